"""Queries of macro, sector, sentiment, options, timing and window-expressible statistical factors."""
from __future__ import annotations

import math

from pyspark.sql import functions as F

from quantloom.functions.series import S, Series
from quantloom.operators import macro as M
from quantloom.operators import relational as REL
from quantloom.operators import sentiment as SE
from quantloom.operators import timing as TI
from quantloom.plans.q_basics import rank_pct, score_pct
from quantloom.plans.q_state_fund import QI, irank
from quantloom.plans.q_technical import BB_STEPS, GL, MACD_STEPS, TR, rsi
from quantloom.plans.registry import query
from quantloom.plans.sql import Q, chain, flag

K = "symbol date"
Y = "sqrt(252::DOUBLE)"


def lad(x, *steps, default):
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in steps) + f" ELSE {default} END"


# --- macro ------------------------------------------------------------------------------------
RC = ({"r10": QI.pct("rate10y")}, {"yield_10y_change_20d": QI.diff("rate10y", 19), "yield_10y_volatility_20d": f"{QI.std('r10', 20)} * {Y} * 100", "yield_curve_slope": "rate10y - rate3m",
      "yield_curve_curvature": "rate30y - 2 * rate10y + rate3m", "real_yield_10y": "rate10y - 2", "rate_environment": lad("", ("rate10y < 2", 1), ("rate10y < 4", 2), default=3)})


@query("macro_rate_curve", "date", "rate3m rate5y rate10y rate30y yield_10y_change_20d yield_10y_volatility_20d yield_curve_slope yield_curve_curvature real_yield_10y", "rate_environment", sql=chain("macro", *RC), tables="macro")
def macro_rate_curve(t):
    return M.rate_curve(t.macro())


IP = ({f"{c}_momentum_60d": f"{QI.pct(c, 59)} * 100" for c in ("gold", "oil", "usd")},
      {"policy_rate_change_60d": QI.diff("rate3m", 59), "commodity_index": "0.6 * gold_momentum_60d + 0.4 * oil_momentum_60d", "inflation_expectation_proxy": f"{irank('rate10y', 252)} * 100", "yield_curve_inversion": flag("rate10y < rate3m")},
      {"monetary_policy_stance": "CASE WHEN policy_rate_change_60d > 0.5 THEN 3 WHEN policy_rate_change_60d > -0.5 THEN 2 WHEN policy_rate_change_60d IS NOT NULL THEN 1 END",
       "inflation_environment": "CASE WHEN commodity_index > 10 THEN 3 WHEN commodity_index > 0 THEN 2 WHEN commodity_index IS NOT NULL THEN 1 END", "liquidity_environment": lad("", ("vix > 30", 1), ("vix > 20", 2), default=3)})


@query("macro_inflation_policy", "date", "gold_momentum_60d oil_momentum_60d usd_momentum_60d policy_rate_change_60d commodity_index inflation_expectation_proxy", "yield_curve_inversion monetary_policy_stance inflation_environment liquidity_environment",
       sql=chain("macro", *IP), tables="macro")
def macro_inflation_policy(t):
    return M.inflation_policy(t.macro())


GRX = ({"e": QI.pct("equity"), "b": f"-{QI.pct('rate10y')}", "u": QI.pct("usd")},
       {"equity_momentum_60d": f"{QI.pct('equity', 59)} * 100", "equity_momentum_1y": f"{QI.pct('equity', 251)} * 100", "equity_volatility_60d": f"{QI.std('e', 60)} * {Y} * 100", "risk_aversion_change_20d": QI.diff("vix", 19),
        "stock_bond_correlation": QI.corr("e", "b", 60), "safe_haven_demand": f"({QI.pct('gold', 19)} - {QI.pct('equity', 19)}) * 100", "liquidity_risk": f"({QI.mean('volume', 5)} / nullif({QI.mean('volume', 55, lo=-59, hi=-5)}, 0) - 1) * 100",
        "var_95": f"{QI.quantile('e', 252, 0.05)} * 100", "usd_volatility_20d": f"{QI.std('u', 20)} * {Y} * 100", "usd_mom": f"{QI.pct('usd', 59)} * 100", "past": f"list(e) OVER {QI.frame(-251)}"},
       {"cvar_95": "CASE WHEN var_95 IS NOT NULL THEN list_avg(list_filter(past, lambda x: x * 100 <= var_95)) * 100 END", "market_stress_index": "(least(vix / 40, 1) + greatest(stock_bond_correlation, 0)) / 2 * 100",
        "economic_cycle": "CASE WHEN equity_momentum_1y > 10 AND vix < 20 THEN 4 WHEN equity_momentum_1y > 0 AND vix < 25 THEN 3 WHEN equity_momentum_1y < -10 AND vix > 30 THEN 1 WHEN equity_momentum_1y IS NOT NULL THEN 2 END",
        "style_rotation": "CASE WHEN equity_momentum_60d > 5 THEN 1 WHEN equity_momentum_60d > -5 THEN 2 WHEN equity_momentum_60d IS NOT NULL THEN 3 END",
        "currency_risk_level": "CASE WHEN usd_volatility_20d > 15 THEN 3 WHEN usd_volatility_20d > 10 THEN 2 WHEN usd_volatility_20d IS NOT NULL THEN 1 END",
        "usd_cycle": "CASE WHEN usd_mom > 5 THEN 3 WHEN usd_mom > -5 THEN 2 WHEN usd_mom IS NOT NULL THEN 1 END"})


@query("macro_growth_risk_fx", "date", "equity_momentum_60d equity_momentum_1y equity_volatility_60d risk_aversion_change_20d stock_bond_correlation safe_haven_demand liquidity_risk var_95 cvar_95 usd_volatility_20d market_stress_index",
       "economic_cycle style_rotation currency_risk_level usd_cycle", sql=chain("macro", *GRX), tables="macro")
def macro_growth_risk_fx(t):
    return M.growth_risk_fx(t.macro())


@query("macro_regime", "date rate_regime inflation_regime policy_regime cycle_regime",
       sql=chain("macro", *RC, *IP, *GRX, {f"{k}_regime": f"coalesce(([{', '.join(repr(x) for x in M.LABELS[k])}])[{c}], 'unknown')" for k, c in
                 (("rate", "rate_environment"), ("inflation", "inflation_environment"), ("policy", "monetary_policy_stance"), ("cycle", "economic_cycle"))}), tables="macro")
def macro_regime(t):
    return M.regime(t.macro())


MF = {k: v for c in ("vix", "gold") for k, v in {f"{c}_pct_1": QI.pct(c), f"{c}_pct_5": QI.pct(c, 5), f"{c}_pct_20": QI.pct(c, 20), f"{c}_ma_20": QI.mean(c, 20), f"{c}_ma_50": QI.mean(c, 50),
      f"{c}_position": f"({c} - {QI.mean(c, 20)}) / nullif({QI.mean(c, 20)}, 0)", f"{c}_vol_20": QI.std(c, 20)}.items()}


@query("macro_feature_join", K, "close " + " ".join(MF), sql=chain("macro", MF, final="SELECT b.symbol, b.date, b.close, m.* EXCLUDE (date, volume) FROM bars b LEFT JOIN {src} m USING (date)"), tables="macro")
def macro_feature_join(t):
    """Features are computed once per calendar date and joined to the bars by date."""
    return t.closes().join(M.macro_features(t.macro(), ["vix", "gold"]), "date", "left")


@query("economic_summary", "date", "cpi_yoy rate_change unemployment_change", sql=chain("macro", {"cpi_yoy": f"{QI.pct('gold', 11)} * 100", "rate_change": QI.diff("rate3m"), "unemployment_change": QI.diff("vix")}, final="SELECT * FROM {src} ORDER BY date DESC LIMIT 1"), tables="macro")
def economic_summary(t):
    return M.economic_summary(t.macro())


PERIODS = (1, 5, 20, 60, 120, 252)
LASTQ = "SELECT * FROM {src} QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1"
SP = chain("industry_panel", {**{f"return_{n}d": f"{Q.pct('close', n)} * 100" for n in PERIODS}, "r": Q.pct("close")}, {"volatility_ann": f"stddev_samp(r) OVER (PARTITION BY symbol) * {Y} * 100"}, final=LASTQ)


@query("sector_performance", K, " ".join(f"return_{n}d" for n in PERIODS) + " volatility_ann", sql=SP, tables="industry_panel")
def sector_performance(t):
    return M.sector_performance(t.industry_panel())


SRS = chain("(SELECT * FROM industry_panel JOIN (SELECT date, mclose FROM market_index) USING (date))", {"rs_ratio": "close / nullif(mclose, 0)"},
            {k: v for n in (5, 20, 60) for k, v in {f"rs_{n}d": f"{Q.pct('rs_ratio', n)} * 100", f"rs_percentile_{n}d": f"{rank_pct('rs_ratio', n)} * 100"}.items()}, final=LASTQ)


def _rs(t):
    return M.relative_strength(t.industry_panel().join(t.market_index(), "date"))


@query("sector_relative_strength", K, "rs_ratio rs_5d rs_20d rs_60d rs_percentile_5d rs_percentile_20d rs_percentile_60d", sql=SRS, tables="industry_panel market_index")
def sector_relative_strength(t):
    return _rs(t)


@query("sector_rotation_signals", "symbol signal confidence volatility_class", "rs_20d rs_percentile_20d", "leader laggard",
       sql=f"WITH r AS ({SRS}), p AS ({SP}), q AS (SELECT quantile_cont(volatility_ann, 0.25) AS q25, quantile_cont(volatility_ann, 0.75) AS q75 FROM p), j AS (SELECT r.*, p.volatility_ann, p.return_20d, p.return_60d, q25, q75, "
           "rs_percentile_20d > 75 AND rs_20d > 0 AS b, rs_percentile_20d < 25 AND rs_20d < 0 AS s FROM r JOIN p USING (symbol) CROSS JOIN q) SELECT *, CASE WHEN b THEN 'BUY' WHEN s THEN 'SELL' ELSE 'HOLD' END AS signal, "
           "CASE WHEN (b AND rs_percentile_20d > 90) OR (s AND rs_percentile_20d < 10) THEN 'HIGH' WHEN b OR s THEN 'MEDIUM' ELSE 'NONE' END AS confidence, CASE WHEN volatility_ann > q75 THEN 'high' WHEN volatility_ann < q25 THEN 'low' ELSE 'normal' END AS volatility_class, "
           "CASE WHEN return_20d > 0 AND return_60d > 0 THEN 1 ELSE 0 END AS leader, CASE WHEN return_20d < -5 THEN 1 ELSE 0 END AS laggard FROM j", tables="industry_panel market_index", staged=True)
def sector_rotation_signals(t):
    return M.rotation_signals(_rs(t), M.sector_performance(t.industry_panel()))


@query("fx_crypto_summary", "symbol", "change_pct volatility dominance average_change",
       sql=chain("industry_panel", {"r": Q.pct("close"), "cap": "close * volume"}, {"volatility": "stddev_samp(r) OVER (PARTITION BY symbol)", "change_pct": "r * 100"}, LASTQ, {"dominance": "cap / sum(cap) OVER () * 100", "average_change": "avg(change_pct) OVER ()"}), tables="industry_panel")
def fx_crypto_summary(t):
    return M.fx_crypto_summary(t.industry_panel())


@query("bond_commodity_summary", "date shape best_performer", "spread_10y_3m spread_10y_5y gold_change oil_change commodity_average",
       sql=chain("macro", {"spread_10y_3m": "rate10y - rate3m", "spread_10y_5y": "rate10y - rate5y", "gold_change": f"{QI.pct('gold')} * 100", "oil_change": f"{QI.pct('oil')} * 100"},
                 {"shape": "CASE WHEN spread_10y_3m > 1 THEN 'steep' WHEN spread_10y_3m > 0 THEN 'normal' WHEN spread_10y_3m > -0.5 THEN 'flat' ELSE 'inverted' END", "commodity_average": "(gold_change + oil_change) / 2",
                  "best_performer": "CASE WHEN gold_change >= oil_change THEN 'gold' WHEN oil_change IS NOT NULL THEN 'oil' ELSE 'none' END"}), tables="macro")
def bond_commodity_summary(t):
    return M.bond_commodity_summary(t.macro())


# --- text -------------------------------------------------------------------------------------
@query("text_polarity_lexicon", "doc_id sentiment", "polarity subjectivity", "hits", sql="SELECT * FROM doc_sentiment", tables="doc_sentiment")
def text_polarity_lexicon(t):
    return t.doc_sentiment()


@query("news_sentiment_summary", "symbol", "avg_polarity avg_subjectivity score", "n positive negative neutral",
       sql="SELECT symbol, count(*) AS n, count(*) FILTER (WHERE sentiment = 'positive') AS positive, count(*) FILTER (WHERE sentiment = 'negative') AS negative, count(*) FILTER (WHERE sentiment = 'neutral') AS neutral, avg(polarity) AS avg_polarity, avg(subjectivity) AS avg_subjectivity, "
           "avg(polarity) * least(count(*) / 10, 1) AS score FROM doc_sentiment GROUP BY symbol", tables="doc_sentiment")
def news_sentiment_summary(t):
    return SE.news_summary(t.doc_sentiment())


# documents carry no time: doc_id modulo 60 spreads ALL of them over sixty days
DAILY_NEWS = ("SELECT lang AS symbol, CAST(DATE '2024-01-01' + CAST(doc_id % 60 AS INTEGER) AS DATE) AS date, avg(0.7 * polarity + 0.3 * subjectivity) AS news_sentiment, count(*) AS mentions FROM doc_sentiment GROUP BY 1, 2")


def daily_news(t):
    d = t.doc_sentiment().withColumn("date", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("doc_id", F.lit(60)).cast("int")))
    return d.groupBy(F.col("lang").alias("symbol"), "date").agg(F.avg(0.7 * F.col("polarity") + 0.3 * F.col("subjectivity")).alias("news_sentiment"), F.count(F.lit(1)).alias("mentions"))


@query("news_sentiment_series", K, "news_sentiment news_sentiment_ma news_sentiment_volatility", sql=chain(f"({DAILY_NEWS})", {"news_sentiment_ma": Q.mean("news_sentiment", 5), "news_sentiment_volatility": Q.std("news_sentiment", 10)}), tables="doc_sentiment")
def news_sentiment_series(t):
    return SE.news_series(daily_news(t))


@query("social_sentiment_series", K, "social_buzz social_sentiment_trend intensity slope_10", "mentions extreme",
       sql=chain(f"(SELECT symbol, date, news_sentiment AS sentiment, mentions FROM ({DAILY_NEWS}))", {"pos": Q.pos()}, {"social_buzz": Q.mean("mentions", 7), "social_sentiment_trend": Q.mean("sentiment", 7), "intensity": "abs(sentiment)", "slope_10": Q.slope("sentiment", 10),
                 "extreme": flag(f"sentiment > {Q.quantile('sentiment', 30, 0.9)} OR sentiment < {Q.quantile('sentiment', 30, 0.1)}")}), tables="doc_sentiment")
def social_sentiment_series(t):
    return SE.social_series(daily_news(t).withColumnRenamed("news_sentiment", "sentiment"))


@query("search_volume_factors", K, "search_volume_anomaly search_volume_trend search_price_correlation",
       sql=chain("returns", {"pos": Q.pos(), "sc": Q.pct("volume")}, {"search_volume_anomaly": f"(volume - {Q.mean('volume', 30)}) / nullif({Q.std('volume', 30)}, 0)", "search_volume_trend": Q.slope("volume", 10), "search_price_correlation": Q.corr("ret", "sc", 20)}), tables="returns")
def search_volume_factors(t):
    """Traded volume stands in for the search series."""
    return SE.search_volume(t.bars(), "volume")


SPD = ("SELECT b.symbol, b.date, b.close, s.sentiment FROM bars b ASOF LEFT JOIN (SELECT symbol, date, volume / 100 - 0.25 AS sentiment FROM second_source) s ON b.symbol = s.symbol AND b.date >= s.date")


@query("sentiment_price_divergence", K, "news_sentiment_momentum news_sentiment_reversal news_sentiment_vol news_price_divergence",
       sql=chain(f"({SPD})", {"news_sentiment_momentum": Q.mean("sentiment", 5), "news_sentiment_reversal": f"-{Q.mean('sentiment', 20)}", "news_sentiment_vol": Q.std("sentiment", 10), "news_price_divergence": f"{Q.mean('sentiment', 5)} - {Q.pct('close', 5)}"}), tables="second_source")
def sentiment_price_divergence(t):
    sp = t.second_source().select("symbol", "date", (F.col("volume") / 100 - 0.25).alias("sentiment"))
    return SE.sentiment_divergence(REL.asof_ffill(t.closes(), sp, ["sentiment"]))


@query("composite_alternative", K, "composite strength",
       sql=chain("returns", {"m20": Q.pct("close", 20), "v20": Q.std("ret", 20), "lv": "ln(volume)"}, {"z": "list_filter([" + ", ".join(f"({c} - avg({c}) OVER ()) / nullif(stddev_samp({c}) OVER (), 0)" for c in ("m20", "v20", "lv")) + "], lambda x: x IS NOT NULL)"},
                 {"composite": "list_avg(z)", "strength": "list_avg(list_transform(z, lambda x: abs(x)))"}), tables="returns")
def composite_alternative(t):
    d = t.returns().withColumns({"m20": S.pct("close", 20), "v20": S.std("ret", 20), "lv": F.log("volume")})
    return SE.composite_alternative(d, ["m20", "v20", "lv"])


MSF = {"vix_change": Q.pct("vix"), "vix_zscore": f"(vix - {Q.mean('vix', 60)}) / nullif({Q.std('vix', 60)}, 0)", "volume_sentiment": f"volume / nullif({Q.mean('volume', 20)}, 0) - 1", "price_momentum_sentiment": Q.pct("close", 10), "volatility_sentiment": f"{Q.mean('tr', 14)} / nullif(close, 0)",
       "vwap_sentiment": f"(close - {Q.sum('pv', 10)} / nullif({Q.sum('volume', 10)}, 0)) / nullif(close, 0)"}


@query("market_sentiment_factors", K, " ".join(MSF), sql=chain("(SELECT b.*, m.vix FROM bars b LEFT JOIN macro m USING (date))", {"tr": TR, "pv": "(high + low + close) / 3 * volume"}, MSF), tables="macro")
def market_sentiment_factors(t):
    return SE.market_sentiment(t.bars().join(t.macro().select("date", "vix"), "date", "left"))


def tri(x, hi, lo):
    return f"CASE WHEN {x} > {hi} THEN 1 WHEN {x} < {lo} THEN -1 ELSE 0 END"


TSF = {"rsi_sentiment": tri("rsi_", 70, 30), "stoch_sentiment": tri("k_", 80, 20), "bollinger_sentiment": tri("close", "m_ + 2 * sd_", "m_ - 2 * sd_"), "williams_sentiment": tri("w_", -20, -80), "short_momentum_sentiment": tri(Q.pct("close", 5), 0.05, -0.05),
       "medium_momentum_sentiment": tri(Q.pct("close", 20), 0.1, -0.1)}


@query("technical_sentiment_flags", K, "", " ".join(TSF), sql=chain("bars", {"d": Q.diff("close"), "hh": Q.max("high", 14), "ll": Q.min("low", 14), "m_": Q.mean("close", 20), "sd_": Q.std("close", 20)}, GL,
       {"rsi_": rsi(Q.mean("g", 14), Q.mean("l", 14)), "k_": "100 * (close - ll) / nullif(hh - ll, 0)", "w_": "-100 * (hh - close) / nullif(hh - ll, 0)"}, TSF), tables="bars")
def technical_sentiment_flags(t):
    return SE.technical_flags(t.bars())


@query("volume_sentiment_flags", K, "vpt_sentiment obv_sentiment volume_strength", "price_volume_divergence mfi_sentiment",
       sql=chain("returns", {"d": Q.diff("close"), "tp": "(high + low + close) / 3", "rv": "ret * volume"}, {"td": Q.diff("tp"), "sv": "sign(d) * volume"},
                 {"vpt": f"CASE WHEN ret IS NOT NULL THEN {Q.cum('sum(rv)')} END", "obv": f"CASE WHEN d IS NOT NULL THEN {Q.cum('sum(sv)')} END", "up": "CASE WHEN td > 0 THEN tp * volume ELSE 0.0 END", "dn": "CASE WHEN td < 0 THEN tp * volume ELSE 0.0 END", "pc": Q.pct("close", 10), "vc": Q.pct("volume", 10)},
                 {"vpt_sentiment": Q.pct("vpt", 10), "obv_sentiment": Q.pct("obv", 10), "volume_strength": f"volume / nullif({Q.mean('volume', 20)}, 0) - 1", "mfi": rsi(Q.sum("up", 14), Q.sum("dn", 14)),
                  "price_volume_divergence": "CASE WHEN pc > 0 AND vc < 0 THEN -1 WHEN pc < 0 AND vc > 0 THEN 1 ELSE 0 END"}, {"mfi_sentiment": tri("mfi", 80, 20)}), tables="returns")
def volume_sentiment_flags(t):
    return SE.volume_flags(t.bars())


@query("sentiment_score_ladder", "symbol date level", "sentiment_score",
       sql=chain("bars", *BB_STEPS, {"d": Q.diff("close")}, GL, *MACD_STEPS, {"r": f"coalesce({rsi(Q.mean('g', 14), Q.mean('l', 14))}, 50)", "mo": f"coalesce({Q.pct('close', 20)}, 0)", "vr": f"coalesce(volume / nullif({Q.mean('volume', 20)}, 0), 1)", "bp": "coalesce(bb_position, 0.5)"},
                 {"sentiment_score": "0.2::DOUBLE * (CASE WHEN r > 70 THEN 20 WHEN r < 30 THEN 80 ELSE 50 + (r - 50) * 0.5::DOUBLE END) + 0.25::DOUBLE * (CASE WHEN macd_histogram > 0 THEN 75 WHEN macd_histogram < 0 THEN 25 ELSE 50 END) + 0.2::DOUBLE * (CASE WHEN bp > 0.8 THEN 20 WHEN bp < 0.2 THEN 80 ELSE 50 + (bp - 0.5::DOUBLE) * 40 END) "
                  "+ 0.15::DOUBLE * least(greatest(50 + mo * 1000, 0), 100) + 0.2::DOUBLE * (CASE WHEN vr > 1.5 THEN 70 WHEN vr < 0.7 THEN 30 ELSE 50 END)"},
                 {"level": "CASE WHEN round(sentiment_score, 9) >= 70 THEN 'positive' WHEN round(sentiment_score, 9) >= 60 THEN 'leaning positive' WHEN round(sentiment_score, 9) >= 40 THEN 'leaning negative' ELSE 'negative' END"}), tables="bars")
def sentiment_score_ladder(t):
    return SE.score_ladder(t.bars())


FG = {"vix_like": f"v * {Y} * 100", "fear_index": f"{Q.mean('neg', 20)} * {Q.mean('fn', 20)} * 100", "greed_index": f"{Q.mean('pos', 20)} * {Q.mean('fp', 20)} * 100 * (1 + {Q.mean('vr', 5)})", "sentiment_oscillator": rsi(Q.mean("pos", 14), Q.mean("neg", 14)),
      "investor_sentiment": f"{Q.pct('close', 20)} * 0.4 - v / nullif({Q.mean('v', 60)}, 0) * 0.3 + (volume / nullif({Q.mean('volume', 60)}, 0) - 1) * 0.3", "market_stress": f"{Q.mean('ext', 20)} * 100"}


@query("fear_greed_vix_like", K, " ".join(FG), sql=chain("returns", {"neg": "CASE WHEN ret < 0 THEN -ret ELSE 0.0 END", "pos": "CASE WHEN ret > 0 THEN ret ELSE 0.0 END", "fn": flag("ret < 0"), "fp": flag("ret > 0"), "v": Q.std("ret", 20), "vr": f"volume / nullif({Q.mean('volume', 20)}, 0)",
       "ext": flag(f"abs(ret) > 2 * {Q.std('ret', 60)}")}, FG), tables="returns")
def fear_greed_vix_like(t):
    return SE.fear_greed(t.bars())


@query("herding_overreaction", K, "herding overreaction",
       sql=chain("returns", {"k": Q.pos(), "big": flag(f"abs(ret) > 2 * {Q.std('ret', 60)}"), "a": f"stddev_samp(ret) OVER {Q.frame(-20, -1)}", "b": f"stddev_samp(ret) OVER {Q.frame(-40, -21)}", "na": f"count(ret) OVER {Q.frame(-20, -1)}", "nb": f"count(ret) OVER {Q.frame(-40, -21)}", "pr": Q.lag("ret")},
                 {"herding": "CASE WHEN na > 5 AND nb > 5 AND k > 40 THEN 1 - abs(a - b) / nullif(b, 0) END", "o": f"CASE WHEN k > 20 THEN (CASE WHEN {Q.lag('big')} = 1 AND pr * ret < 0 THEN abs(ret / nullif(pr, 0)) ELSE 0 END) END"}, {"overreaction": Q.mean("o", 20)}), tables="returns")
def herding_overreaction(t):
    return SE.herding_overreaction(t.closes())


# --- options ----------------------------------------------------------------------------------
@query("options_chain_summary", "symbol expiry", "call_volume put_volume call_iv put_iv put_call_ratio", "n bearish",
       sql="WITH g AS (SELECT symbol, expiry, sum(CASE WHEN side = 'call' THEN volume END) AS call_volume, sum(CASE WHEN side = 'put' THEN volume END) AS put_volume, avg(CASE WHEN side = 'call' THEN iv END) AS call_iv, avg(CASE WHEN side = 'put' THEN iv END) AS put_iv, count(*) AS n FROM options GROUP BY 1, 2) "
           "SELECT *, put_volume / nullif(call_volume, 0) AS put_call_ratio, CASE WHEN put_volume / nullif(call_volume, 0) > 1 THEN 1 ELSE 0 END AS bearish FROM g", tables="options")
def options_chain_summary(t):
    return SE.chain_summary(t.options())


OD = "SELECT date, " + ", ".join(f"{f}(CASE WHEN side = '{k}' THEN {x} END)::DOUBLE AS {k}_{n}" for k in ("call", "put") for n, x, f in (("volume", "volume", "sum"), ("iv", "iv", "avg"), ("oi", "open_interest", "sum"))) + " FROM options GROUP BY 1"
OS_ = chain(f"({OD})", {"put_call_ratio": "put_volume / nullif(call_volume, 0)", "iv_skew": "put_iv - call_iv", "oi_ratio": "put_oi / nullif(call_oi, 0)"},
            {"put_call_ratio_ma": QI.mean("put_call_ratio", 5), "pc_ratio_sentiment": f"CASE WHEN put_call_ratio > {QI.mean('put_call_ratio', 10)} + {QI.std('put_call_ratio', 10)} THEN -1 WHEN put_call_ratio < {QI.mean('put_call_ratio', 10)} - {QI.std('put_call_ratio', 10)} THEN 1 ELSE 0 END",
             "iv_skew_sentiment": f"CASE WHEN iv_skew > {QI.mean('iv_skew', 10)} + {QI.std('iv_skew', 10)} THEN -1 ELSE 1 END", "oi_ratio_sentiment": f"CASE WHEN oi_ratio > {QI.mean('oi_ratio', 10)} THEN -1 ELSE 1 END"})


@query("options_sentiment_series", "date", "put_call_ratio put_call_ratio_ma iv_skew oi_ratio", "pc_ratio_sentiment iv_skew_sentiment oi_ratio_sentiment", sql=OS_, tables="options")
def options_sentiment_series(t):
    """Market-wide daily series (one row per day); the sample has thirty days, hence windows of 5 and 10."""
    return SE.options_series(SE.options_by_day(t.options()), 5, 10, Series((), ("date",)))


@query("iv_rank_term_structure", K, "iv_percentile iv_rank iv_term_structure", sql=chain("returns", {"iv": f"{Q.std('ret', 20)} * {Y}"}, {"iv_percentile": score_pct("iv", 60), "iv_rank": rank_pct("iv", 60), "iv_term_structure": f"{Q.mean('iv', 30)} / nullif({Q.mean('iv', 90)}, 0) - 1"}), tables="returns")
def iv_rank_term_structure(t):
    """Realised volatility stands in for the implied one."""
    return SE.iv_rank(t.returns().withColumn("iv", S.std("ret", 20) * SE.YEAR), "iv", 60)


T30, RV = 30 / 365, 0.02
ERF = "(CASE WHEN {x} >= 0 THEN 1 - {tail} ELSE {tail} END)"


def ncdf(x):
    tt = f"(1 / (1 + 0.2316419::DOUBLE * abs({x})))"
    poly = f"({tt} * (0.319381530::DOUBLE + {tt} * (-0.356563782::DOUBLE + {tt} * (1.781477937::DOUBLE + {tt} * (-1.821255978::DOUBLE + {tt} * 1.330274429::DOUBLE)))))"
    tail = f"(exp(-{x} * {x} / 2) / {math.sqrt(2 * math.pi)!r} * {poly})"
    return ERF.format(x=x, tail=tail)


SQ = f"(0.2::DOUBLE * {math.sqrt(T30)!r})"


@query("option_greeks", K, "delta gamma theta vega rho delta_simple gamma_simple",
       sql=chain("bars", {"k": "first_value(close) OVER (PARTITION BY symbol ORDER BY date)"}, {"d1": f"(ln(close / k) + {(RV + 0.02) * T30!r}) / {SQ}"}, {"d2": f"d1 - {SQ}", "dens": f"exp(-d1 * d1 / 2) / {math.sqrt(2 * math.pi)!r}"},
                 {"delta": ncdf("d1"), "gamma": f"dens / (close * {SQ})", "theta": f"(-close * dens * 0.2 / (2 * {math.sqrt(T30)!r}) - {RV * math.exp(-RV * T30)!r} * k * {ncdf('d2')}) / 365", "vega": f"close * dens * {math.sqrt(T30)!r} / 100",
                  "rho": f"k * {T30 * math.exp(-RV * T30)!r} * {ncdf('d2')} / 100", "delta_simple": "least(greatest(0.5 + 0.3 * (close / k - 1), 0), 1)", "gamma_simple": "0.01::DOUBLE * exp(-0.5::DOUBLE * (close / k - 1) * (close / k - 1))"}), tables="bars")
def option_greeks(t):
    return SE.option_greeks(t.closes())


@query("analyst_rating_summary", "sector", "mean_target upside", "n buy hold sell",
       sql="SELECT sector, count(*) AS n, count(*) FILTER (WHERE ret > 0.3) AS buy, count(*) FILTER (WHERE ret BETWEEN -0.3 AND 0.3) AS hold, count(*) FILTER (WHERE ret < -0.3) AS sell, avg(high) AS mean_target, (avg(high) / avg(close) - 1) * 100 AS upside FROM returns JOIN sector USING (symbol) WHERE ret IS NOT NULL GROUP BY sector", tables="returns sector")
def analyst_rating_summary(t):
    """Bars stand in for rating rows: the return is the opinion, the high is the target."""
    r = F.col("ret")
    return (t.returns().where(r.isNotNull()).join(t.sector(), "symbol").groupBy("sector").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(r > 0.3).alias("buy"), F.count_if(r.between(-0.3, 0.3)).alias("hold"), F.count_if(r < -0.3).alias("sell"), F.avg("high").alias("mean_target"),
        ((F.try_divide(F.avg("high"), F.avg("close")) - 1) * 100).alias("upside")))


# --- timing and statistical -------------------------------------------------------------------
TF = {"advance_decline_ratio": f"{Q.sum('adv', 20)} / ({Q.sum('dec_', 20)} + 1e-8::DOUBLE)", "new_high_low_ratio": f"{Q.sum('nh', 20)} / ({Q.sum('nl', 20)} + 1e-8::DOUBLE)", "money_flow_index": f"100 - 100 / (1 + {Q.sum('up', 14)} / ({Q.sum('dn', 14)} + 1e-8::DOUBLE))",
      "market_strength": f"{Q.mean('pr', 20)} / ({Q.mean('nr', 20)} + 1e-8::DOUBLE)", "momentum_timing": f"0.5 * {Q.pct('close', 5)} + 0.3 * {Q.pct('close', 10)} + 0.2 * {Q.pct('close', 20)}",
      "ma_timing_signal": f"({flag('ma5 > ma10')} + {flag('ma10 > ma20')} + {flag('ma20 > ma60')} + {flag('close > ma5')}) / 4", "support_resistance_timing": f"(close - {Q.min('low', 20)}) / ({Q.max('high', 20)} - {Q.min('low', 20)} + 1e-8::DOUBLE)",
      "volatility_mean_reversion": f"-(vol - {Q.mean('vol', 60)}) / ({Q.mean('vol', 60)} + 1e-8::DOUBLE)", "volatility_clustering": Q.corr("v5", "v5l", 19), "net_money_flow": Q.sum("nf", 20), "large_order_flow": Q.sum("lg", 10), "institutional_flow": Q.sum("inn", 10), "retail_sentiment": Q.sum("rt", 10)}
TFI = {"breakout_timing": tri("close", "ma20 + 2 * sd20", "ma20 - 2 * sd20"), "swing_timing": "CASE WHEN rsi_ < 30 THEN 1 WHEN rsi_ > 70 THEN -1 ELSE 0 END", "volatility_breakout": flag(f"vol > {Q.quantile('vol', 60, 0.8)}"), "volatility_timing_signal": f"CASE WHEN vr < 0.2 THEN 1 WHEN vr > 0.8 THEN -1 ELSE 0 END"}


@query("timing_factors", K, " ".join(TF), " ".join(TFI),
       sql=chain("returns", {"d": Q.diff("close"), "tp": "(high + low + close) / 3", "adv": flag("ret > 0"), "dec_": flag("ret < 0"), "nh": flag(f"high >= {Q.max('high', 252)}"), "nl": flag(f"low <= {Q.min('low', 252)}"), "vol": Q.std("ret", 20), "v5": Q.std("ret", 5), "vma": Q.mean("volume", 20), "vc": Q.pct("volume"),
                             "pr": "CASE WHEN ret > 0 THEN ret ELSE 0.0 END", "nr": "CASE WHEN ret < 0 THEN -ret ELSE 0.0 END", "sd20": Q.std("close", 20), **{f"ma{n}": Q.mean("close", n) for n in (5, 10, 20, 60)}}, GL,
                 {"td": Q.diff("tp"), "v5l": Q.lag("v5"), "mf": "tp * volume", "rsi_": f"100 - 100 / (1 + {Q.mean('g', 14)} / ({Q.mean('l', 14)} + 1e-8::DOUBLE))", "vr": rank_pct("vol", 252)},
                 {"up": "CASE WHEN td > 0 THEN mf ELSE 0.0 END", "dn": "CASE WHEN td < 0 THEN mf ELSE 0.0 END", "nf": "CASE WHEN d > 0 THEN mf WHEN d < 0 THEN -mf ELSE 0.0 END", "lg": "CASE WHEN volume > vma * 1.5 THEN coalesce(sign(ret), 0) ELSE 0 END",
                  "inn": "CASE WHEN vc > 0 THEN coalesce(sign(ret), 0) ELSE 0 END", "rt": "CASE WHEN volume < vma * 0.8 THEN ret ELSE 0.0 END"}, {**TF, **TFI}), tables="returns")
def timing_factors(t):
    return TI.timing_factors(t.bars())


@query("hf_returns_stats", K, "jump_intensity realized_volatility realized_skewness realized_kurtosis",
       sql=chain("returns", {"j": flag(f"abs(ret / nullif({Q.std('ret', 20)}, 0)) > 3"), "r2": "ret * ret"}, {"jump_intensity": Q.sum("j", 20), "realized_volatility": f"sqrt({Q.sum('r2', 20)})", "realized_skewness": Q.skew("ret", 20), "realized_kurtosis": Q.kurt("ret", 20)}), tables="returns")
def hf_returns_stats(t):
    return TI.hf_returns_stats(t.closes())


@query("hf_efficiency_impact", K, "price_efficiency microstructure_noise price_impact",
       sql=chain("returns", {"a": f"abs({Q.diff('close')})", "rl": Q.lag("ret"), "k": Q.pos()}, {"path": f"sum(a) OVER {Q.frame(-19, -1)}", "nr": f"count(ret) OVER {Q.frame(-20, -1)}"},
                 {"price_efficiency": f"CASE WHEN k > 20 THEN (CASE WHEN path > 0 THEN abs({Q.lag('close', 1)} - {Q.lag('close', 20)}) / path ELSE 0 END) END", "microstructure_noise": f"-{Q.corr('ret', 'rl', 19)}", "price_impact": f"CASE WHEN k > 20 AND nr > 5 THEN coalesce({Q.corr('ret', 'rl', 20, 2, lo=-19, hi=-1)}, 0) END"}), tables="returns")
def hf_efficiency_impact(t):
    return TI.hf_efficiency_impact(t.closes())


@query("hf_liquidity", K, "amihud vwap_factor order_flow_imbalance spread_estimate hf_momentum",
       sql=chain("returns", {"tp": "(high + low + close) / 3", "il": "abs(ret) / nullif(close * volume, 0)", "m20": Q.sum("ret", 20), "of_": "CASE WHEN ret > 0 THEN 1.0::DOUBLE WHEN ret < 0 THEN -1.0::DOUBLE END"}, {"pv": "tp * volume"}, {"vwap": f"{Q.sum('pv', 20)} / nullif({Q.sum('volume', 20)}, 0)"},
                 {"amihud": Q.mean("il", 20), "vwap_factor": "(tp - vwap) / nullif(vwap, 0)", "order_flow_imbalance": Q.mean("of_", 10), "spread_estimate": "(high - low) / nullif(close, 0)", "hf_momentum": f"{Q.sum('ret', 5)} / nullif({Q.std('m20', 5)}, 0)"}), tables="returns")
def hf_liquidity(t):
    return TI.hf_liquidity(t.bars())


@query("tick_microstructure", "symbol", "volatility avg_spread spread_volatility price_vwap_deviation price_impact",
       sql="WITH o AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, event_id DESC) AS rn FROM ticks), l AS (SELECT *, price / 1000 AS spread, ln(price) - ln(lag(price) OVER (PARTITION BY symbol ORDER BY rn DESC)) AS lr FROM o WHERE rn <= 1000) "
           "SELECT symbol, stddev_pop(lr) * sqrt(252 * 24 * 60::DOUBLE) AS volatility, avg(spread) AS avg_spread, stddev_pop(spread) AS spread_volatility, arg_min(price, rn) / (sum(CASE WHEN rn <= 20 THEN price * size END) / nullif(sum(CASE WHEN rn <= 20 THEN size END), 0)) - 1 AS price_vwap_deviation, "
           "avg(CASE WHEN rn <= 10 THEN abs(lr) END) AS price_impact FROM l GROUP BY symbol", tables="ticks")
def tick_microstructure(t):
    from quantloom.streaming.ticks import last_ticks_microstructure
    return last_ticks_microstructure(t.ticks())


HM = chain("bars", {"x": f"ln(close / nullif({Q.lag('close')}, 0))"}, {"skew": Q.skew("x", 50), "kurt": Q.kurt("x", 50), "arr": f"list(x) OVER {Q.frame(-49)}", "mu": Q.mean("x", 50), "sd": Q.std0("x", 50), "cnt": f"count(x) OVER {Q.frame(-49)}"},
           {"excess": "kurt - 3", "jarque_bera": "50 / 6 * (skew * skew + pow(kurt - 3, 2) / 4)", **{f"moment_{k}": f"CASE WHEN cnt >= 50 THEN list_avg(list_transform(list_filter(arr, lambda a: a IS NOT NULL), lambda a: pow(a - mu, {k}))) / nullif(pow(sd, {k}), 0) END" for k in (5, 6)}})


@query("higher_moments", K, "skew kurt excess jarque_bera moment_5 moment_6", sql=HM, tables="bars")
def higher_moments(t):
    return TI.higher_moments(t.closes())


@query("seasonal_component_ts", K, "trend_strength month_component weekday_component", "volatility_regime",
       sql=chain("returns", {"pos": Q.pos(), "v": Q.std("ret", 20)}, {"trend_strength": Q.slope("close", 20), "month_component": "avg(ret) OVER (PARTITION BY symbol, month(date))", "weekday_component": "avg(ret) OVER (PARTITION BY symbol, isodow(date))",
                 "volatility_regime": f"CASE WHEN v > {Q.mean('v', 60)} * 1.2 THEN 1 WHEN v < {Q.mean('v', 60)} * 0.8 THEN -1 ELSE 0 END"}), tables="returns")
def seasonal_component_ts(t):
    return TI.time_series_components(t.closes())


@query("zscore_anomaly", K, "z", "anomaly", sql=chain("returns", {"z": f"(ret - {Q.mean('ret', 20)}) / nullif({Q.std('ret', 20)}, 0)"}, {"anomaly": flag("abs(z) > 2")}), tables="returns")
def zscore_anomaly(t):
    return TI.zscore_anomaly(t.closes())
