"""Sentiment, alternative and options factors."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.series import S, Series, div, flag, ladder, with_pos
from quantloom.operators.risk import YEAR, daily_returns
from quantloom.operators.technical import bollinger_family, gains_losses, macd_family, rsi_from, true_range

# fixed values: a short list of opinion words of our own per language, as (words, polarity, subjectivity)
OPINIONS = {
    "en": [("good gain rise strong profit", 0.5, 0.5), ("great excellent win", 0.8, 0.75), ("bad loss fall weak risk", -0.5, 0.5), ("terrible crash fraud", -0.8, 0.8)],
    "fr": [("bon bonne hausse gain fort", 0.5, 0.5), ("excellent excellente succès", 0.8, 0.75), ("mauvais mauvaise baisse perte faible", -0.5, 0.5), ("terrible échec fraude", -0.8, 0.8)],
    "de": [("gut gute gewinn anstieg stark", 0.5, 0.5), ("ausgezeichnet großartig erfolg", 0.8, 0.75), ("schlecht schlechte verlust rückgang schwach", -0.5, 0.5), ("schrecklich absturz betrug", -0.8, 0.8)],
    "es": [("bueno buena ganancia alza fuerte", 0.5, 0.5), ("excelente éxito", 0.8, 0.75), ("malo mala pérdida caída débil", -0.5, 0.5), ("terrible fracaso fraude", -0.8, 0.8)],
}


def default_lexicon() -> list[tuple[str, int, int]]:
    """(token, polarity, subjectivity) in whole hundredths, so that sums do not depend on their order; shared words stand once."""
    words = {w: (round(p * 100), round(s * 100)) for groups in OPINIONS.values() for ws, p, s in groups for w in ws.split()}
    return [(w, p, s) for w, (p, s) in sorted(words.items())]


#: Words of a learned lexicon.
LEXICON_WORDS = 2000


def learn_lexicon(docs: DataFrame, labels: DataFrame, text: str, key: str = "doc_id", mark: str = "quality", least: int = 5, words: int = LEXICON_WORDS) -> DataFrame:
    """(token, pol, sub): the words that tell documents marked 1 from those marked 0 best.

    The polarity of a word is the difference of its shares of the two kinds over their sum, in whole hundredths by integer
    division, and its size is the subjectivity.  A word counts once per document; words of fewer than ``least`` marked documents are left
    out.  The lexicon is the ``words`` strongest, so it has a fixed largest size.
    """
    marked = docs.join(labels.where(F.col(mark).isNotNull()).select(key, F.col(mark).alias("_m")), key)
    n = marked.agg(F.count_if(F.col("_m") == 1).alias("_good"), F.count_if(F.col("_m") == 0).alias("_bad"))  # one row
    each = marked.select("_m", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), 1))).alias("token"))
    seen = each.groupBy("token").agg(F.count_if(F.col("_m") == 1).alias("a"), F.count_if(F.col("_m") == 0).alias("b")).where(F.col("a") + F.col("b") >= least)
    pol = F.expr("(100 * (a * _bad - b * _good)) div nullif(a * _bad + b * _good, 0)")
    scored = seen.join(F.broadcast(n)).withColumn("pol", pol).where(F.col("pol") != 0)
    best = scored.orderBy(F.desc(F.abs("pol")), F.desc(F.col("a") + F.col("b")), "token").limit(words)
    return best.select("token", "pol", F.abs("pol").alias("sub"))


def text_polarity(df: DataFrame, text: str, lexicon: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """Mean polarity and subjectivity of the lexicon words of each whole text, with label and confidence.

    ``lexicon`` is a table (token, pol, sub) of any size, in hundredths.  Words are runs of letters of any
    alphabet; only those that are in the lexicon, counted per text inside the tasks, are shuffled.
    """
    if lexicon is None:
        lexicon = df.sparkSession.createDataFrame(default_lexicon(), "token string, pol long, sub long")
    words = df.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), 1)).alias("token"))
    known = words.join(lexicon, "token").groupBy(key).agg(F.sum("pol").alias("_p"), F.sum("sub").alias("_s"), F.count(F.lit(1)).alias("hits"))
    d = df.join(known, key, "left").withColumn("hits", F.coalesce("hits", F.lit(0)))

    def mean(total):
        return F.coalesce(F.try_divide(F.col(total).cast("double"), F.col("hits") * 100), F.lit(0.0))
    d = d.withColumns({"polarity": mean("_p"), "subjectivity": mean("_s")}).drop("_p", "_s")
    p = F.col("polarity")
    return d.withColumns({"sentiment": ladder([(p > 0.1, "positive"), (p < -0.1, "negative")], "neutral"), "confidence": F.abs(p)})


def news_summary(docs: DataFrame) -> DataFrame:
    s = F.col("sentiment")
    g = docs.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(s == k).alias(k) for k in ("positive", "negative", "neutral")],
                                   F.avg("polarity").alias("avg_polarity"), F.avg("subjectivity").alias("avg_subjectivity"))
    return g.withColumn("score", F.col("avg_polarity") * F.least(F.col("n") / 10, F.lit(1.0)))


def news_series(daily: DataFrame, s: Series = S) -> DataFrame:
    return daily.withColumns({"news_sentiment_ma": s.mean("news_sentiment", 5), "news_sentiment_volatility": s.std("news_sentiment", 10)})


def social_series(daily: DataFrame, s: Series = S) -> DataFrame:
    """Mentions and mean sentiment per day: buzz, trend, intensity and 30-row extreme flags."""
    x = F.col("sentiment")
    d = with_pos(daily, s)
    return d.withColumns({"social_buzz": s.mean("mentions", 7), "social_sentiment_trend": s.mean(x, 7), "intensity": F.abs(x), "slope_10": s.slope(x, 10),
                          "extreme": flag((x > s.quantile(x, 30, 0.9)) | (x < s.quantile(x, 30, 0.1)))}).drop("_pos")


def search_volume(df: DataFrame, search="search", s: Series = S) -> DataFrame:
    v = F.col(search)
    d = with_pos(daily_returns(df, s), s).withColumn("_sc", s.pct(v))
    return d.withColumns({"search_volume_anomaly": div(v - s.mean(v, 30), s.std(v, 30)), "search_volume_trend": s.slope(v, 10), "search_price_correlation": s.corr("ret", "_sc", 20)}).drop("_pos", "_sc")


def sentiment_divergence(df: DataFrame, sent="sentiment", s: Series = S) -> DataFrame:
    x = F.col(sent)
    return df.withColumns({"news_sentiment_momentum": s.mean(x, 5), "news_sentiment_reversal": -s.mean(x, 20), "news_sentiment_vol": s.std(x, 10),
                           "news_price_divergence": s.mean(x, 5) - s.pct("close", 5)})


def composite_alternative(df: DataFrame, cols) -> DataFrame:
    """Row mean (and mean absolute value) of globally standardised factors."""
    from quantloom.functions.exact import with_group_stats
    d = with_group_stats(df, [], {f"_{k}_{c}": a(c) for c in cols for k, a in (("m", F.avg), ("s", F.stddev_samp))})
    zs = F.filter(F.array(*[div(F.col(c) - F.col(f"_m_{c}"), f"_s_{c}") for c in cols]), lambda z: z.isNotNull())
    d = d.withColumn("_z", zs)
    return d.withColumns({"composite": F.try_divide(F.aggregate("_z", F.lit(0.0), lambda a, z: a + z), F.size("_z")),
                          "strength": F.try_divide(F.aggregate("_z", F.lit(0.0), lambda a, z: a + F.abs(z)), F.size("_z"))}).drop("_z")


def market_sentiment(df: DataFrame, vix="vix", s: Series = S) -> DataFrame:
    v = F.col(vix)
    d = df.withColumns({"_tr": true_range(s), "_pv": (F.col("high") + F.col("low") + F.col("close")) / 3 * F.col("volume")})
    return d.withColumns({"vix_change": s.pct(v), "vix_zscore": div(v - s.mean(v, 60), s.std(v, 60)), "volume_sentiment": div("volume", s.mean("volume", 20)) - 1,
                          "price_momentum_sentiment": s.pct("close", 10), "volatility_sentiment": div(s.mean("_tr", 14), "close"),
                          "vwap_sentiment": div(F.col("close") - div(s.sum("_pv", 10), s.sum("volume", 10)), "close")}).drop("_tr", "_pv")


def tri(x: Column, hi, lo) -> Column:
    """1 above hi, -1 below lo, else 0 (also for NULL)."""
    return ladder([(x > hi, 1), (x < lo, -1)], 0)


def technical_flags(df: DataFrame, s: Series = S) -> DataFrame:
    c = F.col("close")
    d = gains_losses(df, s).withColumns({"_hh": s.max("high", 14), "_ll": s.min("low", 14), "_m": s.mean(c, 20), "_sd": s.std(c, 20)})
    d = d.withColumns({"_rsi": rsi_from(s.mean("_gain", 14), s.mean("_loss", 14)), "_k": 100 * div(c - F.col("_ll"), F.col("_hh") - F.col("_ll")),
                       "_w": -100 * div(F.col("_hh") - c, F.col("_hh") - F.col("_ll"))})
    return d.withColumns({"rsi_sentiment": tri(F.col("_rsi"), 70, 30), "stoch_sentiment": tri(F.col("_k"), 80, 20), "bollinger_sentiment": ladder([(c > F.col("_m") + 2 * F.col("_sd"), 1), (c < F.col("_m") - 2 * F.col("_sd"), -1)], 0),
                          "williams_sentiment": tri(F.col("_w"), -20, -80), "short_momentum_sentiment": tri(s.pct(c, 5), 0.05, -0.05), "medium_momentum_sentiment": tri(s.pct(c, 20), 0.1, -0.1)}
                         ).drop("_d", "_gain", "_loss", "_hh", "_ll", "_m", "_sd", "_rsi", "_k", "_w")


def volume_flags(df: DataFrame, s: Series = S) -> DataFrame:
    v = F.col("volume")
    d = daily_returns(df, s).withColumns({"_d": s.diff("close"), "_tp": (F.col("high") + F.col("low") + F.col("close")) / 3})
    d = d.withColumn("_td", s.diff("_tp"))
    d = d.withColumns({"_vpt": F.when(F.col("ret").isNotNull(), s.cumsum(F.col("ret") * v)), "_obv": F.when(F.col("_d").isNotNull(), s.cumsum(F.signum("_d") * v)),
                       "_up": F.when(F.col("_td") > 0, F.col("_tp") * v).otherwise(0.0), "_dn": F.when(F.col("_td") < 0, F.col("_tp") * v).otherwise(0.0)})
    pc, vc = s.pct("close", 10), s.pct(v, 10)
    mfi = rsi_from(s.sum("_up", 14), s.sum("_dn", 14))
    d = d.withColumns({"vpt_sentiment": s.pct("_vpt", 10), "obv_sentiment": s.pct("_obv", 10), "volume_strength": div(v, s.mean(v, 20)) - 1, "_pc": pc, "_vc": vc, "_mfi": mfi})
    return d.withColumns({"price_volume_divergence": ladder([((F.col("_pc") > 0) & (F.col("_vc") < 0), -1), ((F.col("_pc") < 0) & (F.col("_vc") > 0), 1)], 0),
                          "mfi_sentiment": tri(F.col("_mfi"), 80, 20)}).drop("_d", "_tp", "_td", "_vpt", "_obv", "_up", "_dn", "_pc", "_vc", "_mfi")


def score_ladder(df: DataFrame, s: Series = S) -> DataFrame:
    """0 .. 100 score: RSI 20 %, MACD 25 %, Bollinger 20 %, momentum 15 %, volume 20 %, with a level label."""
    d = gains_losses(macd_family(bollinger_family(df, s=s), s=s), s)
    d = d.withColumns({"_rsi": F.coalesce(rsi_from(s.mean("_gain", 14), s.mean("_loss", 14)), F.lit(50.0)), "_mo": F.coalesce(s.pct("close", 20), F.lit(0.0)),
                       "_vr": F.coalesce(div("volume", s.mean("volume", 20)), F.lit(1.0)), "_bp": F.coalesce("bb_position", F.lit(0.5))})
    r, b, h = F.col("_rsi"), F.col("_bp"), F.col("macd_histogram")
    parts = [(0.2, ladder([(r > 70, F.lit(20.0)), (r < 30, F.lit(80.0))], 50 + (r - 50) * 0.5)),
             (0.25, ladder([(h > 0, 75.0), (h < 0, 25.0)], 50.0)), (0.2, ladder([(b > 0.8, F.lit(20.0)), (b < 0.2, F.lit(80.0))], 50 + (b - 0.5) * 40)),
             (0.15, F.least(F.greatest(50 + F.col("_mo") * 1000, F.lit(0.0)), F.lit(100.0))), (0.2, ladder([(F.col("_vr") > 1.5, 70.0), (F.col("_vr") < 0.7, 30.0)], 50.0))]
    total = F.lit(0.0)
    for w, p in parts:
        total = total + w * p
    d = d.withColumn("sentiment_score", total)
    x = F.round("sentiment_score", 9)
    return d.withColumn("level", ladder([(x >= 70, "positive"), (x >= 60, "leaning positive"), (x >= 40, "leaning negative")], "negative")).drop("_d", "_gain", "_loss", "_rsi", "_mo", "_vr", "_bp")


def fear_greed(df: DataFrame, n=20, s: Series = S) -> DataFrame:
    d = daily_returns(df, s)
    r = F.col("ret")
    d = d.withColumns({"_neg": F.when(r < 0, -r).otherwise(0.0), "_pos": F.when(r > 0, r).otherwise(0.0), "_fn": flag(r < 0), "_fp": flag(r > 0), "_v": s.std("ret", 20),
                       "_vr": div("volume", s.mean("volume", n)), "_ext": flag(F.abs(r) > 2 * s.std("ret", 60))})
    return d.withColumns({
        "vix_like": F.col("_v") * YEAR * 100, "fear_index": s.mean("_neg", n) * s.mean("_fn", n) * 100, "greed_index": s.mean("_pos", n) * s.mean("_fp", n) * 100 * (1 + s.mean("_vr", 5)),
        "sentiment_oscillator": rsi_from(s.mean("_pos", 14), s.mean("_neg", 14)),
        "investor_sentiment": s.pct("close", 20) * 0.4 - div("_v", s.mean("_v", 60)) * 0.3 + (div("volume", s.mean("volume", 60)) - 1) * 0.3,
        "market_stress": s.mean("_ext", n) * 100}).drop("_neg", "_pos", "_fn", "_fp", "_v", "_vr", "_ext")


def herding_overreaction(df: DataFrame, n=20, s: Series = S) -> DataFrame:
    """Similarity of the volatility of two adjoining past windows; size of the reversal after a 2-sigma move."""
    d = daily_returns(df, s)
    recent, past = F.stddev_samp("ret").over(s.frame(-n, -1)), F.stddev_samp("ret").over(s.frame(-2 * n, -n - 1))
    ok = (F.count("ret").over(s.frame(-n, -1)) > 5) & (F.count("ret").over(s.frame(-2 * n, -n - 1)) > 5) & (s.pos() > 2 * n)
    d = d.withColumns({"herding": F.when(ok, 1 - div(F.abs(recent - past), past)), "_big": flag(F.abs("ret") > 2 * s.std("ret", 60))})
    prev, big = s.lag("ret"), s.lag("_big")
    d = d.withColumn("_o", F.when(s.pos() > n, F.when((big == 1) & (prev * F.col("ret") < 0), F.abs(div("ret", prev))).otherwise(0.0)))
    return d.withColumn("overreaction", s.mean("_o", n)).drop("_big", "_o")


# --- options ---------------------------------------------------------------------------------
def chain_summary(opts: DataFrame) -> DataFrame:
    c, p = F.col("side") == "call", F.col("side") == "put"
    g = opts.groupBy("symbol", "expiry").agg(F.sum(F.when(c, F.col("volume"))).alias("call_volume"), F.sum(F.when(p, F.col("volume"))).alias("put_volume"),
                                             F.avg(F.when(c, F.col("iv"))).alias("call_iv"), F.avg(F.when(p, F.col("iv"))).alias("put_iv"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("put_call_ratio", div("put_volume", "call_volume")).withColumn("bearish", flag(F.col("put_call_ratio") > 1))


def options_by_day(opts: DataFrame, by=()) -> DataFrame:
    c, p = F.col("side") == "call", F.col("side") == "put"
    return opts.groupBy(*by, "date").agg(*[f(F.when(w, F.col(x)).cast("double")).alias(f"{k}_{n}") for k, w in (("call", c), ("put", p))
                                          for n, x, f in (("volume", "volume", F.sum), ("iv", "iv", F.avg), ("oi", "open_interest", F.sum))])


def options_series(day: DataFrame, ma=10, n=20, s: Series = S) -> DataFrame:
    d = day.withColumns({"put_call_ratio": div("put_volume", "call_volume"), "iv_skew": F.col("put_iv") - F.col("call_iv"), "oi_ratio": div("put_oi", "call_oi")})
    x, k, o = F.col("put_call_ratio"), F.col("iv_skew"), F.col("oi_ratio")
    return d.withColumns({"put_call_ratio_ma": s.mean(x, ma), "pc_ratio_sentiment": ladder([(x > s.mean(x, n) + s.std(x, n), -1), (x < s.mean(x, n) - s.std(x, n), 1)], 0),
                          "iv_skew_sentiment": F.when(k > s.mean(k, n) + s.std(k, n), -1).otherwise(1), "oi_ratio_sentiment": F.when(o > s.mean(o, n), -1).otherwise(1)})


def iv_rank(df: DataFrame, iv="iv", n=252, s: Series = S) -> DataFrame:
    return df.withColumns({"iv_percentile": s.score_pct(iv, n), "iv_rank": s.rank_pct(iv, n), "iv_term_structure": div(s.mean(iv, 30), s.mean(iv, 90)) - 1})


def norm_cdf(x: Column) -> Column:
    """Normal distribution function by the Abramowitz-Stegun rational form (error below 7.5e-8)."""
    # fixed values: coefficients of formula 26.2.17
    t = 1 / (1 + 0.2316419 * F.abs(x))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def option_greeks(df: DataFrame, rate=0.02, vol=0.2, days=30, s: Series = S) -> DataFrame:
    """Call greeks at the first price as strike (theta per day, vega and rho per point), and a linear variant."""
    t = days / 365
    k = F.first("close").over(s.run)
    d = df.withColumns({"_k": k})
    p, k = F.col("close"), F.col("_k")
    d = d.withColumn("_d1", (F.log(p / k) + (rate + vol * vol / 2) * t) / (vol * math.sqrt(t)))
    d1 = F.col("_d1")
    d2 = d1 - vol * math.sqrt(t)
    dens = F.exp(-d1 * d1 / 2) / math.sqrt(2 * math.pi)
    disc = math.exp(-rate * t)
    m = p / k
    return d.withColumns({"delta": norm_cdf(d1), "gamma": dens / (p * vol * math.sqrt(t)), "theta": (-p * dens * vol / (2 * math.sqrt(t)) - rate * k * disc * norm_cdf(d2)) / 365,
                          "vega": p * dens * math.sqrt(t) / 100, "rho": k * t * disc * norm_cdf(d2) / 100,
                          "delta_simple": F.least(F.greatest(0.5 + 0.3 * (m - 1), F.lit(0.0)), F.lit(1.0)), "gamma_simple": 0.01 * F.exp(-0.5 * (m - 1) * (m - 1))}).drop("_k", "_d1")
