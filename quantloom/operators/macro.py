"""Macro and sector factors; macro tables hold one row per calendar date."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions.exact import quantiles, with_group_stats
from quantloom.functions.series import S, Series, div, flag, ladder
from quantloom.operators.risk import YEAR
from quantloom.session import materialise

M = Series((), ("date",))


def rate_curve(df: DataFrame, s: Series = M) -> DataFrame:
    y = F.col("rate10y")
    d = df.withColumn("_r", s.pct(y))
    return d.withColumns({"yield_10y_change_20d": s.diff(y, 19), "yield_10y_volatility_20d": s.std("_r", 20) * YEAR * 100, "yield_curve_slope": y - F.col("rate3m"),
                          "yield_curve_curvature": F.col("rate30y") - 2 * y + F.col("rate3m"), "real_yield_10y": y - 2.0, "rate_environment": ladder([(y < 2, 1), (y < 4, 2)], 3)}).drop("_r")


def inflation_policy(df: DataFrame, n=252, s: Series = M) -> DataFrame:
    d = df.withColumns({f"{c}_momentum_60d": s.pct(c, 59) * 100 for c in ("gold", "oil", "usd")})
    d = d.withColumns({"policy_rate_change_60d": s.diff("rate3m", 59), "commodity_index": 0.6 * F.col("gold_momentum_60d") + 0.4 * F.col("oil_momentum_60d"),
                       # share of the window up to and including today, ties counted half
                       "inflation_expectation_proxy": (s.rank_pct("rate10y", n) * n) / n * 100, "yield_curve_inversion": flag(F.col("rate10y") < F.col("rate3m"))})
    p, c, v = F.col("policy_rate_change_60d"), F.col("commodity_index"), F.col("vix")
    return d.withColumns({"monetary_policy_stance": F.when(p.isNotNull(), ladder([(p > 0.5, 3), (p > -0.5, 2)], 1)), "inflation_environment": F.when(c.isNotNull(), ladder([(c > 10, 3), (c > 0, 2)], 1)),
                          "liquidity_environment": ladder([(v > 30, 1), (v > 20, 2)], 3)})


def growth_risk_fx(df: DataFrame, s: Series = M) -> DataFrame:
    d = df.withColumns({"_e": s.pct("equity"), "_b": -s.pct("rate10y"), "_u": s.pct("usd")})
    d = d.withColumns({"equity_momentum_60d": s.pct("equity", 59) * 100, "equity_momentum_1y": s.pct("equity", 251) * 100, "equity_volatility_60d": s.std("_e", 60) * YEAR * 100,
                       "risk_aversion_change_20d": s.diff("vix", 19), "stock_bond_correlation": s.corr("_e", "_b", 60), "safe_haven_demand": (s.pct("gold", 19) - s.pct("equity", 19)) * 100,
                       "liquidity_risk": (div(s.mean("volume", 5), s.mean("volume", 55, lo=-59, hi=-5)) - 1) * 100, "var_95": s.quantile("_e", 252, 0.05) * 100,
                       "usd_volatility_20d": s.std("_u", 20) * YEAR * 100, "usd_momentum_60d": s.pct("usd", 59) * 100})
    m, v, m6, uv, um = (F.col(c) for c in ("equity_momentum_1y", "vix", "equity_momentum_60d", "usd_volatility_20d", "usd_momentum_60d"))
    past = F.collect_list("_e").over(s.past(252))
    tail = F.filter(past, lambda x: x * 100 <= F.col("var_95"))
    d = d.withColumn("cvar_95", F.when(F.col("var_95").isNotNull(), F.aggregate(tail, F.lit(0.0), lambda a, x: a + x) / F.size(tail) * 100))
    return d.withColumns({"market_stress_index": (F.least(v / 40, F.lit(1.0)) + F.greatest("stock_bond_correlation", F.lit(0.0))) / 2 * 100,
                          "economic_cycle": F.when(m.isNotNull(), ladder([((m > 10) & (v < 20), 4), ((m > 0) & (v < 25), 3), ((m < -10) & (v > 30), 1)], 2)),
                          "style_rotation": F.when(m6.isNotNull(), ladder([(m6 > 5, 1), (m6 > -5, 2)], 3)), "currency_risk_level": F.when(uv.isNotNull(), ladder([(uv > 15, 3), (uv > 10, 2)], 1)),
                          "usd_cycle": F.when(um.isNotNull(), ladder([(um > 5, 3), (um > -5, 2)], 1))}).drop("_e", "_b", "_u")


LABELS = {"rate": ["low", "medium", "high"], "inflation": ["low", "moderate", "high"], "policy": ["easing", "neutral", "tightening"], "cycle": ["recession", "slowdown", "recovery", "expansion"]}


def regime(df: DataFrame, s: Series = M) -> DataFrame:
    d = growth_risk_fx(inflation_policy(rate_curve(df, s), s=s), s)
    src = {"rate": "rate_environment", "inflation": "inflation_environment", "policy": "monetary_policy_stance", "cycle": "economic_cycle"}
    return d.withColumns({f"{k}_regime": F.coalesce(F.try_element_at(F.array(*[F.lit(x) for x in LABELS[k]]), F.col(c)), F.lit("unknown")) for k, c in src.items()})


def macro_features(df: DataFrame, cols, s: Series = M) -> DataFrame:
    out = {}
    for c in cols:
        x = F.col(c)
        out.update({f"{c}_pct_1": s.pct(x), f"{c}_pct_5": s.pct(x, 5), f"{c}_pct_20": s.pct(x, 20), f"{c}_ma_20": s.mean(x, 20), f"{c}_ma_50": s.mean(x, 50),
                    f"{c}_position": div(x - s.mean(x, 20), s.mean(x, 20)), f"{c}_vol_20": s.std(x, 20)})
    return df.select("date", *cols).withColumns(out)


def economic_summary(df: DataFrame, s: Series = M) -> DataFrame:
    """Year-on-year change by row 12 from the end, rate and level changes, on the last date."""
    d = df.withColumns({"cpi_yoy": s.pct("gold", 11) * 100, "rate_change": s.diff("rate3m"), "unemployment_change": s.diff("vix")})
    return d.withColumn("_last", s.is_last()).where("_last").drop("_last")


def sector_performance(panel: DataFrame, periods=(1, 5, 20, 60, 120, 252), s: Series = S) -> DataFrame:
    d = panel.withColumns({f"return_{n}d": s.pct("close", n) * 100 for n in periods}).withColumn("_r", s.pct("close"))
    d = with_group_stats(d, list(s.by), {"_sd": F.stddev_samp("_r")}).withColumn("volatility_ann", F.col("_sd") * YEAR * 100)
    return d.withColumn("_last", s.is_last()).where("_last").drop("_last", "_sd", "_r")


def relative_strength(panel: DataFrame, market="mclose", periods=(5, 20, 60), s: Series = S) -> DataFrame:
    d = panel.withColumn("rs_ratio", div("close", market))
    out = {}
    for n in periods:
        out[f"rs_{n}d"] = s.pct("rs_ratio", n) * 100
        out[f"rs_percentile_{n}d"] = s.rank_pct("rs_ratio", n) * 100
    d = d.withColumns(out).withColumn("_last", s.is_last())
    return d.where("_last").drop("_last")


def rotation_signals(rs: DataFrame, perf: DataFrame, key="symbol") -> DataFrame:
    """Signals of the relative strength, with the quarter of the volatilities an instrument lies in.

    The performance is computed once and written: a quartile is often the value of an instrument itself, and means that were
    summed a second time, in another order, would lie above or below it by a last bit.
    """
    perf = materialise(perf.select(key, "volatility_ann", "return_20d", "return_60d"), "performance")
    q = quantiles(perf, [], "volatility_ann", [0.25, 0.75], ["q25", "q75"])
    d = rs.join(perf, key).crossJoin(F.broadcast(q))  # one row
    p, r = F.col("rs_percentile_20d"), F.col("rs_20d")
    buy, sell = (p > 75) & (r > 0), (p < 25) & (r < 0)
    return d.withColumns({"signal": ladder([(buy, "BUY"), (sell, "SELL")], "HOLD"), "confidence": ladder([(buy & (p > 90), "HIGH"), (sell & (p < 10), "HIGH"), (buy | sell, "MEDIUM")], "NONE"),
                          "volatility_class": ladder([(F.col("volatility_ann") > F.col("q75"), "high"), (F.col("volatility_ann") < F.col("q25"), "low")], "normal"),
                          "leader": flag((F.col("return_20d") > 0) & (F.col("return_60d") > 0)), "laggard": flag(F.col("return_20d") < -5)}).drop("q25", "q75")


def fx_crypto_summary(panel: DataFrame, s: Series = S) -> DataFrame:
    """Last change, volatility and share of total value per instrument."""
    d = panel.withColumns({"change_pct": s.pct("close") * 100, "_r": s.pct("close"), "cap": F.col("close") * F.col("volume")})
    d = with_group_stats(d, list(s.by), {"volatility": F.stddev_samp("_r")})
    d = d.withColumn("_last", s.is_last()).where("_last")
    d = with_group_stats(d, [], {"_t": F.sum("cap"), "average_change": F.avg("change_pct")})
    return d.withColumn("dominance", div("cap", "_t") * 100).drop("_last", "_t", "_r")


def bond_commodity_summary(macro: DataFrame, s: Series = M) -> DataFrame:
    d = macro.withColumns({"spread_10y_3m": F.col("rate10y") - F.col("rate3m"), "spread_10y_5y": F.col("rate10y") - F.col("rate5y"), "gold_change": s.pct("gold") * 100, "oil_change": s.pct("oil") * 100})
    a = F.col("spread_10y_3m")
    return d.withColumns({"shape": ladder([(a > 1, "steep"), (a > 0, "normal"), (a > -0.5, "flat")], "inverted"), "commodity_average": (F.col("gold_change") + F.col("oil_change")) / 2,
                          "best_performer": ladder([(F.col("gold_change") >= F.col("oil_change"), "gold"), (F.col("oil_change").isNotNull(), "oil")], "none")})
