"""Trading signals as columns; every rule is a window expression over the symbol's bars."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions.exact import with_group_stats
from quantloom.functions.series import S, Series, div, flag, ladder, span, true_range
from quantloom.operators.relational import corr_agg
from quantloom.operators.risk import YEAR, daily_returns
from quantloom.operators.technical import gains_losses, macd_family, rsi_from


def momentum_ema(df: DataFrame, fast=12, slow=26, s: Series = S) -> DataFrame:
    d = s.ewm(df, {"_f": ("close", span(fast), False), "_s": ("close", span(slow), False)})
    return d.withColumn("signal", flag(F.col("_f") > F.col("_s"))).drop("_f", "_s")


def mean_reversion(df: DataFrame, lookback=20, entry=-1.0, exit_=0.0, s: Series = S) -> DataFrame:
    """1 at or below the entry z-score, 0 from the exit z-score on; warm-up rows are 0."""
    z = div(F.col("close") - s.mean("close", lookback), s.std("close", lookback) + 1e-12)
    return df.withColumn("z", z).withColumn("signal", flag((F.col("z") <= entry) & (F.col("z") < exit_)))


def rsi_signal(df: DataFrame, period=14, oversold=30, overbought=70, s: Series = S) -> DataFrame:
    d = gains_losses(df, s)
    rs = s.mean("_gain", period) / (s.mean("_loss", period) + 1e-12)
    d = d.withColumn("rsi", 100 - 100 / (1 + rs))
    return d.withColumn("signal", flag((F.col("rsi") <= oversold) & (F.col("rsi") < overbought))).drop("_d", "_gain", "_loss")


def bollinger_signal(df: DataFrame, period=20, k=2.0, s: Series = S) -> DataFrame:
    m, sd, c = s.mean("close", period), s.std("close", period), F.col("close")
    d = df.withColumns({"_u": m + k * sd, "_l": m - k * sd})
    return d.withColumns({"mean_reversion": flag((c <= F.col("_l")) & (c < F.col("_u"))), "breakout": flag((c >= F.col("_u")) & (c > F.col("_l")))}).drop("_u", "_l")


def macd_signal(df: DataFrame, s: Series = S) -> DataFrame:
    return macd_family(df, s=s).withColumn("signal", flag(F.col("macd_line") > F.col("macd_signal")))


def pairs_signal(pair: DataFrame, lookback=60, entry=2.0, exit_=0.5, s: Series = S) -> DataFrame:
    """Opposite the log-ratio z-score beyond the entry, 0 inside the exit band and during warm-up."""
    d = pair.withColumn("ratio", F.log(div("close1", "close2")))
    d = d.withColumn("z", div(F.col("ratio") - s.mean("ratio", lookback), s.std("ratio", lookback) + 1e-12))
    z = F.col("z")
    return d.withColumn("signal", F.when((F.abs(z) >= entry) & (F.abs(z) > exit_), F.signum(-z)).otherwise(0.0))


def vol_breakout(df: DataFrame, lookback=20, k=1.5, s: Series = S) -> DataFrame:
    d = df.withColumn("_tr", true_range(s)).withColumns({"_pc": s.lag("close")})
    d = d.withColumn("_b", s.mean("_tr", lookback) * k)
    c = F.col("close")
    return d.withColumn("signal", flag((c >= F.col("_pc") + F.col("_b")) & (c > F.col("_pc") - F.col("_b")))).drop("_tr", "_pc", "_b")


def basis_momentum_meanrev(df: DataFrame, threshold=0.1, n=20, s: Series = S) -> DataFrame:
    """Basis of the open to the close, moving-average cross and band signals, each -1 / 0 / 1."""
    b = div(F.col("open") - F.col("close"), "close")
    m, sd, c = s.mean("close", n), s.std("close", n), F.col("close")
    d = df.withColumn("basis", b)
    ma5 = s.mean(c, 5)
    bm = s.mean("basis", n)
    return d.withColumns({"basis_signal": ladder([(F.col("basis") - bm > threshold, -1), (F.col("basis") - bm < -threshold, 1)], 0), "momentum_signal": ladder([(ma5 > m, 1), (ma5 < m, -1)], 0),
                          "meanrev_signal": ladder([(c > m + 2 * sd, -1), (c < m - 2 * sd, 1)], 0)})


def scored_composite(df: DataFrame, weights=(0.3, 0.2, 0.2, 0.15, 0.15), s: Series = S) -> DataFrame:
    """Weighted sum of five scores in -1 .. 1: momentum, mean reversion, volatility, volume, range position."""
    d = daily_returns(df, s)
    z = div(F.col("close") - s.mean("close", 20), s.std("close", 20))
    v = div(s.std("ret", 10), s.std("ret", 60))
    vr = div("volume", s.mean("volume", 20))
    pos = div(F.col("close") - F.col("low"), F.col("high") - F.col("low"))
    mom = s.pct("close", 10)
    d = d.withColumns({"_z": z, "_v": v, "_vr": vr, "_p": pos, "_m": mom})
    d = d.withColumns({
        "momentum_score": ladder([(F.col("_m") > 0.1, 1.0), (F.col("_m") > 0.02, 0.5), (F.col("_m") < -0.1, -1.0), (F.col("_m") < -0.02, -0.5)], 0.0),
        "reversion_score": ladder([(F.col("_z") < -2, 1.0), (F.col("_z") < -1, 0.5), (F.col("_z") > 2, -1.0), (F.col("_z") > 1, -0.5)], 0.0),
        "volatility_score": ladder([(F.col("_v") < 0.8, 0.5), (F.col("_v") > 1.5, -0.5)], 0.0),
        "volume_score": ladder([(F.col("_vr") > 1.5, 1.0), (F.col("_vr") < 0.5, -0.5)], 0.0),
        "micro_score": ladder([(F.col("_p") > 0.8, 0.5), (F.col("_p") < 0.2, -0.5)], 0.0)})
    parts = ("momentum_score", "reversion_score", "volatility_score", "volume_score", "micro_score")
    total = F.lit(0.0)
    for w, p in zip(weights, parts):
        total = total + w * F.col(p)
    d = d.withColumn("score", F.round(total, 9))
    return d.withColumn("signal", ladder([(F.col("score") > 0.3, 1), (F.col("score") < -0.3, -1)], 0)).drop("_z", "_v", "_vr", "_p", "_m")


def signal_families(df: DataFrame, s: Series = S) -> DataFrame:
    c = F.col("close")
    d = gains_losses(daily_returns(df, s), s).withColumn("_tr", true_range(s))
    d = d.withColumns({f"volatility_{n}": s.std("ret", n) * YEAR for n in (10, 20)})
    cols = {f"momentum_{n}": s.pct(c, n) for n in (5, 10, 20)} | {f"rsi_{n}": rsi_from(s.mean("_gain", n), s.mean("_loss", n)) for n in (5, 10, 20)}
    for n in (10, 20, 50):
        m, sd = s.mean(c, n), s.std(c, n)
        cols.update({f"bollinger_{n}": div(c - m, 2 * sd), f"zscore_{n}": div(c - m, sd), f"price_position_{n}": div(c - s.min("low", n), s.max("high", n) - s.min("low", n))})
    for n in (10, 20):
        cols.update({f"atr_{n}": s.mean("_tr", n), f"vol_breakout_{n}": div(f"volatility_{n}", s.mean(f"volatility_{n}", n)) - 1})
    cols.update({"volume_ma_ratio": div("volume", s.mean("volume", 20)), "vwap": div(s.cumsum(c * F.col("volume")), s.cumsum("volume")), "price_volume_trend": F.col("ret") * F.col("volume"),
                 "price_jump": flag(F.abs("ret") > 3 * s.std("ret", 20))})
    return d.withColumns(cols).drop("_d", "_gain", "_loss", "_tr")


def normalize_smooth(df: DataFrame, col: str, s: Series = S) -> DataFrame:
    """z-score, min-max and percent rank per series; SMA, EMA and median smoothing of five rows."""
    x = F.col(col)
    d = s.ewm(df, {"ema": (col, span(5), True)})
    lo, hi = F.min(x).over(s.whole), F.max(x).over(s.whole)
    return d.withColumns({"zscore": div(x - F.avg(x).over(s.whole), F.stddev_samp(x).over(s.whole)), "minmax": div(x - lo, hi - lo), "sma": s.mean(x, 5), "median": s.median(x, 5), "rank": s.rank_of(x)})


def first_component(k: int):
    """Column function: score of standardised values on the first principal component of their series.

    Takes the upper triangle of the correlation matrix of the series, row by row, and the ``k`` values.  The first of the largest loadings
    is positive; loadings that differ by rounding only are equally large.  A matrix is solved once per run of equal ones, so once per series and batch.
    """
    i, j = np.triu_indices(k)

    @F.pandas_udf("double")
    def score(*cols: pd.Series) -> pd.Series:
        c, y = np.stack(cols[:len(i)], axis=1).astype(float), np.stack(cols[len(i):], axis=1).astype(float)
        new = np.ones(len(c), dtype=bool)
        new[1:] = (c[1:] != c[:-1]).any(axis=1)
        m = np.zeros((new.sum(), k, k))
        m[:, i, j] = m[:, j, i] = np.where(np.isfinite(c[new]).all(axis=1, keepdims=True), c[new], 0.0)
        lead = np.linalg.eigh(m)[1][:, :, -1]
        size = np.abs(lead)
        top = (size >= size.max(axis=1, keepdims=True) - 1e-9).argmax(axis=1)
        lead = lead * np.sign(lead[np.arange(len(lead)), top])[:, None]
        return pd.Series((lead[np.cumsum(new) - 1] * y).sum(axis=1))
    return score


def fuse(df: DataFrame, cols, weights, s: Series = S) -> DataFrame:
    """Weighted z-score, mean percent rank, median and first principal component of several signals; a series is bounded, so its ranks are windows.

    For the component a missing signal counts as 0 and every signal is standardised over its series; one without variation is 0.
    """
    d = df.withColumns({f"_r_{c}": s.rank_of(c) for c in cols} | {f"_x_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols})
    sd = {c: F.stddev_pop(f"_x_{c}").over(s.whole) for c in cols}
    corr = [F.when(sd[a] > 0, 1.0).otherwise(0.0) if a == b else F.coalesce(div(F.covar_pop(f"_x_{a}", f"_x_{b}").over(s.whole), sd[a] * sd[b]), F.lit(0.0))
            for k, a in enumerate(cols) for b in cols[k:]]
    scaled = [F.coalesce(div(F.col(f"_x_{c}") - F.avg(f"_x_{c}").over(s.whole), sd[c]), F.lit(0.0)) for c in cols]
    z = {c: div(F.col(c) - F.avg(c).over(s.whole), F.stddev_samp(c).over(s.whole)) for c in cols}
    total = sum((F.coalesce(z[c], F.lit(0.0)) * w for c, w in zip(cols, weights)), F.lit(0.0))
    arr = F.array_sort(F.filter(F.array(*[F.col(c) for c in cols]), lambda x: x.isNotNull()))
    n = F.size(arr)
    lo, hi = F.try_element_at(arr, F.floor((n + 1) / 2).cast("int")), F.try_element_at(arr, F.ceil((n + 1) / 2).cast("int"))
    ranks = F.filter(F.array(*[F.col(f"_r_{c}") for c in cols]), lambda x: x.isNotNull())
    parts = {f"_p{i}": x for i, x in enumerate([*corr, *scaled])}
    d = d.withColumns({"weighted": total, "rank_mean": F.try_divide(F.aggregate(ranks, F.lit(0.0), lambda a, x: a + x), F.size(ranks)), "median": F.when(n > 0, (lo + hi) / 2)} | parts)
    return d.withColumn("pca", first_component(len(cols))(*parts)).drop(*[f"_{p}_{c}" for c in cols for p in "rx"], *parts)


def vote(long: DataFrame, by=("symbol", "date"), min_conf=0.2) -> DataFrame:
    """Net strength, majority vote and confidence over (strategy, signal, weight) rows."""
    sg, w = F.col("signal"), F.col("weight")
    g = long.groupBy(*by).agg(F.try_divide(F.sum(sg * w), F.sum(w)).alias("net_strength"), F.count_if(sg > 0).alias("buys"), F.count_if(sg < 0).alias("sells"), F.count(F.lit(1)).alias("n"))
    b, s_ = F.col("buys"), F.col("sells")
    g = g.withColumns({"majority": ladder([((b > s_) & (b > 0), "BUY"), ((s_ > b), "SELL")], "HOLD"), "confidence": F.greatest(b, s_) / F.col("n")})
    return g.withColumn("accepted", flag((F.abs("net_strength") >= min_conf) & (F.col("confidence") >= 0.5)))


def signal_diagnostics(long: DataFrame, s: Series) -> DataFrame:
    """Per signal series: mean, std, range, strength, outlier share, autocorrelation and issue flags."""
    d = long.where(F.col("value").isNotNull()).withColumn("_l", s.lag("value"))
    d = with_group_stats(d, list(s.by), {"_m": F.avg("value"), "_s": F.stddev_samp("value")})
    g = d.groupBy(*s.by).agg(F.first("_m").alias("mean"), F.first("_s").alias("std"), (F.max("value") - F.min("value")).alias("range"), F.avg(flag(F.abs(F.col("value") - F.col("_m")) > 3 * F.col("_s"))).alias("outlier_ratio"),
                             corr_agg("value", "_l").alias("autocorr"), F.count(F.lit(1)).alias("n"))
    g = g.withColumn("strength", F.coalesce(div(F.abs("mean"), "std"), F.lit(0.0)))
    return g.withColumns({"weak": flag(F.col("strength") < 0.5), "many_outliers": flag(F.col("outlier_ratio") > 0.1), "persistent": flag(F.abs("autocorr") > 0.8)})
