"""Feature bundles for models."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions.exact import unpivot
from quantloom.functions.series import S, Series, div, flag, ladder
from quantloom.operators.relational import calendar_fields, g1
from quantloom.operators.risk import daily_returns
from quantloom.operators.technical import gains_losses, rsi_from


def time_series_bundle(df: DataFrame, s: Series = S) -> DataFrame:
    """Lags, rolling statistics, differences, interactions, powers and calendar fields in one pass."""
    d = daily_returns(df, s)
    cols = {f"close_lag_{n}": s.lag("close", n) for n in (1, 5)} | {f"close_mean_{n}": s.mean("close", n) for n in (5, 20)} | {f"close_std_{n}": s.std("close", n) for n in (5, 20)}
    cols |= {f"close_diff_{n}": s.diff("close", n) for n in (1, 5)}
    cols |= {"close_x_volume": F.col("close") * F.col("volume"), "close_div_volume": F.col("close") / (F.col("volume") + 1e-8), "ret_pow_2": F.col("ret") * F.col("ret")}
    return calendar_fields(d.withColumns(cols))


def regimes(df: DataFrame, s: Series = S) -> DataFrame:
    d = daily_returns(df, s).withColumn("_v", s.std("ret", 20))
    return d.withColumns({f"trend_{n}": flag(F.col("close") > s.mean("close", n)) for n in (5, 20, 50)} | {
        "high_vol": flag(F.col("_v") > s.quantile("_v", 60, 0.75)), "momentum_regime": ladder([(s.pct("close", 20) > 0.1, 1), (s.pct("close", 20) < -0.1, -1)], 0)}).drop("_v")


def seasonal(df: DataFrame, periods=(12, 52), s: Series = S) -> DataFrame:
    d = df.withColumns({f"seasonal_{p}": s.mean("close", p) for p in periods})
    return d.withColumns({f"residual_{p}": F.col("close") - F.col(f"seasonal_{p}") for p in periods})


def market_micro(df: DataFrame, s: Series = S) -> DataFrame:
    """Spread, imbalance, mid and acceleration from the bar's extremes as quotes."""
    h, lo, c = F.col("high"), F.col("low"), F.col("close")
    d = df.withColumns({"mid": (h + lo) / 2, "spread_pct": div(h - lo, (h + lo) / 2) * 100, "imbalance": div(2 * c - h - lo, h - lo), "basis": div(F.col("open") - c, c)})
    return d.withColumns({"basis_ma": s.mean("basis", 20), "volume_ma": s.mean("volume", 20), "momentum": s.pct("mid", 5), "_m1": s.diff("mid")}).withColumn("acceleration", s.diff("_m1")).drop("_m1")


def ml_inputs(df: DataFrame, s: Series = S) -> DataFrame:
    d = gains_losses(daily_returns(df, s), s)
    c = F.col("close")
    return d.withColumns({"f_ret_5": s.pct(c, 5), "f_ret_20": s.pct(c, 20), "f_vol_20": s.std("ret", 20), "f_pos_20": div(c - s.min(c, 20), s.max(c, 20) - s.min(c, 20)),
                          "f_rsi": rsi_from(s.mean("_gain", 14), s.mean("_loss", 14)), "f_ma_ratio": div(s.mean(c, 5), s.mean(c, 20)), "f_vol_ratio": div("volume", s.mean("volume", 20))}).drop("_d", "_gain", "_loss")


FEATURES = ["f_ret_5", "f_ret_20", "f_vol_20", "f_pos_20", "f_rsi", "f_ma_ratio", "f_vol_ratio"]


def frame_profile(frames: dict[str, DataFrame], cols) -> DataFrame:
    """Counts, nulls and moments of every column of several frames."""
    out = None
    for name, df in frames.items():
        v = F.col("value")
        g = unpivot(df, [], list(cols)).groupBy("name").agg(F.count(F.lit(1)).alias("rows"), F.count_if(v.isNull()).alias("nulls"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), g1(v).alias("skew"))
        g = g.withColumn("frame", F.lit(name))
        out = g if out is None else out.unionByName(g)
    return out
