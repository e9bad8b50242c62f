"""Timing factors and the window-expressible statistical factors."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions.kernels import rolling_frame
from quantloom.functions.series import S, Series, div, flag, ladder, spread, with_pos
from quantloom.operators.risk import daily_returns
from quantloom.operators.technical import gains_losses


def timing_factors(df: DataFrame, s: Series = S) -> DataFrame:
    """Breadth, flow, trend, swing and volatility timing of one series."""
    c, h, lo, v = (F.col(x) for x in ("close", "high", "low", "volume"))
    d = gains_losses(daily_returns(df, s), s)
    tp = (h + lo + c) / 3
    d = d.withColumns({"_tp": tp, "_adv": flag(F.col("ret") > 0), "_dec": flag(F.col("ret") < 0), "_nh": flag(h >= s.max(h, 252)), "_nl": flag(lo <= s.min(lo, 252)), "_vol": s.std("ret", 20), "_v5": s.std("ret", 5),
                       "_vma": s.mean(v, 20), "_vc": s.pct(v), "_pr": F.when(F.col("ret") > 0, F.col("ret")).otherwise(0.0), "_nr": F.when(F.col("ret") < 0, -F.col("ret")).otherwise(0.0)})
    d = d.withColumns({"_td": s.diff("_tp"), "_v5l": s.lag("_v5"), "_mf": F.col("_tp") * v})
    d = d.withColumns({"_up": F.when(F.col("_td") > 0, F.col("_mf")).otherwise(0.0), "_dn": F.when(F.col("_td") < 0, F.col("_mf")).otherwise(0.0),
                       "_nf": F.when(F.col("_d") > 0, F.col("_mf")).when(F.col("_d") < 0, -F.col("_mf")).otherwise(0.0),
                       "_lg": F.when(v > F.col("_vma") * 1.5, F.signum("ret")).otherwise(0.0), "_in": F.when(F.col("_vc") > 0, F.signum("ret")).otherwise(0.0), "_rt": F.when(v < F.col("_vma") * 0.8, F.col("ret")).otherwise(0.0)})
    d = d.withColumns({"_lg": F.coalesce("_lg", F.lit(0.0)), "_in": F.coalesce("_in", F.lit(0.0))})
    ma = {n: s.mean(c, n) for n in (5, 10, 20, 60)}
    sd, rs = s.std(c, 20), s.mean("_gain", 14) / (s.mean("_loss", 14) + 1e-8)
    rsi = 100 - 100 / (1 + rs)
    vr = s.rank_pct("_vol", 252)
    d = d.withColumns({
        "advance_decline_ratio": s.sum("_adv", 20) / (s.sum("_dec", 20) + 1e-8), "new_high_low_ratio": s.sum("_nh", 20) / (s.sum("_nl", 20) + 1e-8),
        "money_flow_index": 100 - 100 / (1 + s.sum("_up", 14) / (s.sum("_dn", 14) + 1e-8)), "market_strength": s.mean("_pr", 20) / (s.mean("_nr", 20) + 1e-8),
        "momentum_timing": 0.5 * s.pct(c, 5) + 0.3 * s.pct(c, 10) + 0.2 * s.pct(c, 20), "ma_timing_signal": (flag(ma[5] > ma[10]) + flag(ma[10] > ma[20]) + flag(ma[20] > ma[60]) + flag(c > ma[5])) / 4,
        "breakout_timing": ladder([(c > ma[20] + 2 * sd, 1), (c < ma[20] - 2 * sd, -1)], 0), "support_resistance_timing": div(c - s.min(lo, 20), s.max(h, 20) - s.min(lo, 20) + 1e-8),
        "swing_timing": ladder([(rsi < 30, 1), (rsi > 70, -1)], 0), "volatility_mean_reversion": -div(F.col("_vol") - s.mean("_vol", 60), s.mean("_vol", 60) + 1e-8),
        "volatility_breakout": flag(F.col("_vol") > s.quantile("_vol", 60, 0.8)), "volatility_clustering": s.corr("_v5", "_v5l", 19),
        "volatility_timing_signal": ladder([(vr < 0.2, 1), (vr > 0.8, -1)], 0), "net_money_flow": s.sum("_nf", 20), "large_order_flow": s.sum("_lg", 10), "institutional_flow": s.sum("_in", 10), "retail_sentiment": s.sum("_rt", 10)})
    return d.drop(*[x for x in d.columns if x.startswith("_")])


def hf_returns_stats(df: DataFrame, s: Series = S) -> DataFrame:
    d = daily_returns(df, s)
    d = d.withColumns({"_j": flag(F.abs(div("ret", s.std("ret", 20))) > 3), "_r2": F.col("ret") * F.col("ret")})
    return d.withColumns({"jump_intensity": s.sum("_j", 20), "realized_volatility": F.sqrt(s.sum("_r2", 20)), "realized_skewness": s.skew("ret", 20), "realized_kurtosis": s.kurt("ret", 20)}).drop("_j", "_r2")


def hf_efficiency_impact(df: DataFrame, n=20, s: Series = S) -> DataFrame:
    """Path efficiency over the n rows before the current one, and return autocorrelations."""
    d = daily_returns(df, s).withColumns({"_a": F.abs(s.diff("close")), "_l": s.lag("ret")})
    path = F.sum("_a").over(s.frame(-(n - 1), -1))
    eff = F.when(path > 0, div(F.abs(s.lag("close", 1) - s.lag("close", n)), path)).otherwise(0.0)
    cnt = F.count("ret").over(s.frame(-n, -1))
    d = d.withColumns({"price_efficiency": F.when(s.pos() > n, eff), "microstructure_noise": -s.corr("ret", "_l", n - 1),
                       "price_impact": F.when((s.pos() > n) & (cnt > 5), F.coalesce(s.corr("ret", "_l", n, min_periods=2, lo=-(n - 1), hi=-1), F.lit(0.0)))})
    return d.drop("_a", "_l")


def hf_liquidity(df: DataFrame, s: Series = S) -> DataFrame:
    v = F.col("volume")
    d = daily_returns(df, s).withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    d = d.withColumns({"_il": div(F.abs("ret"), F.col("close") * v), "_of": div(F.when(F.col("ret") > 0, v).when(F.col("ret") < 0, -v).otherwise(0.0), F.when(F.col("ret") != 0, v).otherwise(0.0)),
                       "_m20": s.sum("ret", 20), "_pv": F.col("_tp") * v})
    vwap = div(s.sum("_pv", 20), s.sum(v, 20))
    return d.withColumns({"amihud": s.mean("_il", 20), "vwap_factor": div(F.col("_tp") - vwap, vwap), "order_flow_imbalance": s.mean("_of", 10), "spread_estimate": div(F.col("high") - F.col("low"), "close"),
                          "hf_momentum": div(s.sum("ret", 5), s.std("_m20", 5))}).drop("_tp", "_il", "_of", "_m20", "_pv")


def _window_moments(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """Bias corrected skewness and excess kurtosis and the standardised fifth and sixth moments of (windows x n) values."""
    n = x.shape[1]
    d = x - x[:, :1]  # a constant window is exactly zero
    d = d - d.mean(axis=1, keepdims=True)
    d2 = d * d
    d3 = d2 * d
    m2, m3, m4, m5, m6 = (np.einsum("ij,ij->i", a, b) / n for a, b in ((d, d), (d2, d), (d2, d2), (d2, d3), (d3, d3)))
    skew = m3 / m2 ** 1.5 * ((n * (n - 1)) ** 0.5 / (n - 2))
    kurt = ((m4 / m2 ** 2 - 3) * (n + 1) + 6) * ((n - 1) / ((n - 2) * (n - 3)))
    return skew, kurt, m5 / m2 ** 2.5, m6 / m2 ** 3


def higher_moments(df: DataFrame, n=50, s: Series = S) -> DataFrame:
    """Moments of log returns.  ``excess`` subtracts 3 from an already excess kurtosis, as the factor is defined."""
    d = spread(df, s).withColumn("_x", F.log(div("close", s.lag("close"))))
    d = rolling_frame(d, ["_x"], n, _window_moments, ["skew", "kurt", "moment_5", "moment_6"], s)
    return d.withColumns({"excess": F.col("kurt") - 3, "jarque_bera": n / 6 * (F.col("skew") ** 2 + (F.col("kurt") - 3) ** 2 / 4)}).drop("_x")


def time_series_components(df: DataFrame, s: Series = S) -> DataFrame:
    """Trend slope, mean return of the weekday and month, and a volatility regime."""
    d = with_pos(daily_returns(df, s), s)
    v = s.std("ret", 20)
    d = d.withColumns({"trend_strength": s.slope("close", 20), "_v": v, "_m": F.month(s.order[0]), "_dw": F.weekday(s.order[0])})
    from quantloom.functions.exact import with_group_stats
    d = with_group_stats(d, [*s.by, "_m"], {"month_component": F.avg("ret")})
    d = with_group_stats(d, [*s.by, "_dw"], {"weekday_component": F.avg("ret")})
    base = s.mean("_v", 60)
    return d.withColumn("volatility_regime", ladder([(F.col("_v") > base * 1.2, 1), (F.col("_v") < base * 0.8, -1)], 0)).drop("_pos", "_v", "_m", "_dw")


def zscore_anomaly(df: DataFrame, n=20, s: Series = S) -> DataFrame:
    d = daily_returns(df, s)
    d = d.withColumn("z", div(F.col("ret") - s.mean("ret", n), s.std("ret", n)))
    return d.withColumn("anomaly", flag(F.abs("z") > 2))


