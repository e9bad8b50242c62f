"""Technical factors per symbol series, as window expressions over one (symbol, date) ordering.

Output columns always exist and are NULL until a series is long enough.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.series import S, Series, div, flag, ladder, span, spread, true_range, with_pos

YEAR = math.sqrt(252)


def sma_family(df: DataFrame, windows=(5, 10, 20, 50, 200), s: Series = S) -> DataFrame:
    d = df.withColumns({f"sma_{n}": s.mean("close", n, n // 2) for n in windows})
    cols = {}
    for n in windows:
        m = F.col(f"sma_{n}")
        cols[f"sma_{n}_slope"] = div(s.diff(m, 5), s.lag(m, 5))
        cols[f"price_to_sma_{n}"] = (div("close", m) - 1) * 100
    for a, b in zip(windows, windows[1:]):
        cols[f"sma_cross_{a}_{b}"] = flag(F.col(f"sma_{a}") > F.col(f"sma_{b}"))
    return d.withColumns(cols)


def ema_family(df: DataFrame, windows=(12, 26, 50), s: Series = S) -> DataFrame:
    d = s.ewm(df, {f"ema_{n}": ("close", span(n), False) for n in windows})
    cols = {}
    for n in windows:
        m = F.col(f"ema_{n}")
        cols[f"ema_{n}_slope"] = div(s.diff(m, 3), s.lag(m, 3))
        cols[f"price_to_ema_{n}"] = (div("close", m) - 1) * 100
    return d.withColumns(cols)


def gains_losses(df: DataFrame, s: Series = S) -> DataFrame:
    d = s.diff("close")
    return df.withColumn("_d", d).withColumns({
        "_gain": F.when(F.col("_d") > 0, F.col("_d")).otherwise(0.0),
        "_loss": F.when(F.col("_d") < 0, -F.col("_d")).otherwise(0.0)})


def rsi_from(gain: Column, loss: Column) -> Column:
    """RSI of average gain and loss: 100 when nothing was lost, NULL when nothing moved."""
    return F.when(loss == 0, F.when(gain > 0, 100.0)).otherwise(100 - 100 / (1 + div(gain, loss)))


def rsi_sma(df: DataFrame, periods=(14, 21), s: Series = S) -> DataFrame:
    d = gains_losses(df, s)
    d = d.withColumns({f"rsi_{n}": rsi_from(s.mean("_gain", n), s.mean("_loss", n)) for n in periods})
    cols = {}
    for n in periods:
        r = F.col(f"rsi_{n}")
        cols.update({f"rsi_{n}_overbought": flag(r > 70), f"rsi_{n}_oversold": flag(r < 30),
                     f"rsi_{n}_momentum": s.diff(r, 5)})
    return d.withColumns(cols).drop("_d", "_gain", "_loss")


def wilder(df: DataFrame, outputs: dict, n_by_name: dict, s: Series = S) -> DataFrame:
    """Wilder averages: the mean of the first n values, then y = (y' (n-1) + x) / n.

    The seed row carries the mean, so the rest is an exponential mean with alpha 1/n.
    """
    seeds = {}
    for name, x in outputs.items():
        n = n_by_name[name]
        k = F.count(F.col(x)).over(s.run)
        seeds[f"{name}_x"] = F.when(k == n, F.avg(F.col(x)).over(s.past(n))).when(k > n, F.col(x))
    d = df.withColumns(seeds)
    d = s.ewm(d, {name: (f"{name}_x", 1.0 / n_by_name[name], False) for name in outputs})
    return d.drop(*seeds)


def rsi_wilder(df: DataFrame, periods=(6, 14, 24, 30), s: Series = S) -> DataFrame:
    d = gains_losses(spread(df, s), s)
    # the first bar has no change; the seed averages the first n real changes
    d = d.withColumns({c: F.when(F.col("_d").isNotNull(), F.col(c)) for c in ("_gain", "_loss")})
    outs, ns = {}, {}
    for n in periods:
        outs[f"_g{n}"], outs[f"_l{n}"] = "_gain", "_loss"
        ns[f"_g{n}"] = ns[f"_l{n}"] = n
    d = wilder(d, outs, ns, s)
    d = d.withColumns({
        f"rsi_w{n}": F.when(F.col(f"_g{n}") + F.col(f"_l{n}") == 0, 0.0).otherwise(
            100 * div(F.col(f"_g{n}"), F.col(f"_g{n}") + F.col(f"_l{n}"))) for n in periods})
    return d.drop("_d", "_gain", "_loss", *outs)


def macd_family(df: DataFrame, fast=12, slow=26, signal=9, s: Series = S) -> DataFrame:
    d = s.ewm(df, {"_ef": ("close", span(fast), True), "_es": ("close", span(slow), True)})
    d = s.ewm(d.withColumn("macd_line", F.col("_ef") - F.col("_es")), {"macd_signal": ("macd_line", span(signal), True)})
    m, g = F.col("macd_line"), F.col("macd_signal")
    d = d.withColumn("macd_histogram", m - g)
    return d.withColumns({
        "macd_bullish_cross": flag((m > g) & (s.lag(m) <= s.lag(g))),
        "macd_bearish_cross": flag((m < g) & (s.lag(m) >= s.lag(g))),
        "macd_momentum": s.diff("macd_histogram", 3),
        "macd_zero_cross": flag((m > 0) & (s.lag(m) <= 0))}).drop("_ef", "_es")


def bollinger_family(df: DataFrame, window=20, k=2.0, s: Series = S) -> DataFrame:
    d = df.withColumns({"bb_middle": s.mean("close", window), "_sd": s.std("close", window)})
    d = d.withColumns({"bb_upper": F.col("bb_middle") + k * F.col("_sd"), "bb_lower": F.col("bb_middle") - k * F.col("_sd")})
    d = d.withColumn("_bw", F.col("bb_upper") - F.col("bb_lower"))
    c, up, lo = F.col("close"), F.col("bb_upper"), F.col("bb_lower")
    return d.withColumns({
        "bb_position": div(c - lo, F.col("_bw")), "bb_width": div(F.col("_bw"), "bb_middle"),
        "bb_squeeze": flag(F.col("_bw") < s.mean("_bw", 20) * 0.8),
        "bb_upper_break": flag(c > up), "bb_lower_break": flag(c < lo),
        "bb_mean_reversion": flag((c > up) | (c < lo))}).drop("_sd", "_bw")


def momentum_family(df: DataFrame, s: Series = S) -> DataFrame:
    c = F.col("close")
    cols = {f"momentum_{n}d": s.pct(c, n) * 100 for n in (1, 3, 5, 10, 20, 60)}
    cols["momentum_acceleration"] = s.pct(c, 5) - s.pct(c, 20)
    cols["relative_strength_1y"] = s.pct(c, 252)
    for n in (20, 60, 252):
        hi, lo = s.max(c, n), s.min(c, n)
        cols[f"price_position_{n}d"] = div(c - lo, hi - lo)
    for n in (20, 60):
        # the channel of the n bars before the current one
        cols[f"breakout_momentum_{n}d"] = ladder([
            (c > s.max("high", n, lo=-n, hi=-1), 1), (c < s.min("low", n, lo=-n, hi=-1), -1)], 0)
    return df.withColumns(cols)


def volatility_family(df: DataFrame, s: Series = S) -> DataFrame:
    d = df.withColumns({"_r": s.pct("close"), "_tr": F.abs(s.diff("close"))})
    d = d.withColumns({f"_v{n}": s.std("_r", n) for n in (5, 10, 20, 60)})
    cols = {f"volatility_{n}d": F.col(f"_v{n}") * YEAR for n in (5, 10, 20, 60)}
    cols["volatility_ratio"] = div("_v10", "_v60")
    cols["atr_14"] = s.mean("_tr", 14)
    cols["atr_ratio"] = div(s.mean("_tr", 14), "close")
    for n in (20, 60):
        cols[f"volatility_breakout_{n}d"] = flag(F.col(f"_v{n}") > s.quantile(f"_v{n}", n, 0.8))
    return d.withColumns(cols).drop("_r", "_tr", "_v5", "_v10", "_v20", "_v60")


def volume_family(df: DataFrame, s: Series = S) -> DataFrame:
    c, v = F.col("close"), F.col("volume")
    d = df.withColumns({"_d": s.diff(c), "_r": s.pct(c)})
    d = d.withColumns({f"volume_ma_{n}": s.mean(v, n) for n in (5, 10, 20, 60)})
    d = d.withColumns({"_up": F.when(F.col("_d") > 0, c * v).otherwise(0.0),
                       "_dn": F.when(F.col("_d") < 0, c * v).otherwise(0.0)})
    cols = {f"volume_ratio_{n}": div(v, f"volume_ma_{n}") for n in (5, 10, 20, 60)}
    cols["vpt"] = F.when(F.col("_r").isNotNull(), s.cumsum(F.col("_r") * v))
    cols["obv"] = s.cumsum(F.when(F.col("_d") > 0, v).when(F.col("_d") < 0, -v).otherwise(0.0))
    vwap = div(s.sum(c * v, 20), s.sum(v, 20))
    cols["vwap_20"] = vwap
    cols["price_to_vwap"] = (div(c, vwap) - 1) * 100
    for n in (20, 60):
        cols[f"volume_breakout_{n}d"] = flag(v > s.quantile(v, n, 0.8))
    for n in (10, 20):
        cols[f"volume_trend_{n}d"] = flag(F.col(f"volume_ma_{n}") > s.lag(f"volume_ma_{n}", 5))
    cols["mfi_14"] = rsi_from(s.sum("_up", 14), s.sum("_dn", 14))
    return d.withColumns(cols).drop("_d", "_r", "_up", "_dn")


def streaks(df: DataFrame, s: Series = S) -> DataFrame:
    """Lengths of the current runs of rising and of falling closes."""
    d = with_pos(df.withColumn("_d", s.diff("close")), s)
    p = F.col("_pos")

    def run(cond):
        broken = F.max(F.when(~F.coalesce(cond, F.lit(False)), p)).over(s.run)
        return (p - F.coalesce(broken, F.lit(0))).cast("int")
    return d.withColumns({"consecutive_up_days": run(F.col("_d") > 0),
                          "consecutive_down_days": run(F.col("_d") < 0)}).drop("_d", "_pos")


def pattern_family(df: DataFrame, s: Series = S) -> DataFrame:
    """Gaps, streaks, reversals and nearness to extremes; the reversal flags look one bar ahead."""
    c = F.col("close")
    d = streaks(df, s).withColumns({"_gap": s.pct(c), "_prev": s.lag(c), "_next": s.lead(c)})
    cols = {"gap_up": flag(F.col("_gap") > 0.02), "gap_down": flag(F.col("_gap") < -0.02)}
    for n in (3, 5, 10):
        cols[f"top_reversal_{n}d"] = flag((c == s.max(c, n)) & (F.col("_prev") < c) & (F.col("_next") < c))
        cols[f"bottom_reversal_{n}d"] = flag((c == s.min(c, n)) & (F.col("_prev") > c) & (F.col("_next") > c))
    for n in (20, 60):
        cols[f"near_resistance_{n}d"] = flag(div(F.abs(c - s.max(c, n)), c) < 0.02)
        cols[f"near_support_{n}d"] = flag(div(F.abs(c - s.min(c, n)), c) < 0.02)
    return d.withColumns(cols).drop("_gap", "_prev", "_next")


def cycle_family(df: DataFrame, cycles=(5, 10, 22), s: Series = S) -> DataFrame:
    """Mean return of the last row's calendar month, and the mean of the last three cycle returns."""
    c = F.col("close")
    d = with_pos(df.withColumns({"_r": s.pct(c), "_m": s.last_of(F.month(s.order[0]))}), s)
    cols = {"monthly_effect": F.coalesce(
        F.avg(F.when(F.month(s.order[0]) == F.col("_m"), F.col("_r"))).over(s.whole), F.lit(0.0))}
    for n in cycles:
        legs = [div(s.lag(c, j * n) if j else c, s.lag(c, (j + 1) * n)) - 1 for j in range(3)]
        cols[f"cycle_momentum_{n}d"] = F.when(F.col("_pos") > 3 * n, (legs[0] + legs[1] + legs[2]) / 3).otherwise(0.0)
    return d.withColumns(cols).drop("_r", "_m", "_pos")


def adaptive_ma(df: DataFrame, window=20, s: Series = S) -> DataFrame:
    """Moving average whose smoothing follows relative volatility, clipped to 0.1 .. 0.9.

    While the smoothing is undefined the average rests on the price.  The factor of y' changes from
    row to row; the affine maps are composed in blocks, so no array of the series is built.
    """
    d = df.withColumn("_v", s.std("close", window))
    ratio = div("_v", s.mean("_v", window))
    clipped = F.when(F.col("_q").isNotNull(), F.least(F.greatest("_q", F.lit(0.1)), F.lit(0.9)))
    d = d.withColumn("_q", ratio).withColumn("_k", F.coalesce(clipped, F.lit(1.0)))
    return s.affine(d, "adaptive_ma", 1 - F.col("_k"), F.col("_k") * F.col("close")).drop("_v", "_q", "_k")


def trend_strength_persistence(df: DataFrame, window=20, s: Series = S) -> DataFrame:
    d = df.withColumn("_r", s.pct("close"))
    d = d.withColumn("_chg", flag(F.col("_r") * s.lag("_r") < 0))
    up = F.count(F.when(F.col("_r") > 0, 1)).over(s.past(window))
    share = F.when(F.count("_r").over(s.past(window)) >= window, (up / F.lit(float(window)) - 0.5) * 2)
    return d.withColumns({"trend_strength": F.coalesce(share, F.lit(0.0)),
                          "trend_persistence": 1 - s.sum("_chg", window) / window}).drop("_r", "_chg")


def donchian_keltner(df: DataFrame, window=20, s: Series = S) -> DataFrame:
    d = df.withColumns({"_tr": true_range(s), "_tp": (F.col("high") + F.col("low") + F.col("close")) / 3})
    d = d.withColumns({"donchian_upper": s.max("high", window), "donchian_lower": s.min("low", window),
                       "_ma": s.mean("_tp", window), "_atr": s.mean("_tr", window)})
    c, up, lo = F.col("close"), F.col("donchian_upper"), F.col("donchian_lower")
    d = d.withColumns({"donchian_middle": (up + lo) / 2, "donchian_position": div(c - lo, up - lo),
                       "keltner_upper": F.col("_ma") + 2 * F.col("_atr"), "keltner_lower": F.col("_ma") - 2 * F.col("_atr")})
    return d.withColumn("keltner_position", div(c - F.col("keltner_lower"), F.col("keltner_upper") - F.col("keltner_lower"))
                        ).drop("_tr", "_tp", "_ma", "_atr")


def support_resistance_strength(df: DataFrame, window=20, s: Series = S) -> DataFrame:
    """Counts of centred local extremes; the centred window looks ahead half its length."""
    half = window // 2
    c = F.col("close")
    d = df.withColumns({"_mx": flag(s.max(c, window, lo=-half, hi=half - 1) == c),
                        "_mn": flag(s.min(c, window, lo=-half, hi=half - 1) == c)})
    d = d.withColumns({"resistance_strength": s.sum("_mx", 2 * window), "support_strength": s.sum("_mn", 2 * window)})
    return d.withColumn("sr_ratio", F.col("resistance_strength") / (F.col("support_strength") + 1e-8)).drop("_mx", "_mn")


def microstructure_price(df: DataFrame, s: Series = S) -> DataFrame:
    c, v = F.col("close"), F.col("volume")
    d = df.withColumn("_r", s.pct(c)).withColumns({"_rl": s.lag("_r")})
    vwap = div(s.sum(c * v, 20), s.sum(v, 20))
    return d.withColumns({
        "price_jumps": flag(F.abs(div("_r", s.std("_r", 20))) > 3),
        "price_efficiency": div(div(F.abs(s.diff(c, 20)), s.lag(c, 20)), s.sum(F.abs("_r"), 20) + 1e-8),
        "amihud_illiquidity": div(F.abs("_r"), c * v + 1e-8), "vwap_deviation": div(c - vwap, vwap),
        "liquidity_ratio": div(v, s.mean(v, 20)), "market_impact": s.corr("_r", "_rl", 5)}).drop("_r", "_rl")


def atr_stoch_williams(df: DataFrame, n=14, d_window=3, s: Series = S) -> DataFrame:
    d = df.withColumns({"_tr": true_range(s), "_hh": s.max("high", n), "_ll": s.min("low", n)})
    d = d.withColumn("stoch_k", 100 * div(F.col("close") - F.col("_ll"), F.col("_hh") - F.col("_ll")))
    return d.withColumns({"stoch_d": s.mean("stoch_k", d_window), "atr": s.mean("_tr", n),
                          "williams_r": -100 * div(F.col("_hh") - F.col("close"), F.col("_hh") - F.col("_ll"))
                          }).drop("_tr", "_hh", "_ll")


def directional_moves(df: DataFrame, s: Series = S) -> DataFrame:
    up, dn = s.diff("high"), s.lag("low") - F.col("low")
    return df.withColumns({"_tr": true_range(s), "_up": up, "_dn": dn})


def adx_di(df: DataFrame, n=14, s: Series = S) -> DataFrame:
    d = directional_moves(df, s)
    # a side counts when it is the larger move, whatever its sign
    d = d.withColumns({"_p": F.when(F.col("_up") > F.col("_dn"), F.col("_up")).otherwise(0.0),
                       "_m": F.when(F.col("_dn") > F.col("_up"), F.col("_dn")).otherwise(0.0)})
    d = d.withColumns({"_atr": s.mean("_tr", n), "_pm": s.mean("_p", n), "_mm": s.mean("_m", n)})
    d = d.withColumns({"plus_di": div("_pm", "_atr") * 100, "minus_di": div("_mm", "_atr") * 100})
    p, m = F.col("plus_di"), F.col("minus_di")
    d = d.withColumn("_dx", div(F.abs(p - m), p + m + 1e-8) * 100)
    return d.withColumn("adx", s.mean("_dx", n)).drop("_tr", "_up", "_dn", "_p", "_m", "_atr", "_pm", "_mm", "_dx")


def adx_di_wilder(df: DataFrame, n=14, s: Series = S) -> DataFrame:
    """ADX with Wilder averages throughout (means of the first n values as seeds)."""
    d = directional_moves(df, s)
    has = F.col("_up").isNotNull()
    d = d.withColumns({
        "_p": F.when(has, F.when((F.col("_up") > F.col("_dn")) & (F.col("_up") > 0), F.col("_up")).otherwise(0.0)),
        "_m": F.when(has, F.when((F.col("_dn") > F.col("_up")) & (F.col("_dn") > 0), F.col("_dn")).otherwise(0.0)),
        "_t": F.when(has, F.col("_tr"))})
    d = wilder(d, {"_ps": "_p", "_ms": "_m", "_ts": "_t"}, {"_ps": n, "_ms": n, "_ts": n}, s)
    d = d.withColumns({"plus_di_w": 100 * div("_ps", "_ts"), "minus_di_w": 100 * div("_ms", "_ts")})
    p, m = F.col("plus_di_w"), F.col("minus_di_w")
    d = d.withColumn("_dx", F.when(p.isNotNull(), F.coalesce(100 * div(F.abs(p - m), p + m), F.lit(0.0))))
    return wilder(d, {"adx_w": "_dx"}, {"adx_w": n}, s).drop("_tr", "_up", "_dn", "_p", "_m", "_t", "_ps", "_ms", "_ts", "_dx")


def cci_mom_roc_trix(df: DataFrame, s: Series = S) -> DataFrame:
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3
    d = df.withColumn("_tp", tp).withColumn("_ma", s.mean("_tp", 14))
    arr = F.collect_list("_tp").over(s.past(14))
    mad = F.aggregate(F.transform(arr, lambda x: F.abs(x - F.col("_ma"))), F.lit(0.0), lambda a, x: a + x) / 14
    d = d.withColumn("cci", F.when(F.col("_ma").isNotNull(), div(F.col("_tp") - F.col("_ma"), 0.015 * mad)))
    d = d.withColumns({f"mom_{n}": s.diff("close", n) for n in (10, 20)})
    d = d.withColumns({f"roc_{n}": s.pct("close", n) * 100 for n in (10, 20)})
    for a, b in (("close", "_t1"), ("_t1", "_t2"), ("_t2", "_t3")):
        d = s.ewm(d, {b: (a, span(14), False)})
    return d.withColumn("trix", s.pct("_t3") * 100).drop("_tp", "_ma", "_t1", "_t2", "_t3")


def linreg_channel(df: DataFrame, n=20, s: Series = S) -> DataFrame:
    d = with_pos(df, s)
    hi, lo = s.max("high", n), s.min("low", n)
    return d.withColumns({
        "trend_slope": s.slope("close", n), "trend_r2": s.over(F.regr_r2("close", "_pos"), "close", n),
        "price_channel_position": F.when(hi > lo, div(F.col("close") - lo, hi - lo) * 100).when(hi.isNotNull(), 50.0)
    }).drop("_pos")


def volatility_log_range(df: DataFrame, s: Series = S) -> DataFrame:
    d = df.withColumn("_lr", F.log("close") - F.log(s.lag("close")))
    cols = {f"log_vol_{n}": s.std0("_lr", n) * YEAR * 100 for n in (10, 20, 60)}
    for n in (5, 10, 20):
        cols[f"price_range_{n}"] = div(s.max("high", n) - s.min("low", n), s.min("low", n)) * 100
    cols["intraday_range"] = div(F.col("high") - F.col("low"), "close") * 100
    d = d.withColumns(cols).withColumn("_tr", F.when(s.lag("close").isNotNull(), true_range(s)))
    d = wilder(d, {"_atr": "_tr"}, {"_atr": 20}, s)
    # the channel middle is seeded with the plain mean of its first 20 closes
    k = F.count("close").over(s.run)
    d = d.withColumn("_c", F.when(k == 20, F.avg("close").over(s.past(20))).when(k > 20, F.col("close")))
    d = s.ewm(d, {"_mid": ("_c", span(20), False)})
    lo, hi = F.col("_mid") - 2 * F.col("_atr"), F.col("_mid") + 2 * F.col("_atr")
    return d.withColumn("kc_position", F.when(hi > lo, div(F.col("close") - lo, hi - lo) * 100).when(hi.isNotNull(), 50.0)
                        ).drop("_lr", "_tr", "_atr", "_c", "_mid")


def obv_ad_cmf(df: DataFrame, s: Series = S) -> DataFrame:
    c, h, lo, v = (F.col(x) for x in ("close", "high", "low", "volume"))
    d = df.withColumn("_d", s.diff(c)).withColumn(
        "_mfv", F.coalesce(div((c - lo) - (h - c), h - lo), F.lit(0.0)) * v)
    # on-balance volume starts from the first bar's volume
    sign = F.when(F.col("_d") > 0, v).when(F.col("_d") < 0, -v).when(F.col("_d").isNull(), v).otherwise(0.0)
    d = d.withColumns({"obv": s.cumsum(sign), "ad_line": s.cumsum("_mfv"),
                       "cmf_20": div(s.sum("_mfv", 20), s.sum(v, 20)), "vroc": s.pct(v, 10) * 100})
    d = s.ewm(d, {"_a3": ("ad_line", span(3), False), "_a10": ("ad_line", span(10), False)})
    d = d.withColumn("obv_change_10", div(s.diff("obv", 9), F.abs(s.lag("obv", 9))) * 100)
    return d.withColumn("adosc", F.col("_a3") - F.col("_a10")).drop("_d", "_mfv", "_a3", "_a10")


def candlestick_patterns(df: DataFrame, s: Series = S) -> DataFrame:
    """Five candle shapes with thresholds of our own.

    doji: body at most 10 % of the range.  hammer / hanging man: lower shadow at least twice the
    body, upper shadow at most half the body, after a fall / rise below / above the 10-bar mean.
    shooting star: the mirror image after a rise.  engulfing: opposite bodies, the second covering
    the first.
    """
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    body, rng = F.abs(c - o), h - lo
    upper, lower = h - F.greatest(o, c), F.least(o, c) - lo
    po, pc, m = s.lag(o), s.lag(c), s.mean(c, 10)
    d = df.withColumns({"_body": body, "_up": upper, "_lo": lower, "_rng": rng, "_po": po, "_pc": pc, "_m": m})
    b = F.col("_body")
    long_low = (F.col("_lo") >= 2 * b) & (F.col("_up") <= 0.5 * b) & (b > 0)
    long_up = (F.col("_up") >= 2 * b) & (F.col("_lo") <= 0.5 * b) & (b > 0)
    cover = ((c > o) & (F.col("_pc") < F.col("_po")) & (c >= F.col("_po")) & (o <= F.col("_pc"))) | (
        (c < o) & (F.col("_pc") > F.col("_po")) & (c <= F.col("_po")) & (o >= F.col("_pc")))
    return d.withColumns({
        "hammer": flag(long_low & (c < F.col("_m"))), "hanging_man": flag(long_low & (c > F.col("_m"))),
        "shooting_star": flag(long_up & (c > F.col("_m"))), "engulfing": flag(cover),
        "doji": flag(b <= 0.1 * F.col("_rng"))}).drop("_body", "_up", "_lo", "_rng", "_po", "_pc", "_m")


def pattern_52w_breakout(df: DataFrame, s: Series = S) -> DataFrame:
    c, h, lo = F.col("close"), F.col("high"), F.col("low")
    hi52, lo52 = s.max(h, 252, 52), s.min(lo, 252, 52)
    pc = s.lag(c)
    return df.withColumns({
        "distance_to_resistance": div(s.max(h, 20) - c, c) * 100, "distance_to_support": div(c - s.min(lo, 20), c) * 100,
        "open_gap_up": F.when(pc.isNotNull(), F.when(F.col("open") > pc, div(F.col("open") - pc, pc) * 100).otherwise(0.0)),
        "open_gap_down": F.when(pc.isNotNull(), F.when(F.col("open") < pc, div(pc - F.col("open"), pc) * 100).otherwise(0.0)),
        "position_52w": F.when(hi52 > lo52, div(c - lo52, hi52 - lo52) * 100).when(hi52.isNotNull(), 50.0),
        "distance_to_52w_high": div(hi52 - c, c) * 100, "distance_to_52w_low": div(c - lo52, c) * 100,
        "breakout_up": flag(h > s.max(h, 19, lo=-19, hi=-1)), "breakout_down": flag(lo < s.min(lo, 19, lo=-19, hi=-1))})


def natr_bbands5(df: DataFrame, s: Series = S) -> DataFrame:
    d = df.withColumns({"bb5_middle": s.mean("close", 5), "_sd": s.std0("close", 5)})
    d = d.withColumns({"bb5_upper": F.col("bb5_middle") + 2 * F.col("_sd"), "bb5_lower": F.col("bb5_middle") - 2 * F.col("_sd"),
                       "_tr": F.when(s.lag("close").isNotNull(), true_range(s))})
    w = F.col("bb5_upper") - F.col("bb5_lower")
    d = d.withColumns({"bb5_width": div(w, "bb5_middle"), "bb5_position": div(F.col("close") - F.col("bb5_lower"), w)})
    d = wilder(d, {"atr_w14": "_tr"}, {"atr_w14": 14}, s)
    return d.withColumn("natr_14", div("atr_w14", "close") * 100).drop("_sd", "_tr")


def indicator_panel(df: DataFrame, s: Series = S) -> DataFrame:
    d = s.ewm(df, {"ema_12": ("close", span(12), True), "ema_26": ("close", span(26), True)})
    d = s.ewm(d.withColumn("macd", F.col("ema_12") - F.col("ema_26")), {"macd_signal": ("macd", span(9), True)})
    d = gains_losses(d, s)
    cols = {f"sma_{n}": s.mean("close", n) for n in (5, 10, 20, 50)}
    m, sd = s.mean("close", 20), s.std("close", 20)
    cols.update({"macd_histogram": F.col("macd") - F.col("macd_signal"), "rsi": rsi_from(s.mean("_gain", 14), s.mean("_loss", 14)),
                 "bb_middle": m, "bb_upper": m + 2 * sd, "bb_lower": m - 2 * sd, "volume_sma": s.mean("volume", 20)})
    return d.withColumns(cols).drop("_d", "_gain", "_loss")


def snapshot_last(df: DataFrame, s: Series = S) -> DataFrame:
    """Last row of every series."""
    return df.withColumn("_last", s.is_last()).where("_last").drop("_last")


def factor_snapshot(df: DataFrame, s: Series = S) -> DataFrame:
    """The main technical factors of the last bar, one row per symbol; NULLs take neutral values."""
    d = adx_di(obv_ad_cmf(macd_family(rsi_sma(bollinger_family(df, s=s), s=s), s=s), s=s), s=s)
    d = d.withColumns({"volume_ratio_20": div("volume", s.mean("volume", 20)),
                       "bb_position_pct": F.col("bb_position") * 100})
    d = snapshot_last(d, s)
    neutral = {"rsi_14": 50.0, "macd_line": 0.0, "macd_signal": 0.0, "adx": 0.0, "bb_position_pct": 50.0,
               "volume_ratio_20": 1.0}
    return d.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in neutral.items()})


def factor_scores(snap: DataFrame) -> DataFrame:
    """Scores 0 .. 100 from the snapshot."""
    r, b, a, v = (F.col(x) for x in ("rsi_14", "bb_position_pct", "adx", "volume_ratio_20"))
    return snap.withColumns({
        "rsi_14_score": ladder([(r <= 30, 100), (r >= 70, 0)], 50),
        "macd_score": F.when(F.col("macd_line") > F.col("macd_signal"), 100).otherwise(0),
        "bb_position_score": ladder([(b <= 20, 100), (b >= 80, 0)], 50),
        "trend_strength_score": ladder([(a >= 25, 100), (a >= 20, 75)], 25),
        "volume_score": ladder([(v >= 2, 100), (v >= 1.5, 75), (v >= 0.5, 50)], 25)})
