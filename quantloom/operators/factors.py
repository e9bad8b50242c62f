"""Factor processing, evaluation, weighting and combination.

Factor values travel in long form (symbol, date, factor, value[, fwd]); per-date statistics are
partial aggregates or exact distributed ranks, so a date never has to fit one task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.exact import quantiles, sorted_ranks, with_group_stats, with_ranks
from quantloom.functions.series import Series, div, flag, ladder
from quantloom.operators.relational import bucketize, corr_agg
from quantloom.operators.sentiment import norm_cdf
from quantloom.session import materialise

KEYS = ["symbol", "date", "factor"]


# --- processing ------------------------------------------------------------------------------
def winsorize(df: DataFrame, col="value", by=("date", "factor"), lo=0.05, hi=0.95, out: str | None = None) -> DataFrame:
    q = materialise(quantiles(df, list(by), col, [lo, hi], ["_lo", "_hi"]), "quantiles")  # one row per group
    d = df.join(q, list(by), "left")
    return d.withColumn(out or col, F.when(F.col(col).isNotNull(), F.least(F.greatest(col, "_lo"), F.col("_hi")))).drop("_lo", "_hi")


def clip_sigma(df: DataFrame, col="value", by=("factor",), k=3.0) -> DataFrame:
    d = with_group_stats(df, list(by), {"_m": F.avg(col), "_s": F.stddev_samp(col)}, few="date" not in by)
    return d.withColumn(col, F.least(F.greatest(F.col(col), F.col("_m") - k * F.col("_s")), F.col("_m") + k * F.col("_s"))).drop("_m", "_s")


def zscore(df: DataFrame, col="value", by=("date", "factor"), out="z") -> DataFrame:
    d = with_group_stats(df, list(by), {"_m": F.avg(col), "_s": F.stddev_samp(col)}, few="date" not in by)
    return d.withColumn(out, div(F.col(col) - F.col("_m"), "_s")).drop("_m", "_s")


def minmax(df: DataFrame, col="value", by=("date", "factor"), out="mm") -> DataFrame:
    d = with_group_stats(df, list(by), {"_a": F.min(col), "_b": F.max(col)})
    return d.withColumn(out, div(F.col(col) - F.col("_a"), F.col("_b") - F.col("_a"))).drop("_a", "_b")


def robust_z(df: DataFrame, col="value", by=("date", "factor"), out="rz") -> DataFrame:
    """(x - median) / (1.4826 MAD): two exact median passes."""
    d = df.join(quantiles(df, list(by), col, [0.5], ["_md"]), list(by), "left").withColumn("_ad", F.abs(F.col(col) - F.col("_md")))
    d = d.join(quantiles(d, list(by), "_ad", [0.5], ["_mad"]), list(by), "left")
    return d.withColumn(out, div(F.col(col) - F.col("_md"), 1.4826 * F.col("_mad"))).drop("_md", "_ad", "_mad")


def neutralize(df: DataFrame, industry: DataFrame, col="value", how="zscore", min_names=10) -> DataFrame:
    """z-score inside industry and date, or the residual on industry dummies (= industry demeaning)."""
    d = df.join(industry, "symbol")
    d = with_group_stats(d, ["date", "factor", "industry"], {"_m": F.avg(col), "_s": F.stddev_samp(col)})
    if how == "zscore":
        return d.withColumn("neutral", div(F.col(col) - F.col("_m"), "_s")).drop("_m", "_s")
    d = with_group_stats(d, ["date", "factor"], {"_n": F.count(col)})
    return d.withColumn("neutral", F.when(F.col("_n") > min_names, F.col(col) - F.col("_m")).otherwise(F.col(col))).drop("_m", "_s", "_n")


def process(df: DataFrame, industry: DataFrame, config: dict) -> DataFrame:
    """Winsorise, standardise and neutralise each factor as its config says."""
    d = winsorize(df, by=("date", "factor"), lo=0.01, hi=0.99, out="_w")
    wz = [f for f, c in config.items() if c.get("winsorize", True)]
    d = d.withColumn("_x", F.when(F.col("factor").isin(wz), F.col("_w")).otherwise(F.col("value")))
    d = zscore(d, "_x", out="_z")
    sd = [f for f, c in config.items() if c.get("standardize", True)]
    d = d.withColumn("_x", F.when(F.col("factor").isin(sd), F.col("_z")).otherwise(F.col("_x")))
    d = neutralize(d, industry, "_x", "ols")
    nt = [f for f, c in config.items() if c.get("neutralize", False)]
    return d.withColumn("processed", F.when(F.col("factor").isin(nt), F.col("neutral")).otherwise(F.col("_x"))).drop("_w", "_x", "_z", "neutral")


def weighted_score(df: DataFrame, weights: dict[str, float], lo=0.05, hi=0.95) -> DataFrame:
    """Signed weights x winsorised z-scores over the whole sample, summed per (symbol, date)."""
    df = materialise(df.select(*KEYS, "value"), "values")  # read for the quantiles, the moments and the scores
    z = zscore(winsorize(df, by=("factor",), lo=lo, hi=hi), by=("factor",))
    w = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
    return z.groupBy("symbol", "date").agg(F.sum(F.coalesce("z", F.lit(0.0)) * F.coalesce(F.try_element_at(w, F.col("factor")), F.lit(0.0))).alias("score"))


# --- evaluation ------------------------------------------------------------------------------
def complete(df: DataFrame) -> DataFrame:
    return df.where(F.col("value").isNotNull() & F.col("fwd").isNotNull())


def two_sided_p(t: Column) -> Column:
    """Two-sided p-value by the normal tail (the samples have thousands of rows)."""
    return 2 * (1 - norm_cdf(F.abs(t)))


def ic_total(df: DataFrame) -> DataFrame:
    """Pearson and Spearman IC per factor over all rows, with t statistic and p-value."""
    d = with_ranks(complete(df), KEYS, ["factor"], {"_rv": ("value", "mean_row"), "_rf": ("fwd", "mean_row")})
    g = d.groupBy("factor").agg(corr_agg("value", "fwd").alias("ic"), corr_agg("_rv", "_rf").alias("rank_ic"), F.count(F.lit(1)).alias("n"))
    t = F.col("ic") * F.sqrt((F.col("n") - 2) / (1 - F.col("ic") * F.col("ic")))
    return g.withColumn("t_stat", t).withColumn("p_value", two_sided_p(F.col("t_stat")))


def ic_by_date(df: DataFrame, min_names=3) -> DataFrame:
    """Correlation of values and of their ranks with the forward return per date and factor, rows sorted inside their date and factor.

    Rows that already lie by date are not moved; others are moved once.
    """
    d = sorted_ranks(complete(df).select("date", "factor", "value", "fwd"), ["date", "factor"], {"_rv": ("value", "mean_row"), "_rf": ("fwd", "mean_row")})
    g = d.groupBy("date", "factor").agg(corr_agg("value", "fwd").alias("ic"), corr_agg("_rv", "_rf").alias("rank_ic"), F.count(F.lit(1)).alias("n"))
    return g.where(F.col("n") >= min_names)


FS = Series(("factor",), ("date",))  # per-date factor statistics: calendar bounded


def ic_summary(ic: DataFrame, by=("factor",)) -> DataFrame:
    g = ic.groupBy(*by).agg(F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"), F.avg(F.when(F.col("ic").isNotNull(), flag(F.col("ic") > 0))).alias("positive_ratio"), F.count("ic").alias("n"))
    return g.withColumn("ir", div("ic_mean", "ic_std"))


def quantile_returns(df: DataFrame, n=5, by=("factor",)) -> DataFrame:
    d = bucketize(complete(df), "value", n, ["date", *by])
    return d.groupBy(*by, "bucket").agg(F.avg("fwd").alias("mean_fwd"), F.count(F.lit(1)).alias("n"))


def long_short(qr: DataFrame, n=5, by=("factor",)) -> DataFrame:
    return qr.groupBy(*by).agg((F.max(F.when(F.col("bucket") == n, F.col("mean_fwd"))) - F.max(F.when(F.col("bucket") == 1, F.col("mean_fwd")))).alias("spread"))


def rolling_ic(df: DataFrame, n=20) -> DataFrame:
    s = Series(("symbol", "factor"), ("date",))
    return df.withColumn("rolling_ic", s.corr("value", "fwd", n, lo=-n, hi=-1))


def layer_returns(df: DataFrame, n=5, cost_bps=10.0) -> DataFrame:
    """Per date and layer: mean forward return minus membership turnover x cost."""
    d = bucketize(complete(df), "value", n, ["date", "factor"])
    days = d.select("date").distinct().withColumn("_dp", F.row_number().over(Series((), ("date",)).w))  # calendar bounded
    s = Series(("symbol", "factor"), ("date",))
    d = d.join(days, "date").withColumns({"_pb": s.lag("bucket"), "_pd": s.lag("_dp")})
    same = flag((F.col("_pd") == F.col("_dp") - 1) & (F.col("_pb") == F.col("bucket")))
    g = d.groupBy("factor", "date", "bucket").agg(F.avg("fwd").alias("raw"), F.sum(same).alias("_kept"), F.count(F.lit(1)).alias("n"), F.first("_dp").alias("_dp"))
    gs = Series(("factor", "bucket"), ("date",))
    prev = F.when(gs.lag("_dp") == F.col("_dp") - 1, gs.lag("n"))
    g = g.withColumn("turnover", F.when(prev.isNull(), 1.0).otherwise(1 - F.col("_kept") / prev))
    return g.withColumn("net", F.col("raw") - F.col("turnover") * cost_bps / 10000).drop("_kept", "_dp")


def turnover_coverage(df: DataFrame) -> DataFrame:
    """1 - rank correlation with the previous date (common names, at least five), and the share of valid values."""
    days = df.select("date").distinct().withColumn("_dp", F.row_number().over(Series((), ("date",)).w))  # calendar bounded
    s = Series(("symbol", "factor"), ("date",))
    d = df.join(days, "date").withColumns({"_pv": s.lag("value"), "_pd": s.lag("_dp")})
    cov = d.groupBy("date", "factor").agg((F.count("value") / F.count(F.lit(1))).alias("coverage"))
    both = d.where(F.col("value").isNotNull() & F.col("_pv").isNotNull() & (F.col("_pd") == F.col("_dp") - 1))
    r = with_ranks(both, KEYS, ["date", "factor"], {"_a": ("value", "mean_row"), "_b": ("_pv", "mean_row")})
    g = r.groupBy("date", "factor").agg(corr_agg("_a", "_b").alias("_c"), F.count(F.lit(1)).alias("_n"))
    t = F.when(F.col("_n") >= 5, F.least(F.greatest(1 - F.coalesce("_c", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return cov.join(g, ["date", "factor"], "left").withColumn("turnover", F.coalesce(t, F.lit(0.0))).drop("_c", "_n")


def stability_decay(ic: DataFrame, n=20) -> DataFrame:
    """1 - std / |mean| of the last n per-date ICs (ddof 0), and the slope of |IC| counted from the newest."""
    d = ic.withColumn("_age", F.row_number().over(Series(("factor",), (F.desc("date"),)).w) - 1).where(F.col("_age") < n)
    g = d.groupBy("factor").agg(F.avg("ic").alias("_m"), F.stddev_pop("ic").alias("_s"), F.regr_slope(F.abs("ic"), F.col("_age")).alias("slope"), F.count("ic").alias("n"))
    st = F.least(F.greatest(1 - div("_s", F.abs("_m")), F.lit(0.0)), F.lit(1.0))
    return g.withColumns({"stability": F.when(F.col("n") >= 3, st).otherwise(0.0), "decaying": flag((F.col("n") >= 10) & (F.col("slope") < -0.001))}).drop("_m", "_s")


def alerts(ic: DataFrame, stab: DataFrame, cover: DataFrame, pairs: DataFrame, ic_min=0.02, stab_min=0.5, cover_min=0.8, corr_max=0.2) -> DataFrame:
    def rows(d, name, kind, level, value, limit):
        return d.select(name.alias("factor"), F.lit(kind).alias("alert"), level.alias("level"), value.alias("value"), F.lit(limit).alias("threshold"))
    f = F.col("factor")
    out = rows(ic.where(F.abs("ic") < ic_min), f, "low_ic", F.lit("medium"), F.abs("ic"), ic_min)
    out = out.unionByName(rows(stab.where(F.col("stability") < stab_min), f, "unstable", F.lit("high"), F.col("stability"), stab_min))
    out = out.unionByName(rows(stab.where(F.col("decaying") == 1), f, "decay", F.when(F.abs("slope") > 0.01, "critical").otherwise("high"), F.abs("slope"), 0.001))
    out = out.unionByName(rows(cover.where(F.col("coverage") < cover_min), f, "low_coverage", F.lit("medium"), F.col("coverage"), cover_min))
    return out.unionByName(rows(pairs.where(F.abs("corr") > corr_max), F.concat_ws("-", "a", "b"), "correlated", F.lit("medium"), F.abs("corr"), corr_max))


# --- weights and combination ------------------------------------------------------------------
def simple_weights(summary: DataFrame) -> DataFrame:
    d = with_group_stats(summary, [], {"_ic": F.sum(F.abs("ic_mean")), "_ir": F.sum(F.abs("ir")), "_n": F.count(F.lit(1))})
    return d.select("factor", (F.lit(1.0) / F.col("_n")).alias("w_equal"), div(F.abs("ic_mean"), "_ic").alias("w_ic"), div(F.abs("ir"), "_ir").alias("w_ir"))


def greedy_filter(pairs: list[tuple[str, str, float]], names: list[str], threshold=0.8) -> list[str]:
    """Keep a factor unless it correlates beyond the threshold with one kept before; a short list of columns."""
    high = {frozenset((a, b)) for a, b, c in pairs if c is not None and abs(c) > threshold}
    kept: list[str] = []
    for n in names:
        if not any(frozenset((n, k)) in high for k in kept):
            kept.append(n)
    return kept


def combine(df: DataFrame, weights: DataFrame, weight="w_ic") -> DataFrame:
    """Weighted sum of per-date z-scores; weights hold one row per factor."""
    return zscore(df).join(F.broadcast(weights.select("factor", F.col(weight).alias("_w"))), "factor").groupBy("symbol", "date").agg(F.sum(F.coalesce("z", F.lit(0.0)) * F.col("_w")).alias("combined"))


def factor_performance(df: DataFrame) -> DataFrame:
    """Per-date factor return: mean of z-score x forward return."""
    return zscore(complete(df)).groupBy("date", "factor").agg(F.avg(F.col("z") * F.col("fwd")).alias("perf"))


def normalize_positive(d: DataFrame, col: str, out: str) -> DataFrame:
    d = with_group_stats(d.withColumn("_p", F.greatest(F.coalesce(col, F.lit(0.0)), F.lit(0.0))), [], {"_t": F.sum("_p"), "_k": F.count(F.lit(1))})
    return d.withColumn(out, F.when(F.col("_t") > 0, F.col("_p") / F.col("_t")).otherwise(F.lit(1.0) / F.col("_k"))).drop("_p", "_t", "_k")


def adaptive_weights(perf: DataFrame, regime: DataFrame) -> DataFrame:
    """0.4 regime + 0.3 momentum + 0.3 risk-adjusted weights; regime holds (date, regime)."""
    cur = regime.agg(F.max_by("regime", "date").alias("_cur"))
    d = perf.join(regime, "date").crossJoin(F.broadcast(cur))  # one row
    d = d.withColumn("_age", F.row_number().over(Series(("factor",), (F.desc("date"),)).w))
    p, a = F.col("perf"), F.col("_age")
    g = d.groupBy("factor").agg(F.avg(F.when(F.col("regime") == F.col("_cur"), p)).alias("_rg"), (0.6 * F.avg(F.when(a <= 20, p)) + 0.4 * F.avg(F.when(a <= 60, p))).alias("_mo"),
                                (F.avg(p) / (F.stddev_samp(p) + 1e-8)).alias("_sh"))
    for c, o in (("_rg", "w_regime"), ("_mo", "w_momentum"), ("_sh", "w_risk")):
        g = normalize_positive(g, c, o)
    return g.withColumn("weight", 0.4 * F.col("w_regime") + 0.3 * F.col("w_momentum") + 0.3 * F.col("w_risk")).drop("_rg", "_mo", "_sh")


def rotation(perf: DataFrame, lookback=20, z_window=60, threshold=0.1, target=0.15, s: Series = FS) -> DataFrame:
    """Factor momentum, its z-score signal, and weights normalised per date and scaled to a volatility target."""
    d = perf.withColumn("momentum", s.mean("perf", lookback))
    d = d.withColumn("z", div(F.col("momentum") - s.mean("momentum", z_window), s.std("momentum", z_window)))
    d = d.withColumn("signal", ladder([(F.col("z") > threshold, 1.0), (F.col("z") < -threshold, -1.0)], 0.0))
    d = with_group_stats(d, ["date"], {"_t": F.sum(F.abs("signal"))}).withColumn("raw_weight", F.coalesce(div("signal", "_t"), F.lit(0.0)))
    d = with_group_stats(d, ["date"], {"_s": F.stddev_samp("raw_weight")})
    mult = F.least(F.greatest(target / (F.col("_s") + 1e-8), F.lit(0.5)), F.lit(2.0))
    return d.withColumn("weight", F.col("raw_weight") * F.coalesce(mult, F.lit(2.0))).drop("_t", "_s")


def multi_timeframe(df: DataFrame, weights=(0.2, 0.5, 0.3)) -> DataFrame:
    """Blend of standardised short, medium and long factors, with their agreement in sign."""
    z = df.groupBy("symbol", "date").pivot("factor", ["short", "medium", "long_"]).agg(F.first("z"))
    a, b, c = F.col("short"), F.col("medium"), F.col("long_")
    blend = weights[0] * F.coalesce(a, F.lit(0.0)) + weights[1] * F.coalesce(b, F.lit(0.0)) + weights[2] * F.coalesce(c, F.lit(0.0))
    return z.withColumns({"blend": blend, "agreement": F.abs(F.coalesce(F.signum(a), F.lit(0.0)) + F.coalesce(F.signum(b), F.lit(0.0)) + F.coalesce(F.signum(c), F.lit(0.0))) / 3})


def timing_selection(sel: DataFrame, timing: DataFrame, lo=0.001, hi=0.05) -> DataFrame:
    """Selection scores x the date's timing signal, clipped and renormalised per date."""
    d = sel.join(timing, "date").withColumn("integrated", F.col("score") * F.col("timing"))
    d = d.withColumn("_c", F.least(F.greatest("integrated", F.lit(lo)), F.lit(hi)))
    return with_group_stats(d, ["date"], {"_t": F.sum("_c")}).withColumn("weight", div("_c", "_t")).drop("_c", "_t")
