"""Multi-factor model and portfolio construction."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions.exact import with_group_stats
from quantloom.functions.series import Series, div, flag
from quantloom.operators.relational import top_n


def solve_spd(d: DataFrame, a: dict[tuple[int, int], str], b: list[str], out: list[str], least: float = 1e-12) -> DataFrame:
    """Add the solution of a symmetric positive definite system per row, by a Cholesky factor in column expressions.

    ``a`` names the column of each element on and below the diagonal, ``b`` those of the right side.  A pivot of less than
    ``least`` of its diagonal element means dependent columns: the solution is NULL then.
    """
    k = len(b)
    temporary = []

    def add(name, value):
        nonlocal d
        temporary.append(name)
        d = d.withColumn(name, value)
        return F.col(name)
    low: dict[tuple[int, int], F.Column] = {}
    for j in range(k):
        for i in range(j, k):
            rest = sum((low[i, m] * low[j, m] for m in range(j)), F.lit(0.0))
            value = F.col(a[i, j]) - rest
            low[i, j] = add(f"_l{i}_{j}", F.when(value > least * F.col(a[j, j]), F.sqrt(value)) if i == j else value / low[j, j])
    y, x = [], {}
    for i in range(k):
        y.append(add(f"_y{i}", (F.col(b[i]) - sum((low[i, m] * y[m] for m in range(i)), F.lit(0.0))) / low[i, i]))
    for i in reversed(range(k)):
        x[i] = add(f"_x{i}", (y[i] - sum((low[m, i] * x[m] for m in range(i + 1, k)), F.lit(0.0))) / low[i, i])
    return d.withColumns({name: x[i] for i, name in enumerate(out)}).drop(*temporary)


def cross_sectional_returns(df: DataFrame, factors, ret="fwd", min_names=10) -> DataFrame:
    """Per-date OLS of returns on exposures (no intercept); NULL returns where exposures are dependent.

    The k x k normal equations are summed per date (combined map-side) and solved in column expressions.
    """
    k = len(factors)
    ok = F.col(ret).isNotNull()
    for f in factors:
        ok &= F.col(f).isNotNull()
    a = {(i, j): f"_a{i}_{j}" for i in range(k) for j in range(i + 1)}
    sums = [F.sum(F.col(factors[i]) * F.col(factors[j])).alias(name) for (i, j), name in a.items()] + [F.sum(F.col(f) * F.col(ret)).alias(f"_b{i}") for i, f in enumerate(factors)]
    g = df.where(ok).groupBy("date").agg(*sums, F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_names)
    return solve_spd(g, a, [f"_b{i}" for i in range(k)], list(factors)).select("date", *factors, "n")


def decay_covariance(wide: DataFrame, factors, decay=0.94) -> DataFrame:
    """Decay-weighted covariance around the plain mean; one row per date, k columns."""
    s = Series((), ("date",))
    d = with_group_stats(wide, [], {f"_m_{f}": F.avg(f) for f in factors} | {"_n": F.count(F.lit(1))})
    d = d.withColumn("_w", F.pow(F.lit(decay), F.col("_n") - F.row_number().over(s.w)))
    aggs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), div(F.sum(F.col("_w") * (F.col(a) - F.col(f"_m_{a}")) * (F.col(b) - F.col(f"_m_{b}"))), F.sum("_w")).alias("cov"))
            for i, a in enumerate(factors) for b in factors[i:]]
    return d.agg(F.array(*aggs).alias("p")).select(F.explode("p").alias("q")).select("q.*")


def residuals(exposures: DataFrame, factor_returns: DataFrame, ret="fwd") -> DataFrame:
    """Return minus exposure x factor return, long inputs (symbol, date, factor, value, fwd), (date, factor, fret)."""
    j = exposures.join(factor_returns, ["date", "factor"])
    return j.groupBy("symbol", "date").agg((F.first(ret) - F.sum(F.col("value") * F.col("fret"))).alias("residual"))


def specific_risk(res: DataFrame, decay=0.94, s: Series = Series(("symbol",), ("date",))) -> DataFrame:
    d = res.where(F.col("residual").isNotNull())
    d = d.withColumn("_w", F.pow(F.lit(decay), F.count(F.lit(1)).over(s.whole) - F.row_number().over(s.w)))
    return d.groupBy("symbol").agg(F.stddev_samp("residual").alias("residual_std"), F.sqrt(div(F.sum(F.col("_w") * F.col("residual") ** 2), F.sum("_w"))).alias("decay_risk"), F.count(F.lit(1)).alias("n"))


def model_risk(weights: DataFrame, exposures: DataFrame, factor_cov: DataFrame, specific: DataFrame) -> DataFrame:
    """Annualised portfolio risk from factor and specific parts; factor_cov holds pairs a <= b."""
    pe = weights.join(exposures, "symbol").groupBy("portfolio", "factor").agg(F.sum(F.col("weight") * F.col("exposure")).alias("x"))
    a, b = pe.select("portfolio", F.col("factor").alias("a"), F.col("x").alias("xa")), pe.select("portfolio", F.col("factor").alias("b"), F.col("x").alias("xb"))
    fr = a.join(factor_cov, "a").join(b, ["portfolio", "b"]).groupBy("portfolio").agg(F.sum(F.when(F.col("a") == F.col("b"), 1.0).otherwise(2.0) * F.col("xa") * F.col("xb") * F.col("cov")).alias("factor_risk"))
    sp = weights.join(specific, "symbol").groupBy("portfolio").agg(F.sum(F.col("weight") ** 2 * F.col("specific") ** 2).alias("specific_risk"))
    return fr.join(sp, "portfolio").withColumn("total_risk", F.sqrt((F.col("factor_risk") + F.col("specific_risk")) * 252))


def top_n_weights(df: DataFrame, n=10, lo=0.02, hi=0.2) -> DataFrame:
    """Best n names per date: equal, score and inverse-volatility weights, the last clipped and renormalised."""
    d = top_n(df, "score", n, ["date"], ["symbol"])
    d = with_group_stats(d, ["date"], {"_n": F.count(F.lit(1)), "_lo": F.min("score"), "_iv": F.sum(F.try_divide(F.lit(1.0), F.col("vol")))})
    d = d.withColumn("_s", F.col("score") - F.col("_lo") + 1e-8)
    d = with_group_stats(d, ["date"], {"_ss": F.sum("_s")})
    d = d.withColumns({"w_equal": F.lit(1.0) / F.col("_n"), "w_score": div("_s", "_ss"), "_w": div(div(F.lit(1.0), "vol"), "_iv")})
    d = d.withColumn("_c", F.least(F.greatest("_w", F.lit(lo)), F.lit(hi)))
    return with_group_stats(d, ["date"], {"_t": F.sum("_c")}).withColumn("w_inverse_vol", div("_c", "_t")).drop("_n", "_lo", "_iv", "_s", "_ss", "_w", "_c", "_t")


def weight_metrics(weights: DataFrame) -> DataFrame:
    w = F.col("weight")
    return weights.groupBy("portfolio").agg(F.sum(w).alias("total"), F.max(w).alias("max_weight"), F.min(w).alias("min_weight"), F.sum(w * w).alias("hhi"), F.count(F.lit(1)).alias("n"), F.sum(F.abs(w)).alias("gross")
                                            ).withColumn("effective_n", div(F.lit(1.0), "hhi"))


def constraint_checks(weights: DataFrame, sectors: DataFrame, sector_cap=0.5, turnover_cap=0.3) -> DataFrame:
    """Sum, long-only, sector-cap and turnover-cap violations; needs weight and old_weight."""
    d = weights.join(sectors, "symbol", "left")
    sec = d.groupBy("portfolio", "sector").agg(F.sum("weight").alias("_sw")).groupBy("portfolio").agg(F.max("_sw").alias("max_sector"))
    g = d.groupBy("portfolio").agg(F.sum("weight").alias("total"), F.min("weight").alias("lowest"), (F.sum(F.abs(F.col("weight") - F.col("old_weight"))) / 2).alias("turnover")).join(sec, "portfolio")
    return g.withColumns({"sum_violation": flag(F.abs(F.col("total") - 1) > 1e-6), "long_only_violation": flag(F.col("lowest") < 0), "sector_violation": flag(F.col("max_sector") > sector_cap), "turnover_violation": flag(F.col("turnover") > turnover_cap)})


def rebalance_dates(dates: DataFrame) -> DataFrame:
    """Flags on the distinct dates: last date of the month, last date of the week."""
    d = dates.select("date").distinct()
    m = d.groupBy(F.trunc("date", "month").alias("_m")).agg(F.max("date").alias("_ml"))
    return d.withColumn("_m", F.trunc("date", "month")).join(m, "_m").select("date", flag(F.col("date") == F.col("_ml")).alias("monthly"), flag(F.weekday("date") == 4).alias("weekly"), F.lit(1).alias("daily"))


def turnover(weights: DataFrame, key="portfolio", order="date") -> DataFrame:
    """Half the absolute weight change between consecutive dates; names missing on one side count 0."""
    days = weights.select(key, order).distinct()
    s = Series((key,), (order,))
    days = days.withColumns({"_prev": s.lag(order), "_next": s.lead(order)})
    cur = weights.join(days, [key, order]).select(key, F.col(order).alias("d"), "symbol", "weight", "_prev", "_next")
    now = cur.where(F.col("_prev").isNotNull()).select(key, "d", "symbol", F.col("weight").alias("w1"), F.lit(0.0).alias("w0"))
    old = cur.where(F.col("_next").isNotNull()).select(key, F.col("_next").alias("d"), "symbol", F.lit(0.0).alias("w1"), F.col("weight").alias("w0"))
    per = now.unionByName(old).groupBy(key, "d", "symbol").agg(F.sum("w1").alias("w1"), F.sum("w0").alias("w0"))
    return per.groupBy(key, F.col("d").alias(order)).agg((F.sum(F.abs(F.col("w1") - F.col("w0"))) / 2).alias("turnover"), F.count(F.lit(1)).alias("n"))


def grid_evaluate(grid: DataFrame, stats: DataFrame, cov: DataFrame) -> DataFrame:
    """Return, risk and Sharpe ratio of candidate weight vectors (id, asset, weight) over a short asset list, with the efficient flag."""
    ret = grid.join(F.broadcast(stats), "asset").groupBy("id").agg(F.sum(F.col("weight") * F.col("mu")).alias("ret"))
    a, b = grid.select("id", F.col("asset").alias("a"), F.col("weight").alias("wa")), grid.select("id", F.col("asset").alias("b"), F.col("weight").alias("wb"))
    var = a.join(F.broadcast(cov), "a").join(b, ["id", "b"]).groupBy("id").agg(F.sum(F.when(F.col("a") == F.col("b"), 1.0).otherwise(2.0) * F.col("wa") * F.col("wb") * F.col("cov")).alias("var"))
    d = ret.join(var, "id").withColumn("risk", F.sqrt("var")).withColumn("sharpe", div("ret", "risk"))
    d = d.withColumn("risk_bucket", F.floor(F.col("risk") * 20).cast("long"))
    best = d.groupBy("risk_bucket").agg(F.max_by("id", F.struct(F.round("ret", 9), -F.col("id"))).alias("_b"))
    return d.join(best, "risk_bucket").withColumn("efficient", flag(F.col("id") == F.col("_b"))).drop("_b", "var")
