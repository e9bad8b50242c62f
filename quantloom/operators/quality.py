"""Data-quality rules, outliers, cleaning and reports, each in one or two passes over the rows."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.functions.exact import quantiles, unpivot
from quantloom.functions.series import div, ladder
from quantloom.operators.relational import corr_agg
from quantloom.session import materialise


def rule_counts(df: DataFrame, rules: dict) -> DataFrame:
    """(rule, violations, rows): all rules counted in one aggregation."""
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in rules.items()])
    arr = F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("violations")) for k in rules])
    return row.select("_n", F.explode(arr).alias("r")).select("r.rule", "r.violations", F.col("_n").alias("rows"))


def schema_rules(df: DataFrame, required, numeric, positive) -> DataFrame:
    """Missing columns, wrong types, nulls in required columns and non-positive values."""
    fields = {f.name: f.dataType for f in df.schema}
    rules = {}
    for c in required:
        rules[f"missing_column_{c}"] = F.lit(c not in fields)
        if c in fields:
            rules[f"null_{c}"] = F.col(c).isNull()
    for c in numeric:
        rules[f"not_numeric_{c}"] = F.lit(not isinstance(fields.get(c), T.NumericType))
    for c in positive:
        rules[f"not_positive_{c}"] = F.col(c) <= 0
    return rule_counts(df, rules).withColumn("level", ladder([(F.col("violations") == 0, "ok"), (F.col("rule").startswith("not_positive"), "warning")], "error"))


def price_consistency(df: DataFrame) -> DataFrame:
    o, h, lo, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    return rule_counts(df, {"high_below_low": h < lo, "close_outside": (c > h) | (c < lo), "open_outside": (o > h) | (o < lo), "zero_volume": v == 0, "missing_close": c.isNull()})


def fundamental_consistency(df: DataFrame) -> DataFrame:
    return rule_counts(df, {"negative_equity": F.col("equity") < 0, "extreme_margin": F.abs(div("net_income", "revenue")) > 0.5, "liabilities_above_assets": F.col("total_liabilities") > F.col("total_assets"), "zero_income": F.col("net_income") == 0})


def outliers(df: DataFrame, cols, iqr=1.5, z=3.0, mz=3.5) -> DataFrame:
    """Counts by IQR, z-score and modified z-score (exact quartiles, two-pass MAD).

    The input is counted by column and value once; quartiles, moments, deviations and the counts of
    outliers are weighted sums over that table.
    """
    long = unpivot(df, [], list(cols)).where(F.col("value").isNotNull())
    vc = materialise(long.groupBy("name", "value").agg(F.count(F.lit(1)).alias("n")), "values")
    b = quantiles(vc, ["name"], "value", [0.25, 0.5, 0.75], ["q1", "md", "q3"], weight="n")
    mean = vc.groupBy("name").agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("_m"), F.sum("n").alias("_k"))
    d = materialise(vc.join(F.broadcast(b.join(mean, "name")), "name").withColumn("_ad", F.abs(F.col("value") - F.col("md"))), "deviations")  # one row per column name
    mad = quantiles(d, ["name"], "_ad", [0.5], ["mad"], weight="n")
    spread = d.groupBy("name").agg(F.sqrt(F.try_divide(F.sum(F.col("n") * F.pow(F.col("value") - F.col("_m"), 2)), F.max("_k") - 1)).alias("_s"))
    d = d.join(F.broadcast(mad.join(spread, "name")), "name")
    w = F.col("q3") - F.col("q1")
    v = F.col("value")

    def rows(condition):
        return F.sum(F.when(condition, F.col("n")).otherwise(0))
    g = d.groupBy("name").agg(rows((v < F.col("q1") - iqr * w) | (v > F.col("q3") + iqr * w)).alias("iqr_outliers"), rows(F.abs(div(v - F.col("_m"), "_s")) > z).alias("z_outliers"),
                              rows(F.abs(div(0.6745 * (v - F.col("md")), "mad")) > mz).alias("mz_outliers"), F.sum("n").alias("n"))
    return g.withColumn("iqr_share", F.col("iqr_outliers") / F.col("n"))


def clean(df: DataFrame, cols, iqr=1.5) -> DataFrame:
    """Repeated rows and rows with an IQR outlier removed."""
    d = df.dropDuplicates()
    long = unpivot(d, [], list(cols)).where(F.col("value").isNotNull())
    b = quantiles(long, ["name"], "value", [0.25, 0.75], ["q1", "q3"])
    bounds = b.agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("q1", "q3")))).alias("_b"))  # one entry per column
    d = d.crossJoin(F.broadcast(bounds))  # one row
    keep = F.lit(True)
    for c in cols:
        q1, q3 = F.col("_b")[c]["q1"], F.col("_b")[c]["q3"]
        w = q3 - q1
        keep &= F.coalesce((F.col(c) >= q1 - iqr * w) & (F.col(c) <= q3 + iqr * w), F.lit(True))
    return d.where(keep).drop("_b")


def report(df: DataFrame, cols) -> DataFrame:
    """Per column: type, nulls, distinct values and a recommendation; ``duplicates`` counts the repeats of whole rows."""
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(f"c_{c}") for c in cols], *[F.count_distinct(c).alias(f"d_{c}") for c in cols])
    types = dict(df.dtypes)
    arr = F.array(*[F.struct(F.lit(c).alias("name"), F.lit(types[c]).alias("type"), (F.col("_n") - F.col(f"c_{c}")).alias("nulls"), F.col(f"d_{c}").alias("distinct_values")) for c in cols])
    repeats = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_k")).agg(F.coalesce(F.sum(F.col("_k") - 1), F.lit(0)).alias("duplicates"))
    d = row.select("_n", F.explode(arr).alias("r")).select("r.*", F.col("_n").alias("rows")).crossJoin(F.broadcast(repeats))  # one row
    s = div("nulls", "rows")  # NULL in an empty table
    return d.withColumns({"null_share": s, "advice": ladder([(s > 0.5, "drop column"), (s > 0.1, "interpolate"), (s > 0, "fill"), (F.col("distinct_values") == 1, "constant")], "keep")})


def completeness(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Records against the calendar dates inside each symbol's own range."""
    g = bars.groupBy("symbol").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count_distinct("date").alias("records"))
    days = calendar.select("date").distinct().agg(F.array_sort(F.collect_set("date")).alias("_d"))  # the calendar: bounded
    d = g.crossJoin(F.broadcast(days))  # one row
    n = F.size(F.filter("_d", lambda x: (x >= F.col("first_date")) & (x <= F.col("last_date"))))
    return d.withColumn("expected", n).withColumn("completeness", F.col("records") / F.col("expected") * 100).drop("_d")


def source_consistency(pair: DataFrame) -> DataFrame:
    """Common dates, correlation and mean % difference of two sources, with a class."""
    d = pair.withColumn("_p", F.abs(div(F.col("close2") - F.col("close1"), "close1")) * 100)
    g = d.groupBy("symbol").agg(F.count(F.lit(1)).alias("common"), corr_agg("close1", "close2").alias("corr"), F.avg("_p").alias("mean_diff_pct"), F.max("_p").alias("max_diff_pct"))
    m, c = F.col("mean_diff_pct"), F.col("corr")
    return g.withColumn("grade", ladder([((c > 0.999) & (m < 0.2), "excellent"), ((c > 0.99) & (m < 1), "good"), ((c > 0.95) & (m < 5), "fair")], "poor"))


def metric_table(metrics: DataFrame, thresholds: dict) -> DataFrame:
    """Metric rows with warning and failure limits and a status."""
    w = F.create_map(*[x for k, v in thresholds.items() for x in (F.lit(k), F.lit(float(v[0])))])
    f = F.create_map(*[x for k, v in thresholds.items() for x in (F.lit(k), F.lit(float(v[1])))])
    d = metrics.withColumns({"warn_at": F.try_element_at(w, F.col("metric")), "fail_at": F.try_element_at(f, F.col("metric"))})
    return d.withColumn("status", ladder([(F.col("value") > F.col("fail_at"), "fail"), (F.col("value") > F.col("warn_at"), "warning")], "pass"))

