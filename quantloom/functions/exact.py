"""Exact ranks and quantiles over groups that may be larger than one task.

A plain window over a date, or an exact ``percentile``, puts a whole group in one task.  Here equal
values are counted first (map-side combined), the distinct values are cut into value buckets by
sketch splits, and only bucket totals, at most ``buckets`` per group, are accumulated in one place.
The sketch decides where the cuts lie, never the result: every rank and quantile is exact.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.session import materialise


def attach(df: DataFrame, table: DataFrame, by: list[str], on: list[str] | None = None) -> DataFrame:
    """Join a per-group table; adaptive execution broadcasts it when it turns out small.

    Without keys the table is a single row.
    """
    on = by if on is None else on
    return df.join(table, on) if on else df.crossJoin(F.broadcast(table))


def _bucket_count(spark) -> int:
    # the buckets follow the parallelism of the session, which follows the data
    return max(16, min(1000, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def below(splits: str, value: str, k: int, rows: DataFrame, out: str) -> DataFrame:
    """The rows with the number ``out`` of the at most ``k`` ascending splits that lie below their value.

    A binary search, one projection per halving: compiled code, where a lambda over the array is interpreted
    element by element, and log k comparisons a row.
    """
    d = rows.withColumn(out, F.lit(0))
    for step in (1 << i for i in reversed(range(k.bit_length()))):
        at = F.get(splits, F.col(out) + (step - 1))  # NULL beyond the end
        d = d.withColumn(out, F.when(at < F.col(value), F.col(out) + step).otherwise(F.col(out)))
    return d


def bucketed(vc: DataFrame, by: list[str], value: str, k: int) -> DataFrame:
    """The rows with the number ``_b`` of their value bucket.

    The splits are written once: a sketch depends on the order in which its parts arrive, so a plan that computed
    it twice could cut one group in two ways.
    """
    splits = vc.groupBy(*by).agg(F.percentile_approx(value, [i / k for i in range(1, k)], max(1000, 4 * k)).alias("_splits"))
    splits = materialise(splits, "splits")
    return below("_splits", value, k - 1, attach(vc, splits, by), "_b").drop("_splits")


def bucket_offsets(b: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """(by, _b, _t_<name>, _off_<name>, all_<name>): total of each bucket, of the buckets before it, and of the group."""
    totals = b.groupBy(*by, "_b").agg(*[F.sum(n).alias(f"_t_{n}") for n in names])
    group = Window.partitionBy(*by)
    order = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumns({**{f"_off_{n}": F.coalesce(F.sum(f"_t_{n}").over(order), F.lit(0)) for n in names},
                               **{f"all_{n}": F.sum(f"_t_{n}").over(group) for n in names}})


def cumulative_sums(df: DataFrame, by: list[str], value: str, cols: dict[str, Column], buckets: int | None = None) -> DataFrame:
    """(by, value, sums, cum_<name>, all_<name>): per distinct value the sum of each column, its running total
    up to and including that value, and the total of the group.

    The sums per distinct value are written once; splits, bucket totals and running totals all read them there.
    """
    names = list(cols)
    k = buckets or _bucket_count(df.sparkSession)
    vc = materialise(df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(*[F.sum(c).alias(n) for n, c in cols.items()]), "counts")
    b = bucketed(vc, by, value, k)
    offsets = bucket_offsets(b, by, names).drop(*[f"_t_{n}" for n in names])
    inner = Window.partitionBy(*by, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return (attach(b, offsets, by, [*by, "_b"]).withColumns({f"cum_{n}": F.col(f"_off_{n}") + F.sum(n).over(inner) for n in names})
            .select(*by, value, *names, *[f"cum_{n}" for n in names], *[f"all_{n}" for n in names]))


def value_positions(df: DataFrame, by: list[str], value: str, weight: str | None = None) -> DataFrame:
    """(by, value, n, before, total): count of each distinct value, of the smaller rows, and of the group."""
    c = cumulative_sums(df, by, value, {"n": F.col(weight) if weight else F.lit(1)})
    return c.select(*by, value, "n", (F.col("cum_n") - F.col("n")).alias("before"), F.col("all_n").alias("total"))


def two_sample_ks(df: DataFrame, by: list[str], value: str, first: Column, buckets: int = 2000) -> DataFrame:
    """Kolmogorov-Smirnov distance between the rows where ``first`` holds and the rest of each group.

    The rows are read three times, for splits, bucket totals and the buckets left open, so give a written table.  The totals
    give the distance at the end of each bucket and bound it inside; only the rows of buckets that may hold a larger one are
    shuffled and ordered.  There are more buckets than tasks: the fewer rows in a bucket, the tighter its bound.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, value, first.cast("long").alias("a"), (~first).cast("long").alias("b"))
    b = bucketed(rows, by, value, buckets)

    def gap(x: Column, y: Column) -> Column:
        return F.try_divide(x, F.col("all_a")) - F.try_divide(y, F.col("all_b"))
    off, end = [F.col(f"_off_{n}") for n in "ab"], [F.col(f"_off_{n}") + F.col(f"_t_{n}") for n in "ab"]
    ends = bucket_offsets(b, by, ["a", "b"]).withColumns({"_d": F.abs(gap(*end)), "_reach": F.greatest(gap(end[0], off[1]), -gap(off[0], end[1]))})
    ends = ends.withColumn("_open", F.col("_reach") > F.max("_d").over(Window.partitionBy(*by)))
    ends = materialise(ends.drop("_t_a", "_t_b", "_reach"), "ends")
    kept = ["_off_a", "_off_b", "all_a", "all_b"]
    inside = attach(b, ends.where("_open").select(*by, "_b", *kept), by, [*by, "_b"])
    inside = inside.groupBy(*by, "_b", value).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), *[F.first(c).alias(c) for c in kept])
    inner = Window.partitionBy(*by, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("_d", F.abs(gap(off[0] + F.sum("a").over(inner), off[1] + F.sum("b").over(inner))))
    return ends.select(*by, "_d").unionByName(inside.select(*by, "_d")).groupBy(*by).agg(F.max("_d").alias("ks"))


def quantiles(df: DataFrame, by: list[str], value: str, probs: list[float], names: list[str], weight: str | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group; ``weight`` counts how often a row stands.

    The values are written once, narrow and unsorted.  Bucket totals tell which buckets hold the wanted positions; only
    the rows of these are shuffled and ordered.
    """
    rows = materialise(df.where(F.col(value).isNotNull()).select(*by, value, (F.col(weight) if weight else F.lit(1)).cast("long").alias("n")), "values")
    b = bucketed(rows, by, value, _bucket_count(df.sparkSession))
    offsets = bucket_offsets(b, by, ["n"]).withColumnsRenamed({"_off_n": "_off", "_t_n": "_t", "all_n": "total"})
    wanted = [(F.col("total") - 1) * F.lit(float(p)) for p in probs]

    def holds(pos: Column) -> Column:
        return (F.col("_off") <= pos) & (pos < F.col("_off") + F.col("_t"))
    hit = F.lit(False)
    for h in wanted:
        hit = hit | holds(F.floor(h)) | holds(F.ceil(h))
    inner = Window.partitionBy(*by, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    j = attach(b, offsets.where(hit).drop("_t"), by, [*by, "_b"]).groupBy(*by, "_b", value).agg(F.sum("n").alias("n"), F.first("_off").alias("_off"), F.first("total").alias("total"))
    j = j.withColumn("before", F.col("_off") + F.sum("n").over(inner) - F.col("n"))

    def at(pos: Column) -> Column:
        return F.max(F.when((F.col("before") <= pos) & (pos < F.col("before") + F.col("n")), F.col(value)))

    aggs, out = [], []
    for i, (h, name) in enumerate(zip(wanted, names)):
        aggs += [at(F.floor(h)).alias(f"_lo{i}"), at(F.ceil(h)).alias(f"_hi{i}"),
                 F.max(h - F.floor(h)).alias(f"_f{i}")]
        out.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}")).alias(name))
    return j.groupBy(*by).agg(*aggs).select(*by, *out)


def unpivot(df: DataFrame, keys: list[str], cols: list[str], name="name", value="value") -> DataFrame:
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(keys, cols, name, value)


def ranks(df: DataFrame, keys: list[str], by: list[str], cols: dict[str, tuple[str, str]]) -> DataFrame:
    """Ranks of several columns inside ``by`` groups, in one pass over the long form.

    ``cols`` maps output name -> (input column, kind); kind is ``min`` (percent rank, ties share the
    lowest), ``avg`` (percent rank, ties share the mean), ``row`` (1-based lowest rank),
    ``mean_row`` (1-based mean rank) or ``count`` (non-null values).  Returns keys + outputs.
    """
    inputs = sorted({c for c, _ in cols.values()})
    long = unpivot(df, [*keys, *[b for b in by if b not in keys]], inputs).where(F.col("value").isNotNull())
    g = [*by, "name"]
    # the value leads the join keys: it tells the rows apart, so the sort seldom looks at the names behind it
    j = long.join(value_positions(long, g, "value").withColumnRenamed("total", "_n"), ["value", *g])
    kinds = {
        "min": (F.col("before") + 1) / F.col("_n"),
        "avg": (F.col("before") + (F.col("n") + 1) / 2) / F.col("_n"),
        "row": (F.col("before") + 1).cast("double"),
        "mean_row": F.col("before") + (F.col("n") + 1) / 2,
        "count": F.col("_n").cast("double"),
    }
    return j.groupBy(*keys).agg(*[
        F.max(F.when(F.col("name") == c, kinds[k])).alias(out) for out, (c, k) in cols.items()])


def with_ranks(df: DataFrame, keys: list[str], by: list[str], cols: dict[str, tuple[str, str]]) -> DataFrame:
    """The rows with their ranks; the input is computed once and then read three times."""
    df = materialise(df, "ranked")
    return df.join(ranks(df, keys, by, cols), keys, "left")


def sorted_ranks(df: DataFrame, by: list[str], cols: dict[str, tuple[str, str]]) -> DataFrame:
    """The rows with their ranks, as ``with_ranks``, by a sort per column of whole groups.

    The rows are moved once, all columns together, and nothing is written; the long form of ``with_ranks`` writes and moves every value
    several times.  A group is sorted in one task, which spills what it cannot hold, so this is for groups that are many and of like size,
    such as the dates of a panel; a group with most of the rows wants ``with_ranks``.
    """
    group = Window.partitionBy(*by)
    out = {}
    for name, (c, kind) in cols.items():
        x = F.col(c)
        order = group.orderBy(x.asc_nulls_last())
        least, total = F.rank().over(order), F.count(x).over(group)
        mean = (least + F.count(x).over(order)) / 2  # the first and the last place of the equal values
        kinds = {"min": least / total, "avg": mean / total, "row": least.cast("double"), "mean_row": mean}
        out[name] = F.when(x.isNotNull(), kinds[kind])
    return df.withColumns(out)


def with_group_stats(df: DataFrame, by: list[str], aggs: dict[str, Column], few: bool = False) -> DataFrame:
    """Join plain group aggregates back to the rows (partial aggregation, no window over the group).

    ``few`` is for keys of a handful of values: the aggregates are written first, so that their size is known when the join is
    planned and the rows stay where they are.  Adaptive execution learns it too late: the rows are then shuffled already,
    and as most partitions are empty it keeps the sort join, with one task per group.
    """
    stats = df.groupBy(*by).agg(*[a.alias(k) for k, a in aggs.items()])
    stats = materialise(stats, "stats") if few and by else stats
    return df.join(stats, by, "left") if by else df.crossJoin(F.broadcast(stats))  # one row
