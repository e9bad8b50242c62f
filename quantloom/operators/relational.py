"""Filters, fills, joins, aggregates, set operations and scalar features over panel tables."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.exact import quantiles, unpivot, value_positions, with_group_stats
from quantloom.functions.series import S, Series, div, flag, ladder, with_pos

OHLC = ("open", "high", "low", "close")


# --- filters and fills -----------------------------------------------------------------------
def date_range(df: DataFrame, lo, hi, date="date", **equal) -> DataFrame:
    """Equality filters and a closed date range; all of it reaches the scan."""
    cond = F.col(date).between(F.lit(lo), F.lit(hi))
    for k, v in equal.items():
        cond &= F.col(k) == v
    return df.where(cond)


def positive_prices(df: DataFrame) -> DataFrame:
    cols = [*OHLC, "volume"]
    d = df.select(*[c for c in df.columns if c not in cols], *[F.col(c).try_cast("double").alias(c) for c in cols])
    ok = F.lit(True)
    for c in OHLC:
        ok &= F.col(c) > 0
    return d.dropDuplicates().dropna(subset=cols).where(ok)


def fill_forward_backward(df: DataFrame, cols, s: Series = S) -> DataFrame:
    return df.withColumns({c: F.coalesce(s.ffill(c), s.bfill(c)) for c in cols})


def fill_interpolate(df: DataFrame, cols, s: Series = S) -> DataFrame:
    """Linear between known points by row position; ends keep the nearest earlier value, leading gaps stay."""
    d = with_pos(df, s)
    p = F.col("_pos")
    out = {}
    for c in cols:
        known = F.when(F.col(c).isNotNull(), p)
        a, b = F.last(known, True).over(s.run), F.first(known, True).over(s.frame(0, Window.unboundedFollowing))
        va, vb = s.ffill(c), s.bfill(c)
        out[c] = F.when(F.col(c).isNotNull(), F.col(c)).when(b.isNull(), va).otherwise(va + (vb - va) * div(p - a, b - a))
    return d.withColumns(out).drop("_pos")


def fill_stat(df: DataFrame, cols, how="mean", by=("symbol",)) -> DataFrame:
    if how == "zero":
        return df.fillna(0.0, subset=list(cols))
    agg = F.avg if how == "mean" else F.median
    d = with_group_stats(df, list(by), {f"_f_{c}": agg(c) for c in cols})
    return d.withColumns({c: F.coalesce(c, f"_f_{c}") for c in cols}).drop(*[f"_f_{c}" for c in cols])


def missing_strategy(df: DataFrame, cols, s: Series = S) -> DataFrame:
    """Per series and column: drop above half missing, interpolate above a tenth, else fill forward then back."""
    d = with_group_stats(df, list(s.by), {f"_m_{c}": F.avg(F.col(c).isNull().cast("double")) for c in cols})
    lin = fill_interpolate(d.withColumns({f"_l_{c}": F.col(c) for c in cols}), [f"_l_{c}" for c in cols], s)
    filled = {c: F.coalesce(s.ffill(c), s.bfill(c)) for c in cols}
    m = {c: F.col(f"_m_{c}") for c in cols}
    d = lin.withColumns({f"_f_{c}": filled[c] for c in cols})
    d = d.withColumns({c: F.when(m[c] > 0.5, F.lit(None).cast("double")).when(m[c] > 0.1, F.col(f"_l_{c}"))
                      .otherwise(F.col(f"_f_{c}")) for c in cols})
    d = d.withColumns({f"{c}_strategy": F.when(m[c] > 0.5, "drop").when(m[c] > 0.1, "interpolate").otherwise("ffill") for c in cols})
    return d.drop(*[f"{p}{c}" for c in cols for p in ("_m_", "_l_", "_f_")])


def replace_inf(df: DataFrame, cols, s: Series = S) -> DataFrame:
    """inf and NaN become missing, are filled forward, then 0."""
    clean = {c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)) for c in cols}
    return df.withColumns(clean).withColumns({c: F.coalesce(s.ffill(c), F.lit(0.0)) for c in cols})


def clip(df: DataFrame, col: str, lo: float, hi: float) -> DataFrame:
    return df.withColumn(col, F.when(F.col(col).isNotNull(), F.least(F.greatest(F.col(col), F.lit(lo)), F.lit(hi))))


def valid_ratio(df: DataFrame, cols, threshold=0.5) -> DataFrame:
    """(name, valid_ratio, keep): one pass over all columns."""
    row = df.agg(*[(F.count(c) / F.count(F.lit(1))).alias(c) for c in cols])
    return unpivot(row, [], list(cols), "name", "valid_ratio").withColumn("keep", flag(F.col("valid_ratio") >= threshold))


def variances(df: DataFrame, cols, threshold=0.0) -> DataFrame:
    row = df.agg(*[F.var_samp(c).alias(c) for c in cols])
    return unpivot(row, [], list(cols), "name", "variance").withColumn("keep", flag(F.col("variance") > threshold))


# --- joins -----------------------------------------------------------------------------------
def inner_align(a: DataFrame, b: DataFrame, keys=("symbol", "date")) -> DataFrame:
    return a.join(b, list(keys)).dropna()


def asof_ffill(left: DataFrame, right: DataFrame, values, by=("symbol",), order="date") -> DataFrame:
    """Latest right row at or before each left row (one shuffle: union, running last, keep left rows)."""
    lcols = [c for c in left.columns if c not in (*by, order)]
    lft = left.withColumns({f"_r_{v}": F.lit(None).cast("double") for v in values}).withColumn("_side", F.lit(1))
    rgt = right.select(*by, order, *[F.col(v).cast("double").alias(f"_r_{v}") for v in values]).withColumn("_side", F.lit(0))
    both = lft.unionByName(rgt, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(order, "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumns({f"_v_{v}": F.last(f"_r_{v}", True).over(w) for v in values}).where(F.col("_side") == 1)
    return out.select(*by, order, *lcols, *[F.col(f"_v_{v}").alias(v) for v in values])


def latest_on_or_before(df: DataFrame, day, value, by=("symbol",), date="date") -> DataFrame:
    return df.where(F.col(date) <= F.lit(day)).groupBy(*by).agg(
        F.max_by(value, date).alias(value), F.max(date).alias("as_of"))


def reindex_fill(df: DataFrame, keys_df: DataFrame, keys, values, fill=0.0) -> DataFrame:
    return keys_df.join(df, list(keys), "left").withColumns({v: F.coalesce(v, F.lit(fill)) for v in values})


def column_pairs(df: DataFrame, cols, by=()) -> DataFrame:
    """Correlation and covariance of every column pair, from one aggregation (cols is a short, fixed list)."""
    cols = sorted(cols)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    aggs = []
    for a, b in pairs:
        x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
        aggs.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count(x).alias("n"),
                             F.covar_samp(x, y).alias("cov"),
                             div(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y)).alias("corr")))
    return df.groupBy(*by).agg(F.array(*aggs).alias("_p")).select(*by, F.explode("_p").alias("_q")).select(*by, "_q.*")


def supply_links(symbols: DataFrame, n: int = 3) -> DataFrame:
    """Symbol to its n suppliers, the next symbols in numeric order (wrapping); a stand-in mapping."""
    total = symbols.agg(F.max("symbol").alias("_m"), F.min("symbol").alias("_a"))
    size = F.col("_m") - F.col("_a") + 1
    d = symbols.crossJoin(F.broadcast(total))  # one row
    return d.select("symbol", F.explode(F.array(*[F.pmod(F.col("symbol") - F.col("_a") + k, size) + F.col("_a")
                                                  for k in range(1, n + 1)])).alias("supplier"))


# --- aggregates ------------------------------------------------------------------------------
def g1(x) -> Column:
    n = F.count(x)
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0)))


def g2(x) -> Column:
    n = F.count(x)
    return F.when(n > 3, div(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def describe_columns(df: DataFrame, cols, by=()) -> DataFrame:
    """Long statistics per column."""
    long = unpivot(df, list(by), list(cols))
    v = F.col("value")
    return long.groupBy(*by, "name").agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"),
        F.max(v).alias("max"), g1(v).alias("skew"), g2(v).alias("kurt"),
        F.avg(v.isNull().cast("double")).alias("null_ratio"))


def corr_agg(x, y) -> Column:
    """Pearson correlation as an aggregate, NULL when a side is constant."""
    x, y = F.col(x) if isinstance(x, str) else x, F.col(y) if isinstance(y, str) else y
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return div(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def mean_ranks(df: DataFrame, by, cols) -> DataFrame:
    """Average-tie ranks inside a bounded group (one series): plain windows."""
    out = {}
    for c in cols:
        r = F.rank().over(Window.partitionBy(*by).orderBy(F.col(c).asc_nulls_last()))
        ties = F.count(F.lit(1)).over(Window.partitionBy(*by, c))
        out[f"{c}_rank"] = F.when(F.col(c).isNotNull(), r + (ties - 1) / 2)
    return df.withColumns(out)


def spearman(df: DataFrame, x: str, y: str, by=("symbol",)) -> DataFrame:
    d = mean_ranks(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), by, [x, y])
    return d.groupBy(*by).agg(corr_agg(f"{x}_rank", f"{y}_rank").alias("spearman"), F.count(F.lit(1)).alias("n"))


def kendall(df: DataFrame, x: str, y: str, by=("symbol",)) -> DataFrame:
    """Kendall tau-b per series by counting inversions, n log n instead of all pairs.

    Two ranks of y first differ in one bit; at that bit the rows that share the higher bits are walked in the order of x, and
    each row meets the running number of those with the other bit.  Rows equal in x or in y count in neither direction.
    """
    by = list(by)
    series = Window.partitionBy(*by)
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *by, F.dense_rank().over(series.orderBy(x)).alias("_x"), (F.dense_rank().over(series.orderBy(y)) - 1).alias("_y"))
    d = d.withColumns({"_top": F.max("_y").over(series), "_tx": F.count(F.lit(1)).over(Window.partitionBy(*by, "_x")) - 1, "_ty": F.count(F.lit(1)).over(Window.partitionBy(*by, "_y")) - 1})
    d = d.withColumn("_level", F.explode(F.sequence(F.lit(0), F.length(F.bin("_top")) - 1)))
    d = d.withColumns({"_high": F.expr("shiftright(_y, _level + 1)"), "_bit": F.expr("shiftright(_y, _level) & 1")})
    before = Window.partitionBy(*by, "_level", "_high").orderBy("_x").rangeBetween(Window.unboundedPreceding, -1)
    d = d.withColumns({"_ones": F.coalesce(F.sum("_bit").over(before), F.lit(0)), "_rows": F.count(F.lit(1)).over(before)})
    first = F.col("_level") == 0  # every row once
    g = d.groupBy(*by).agg(F.sum(F.when(F.col("_bit") == 1, F.col("_rows") - F.col("_ones")).otherwise(-F.col("_ones"))).alias("_s"), F.count_if(first).alias("n"),
                           F.sum(F.when(first, F.col("_tx"))).alias("_tx"), F.sum(F.when(first, F.col("_ty"))).alias("_ty"))
    pairs = F.col("n") * (F.col("n") - 1)
    untied = [(pairs - F.col(t)).cast("double") / 2 for t in ("_tx", "_ty")]
    return g.select(*by, div(F.col("_s"), F.sqrt(untied[0] * untied[1])).alias("kendall"), "n")


def iqr_bounds(df: DataFrame, col: str, by=("symbol",)) -> DataFrame:
    return quantiles(df, list(by), col, [0.25, 0.5, 0.75], ["q1", "q2", "q3"])


def concentration(df: DataFrame, value="market_value", by=("portfolio",)) -> DataFrame:
    """Herfindahl index, effective number and top-5 share of absolute weights."""
    t = with_group_stats(df, list(by), {"_t": F.sum(F.abs(value))}).withColumn("_w", div(F.abs(value), "_t"))
    return t.groupBy(*by).agg(F.sum(F.col("_w") * F.col("_w")).alias("hhi"), F.max("_w").alias("largest"),
                              F.count(F.lit(1)).alias("n")).withColumn("effective_n", div(F.lit(1.0), "hhi")).join(
        top_n(t, "_w", 5, list(by), tie=["symbol"]).groupBy(*by).agg(F.sum("_w").alias("top5")), list(by), "left")


# --- top-k -----------------------------------------------------------------------------------
def top_n(df: DataFrame, score: str, n: int, by=(), tie=(), desc=True, salt=16) -> DataFrame:
    """The n best rows per group.

    Spark limits every map task to its own best n per window group before the shuffle; the salted first
    step spreads what is left of a hot group, and the last step sees at most n x salt rows of it.
    """
    key = F.col(score).desc_nulls_last() if desc else F.col(score).asc_nulls_last()
    if not by:
        return df.orderBy(key, *tie).limit(n)
    order = [key, *tie]
    d = df.withColumn("_salt", F.pmod(F.xxhash64(*(tie or df.columns)), F.lit(salt)))
    w1 = Window.partitionBy(*by, "_salt").orderBy(*order)
    d = d.withColumn("_rn", F.row_number().over(w1)).where(F.col("_rn") <= n)
    w2 = Window.partitionBy(*by).orderBy(*order)
    return d.withColumn("_rn", F.row_number().over(w2)).where(F.col("_rn") <= n).drop("_rn", "_salt")


def top_fraction(df: DataFrame, score: str, share: float, by=("date",), keys=("symbol", "date")) -> DataFrame:
    """Rows among the best floor(n * share) (at least one) of their group; ties by value are kept together."""
    j = df.join(value_positions(df, list(by), score).withColumnRenamed("total", "_n"), [*by, score])
    above = F.col("_n") - F.col("before") - F.col("n")
    return j.where(above < F.greatest(F.floor(F.col("_n") * F.lit(share)), F.lit(1))).select(*df.columns)


# --- windows ---------------------------------------------------------------------------------
def rank_by_date(df: DataFrame, score: str, keys=("symbol", "date"), by=("date",)) -> DataFrame:
    from quantloom.functions.exact import with_ranks
    return with_ranks(df.withColumn("_neg", -F.col(score)), list(keys), list(by), {"position": ("_neg", "row")}).drop("_neg")


def bucketize(df: DataFrame, col: str, n: int, by=(), out="bucket") -> DataFrame:
    """Quantile buckets 1..n by exact rank; equal values share a bucket."""
    vp = value_positions(df, list(by), col)
    b = vp.select(*by, col, (F.floor(F.col("before") * n / F.col("total")) + 1).cast("int").alias(out))
    return df.join(b, [*by, col], "left")


# --- scalar features -------------------------------------------------------------------------
def calendar_fields(df: DataFrame, date="date") -> DataFrame:
    d = F.col(date)
    return df.withColumns({"year": F.year(d), "month": F.month(d), "day": F.dayofmonth(d), "dayofweek": F.weekday(d),
                           "dayofyear": F.dayofyear(d), "quarter": F.quarter(d), "weekofyear": F.weekofyear(d)})


def cyclic_encoding(df: DataFrame, date="date") -> DataFrame:
    tau = 2 * math.pi
    parts = {"month": (F.month(date), 12), "day": (F.dayofmonth(date), 31), "weekday": (F.weekday(date), 7)}
    return df.withColumns({f"{k}_{f}": (F.sin if f == "sin" else F.cos)(F.lit(tau) * v / n)
                           for k, (v, n) in parts.items() for f in ("sin", "cos")})


def period_edges(df: DataFrame, date="date") -> DataFrame:
    d = F.col(date)
    end = F.last_day(d) == d
    return df.withColumns({
        "is_month_start": flag(F.dayofmonth(d) == 1), "is_month_end": flag(end),
        "is_quarter_start": flag((F.dayofmonth(d) == 1) & F.month(d).isin(1, 4, 7, 10)),
        "is_quarter_end": flag(end & F.month(d).isin(3, 6, 9, 12))})


def easter(year: Column) -> Column:
    """Gregorian Easter Sunday (anonymous computus) as a date column."""
    a, b, c = year % 19, F.floor(year / 100), year % 100
    d, e = F.floor(b / 4), b % 4
    g = F.floor((8 * b + 13) / 25)
    h = (19 * a + b - d - g + 15) % 30
    i, k = F.floor(c / 4), c % 4
    ll = (32 + 2 * e + 2 * i - h - k) % 7
    m = F.floor((a + 11 * h + 19 * ll) / 433)
    mo = F.floor((h + ll - 7 * m + 90) / 25)
    dy = (h + ll - 7 * m + 33 * mo + 19) % 32
    return F.make_date(year.cast("int"), mo.cast("int"), dy.cast("int"))


def nth_weekday(d: Column, month: int, weekday: int, n: int) -> Column:
    """True on the n-th given weekday (Monday 0) of a month."""
    return (F.month(d) == month) & (F.weekday(d) == weekday) & (F.ceil(F.dayofmonth(d) / 7) == n)


def trading_calendar(days: DataFrame, date="date") -> DataFrame:
    """US market holidays, early closes and trading days for a table of dates."""
    d = F.col(date)

    def observed(month, day):
        # Saturday holidays move to Friday, Sunday ones to Monday
        base = F.make_date(F.year(d), F.lit(month), F.lit(day))
        nxt = F.make_date(F.year(d) + 1, F.lit(month), F.lit(day))

        def moved(b):
            return F.when(F.weekday(b) == 5, F.date_sub(b, 1)).when(F.weekday(b) == 6, F.date_add(b, 1)).otherwise(b)
        return (d == moved(base)) | (d == moved(nxt))

    def last_monday(month):
        return (F.month(d) == month) & (F.weekday(d) == 0) & (F.dayofmonth(d) > 24)
    holiday = (observed(1, 1) | nth_weekday(d, 1, 0, 3) | nth_weekday(d, 2, 0, 3)
               | (d == F.date_sub(easter(F.year(d)), 2)) | last_monday(5)
               | (observed(6, 19) & (F.year(d) >= 2021)) | observed(7, 4) | nth_weekday(d, 9, 0, 1)
               | nth_weekday(d, 11, 3, 4) | observed(12, 25))
    out = df_h = days.withColumn("is_holiday", flag(holiday))
    weekday = F.weekday(d) < 5
    early = nth_weekday(F.date_sub(d, 1), 11, 3, 4) | ((F.month(d) == 12) & (F.dayofmonth(d) == 24)) | (
        (F.month(d) == 7) & (F.dayofmonth(d) == 3))
    out = df_h.withColumn("is_trading_day", flag(weekday & (F.col("is_holiday") == 0)))
    return out.withColumn("is_early_close", flag(early & (F.col("is_trading_day") == 1)))


def session_label(df: DataFrame, ts="ts", zone="America/New_York") -> DataFrame:
    """Exchange-local hour and session of a UTC time."""
    d = df.withColumn("_t", F.from_utc_timestamp(ts, zone))
    m = F.hour("_t") * 60 + F.minute("_t")
    s = ladder([(F.weekday("_t") >= 5, "closed"), ((m >= 240) & (m < 570), "premarket"),
                ((m >= 570) & (m < 960), "regular"), ((m >= 960) & (m < 1200), "afterhours")], "closed")
    return d.withColumns({"local_minute": m, "session": s}).drop("_t")


def row_stats(df: DataFrame, cols) -> DataFrame:
    xs = [F.col(c) for c in cols]
    n = len(cols)
    total = sum(xs[1:], xs[0])
    mean = total / n
    ss = sum((F.pow(x - mean, F.lit(2)) for x in xs[1:]), F.pow(xs[0] - mean, F.lit(2)))
    return df.withColumns({"row_sum": total, "row_mean": mean, "row_std": F.sqrt(ss / (n - 1)),
                           "row_max": F.greatest(*xs), "row_min": F.least(*xs),
                           "row_max_min_ratio": div(F.greatest(*xs), F.least(*xs) + 1e-8)})


def label_encode(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Dense integer codes in sorted order of the values.

    The distinct values are range-sorted; the sorted partitions are pinned by a checkpoint, numbered
    inside each partition and shifted by the partition totals.
    """
    from quantloom.session import checkpoint
    values = df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col)
    pinned = checkpoint(values.withColumn("_p", F.spark_partition_id()))
    totals = pinned.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    off = totals.select("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    codes = pinned.join(off, "_p").select(col, (
        F.col("_off") + F.row_number().over(Window.partitionBy("_p").orderBy(col)) - 1).alias(out or f"{col}_code"))
    return df.join(codes, col, "left")


def equal_width_bins(x: Column, lo: Column, hi: Column, n: int) -> Column:
    """Bins 0..n-1, right edges closed, the lowest value in bin 0."""
    k = F.ceil(div((x - lo) * n, hi - lo)) - 1
    return F.when(hi > lo, F.greatest(F.least(k, F.lit(n - 1)), F.lit(0)))
