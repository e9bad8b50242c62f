"""Column builders for ordered series (one series per ``by`` key, ordered by ``order``).

Rules shared by every builder:
* a rolling value is NULL until its window holds ``min_periods`` (default ``n``) non-null values;
* ``std``/``var``/``cov`` use ddof 1, the ``*0`` variants ddof 0; skew and kurt are bias corrected;
* division by zero is NULL.

All frames share one (by, order) specification, so Spark shuffles and sorts once and runs the
frames as consecutive Window nodes.  A series is bounded by its calendar: bars are unique per
(symbol, date), so a partition holds at most one row per bar date, however hot the symbol is in
the source rows.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def div(a, b) -> Column:
    """a / b, NULL where b is zero."""
    return F.try_divide(col(a), col(b))


def flag(cond: Column) -> Column:
    """0/1 with NULL conditions counted as 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def lit_null() -> Column:
    return F.lit(None).cast("double")


@dataclass(frozen=True)
class Series:
    by: tuple = ("symbol",)
    order: tuple = ("date",)

    @property
    def w(self):
        return Window.partitionBy(*self.by).orderBy(*self.order)

    def frame(self, lo, hi=0):
        return self.w.rowsBetween(lo, hi)

    def past(self, n):
        return self.frame(-(n - 1), 0)

    @property
    def run(self):
        return self.frame(Window.unboundedPreceding, 0)

    @property
    def whole(self):
        return Window.partitionBy(*self.by)

    # --- guarded frames -------------------------------------------------------------------
    def over(self, agg: Column, x, n: int, min_periods: int | None = None, lo=None, hi=0) -> Column:
        """``agg`` over the last n rows (or rows lo..hi) when enough non-null x are present."""
        f = self.frame(-(n - 1) if lo is None else lo, hi)
        need = n if min_periods is None else min_periods
        return F.when(F.count(col(x)).over(f) >= need, agg.over(f))

    def mean(self, x, n, min_periods=None, lo=None, hi=0):
        return self.over(F.avg(col(x)), x, n, min_periods, lo, hi)

    def sum(self, x, n, min_periods=None, lo=None, hi=0):
        return self.over(F.sum(col(x)), x, n, min_periods, lo, hi)

    def std(self, x, n, min_periods=None, lo=None, hi=0):
        return self.over(F.stddev_samp(col(x)), x, n, min_periods, lo, hi)

    def std0(self, x, n, lo=None, hi=0):
        return self.over(F.stddev_pop(col(x)), x, n, None, lo, hi)

    def var(self, x, n, lo=None, hi=0):
        return self.over(F.var_samp(col(x)), x, n, None, lo, hi)

    def max(self, x, n, min_periods=None, lo=None, hi=0):
        return self.over(F.max(col(x)), x, n, min_periods, lo, hi)

    def min(self, x, n, min_periods=None, lo=None, hi=0):
        return self.over(F.min(col(x)), x, n, min_periods, lo, hi)

    def quantile(self, x, n, q, lo=None, hi=0):
        return self.over(F.percentile(col(x), F.lit(q)), x, n, None, lo, hi)

    def median(self, x, n, lo=None, hi=0):
        return self.quantile(x, n, 0.5, lo, hi)

    def skew(self, x, n):
        return self.over(F.skewness(col(x)), x, n) * ((n * (n - 1)) ** 0.5 / (n - 2))

    def kurt(self, x, n):
        g2 = self.over(F.kurtosis(col(x)), x, n)
        return (g2 * (n + 1) + 6.0) * ((n - 1) / ((n - 2) * (n - 3)))

    def _pairs(self, x, y):
        """x and y with a row's value dropped when its partner is missing."""
        x, y = col(x), col(y)
        return F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)

    def corr(self, x, y, n, min_periods=None, lo=None, hi=0):
        x, y = self._pairs(x, y)
        f = self.frame(-(n - 1) if lo is None else lo, hi)
        need = n if min_periods is None else min_periods
        c = div(F.covar_samp(x, y).over(f), F.stddev_samp(x).over(f) * F.stddev_samp(y).over(f))
        return F.when(F.count(x).over(f) >= need, c)

    def cov(self, x, y, n):
        x, y = self._pairs(x, y)
        return self.over(F.covar_samp(x, y), x, n)

    def beta(self, y, x, n):
        """Slope of y on x: cov(y, x) / var(x), ddof 1 on both."""
        y, x = self._pairs(y, x)
        f = self.past(n)
        return F.when(F.count(x).over(f) >= n, div(F.covar_samp(y, x).over(f), F.var_samp(x).over(f)))

    def slope(self, x, n, pos="_pos"):
        """OLS slope of x on its position in the window; needs a row position column."""
        return self.over(F.regr_slope(col(x), F.col(pos)), x, n)

    # --- shifts and running values --------------------------------------------------------
    def lag(self, x, n=1):
        return F.lag(col(x), n).over(self.w)

    def lead(self, x, n=1):
        return F.lead(col(x), n).over(self.w)

    def diff(self, x, n=1):
        return col(x) - self.lag(x, n)

    def pct(self, x, n=1):
        return div(x, self.lag(x, n)) - 1

    def pos(self):
        return F.row_number().over(self.w)

    def cumsum(self, x):
        return F.sum(col(x)).over(self.run)

    def cummax(self, x):
        return F.max(col(x)).over(self.run)

    def cummin(self, x):
        return F.min(col(x)).over(self.run)

    def cumprod(self, x):
        return F.product(col(x)).over(self.run)

    def ffill(self, x):
        return F.last(col(x), ignorenulls=True).over(self.run)

    def bfill(self, x):
        return F.first(col(x), ignorenulls=True).over(self.frame(0, Window.unboundedFollowing))

    def last_of(self, x):
        """Value of x on the last row of the series."""
        return F.max_by(col(x), F.struct(*self.order)).over(self.whole)

    def is_last(self):
        """True on the last row of the series."""
        return F.lead(F.lit(1)).over(self.w).isNull()

    # --- ranks inside a window ------------------------------------------------------------
    def rank_pct(self, x, n):
        """Percentile rank (average ties) of the current value in its window of n."""
        f = self.past(n)
        arr, cur = F.collect_list(col(x)).over(f), col(x)
        lt = F.size(F.filter(arr, lambda v: v < cur))
        eq = F.size(F.filter(arr, lambda v: v == cur))
        return F.when((F.count(col(x)).over(f) >= n) & cur.isNotNull(), (lt + (eq + 1) / 2) / F.size(arr))

    def rank_of(self, x):
        """Percentile rank (average ties) of the value among all values of its series."""
        x = col(x)
        w = self.whole.orderBy(x.asc_nulls_last())
        # the first and the last place of the equal values
        return F.when(x.isNotNull(), (F.rank().over(w) + F.count(x).over(w)) / 2 / F.count(x).over(self.whole))

    def score_pct(self, x, n):
        """Share of the earlier n-1 values below the current one, ties counted half."""
        f = self.frame(-(n - 1), -1)
        arr, cur = F.collect_list(col(x)).over(f), col(x)
        lt = F.size(F.filter(arr, lambda v: v < cur))
        le = F.size(F.filter(arr, lambda v: v <= cur))
        return F.when((F.count(col(x)).over(f) >= n - 1) & cur.isNotNull(), (lt + le) / 2 / F.size(arr))

    # --- exponential means ----------------------------------------------------------------
    def ewm_cov(self, df: DataFrame, x: str, y: str, alpha: float) -> DataFrame:
        """One row per series: exponentially weighted covariance at its end, bias corrected.

        Weights are (1 - alpha)^age with ages counted in rows, also those that lack x or y; such rows have no weight themselves.
        """
        both = col(x).isNotNull() & col(y).isNotNull()
        age = F.count(F.lit(1)).over(self.whole) - self.pos()
        d = df.withColumn("_w", F.when(both, F.pow(F.lit(1.0 - alpha), age)))
        w, a, b = F.col("_w"), col(x), col(y)
        cov = div(F.sum(w * a * b) - div(F.sum(w * a) * F.sum(w * b), F.sum(w)), F.sum(w) - div(F.sum(w * w), F.sum(w)))
        return d.where(both).groupBy(*self.by).agg(cov.alias("ewm_cov"))

    def ewm(self, df: DataFrame, outputs: dict) -> DataFrame:
        """Add exponential means: ``outputs`` maps a new name to (column, alpha, adjust).

        With q = 1 - alpha and g rows since the last value, the adjusted mean is a quotient of two
        recursions N = q^g N' + x and D = q^g D' + 1, the other one is y = (q^g y' + alpha x) / (q^g + alpha).
        Decay runs on row positions, so a NULL ages what came before it; rows without a value carry the mean
        on, rows before the first value have none.

        Every recursion has the form y = a y' + c, so it needs no sequential fold.  E is the running sum of
        -log a; rows are cut in blocks of ``SPAN`` of E.  Inside a block the sum of c e^E is a running
        sum, to which the value at the end of the previous block is added, decayed.  What lies two blocks back
        has no weight in double precision, and e^SPAN stays far from overflow.
        """
        src = {name: f"_e{i}" for i, name in enumerate(outputs)}
        d = df
        for name, (x, alpha, adjust) in outputs.items():
            p, q = src[name], 1.0 - alpha
            c = lambda k, p=p: F.col(f"{p}{k}")
            d = d.withColumns({f"{p}x": col(x).cast("double"), f"{p}p": self.pos()})
            has = c("x").isNotNull()
            before = F.last(F.when(has, c("p")), ignorenulls=True).over(self.frame(Window.unboundedPreceding, -1))
            d = d.withColumn(f"{p}g", F.when(has, c("p") - before))
            kept = F.pow(F.lit(q), c("g"))  # weight of what came before, NULL on the first value
            # with g = 1 the sum of both weights is one; it is written out, so that it is exactly one
            both = F.when(c("g") == 1, F.lit(1.0)).otherwise(kept + alpha)
            step = c("g") * -math.log(q) + (0.0 if adjust else F.log(both))
            d = d.withColumns({f"{p}c": c("x") if adjust else F.coalesce(c("x") * alpha / both, c("x")), f"{p}d": F.when(has, F.lit(1.0))})
            d, total, rows = self._decayed(d, p, has, step, ("c", "d") if adjust else ("c",))
            # the first value is the mean itself, free of rounding
            value = F.when(c("g").isNull(), c("x")).otherwise(total["c"] / total["d"] if adjust else total["c"])
            d = d.withColumn(name, F.last(F.when(has, value), ignorenulls=True).over(rows))
            d = d.drop(*[f"{p}{k}" for k in ("x", "p", "g", "l", "c", "d", "b", "sc", "sd", "t")])
        return d

    def affine(self, df: DataFrame, name: str, keep: Column, add: Column) -> DataFrame:
        """Add the solution of y = keep y' + add with a factor of its own per row, keep in 0 .. 1; the first row has y = add.

        Affine maps compose, so this is a scan by blocks like the exponential mean; where keep is 0 a new block begins
        and nothing before it has weight.  NULL rows are passed over and carry the value on.
        """
        p = "_a"
        d = df.withColumns({f"{p}k": keep.cast("double"), f"{p}c": add.cast("double")})
        has = F.col(f"{p}c").isNotNull() & F.col(f"{p}k").isNotNull()
        first = F.coalesce(F.sum(has.cast("int")).over(self.frame(Window.unboundedPreceding, -1)), F.lit(0)) == 0
        step = F.when(first, 0.0).otherwise(F.when(F.col(f"{p}k") > 0, F.least(-F.log(f"{p}k"), F.lit(2 * SPAN))).otherwise(2 * SPAN))
        d, total, rows = self._decayed(d.withColumn(f"{p}g", step), p, has, F.col(f"{p}g"), ("c",))
        return d.withColumn(name, F.last(F.when(has, total["c"]), ignorenulls=True).over(rows)).drop(*[f"{p}{k}" for k in ("k", "c", "g", "l", "b", "sc", "t")])

    def _decayed(self, d: DataFrame, p: str, has: Column, step: Column, parts: tuple) -> tuple:
        """Decayed sums of the columns ``p + part`` up to each row: (frame, {part: sum}, window over the rows so far).

        ``step`` is -log of the factor by which a row with a value decays what came before it.
        """
        c = lambda k: F.col(f"{p}{k}")
        d = d.withColumn(f"{p}l", F.coalesce(F.sum(F.when(has, step)).over(self.run), F.lit(0.0)))
        d = d.withColumn(f"{p}b", F.floor(c("l") / SPAN))
        # E grows with the rows, so ordering by block first keeps the order of the series: one sort for all frames
        inside = Window.partitionBy(*self.by, f"{p}b").orderBy(*self.order).rowsBetween(Window.unboundedPreceding, 0)
        blocks = Window.partitionBy(*self.by).orderBy(f"{p}b").rangeBetween(Window.unboundedPreceding, -1)
        rows = Window.partitionBy(*self.by).orderBy(f"{p}b", *self.order).rowsBetween(Window.unboundedPreceding, 0)
        o = c("l") - c("b") * SPAN
        d = d.withColumns({f"{p}s{k}": F.exp(-o) * F.sum(F.when(has, c(k)) * F.exp(o)).over(inside) for k in parts})
        # the last row of the blocks before has the largest E of them
        d = d.withColumn(f"{p}t", F.max(F.when(has, F.struct(f"{p}l", *[f"{p}s{k}" for k in parts]))).over(blocks))
        return d, {k: c(f"s{k}") + F.coalesce(c("t")[f"{p}s{k}"] * F.exp(c("t")[f"{p}l"] - c("l")), F.lit(0.0)) for k in parts}, rows


#: Decay of a block of an exponential mean: e^-41.5 is below 1e-18.
SPAN = 41.5

S = Series()


def span(n: float) -> float:
    """Smoothing factor of an exponential mean with the given span."""
    return 2.0 / (n + 1.0)


def spread(df: DataFrame, s: Series = S) -> DataFrame:
    """The series dealt to as many tasks as the session has shuffle partitions; the windows after it need no other shuffle.

    A long chain of windows holds a row once per sort, many times the bytes that were shuffled, and adaptive execution
    joins partitions by shuffled bytes; a number that is asked for stays.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *s.by)


def with_pos(df: DataFrame, s: Series = S, name: str = "_pos") -> DataFrame:
    return df.withColumn(name, s.pos())


def true_range(s: Series = S) -> Column:
    """Largest of high-low and the distances of high and low to the previous close."""
    pc = s.lag("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc))


def ladder(steps, default) -> Column:
    """First matching step of [(condition, value), ...]."""
    out = None
    for cond, value in steps:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(default)
