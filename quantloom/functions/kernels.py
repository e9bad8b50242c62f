"""Numeric kernels over windows and series, run in Arrow batches on Spark's partitions.

``rolling_apply`` sends full windows as arrays (rows x window values per batch); ``rolling_frame`` sends the
sorted rows once and cuts their windows in the task; ``apply_series`` sends one series at a time, which the calendar bounds.
"""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quantloom.functions.series import S, Series


def rolling_windows(df: DataFrame, col: str, n: int, s: Series = S, lo=None, hi=0, min_periods: int | None = None) -> DataFrame:
    """Keys and an array of the values of each window that holds enough of them (default n), else NULL."""
    f = s.frame(-(n - 1) if lo is None else lo, hi)
    x = F.col(col)
    return df.select(*s.by, *s.order, F.when(F.count(x).over(f) >= (min_periods or n), F.collect_list(x).over(f)).alias("_w"))


ROWS = 1024  # windows worked on at once: a few hundred kilobytes of values


def map_windows(win: DataFrame, fns: dict[str, Callable], keys: list[str], n_out: dict[str, list[str]] | None = None) -> DataFrame:
    """Apply functions of (windows x values) arrays to the windows; each gives one number per window, or a tuple of them named by ``n_out``.

    The windows of a batch are stacked by length, so a function runs a few times per batch and not once per row.
    """
    names = [c for k in fns for c in (n_out or {}).get(k, [k])]
    keys = [f.name for f in win.schema if f.name in keys]
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in win.schema if f.name in keys], *[f"{c} double" for c in names]])

    def run(batches):
        for batch in batches:
            w = batch.column(batch.schema.get_field_index("_w"))
            size = w.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = w.flatten().to_numpy(zero_copy_only=False).astype(float)
            start = np.cumsum(size) - size
            out = np.full((len(names), len(size)), np.nan)
            for n in np.unique(size[size > 0]):
                same = np.flatnonzero(size == n)
                for at in np.split(same, range(ROWS, len(same), ROWS)):
                    x = flat[start[at][:, None] + np.arange(n)]
                    with np.errstate(all="ignore"):
                        vals = [v for fn in fns.values() for r in (fn(x),) for v in (r if isinstance(r, tuple) else (r,))]
                    for k, v in enumerate(vals):
                        out[k, at] = v
            cols = [batch.column(batch.schema.get_field_index(k)) for k in keys]
            yield pa.RecordBatch.from_arrays([*cols, *[pa.array(v, mask=~np.isfinite(v)) for v in out]], names=[*keys, *names])
    return win.mapInArrow(run, schema)


def rolling_apply(df: DataFrame, col: str, n: int, fns: dict[str, Callable], n_out=None, s: Series = S, lo=None, hi=0, min_periods=None) -> DataFrame:
    return map_windows(rolling_windows(df, col, n, s, lo, hi, min_periods), fns, [*s.by, *s.order], n_out)


def rolling_frame(df: DataFrame, cols: list[str], n: int, fn: Callable, outs: list[str], s: Series = S) -> DataFrame:
    """The rows with a function of the last ``n`` values of several columns; ``df`` is dealt by series (``spread``).

    ``fn`` takes one (windows x n) array per column, with NaN for NULL, and returns one array per output.  The rows of a
    task stream by in the order of their series with the last ``n - 1`` rows carried over, so a value is sent once and
    not once per window.  Windows that are not full, and results that are no finite numbers, are NULL.
    """
    d = df.sortWithinPartitions(*s.by, *s.order)
    schema = StructType([*d.schema.fields, *[StructField(o, DoubleType()) for o in outs]])

    def run(batches):
        tail = None
        for batch in batches:
            part = pa.Table.from_batches([batch]).select([*s.by, *cols])
            rows = part if tail is None else pa.concat_tables([tail, part])
            old, size = len(rows) - len(part), len(rows)
            first = np.zeros(size, dtype=bool)
            for k in s.by:
                code = rows.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                first[1:] |= code[1:] != code[:-1]
            start = np.maximum.accumulate(np.where(first, np.arange(size), 0))
            begin = np.arange(old, size) - (n - 1)  # first row of the window of every new row
            full = np.flatnonzero((begin >= 0) & (start[old:] <= begin))
            values = [rows.column(c).to_numpy().astype(float) for c in cols]
            out = np.full((len(outs), len(part)), np.nan)
            for at in np.split(full, range(ROWS, len(full), ROWS)) if len(full) else []:
                with np.errstate(all="ignore"):
                    out[:, at] = fn(*[np.lib.stride_tricks.sliding_window_view(v, n)[begin[at]] for v in values])
            tail = rows.slice(max(0, size - (n - 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(v, mask=~np.isfinite(v)) for v in out]], names=[*batch.schema.names, *outs])
    return d.mapInArrow(run, schema)


def apply_series(df: DataFrame, fn: Callable[[pd.Series], pd.Series], col: str, out: str = "value", s: Series = S) -> DataFrame:
    keys = [*s.by, *s.order]
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema], f"{out} double"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(s.order)).reset_index(drop=True)
        return pdf[keys].assign(**{out: fn(pdf[col]).astype(float)})
    return df.select(*keys, col).groupBy(*s.by).applyInPandas(run, schema)


def rolling_apply_pair(df: DataFrame, a: str, b: str, n: int, fns: dict[str, Callable], n_out=None, s: Series = S, lo=None, hi=0) -> DataFrame:
    """Functions of two aligned windows; rows where either value is missing are left out of both."""
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("_ab", F.struct(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")))
    f = s.frame(-(n - 1) if lo is None else lo, hi)
    full = F.count("_ab").over(f) == n
    both = F.collect_list("_ab").over(f)
    d = d.select(*s.by, *s.order, F.when(full, F.concat(F.transform(both, lambda r: r["a"]), F.transform(both, lambda r: r["b"]))).alias("_w"))
    split = {k: (lambda w, fn=fn: fn(w[:, :n], w[:, n:])) for k, fn in fns.items()}
    return map_windows(d, split, [*s.by, *s.order], n_out)


def apply_frame(df: DataFrame, fn: Callable, cols: list[str], outs: list[str], s: Series = S) -> DataFrame:
    """A function of several whole columns of one series (arrays in, arrays out)."""
    keys = [*s.by, *s.order]
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema], *[f"{o} double" for o in outs]])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(s.order)).reset_index(drop=True)
        res = fn(*[pdf[c].to_numpy(float) for c in cols])
        return pdf[keys].assign(**{o: np.asarray(r, float) for o, r in zip(outs, res)})
    return df.select(*keys, *cols).groupBy(*s.by).applyInPandas(run, schema)
