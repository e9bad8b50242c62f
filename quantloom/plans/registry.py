"""Registry of the queries: one entry per operator, with its check text where SQL can express it."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.plans import sql
from quantloom.sources.tables import Tables


def snap(x: str) -> Column:
    """Round to a magnitude-dependent grid with an off-centre offset.

    Two engines differ in the last bits, and values such as price / quantity sit exactly on half
    steps; the offset keeps both on the same side.  Used only here, never in an operator.
    """
    d = f"CAST(`{x}` AS DOUBLE)"
    a = f"abs({d})"
    s = (f"(CASE WHEN {a} < 1e-3D THEN 1e9D WHEN {a} < 1D THEN 1e6D WHEN {a} < 1e3D THEN 1e4D WHEN {a} < 1e6D THEN 1e2D "
         f"WHEN {a} < 1e9D THEN 1D ELSE 1e-3D END)")
    return F.expr(f"CASE WHEN {d} IS NOT NULL AND NOT isnan({d}) AND {a} < double('infinity') "
                  f"THEN floor({d} * {s} + 0.37D) / {s} END")


@dataclass
class Entry:
    name: str
    fn: Callable[[Tables], DataFrame]
    keys: list[str]
    nums: list[str]
    ints: list[str]
    body: str | None
    tables: list[str]
    staged: bool = False

    def run(self, spark, folder) -> DataFrame:
        t = Tables(spark, folder)
        df = self.fn(t.staged() if self.staged else t)
        return df.select(*[F.col(k) for k in self.keys], *[snap(c).alias(c) for c in self.nums],
                         *[F.col(c).cast("long").alias(c) for c in self.ints])

    def oracle(self) -> str | None:
        if self.body is None:
            return None
        ctes = [*sql.prelude(self.tables), f"q_ AS ({self.body})"]
        cols = [*self.keys, *[f"{sql.snap(f'CAST({c} AS DOUBLE)')} AS {c}" for c in self.nums],
                *[f"CAST({c} AS BIGINT) AS {c}" for c in self.ints]]
        return f"WITH {', '.join(ctes)} SELECT {', '.join(cols)} FROM q_"


ENTRIES: dict[str, Entry] = {}


def query(name: str, keys: str = "", nums: str = "", ints: str = "", sql: str | None = None, tables: str = "", staged: bool = False):
    """Register a query; ``keys`` pass through, ``nums`` are snapped doubles, ``ints`` become bigint.

    A ``staged`` query uses the bars more than once: they are aggregated once, written, and read from there.
    """
    def wrap(fn):
        assert name not in ENTRIES, name
        ENTRIES[name] = Entry(name, fn, keys.split(), nums.split(), ints.split(), sql, tables.split(), staged)
        return fn
    return wrap
