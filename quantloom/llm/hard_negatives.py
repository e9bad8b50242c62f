"""Hard-negative mining by slot-decomposed selection.

Every anchor has some positives (its best other rows of its label) and every positive asks for the best
rows of other labels whose score lies in a window below its own score.  The windows of one anchor
overlap, so rows are not gathered window by window: the positives' scores, in falling order, cut the
scores below them into disjoint slots.  A row falls into one slot; the best few of each slot are kept,
first inside a task, then by a limited window over all tasks.  As every row of a slot is better than
every row of the next, one merge from the last slot up to the first answers all windows: the best rows
under limit i are those of slot i followed by the answer under limit i + 1, cut to the wanted number.
The lower end of a window then cuts off the tail.

Rows and anchors meet in a grid: rows are dealt into cells by the hash of their id, anchors into blocks,
and a task scores one cell against one block (at most ``CELL`` components on either side, a few anchors
at a time).  Nothing is broadcast or collected, a hot label has no place of its own, and a lost task is
one cell to repeat.  The grid runs twice, once for the positives and once for the slots.

Components become ``floor(scale * x)`` and scores are exact integers: products are summed as doubles while
they stay below 2^53 and as Python integers beyond it (scores outside the 64-bit range are cut to it).

Defined cases: rows with a null id, label or vector or a null or non-finite component take no part;
rows with the same id are one row, the least in label and vector; missing components of a shorter vector count as 0, an
empty vector scores 0; ties go to the smaller id; anchors without positives and positives without
negatives give no row; an empty table gives an empty result.  Other columns are not read.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import materialise

#: Components of one side of a cell of the grid.
CELL = 1 << 22
#: Scores a task holds at a time.
SCORES = 1 << 22
LONG = 2**63

FOUND = "anchor_id bigint, slot int, score bigint, id bigint"


def prepare(df: DataFrame, key: Column, label: Column, vector: Column, scale: int) -> DataFrame:
    """id, label, q: one row per id with its whole-number components."""
    x = vector.cast("array<double>")
    rows = df.select(key.cast("long").alias("id"), label.cast("long").alias("label"), x.alias("x"))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()).where(~bad)
    whole = rows.select("id", F.struct("label", F.transform("x", lambda v: F.floor(v * scale)).alias("q")).alias("row"))
    return whole.groupBy("id").agg(F.min("row").alias("row")).select("id", "row.label", "row.q")


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of whole numbers, filled up with zeros to ``width``."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(size) and (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), np.int64)
    out[np.arange(width) < size[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a and b, exact: doubles below 2^53, Python integers beyond."""
    top = lambda m: max(-int(m.min()), int(m.max())) if m.size else 0
    if top(a) * top(b) * max(a.shape[1], 1) < 2**53:
        return a.astype(np.float64) @ b.astype(np.float64).T
    cut = np.vectorize(lambda s: min(max(s, -LONG), LONG - 1), otypes=[object])
    return cut(a.astype(object) @ b.astype(object).T)


def best(scores: np.ndarray, open_: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the k best open scores of every row; ties to the smaller column."""
    columns = np.flatnonzero(open_.any(0))
    if not len(columns):
        return columns, columns
    s = np.where(open_[:, columns], scores[:, columns], -np.inf)
    take = open_[:, columns]
    if len(columns) > k:
        least = np.partition(s, len(columns) - k, axis=1)[:, len(columns) - k, None]
        above, level = s > least, s == least
        take = take & (above | (level & (np.cumsum(level, axis=1) <= k - above.sum(1, keepdims=True))))
    i, j = np.nonzero(take)
    return i, columns[j]


def score_cell(rows: pa.Table, anchors: pa.Table, positives: int, negatives: int, low: int, high: int) -> pa.Table:
    """Best rows of one cell for one block of anchors: by label (slot 0), or by slot where the anchors carry limits."""
    rows = rows.sort_by("id")
    r_id, r_label = (rows.column(c).to_numpy() for c in ("id", "label"))
    a_id, a_label = (anchors.column(c).to_numpy() for c in ("id", "label"))
    limits = anchors.column("limits").to_pylist() if "limits" in anchors.column_names else None
    width = max([int(n) for t in (rows, anchors) for n in [np.diff(t.column("q").combine_chunks().offsets.to_numpy()).max(initial=0)]], default=0)
    r_q, a_q = matrix(rows.column("q"), width), matrix(anchors.column("q"), width)
    found: list[tuple[np.ndarray, ...]] = []
    step = max(1, SCORES // max(len(r_id), 1))
    for at in range(0, len(a_id) if len(r_id) else 0, step):
        part = slice(at, at + step)
        s = products(a_q[part], r_q)
        same = a_label[part, None] == r_label[None, :]
        if limits is None:
            picks = [(0, *best(s, same & (a_id[part, None] != r_id[None, :]), positives))]
        else:
            # upper limits, padded below every score; the least score that any window admits
            fill = [[*u, *[-np.inf] * (positives - len(u))] for u in limits[part]]
            upper = np.array(fill, dtype=s.dtype)
            least = np.array([min((-(-low * x // high) for x in u if x >= 0), default=np.inf) for u in limits[part]], dtype=s.dtype)[:, None]
            open_ = ~same & (s >= least)
            picks = []
            for slot in range(1, positives + 1):
                under = open_ & (s <= upper[:, slot - 1, None])
                open_ = under if slot == positives else under & (s <= upper[:, slot, None])
                picks.append((slot, *best(s, under & ~open_ if slot < positives else under, negatives)))
        for slot, i, j in picks:
            found.append((a_id[part][i], np.full(len(i), slot, np.int32), s[i, j].astype(np.int64), r_id[j]))
    columns = [np.concatenate(c) for c in zip(*found)] if found else [[], [], [], []]
    return pa.table({"anchor_id": pa.array(columns[0], pa.int64()), "slot": pa.array(columns[1], pa.int32()),
                     "score": pa.array(columns[2], pa.int64()), "id": pa.array(columns[3], pa.int64())})


def over_grid(rows: DataFrame, anchors: DataFrame, shape: tuple[int, int], keep: int, **sizes: int) -> DataFrame:
    """anchor_id, slot, score, id: the ``keep`` best of every anchor and slot over all cells."""
    down, across = shape
    tasks = min(down * across, 20_000)
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n).cast("long"))
    # cell = row cell * across + anchor block
    left = rows.withColumn("cell", F.explode(F.sequence(dealt(down) * across, dealt(down) * across + (across - 1))))
    right = anchors.select(*[F.col(c).alias(c) for c in anchors.columns]).withColumn("cell", F.explode(F.sequence(dealt(across), dealt(across) + (down - 1) * across, F.lit(across).cast("long"))))

    def scored(a: pa.Table, b: pa.Table) -> pa.Table:
        return score_cell(a, b, **sizes)

    # the number of partitions is given: the tables are small for the work on them, and adaptive execution goes by bytes
    found = left.repartition(tasks, "cell").groupBy("cell").cogroup(right.repartition(tasks, "cell").groupBy("cell")).applyInArrow(scored, FOUND)
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def mine(df: DataFrame, is_anchor: Column, key: str = "vec_id", label: Column | str = "label", vector: str = "embedding", scale: int = 256, positives: int = 5,
         negatives: int = 5, low: int = 80, high: int = 100, cell: int = CELL) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on ``id``.  A window holds ``low * positive_score <= high * negative_score <= high * positive_score``.
    """
    rows = materialise(prepare(df, F.col(key), F.col(label) if isinstance(label, str) else label, F.col(vector), scale), "vectors")
    anchors = rows.where(is_anchor)
    parts = lambda t: -(-(t.agg(F.sum(F.greatest(F.size("q"), F.lit(1)))).first()[0] or 1) // cell)
    across = parts(anchors)
    down = max(parts(rows), -(-2 * rows.sparkSession.sparkContext.defaultParallelism // across))
    sizes = {"positives": positives, "negatives": negatives, "low": low, "high": high}

    best_rows = over_grid(rows, anchors, (down, across), positives, **sizes)
    listed = best_rows.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "id"))).alias("pos"))
    listed = materialise(listed, "positives")
    limited = anchors.join(listed.select(F.col("anchor_id").alias("id"), F.col("pos.score").alias("limits")), "id")
    slots = over_grid(rows, limited, (down, across), negatives, **sizes)
    kept = slots.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("slot", "rank", "score", "id"))).alias("found"))

    entry = "array<struct<slot:int,rank:int,score:bigint,id:bigint>>"
    suffixes = F.expr(f"""aggregate(sequence(size(pos), 1, -1), cast(array() AS array<{entry}>), (done, s) -> concat(
        array(slice(concat(filter(found, e -> e.slot = s), coalesce(get(done, 0), cast(array() AS {entry}))), 1, {int(negatives)})), done))""")
    windows = listed.join(kept, "anchor_id").withColumn("under", suffixes).select("anchor_id", F.explode(F.arrays_zip("pos", "under")).alias("w"))
    lower = lambda e: e["score"].cast("decimal(20,0)") * high >= F.col("w.pos.score").cast("decimal(20,0)") * low
    ranked = windows.select("anchor_id", F.col("w.pos.id").alias("positive_id"), F.col("w.pos.score").alias("positive_score"),
                            F.posexplode(F.filter("w.under", lower)).alias("at", "n"))
    return ranked.select("anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("n.id").alias("negative_id"), "positive_score", F.col("n.score").alias("negative_score"))
