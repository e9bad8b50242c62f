"""Run a stream over the files present and read its table back."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.session import shared_folder

#: Epochs whose changes are folded into one file set before the next are kept apart again.
COMPACT_EVERY = 16


def run_append(stream: DataFrame, tag: str) -> DataFrame:
    """Append the finished rows to parquet with a checkpoint, drain what is available, read the table."""
    spark = stream.sparkSession
    root = shared_folder(spark, tag)
    q = (stream.writeStream.format("parquet").outputMode("append").option("path", f"{root}/table")
         .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/table")


def newest(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The row of the last epoch per key."""
    rest = [c for c in changes.columns if c not in (*keys, "epoch")]
    return changes.groupBy(*keys).agg(F.max("epoch").alias("epoch"), F.max_by(F.struct(*rest), "epoch").alias("_r")).select(*keys, "_r.*", "epoch")


def run_upsert(stream: DataFrame, tag: str, keys: list[str], transform=None) -> DataFrame:
    """Snapshot of an update-mode stream: every micro-batch brings the changed keys, the newest row of each key counts.

    A micro-batch writes its own changes only, under its epoch, so a repeated epoch replaces itself;
    every ``COMPACT_EVERY`` epochs the changes since the last fold are folded into one row per key.
    """
    return _upsert(stream, tag, keys, transform)[0]


def run_windows(stream: DataFrame, tag: str, keys: list[str], start: str, width: str) -> DataFrame:
    """All windows of an update-mode stream, also those still open, with ``is_final`` = 1 once the watermark has passed their end."""
    out, mark = _upsert(stream, tag, keys, None)
    end = F.col(start).cast("timestamp") + F.expr(f"INTERVAL {width}")
    done = end <= F.lit(mark).cast("timestamp") if mark else F.lit(False)
    return out.withColumn("is_final", done.cast("int"))


def run_sessions(stream: DataFrame, tag: str, keys: list[str], fold, end: str, gap: str) -> DataFrame:
    """``fold`` over the snapshot of an update-mode stream of pieces; ``is_final`` = 1 once the watermark has passed ``end`` by the gap."""
    parts, mark = _upsert(stream, tag, keys, None)
    done = F.col(end) + F.expr(f"INTERVAL {gap}") <= F.lit(mark).cast("timestamp") if mark else F.lit(False)
    return fold(parts).withColumn("is_final", done.cast("int"))


def run_decided(stream: DataFrame, tag: str, keys: list[str]) -> DataFrame:
    """Rows of an update-mode stream with ``final``: all final rows, and of each key the open ones of the last epoch that brought it."""
    spark = stream.sparkSession
    root = shared_folder(spark, tag)
    epochs: set[int] = set()

    def keep(batch: DataFrame, epoch: int) -> None:
        epochs.add(epoch)
        batch.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(f"{root}/changes/{epoch:09d}")

    q = (stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{root}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if not epochs:
        return spark.createDataFrame([], stream.schema).drop("final")
    rows = _read(spark, root, "", sorted(epochs))
    newest_epoch = rows.groupBy(*keys).agg(F.max("epoch").alias("_last"))
    return rows.join(newest_epoch, keys).where(F.col("final") | (F.col("epoch") == F.col("_last"))).drop("final", "epoch", "_last")


def run_two_levels(stream: DataFrame, tag: str, keys: list[str], groups: list[str], second) -> DataFrame:
    """A second aggregation over the snapshot of an update-mode stream: ``second`` runs on the groups that a micro-batch changed.

    ``keys`` identify a row of the stream and include ``groups``; the newest result of every group counts.
    """
    root = shared_folder(stream.sparkSession, tag)
    epochs: set[int] = set()

    def again(changes: DataFrame, snapshot: DataFrame, epoch: int) -> None:
        epochs.add(epoch)
        part = snapshot.join(changes.select(*groups).distinct(), groups, "left_semi")
        second(part.drop("epoch")).withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(f"{root}/second/{epoch:09d}")

    snapshot, _ = _upsert(stream, tag, keys, None, again)
    if not epochs:
        return second(snapshot)
    out = stream.sparkSession.read.parquet(*[f"{root}/second/{e:09d}" for e in sorted(epochs)])
    return newest(out, groups).drop("epoch")


def _upsert(stream: DataFrame, tag: str, keys: list[str], transform, then=None) -> tuple[DataFrame, str | None]:
    spark = stream.sparkSession
    root = shared_folder(spark, tag)
    folds: list[tuple[str, list[int]]] = [("", [])]  # the newest fold and the epochs after it

    def keep(batch: DataFrame, epoch: int) -> None:
        out = transform(batch) if transform else batch
        out.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(f"{root}/changes/{epoch:09d}")
        base, after = folds[-1]
        after = sorted({*after, epoch})
        if then:
            then(_read(spark, root, "", [epoch]), newest(_read(spark, root, base, after), keys), epoch)
        if len(after) >= COMPACT_EVERY:
            path = f"{root}/folds/{epoch:09d}"
            newest(_read(spark, root, base, after), keys).write.mode("overwrite").parquet(path)
            base, after = path, []
        folds.append((base, after))

    q = (stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{root}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    marks = [p["eventTime"]["watermark"] for p in q.recentProgress if "watermark" in (p["eventTime"] or {})]
    base, after = folds[-1]
    if not base and not after:
        shape = transform(stream) if transform else stream
        return spark.createDataFrame([], shape.schema), None
    return newest(_read(spark, root, base, after), keys).drop("epoch"), max(marks, default=None)


def _read(spark: SparkSession, root: str, base: str, after: list[int]) -> DataFrame:
    return spark.read.parquet(*([base] if base else []), *[f"{root}/changes/{e:09d}" for e in after])
