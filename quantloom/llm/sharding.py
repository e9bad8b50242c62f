"""Sharding by jump consistent hashing: shard = f(key, shard count), with no ring table to store or send.

One more shard moves only the rows that the new shard takes, 1/(n+1) of them on average, and all of
them into it.  Keys of integer type are used as they are (the generator mixes them), others by their
64-bit hash; a null key counts as 0, so its rows meet in one shard by the law of the key.

``assign`` also numbers the rows of every shard from 0 without gaps.  Nothing is numbered by one task
per shard: equal rows are counted first, the counts are range-partitioned over (shard, key, size,
checksum), and every range starts at the sum of the ranges before it.

Defined cases: a null text has no bytes and checksum 0; rows equal in key, size and checksum are
interchangeable and take neighbouring slots; an empty table gives an empty result.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.llm.common import materialise

#: Multiplier of the 64-bit generator in the published algorithm.
MULTIPLIER = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of every key (uint64): each key jumps ahead until its next jump leaves the table."""
    state = keys.astype(np.uint64).copy()
    at = np.zeros(len(state), np.int64)
    todo = np.arange(len(state))
    while len(todo):
        state[todo] = state[todo] * MULTIPLIER + np.uint64(1)
        jump = ((at[todo] + 1) * (float(1 << 31) / ((state[todo] >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        todo, jump = todo[jump < shards], jump[jump < shards]
        at[todo] = jump
    return at.astype(np.int32)


def shard_column(key: Column, shards: int) -> Column:
    @F.pandas_udf(T.IntegerType())
    def shard(k: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(k.to_numpy(np.int64, na_value=0).view(np.uint64), shards))
    return shard(key)


def key_column(docs: DataFrame, key: str) -> Column:
    integral = isinstance(docs.schema[key].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    return F.coalesce(F.col(key).cast("long") if integral else F.xxhash64(F.col(key)), F.lit(0))


def assign(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text", rows_per_range: int = 200_000) -> DataFrame:
    """key, size, text_crc32, shard, slot, grown_shard for every row."""
    sized = docs.select(F.col(key), key_column(docs, key).alias("_k"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
                        F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0)).alias("text_crc32"))
    equal = sized.groupBy(key, "_k", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    placed = equal.withColumns({"shard": shard_column(F.col("_k"), shards), "grown_shard": shard_column(F.col("_k"), shards + 1)}).drop("_k")
    placed = materialise(placed, "placed")
    order = [key, "size", "text_crc32"]
    ranges = max(1, -(-placed.count() // rows_per_range), placed.sparkSession.sparkContext.defaultParallelism)
    ranged = materialise(placed.repartitionByRange(ranges, "shard", *order).withColumn("_range", F.spark_partition_id()), "ranges")
    # one row per shard and range: a range meets few shards, since ranges are cut by shard first
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    start = ranged.groupBy("shard", "_range").agg(F.sum("n").alias("_n")).select("shard", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    first = ranged.join(start, ["shard", "_range"]).withColumn("_first", F.col("_start") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return first.withColumn("slot", F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("n") - 1))).select(
        key, "size", "text_crc32", "shard", "slot", "grown_shard")
