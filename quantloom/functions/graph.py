"""Connected components of an edge table, as joins and aggregations."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.session import checkpoint


def component_labels(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node of its component for every node that has an edge to another.

    Alternating large-star and small-star steps: a node hands its smallest neighbour first to its
    larger neighbours, then to the smaller ones.  The number of rounds grows with the logarithm of the
    longest path; no neighbourhood is ever collected, only its minimum, which combines map-side.  It
    runs until no edge changes.  Nodes may be of any orderable type, also structs.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u") != F.col("v")).distinct()
    e = checkpoint(e)
    before = None
    while (state := _state(e)) != before:
        before = state
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        e = checkpoint(small.select("e.u", "e.v").where(F.col("u") != F.col("v")).distinct())
    roots = e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("label"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)


def _state(e: DataFrame) -> tuple:
    """Number of edges and an order-free checksum of them."""
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
