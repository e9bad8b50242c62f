"""Reproducible uniform draws in integer arithmetic.

A draw is a function of its seed and keys alone, so it does not depend on partitioning or recomputation, and any
engine with 64-bit integers computes the same one.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

P = 2 ** 31 - 1  # a prime: products of two residues fit in 63 bits
MULTIPLIER, INCREMENT = 48271, 1013904223


def with_draw(df: DataFrame, out: str, seed: int | Column, keys: list[Column]) -> DataFrame:
    """Add ``out``, a residue below ``P`` drawn from the seed and the integer keys, in that order.

    Each key is added and the sum taken to its fifth power, which permutes the residues, and spread by an
    affine map; a last power without a key ends the chain.  A NULL key gives a NULL draw.  The seed may be an earlier draw.
    """
    p = F.lit(P)
    d = df.withColumn(out, (F.lit(seed) if isinstance(seed, int) else seed).cast("long") % p)
    for k in [*keys, F.lit(0)]:
        d = d.withColumn("_draw", (F.col(out) + F.pmod(k.cast("long"), p)) % p)
        d = d.withColumn("_draw2", F.col("_draw") * F.col("_draw") % p)
        d = d.withColumn("_draw4", F.col("_draw2") * F.col("_draw2") % p)
        d = d.withColumn(out, (F.col("_draw4") * F.col("_draw") % p * MULTIPLIER + INCREMENT) % p)
    return d.drop("_draw", "_draw2", "_draw4")


def unit(draw: str) -> Column:
    """The draw as a number strictly between 0 and 1."""
    return (F.col(draw) + 0.5) / float(P)
