"""Exact deduplication by skew-safe combining, in DataFrame functions only.

Copies are merged three times, each time by digest *and* full content: inside every map task (the
partial aggregation), per salt (the rows of a hot text are spread over ``salts`` groups, dealt out by
input partition so that the copies of one task stay together), and over the salts' winners.  A hot text thus leaves
a task as one row, and no task ever sees more than the winners of one digest.

Defined cases: a null text counts as empty; a null id never wins against another id; of rows that
repeat both id and text one is kept; an empty table gives an empty result; other columns are untouched.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import materialise


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def _salted(docs: DataFrame, digest: Callable[[Column], Column], text: str, salts: int, cols: dict[str, Column]) -> DataFrame:
    content = F.coalesce(F.col(text), F.lit(""))
    # the salt only spreads the load: every result is the same for any salt
    return docs.select(content.alias("content"), *[c.alias(k) for k, c in cols.items()]).select(
        digest(F.col("content")).alias("digest"), "content", F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"), *cols)


def winners(docs: DataFrame, id_col: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256, salts: int = 16) -> DataFrame:
    """(digest, content, keep_id, group_size): one row per different text."""
    rows = _salted(docs, digest, text, salts, {"id": F.col(id_col)})
    per_salt = rows.groupBy("digest", "salt", "content").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return per_salt.groupBy("digest", "content").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def decisions(docs: DataFrame, id_col: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256, salts: int = 16) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest.

    The rows look up their winner by digest alone, so no text travels with them; a digest that two
    different texts share (possible with a weak ``digest`` only) is looked up by content instead.
    """
    # one shuffle by digest serves both aggregations: contents of a digest, then their number
    won = winners(docs, id_col, text, digest, salts)
    narrow = materialise(won.groupBy("digest").agg(F.count(F.lit(1)).alias("n_texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")), "winners")
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), digest(content).alias("digest"))
    out = _look_up(rows, narrow.where("n_texts = 1").drop("n_texts"), ["digest"])
    clash = narrow.where("n_texts > 1").select("digest")
    if not clash.isEmpty():
        rows = docs.select(F.col(id_col).alias("doc_id"), digest(content).alias("digest"), content.alias("content")).join(clash, "digest", "left_semi")
        out = out.unionByName(_look_up(rows, won.join(clash, "digest", "left_semi"), ["digest", "content"]))
    return out


def _look_up(rows: DataFrame, won: DataFrame, on: list[str]) -> DataFrame:
    """Winner of every row; repeated rows (same id and text) are counted first and dealt out again, one of them kept."""
    counted = rows.groupBy("doc_id", *on).agg(F.count(F.lit(1)).alias("copies"))
    j = counted.join(won, on).withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return j.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"), "digest")


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256, salts: int = 16) -> DataFrame:
    """The documents with one row per different text, that with the largest id; columns as given.

    The whole row rides along with its text through the three merges, so no join back is needed.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text], F.col(text).isNull().alias("was_null"))
    rank = F.struct(F.col(id_col).isNotNull(), F.col(id_col))
    rows = _salted(docs, digest, text, salts, {"row": row, "rank": rank})
    for by in (["digest", "salt", "content"], ["digest", "content"]):
        rows = rows.groupBy(*by).agg(F.max_by("row", "rank").alias("row"), F.max("rank").alias("rank"))
    return rows.select(*[F.when(~F.col("row.was_null"), F.col("content")).alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
