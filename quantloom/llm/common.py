"""Small helpers shared by the corpus operators."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.session import checkpoint, materialise, shared_folder

#: A-Z to a-z and every other byte below 0x80 that is not a digit or a letter to a blank.
ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: A-Z to a-z, nothing else.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def alnum_words(text: bytes | None) -> list[bytes]:
    """Words of UTF-8 bytes: runs of digits, ASCII letters (lower-cased) and non-ASCII characters."""
    return text.translate(ALNUM).split() if text else []


def blank_words(text: bytes | None) -> list[bytes]:
    """Words between blanks (space, tab to carriage return), A-Z lower-cased."""
    return text.translate(LOWER).split() if text else []


def utf8(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a text column, without a detour over str."""
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


#: Bytes of an Arrow batch between Spark and a Python worker: texts as Python objects take a multiple of it.
BATCH_BYTES = 16 << 20


def map_rows(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with batches cut by bytes, so that long texts do not pile up in a worker.

    Lowers ``spark.sql.execution.arrow.maxBytesPerBatch`` of the session where it is larger.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(key).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def id_crc(col: str) -> Column:
    """CRC-32 of an id written as text; null ids count as the text "null"."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("null")))


__all__ = ["alnum_words", "blank_words", "checkpoint", "id_crc", "map_rows", "materialise", "shared_folder", "utf8"]
