"""Fill-in-the-middle transformation by repeated-capture matching.

A unit is a run of ASCII letters or any other single code point.  One ``fullmatch`` of ``(unit)*`` with
the ``regex`` library keeps every repetition of the group, so ``match.ends(1)`` is the list of all unit
ends: its length is the number of units and two look-ups in it are the cuts.  The match costs about 120
bytes a unit, so a text of more than ``PIECE`` code points is matched in pieces that end where a unit ends.

The draw of a row is the SHA-256 of ``seed:id``: its first four 8-digit groups give the two cuts, plain or
not, and the order of the parts.  A row is therefore cut alike in every run and on every machine.

Output: plain texts as they are, ``psm`` as <P>prefix<S>suffix<M>middle, ``spm`` as
<S>suffix<P>prefix<M>middle.  ``restored`` takes the parts apart again; texts that hold a mark stay plain,
and a mark cannot arise across a seam because "<" only begins one.

Defined cases: a null text is an empty one; empty texts and texts with a mark are plain; a null id is
drawn as the text "null"; repeated rows are cut alike; other columns travel in ``row``; an empty table
gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import map_rows

#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Shares of a hundred rows that are rewritten, and of those that put the suffix first.
REWRITTEN, SUFFIX_FIRST = 90, 20

#: Code points of one match.
PIECE = 1 << 20

UNITS = regex.compile(r"([A-Za-z]++|[^A-Za-z])*")
OTHER = regex.compile(r"[^A-Za-z]")


def unit_ends(text: str, piece: int = PIECE) -> list[int]:
    """End of every unit of a text, in code points."""
    if len(text) <= piece:
        return UNITS.fullmatch(text).ends(1)
    ends, start = [], 0
    while start < len(text):
        seam = OTHER.search(text, start + piece)  # no run of letters goes on across it
        stop = seam.start() if seam else len(text)
        ends += UNITS.fullmatch(text, start, stop).ends(1)
        start = stop
    return ends


def draws(key: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 from the digest of ``seed:key``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def rearrange(text: str, ends: list[int], one: int, other: int, rewritten: bool, suffix_first: bool) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    n = len(ends)
    if not n or not rewritten or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return n, "plain", None, None, text
    low, high = sorted((one % (n + 1), other % (n + 1)))
    a, b = (ends[low - 1] if low else 0), (ends[high - 1] if high else 0)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if suffix_first:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1) -> DataFrame:
    """row (all columns but the text), n, form, prefix_chars, middle_chars, output."""
    others = [c for c in docs.columns if c != text]
    h = draws(F.col(key), seed)
    cut = docs.select(F.struct(*others).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"), h[0].alias("one"), h[1].alias("other"),
                      (h[2] % 100 < REWRITTEN).alias("rewritten"), (h[3] % 100 < SUFFIX_FIRST).alias("suffix_first"))
    out = pa.schema([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

    def cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            draws_of = zip(*(b.column(c).to_pylist() for c in ("one", "other", "rewritten", "suffix_first")))
            done = [rearrange(t, unit_ends(t), *d) for t, d in zip((t.as_py() for t in b.column("text")), draws_of)]
            columns = [pa.array(c, f.type) for c, f in zip(zip(*done) if done else [()] * len(out), out)]
            yield pa.RecordBatch.from_arrays([b.column("row"), *columns], ["row", *out.names])

    return map_rows(cut, cut_batches, f"row {cut.schema['row'].dataType.simpleString()}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: str = "output", form: str = "form") -> Column:
    """The text again, from output and form alone."""
    part = F.split(F.col(output), "<[PSM]>", -1)
    return (F.when(F.col(form) == "psm", F.concat(part[1], part[3], part[2]))
            .when(F.col(form) == "spm", F.concat(part[2], part[3], part[1])).otherwise(F.col(output)))
