"""Benchmark decontamination with a generalised suffix automaton of the benchmark items.

The words of all items form one suffix automaton (states = classes of word sequences with the same
end positions).  The words of a document are streamed through it; the state and the matched length
after each word say which item windows end there.  A window is ``window`` consecutive words of an
item; an item with fewer words, but not none, is one window as a whole.

The automaton is built in blocks of at most ``block_words`` item words (longer items are cut into
pieces that overlap by ``window - 1`` words), so what is broadcast has a fixed bound however large
the benchmark is; with several blocks the spans of each are added to those before it, with a
reliable checkpoint in between.

Defined cases: null and wordless texts have no words, no hits and are clean; wordless items never
match; repeated items count once per id; a null item id is listed as "null"; documents may repeat.
"""
from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import alnum_words, checkpoint, map_rows, utf8

OUT = "n_words bigint, spans array<struct<first:int,last:int>>, items array<string>"


class SuffixAutomaton:
    """Generalised suffix automaton over word numbers; built online, one item after the other."""

    def __init__(self) -> None:
        self.step: list[dict[int, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, parent: int, word: int, child: int) -> int:
        """State of the sequences that end like ``child`` but are at most one word longer than ``parent``'s."""
        if self.length[child] == self.length[parent] + 1:
            return child
        short = self._state(self.length[parent] + 1, dict(self.step[child]), self.link[child])
        self.link[child] = short
        while parent >= 0 and self.step[parent].get(word) == child:
            self.step[parent][word] = short
            parent = self.link[parent]
        return short

    def _extend(self, last: int, word: int) -> int:
        known = self.step[last].get(word)
        if known is not None:
            return self._split(last, word, known)
        new, at = self._state(self.length[last] + 1, {}, 0), last
        while at >= 0 and word not in self.step[at]:
            self.step[at][word] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self._split(at, word, self.step[at][word])
        return new

    def add(self, words: Iterable[int]) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w)

    def walk(self, words: Iterable[int]) -> Iterator[tuple[int, int]]:
        """(state, matched length) after each word: the longest suffix that occurs in an item."""
        at, size = 0, 0
        for w in words:
            while at and w not in self.step[at]:
                at = self.link[at]
                size = self.length[at]
            nxt = self.step[at].get(w)
            if nxt is None:
                at, size = 0, 0
            else:
                at, size = nxt, size + 1
            yield at, size


class Matcher:
    """Automaton of a block of items with, per state, the windows that end there."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.window = window
        self.number: dict[bytes, int] = {}
        coded = [(name, [self.number.setdefault(w, len(self.number)) for w in words]) for name, words in items if words]
        self.auto = SuffixAutomaton()
        for _, words in coded:
            self.auto.add(words)
        # whole windows by the state that holds exactly that sequence; marks[state] = [(length, items)]
        self.marks: dict[int, dict[int, set[str]]] = {}
        for name, words in coded:
            size = min(window, len(words))
            for end, (state, matched) in enumerate(self.auto.walk(words)):
                if matched >= size and end + 1 >= size:
                    self.marks.setdefault(self._holder(state, size), {}).setdefault(size, set()).add(name)
        # the nearest marked state on the way of suffix links, for every state
        order = sorted(range(len(self.auto.link)), key=self.auto.length.__getitem__)
        self.near = [-1] * len(order)
        for s in order:
            self.near[s] = s if s in self.marks else self.near[self.auto.link[s]] if s else -1
        self.shortest = min((min(window, len(w)) for _, w in coded), default=0)
        pairs = {(a, b) for _, words in coded for a, b in zip(words, words[1:])}
        self.base = len(self.number) + 1
        self.pairs = np.array(sorted(a * self.base + b for a, b in pairs), np.int64)

    def _holder(self, state: int, size: int) -> int:
        while state and self.auto.length[self.auto.link[state]] >= size:
            state = self.auto.link[state]
        return state

    def runs(self, codes: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches of words in which every neighbouring pair occurs in an item.

        Where a pair does not occur the matched length falls to one word, so the automaton may start
        afresh there; stretches shorter than the shortest window cannot hold one.
        """
        if self.shortest <= 1:
            known = codes >= 0
        else:
            pair = codes[:-1] * self.base + codes[1:]
            at = np.searchsorted(self.pairs, pair)
            known = (codes[:-1] >= 0) & (codes[1:] >= 0) & (at < len(self.pairs)) & (self.pairs[np.minimum(at, len(self.pairs) - 1)] == pair)
        edge = np.flatnonzero(np.diff(np.concatenate(([0], known.astype(np.int8), [0]))))
        more = 0 if self.shortest <= 1 else 1
        for first, end in zip(edge[::2], edge[1::2] + more):
            if end - first >= self.shortest:
                yield int(first), int(end)

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word spans (first, last) covered by windows, merged, and the items whose windows occur."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        if not self.shortest or len(words) < self.shortest:
            return spans, items
        codes = np.fromiter((self.number.get(w, -1) for w in words), np.int64, len(words))
        for first, end in self.runs(codes):
            for i, (state, size) in enumerate(self.auto.walk(codes[first:end].tolist()), first):
                state = self.near[state]
                while state >= 0:
                    for k, names in self.marks[state].items():
                        if k <= size:
                            items |= names
                            _cover(spans, i - k + 1, i)
                    state = self.near[self.auto.link[state]] if state else -1
        return spans, items


def _cover(spans: list[tuple[int, int]], first: int, last: int) -> None:
    """Add a span that ends at or after the last one; spans that touch or overlap become one."""
    while spans and spans[-1][1] >= first - 1:
        first, last = min(first, spans[-1][0]), max(last, spans.pop()[1])
    spans.append((first, last))


def blocks(benchmark: DataFrame, item: str, text: str, window: int, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Benchmark items in blocks of bounded size; partitions are fetched one at a time."""
    block: list[tuple[str, list[bytes]]] = []
    room = block_words
    for row in benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")), F.col(text).cast("binary")).toLocalIterator():
        words = alnum_words(row[1])
        for at in range(0, len(words), block_words) if len(words) > block_words else [0]:
            piece = words[at:at + block_words + window - 1] if len(words) > block_words else words
            if at and len(piece) < window:
                continue  # its windows lie in the piece before
            if block and len(piece) > room:
                yield block
                block, room = [], block_words
            block.append((row[0], piece))
            room -= len(piece)
    yield block


def find_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 13,
               block_words: int = 100_000, keep_text: bool = True) -> DataFrame:
    """Per document: struct ``row`` (its other columns), text (if kept), n_words, spans (first and last word, merged, in order), items."""
    out = docs.select(F.struct(F.lit(None).cast("string").alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row"),
                      F.col(text).alias("text"))
    row = out.schema["row"].dataType.simpleString()
    todo = blocks(benchmark, item, item_text, window, block_words)
    block, n = next(todo), 0
    while block is not None:
        after = next(todo, None)
        keep = keep_text or after is not None
        sent = docs.sparkSession.sparkContext.broadcast(block)
        out = map_rows(checkpoint(out) if n else out, _step(sent, uuid.uuid4().hex, window, n > 0, keep), f"row {row}, {'text string, ' if keep else ''}{OUT}")
        block, n = after, n + 1
    return out


#: Matcher of the block that this worker used last.
_LAST: dict[str, Matcher] = {}


def _step(sent, key: str, window: int, more: bool, keep: bool):
    span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _LAST:
            _LAST.clear()
            _LAST[key] = Matcher(sent.value, window)
        matcher = _LAST[key]
        for b in batches:
            counts, spans, items = [], [], []
            old = zip(b.column("spans").to_pylist(), b.column("items").to_pylist()) if more else None
            for t in utf8(b.column("text")):
                words = alnum_words(t)
                s, names = matcher.find(words)
                if old is not None:
                    was, had = next(old)
                    merged: list[tuple[int, int]] = []
                    for first, last in sorted([*s, *((x["first"], x["last"]) for x in was)], key=lambda x: (x[1], x[0])):
                        _cover(merged, first, last)
                    s, names = merged, names | set(had)
                counts.append(len(words))
                spans.append([{"first": f, "last": e} for f, e in s])
                items.append(sorted(names))
            made = {"n_words": pa.array(counts, pa.int64()), "spans": pa.array(spans, span), "items": pa.array(items, pa.list_(pa.string()))}
            carried = {c: b.column(c) for c in (["row", "text"] if keep else ["row"])}
            yield pa.RecordBatch.from_pydict({**carried, **made})
    return run


def verdicts(found: DataFrame, one_in: int = 20) -> DataFrame:
    """n_hit, n_items and ``contaminated``: at least one word in ``one_in`` is hit."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1)
    return found.withColumn("n_hit", hit).withColumns({
        "n_items": F.size("items").cast("long"), "items_sha256": F.sha2(F.array_join("items", ","), 256),
        "contaminated": (F.col("n_hit") > 0) & (F.col("n_hit") * one_in >= F.col("n_words"))})


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", one_in: int = 20, **options) -> DataFrame:
    """The documents, as given, without those that ``verdicts`` calls contaminated."""
    found = verdicts(find_spans(docs, benchmark, text=text, **options), one_in)
    return found.where(~F.col("contaminated")).select(*[F.col("text").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", min_words: int = 13, one_in: int = 20, **options) -> DataFrame:
    """The documents with hit spans cut out of their text: those of at least ``min_words`` words, and all spans of contaminated documents."""
    found = verdicts(find_spans(docs, benchmark, text=text, **options), one_in)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series, every: pd.Series) -> pd.Series:
        drop = [[x for x in s if e or x["last"] - x["first"] + 1 >= min_words] for s, e in zip(spans, every)]
        return pd.Series([without(t, d) if d else t for t, d in zip(texts, drop)], dtype=object)

    return found.select(*[cut("text", "spans", "contaminated").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def without(text: str, spans: list) -> str:
    """Text without the words of the spans and what stands between them; what surrounds a cut stays."""
    raw = text.encode()
    at = [m.span() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", raw)]
    out, last = [], 0
    for s in spans:
        out.append(raw[last:at[s["first"]][0]])
        last = at[s["last"]][1]
    return b"".join([*out, raw[last:]]).decode()
