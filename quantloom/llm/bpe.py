"""Byte-level BPE encoding and decoding with forced-boundary splitting.

Two bytes that are neighbours inside no vocabulary entry can never end up in one token, so the place
between them is a certain cut.  Every word of the pre-tokenizer is cut there first; the fragments are
encoded on their own, by merging the pair of lowest rank until none is left, and concatenated.  Short
fragments repeat far more often than words, so a bounded cache of both saves most of the merging.

The vocabulary file is a parameter.  The driver reads it and broadcasts its bytes, whose size is that
of the file.  Decoding joins the bytes of the ids and is independent of encoding.

Defined cases: a null text counts as empty and gives no ids; ids outside the vocabulary give no bytes
on decoding; invalid UTF-8 decodes to replacement characters; special tokens in a text become their id.
"""
from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import map_rows

#: The word pattern of the byte-level pre-tokenizer.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points that ``regex`` counts as letters or digits and the tokenizers library,
#: whose character tables are older, as symbols (first and last of each range).
NEWER = [(0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF),
         (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF),
         (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9),
         (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3),
         (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191),
         (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81),
         (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED),
         (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F)]
#: A symbol that no pattern treats otherwise, to stand for the newer code points while words are cut.
SYMBOL = "☃"


def printable_bytes() -> dict[str, int]:
    """Character that stands for each byte in vocabulary files: itself where printable, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def latin_words() -> re.Pattern:
    """The word pattern for texts of the first 256 code points only: plain character sets, which ``re`` runs faster."""
    kind = lambda p: "".join(f"\\x{i:02x}" for i in range(256) if regex.match(p, chr(i)))
    letter, digit, blank = kind(r"\p{L}"), kind(r"\p{N}"), kind(r"\s")
    return re.compile(f"'(?:[sdmt]|ll|ve|re)| ?[{letter}]+| ?[{digit}]+| ?[^{blank}{letter}{digit}]+|[{blank}]+(?![^{blank}])|[{blank}]+")


class Codec:
    """Tables of one vocabulary file and the caches of one worker."""

    def __init__(self, file: bytes, cache: int = 200_000) -> None:
        spec = json.loads(file)
        raw = printable_bytes()
        to_bytes = lambda s: bytes(raw[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.id_of = {to_bytes(s): i for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: b for b, i in self.id_of.items()} | {i: s.encode() for s, i in self.special.items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank = {(vocab[a], vocab[b]): n for n, (a, b) in enumerate(merges)}
        self.merged = [vocab[a + b] for a, b in merges]
        self.none = len(merges)
        first = [self.id_of[bytes([b])] for b in range(256)]
        self.byte_ids = lambda piece: [first[b] for b in piece]
        inside = np.zeros(65536, bool)
        for token in self.id_of:
            t = np.frombuffer(token, np.uint8).astype(np.int64)
            inside[t[:-1] * 256 + t[1:]] = True
        self.inside = inside.tobytes()
        self.words = regex.compile(WORDS)
        self.latin = latin_words()
        self.newer = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in NEWER) + "]")
        self.split_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.room = cache
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.pieces: dict[bytes, bytes] = {}

    def fragments(self, word: bytes) -> list[bytes]:
        """Cut between bytes that are neighbours in no token."""
        inside, out, first = self.inside, [], 0
        for i in range(1, len(word)):
            if not inside[word[i - 1] * 256 + word[i]]:
                out.append(word[first:i])
                first = i
        out.append(word[first:])
        return out

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a fragment: the leftmost pair of lowest rank first."""
        ids = self.byte_ids(piece)
        if len(ids) < 2:
            return ids
        rank, none = self.rank, self.none
        if len(ids) <= 64:
            ranks = [rank.get(p, none) for p in zip(ids, ids[1:])]
            while (best := min(ranks)) < none:
                i = ranks.index(best)
                ids[i] = self.merged[best]
                del ids[i + 1], ranks[i]
                if i:
                    ranks[i - 1] = rank.get((ids[i - 1], ids[i]), none)
                if i < len(ranks):
                    ranks[i] = rank.get((ids[i], ids[i + 1]), none)
                elif not ranks:
                    break
            return ids
        # long fragment: linked list and heap
        n = len(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j, new = right[i], self.merged[r]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j] = new, -1
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
                if (r := rank.get((new, ids[k]))) is not None:
                    heapq.heappush(heap, (r, i, new, ids[k]))
            h = left[i]
            if h >= 0 and (r := rank.get((ids[h], new))) is not None:
                heapq.heappush(heap, (r, h, ids[h], new))
        out, i = [], 0
        while i >= 0:
            out.append(ids[i])
            i = right[i]
        return out

    def word(self, word: str) -> bytes:
        """Packed ids of one word, from the caches where possible."""
        found = self.old.get(word)
        if found is None:
            parts = []
            for piece in self.fragments(word.encode()):
                packed = self.pieces.get(piece)
                if packed is None:
                    packed = array("I", self.merge(piece)).tobytes()
                    if len(piece) <= 32:
                        if len(self.pieces) >= self.room:
                            self.pieces.clear()
                        self.pieces[piece] = packed
                parts.append(packed)
            found = b"".join(parts)
        if len(word) <= 64:
            if len(self.young) >= self.room:
                self.old, self.young = self.young, {}
            self.young[word] = found
        return found

    def plain(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
            latin = True
        except UnicodeEncodeError:
            latin = False
        if latin:
            words = self.latin.findall(text)
        elif self.newer.search(text):
            cuts = [m.span() for m in self.words.finditer(self.newer.sub(SYMBOL, text))]
            words = [text[a:b] for a, b in cuts]
        else:
            words = self.words.findall(text)
        out = [*map(self.young.get, words)]
        if None in out:
            slow = self.word
            out = [slow(w) if packed is None else packed for w, packed in zip(words, out)]
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.split_special is None or not self.split_special.search(text):
            return self.plain(text)
        out, last = [], 0
        for m in self.split_special.finditer(text):
            out += [self.plain(text[last:m.start()]), array("I", [self.special[m[0]]]).tobytes()]
            last = m.end()
        return b"".join([*out, self.plain(text[last:])])

    def decode(self, packed: bytes) -> bytes:
        """UTF-8 bytes of packed ids."""
        get = self.bytes_of.get
        raw = b"".join([get(i, b"") for i in memoryview(packed).cast("I")])
        return raw.decode("utf-8", "replace").encode("utf-8")


#: Codec that this worker used last, by digest of its file.
_LAST: dict[str, Codec] = {}


def codec(key: str, file) -> Codec:
    if key not in _LAST:
        _LAST.clear()
        _LAST[key] = Codec(file.value)
    return _LAST[key]


def _broadcast(df: DataFrame, path: str):
    with open(path, "rb") as f:
        file = f.read()
    return hashlib.sha256(file).hexdigest(), df.sparkSession.sparkContext.broadcast(file)


def encode(docs: DataFrame, vocabulary: str, text: str = "text", keep: list[str] | None = None, digests: bool = False) -> DataFrame:
    """``ids`` (binary, little-endian unsigned 32-bit) per row next to the columns ``keep``.

    With ``digests`` the ids are decoded again in the same task and only n_tokens, ids_sha256 and
    decoded_sha256 leave it.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    rows = docs.select(F.struct(F.lit(None).cast("string").alias("_"), *[F.col(f"`{c}`") for c in keep]).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    key, file = _broadcast(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(key, file)
        for b in batches:
            packed = [c.encode(t) for t in b.column("text").to_pylist()]
            if digests:
                sha = lambda x: hashlib.sha256(x).hexdigest()
                made = {"n_tokens": pa.array([len(p) // 4 for p in packed], pa.int64()), "ids_sha256": pa.array(map(sha, packed), pa.string()),
                        "decoded_sha256": pa.array([sha(c.decode(p)) for p in packed], pa.string())}
            else:
                made = {"ids": pa.array(packed, pa.binary())}
            yield pa.RecordBatch.from_pydict({"row": b.column("row"), **made})

    made = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digests else "ids binary"
    out = map_rows(rows, run, f"row {rows.schema['row'].dataType.simpleString()}, {made}")
    clash = {x.split(" ")[0] for x in made.split(", ")}
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in keep if c not in clash], *sorted(clash))


def decode(encoded: DataFrame, vocabulary: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """``out`` (text) from packed ids, next to the other columns."""
    keep = [c for c in encoded.columns if c not in (ids, out)]
    rows = encoded.select(F.struct(F.lit(None).cast("string").alias("_"), *[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(ids).alias("ids"))
    key, file = _broadcast(encoded, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(key, file)
        for b in batches:
            texts = [None if p is None else c.decode(p).decode() for p in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"row": b.column("row"), "text": pa.array(texts, pa.string())})

    made = map_rows(rows, run, f"row {rows.schema['row'].dataType.simpleString()}, text string")
    return made.select(*[F.col(f"row.`{c}`").alias(c) for c in keep], F.col("text").alias(out))
