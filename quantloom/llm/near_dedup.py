"""Near-duplicate detection with HyperMinHash registers, banding and exact verification.

A document is the set of its distinct word shingles.  Its sketch has ``BUCKETS`` registers of 16
bits; each keeps, for the smallest hash of its bucket, the number of leading zeros and ten mantissa
bits.  Buckets that a small set leaves empty are filled by further hash rounds, so every register of
every set agrees with probability close to the Jaccard similarity.  ``ROWS`` registers form a band
(42 bands): a pair of similarity 0.8 is missed with probability (1 - 0.8^6)^42 < 3e-6.

Equal sets are one class from the start.  The classes of a band bucket are compared with the smallest
of them only (a star, never all pairs): the estimate from the registers, corrected for chance
agreement, drops clear misses, and what is left is confirmed on the full sets.  Linked classes are
contracted to components.  Buckets that still hold several components are settled in tasks of at most
``2 * CHUNK`` members: pairs across components only, each pair in its first common band, the likeliest
first, none between components that have met, and only confirmed links leave the task.  So no link of
a bucket is lost, and the members of a large group of near copies are not compared with each other.

Defined cases: null and wordless texts have the empty set, are linked with nothing and stay; a text
with fewer words than a shingle has them all as its one shingle; a null id is a document of its own
class and never the smallest; rows that repeat an id and a text share their decision.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions.graph import component_labels
from quantloom.llm.common import blank_words, map_rows, materialise, utf8

BUCKETS, ROWS, MANTISSA, WIDTH = 256, 6, 10, 40
BANDS = BUCKETS // ROWS
#: Registers of a band stand side by side in the stored sketch; a band takes every 42nd register.
BAND_ORDER = np.arange(BANDS * ROWS).reshape(ROWS, BANDS).T.ravel()
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: The estimate may be this far below the limit before a pair is dropped unverified: over six standard
#: deviations of 256 registers at a similarity of 0.8.
MARGIN = 0.16
#: Most members of a bucket that one task compares with as many others.
CHUNK = 2048


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Hashes of words met by this worker.
_WORDS: dict[bytes, int] = {}


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    ws = blank_words(text)
    if not ws:
        return np.empty(0, np.uint64)
    if len(_WORDS) > 150_000:
        _WORDS.clear()
    codes = [*map(_WORDS.get, ws)]
    if None in codes:
        for i, c in enumerate(codes):
            if c is None:
                codes[i] = _WORDS.setdefault(ws[i], xxhash.xxh3_64_intdigest(ws[i]))
    h = np.array(codes, np.uint64)
    k = min(words, len(h))
    out = mix(h[:len(h) - k + 1] + np.uint64(k))
    for j in range(1, k):
        out = mix(out * GOLDEN + h[j:len(h) - k + 1 + j])
    return np.unique(out)


def sketch(elements: np.ndarray) -> np.ndarray:
    """Registers of a non-empty set, in bucket order.

    Round r hashes every element to one bucket; a bucket keeps the smallest (round, value), so later
    rounds only fill what is still empty.
    """
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    low = np.full(BUCKETS, empty)
    done, rounds = 0, 1 if len(elements) >= 4 * BUCKETS else math.ceil(5 * BUCKETS / len(elements))
    while True:
        r = np.arange(done, done + rounds, dtype=np.uint64)[:, None]
        h = mix(elements[None, :] + (r + np.uint64(1)) * GOLDEN)
        np.minimum.at(low, (h >> np.uint64(56)).astype(np.int64).ravel(), ((r << np.uint64(WIDTH)) | (h & np.uint64((1 << WIDTH) - 1))).ravel())
        done += rounds
        if not (low == empty).any():
            break
    m, e = np.frexp((low & np.uint64((1 << WIDTH) - 1)).astype(np.float64))
    fraction = np.where(m > 0, (m * 2 - 1) * (1 << MANTISSA), 0).astype(np.uint16)
    return ((WIDTH - e).astype(np.uint16) << np.uint16(MANTISSA)) | fraction


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Expected share of registers that agree by chance for disjoint sets of n and m elements."""
    zeros = np.arange(WIDTH)
    lo, hi = 0.5 ** (zeros + 1), 0.5 ** zeros

    def in_cell(size: np.ndarray) -> np.ndarray:
        load = np.maximum(size / BUCKETS, 1.0)[:, None]
        return np.exp(-load * lo) - np.exp(-load * hi)
    return (in_cell(n) * in_cell(m)).sum(axis=1) / (1 << MANTISSA)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimates of register rows, corrected for chance agreement."""
    same = (a == b).mean(axis=1)
    by_chance = chance(n, m)
    return (same - by_chance) / (1 - by_chance)


def sketches(docs: DataFrame, id_col: str, text: str, words: int) -> DataFrame:
    """doc_id, rkey (hash of id and text), n, digest of the set (16 bytes), registers in band order; empty sets have no digest."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text).alias("rkey"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, digest, regs = [], [], []
            for t in utf8(b.column("text")):
                s = shingle_set(t, words)
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                regs.append(sketch(s)[BAND_ORDER].astype("<u2").tobytes() if len(s) else None)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "rkey": b.column("rkey"), "n": pa.array(n, pa.int64()),
                                              "digest": pa.array(digest, pa.binary()), "regs": pa.array(regs, pa.binary())})
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_rows(rows, run, f"doc_id {kind}, rkey bigint, n bigint, digest binary, regs binary")


def band_rows(classes: DataFrame) -> DataFrame:
    """(band, key, cid): one row per class and band."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda j: F.xxhash64(j, F.substring(F.col("regs"), j * (2 * ROWS) + 1, F.lit(2 * ROWS))))
    return classes.select(F.posexplode(keys).alias("band", "key"), "cid")


def buckets(classes: DataFrame) -> DataFrame:
    """(key, band, cid, rep, size): members of the band buckets with at least two classes, with the smallest of the bucket."""
    rows = band_rows(classes)
    full = rows.groupBy("key").agg(F.min("cid").alias("rep"), F.count(F.lit(1)).alias("size")).where("size > 1")
    return rows.join(full, "key")


def candidate_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text: str, words: int) -> DataFrame:
    """(cid, n, regs, elements): full shingle sets of the wanted classes (cid, rkey, n, regs).

    The texts are read once more.  A bitmap of the wanted rows, of a fixed largest size, keeps the rest
    from being hashed; what it lets through by mistake falls out of the join.
    """
    bits = min(1 << 27, max(1 << 20, 1 << (16 * wanted.count()).bit_length()))
    at = F.pmod(F.col("rkey"), F.lit(bits))
    maps = wanted.select(F.bitmap_bucket_number(at + 1).alias("k"), F.bitmap_bit_position(at + 1).alias("p")).groupBy("k").agg(F.bitmap_construct_agg("p").alias("m"))
    filled = np.zeros(bits // 8 + 4096, np.uint8)
    for k, m in maps.collect():  # at most bits / 32768 rows of 4 KB
        filled[(k - 1) * 4096:k * 4096] = np.frombuffer(m, np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(filled)
    rows = docs.select(F.xxhash64(id_col, text).alias("rkey"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = sent.value
        for b in batches:
            # the bitmap functions count values from 1, buckets from 1, and fill a byte from its lowest bit
            pos = b.column("rkey").to_numpy(zero_copy_only=False) % bits
            hit = np.flatnonzero((have[pos >> 3] >> (pos & 7).astype(np.uint8)) & 1)
            if len(hit):
                b = b.take(pa.array(hit))
                sets = [shingle_set(t, words).tobytes() for t in utf8(b.column("text"))]
                yield pa.RecordBatch.from_pydict({"rkey": b.column("rkey"), "elements": pa.array(sets, pa.binary())})
    found = map_rows(rows, run, "rkey bigint, elements binary")
    return found.join(wanted, "rkey").dropDuplicates(["cid"]).select("cid", "n", "regs", "elements")


def with_both(pairs: DataFrame, table: DataFrame, cols: list[str]) -> DataFrame:
    """Columns of both members of the pairs, as a_<name> and b_<name>."""
    for side in ("a", "b"):
        pairs = pairs.join(table.select(F.col("cid").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in cols]), side)
    return pairs


def reaches(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def registers(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, BANDS * ROWS)


def star_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs whose sets reach the limit; the registers decide which sets are compared."""
    def estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                n, m = (b.column(c).to_numpy().astype(float) for c in ("a_n", "b_n"))
                likely = estimate(registers(b.column("a_regs")), registers(b.column("b_regs")), n, m) >= percent / 100 - MARGIN
                yield b.select(["a", "b"]).filter(pa.array(likely & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))))

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = zip(b.column("a_elements").to_pylist(), b.column("b_elements").to_pylist())
            yield b.select(["a", "b"]).filter(pa.array([reaches(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in both], pa.bool_()))

    likely = map_rows(with_both(pairs, sets, ["regs", "n"]), estimated, "a bigint, b bigint")
    return map_rows(with_both(likely, sets, ["elements"]), verified, "a bigint, b bigint")


def unsettled(members: DataFrame, label: DataFrame) -> DataFrame:
    """(key, band, cid, label, size) of the buckets that hold several components; a bucket of two is settled by its star."""
    named = members.where("size > 2").join(label.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    mixed = named.groupBy("key").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi")).where("_lo <> _hi").select("key")
    return named.join(mixed, "key", "left_semi").select("key", "band", "cid", "label", "size")


def bucket_links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): confirmed links across the components of a bucket, those that join two of them.

    A bucket of more than ``CHUNK`` members is dealt into chunks, and every pair of chunks is a group.
    """
    chunks = F.ceil(F.col("size") / CHUNK).cast("int")
    mine = F.pmod(F.xxhash64("cid"), chunks).cast("int")
    units = F.transform(F.sequence(F.lit(0), chunks - 1), lambda c: F.least(c, mine) * (1 << 16) + F.greatest(c, mine))
    dealt = rows.select("key", "band", "cid", "label", mine.alias("chunk"), F.explode(units).alias("unit")).join(sets, "cid")
    return dealt.groupBy("key", "unit").applyInArrow(_settle(percent), "a bigint, b bigint")


def _settle(percent: int):
    def run(t: pa.Table) -> pa.Table:
        regs, n = registers(t.column("regs")).reshape(-1, BANDS, ROWS), t.column("n").to_numpy().astype(float)
        cid, chunk, band = t.column("cid").to_numpy(), t.column("chunk").to_numpy(), t.column("band")[0].as_py()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("elements")]
        crossing = len(set(chunk.tolist())) > 1
        _, label, sizes = np.unique(t.column("label").to_numpy(), return_inverse=True, return_counts=True)
        main = int(np.argmax(sizes))  # its members need no comparison among each other, and no turn of their own
        links: list[tuple[int, int]] = []
        for i in np.flatnonzero(label != main):
            with_ = (label != label[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
            with_ &= (np.arange(len(n)) > i) | (label == main)
            if crossing:
                with_ &= chunk != chunk[i]
            js = np.flatnonzero(with_)
            if not len(js):
                continue
            same = regs[js] == regs[i]
            by_chance = chance(n[js], np.full(len(js), n[i]))
            likely = (same.mean(axis=(1, 2)) - by_chance) / (1 - by_chance)
            first = same.all(axis=2).argmax(axis=1) == band
            for k in np.argsort(-likely):
                if likely[k] < percent / 100 - MARGIN:
                    break
                j = js[k]
                if first[k] and label[j] != label[i] and reaches(sets[i], sets[j], percent):
                    links.append((int(cid[i]), int(cid[j])))
                    old, new = label[i], label[j]
                    if old == main:
                        old, new = new, old
                    label[label == old] = new
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})
    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, rkey, n_shingles, component_id (smallest id reachable), kept, one row per document."""
    rows = materialise(sketches(docs, id_col, text, words), "sketches")
    full = rows.where(F.col("digest").isNotNull())
    classes = full.groupBy("digest").agg(F.min("doc_id").alias("least_id"), F.max("n").alias("n"), F.min_by("regs", "rkey").alias("regs"), F.min("rkey").alias("rkey"))
    classes = materialise(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    members = materialise(buckets(classes), "buckets")
    wanted = materialise(members.select("cid").distinct().join(classes.select("cid", "rkey", "n", "regs"), "cid"), "wanted")
    sets = materialise(candidate_sets(docs, wanted, id_col, text, words), "sets")

    star = members.where(F.col("cid") != F.col("rep")).select(F.col("rep").alias("a"), F.col("cid").alias("b")).distinct()
    label = component_labels(star_links(star, sets, percent))
    more = materialise(bucket_links(unsettled(members, label), sets, percent), "links")
    if not more.isEmpty():
        # the components that met, as a graph of their own
        of = label.withColumnRenamed("label", "_label")
        met = more
        for side in ("a", "b"):
            met = met.join(of.withColumnRenamed("node", side), side, "left").withColumn(f"_{side}", F.coalesce("_label", side)).drop("_label")
        over = component_labels(met.select(F.col("_a").alias("a"), F.col("_b").alias("b"))).select(F.col("node").alias("label"), F.col("label").alias("_over"))
        alone = over.select(F.col("label").alias("node"), F.col("_over").alias("label"))
        label = label.join(over, "label", "left").select("node", F.coalesce("_over", "label").alias("label")).unionByName(alone.join(label, "node", "left_anti"))

    labelled = classes.select("digest", "cid", "least_id").join(label.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    least = labelled.groupBy("label").agg(F.min("least_id").alias("component_id"))
    of_class = labelled.join(least, "label").select("digest", "component_id")
    out = rows.select("doc_id", "rkey", F.col("n").alias("n_shingles"), "digest").join(of_class, "digest", "left")
    out = out.withColumn("component_id", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "rkey", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The documents, as given, without those that a smaller id of their component stands for."""
    gone = near_duplicates(docs, id_col, text, words, percent).where(~F.col("kept")).select("rkey").distinct()
    key = F.xxhash64(id_col, text)
    return docs.withColumn("_rkey", key).join(gone.withColumnRenamed("rkey", "_rkey"), "_rkey", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
