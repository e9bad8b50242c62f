"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the one- to three-grams of the lower-cased text, with everything below 0x80 that is not a
letter as blank, hashed to ``DIMS`` places.  Document frequencies are counted over every training document.
The weights are learned by follow-the-regularised-leader with L1 and L2 penalties (most weights stay
exactly zero) on a sample of about ``sample_rows`` training documents: each epoch every part of the sample updates a copy
of the state in its own task and the copies are averaged.  A fifth of the sample stays out and sets
the temperature of the softmax.  Only the state, of fixed size, meets on the driver.

Defined cases: null texts and texts without a letter are ``und`` with score 0; without any training
document every text is ``und``; rows without a label are not learned from; equal scores go to the
first label in order.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import id_crc, map_rows, materialise

DIMS = 1 << 15
#: Per-coordinate rate, its offset, and the two penalties of the leader update.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.02
EPOCHS, PARTS = 3, 4
TEMPERATURES = 2.0 ** (np.arange(-32, 33) / 8)
UNKNOWN = "und"

_ASCII_LETTER = re.compile("[A-Za-z]")
_BLANK = np.array([i if 97 <= i <= 122 else 32 for i in range(128)], np.uint32)


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text)))


def ngram_counts(text: str) -> np.ndarray:
    """Counts of the hashed one- to three-grams."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(c < 128, _BLANK[np.minimum(c, 127)], c)
    c = np.concatenate(([np.uint32(32)], c, [np.uint32(32)]))
    shift = np.uint32(32 - DIMS.bit_length() + 1)
    two = c[:-1] * np.uint32(0x9E3779B1) + c[1:]
    three = two[:-1] * np.uint32(0x85EBCA6B) + c[2:]
    out = np.bincount((c * np.uint32(0xC2B2AE35)) >> shift, minlength=DIMS)
    out += np.bincount((two * np.uint32(0x27D4EB2F)) >> shift, minlength=DIMS)
    out += np.bincount((three * np.uint32(0x165667B1)) >> shift, minlength=DIMS)
    return out


def features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the TF-IDF vector of length one."""
    n = ngram_counts(text)
    at = np.flatnonzero(n)
    v = (1 + np.log(n[at])) * idf[at]
    return at, v / max(np.sqrt(v @ v), 1e-12)


def leader_weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Model:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.labels or not has_letter(text):
            return UNKNOWN, 0.0
        at, v = features(text, self.idf)
        p = softmax(self.weights[:, at] @ v / self.temperature)
        k = int(np.argmax(p))
        return self.labels[k], float(p[k])


def _labelled(docs: DataFrame, train: Column, id_col: str, text: str, label: str) -> DataFrame:
    return docs.where(train & F.col(label).isNotNull() & F.col(text).isNotNull()).select(
        F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("h"), F.col(text).alias("text"), F.col(label).cast("string").alias("label"))


def document_frequencies(rows: DataFrame) -> tuple[int, np.ndarray]:
    """Number of documents and, per place, of those with an n-gram there; summed per task before anything is sent."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMS, np.int64), 0
        for b in batches:
            for t in b.column("text").to_pylist():
                df += ngram_counts(t) > 0
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"place": pa.array(np.append(at, -1), pa.int64()), "n": pa.array(np.append(df[at], n), pa.int64())})
    total = map_rows(rows.select("text"), count, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    place, n = total.column("place").to_numpy(), total.column("n").to_numpy()
    df = np.zeros(DIMS)
    df[place[place >= 0]] = n[place >= 0]
    return int(n[place < 0].sum()), df


def fit(docs: DataFrame, train: Column | None = None, id_col: str = "doc_id", text: str = "text", label: str = "lang", sample_rows: int = 8192) -> Model:
    """Model from the rows where ``train`` holds; ``sample_rows`` is the expected size of the sample that sets the weights."""
    rows = _labelled(docs, F.lit(True) if train is None else train, id_col, text, label)
    labels = sorted(r[0] for r in rows.select("label").distinct().collect())  # one per language
    n, df = document_frequencies(rows)
    idf = np.log((1 + n) / (1 + df)) + 1
    if not labels:
        return Model([], idf, np.zeros((0, DIMS)))
    share = min(1.0, sample_rows / max(n, 1))
    # the hash of the id draws the sample; its next digits part it
    drawn = rows.where(F.pmod("h", F.lit(1_000_003)) < F.lit(share * 1_000_003))
    drawn = drawn.withColumn("part", F.pmod(F.shiftright("h", 24), F.lit(5 * PARTS)).cast("int")).repartition(PARTS, F.col("part") % PARTS)
    drawn = materialise(drawn.sortWithinPartitions("part", "h", "text"), "sample")
    sc = docs.sparkSession.sparkContext
    z = n2 = np.zeros((len(labels), DIMS))
    learn = drawn.where(F.col("part") >= PARTS)
    for _ in range(EPOCHS):
        sent = sc.broadcast((labels, idf, z, n2))
        states = learn.groupBy(F.col("part") % PARTS).applyInArrow(_epoch(sent), "z binary, n binary").collect()  # at most PARTS states of fixed size
        if states:
            z, n2 = (np.mean([np.frombuffer(s[k]).reshape(z.shape) for s in states], axis=0) for k in ("z", "n"))
        sent.destroy()
    model = Model(labels, idf, leader_weights(z, n2))
    model.temperature = _temperature(drawn.where(F.col("part") < PARTS), model)
    return model


def _epoch(sent):
    def run(table: pa.Table) -> pa.Table:
        labels, idf, z, n = sent.value
        z, n = z.copy(), n.copy()
        number = {name: k for k, name in enumerate(labels)}
        order = np.lexsort((table.column("h").to_numpy(),))
        texts, names = table.column("text").to_pylist(), table.column("label").to_pylist()
        for i in order:
            if not has_letter(texts[i]):
                continue
            at, v = features(texts[i], idf)
            zs, ns = z[:, at], n[:, at]
            w = leader_weights(zs, ns)
            err = softmax(w @ v)
            err[number[names[i]]] -= 1
            g = err[:, None] * v
            more = ns + g * g
            z[:, at] = zs + g - (np.sqrt(more) - np.sqrt(ns)) / ALPHA * w
            n[:, at] = more
        return pa.table({"z": [z.tobytes()], "n": [n.tobytes()]}, schema=pa.schema([("z", pa.binary()), ("n", pa.binary())]))
    return run


def _temperature(rows: DataFrame, model: Model) -> float:
    """The temperature with the least log loss on the rows that were kept out; 1 without any."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        total = np.zeros(len(TEMPERATURES))
        for b in batches:
            for t, name in zip(b.column("text").to_pylist(), b.column("label").to_pylist()):
                if has_letter(t):
                    at, v = features(t, m.idf)
                    p = softmax((m.weights[:, at] @ v)[None, :] / TEMPERATURES[:, None])
                    total -= np.log(np.maximum(p[:, m.labels.index(name)], 1e-12))
        yield pa.RecordBatch.from_pydict({"t": pa.array(range(len(TEMPERATURES)), pa.int32()), "loss": pa.array(total)})
    got = map_rows(rows, losses, "t int, loss double").groupBy("t").agg(F.sum("loss").alias("loss")).orderBy("loss", F.abs(F.col("t") - 32)).first()
    return float(TEMPERATURES[got["t"]]) if got and got["loss"] > 0 else 1.0


def predict(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = False) -> DataFrame:
    """Struct ``row`` (the other columns), text (if kept), lang_pred and score per document."""
    rows = docs.select(F.struct(F.lit(None).cast("string").alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row"), F.col(text).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            got = [m.predict(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({**{c: b.column(c) for c in (["row", "text"] if keep_text else ["row"])},
                                              "lang_pred": pa.array([g[0] for g in got], pa.string()), "score": pa.array([g[1] for g in got], pa.float64())})
    return map_rows(rows, run, f"row {rows.schema['row'].dataType.simpleString()}, {'text string, ' if keep_text else ''}lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(id_crc(id_col), F.lit(4)) == 2


def recognised(docs: DataFrame, model: Model, text: str = "text", min_score: float = 0.3) -> DataFrame:
    """The documents, as given, whose language is recognised with at least ``min_score``."""
    p = predict(docs, model, text, keep_text=True).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score))
    return p.select(*[F.col("text").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
