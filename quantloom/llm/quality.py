"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Every text becomes a vector of statistics (lengths, shares of character kinds, repetition, word
shapes), transformed to be closer to normal.  Each class has a mean and a covariance, shrunk first
towards the pooled covariance, then towards a multiple of the identity; its Cholesky factor is computed
once and sent along.  The score is the logistic of the difference of the log densities plus log priors.

Training sums first and second moments of every labelled row inside the tasks; one row of sums per
class reaches the driver.

Defined cases: null and empty texts have the statistics of an empty text and get a score; without
rows of both classes the score is the share of class 1, or 0.5 without any labelled row; a label row
counts once per document row with its id; null labels and ids that do not meet teach nothing.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import id_crc, map_rows, materialise, utf8

#: Shrinkage of a class covariance towards the pooled one, and of both towards the identity.
POOL, RIDGE = 0.1, 0.02
#: Kinds of bytes: lower, upper, digit, blank, line end, sentence mark, other ASCII, non-ASCII.
_KIND = np.full(256, 6, np.uint8)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 0, 1, 2, 7
_KIND[[32, 9]], _KIND[[10, 13]], _KIND[[ord(c) for c in ".,;:"]] = 3, 4, 5
STATISTICS = 18


def statistics(text: bytes | None) -> np.ndarray:
    """Transformed statistics of one text."""
    text = text or b""
    n = len(text)
    share = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=8) / max(n, 1)
    words = text.split()
    k = len(words)
    different = set(words)
    lines = text.split(b"\n")
    once = np.array([*map(len, words)] or [0], float)
    # neighbours that repeat, as in "word word word"
    twice = sum(map(bytes.__eq__, words, words[1:])) if k > 1 else 0
    pairs = len(set(zip(words, words[1:]))) if k > 1 else 0
    ends = sum(w.endswith((b".", b"!", b"?")) for w in words)
    bangs = sum(w.endswith((b"!", b"?")) for w in words)
    capital = sum(w[:1].isupper() for w in words)
    logit = lambda p: np.log((p + 0.005) / (1.005 - p))
    return np.array([
        np.log1p(n), np.log1p(k), *[logit(share[i]) for i in (1, 2, 3, 5, 6, 7)], np.log1p(once.mean()), np.log1p(once.std()),
        logit(len(different) / max(k, 1)), logit(twice / max(k, 1)), logit(pairs / max(k - 1, 1)), logit(ends / max(k, 1)), logit(bangs / max(k, 1)),
        logit(capital / max(k, 1)), np.log1p(len(lines)), logit(1 - len(set(lines)) / len(lines))])


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and constants of both classes; ``share`` serves where they are missing."""
    share: float
    mean: list[np.ndarray]
    factor: list[np.ndarray]
    constant: list[float]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.mean:
            return np.full(len(x), self.share)
        log = []
        for mean, factor, constant in zip(self.mean, self.factor, self.constant):
            y = (x - mean) @ factor.T  # |y|^2 is the squared Mahalanobis distance
            log.append(constant - 0.5 * (y * y).sum(axis=1))
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def from_moments(counts: np.ndarray, sums: np.ndarray, squares: np.ndarray) -> Discriminant:
    total = counts.sum()
    share = float(counts[1] / total) if total else 0.5
    if counts.min() < 2:
        return Discriminant(share, [], [], [])
    means = [s / c for s, c in zip(sums, counts)]
    own = [q / c - np.outer(m, m) for q, c, m in zip(squares, counts, means)]
    pooled = sum(c * s for c, s in zip(counts, own)) / total
    factors, constants = [], []
    for k in (0, 1):
        cov = (1 - POOL) * own[k] + POOL * pooled
        cov = (1 - RIDGE) * cov + RIDGE * max(np.trace(pooled) / len(pooled), 1e-6) * np.eye(len(pooled))
        lower = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(lower))
        constants.append(float(np.log(counts[k] / total) - np.log(np.diag(lower)).sum()))
    return Discriminant(share, means, factors, constants)


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the vector ``x`` of every document, one pass over the texts."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t) for t in utf8(b.column("text"))]).reshape(-1, STATISTICS)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "x": pa.array([*x], pa.list_(pa.float64()))})
    return map_rows(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, x array<double>")


def _matrix(x: pa.Array) -> np.ndarray:
    return x.flatten().to_numpy().reshape(-1, STATISTICS)


def fit(vectors: DataFrame, labels: DataFrame, train: Column, label: str = "quality") -> Discriminant:
    """Discriminant of label 0 and 1 from the vectors (doc_id, x) of the rows where ``train`` holds."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("label in (0, 1)")
    rows = vectors.where(train).join(known, "doc_id").select("x", "label")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, s, q = np.zeros(2), np.zeros((2, STATISTICS)), np.zeros((2, STATISTICS, STATISTICS))
        for b in batches:
            x, y = _matrix(b.column("x")), b.column("label").to_numpy()
            for k in (0, 1):
                z = x[y == k]
                count[k], s[k], q[k] = count[k] + len(z), s[k] + z.sum(axis=0), q[k] + z.T @ z
        flat = np.concatenate([count, s.ravel(), q.ravel()])
        yield pa.RecordBatch.from_pydict({"place": pa.array(range(len(flat)), pa.int32()), "value": pa.array(flat)})
    got = map_rows(rows, moments, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()  # a few hundred sums
    flat = np.zeros(2 + 2 * STATISTICS + 2 * STATISTICS ** 2)
    for r in got:
        flat[r["place"]] = r["value"]
    return from_moments(flat[:2], flat[2:2 + 2 * STATISTICS].reshape(2, -1), flat[2 + 2 * STATISTICS:].reshape(2, STATISTICS, STATISTICS))


def score(vectors: DataFrame, model: Discriminant, limit: float = 0.3) -> DataFrame:
    """doc_id, score and predicted (1 from ``limit`` on)."""
    sent = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = sent.value.scores(_matrix(b.column("x")))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "score": pa.array(s), "predicted": pa.array((s >= limit).astype(np.int32))})
    return map_rows(vectors, run, f"doc_id {vectors.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(id_crc(id_col), F.lit(5)) == 0


def classify(docs: DataFrame, labels: DataFrame, train: Column | None = None, limit: float = 0.3) -> DataFrame:
    """doc_id, score and predicted for every document; learned from the labels where ``train`` holds."""
    vectors = materialise(with_statistics(docs), "statistics")
    return score(vectors, fit(vectors, labels, F.lit(True) if train is None else train), limit)
