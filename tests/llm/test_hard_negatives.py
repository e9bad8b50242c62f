"""Hard negatives against a brute-force version."""
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quantloom.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, rank int, id string, score double, cell int"


def brute(rows, k=5, n=5, low=80, high=100, every=10):
    """The contract with Python integers; ``rows`` are (id, vector, label)."""
    least = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * x) for x in v]
        least[i] = min(least.get(i, (label, q)), (label, q))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, (label, q) in least.items():
        if a % every:
            continue
        others = sorted(((-dot(q, w), i, m) for i, (m, w) in least.items() if i != a))
        for minus, p, m in [o for o in others if o[2] == label][:k]:
            fit = [(i, -s) for s, i, m2 in others if m2 != label and low * -minus <= high * -s <= high * -minus][:n]
            out += [(a, p, r, i, -minus, s) for r, (i, s) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, "x", 0.5, 2) for r in rows], SCHEMA).repartition(3)
    got = hn.mine(df, F.col("id") % 10 == 0, **kw)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


@pytest.fixture(scope="module")
def clustered():
    """Few directions, so that many scores are equal; a hot label; ids out of order."""
    rng = random.Random(7)
    base = [[rng.choice([-0.5, 0.25, 0.5, 1.0]) for _ in range(6)] for _ in range(4)]
    return [(i, [x + rng.choice([0, 0, 0.004, -0.004]) for x in rng.choice(base)], rng.choice([1, 1, 1, 2, 3])) for i in rng.sample(range(500), 260)]


def test_equals_brute_force(spark, clustered):
    want = brute(clustered)
    assert len(want) > 400 and mined(spark, clustered) == want


def test_cells_do_not_matter(spark, clustered):
    """Many small cells and blocks, one answer."""
    assert mined(spark, clustered, cell=150) == brute(clustered)
    assert mined(spark, clustered, positives=2, negatives=7, low=50) == brute(clustered, k=2, n=7, low=50)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, 0.25], 1), (2, [0.9, 0.5], 2), (2, [0.9, 0.5], 2), (3, None, 1), (4, [1.0, None], 1), (5, [nan, 1.0], 2), (6, [inf, 1.0], 2), (None, [1.0, 1.0], 2),
            (7, [1.0, 1.0], None), (10, [], 1), (20, [2.0, 1.0, 5.0], 3), (30, [0.9, 0.5], 1), (30, [0.9, 0.5], 2), (40, [-3.0, -3.0], 2), (11, [0.95], 2), (-10, [0.5, 0.5], 1), (50, [0.0, 0.0], 2)]
    want = brute(rows)
    assert want and mined(spark, rows) == want
    assert mined(spark, []) == [] == mined(spark, [(10, [1.0], 1)]) == mined(spark, [(1, [1.0], 1), (2, [1.0], 2)])


def test_scores_beyond_doubles_are_exact(spark):
    rng = random.Random(5)
    rows = [(i, [float(rng.randint(2**22, 2**22 + 40)), rng.random(), 3.0], i % 3) for i in range(60)]
    want = brute(rows)
    assert max(r[4] for r in want) > 2**53 and mined(spark, rows) == want


def test_best_of_every_row():
    rng = np.random.default_rng(1)
    for _ in range(200):
        s, open_ = rng.integers(-3, 4, (4, 9)).astype(float), rng.random((4, 9)) < rng.random()
        i, j = hn.best(s, open_, 3)
        want = [(a, b) for a in range(4) for b in sorted(np.flatnonzero(open_[a]), key=lambda c, a=a: (-s[a, c], c))[:3]]
        assert sorted(zip(i.tolist(), j.tolist())) == sorted((a, int(b)) for a, b in want)
    lists = pa.chunked_array([pa.array([[1, 2], [], [3]], pa.list_(pa.int64()))])
    assert hn.matrix(lists, 2).tolist() == [[1, 2], [0, 0], [3, 0]]
