"""Integer draws, and Kendall's tau by counted inversions."""
import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.functions.draws import P, unit, with_draw
from quantloom.operators.relational import kendall


def plain(seed, keys):
    h = seed % P
    for k in [*keys, 0]:
        h = (pow((h + k) % P, 5, P) * 48271 + 1013904223) % P
    return h


def test_draws_follow_their_rule(spark):
    rows = [(3, -5), (0, 0), (2 ** 62, 2 ** 31 - 1), (-(2 ** 63), 7)]
    got = with_draw(spark.createDataFrame(rows, "a long, b long"), "h", 2 ** 40, [F.col("a"), F.col("b")]).collect()
    assert {(r["a"], r["b"]): r["h"] for r in got} == {(a, b): plain(2 ** 40, [a, b]) for a, b in rows}
    assert with_draw(spark.range(1), "h", 1, [F.lit(None).cast("long")]).first()["h"] is None


def test_draws_are_uniform_and_unrelated(spark):
    d = spark.range(200).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(100))))
    d = with_draw(with_draw(d, "r", 11, [F.col("id")]), "h", F.col("r"), [F.col("k")]).select("id", "k", unit("h").alias("u")).toPandas()
    u = d.pivot(index="id", columns="k", values="u").to_numpy()
    assert 0 < u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.01 and abs(u.var() - 1 / 12) < 0.003
    counts = np.histogram(u, 20, (0, 1))[0]
    assert ((counts - 1000) ** 2 / 1000).sum() < 45  # 19 degrees of freedom
    for m in (u, u.T):
        c = np.corrcoef(m)
        off = c[~np.eye(len(c), dtype=bool)]
        assert abs(off.mean()) < 0.01 and off.std() < 1.3 / np.sqrt(m.shape[1])


def brute_tau(pairs):
    s = a = b = 0
    for (x, y), (v, w) in itertools.combinations(pairs, 2):
        p, q = np.sign(x - v), np.sign(y - w)
        s, a, b = s + p * q, a + abs(p), b + abs(q)
    return s / np.sqrt(float(a) * float(b)) if a and b else None


def test_kendall_equals_all_pairs(spark):
    rng = np.random.default_rng(2)
    series = {0: [(1.0, 2.0)], 1: [(1.0, 5.0), (1.0, 6.0), (1.0, 7.0)], 2: [(float(i), float(-i)) for i in range(33)],
              3: [tuple(map(float, r)) for r in rng.integers(0, 6, (120, 2))], 4: [(float(x), float(x + 0.5 * e)) for x, e in rng.normal(size=(90, 2))]}
    rows = [(s, dt.date(2020, 1, 1) + dt.timedelta(days=i), *p) for s, ps in series.items() for i, p in enumerate(ps)]
    df = spark.createDataFrame([*rows, (3, dt.date(2019, 1, 1), None, 1.0), (9, dt.date(2019, 1, 1), 1.0, None)], "symbol long, date date, x double, y double")
    got = {r["symbol"]: (r["kendall"], r["n"]) for r in kendall(df, "x", "y").collect()}
    assert got.keys() == series.keys()
    for s, ps in series.items():
        want = brute_tau(ps)
        assert got[s][1] == len(ps) and (got[s][0] is None if want is None else got[s][0] == pytest.approx(want, abs=1e-12))
    assert kendall(df.limit(0), "x", "y").collect() == []
