"""Models compute their features once, however many passes a fit makes."""
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.functions import exact
from quantloom.operators import learning as L
from quantloom.operators import macro as MA

COLS = ["x", "z"]


@pytest.mark.parametrize("model", [L.ensemble, lambda d, c: L.linear_predictions(d, c, forest=True), L.importance, L.kmeans_cluster], ids=["ensemble", "linear", "importance", "kmeans"])
def test_features_are_computed_once(spark, model):
    rng = np.random.default_rng(2)
    rows = [(i % 4, dt.date(2020, 1, 1) + dt.timedelta(days=i // 4), float(x), float(z), float(2 * x - z)) for i, (x, z) in enumerate(rng.normal(size=(200, 2)))]
    df = spark.createDataFrame(rows, "symbol long, date date, raw double, z double, fwd double")
    seen = spark.sparkContext.accumulator(0)

    def counted(v):
        seen.add(1)
        return v
    model(df.withColumn("x", F.udf(counted, "double", useArrow=False)("raw")), COLS).collect()
    assert seen.value == 200


def test_stability_computes_features_once(spark):
    rng = np.random.default_rng(4)
    n = 300
    raw = rng.normal(size=n)
    rows = [(i % 3, dt.date(2020, 1, 1) + dt.timedelta(days=i // 3), None if i % 50 == 0 else float(v)) for i, v in enumerate(raw)]
    df = spark.createDataFrame(rows, "symbol long, date date, raw double").withColumn("z", F.lit(None).cast("double"))
    seen = spark.sparkContext.accumulator(0)

    def counted(v):
        seen.add(1)
        return v
    got = L.feature_stability(df.withColumn("x", F.udf(counted, "double", useArrow=False)("raw")), COLS).collect()
    assert seen.value == n
    assert [r["factor"] for r in got] == ["x"]  # z has no value
    known = np.arange(n) % 50 != 0
    period = np.arange(n) // 3 * 5 // 100 + 1
    m = np.array([raw[known & (period == p)].mean() for p in range(1, 6)])
    s = np.array([raw[known & (period == p)].std(ddof=1) for p in range(1, 6)])
    a, b = np.sort(raw[known & (period <= 2)]), np.sort(raw[known & (period > 2)])
    ks = np.abs(np.searchsorted(a, raw[known], "right") / len(a) - np.searchsorted(b, raw[known], "right") / len(b)).max()
    cv = m.std(ddof=1) / abs(m.mean())
    want = [cv, s.std(ddof=1) / s.mean(), np.polyfit(range(1, 6), m, 1)[0], ks, max(100 - 50 * min(cv, 1) - 50 * ks, 0)]
    np.testing.assert_allclose([got[0][c] for c in ("mean_cv", "std_cv", "trend", "ks", "score")], want, rtol=1e-9)


def test_regime_distance_writes_nothing_and_equals_brute_force(spark, monkeypatch):
    def refuse(df, tag="stage"):
        raise AssertionError(f"wrote {tag}")
    monkeypatch.setattr(exact, "materialise", refuse)
    rng = np.random.default_rng(6)
    series = {1: np.round(rng.normal(size=41), 1), 2: np.r_[rng.normal(size=30), rng.normal(3, 1, 30)], 3: np.full(8, 0.5), 4: np.array([0.1])}
    rows = [(k, dt.date(2020, 1, 1) + dt.timedelta(days=i), float(v)) for k, x in series.items() for i, v in enumerate(x)]
    rows += [(1, dt.date(2019, 1, 1), None), (5, dt.date(2020, 1, 1), None)]
    got = {r["symbol"]: r for r in L.regime_change(spark.createDataFrame(rows, "symbol long, date date, ret double").repartition(3)).collect()}
    assert set(got) == set(series)
    for k, x in series.items():
        n = len(x)
        a, b = np.sort(x[:n // 2]), np.sort(x[n // 2:])
        if n > 1:
            want = np.abs(np.searchsorted(a, x, "right") / len(a) - np.searchsorted(b, x, "right") / len(b)).max()
            assert abs(got[k]["ks"] - want) < 1e-12
        assert (got[k]["n"], got[k]["changed"]) == (n, int(k == 2))
    assert got[4]["ks"] is None and got[3]["t_stat"] is None


def test_rotation_signals_compute_the_performance_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(v):
        seen.add(1)
        return v
    perf = spark.createDataFrame([(k, float(k), 1.0, 1.0) for k in range(1, 10)], "symbol long, raw double, return_20d double, return_60d double")
    perf = perf.withColumn("volatility_ann", F.udf(counted, "double", useArrow=False)("raw"))
    rs = spark.createDataFrame([(k, 50.0, 0.0) for k in range(1, 10)], "symbol long, rs_percentile_20d double, rs_20d double")
    got = {r["symbol"]: r["volatility_class"] for r in MA.rotation_signals(rs, perf).collect()}
    assert seen.value == 9  # the quartile and what is compared with it are the same numbers
    assert got == {k: "low" if k < 3 else "high" if k > 7 else "normal" for k in range(1, 10)}
