"""Market structure by cells of symbol blocks, distances of small graphs, staged bars, small report and model parts."""
import datetime as dt
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quantloom.operators import learning as L
from quantloom.operators import network as NW
from quantloom.operators import quality as DQ
from quantloom.plans.registry import ENTRIES


def brute_structure(ret, vol, n, threshold, least):
    out = {}
    for end in range(n, len(ret) + 1):
        r, v = ret.iloc[end - n:end], vol.iloc[end - n:end]
        syms = list(r.columns)
        vc, rc = v.corr(min_periods=least), r.corr(min_periods=least)
        upper = [(a, b) for i, a in enumerate(syms) for b in syms[i + 1:]]
        nodes = int(v.notna().any().sum())
        market = ret.mean(axis=1).iloc[end - n:end]
        fits = [r[a].corr(market, min_periods=least) ** 2 for a in syms]
        lags = [abs(r[a].corr(r[b].shift(1), min_periods=least)) for a in syms for b in syms if a != b]
        edges = sum(abs(vc.loc[a, b]) > threshold for a, b in upper)
        out[ret.index[end - 1]] = (nodes, edges, 2 * edges / (nodes * (nodes - 1)), np.nanmean(fits), 1 - np.nanmean([rc.loc[a, b] for a, b in upper]), 1 - np.nanmean(lags))
    return out


@pytest.mark.parametrize("block, span", [(512, 16), (3, 4), (2, 40)])
def test_structure_equals_pair_enumeration(spark, block, span):
    rng = np.random.default_rng(3)
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(40)]
    common = rng.normal(size=(40, 1))
    ret = pd.DataFrame(rng.normal(size=(40, 9)) + common, index=days)
    vol = pd.DataFrame(np.exp(rng.normal(size=(40, 9)) + 0.8 * rng.normal(size=(40, 1))) * 1e6, index=days)
    hole = rng.random((40, 9)) < 0.2
    hole[:25, 8] = True  # listed late: pairs with too few dates in common
    ret, vol = ret.mask(hole), vol.mask(hole)
    rows = [(s, d, float(ret.loc[d, s]), float(vol.loc[d, s])) for d in days for s in range(9) if not np.isnan(ret.loc[d, s])]
    df = spark.createDataFrame(rows, "symbol long, date date, ret double, volume double")
    got = {r["date"]: tuple(r)[1:] for r in NW.structure_series(df, 12, 0.3, 0.5, block, span).collect()}
    want = brute_structure(ret, vol, 12, 0.3, 6)
    assert got.keys() == want.keys() and len({v[1] for v in want.values()}) > 3
    for d in want:
        assert got[d] == pytest.approx(want[d], abs=1e-9)


def test_windows_of_pairs_with_gaps(spark):
    rng = np.random.default_rng(8)
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(40)]
    v = pd.DataFrame(rng.normal(size=(40, 4)), index=days).mask(rng.random((40, 4)) < 0.15)
    v.iloc[10:22, 1] = np.nan  # longer than a window
    v.iloc[25:, 2] = np.nan  # ends early
    rows = [(s, d, float(v.loc[d, s])) for s in range(4) for d in days if not np.isnan(v.loc[d, s])]
    corr, nodes = NW.windowed_network(spark.createDataFrame(rows, "symbol long, date date, ret double"), 8)
    got = {(r["date"], r["a"], r["b"]): r["corr"] for r in corr.collect()}
    want, alive = {}, set()
    for e in range(8, 41):
        w = v.iloc[e - 8:e]
        alive |= {(days[e - 1], s) for s in range(4) if w[s].notna().any()}
        want |= {(days[e - 1], a, b): w[a].corr(w[b]) for a in range(4) for b in range(a + 1, 4) if (w[a].notna() & w[b].notna()).sum() >= 4}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert {tuple(r) for r in nodes.collect()} == alive


def test_structure_of_flat_single_and_empty(spark):
    schema = "symbol long, date date, ret double, volume double"
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(6)]
    flat = spark.createDataFrame([(s, d, 0.0, 5.0) for s in (1, 2) for d in days], schema)
    rows = NW.structure_series(flat, 4).collect()
    assert len(rows) == 3 and all(r["edges"] == 0 and r["nodes"] == 2 and r["segmentation"] is None and r["price_discovery"] == 0 for r in rows)
    one = NW.structure_series(flat.where("symbol = 1"), 4).collect()
    assert [(r["nodes"], r["liquidity_density"]) for r in one] == [(1, 0.0)] * 3
    assert NW.structure_series(spark.createDataFrame([], schema), 4).collect() == []


def hops(spark, k, edges):
    m = np.zeros((k, k), int)
    for a, b in edges:
        m[a, b] = m[b, a] = 1
    d = spark.range(1).withColumn("h", NW.hop_counts(F.array(*[F.lit(int(x)) for x in m.ravel()]), k)).withColumn("p", NW.path_length("h", k)).first()
    return np.array(d["h"]).reshape(k, k), d["p"]


def test_distances_of_small_graphs(spark):
    h, p = hops(spark, 5, [(0, 1), (2, 3), (3, 4)])  # a pair and a chain of three
    assert h[0, 1] == 1 and h[2, 4] == 2 and h[0, 2] == 5 and np.diag(h).sum() == 0
    assert p == pytest.approx((1 + 1 + 2) * 2 / 6)
    assert hops(spark, 4, [])[1] == float("inf")
    assert hops(spark, 4, [(0, 1), (2, 3)])[1] == 1.0  # equal components
    assert hops(spark, 6, [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 0)])[1] == pytest.approx((1 + 1 + 2 + 2 + 3) / 5)


def test_feature_network_of_two_pairs(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=60), rng.normal(size=60)
    rows = [(1, dt.date(2020, 1, 1) + dt.timedelta(days=i), float(a[i]), float(2 * a[i] + 1), float(b[i]), float(-b[i])) for i in range(60)]
    df = spark.createDataFrame(rows, "symbol long, date date, a double, a2 double, b double, b2 double")
    got = [r for r in NW.feature_network(df, ["a", "a2", "b", "b2"]).orderBy("date").collect() if r["density"] is not None]
    assert len(got) == 11 and all(r["density"] == pytest.approx(2 / 6) and r["centrality"] == pytest.approx(1 / 3) and r["path_length"] == 1 for r in got)


def test_report_counts_repeated_rows(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 3.0), (2, 3.0), (2, 3.0), (4, 5.0)], "a long, b double")
    assert {r["duplicates"] for r in DQ.report(df, ["a", "b"]).collect()} == {3}
    assert {r["duplicates"] for r in DQ.report(df.limit(0), ["a"]).collect()} == {0}


def planted(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    y = 2 * x[:, 0] - x[:, 1] + 0.1 * rng.normal(size=400)
    rows = [(i % 4, dt.date(2020, 1, 1) + dt.timedelta(days=i // 4), *map(float, x[i]), float(y[i])) for i in range(400)]
    return spark.createDataFrame(rows, "symbol long, date date, f0 double, f1 double, f2 double, fwd double")


def test_lasso_importance_finds_the_planted_features(spark):
    got = {r["feature"]: r for r in L.importance(planted(spark), ["f0", "f1", "f2"]).collect()}
    assert got["f0"]["lasso_importance"] == 1 and got["f1"]["lasso_importance"] == pytest.approx(0.5, abs=0.05) and got["f2"]["lasso_importance"] < 0.02
    assert got["f0"]["consensus"] == pytest.approx(1) and got["f2"]["consensus"] < 0.2


def test_forest_predictions_follow_the_target(spark):
    d = L.linear_predictions(planted(spark), ["f0", "f1", "f2"], forest=True).toPandas()
    assert np.corrcoef(d.fwd, d.p_forest)[0, 1] > 0.85 and np.corrcoef(d.fwd, d.p_importance)[0, 1] > 0.85


STAGED = [n for n, e in ENTRIES.items() if e.staged]


@pytest.mark.parametrize("name", ["risk_metrics_comprehensive", "performance_attribution", "factor_score_weighted"])
def test_staged_queries_leave_the_source_alone(spark, name):
    assert name in STAGED
    df = entry.queries()[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "lineitem.parquet" not in plan


def test_mean_correlation_builds_its_map_once_per_row(spark):
    """A map inlined into the lambda over the slots would be built once per slot."""
    df = spark.createDataFrame([(s, dt.date(2020, 1, 1) + dt.timedelta(days=i), float(s * i % 5)) for s in range(3) for i in range(8)], "symbol long, date date, ret double")
    plan = NW.group_mean_correlation(df, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "map_from_entries" in plan and "element_at(map_from_entries" not in plan


def test_strips_are_sent_to_a_bounded_number_of_tasks(spark):
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(6)]
    df = spark.createDataFrame([(s, d, 0.1 * ((s + i) % 5), float(s + i * i)) for s in range(20) for i, d in enumerate(days)], "symbol long, date date, ret double, volume double")
    d = NW.structure_series(df, 4, block=1)  # twenty blocks
    copies = re.findall(r"sequence\(0, (\d+)", d._jdf.queryExecution().analyzed().toString())
    assert copies and all(int(c) < NW.LANES for c in copies)
    assert [tuple(r)[1:] for r in d.orderBy("date").collect()] == [pytest.approx(tuple(r)[1:], abs=1e-9) for r in NW.structure_series(df, 4).orderBy("date").collect()]


@pytest.mark.parametrize(("n", "windows"), [(52, 32), (52, 1), (5, 40), (1, 3)])
def test_sliding_correlations_share_the_common_dates(monkeypatch, n, windows):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(7, n + windows - 1)), rng.normal(size=(5, n + windows - 1))
    x[0, :4] = 1e7  # far off, in the first windows only: later ones must not bear its rounding
    x[1] = 0.1  # does not vary
    x[rng.random(x.shape) < 0.2] = np.nan
    y[rng.random(y.shape) < 0.2] = np.nan
    y[2] = np.nan
    done = []
    real = NW._products
    monkeypatch.setattr(NW, "_products", lambda a, b, to: (done.append(a.shape[2]), real(a, b, to)))
    got = [(c.copy(), ok.copy()) for c, ok in NW.sliding_corr(x, y, n, n / 2)]
    assert len(got) == windows
    for w, (c, ok) in enumerate(got):
        want, k = NW.complete_corr(x[:, w:w + n], y[:, w:w + n])
        count = (k >= n / 2) & ~np.isnan(want)
        assert (ok == count).all() and (c[~ok] == 0).all()
        part = slice(1 if w < 4 else 0, None)  # a pair that lacks the far dates loses digits beside them, in either way
        np.testing.assert_allclose(c[part][ok[part]], want[part][ok[part]], atol=1e-9)
    if windows > 30 and n > 50:
        assert sum(done) < n * windows / 3  # dates multiplied; a window for itself takes n
