"""Window kernels over streamed rows: values against numpy, and what the plans do per row."""
import datetime as dt
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import cross_section as CS
from quantloom.operators import network as NW
from quantloom.operators import signals as G
from quantloom.operators import timing as TI


@pytest.fixture
def small_batches(spark):
    """Batches of a few rows, so that windows and series cross them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


COLS = ["a", "b", "c", "d"]


def walks(spark, sizes=(30, 5, 23), hole=(0, 20, "b"), flat=2):
    """Series of several lengths with one NULL; the last column of series ``flat`` is constant."""
    rng = np.random.default_rng(3)
    rows = []
    for sym, n in enumerate(sizes):
        x = rng.normal(size=(n, 4)).cumsum(axis=0)
        for i in range(n):
            v = dict(zip(COLS, map(float, x[i])))
            if sym == flat:
                v["d"] = 0.1
            if (sym, i) == hole[:2]:
                v[hole[2]] = None
            rows.append((sym, dt.date(2020, 1, 1) + dt.timedelta(days=i), *v.values()))
    return spark.createDataFrame(rows, "symbol long, date date, a double, b double, c double, d double")


def test_feature_network_across_batches(spark, small_batches):
    df, n = walks(spark), 8
    got = NW.feature_network(df, COLS, n).toPandas().sort_values(["symbol", "date"])
    src = df.toPandas().sort_values(["symbol", "date"])
    assert len(got) == len(src) and list(got.columns[:6]) == df.columns
    for sym, g in src.groupby("symbol"):
        x, rows = g[COLS].to_numpy(float), got[got.symbol == sym].to_dict("records")
        for i, row in enumerate(rows):
            w = x[i - n + 1:i + 1] if i >= n - 1 else np.full((n, 4), np.nan)
            c = {p: np.corrcoef(w[:, p[0]], w[:, p[1]])[0, 1] if np.isfinite(w[:, p]).all() and np.ptp(w[:, p], axis=0).min() > 0 else np.nan for p in combinations(range(4), 2)}
            if np.isnan(c[0, 1]):
                assert np.isnan(row["density"]) and np.isnan(row["path_length"])
                continue
            e = sum(abs(v) > 0.5 for v in c.values())
            assert row["density"] == pytest.approx(e / 6)
            mean = np.mean(np.abs(list(c.values())))
            assert np.isnan(row["mean_abs_corr"]) if np.isnan(mean) else row["mean_abs_corr"] == pytest.approx(mean)


def test_feature_network_measures_graphs_once(spark):
    plan = plan_of(NW.feature_network(walks(spark), COLS, 8))
    assert "Window" not in plan  # no frame is summed up again for every row
    assert "Range (0, 64" in plan and "BroadcastHashJoin" in plan  # the graphs of four nodes, not of the rows


def test_feature_network_of_many_features(spark):
    df = walks(spark).withColumn("e", F.col("a") * F.col("b")).withColumn("f", F.col("c") - F.col("d"))  # 15 edges: not tabulated
    got = NW.feature_network(df, [*COLS, "e", "f"], 8)
    assert got.where("density is not null and path_length is null").count() == 0 and got.where("density is not null").count() > 0
    few = NW.feature_network(df, COLS, 8).select("symbol", "date", F.col("density").alias("d4"))
    assert got.join(few, ["symbol", "date"]).where("density is null and d4 is not null").count() == 0


def test_higher_moments_across_batches(spark, small_batches):
    n = 8
    df = walks(spark, flat=None).select("symbol", "date", F.exp("a").alias("close"), "b").withColumn("close", F.when((F.col("symbol") == 2) & (F.col("b").isNull() | (F.dayofmonth("date") == 12)), None).otherwise(F.col("close")))
    df = df.unionByName(df.where("symbol = 2").withColumns({"symbol": F.lit(9).cast("long"), "close": F.lit(3.7)}))  # no moments without variance
    df = df.drop("b")
    got = TI.higher_moments(df, n).toPandas().sort_values(["symbol", "date"])
    assert len(got) == df.count()
    for sym, g in got.groupby("symbol"):
        r = np.diff(np.log(g["close"].to_numpy(float)), prepend=np.nan)
        for i, row in enumerate(g.to_dict("records")):
            w = r[i - n + 1:i + 1] if i >= n - 1 else np.array([np.nan])
            if not np.isfinite(w).all() or sym == 9:
                assert np.isnan(row["skew"]) and np.isnan(row["moment_6"]) and np.isnan(row["jarque_bera"])
                continue
            d = w - w.mean()
            m = {k: (d ** k).mean() for k in range(2, 7)}
            skew = m[3] / m[2] ** 1.5 * (n * (n - 1)) ** 0.5 / (n - 2)
            kurt = ((m[4] / m[2] ** 2 - 3) * (n + 1) + 6) * (n - 1) / ((n - 2) * (n - 3))
            assert [row[c] for c in ("skew", "kurt", "excess", "jarque_bera", "moment_5", "moment_6")] == pytest.approx(
                [skew, kurt, kurt - 3, n / 6 * (skew ** 2 + (kurt - 3) ** 2 / 4), m[5] / m[2] ** 2.5, m[6] / m[2] ** 3], rel=1e-6)


def test_higher_moments_sums_no_frame_per_row(spark):
    assert "RowFrame, -7" not in plan_of(TI.higher_moments(walks(spark).withColumn("close", F.exp("a")), 8))


def test_fuse_ranks_inside_the_series(spark):
    df = spark.createDataFrame([(s, dt.date(2020, 1, 1) + dt.timedelta(days=i), x, y) for s in (1, 2) for i, (x, y) in enumerate([(1.0, None), (0.0, 5.0), (-0.0, 5.0), (None, None), (3.0, 1.0)])],
                               "symbol long, date date, x double, y double")
    got = G.fuse(df, ["x", "y"], [0.5, 0.5])
    assert "BroadcastHashJoin" not in plan_of(got) and "SortMergeJoin" not in plan_of(got)  # the series stays in one task: no join, no sketch
    rows = got.where("symbol = 2").orderBy("date").collect()
    # ranks of x: 3/4, 1.5/4, 1.5/4, -, 4/4; of y: -, 2.5/3, 2.5/3, -, 1/3
    assert [r["rank_mean"] for r in rows] == [pytest.approx(v) if v is not None else None for v in (0.75, (0.375 + 2.5 / 3) / 2, (0.375 + 2.5 / 3) / 2, None, (1 + 1 / 3) / 2)]
    assert [r["median"] for r in rows] == [1.0, 2.5, 2.5, None, 2.0] and rows[3]["weighted"] == 0


def test_liquidity_shock_at_the_limit(spark):
    # the last volume is exactly mean + 2 deviations, no shock; one more is one (mean + 2 deviations moves by less than one)
    windows = [[1, 6, 10, 1, 7, 3, 11, 8, 10, 9, 8, 9, 1, 3, 12, 5, 8, 2, 11, 7, 15], [4, 6, 2, 6, 7, 7, 2, 5, 2, 3, 2, 3, 1, 6, 4, 4, 3, 3, 4, 2, 8],
               [1, 4, 5, 7, 3, 5, 3, 5, 4, 1, 2, 3, 6, 3, 6, 2, 2, 3, 7, 4, 8]]
    series = {10 * k + more: [float(x) for x in w[:-1]] + [float(w[-1] + more)] for k, w in enumerate(windows) for more in (0, 1)}
    rng = np.random.default_rng(5)
    series[100] = (1e9 + rng.normal(size=60)).tolist()
    series[101] = [5.0] * 30
    series[102] = [None if i == 25 else float(i * i % 13) for i in range(50)]
    rows = [(k, dt.date(2020, 1, 1) + dt.timedelta(days=i), 10.0 + i % 3, x) for k, v in series.items() for i, x in enumerate(v)]
    got = {(r["symbol"], r["date"].toordinal() - dt.date(2020, 1, 1).toordinal()): r for r in CS.liquidity_state(spark.createDataFrame(rows, "symbol long, date date, close double, volume double"), 24).collect()}
    for k in range(len(windows)):
        assert [got[(10 * k + more, 20)]["liquidity_shock_state"] for more in (0, 1)] == [0, 1]
    for k in (100, 101, 102):
        for i, x in enumerate(series[k]):
            w = np.array([np.nan if y is None else y for y in series[k][max(0, i - 20):i + 1]])
            full = len(w) == 21 and np.isfinite(w).all()
            assert got[(k, i)]["liquidity_shock_state"] == int(full and x - w.mean() > 2 * w.std(ddof=1))
            assert (got[(k, i)]["_vv"] == pytest.approx(w.std(ddof=1), rel=1e-6, abs=1e-9)) if full else got[(k, i)]["_vv"] is None


def test_fuse_first_component(spark):
    rng = np.random.default_rng(8)
    n = 40
    base = rng.normal(size=n)
    series = {1: [base, -base + 0.3 * rng.normal(size=n), rng.normal(size=n)], 2: [base, 2 * base + rng.normal(size=n), np.zeros(n)],  # the last signal does not vary
              3: [np.zeros(n), np.zeros(n), np.zeros(n)], 4: [base, rng.normal(size=n), np.full(n, np.nan)]}
    rows = [(k, dt.date(2020, 1, 1) + dt.timedelta(days=i), *[None if np.isnan(x[i]) or i < 3 and k == 1 else float(x[i]) for x in v]) for k, v in series.items() for i in range(n)]
    got = {}
    for r in G.fuse(spark.createDataFrame(rows, "symbol long, date date, x double, y double, z double"), ["x", "y", "z"], [0.5, 0.3, 0.2]).orderBy("symbol", "date").collect():
        got.setdefault(r["symbol"], []).append(r["pca"])
    for k, v in series.items():
        m = np.nan_to_num(np.stack(v, axis=1))
        if k == 1:
            m[:3] = 0
        sd = m.std(axis=0)
        u = (m - m.mean(axis=0)) / np.where(sd > 0, sd, 1)
        lead = np.linalg.svd(u)[2][0] if k != 3 else np.zeros(3)
        top = (np.abs(lead) > np.abs(lead).max() - 1e-9).argmax()
        assert got[k] == pytest.approx((u @ lead * (np.sign(lead[top]) or 1)).tolist(), abs=1e-9)
