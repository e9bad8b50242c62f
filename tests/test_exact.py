"""Distributed ranks and quantiles on data where one value holds a third of all rows."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.functions import exact
from quantloom.functions.exact import bucketed, quantiles, ranks, sorted_ranks, two_sample_ks
from quantloom.operators.cross_section import relative_ranks
from quantloom.operators.factors import ic_by_date
from quantloom.operators.relational import bucketize, label_encode, top_fraction, top_n


def skewed(spark, n=3000):
    rng = np.random.default_rng(5)
    x = np.where(rng.random(n) < 0.34, 7.0, np.round(rng.normal(0, 5, n), 2))
    g = np.where(rng.random(n) < 0.5, "hot", rng.integers(0, 4, n).astype(str))
    pdf = pd.DataFrame({"id": range(n), "g": g, "x": x})
    pdf.loc[::97, "x"] = None
    return pdf, spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x"))).repartition(6)


def test_ranks(spark):
    pdf, df = skewed(spark)
    got = ranks(df, ["id"], ["g"], {"lo": ("x", "min"), "av": ("x", "avg"), "row": ("x", "row")}).toPandas().set_index("id").sort_index()
    r = pdf.groupby("g")["x"]
    for name, want in (("lo", r.rank(pct=True, method="min")), ("av", r.rank(pct=True)), ("row", r.rank(method="min"))):
        np.testing.assert_allclose(got[name], want.dropna())


def test_quantiles(spark):
    pdf, df = skewed(spark)
    got = quantiles(df, ["g"], "x", [0.05, 0.5, 0.95], ["a", "b", "c"]).toPandas().set_index("g").sort_index()
    for q, c in ((0.05, "a"), (0.5, "b"), (0.95, "c")):
        np.testing.assert_allclose(got[c], pdf.groupby("g")["x"].quantile(q))
    one = quantiles(df, [], "x", [0.25], ["q"]).first()["q"]
    assert abs(one - pdf["x"].quantile(0.25)) < 1e-12


def test_two_sample_distance(spark):
    pdf, df = skewed(spark)
    got = two_sample_ks(df, [], "x", F.col("id") < 1000).first()["ks"]
    v = pdf.dropna()
    grid = np.sort(v["x"].unique())
    a, b = np.sort(v[v.id < 1000]["x"]), np.sort(v[v.id >= 1000]["x"])
    want = np.abs(np.searchsorted(a, grid, "right") / len(a) - np.searchsorted(b, grid, "right") / len(b)).max()
    assert abs(got - want) < 1e-12


def distance(v, a):
    """Distance of two samples by brute force."""
    grid, x, y = np.unique(v), np.sort(v[a]), np.sort(v[~a])
    return np.abs(np.searchsorted(x, grid, "right") / len(x) - np.searchsorted(y, grid, "right") / len(y)).max()


def test_two_sample_distance_of_like_halves_orders_few_rows(spark, monkeypatch):
    n = 20000
    rng = np.random.default_rng(8)
    v = np.concatenate([rng.normal(0.2 * (np.arange(n) % 2), 1), np.round(rng.normal(size=n), 1), np.full(n, 3.0), [1.0, 2.0]])
    pdf = pd.DataFrame({"g": [*np.repeat(["smooth", "ties", "flat"], n), "one", "one"], "x": v, "a": [*(np.arange(3 * n) % 2 == 0), True, True]})
    tables = {}
    write = exact.materialise
    monkeypatch.setattr(exact, "materialise", lambda df, tag: tables.setdefault(tag, write(df, tag)))
    got = {r["g"]: r["ks"] for r in two_sample_ks(spark.createDataFrame(pdf).repartition(6), ["g"], "x", F.col("a")).collect()}
    for g in ("smooth", "ties", "flat"):
        d = pdf[pdf.g == g]
        assert abs(got[g] - distance(d["x"].to_numpy(), d["a"].to_numpy())) < 1e-12
    assert got["one"] is None  # no second sample
    # the buckets near the largest distance are left to order
    assert set(tables) == {"splits", "ends"}
    assert 0 < tables["ends"].where("g = 'smooth' AND _open").count() < 100


@pytest.mark.parametrize("buckets", [2, 3, 50, 2000])
def test_two_sample_distance_with_any_number_of_buckets(spark, buckets):
    rng = np.random.default_rng(9)
    v = np.where(rng.random(500) < 0.3, 0.5, np.round(rng.normal(size=500), 2))
    a = rng.random(500) < 0.4
    df = spark.createDataFrame(pd.DataFrame({"x": v, "a": a})).repartition(3)
    assert abs(two_sample_ks(df, [], "x", F.col("a"), buckets).first()["ks"] - distance(v, a)) < 1e-12


def test_top_rows_and_buckets_keep_everything(spark):
    pdf, df = skewed(spark)
    got = {(r["g"], r["id"]) for r in top_n(df, "x", 5, ["g"], ["id"]).collect()}
    want = pdf.dropna().sort_values(["g", "x", "id"], ascending=[True, False, True]).groupby("g").head(5)
    assert got == set(zip(want["g"], want["id"]))
    assert bucketize(df, "x", 5, ["g"]).count() == len(pdf)
    frac = top_fraction(df.withColumnRenamed("g", "date"), "x", 0.2, keys=("id",)).groupBy("date").count().toPandas()
    assert (frac["count"] >= 1).all()


def test_label_codes_are_dense_and_sorted(spark):
    df = spark.createDataFrame([(w,) for w in "pear apple fig apple kiwi fig".split()], "w string").repartition(3)
    got = {r["w"]: r["w_code"] for r in label_encode(df, "w").distinct().collect()}
    assert got == {"apple": 0, "fig": 1, "kiwi": 2, "pear": 3}


def test_splits_are_computed_once(spark, monkeypatch):
    """Bucket totals and rows must be cut alike: the sketch is written, not left in the plan where it may run twice."""
    tags = []
    real = exact.materialise
    monkeypatch.setattr(exact, "materialise", lambda df, tag="stage": tags.append(tag) or real(df, tag))
    _, df = skewed(spark)
    ranks(df, ["id"], ["g"], {"lo": ("x", "min")}).collect()
    assert tags == ["counts", "splits"]


def test_buckets_count_the_splits_below(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).cast("double").alias("x")).repartition(5)
    for k in (16, 23, 200):
        got = bucketed(df, [], "x", k).toPandas().sort_values("x")
        assert got["_b"].is_monotonic_increasing and got["_b"].nunique() > 0.9 * k and got["_b"].max() <= k - 1


def test_binary_search_of_splits_counts_what_lies_below(spark):
    rows = [(float(v), [float(s) for s in splits]) for splits in ([], [3], [1, 1, 2], [0, 2, 2, 2, 5, 9, 9]) for v in (-1, 0, 1, 2, 2.5, 9, 10, float("nan"))]
    df = spark.createDataFrame(rows, "v double, s array<double>")
    d = exact.below("s", "v", 7, df, "n")
    for r in d.collect():
        assert r["n"] == sum(s < r["v"] or r["v"] != r["v"] for s in r["s"])
    plan = bucketed(df.select("v"), [], "v", 16)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan  # interpreted element by element, once per row


def test_statistics_of_few_groups_do_not_move_the_rows(spark):
    df = spark.range(2000).select(F.col("id"), (F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("x"))
    d = exact.with_group_stats(df, ["g"], {"m": F.avg("x")}, few=True)
    assert "Exchange hashpartitioning" not in d._jdf.queryExecution().executedPlan().toString()
    assert all(abs(r["m"] - (998.0 + r["g"])) < 2 for r in d.select("g", "m").distinct().collect()) and d.count() == 2000


def test_sorted_ranks_move_the_rows_once(spark):
    pdf, df = skewed(spark)
    d = df.withColumns({"y": -F.col("x"), "w": F.col("id") % 7}).repartition(6, "id")
    cols = {"lo": ("x", "min"), "av": ("x", "avg"), "row": ("x", "row"), "mean": ("x", "mean_row"), "ylo": ("y", "min"), "wav": ("w", "avg")}
    r = sorted_ranks(d, ["g"], cols)
    assert r._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(g") == 1
    got = r.toPandas().set_index("id").sort_index()
    x = pdf.assign(y=-pdf["x"], w=pdf["id"] % 7).groupby("g")
    for name, want in (("lo", x["x"].rank(pct=True, method="min")), ("av", x["x"].rank(pct=True)), ("row", x["x"].rank(method="min")), ("mean", x["x"].rank()),
                       ("ylo", x["y"].rank(pct=True, method="min")), ("wav", x["w"].rank(pct=True))):
        np.testing.assert_allclose(got[name], want)
    assert len(got) == len(pdf)


def test_relative_ranks_write_nothing_and_move_rows_to_their_date_once(spark, bars, monkeypatch):
    monkeypatch.setattr(exact, "materialise", lambda *a: pytest.fail("a table was written"))
    got = relative_ranks(bars)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(date") == 1 and "Join" not in plan
    p = got.toPandas().sort_values(["symbol", "date"])
    r = p["close"].astype(float) / p.groupby("symbol")["close"].shift() - 1
    np.testing.assert_allclose(p["return_rank"], r.groupby(p["date"]).rank(pct=True, method="min"))
    np.testing.assert_allclose(p["turnover_rank"], (p["volume"] / p["close"]).groupby(p["date"]).rank(pct=True, method="min"))


def test_ic_moves_the_rows_once_and_writes_nothing(spark, monkeypatch):
    monkeypatch.setattr(exact, "materialise", lambda *a: pytest.fail("a table was written"))
    rng = np.random.default_rng(6)
    n = 400
    pdf = pd.DataFrame({"symbol": np.arange(n), "date": np.arange(n) // 40 * 10, "factor": np.where(np.arange(n) % 2, "a", "b"), "value": np.round(rng.normal(size=n), 1), "fwd": np.round(rng.normal(size=n), 1)})
    df = spark.createDataFrame(pdf).withColumn("value", F.when(F.col("symbol") % 11 != 0, F.col("value")))
    got = ic_by_date(df)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    by_date = df.repartition("date").select("date", F.inline(F.array(F.struct("factor", "value", "fwd"))))
    assert ic_by_date(by_date)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    kept = pdf[pdf["symbol"] % 11 != 0]
    for r in got.collect():
        d = kept[(kept["date"] == r["date"]) & (kept["factor"] == r["factor"])]
        assert (r["n"], r["ic"], r["rank_ic"]) == (len(d), pytest.approx(d["value"].corr(d["fwd"])), pytest.approx(d["value"].rank().corr(d["fwd"].rank())))
    assert got.count() == 20
