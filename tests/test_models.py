"""Portfolio, network and model operators on small fixtures."""
import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from quantloom.operators import backtest as B
from quantloom.operators import factors as FA
from quantloom.operators import learning as L
from quantloom.operators import network as NW
from quantloom.operators import portfolio as PO
from quantloom.operators import risk as R


def test_cross_sectional_regression_equals_least_squares(spark):
    rng = np.random.default_rng(0)
    d0, rows = dt.date(2020, 1, 1), []
    x = rng.normal(0, 1, (30, 2))
    y = x @ [0.5, -0.2] + rng.normal(0, 0.1, 30)
    rows = [(i, d0, float(x[i, 0]), float(x[i, 1]), float(y[i])) for i in range(30)]
    got = PO.cross_sectional_returns(spark.createDataFrame(rows, "symbol long, date date, a double, b double, fwd double"), ["a", "b"]).first()
    np.testing.assert_allclose([got["a"], got["b"]], np.linalg.lstsq(x, y, rcond=None)[0], rtol=1e-9)


def test_greedy_filter():
    assert FA.greedy_filter([("a", "b", 0.9), ("b", "c", 0.95), ("a", "c", 0.1)], ["a", "b", "c"]) == ["a", "c"]


def test_linear_form_of_mean_correlation_equals_pairs(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (12, 6))
    rows = [(s, dt.date(2020, 1, 1) + dt.timedelta(days=i), float(x[i, s])) for s in range(6) for i in range(12)]
    got = NW.group_mean_correlation(spark.createDataFrame(rows, "symbol long, date date, ret double"), 12).where("date = '2020-01-12'").orderBy("symbol").toPandas()
    c = np.corrcoef(x.T)
    np.testing.assert_allclose(got["mean_corr"], (c.sum(axis=0) - 1) / 5, rtol=1e-9)


def test_components_and_paths(spark):
    d = dt.date(2020, 1, 1)
    e = spark.createDataFrame([(d, a, b, 0.9) for a, b in ("ab", "bc", "de")], "date date, a string, b string, corr double")
    n = spark.createDataFrame([(d, x) for x in "abcdef"], "date date, node string")
    got = {r["node"]: r["label"] for r in NW.connected_components(e, n).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "f"}


def test_portfolio_identity(spark):
    """w'Cw through the portfolio return equals the matrix form, and components add up to the volatility."""
    rng = np.random.default_rng(9)
    x, w = rng.normal(0, 0.02, (40, 4)), np.array([0.4, 0.3, 0.2, 0.1])
    rows = [(s, dt.date(2020, 1, 1) + dt.timedelta(days=i), float(x[i, s])) for s in range(4) for i in range(40)]
    ret = spark.createDataFrame(rows, "symbol long, date date, ret double")
    wt = spark.createDataFrame([(1, s, float(w[s])) for s in range(4)], "portfolio long, symbol long, weight double")
    v = R.portfolio_parametric(R.portfolio_returns(wt, ret)).first()
    c = np.cov(x.T) * 252
    assert abs(v["variance"] - w @ c @ w) < 1e-12
    comp = R.risk_contributions(wt, ret).orderBy("symbol").toPandas()
    np.testing.assert_allclose(comp["component"].sum(), v["volatility"], rtol=1e-9)
    np.testing.assert_allclose(comp["marginal"], c @ w / np.sqrt(w @ c @ w), rtol=1e-9)


def test_simulated_and_bootstrapped_figures(spark, bars):
    r = R.daily_returns(bars).where("symbol = 1")
    mc, pv = R.monte_carlo_var(r).first(), R.var_table(r).first()
    assert abs(mc["mc_var_5"] - pv["param_var_5"]) < 0.1 * abs(pv["param_var_5"])
    b = B.bootstrap(r.withColumn("strategy_ret", F.col("ret")), replicates=100).first()
    m = r.agg(F.avg("ret")).first()[0]
    assert b["ci_low"] < m < b["ci_high"]
    again = B.bootstrap(r.repartition(5).withColumn("strategy_ret", F.col("ret")), replicates=100).first()
    assert abs(again["boot_mean"] - b["boot_mean"]) < 1e-12


def test_equity_never_shows_positive_drawdown(bars):
    assert R.drawdown(bars).where("drawdown > 1e-12 or drawdown < -1").count() == 0


def test_models_by_property(spark):
    rng = np.random.default_rng(4)
    n = 400
    a, b = rng.normal(0, 1, n), rng.normal(0, 1, n)
    rows = [(i % 10, dt.date(2020, 1, 1) + dt.timedelta(days=i // 10), float(a[i]), float(a[i] + 0.01 * b[i]), float(b[i]), float(2 * a[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "symbol long, date date, x double, y double, z double, fwd double").cache()
    p = L.pca_factors(df, ["x", "y", "z"], 2).toPandas()
    assert abs(np.corrcoef(p["pc_1"], a)[0, 1]) > 0.99
    imp = {r["feature"]: r["consensus"] for r in L.importance(df, ["x", "z"]).collect()}
    assert imp["x"] > imp["z"]
    an = L.anomaly_scores(df.unionByName(spark.createDataFrame([(99, dt.date(2021, 1, 1), 50.0, 50.0, 50.0, 0.0)], df.schema)), ["x", "z"]).orderBy(F.desc("mahalanobis")).first()
    assert an["symbol"] == 99 and an["anomaly"] == 1
    pr = L.linear_predictions(df, ["x", "z"]).toPandas()
    np.testing.assert_allclose(pr["p_ols"], pr["fwd"], atol=1e-6)
    sel = L.impute_scale_select(df, ["x", "y", "z"], k=2)
    assert sel.count() == n
    fr = L.stability_selection(df.selectExpr("symbol", "date", "'x' as factor", "x as value", "fwd"), min_corr=0.5).first()
    assert fr["frequency"] == 1.0
    km = L.kmeans_cluster(df, ["x", "z"], 3)
    assert km.select("cluster").distinct().count() == 3 and km.where("distance < 0").count() == 0
    assert L.ensemble(df, ["x", "z"]).where("p_mean is null").count() == 0


def test_polarity_in_any_alphabet_with_a_given_lexicon(spark):
    from quantloom.operators.sentiment import text_polarity
    docs = spark.createDataFrame([(1, "Großer Verlust, ein Absturz."), (2, "¡Éxito! fuerte"), (3, "плохо, хорошо хорошо"), (4, None), (5, "gains againstloss")], "doc_id long, text string")
    got = {r["doc_id"]: (r["sentiment"], r["hits"], round(r["polarity"], 3)) for r in text_polarity(docs, "text").collect()}
    assert got == {1: ("negative", 2, -0.65), 2: ("positive", 2, 0.65), 3: ("neutral", 0, 0.0), 4: ("neutral", 0, 0.0), 5: ("neutral", 0, 0.0)}
    own = spark.createDataFrame([("хорошо", 60, 50), ("плохо", -60, 50)], "token string, pol long, sub long")
    assert text_polarity(docs, "text", own).where("doc_id = 3").first()["polarity"] == 0.2


def test_learned_lexicon_scores_real_texts(spark):
    from quantloom.operators.sentiment import LEXICON_WORDS, learn_lexicon
    from quantloom.sources.tables import Tables
    t = Tables(spark, "/root/testdata/sf0.01")
    d = t.doc_sentiment()
    assert d.where("polarity <> 0").count() * 10 >= d.count() and {r["sentiment"] for r in d.select("sentiment").distinct().collect()} == {"positive", "negative", "neutral"}
    docs = spark.createDataFrame([(i, "gut und gut" if i % 2 else "schlecht und") for i in range(12)] + [(99, "gut"), (100, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(99, None), (100, 1)], "doc_id long, quality int")
    got = sorted((r["token"], r["pol"], r["sub"]) for r in learn_lexicon(docs, labels, "text", words=LEXICON_WORDS).collect())
    assert got == [("gut", 100, 100), ("schlecht", -100, 100), ("und", -7, 7)]
    assert learn_lexicon(docs, labels, "text", words=1).count() == 1 and learn_lexicon(docs.where("false"), labels, "text").count() == 0


def test_bars_break_ties_by_large_part_keys(spark, tmp_path):
    """Same day, order and line: the smaller part opens and the larger one closes the week, however far apart they are."""
    import pytest
    from quantloom.sources.tables import Tables
    day = dt.date(2020, 1, 6)
    price = {8193: 195.0, 4097: 99.0, 10 ** 15 + 1: 3.5, 1: 3.0, 12289: 291.0, 20_000: 2.0}
    rows = [(7, day, 10 ** 18, 40, p, 1.0, x) for p, x in price.items()] + [(7, day, 10 ** 18, 99, 1, 1.0, 5.0), (7, day, 10 ** 18 - 1, 99, 1, 1.0, 6.0)]
    schema = "l_suppkey long, l_shipdate date, l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    bar = Tables(spark, str(tmp_path)).bars().first()
    assert (bar["open"], bar["close"], bar["volume"]) == (6.0, 5.0, 8.0)
    spark.createDataFrame(rows[:6], schema).write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
    bar = Tables(spark, str(tmp_path)).bars().first()
    assert (bar["open"], bar["close"]) == (3.0, 3.5)
    spark.createDataFrame([(7, day, 1, 100, 1, 1.0, 1.0)], schema).write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
    with pytest.raises(Exception, match="bar key"):
        Tables(spark, str(tmp_path)).bars().collect()


def test_dependent_exposures_have_no_returns(spark):
    d0 = dt.date(2020, 1, 1)
    rows = [(i, d0, float(i), 2.0 * i, float(i % 5)) for i in range(30)] + [(i, d0 + dt.timedelta(days=1), float(i), float(i * i), 3.0 * i - 0.5 * i * i) for i in range(30)]
    got = PO.cross_sectional_returns(spark.createDataFrame(rows, "symbol long, date date, a double, b double, fwd double"), ["a", "b"]).orderBy("date").collect()
    assert (got[0]["a"], got[0]["b"]) == (None, None) and got[0]["n"] == 30
    np.testing.assert_allclose([got[1]["a"], got[1]["b"]], [3.0, -0.5], rtol=1e-9)


def test_features_are_computed_once(spark, monkeypatch):
    """Operators that pass over the features several times write them first."""
    tags = []
    real = L.materialise
    monkeypatch.setattr(L, "materialise", lambda df, tag="stage": tags.append(tag) or real(df, tag))
    rows = [(i % 4, dt.date(2020, 1, 1) + dt.timedelta(days=i // 4), float(i % 7), float(i % 5), float(i % 3)) for i in range(80)]
    df = spark.createDataFrame(rows, "symbol long, date date, x double, z double, fwd double")
    assert L.anomaly_scores(df, ["x", "z"]).count() == 80 and tags == ["features"]
    assert L.impute_scale_select(df, ["x", "z"], k=1).count() == 80 and tags == ["features", "features"]


def test_ensemble_walks_forward(spark):
    rng = np.random.default_rng(12)
    day = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(110)]
    # the target turns on day 40, so only models fitted on the days just before a block see the new rule alone
    rows = [(s, day[i], float(x), float(z), float((2 if i < 40 else -2) * x)) for i in range(110) for s, (x, z) in enumerate(rng.normal(size=(8, 2)))]
    rows += [(9, day[95], 1.0, 1.0, 1e6), (9, day[109], 1.0, 1.0, -2.0)]  # known on day 109 only: no model of the block of day 100 may use it
    rows += [(10, day[i], None, 0.0, 0.0) for i in range(110)]
    got = L.ensemble(spark.createDataFrame(rows, "symbol long, date date, x double, z double, fwd double"), ["x", "z"]).toPandas()
    assert sorted(got["date"].unique()) == day[60:] and len(got) == 50 * 8 + 2  # every day after the first 60
    new = got[(got["date"] >= day[100])]
    np.testing.assert_allclose(new["p_linear"], new["fwd"], atol=0.1)
    assert np.corrcoef(new["p_forest"], new["fwd"])[0, 1] > 0.9 and np.corrcoef(new["p_boost"], new["fwd"])[0, 1] > 0.9
    three = got[["p_linear", "p_forest", "p_boost"]]
    np.testing.assert_allclose(got["p_mean"], three.mean(axis=1))
    np.testing.assert_allclose(got["p_median"], three.median(axis=1), atol=1e-6)
