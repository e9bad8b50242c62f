"""Rolling rules against pandas, an independent implementation."""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quantloom.functions.series import S, span
from quantloom.operators import technical as T


def compare(df, got, fn):
    pdf = df.toPandas().sort_values(["symbol", "date"]).reset_index(drop=True)
    want = pdf.groupby("symbol", group_keys=False).apply(fn, include_groups=False).sort_index()
    np.testing.assert_allclose(pd.to_numeric(pdf[got]), pd.to_numeric(want), rtol=1e-8, atol=1e-10)


def test_rolling_statistics(bars):
    d = bars.withColumns({"mean": S.mean("close", 10), "half": S.mean("close", 10, 5), "std": S.std("close", 10), "skew": S.skew("volume", 20), "kurt": S.kurt("volume", 20),
                          "med": S.median("volume", 7), "q": S.quantile("volume", 20, 0.8), "rank": S.rank_pct("volume", 15), "prior": S.mean("close", 5, lo=-5, hi=-1)})
    d = d.where(F.col("symbol") != 3).cache()
    compare(d, "mean", lambda g: g["close"].rolling(10).mean())
    compare(d, "half", lambda g: g["close"].rolling(10, min_periods=5).mean())
    compare(d, "std", lambda g: g["close"].rolling(10).std())
    compare(d, "skew", lambda g: g["volume"].rolling(20).skew())
    compare(d, "kurt", lambda g: g["volume"].rolling(20).kurt())
    compare(d, "med", lambda g: g["volume"].rolling(7).median())
    compare(d, "q", lambda g: g["volume"].rolling(20).quantile(0.8))
    compare(d, "rank", lambda g: g["volume"].rolling(15).rank(pct=True))
    compare(d, "prior", lambda g: g["close"].shift(1).rolling(5).mean())


def test_exponential_means_both_kinds_and_long_blocks(bars):
    d = S.ewm(bars, {"adj": ("close", span(12), True), "rec": ("close", span(12), False), "fast": ("close", 0.9, False)}).cache()
    compare(d, "adj", lambda g: g["close"].ewm(span=12).mean())
    compare(d, "rec", lambda g: g["close"].ewm(span=12, adjust=False).mean())
    # alpha 0.9 makes blocks of 19 rows, so the carry between blocks is exercised
    compare(d, "fast", lambda g: g["close"].ewm(alpha=0.9, adjust=False).mean())


def test_exponential_means_over_gaps(bars):
    """Leading, inner (single and long) and trailing NULLs, as pandas decays and carries on."""
    day = F.unix_date("date") - F.unix_date(F.lit("2020-01-01").cast("date"))
    holed = bars.withColumn("close", F.when(~((day < 3) | (day % 7).isin(2, 3) | day.between(50, 75) | (day > 112)), F.col("close"))).withColumn("none", F.lit(None).cast("double"))
    d = S.ewm(holed, {"adj": ("close", span(12), True), "rec": ("close", span(12), False), "fast": ("close", 0.9, False), "slow": ("close", 0.9, True), "no": ("none", 0.5, True)}).cache()
    compare(d, "adj", lambda g: g["close"].ewm(span=12).mean())
    compare(d, "rec", lambda g: g["close"].ewm(span=12, adjust=False).mean())
    compare(d, "fast", lambda g: g["close"].ewm(alpha=0.9, adjust=False).mean())
    compare(d, "slow", lambda g: g["close"].ewm(alpha=0.9).mean())
    assert d.where("no IS NOT NULL").isEmpty() and set(d.columns) == {*holed.columns, "adj", "rec", "fast", "slow", "no"}
    got = {r.symbol: r.ewm_cov for r in S.ewm_cov(holed, "close", "volume", 0.06).collect()}
    for k, g in holed.orderBy("date").toPandas().groupby("symbol"):
        want = g["close"].ewm(alpha=0.06).cov(g["volume"]).iloc[-1]
        assert (k not in got or got[k] is None) if np.isnan(want) else abs(got[k] - want) < 1e-8 * max(1, abs(want))


def test_affine_scan_equals_the_fold(spark):
    """10^5 rows with factors from 0 to 1, resets and NULLs."""
    rng = np.random.default_rng(4)
    n = 100_000
    keep, add = rng.random(n), rng.normal(0, 1, n)
    keep[rng.random(n) < 0.01], keep[rng.random(n) < 0.3], keep[rng.random(n) < 0.01] = 0.0, 0.999, 1e-30
    gone = rng.random(n) < 0.05
    gone[:3] = [True, False, True]
    d = spark.createDataFrame(pd.DataFrame({"symbol": 1, "date": np.arange(n), "k": keep, "c": np.where(gone, np.nan, add)})).withColumn("c", F.when(~F.isnan("c"), F.col("c")))
    got = S.affine(d, "y", F.col("k"), F.col("c")).orderBy("date").toPandas()["y"].to_numpy()
    want, y = [], None
    for k, c, g in zip(keep, add, gone):
        y = y if g else c if y is None else k * y + c
        want.append(np.nan if y is None else y)
    np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-9)  # the running exponent reaches 1e5


def test_rolling_correlation_and_flat_series_is_null(bars):
    d = bars.withColumn("c", S.corr("close", "volume", 20)).cache()
    compare(d.where(F.col("symbol") != 3), "c", lambda g: g["close"].rolling(20).corr(g["volume"]))
    assert d.where("symbol = 3 and c is not null").count() == 0


def test_wilder_is_the_seeded_recursion(bars):
    d = T.wilder(bars, {"w": "close"}, {"w": 14})

    def ref(g):
        x, out = g["close"].to_numpy(), np.full(len(g), np.nan)
        for i in range(13, len(x)):
            out[i] = x[:14].mean() if i == 13 else (out[i - 1] * 13 + x[i]) / 14
        return pd.Series(out, index=g.index)
    compare(d, "w", ref)


def test_rsi_edges(bars):
    d = T.rsi_sma(bars.withColumn("close", F.when(F.col("symbol") == 2, F.unix_date("date").cast("double")).otherwise(F.col("close"))))
    assert d.where("symbol = 2 and rsi_14 is not null and rsi_14 <> 100").count() == 0
    assert d.where("symbol = 3 and rsi_14 is not null").count() == 0
    assert d.where("symbol = 4 and (rsi_14 is not null or rsi_14_overbought <> 0)").count() == 0


def test_adaptive_average_follows_its_recursion(bars):
    d = T.adaptive_ma(bars.where("symbol = 1")).orderBy("date").toPandas()
    v = d["close"].rolling(20).std()
    a = (v / v.rolling(20).mean()).clip(0.1, 0.9)
    y = []
    for c, k in zip(d["close"], a):
        y.append(c if np.isnan(k) or not y else k * c + (1 - k) * y[-1])
    np.testing.assert_allclose(d["adaptive_ma"], y, rtol=1e-10)


def test_row_order_of_the_input_does_not_matter(bars):
    a = T.macd_family(bars).select("symbol", "date", F.round("macd_signal", 9).alias("m"))
    b = T.macd_family(bars.orderBy(F.rand(3)).repartition(7)).select("symbol", "date", F.round("macd_signal", 9).alias("m"))
    assert a.exceptAll(b).count() == 0


def test_mean_correlation_meets_the_same_dates(spark):
    """Worked by hand: a symbol without the third date must not be shifted against the others."""
    import datetime as dt

    import numpy as np

    from quantloom.operators.cross_section import mean_correlation
    x = {"a": [1.0, 2.0, -1.0, 3.0, 0.5], "b": [2.0, 1.0, None, 4.0, 1.0], "c": [-1.0, 0.5, 2.0, -2.0, 1.0]}
    rows = [(k, dt.date(2020, 1, 1 + i), v) for k, vs in x.items() for i, v in enumerate(vs) if v is not None]
    got = {r["symbol"]: r["mean_corr"] for r in mean_correlation(spark.createDataFrame(rows, "symbol string, date date, ret double"), 4).where("date = '2020-01-05'").collect()}

    def unit(v):
        v = np.array([np.nan if z is None else z for z in v[:4]])
        v = (v - np.nanmean(v)) / (np.nanstd(v, ddof=1) * np.sqrt(np.sum(~np.isnan(v)) - 1))
        return np.nan_to_num(v)
    u = {k: unit(v) for k, v in x.items()}
    for k in x:
        assert abs(got[k] - np.mean([u[k] @ u[o] for o in x if o != k])) < 1e-12
    assert abs(u["a"] @ u["c"] - np.corrcoef(x["a"][:4], x["c"][:4])[0, 1]) < 1e-12


def test_components_of_a_long_chain(spark):
    from quantloom.operators.network import connected_components
    edge = spark.range(300).selectExpr("date '2020-01-01' AS date", "lpad(id, 4, '0') AS a", "lpad(id + 1, 4, '0') AS b")
    nodes = spark.range(302).selectExpr("date '2020-01-01' AS date", "lpad(id, 4, '0') AS node")
    got = {r["node"]: r["label"] for r in connected_components(edge, nodes).collect()}
    assert len(got) == 302 and {v for k, v in got.items() if k <= "0300"} == {"0000"} and got["0301"] == "0301"


def test_a_long_chain_of_windows_keeps_its_number_of_tasks(spark, bars):
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert T.rsi_wilder(bars).rdd.getNumPartitions() == parts  # adaptive execution would join these few bytes into one task
