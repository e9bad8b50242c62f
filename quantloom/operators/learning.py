"""Models and model checks on factor tables, on Spark's ML library."""
from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, Imputer, StandardScaler, UnivariateFeatureSelector, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions.draws import unit, with_draw
from quantloom.functions.exact import quantiles, two_sample_ks, unpivot, with_group_stats
from quantloom.functions.series import S, Series, div, flag, with_pos
from quantloom.operators.relational import corr_agg, equal_width_bins
from quantloom.session import materialise


def vectors(df: DataFrame, cols, scale=True) -> DataFrame:
    d = VectorAssembler(inputCols=list(cols), outputCol="_raw", handleInvalid="skip").transform(df)
    if not scale:
        return d.withColumnRenamed("_raw", "features")
    return StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True).fit(d).transform(d).drop("_raw")


def inputs(df: DataFrame, cols, target: str, keys=("symbol", "date")) -> DataFrame:
    """Keys, features and target of the rows that have a target, written once: every pass of a fit reads them there."""
    return materialise(df.where(F.col(target).isNotNull()).select(*keys, target, *cols), "features")


def incomplete(df: DataFrame, cols) -> DataFrame:
    """Rows with a NULL feature: they have no vector, so models return them with NULL outputs."""
    return df.where(F.array_contains(F.array(*[F.col(c).isNull() for c in cols]), True))


def pca_factors(df: DataFrame, cols, k=3) -> DataFrame:
    """Leading components of standardised features; the largest loading of each is made positive."""
    d = vectors(df, cols)
    model = PCA(k=k, inputCol="features", outputCol="_pc").fit(d)
    load = model.pc.toArray()
    sign = np.sign(load[np.abs(load).argmax(axis=0), range(k)])
    arr = vector_to_array("_pc")
    out = model.transform(d).select(*df.columns, *[(arr[i] * float(sign[i])).alias(f"pc_{i + 1}") for i in range(k)])
    return out.unionByName(incomplete(df, cols), allowMissingColumns=True)


def kmeans_cluster(df: DataFrame, cols, k=4, seed=7) -> DataFrame:
    df = materialise(df, "features")
    d = vectors(df, cols)
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(d)
    centers = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    out = model.transform(d).withColumn("_c", centers[F.col("cluster")]).withColumn("_f", vector_to_array("features"))
    dist = F.sqrt(F.aggregate(F.zip_with("_f", "_c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x))
    return out.withColumn("distance", dist).select(*df.columns, "cluster", "distance").unionByName(incomplete(df, cols), allowMissingColumns=True)


def split_by_date(df: DataFrame, share=0.7) -> DataFrame:
    """Marks the training rows: dates in the first share of the calendar."""
    days = df.select("date").distinct()
    s = Series((), ("date",))  # calendar bounded
    cut = days.withColumn("_r", F.percent_rank().over(s.w)).withColumn("is_train", F.col("_r") < share).drop("_r")
    return df.join(F.broadcast(materialise(cut, "split")), "date")  # one row per date


def walk_forward(df: DataFrame, cols, target="fwd", window=60, step=20, s: Series = S):
    """Yields (train, test) per block of ``step`` dates, from the date after the first ``window`` ones on: vectors of the block and of the ``window`` dates before it.

    Dates are those on which a row has all features.  A row trains only where its target is known on the first date of the block, that is, where the
    next row of its series lies no later.  The rows are written once, and again by block, so that a fit reads its own dates; the list of dates is bounded by the calendar.
    """
    d = inputs(df.withColumn("_known", s.lead("date")), ["_known", *cols], target).dropna(subset=list(cols))
    dates = [r["date"] for r in d.select("date").distinct().orderBy("date").collect()]
    if len(dates) <= window:
        return
    blocks = df.sparkSession.createDataFrame([(x, (i - window) // step) for i, x in enumerate(dates)], "date date, _block int")
    d = materialise(d.join(F.broadcast(blocks), "date"), "blocks", ["_block"])  # one row per date
    for k in range((len(dates) - window - 1) // step + 1):
        start = window + k * step
        first, last = F.lit(dates[start - window]), F.lit(dates[start])
        past = d.where(F.col("_block").between((start - 2 * window) // step, k - 1) & (F.col("date") >= first) & (F.col("_known") <= last))
        yield vectors(past, cols, scale=False), vectors(d.where(F.col("_block") == k), cols, scale=False)


def ensemble(df: DataFrame, cols, target="fwd", seed=5, window=60, step=20) -> DataFrame:
    """Out-of-sample predictions of a linear, a forest and a boosted model, with mean and median.

    Walk-forward: every block of ``step`` dates is predicted by models fitted anew on the ``window`` dates before it, from the first date that has so many on.
    """
    models = [LinearRegression(labelCol=target, predictionCol="p_linear", regParam=0.01), RandomForestRegressor(labelCol=target, predictionCol="p_forest", numTrees=10, maxDepth=4, seed=seed),
              GBTRegressor(labelCol=target, predictionCol="p_boost", maxIter=5, maxDepth=3, seed=seed)]
    names = [m.getPredictionCol() for m in models]
    out = df.where(F.lit(False)).select("symbol", "date", target, *[F.lit(None).cast("double").alias(p) for p in names])
    for train, test in walk_forward(df, cols, target, window, step):
        fitted = not train.isEmpty()
        for m in models:
            test = m.fit(train).transform(test) if fitted else test.withColumn(m.getPredictionCol(), F.lit(None).cast("double"))
        out = out.unionByName(test.select(*out.columns))
    a, b, c = (F.col(p) for p in names)
    return out.withColumns({"p_mean": (a + b + c) / 3, "p_median": a + b + c - F.greatest(a, b, c) - F.least(a, b, c)})


def linear_predictions(df: DataFrame, cols, target="fwd", ridge=0.01, lasso=0.01, forest=False, seed=11) -> DataFrame:
    """Pooled linear, ridge and lasso predictions after the training part.

    With ``forest`` a random forest predicts too (``p_forest``), and the features are also weighted by its
    importances (``p_importance``): the importance-weighted sum of the standardised features, each with the sign
    of its correlation with the target in the training part.
    """
    d = split_by_date(vectors(inputs(df, cols, target), cols))
    train, test = d.where("is_train"), d.where(~F.col("is_train"))
    for name, reg, mix in (("p_ols", 0.0, 0.0), ("p_ridge", ridge, 0.0), ("p_lasso", lasso, 1.0)):
        test = LinearRegression(labelCol=target, predictionCol=name, regParam=reg, elasticNetParam=mix).fit(train).transform(test)
    if not forest:
        return test.select("symbol", "date", target, "p_ols", "p_ridge", "p_lasso")
    model = RandomForestRegressor(labelCol=target, predictionCol="p_forest", numTrees=20, maxDepth=4, seed=seed).fit(train)
    signs = train.agg(*[F.signum(corr_agg(c, target)).alias(c) for c in cols]).first()  # one row, a number per feature
    f = vector_to_array("features")
    weighted = sum((f[i] * float(w * (signs[c] or 0.0)) for i, (c, w) in enumerate(zip(cols, model.featureImportances.toArray()))), F.lit(0.0))
    return model.transform(test).select("symbol", "date", target, "p_ols", "p_ridge", "p_lasso", "p_forest", weighted.alias("p_importance"))


def prediction_signal(df: DataFrame, target="fwd", lags=3, threshold=0.02, s: Series = S) -> DataFrame:
    """Linear model on lagged returns; predictions beyond the threshold become signals."""
    d = df.withColumns({f"_l{i}": s.lag("ret", i) for i in range(lags)})
    p = linear_predictions(d, [f"_l{i}" for i in range(lags)], target)
    x = F.col("p_ols")
    return p.withColumn("signal", F.when(x > threshold, 1).when(x < -threshold, -1).otherwise(0))


def blend(df: DataFrame, preds, target) -> DataFrame:
    """Inverse-error and softmax weights of several predictions, and their blends."""
    ok = F.col(target).isNotNull()
    for p in preds:
        ok &= F.col(p).isNotNull()
    d = df.where(ok)
    stats = d.agg(*[F.avg(F.pow(F.col(p) - F.col(target), F.lit(2.0))).alias(f"_e_{p}") for p in preds])
    inv = {p: div(F.lit(1.0), f"_e_{p}") for p in preds}
    tot = sum(list(inv.values())[1:], inv[preds[0]])
    best = F.least(*[F.col(f"_e_{p}") for p in preds])
    sm = {p: F.exp(-(F.col(f"_e_{p}") - best)) for p in preds}
    st = sum(list(sm.values())[1:], sm[preds[0]])
    w = stats.select(*[(inv[p] / tot).alias(f"w_{p}") for p in preds], *[(sm[p] / st).alias(f"s_{p}") for p in preds])
    d = d.crossJoin(F.broadcast(w))  # one row

    def mix(prefix):
        return sum((F.col(f"{prefix}_{p}") * F.col(p) for p in preds[1:]), F.col(f"{prefix}_{preds[0]}") * F.col(preds[0]))
    return d.withColumns({"blend_inverse": mix("w"), "blend_softmax": mix("s")})


def importance(df: DataFrame, cols, target="fwd", seed=3, lasso=0.001) -> DataFrame:
    """Absolute correlation, forest importance and absolute lasso coefficient of the standardised features, each scaled to a maximum of 1, and their mean.

    The lasso penalty is relative to the deviation of the target, so it does not depend on its unit; a measure that
    is zero for all features is NULL and counts as 0 in the mean.
    """
    d = inputs(df, cols, target, ())
    corr = d.agg(*[F.abs(corr_agg(c, target)).alias(c) for c in cols])
    c = unpivot(corr, [], list(cols), "feature", "corr_importance")
    v = vectors(d, cols)
    imp = RandomForestRegressor(labelCol=target, numTrees=10, maxDepth=4, seed=seed).fit(v).featureImportances.toArray()
    unit = d.agg(F.stddev_samp(target)).first()[0] or 1.0
    coef = np.abs(LinearRegression(labelCol=target, regParam=lasso * unit, elasticNetParam=1.0).fit(v).coefficients.toArray())

    def by_feature(values):
        return F.element_at(F.create_map(*[x for f, i in zip(cols, values) for x in (F.lit(f), F.lit(float(i)))]), F.col("feature"))
    c = c.withColumns({"forest_importance": by_feature(imp), "lasso_importance": by_feature(coef)})
    kinds = ["corr_importance", "forest_importance", "lasso_importance"]
    c = with_group_stats(c, [], {f"_{k}": F.max(k) for k in kinds})
    c = c.withColumns({k: div(k, f"_{k}") for k in kinds}).drop(*[f"_{k}" for k in kinds])
    return c.withColumn("consensus", sum((F.coalesce(k, F.lit(0.0)) for k in kinds), F.lit(0.0)) / len(kinds))


def mutual_information(long: DataFrame, value="value", target="fwd", bins=10) -> DataFrame:
    """Binned mutual information (equal-width bins) of each factor with the target."""
    d = with_group_stats(long.where(F.col(value).isNotNull() & F.col(target).isNotNull()), ["factor"], {"_a": F.min(value), "_b": F.max(value), "_c": F.min(target), "_d": F.max(target), "_n": F.count(F.lit(1))})
    d = d.select("factor", "_n", equal_width_bins(F.col(value), F.col("_a"), F.col("_b"), bins).alias("x"), equal_width_bins(F.col(target), F.col("_c"), F.col("_d"), bins).alias("y"))
    j = d.groupBy("factor", "x", "y").agg(F.count(F.lit(1)).alias("n"), F.first("_n").alias("_n"))
    j = j.join(j.groupBy("factor", "x").agg(F.sum("n").alias("nx")), ["factor", "x"]).join(j.groupBy("factor", "y").agg(F.sum("n").alias("ny")), ["factor", "y"])
    p = F.col("n") / F.col("_n")
    return j.groupBy("factor").agg(F.sum(p * F.log(F.col("n") * F.col("_n") / (F.col("nx") * F.col("ny")))).alias("mutual_information"), F.sum("n").alias("n"))


def selection_vote(long: DataFrame, min_corr=0.01, min_mi=0.005, min_var=0.05) -> DataFrame:
    """Votes of a correlation, an information and a variance selector per factor."""
    d = long.where(F.col("value").isNotNull() & F.col("fwd").isNotNull())
    g = d.groupBy("factor").agg(corr_agg("value", "fwd").alias("_c"), F.var_samp("value").alias("_v")).join(mutual_information(long), "factor")
    votes = flag(F.abs("_c") > min_corr) + flag(F.col("mutual_information") > min_mi) + flag(F.col("_v") > min_var)
    return g.select("factor", votes.alias("votes"), flag(votes >= 2).alias("selected"))


def stability_selection(long: DataFrame, replicates=20, share=0.5, min_corr=0.01, seed=17) -> DataFrame:
    """Share of half-samples in which a factor correlates beyond the limit; samples drawn by the keys of the row."""
    d = long.where(F.col("value").isNotNull() & F.col("fwd").isNotNull())
    d = with_draw(d, "_row", seed, [F.col("symbol"), F.unix_date("date")])
    d = d.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    d = with_draw(d, "_draw_k", F.col("_row"), [F.col("replicate")])
    u = unit("_draw_k")
    g = d.where(u < share).groupBy("factor", "replicate").agg(corr_agg("value", "fwd").alias("_c"))
    return g.groupBy("factor").agg(F.avg(flag(F.abs("_c") > min_corr)).alias("frequency"), F.avg("_c").alias("mean_corr"), F.count(F.lit(1)).alias("replicates"))


def feature_stability(df: DataFrame, cols, periods=5) -> DataFrame:
    """Period means and their variation, KS distance of the first and second half, score 0 .. 100; one row per feature.

    The features are computed once and written, a row of the panel each; every pass reads them there.
    """
    d = materialise(df.select("date", *[F.col(c).cast("double").alias(c) for c in cols]), "features").where(F.coalesce(*cols).isNotNull() & F.col("date").isNotNull())
    s = Series((), ("date",))  # calendar bounded
    days = d.select("date").distinct().withColumn("period", (F.floor((s.pos() - 1) * periods / F.count(F.lit(1)).over(s.whole)) + 1).cast("int"))
    d = d.join(F.broadcast(materialise(days, "periods")), "date")  # one row per date
    p = d.groupBy("period").agg(*[x for c in cols for x in (F.avg(c).alias(f"m_{c}"), F.stddev_samp(c).alias(f"s_{c}"))])
    p = p.select("period", F.inline(F.array(*[F.struct(F.lit(c).alias("factor"), F.col(f"m_{c}").alias("m"), F.col(f"s_{c}").alias("s")) for c in cols]))).where(F.col("m").isNotNull())
    g = p.groupBy("factor").agg(div(F.stddev_samp("m"), F.abs(F.avg("m"))).alias("mean_cv"), div(F.stddev_samp("s"), F.abs(F.avg("s"))).alias("std_cv"), F.regr_slope("m", "period").alias("trend"))
    ks = two_sample_ks(unpivot(d, ["period"], list(cols), "factor"), ["factor"], "value", F.col("period") <= periods // 2)
    return g.join(ks, "factor").withColumn("score", F.greatest(100 - 50 * F.least("mean_cv", F.lit(1.0)) - 50 * F.col("ks"), F.lit(0.0)))


def leakage(long: DataFrame, s: Series = Series(("symbol", "factor"), ("date",))) -> DataFrame:
    """Correlation with the same-row and the future target, and autocorrelations 1 and 7."""
    d = long.withColumns({"_f": s.lead("fwd"), "_l1": s.lag("value", 1), "_l7": s.lag("value", 7)})
    g = d.groupBy("factor").agg(corr_agg("value", "fwd").alias("target_corr"), corr_agg("value", "_f").alias("future_corr"), corr_agg("value", "_l1").alias("autocorr_1"), corr_agg("value", "_l7").alias("autocorr_7"))
    risk = flag(F.abs("target_corr") > 0.9) * 50 + flag(F.abs("future_corr") > 0.5) * 30 + flag(F.abs("autocorr_1") > 0.99) * 20
    return g.withColumn("risk_score", risk)


def regime_change(df: DataFrame, s: Series = S) -> DataFrame:
    """KS distance between the halves of each series and a t statistic of its mean; the calendar bounds a series, so windows order it."""
    d = with_pos(df.where(F.col("ret").isNotNull()), s).withColumn("_n", F.count(F.lit(1)).over(s.whole))
    first = F.col("_pos") <= F.floor(F.col("_n") / 2)
    upto = s.whole.orderBy("ret")  # the smaller and the equal values
    share = [F.try_divide(F.count(F.when(half, 1)).over(upto), F.count(F.when(half, 1)).over(s.whole)) for half in (first, ~first)]
    d = d.withColumn("_d", F.abs(share[0] - share[1]))
    g = d.groupBy(*s.by).agg(F.avg("ret").alias("_m"), F.stddev_samp("ret").alias("_s"), F.count(F.lit(1)).alias("n"), F.max("_d").alias("ks"))
    g = g.withColumn("t_stat", div(F.col("_m") * F.sqrt("n"), "_s"))
    return g.withColumn("changed", flag(F.col("ks") > 1.36 * F.sqrt(4 / F.col("n")))).drop("_m", "_s")


def cv_folds(df: DataFrame, folds=4, gap=5, s: Series = S) -> DataFrame:
    """Expanding splits with a gap: (rows, fold, part); part is train or test, rows in the gap are left out."""
    d = with_pos(df, s, "pos").withColumn("_n", F.count(F.lit(1)).over(s.whole)).withColumn("_t", F.floor(F.col("_n") / (folds + 1)))
    d = d.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds))))
    start = F.col("fold") * F.col("_t")
    part = F.when(F.col("pos") <= start - gap, "train").when((F.col("pos") > start) & (F.col("pos") <= start + F.col("_t")), "test")
    return d.withColumn("part", part).where(F.col("part").isNotNull()).drop("_n", "_t")


def anomaly_scores(df: DataFrame, cols, limit=3.5, share=0.975) -> DataFrame:
    """Largest robust z and Mahalanobis distance per row; medians are exact, the k x k covariance is inverted on the driver.

    The features are computed once and written; every pass reads them there.
    """
    df = materialise(df, "features")
    d = df.dropna(subset=list(cols))
    md = {r["name"]: r["md"] for r in quantiles(unpivot(d, [], list(cols)), ["name"], "value", [0.5], ["md"]).collect()}  # one row per column
    dev = d.select(*[F.abs(F.col(c) - F.lit(md[c])).alias(c) for c in cols])
    mad = {r["name"]: r["mad"] for r in quantiles(unpivot(dev, [], list(cols)), ["name"], "value", [0.5], ["mad"]).collect()}
    st = {c: (md[c], mad[c]) for c in cols}
    row = d.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.covar_samp(a, b).alias(f"c_{a}_{b}") for a in cols for b in cols]).first()
    inv = np.linalg.pinv(np.array([[row[f"c_{a}_{b}"] for b in cols] for a in cols]))
    rz = F.greatest(*[F.abs(div(0.6745 * (F.col(c) - st[c][0]), F.lit(st[c][1]))) for c in cols])
    dist = F.lit(0.0)
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            dist = dist + float(inv[i, j]) * (F.col(a) - row[f"m_{a}"]) * (F.col(b) - row[f"m_{b}"])
    out = d.withColumns({"robust_z": rz, "mahalanobis": F.sqrt(F.greatest(dist, F.lit(0.0)))}).withColumn("anomaly", flag(F.col("robust_z") > limit))
    return out.unionByName(incomplete(df, cols), allowMissingColumns=True)


def impute_scale_select(df: DataFrame, cols, target="fwd", k=4) -> DataFrame:
    """Median imputation, standard scaling and the k best features by F statistic."""
    d = materialise(df.where(F.col(target).isNotNull()), "features")
    d = Imputer(strategy="median", inputCols=list(cols), outputCols=[f"i_{c}" for c in cols]).fit(d).transform(d)
    d = vectors(d, [f"i_{c}" for c in cols])
    sel = UnivariateFeatureSelector(featuresCol="features", outputCol="chosen", labelCol=target, selectionMode="numTopFeatures").setFeatureType("continuous").setLabelType("continuous").setSelectionThreshold(k).fit(d)
    arr = vector_to_array("chosen")
    return sel.transform(d).select("symbol", "date", *[arr[i].alias(f"x_{i + 1}") for i in range(k)])
