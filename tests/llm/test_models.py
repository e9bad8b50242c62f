"""Language identification and quality: held-out accuracy and defined cases."""
import numpy as np
from pyspark.sql import functions as F

from quantloom.llm import language_id, quality
from quantloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    p = QUERIES["op7_ftrl_language_id"](spark, FOLDER)
    lang = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    r = p.join(lang, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.min("score"), F.max("score"), F.count("*")).first()
    assert r[0] >= 0.97 and 0 <= r[1] and r[2] <= 1 and r[3] > 200
    assert p.count() == lang.count()


def test_language_weights_are_sparse_and_ignore_other_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    m = language_id.fit(docs, ~language_id.held_out())
    assert 0.3 < (m.weights == 0).mean() and m.labels == ["de", "en", "es", "fr"] and m.temperature > 0
    flipped = docs.withColumn("lang", F.when(language_id.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    again = language_id.fit(flipped, ~language_id.held_out())
    assert np.array_equal(m.weights, again.weights) and m.labels == again.labels


def test_language_odd_rows(odd_docs, no_docs):
    m = language_id.fit(odd_docs)
    got = {}
    for r in language_id.predict(odd_docs, m).collect():
        got.setdefault(r.row.doc_id, (r.lang_pred, r.score))
    assert got[3] == got[4] == got[5] == got[8] == ("und", 0.0) and got[9][0] != "und"
    kept = language_id.recognised(odd_docs, m)
    assert kept.columns == odd_docs.columns and kept.where("doc_id in (3, 4, 5, 8)").count() == 0
    none = language_id.fit(no_docs)
    assert none.labels == [] and none.predict("some text") == ("und", 0.0) and language_id.recognised(no_docs, m).count() == 0


def test_quality_held_out(spark):
    p = QUERIES["op8_quadratic_discriminant_quality"](spark, FOLDER)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "quality")
    rows = p.join(labels, "doc_id").where("held_out").collect()
    good, bad = ([r.score for r in rows if r.quality == k] for k in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.95 and np.mean([r.predicted == r.quality for r in rows]) > 0.9
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)


def test_discriminant_equals_densities():
    rng = np.random.default_rng(0)
    x = [rng.normal(k, 1 + k, (500, quality.STATISTICS)) for k in (0, 1)]
    m = quality.from_moments(np.array([500.0, 500.0]), np.array([z.sum(axis=0) for z in x]), np.array([z.T @ z for z in x]))
    probe = rng.normal(0.5, 1, (20, quality.STATISTICS))
    log = []
    for mean, f, c in zip(m.mean, m.factor, m.constant):
        cov = np.linalg.inv(f.T @ f)
        d = probe - mean
        log.append(np.log(0.5) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    assert np.allclose(m.scores(probe), 1 / (1 + np.exp(log[0] - log[1])))


def test_quality_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, None), (3, None, 0), (99, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    nothing = quality.classify(odd_docs, labels.where("false")).collect()
    assert all(r.score == 0.5 and r.predicted == 1 for r in nothing)
    assert quality.classify(no_docs, labels).count() == 0
