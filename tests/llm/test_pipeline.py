"""The pipeline against a plain version of its stages, and the SQL of the corpus queries."""
import hashlib

import corpus_pipeline
import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quantloom.llm import language_id
from quantloom.llm.queries import ORACLES, QUERIES

from .test_dedup import brute_components
from .test_text import brute_hits

FOLDER = "/root/testdata/sf0.001"


def test_pipeline_equals_plain_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = language_id.fit(docs, ~language_id.held_out())
    rows = {r.doc_id: r.text for r in docs.collect()}
    rows = {i: t for i, t in rows.items() if (p := model.predict(t))[0] != "und" and p[1] >= 0.3}
    last = {}
    for i, t in rows.items():
        last[t] = max(i, last.get(t, i))
    rows = {i: t for t, i in last.items()}
    comp = brute_components([*rows.items()], 5)
    rows = {i: t for i, t in rows.items() if comp[i][1] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    # an item can only occur where its first window's words do
    rows = {i: t for i, t in rows.items() if not ((h := brute_hits(t, [x for x in items if x[1].split()[0].lower().strip(".,") in t.lower()]))[1] and 20 * h[1] >= h[0])}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, t in rows.items():
        ids = library.encode(t, add_special_tokens=False).ids
        want[i] = len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert got == want and len(got) < docs.count()


def test_stages_take_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, FOLDER)
            assert out.columns == docs.columns
            out.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() == docs.count()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_gives_the_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    want = con.execute(ORACLES[name]).fetch_df()
    cols = sorted(want.columns)
    got = QUERIES[name](spark, FOLDER)
    assert sorted(got.columns) == cols
    assert sorted(map(tuple, got.select(*cols).collect()), key=repr) == sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall(), key=repr)


def test_bpe_query_equals_the_library(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    for r in QUERIES["op2_bpe_forced_boundaries"](spark, FOLDER).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert QUERIES["op6_information_theoretic_pii"](spark, FOLDER).where(F.col("spans").isNull()).count() == 0
