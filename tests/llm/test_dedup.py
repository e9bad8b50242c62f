"""Exact and near deduplication against brute force."""
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import exact_dedup, near_dedup


def shingles(text, k):
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    return {tuple(ws[i:i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else {tuple(ws)} if ws else set()


def brute_components(docs, k, percent=80):
    sets = [shingles(t, k) for _, t in docs]
    least = {i: docs[i][0] for i in range(len(docs))}
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    for i in range(len(docs)):
        least[root(i)] = min(least[root(i)], docs[i][0])
    return {docs[i][0]: (len(sets[i]), least[root(i)]) for i in range(len(docs))}


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.substring(F.sha2(F.encode(c, "UTF-8"), 256), 1, 1), lambda c: F.lit("same")])
def test_exact_compares_content_whatever_the_digest(spark, digest):
    rng = random.Random(5)
    rows = [(i, f"text {rng.randint(0, 40)}") for i in range(300)] + [(1000 + i, "hot") for i in range(200)] + [(5000, None), (5001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.decisions(df, digest=digest).collect()}
    assert got == {i: (max(g), len(g), i == max(g)) for g in groups.values() for i in g}
    kept = exact_dedup.distinct_documents(df, digest=digest).collect()
    assert sorted((r.doc_id, r.text or "") for r in kept) == sorted((max(g), t) for t, g in groups.items())


def test_exact_odd_rows(odd_docs, no_docs):
    got = exact_dedup.decisions(odd_docs).collect()
    assert len(got) == odd_docs.count()
    two = [r for r in got if r.doc_id == 2]
    assert [r.group_size for r in two] == [3, 3] and sorted(r.kept for r in two) == [False, True]
    empty = {r.doc_id: r for r in got if r.digest == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"}
    assert set(empty) == {3, 4, None} and empty[4].kept and not empty[3].kept and not empty[None].kept
    kept = exact_dedup.distinct_documents(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == 9 and kept.where("doc_id = 2").count() == 1
    assert kept.where("doc_id = 4").first()["n_words"] == 1
    assert exact_dedup.decisions(no_docs).count() == 0 and exact_dedup.distinct_documents(no_docs).count() == 0


def test_sketches_estimate_the_similarity():
    rng = np.random.default_rng(1)
    for n in (3, 40, 3000):
        for share in (0.5, 0.8, 0.95):
            got = []
            for _ in range(30):
                union = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
                common = max(1, round(share * len(union)))
                a, b = union, union[:common]
                regs = near_dedup.sketch(a)[None, :], near_dedup.sketch(b)[None, :]
                got.append(near_dedup.estimate(*regs, np.array([len(a)]), np.array([len(b)]))[0] - common / len(union))
            assert abs(np.mean(got)) < 0.02, (n, share, np.mean(got))
    # chance agreement of disjoint sets is near its expectation
    a, b = (near_dedup.sketch(np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64))) for _ in "ab")
    assert (a == b).mean() <= near_dedup.chance(np.array([5000.0]), np.array([5000.0]))[0] + 0.02


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_equal_brute_force(spark, words):
    rng = random.Random(words)
    vocab = [f"w{i}" for i in range(400)]
    docs, n = [], 0
    for size in (3, 4, 6, 9, 12, 20, 60, 150):
        for _ in range(6):
            base = [rng.choice(vocab) for _ in range(size)]
            for _ in range(6):
                other = [rng.choice(vocab) if rng.random() < rng.choice((0, 0.01, 0.03)) else w for w in base]
                docs.append((n, " ".join(other[rng.choice((0, 0, 1)):])))
                n += 1
    hot = [rng.choice(vocab) for _ in range(120)]  # a large group of near copies
    for _ in range(150):
        docs.append((n, " ".join(rng.choice(vocab) if rng.random() < 0.015 else w for w in hot)))
        n += 1
    docs += [(n, None), (n + 1, ""), (n + 2, "Single"), (n + 3, "single")]
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), words=words).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(docs, words)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_odd_rows(odd_docs, no_docs):
    got = near_dedup.near_duplicates(odd_docs)
    assert got.count() == odd_docs.count()
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append(r)
    assert [r.component_id for r in by[2]] == [1, 1] and by[3][0].kept and by[3][0].n_shingles == 0 and by[6][0].n_shingles > 20_000
    kept = near_dedup.one_per_group(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 2
    assert near_dedup.near_duplicates(no_docs).count() == 0 and near_dedup.one_per_group(no_docs).count() == 0
