"""Fill-in-the-middle: units, cuts and the way back, against a plain version."""
import hashlib
import random
import re

from pyspark.sql import functions as F

from quantloom.llm import fill_middle


def plain(doc_id, text):
    """The contract, step by step."""
    t = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
    digest = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, t
    if h[3] % 100 < 20:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_units():
    rng = random.Random(3)
    for n in [0, 1, 2, 5, 50, 400] * 20:
        t = "".join(rng.choice("abZ  \n\x00é漢😀<PSM>09") for _ in range(n))
        want, at = [], 0
        for u in re.findall(r"[A-Za-z]+|[^A-Za-z]", t):
            want.append(at := at + len(u))
        assert fill_middle.unit_ends(t) == want == fill_middle.unit_ends(t, piece=7)
    assert fill_middle.unit_ends("ab" * 50_000, piece=10) == [100_000]
    assert len(fill_middle.unit_ends(" x" * 1_500_000)) == 3_000_000


def test_transform_equals_the_plain_version(spark, odd_docs, no_docs):
    seams = [(100 + i, t, "en", "s", 1) for i, t in enumerate(["<", "<<S", "a<P", "S>", "P>b", "x<P>", "<M>", "a <S> b", "<P", ">", "S><", "M>M>", "<S<P<M"] * 4)]
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = odd_docs.select(*columns).unionByName(spark.createDataFrame(seams, odd_docs.select(*columns).schema)).withColumns(
        {c: F.lit("clash") for c in ("row", "one", "output", "form", "n")})
    got = fill_middle.transform(docs).withColumn("back", fill_middle.restored()).select("row.*", "back", *[F.col(c).alias(f"_{c}") for c in (
        "n", "form", "prefix_chars", "middle_chars", "output")]).collect()
    texts = docs.select("doc_id", "text").collect()
    want = sorted(((r.doc_id, *plain(r.doc_id, r.text), r.text or "") for r in texts), key=repr)
    assert sorted(((r.doc_id, r._n, r._form, r._prefix_chars, r._middle_chars, r._output, r.back) for r in got), key=repr) == want
    assert {r._form for r in got} == {"plain", "psm", "spm"} and all(r.lang is not None or r.source != "x" for r in got)
    assert fill_middle.transform(no_docs).count() == 0
