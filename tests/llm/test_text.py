"""Encoding, decontamination and personal data against the library or brute force."""
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quantloom.llm import bpe, decontaminate, pii

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def codec():
    with open(VOCABULARY, "rb") as f:
        return bpe.Codec(f.read(), cache=500)


def test_ids_equal_the_library(codec):
    library = Tokenizer.from_file(VOCABULARY)
    rng = random.Random(1)
    parts = [*"abcXYZ 012  \n\t\r'!.,-_<|>éèñß漢字😀\u00a0\u2003\u200b\x00\x1c\x85\u0558\U000323b5\u3000ǅ", "'s", "'ll", "<|endoftext|>", "aaaa", " the"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["a" * 30_000, "ab" * 9999, " " * 3000, "\n" * 2000 + "x", "1" * 7777, "é" * 3333, "the" * 4000, ""]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        packed = codec.encode(t)
        assert np.frombuffer(packed, "<u4").tolist() == want
        assert codec.decode(packed).decode() == library.decode(want, skip_special_tokens=False)


def test_cuts_are_forced(codec):
    """No token spans a cut, and fragments encoded alone give the ids of the whole word."""
    for word in (b" hello", "naïve漢字kanji".encode(), b"xqzjvw" * 5):
        parts = codec.fragments(word)
        assert b"".join(parts) == word
        assert [i for p in parts for i in codec.merge(p)] == codec.merge(word)
        assert all(a[-1:] + b[:1] not in t for a, b in zip(parts, parts[1:]) for t in codec.id_of)


def test_encode_and_decode_tables(odd_docs, no_docs):
    e = bpe.encode(odd_docs, VOCABULARY)
    assert e.columns == [c for c in odd_docs.columns if c not in ("text", "ids")] + ["ids"]
    back = {(r.doc_id, r.text) for r in bpe.decode(e, VOCABULARY).collect()}
    assert back == {(r.doc_id, r.text or "") for r in odd_docs.collect()}
    d = bpe.encode(odd_docs.select("doc_id", "text"), VOCABULARY, digests=True).where("doc_id = 9").first()
    assert d.decoded_sha256 == hashlib.sha256("İstanbul ǅ 漢字 \U0001F600 Straße".encode()).hexdigest()
    assert bpe.encode(no_docs, VOCABULARY).count() == 0


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_hits(text, items, window=13):
    ws, hit, names = words_of(text), set(), set()
    for name, t in items:
        iw = words_of(t)
        k = min(window, len(iw))
        for g in {tuple(iw[i:i + k]) for i in range(len(iw) - k + 1)} if iw else ():
            for i in range(len(ws) - k + 1):
                if tuple(ws[i:i + k]) == g:
                    hit |= set(range(i, i + k))
                    names.add(str(name))
    return len(ws), len(hit), sorted(names)


@pytest.mark.parametrize("block_words", [100_000, 60])
def test_decontamination_equals_brute_force(spark, block_words):
    rng = random.Random(7)
    vocab = [f"v{i}" for i in range(6)] + ["É", "x9"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice((1, 2, 5, 12, 13, 14, 40, 150))))) for i in range(12)]
    items = [x for x in items if x[1].count(" ") > 1] + [(90, None), (91, "..."), (92, items[-1][1]), (92, "v1 v2 v3 v4 v5 v0")]
    docs = []
    for i in range(60):
        parts = [" ".join(rng.choice([*vocab, "Other"]) for _ in range(rng.randint(0, 30))) for _ in range(3)]
        for j in rng.sample(range(len(items)), 2):
            iw = (items[j][1] or "").split()
            at = rng.randint(0, max(0, len(iw) - 13))
            parts.insert(1, ", ".join(iw[at:at + rng.choice((12, 13, 20))]).upper())
        docs.append((i, " ".join(parts)))
    docs += [(100, None), (101, ""), (102, "!!")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_spans(spark.createDataFrame(docs, "doc_id long, text string"), bench, block_words=block_words)
    for r in decontaminate.verdicts(found).collect():
        n, hit, names = brute_hits(dict(docs)[r.row.doc_id], items)
        assert (r.n_words, r.n_hit, r["items"]) == (n, hit, names)
        assert r.contaminated == (hit > 0 and 20 * hit >= n) and r.n_items == len(names)


def test_spans_are_cut_out(spark):
    item = " ".join(f"q{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"Keep this. {item.upper()}! And this", 1), (2, "clean", 2), (3, None, 3)], "doc_id long, text string, spans int")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.remove_spans(docs, bench).collect()}
    assert got[1].text == "Keep this. ! And this" and got[2].text == "clean" and got[3].text is None and got[1].spans == 1
    assert sorted(r.doc_id for r in decontaminate.clean_documents(docs, bench).collect()) == [2, 3]


def test_decontamination_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(None, "the quick brown fox jumps over the lazy dog again and again"), (1, "")], "item_id long, text string")
    got = decontaminate.verdicts(decontaminate.find_spans(odd_docs, bench)).select("row.doc_id", "n_hit", "items", "contaminated").collect()
    assert len(got) == odd_docs.count()
    assert {r.doc_id for r in got if r.contaminated} == {1, 2} and [r["items"] for r in got if r.doc_id == 1] == [["null"]]
    assert decontaminate.clean_documents(odd_docs, bench).columns == odd_docs.columns
    assert decontaminate.clean_documents(no_docs, bench).count() == 0
    assert decontaminate.clean_documents(odd_docs, bench.where("false")).count() == odd_docs.count()


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
            "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            double = [int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))]
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and sum(double) % 10 == 0, "phone": 9 <= len(d) <= 15}
            if good[kind]:
                out.append((kind, *m.span()))
    return out


def test_base_spans_equal_plain_patterns():
    rng = random.Random(3)
    some = ["4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (415) 555-2671", "a.b@c-d.org", "10.0.0.255", "10.0.0.256", "é"]
    for _ in range(20_000):
        t = "".join(rng.choice([*"a1@.-+ 0257é(b@.1 3", *some]) for _ in range(rng.randint(0, 40)))
        assert [x[:3] for x in pii.base_spans(t)] == brute_spans(t)
    for t in ("a" * 200_000 + "@", "1" * 100_000 + "." + "1" * 5000, "@a" * 50_000, "1-" * 60_000 + "+", "a@" * 50_000 + "b.c"):
        pii.base_spans(t)  # linear


def brute_terms(docs, alpha=0.5):
    """Terms by document, from plain counting over different whole texts."""
    import xxhash
    term = re.compile(r"[^\W_]+")
    words = lambda t: [w.lower() for w in term.findall(t or "")]

    def klass(t):
        w = [x.encode() for x in words(t)]
        return min((xxhash.xxh3_64_intdigest(b" ".join(w[i:i + 5])) for i in range(max(1, len(w) - 4))), default=0)
    texts = {t or "": set(words(t)) for t in docs}
    entities = {t: {b[3] for b in pii.base_spans(t)} for t in texts}
    n, out = len(texts), []
    for doc in docs:
        risky, base = set(), pii.base_spans(doc or "")
        for e in {b[3] for b in base}:
            holds = [t for t in texts if e in entities[t]]
            first = {}
            for t in docs:  # the first of its near copies stands for them
                if (t or "") in holds:
                    first.setdefault(klass(t), t)
            for w in texts[doc or ""]:
                k = sum(w in texts[t] for t in first.values())
                df = sum(w in x for x in texts.values()) - sum(w in texts[t] for t in holds) + k
                if not k or len(first) == n:
                    continue
                p, z2 = k / df, 1.645 ** 2
                sure = (p + z2 / 2 / df - 1.645 * np.sqrt(p * (1 - p) / df + z2 / 4 / df / df)) / (1 + z2 / df)
                if sure * np.log(n * k / len(first) / df) / np.log(n / len(first)) >= alpha:
                    risky.add(w)
        out.append([m.span() for m in term.finditer(doc or "") if m[0].lower() in risky and not any(m.start() < b and a < m.end() for _, a, b, _ in base)])
    return out


def found_terms(spark, docs):
    table = spark.createDataFrame([*enumerate(docs)], "doc_id long, text string").coalesce(1)
    return {r.row.doc_id: [(t.start, t.end) for t in r.terms] for r in pii.find(table).collect()}, {r.doc_id: r.text for r in pii.sanitise(table).collect()}


def test_disclosing_terms_equal_brute_force(spark):
    rng = random.Random(11)
    people = [(f"p{i}@mail.example.org", f"nick{i}") for i in range(6)]
    docs = []
    for i in range(120):
        ws = [f"c{rng.randint(0, 30)}" for _ in range(rng.randint(0, 40))]
        if i % 3 == 0:
            mail, nick = rng.choice(people)
            at = rng.randint(0, len(ws))
            ws[at:at] = [nick, mail, "writes"]
        docs.append(" ".join(ws))
    docs += [None, "", "10.1.2.3", *docs[:30], *[d + " tail" for d in docs[:12]]]  # copies and near copies
    got, clean = found_terms(spark, docs)
    assert got == dict(enumerate(brute_terms(docs))) and any(got.values())
    texts = [t or "" for t in clean.values()]
    assert not any("@" in t or "nick" in t for t in texts) and any("[EMAIL]" in t for t in texts)


def test_disclosing_terms_of_whole_documents(spark):
    """A name far from the address counts and is masked everywhere, but not in documents without the entity."""
    rng = random.Random(5)
    filler = lambda k: " ".join(f"c{rng.randint(0, 20)}" for _ in range(k))
    docs = [f"İNick{i % 4} {filler(30)} Far{i % 4} {filler(30)} far{i % 4} m{i % 4}@mail.example.org, 10.0.0.{i % 4} far{i % 4}" for i in range(48)]
    docs += ["m1 " + docs[1], filler(20) + " far1 elsewhere", *[filler(40) for _ in range(80)], None, "once@example.org alone"]
    got, clean = found_terms(spark, docs)
    assert got == dict(enumerate(brute_terms(docs)))
    assert all(len(got[i]) >= 4 for i in range(48)) and got[49] == [] and (0, 2) in got[48]
    assert not any("far" in clean[i].lower() or "nick" in clean[i].lower() for i in range(48)) and clean[49] == docs[49]


def test_three_texts_disclose_and_copies_do_not(spark):
    rng = random.Random(8)
    filler = lambda k: " ".join(f"c{rng.randint(0, 400)}" for _ in range(k))
    named = [f"{filler(20)} Grimaldi {filler(20)} anna@mail.example.org {filler(9)}" for _ in range(3)]
    page = f"Otterlund {filler(200)} bert@mail.example.org"
    twice = [f"{filler(20)} Piazzolla {filler(20)} carl@mail.example.org" for _ in range(2)]
    docs = [*named, *[page] * 6, *[page + f" tail{i}" for i in range(4)], *twice, *[filler(30) for _ in range(200)]]
    got, clean = found_terms(spark, docs)
    assert got == dict(enumerate(brute_terms(docs)))
    assert all("Grimaldi" not in clean[i] and "[EMAIL]" in clean[i] for i in range(3))
    assert all(clean[i].startswith("Otterlund") for i in range(3, 13)) and all("Piazzolla" in clean[i] for i in (13, 14))


def test_pii_odd_rows(odd_docs, no_docs):
    cols = pii.span_columns(pii.find(odd_docs)).collect()
    assert len(cols) == odd_docs.count() and all(r.spans == "" for r in cols)
    assert pii.sanitise(odd_docs).columns == odd_docs.columns and pii.sanitise(no_docs).count() == 0
