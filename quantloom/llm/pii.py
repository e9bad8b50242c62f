"""Personal data: base patterns and information-theoretic sanitisation.

Base spans (e-mail, IP address, card, phone) come from fixed patterns.  They are the protected
entities.  What else gives an entity away is estimated from the corpus: a term discloses
PMI(entity; term) = log(N * together / (with entity * with term)) of the information IC(entity) = log(N / with entity)
that naming the entity would give.  The estimate is smoothed for every pair alike: the share PMI / IC is
multiplied by the lower confidence bound (Wilson, 95 %, one-sided) of together / (with term), the chance that a text
with the term holds the entity.  One text tells little (0.27 of the share), three texts 0.53, ten 0.79.  A
term whose smoothed share reaches ``alpha`` is generalised to its shape wherever it stands in the documents of that entity;
from ``remove`` of it on, it is removed.

All counts are of different whole texts, so copies of a page prove nothing: N and the texts with a term count equal
texts once; with an entity, texts also count once that share the smallest hash of their five-word shingles (a sketch
that near copies agree in with the probability of their similarity).  Every entity is paired with every term of its texts.

Pairs of an entity and a distinct term are summed inside the tasks
and then by (entity, term), so a hot entity is spread by its terms.  The texts are read once for the
spans, kept as a table with a row number (of the texts, those with entities), and once for the document
frequencies, which are summed inside the tasks.  There a bitmap of fixed largest size tells which texts are surely single;
the others are made distinct by a shuffle that combines map-side.  Pairs, frequencies and decisions meet in shuffled joins.

Defined cases: a null text counts as empty and has no spans; repeated rows are documents of their
own but one text; a text counts once per entity and term however often they occur in it, inside base spans too; spans
of terms never overlap base spans; an empty table gives an empty result.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import map_rows, materialise

KINDS = ("email", "ip", "card", "phone")
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match of digits always starts where its run of digits starts, so the look-behind changes nothing but the time
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W_]+")
_DIGIT = re.compile("[0-9]")
SPAN = "struct<kind:string,start:int,end:int>"
TERMS = "array<struct<start:int,end:int,remove:boolean>>"
#: Rows of an Arrow batch of pairs, and pairs that a task sums up at a time.
ROWS, ROOM = 50_000, 300_000
#: Quantile of the normal distribution for a one-sided bound of 95 %.
Z = 1.645
#: Bits of the largest bitmap of repeated texts (16 MB).
BITS = 1 << 27


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the e-mail pattern: the longest local part before each @ that a domain follows.

    The local part has no @, so walking back from each @ reads every character once.
    """
    last = 0
    for m in _AT.finditer(text):
        at = first = m.start()
        if at < last:
            continue
        while first > last and text[first - 1] in _LOCAL:
            first -= 1
        if first < at:
            yield first, m.end()
            last = m.end()


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, entity) by kind, then start; positions are code points, the entity is the normalised value."""
    out = []
    if "@" in text:
        out += [("email", a, b, "email:" + text[a:b].lower()) for a, b in emails(text)]
    if not _DIGIT.search(text):
        return out
    if "." in text:
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
            if all(len(p) <= 3 and int(p) <= 255 for p in parts):
                out.append(("ip", *m.span(), "ip:" + ".".join(parts)))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span(), "card:" + digits))
    if "+" in text:
        for m in _PHONE.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if 9 <= len(digits) <= 15:
                out.append(("phone", *m.span(), "phone:" + digits))
    return out


def terms_of(text: str) -> set[str]:
    """Distinct lower-cased terms of a text."""
    return {w.lower() for w in set(_TERM.findall(text))}


def outside(text: str, base: list[dict]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of the terms that touch no base span, in order."""
    taken = sorted((s["start"], s["end"]) for s in base)
    i, end = 0, 0  # the furthest end of the spans that start before the term does
    for m in _TERM.finditer(text):
        while i < len(taken) and taken[i][0] < m.end():
            end = max(end, taken[i][1])
            i += 1
        if end <= m.start():
            yield m[0].lower(), m.start(), m.end()


def sketch(text: str) -> int:
    """Smallest hash of the five-word shingles of a text: equal for equal texts, mostly for near copies, for no others."""
    words = [w.lower().encode() for w in _TERM.findall(text)]
    return min((xxhash.xxh3_64_intdigest(b" ".join(words[i:i + 5])) for i in range(max(1, len(words) - 4))), default=0) >> 1


def text_digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def scan(docs: DataFrame, text: str, keep_text: bool) -> DataFrame:
    """Struct ``row``, digest, text (null without entities unless kept), base spans, entities and their sketch per document, numbered by ``rid``."""
    rows = docs.select(F.struct(F.lit(None).cast("string").alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row"), F.col(text).alias("text"),
                       text_digest(F.col(text)).alias("digest"))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, entities, kept, sketches = [], [], [], []
            for t in b.column("text").to_pylist():
                found = base_spans(t) if t else []
                spans.append([{"kind": k, "start": s, "end": e} for k, s, e, _ in found])
                entities.append(sorted({x[3] for x in found}))
                kept.append(t if keep_text or found else None)
                sketches.append(sketch(t) if found else None)
            yield pa.RecordBatch.from_pydict({"row": b.column("row"), "digest": b.column("digest"), "text": pa.array(kept, pa.string()), "base": pa.array(spans, span),
                                              "entities": pa.array(entities, pa.list_(pa.string())), "sketch": pa.array(sketches, pa.int64())})
    found = map_rows(rows, run, f"row {rows.schema['row'].dataType.simpleString()}, digest binary, text string, base array<{SPAN}>, entities array<string>, sketch bigint")
    return materialise(found.withColumn("rid", F.monotonically_increasing_id()), "pii")


def bound(share: Column, n: Column) -> Column:
    """Lower confidence bound (Wilson) of a share observed in n cases."""
    z2 = Z * Z
    return (share + z2 / (2 * n) - Z * F.sqrt(F.greatest(share * (1 - share) / n + z2 / (4 * n * n), F.lit(0.0)))) / (1 + z2 / n)


def holders(scanned: DataFrame) -> DataFrame:
    """rid, text, base, ``held`` (number of the entity) and ``counted`` (entity, with_entity, first) of the documents with an entity.

    ``counted`` has the entities for which the document stands for its equals, ``first`` says that it also stands for its near copies.
    """
    each = scanned.select("rid", "digest", "sketch", F.explode("entities").alias("entity"))
    texts = each.groupBy("entity", "digest").agg(F.min("rid").alias("rid"), F.min("sketch").alias("sketch"))
    near = texts.groupBy("entity", "sketch").agg(F.min("rid").alias("rid"))
    counts = near.groupBy("entity").agg(F.count(F.lit(1)).alias("with_entity")).withColumn("number", F.monotonically_increasing_id())
    counts = materialise(counts, "pii-entities")
    own = texts.select("entity", "rid").join(near.select("entity", "rid", F.lit(True).alias("first")), ["entity", "rid"], "left").select(
        "entity", "rid", F.coalesce("first", F.lit(False)).alias("first"))
    # as many as the document has entities
    held = each.select("rid", "entity").join(counts, "entity").join(own, ["entity", "rid"], "left").groupBy("rid").agg(
        F.collect_list("number").alias("held"), F.collect_list(F.when(F.col("first").isNotNull(), F.struct(F.col("number").alias("entity"), "with_entity", "first"))).alias("counted"))
    return materialise(scanned.select("rid", "text", "base").join(held, "rid"), "pii-held")


def distinct_texts(scanned: DataFrame, docs: DataFrame, text: str) -> tuple[int, DataFrame, DataFrame]:
    """Number of different texts; the texts that surely stand once; one text of each of the others."""
    groups = scanned.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    n, repeated = groups.agg(F.count(F.lit(1)), F.count_if(F.col("n") > 1)).first()
    bits = min(BITS, max(1 << 20, 1 << (16 * repeated).bit_length()))
    spot = F.pmod(F.xxhash64("digest"), F.lit(bits))
    maps = groups.where("n > 1").select(F.bitmap_bucket_number(spot + 1).alias("k"), F.bitmap_bit_position(spot + 1).alias("p")).groupBy("k").agg(F.bitmap_construct_agg("p").alias("m"))
    filled = np.zeros(bits // 8 + 4096, np.uint8)
    for k, m in maps.collect():  # at most bits / 32768 rows of 4 KB
        filled[(k - 1) * 4096:k * 4096] = np.frombuffer(m, np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(filled)
    rows = docs.select(F.col(text).alias("text"), text_digest(F.col(text)).alias("digest")).withColumn("spot", spot)

    def some(wanted: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = b.column("spot").to_numpy(zero_copy_only=False)
                # a byte of the bitmap functions is filled from its lowest bit
                yield b.filter(pa.array(((sent.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1) == wanted)).select(["text", "digest"])
        return map_rows(rows, run, "text string, digest binary")
    return n, some(0).select("text"), some(1).groupBy("digest").agg(F.first("text").alias("text")).select("text")


def term_frequencies(texts: DataFrame, room: int = ROOM) -> DataFrame:
    """(term, df): number of texts with each term, in parts; every task adds up its own texts first."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: Counter[str] = Counter()
        for b in batches:
            for t in b.column("text").to_pylist():
                df.update(terms_of(t) if t else ())
                if len(df) > room:
                    yield pa.RecordBatch.from_pydict({"term": pa.array(df.keys(), pa.string()), "df": pa.array(df.values(), pa.int64())})
                    df = Counter()
        yield pa.RecordBatch.from_pydict({"term": pa.array(df.keys(), pa.string()), "df": pa.array(df.values(), pa.int64())})
    return map_rows(texts, count, "term string, df bigint")


def pair_counts(held: DataFrame, room: int = ROOM // 2) -> DataFrame:
    """(entity, with_entity, term, together, texts): texts with both, near copies counted once or each, terms of the whole text; tasks add up their own first."""
    def rows(n: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"entity": pa.array([k[0] for k in n], pa.int64()), "with_entity": pa.array([k[1] for k in n], pa.int64()), "term": pa.array([k[2] for k in n], pa.string()),
                                           "together": pa.array([v >> 32 for v in n.values()], pa.int64()), "texts": pa.array([v & 0xFFFFFFFF for v in n.values()], pa.int64())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[tuple[int, int, str]] = Counter()  # texts, and from bit 32 on those that stand for their near copies
        for b in batches:
            for t, counted in zip(b.column("text").to_pylist(), b.column("counted").to_pylist()):
                terms = terms_of(t)
                for e in counted:
                    one = 1 + (e["first"] << 32)
                    for w in terms:
                        n[e["entity"], e["with_entity"], w] += one
                    if len(n) > room:
                        yield rows(n)
                        n = Counter()
        yield rows(n)
    parts = map_rows(held.where(F.size("counted") > 0).select("text", "counted"), count, "entity bigint, with_entity bigint, term string, together bigint, texts bigint")
    return parts.groupBy("entity", "with_entity", "term").agg(F.sum("together").alias("together"), F.sum("texts").alias("texts"))


def disclosing(held: DataFrame, scanned: DataFrame, docs: DataFrame, text: str, alpha: float) -> DataFrame:
    """(entity, term, share): the terms that disclose at least ``alpha`` of an entity's information."""
    n, single, repeated = distinct_texts(scanned, docs, text)
    df = materialise(term_frequencies(single).unionByName(term_frequencies(repeated)).groupBy("term").agg(F.sum("df").alias("df")), "pii-terms")
    # no share is above the bound for k out of k texts, k / (k + z^2); pairs that cannot reach alpha need no look-up
    pairs = pair_counts(held).where(F.col("together") >= alpha * (F.col("together") + Z * Z) - 1e-9)
    # near copies with the entity count once among the texts with the term, too
    j = pairs.join(df, "term").withColumn("df", F.col("df") - F.col("texts") + F.col("together")).where(F.col("together") > 0)
    pmi = F.log(F.lit(float(n)) * F.col("together") / (F.col("with_entity") * F.col("df")))
    share = bound(F.col("together") / F.col("df"), F.col("df")) * F.try_divide(pmi, F.log(F.lit(float(n)) / F.col("with_entity")))
    return j.withColumn("share", share).where(F.col("share") >= alpha).select("entity", "term", "share")


def candidates(held: DataFrame) -> DataFrame:
    """(rid, entity, term): the distinct terms outside base spans of each document beside each of its entities."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rid, entity, term = [], [], []
            for r, t, base, held in zip(*(b.column(c).to_pylist() for c in ("rid", "text", "base", "held"))):
                words = {w for w, _, _ in outside(t, base)}
                for e in held:
                    rid += [r] * len(words)
                    entity += [e] * len(words)
                    term += words
                    if len(rid) > ROWS:
                        yield pa.RecordBatch.from_pydict({"rid": pa.array(rid, pa.int64()), "entity": pa.array(entity, pa.int64()), "term": pa.array(term, pa.string())})
                        rid, entity, term = [], [], []
            yield pa.RecordBatch.from_pydict({"rid": pa.array(rid, pa.int64()), "entity": pa.array(entity, pa.int64()), "term": pa.array(term, pa.string())})
    return map_rows(held, run, "rid bigint, entity bigint, term string")


def places(held: DataFrame, hits: DataFrame) -> DataFrame:
    """(rid, terms): every place outside base spans of the terms in ``hits`` (rid, term, remove), in order."""
    # as many as the document has distinct terms
    marked = held.select("rid", "text", "base").join(hits.groupBy("rid").agg(F.collect_list(F.struct("term", "remove")).alias("hits")), "rid")
    place = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("remove", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, base, hit in zip(*(b.column(c).to_pylist() for c in ("text", "base", "hits"))):
                risky = {h["term"]: h["remove"] for h in hit}
                out.append([{"start": s, "end": e, "remove": risky[w]} for w, s, e in outside(t, base) if w in risky])
            yield pa.RecordBatch.from_pydict({"rid": b.column("rid"), "terms": pa.array(out, place)})
    return map_rows(marked, run, f"rid bigint, terms {TERMS}")


def find(docs: DataFrame, text: str = "text", alpha: float = 0.5, remove: float = 0.75, keep_text: bool = False) -> DataFrame:
    """Per document: struct ``row``, text (if kept), ``base`` spans and ``terms`` (start, end, remove), both in order."""
    scanned = scan(docs, text, keep_text)
    held = holders(scanned)
    risky = materialise(disclosing(held, scanned, docs, text, alpha), "pii-risky")
    # documents of the entities that a term discloses
    given_away = held.select("rid", F.explode("held").alias("entity")).join(risky.select("entity").distinct(), "entity", "left_semi").select("rid").distinct()
    held = held.join(given_away, "rid", "left_semi")
    hits = candidates(held).join(risky, ["entity", "term"]).groupBy("rid", "term").agg((F.max("share") >= remove - 1e-9).alias("remove"))
    out = scanned.join(places(held, hits), "rid", "left").withColumn("terms", F.coalesce("terms", F.array().cast(TERMS)))
    return out.select("row", *(["text"] if keep_text else []), "base", "terms")


def span_columns(found: DataFrame) -> DataFrame:
    """Counts by kind, base_sha256 and spans (base kinds in order, then terms) next to ``row``."""
    base = F.array_join(F.transform("base", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    terms = F.array_join(F.transform("terms", lambda s: F.concat_ws(":", F.lit("term"), s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("row", *map(count, KINDS), F.sha2(base, 256).alias("base_sha256"), F.concat_ws(",", F.nullif(base, F.lit("")), F.nullif(terms, F.lit(""))).alias("spans"))


def shape(term: str) -> str:
    """Generalised term: a letter or digit kind per run, as in "Xx" or "0"."""
    return re.sub(r"(X|x|0)\1+", r"\1", "".join("0" if c.isdigit() else "X" if c.isupper() else "x" for c in term))


def cleaned(text: str | None, base: list, terms: list) -> str | None:
    """Text with base spans named by kind, removed terms as [TERM] and the others by their shape; of overlapping spans the first stays."""
    if text is None:
        return None
    spans = sorted([(s["start"], -s["end"], f"[{s['kind'].upper()}]") for s in base]
                   + [(s["start"], -s["end"], "[TERM]" if s["remove"] else shape(text[s["start"]:s["end"]])) for s in terms])
    out, last = [], 0
    for start, end, new in spans:
        if start >= last:
            out += [text[last:start], new]
            last = -end
        else:
            last = max(last, -end)
    return "".join([*out, text[last:]])


def sanitise(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents with their personal data replaced; other columns as given."""
    found = find(docs, text, keep_text=True, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [cleaned(*r) for r in zip(b.column("text").to_pylist(), b.column("base").to_pylist(), b.column("terms").to_pylist())]
            yield pa.RecordBatch.from_pydict({"row": b.column("row"), "text": pa.array(new, pa.string())})
    out = map_rows(found, run, f"row {found.schema['row'].dataType.simpleString()}, text string")
    return out.select(*[F.col("text").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
