"""WARC archives: writing captures, reading them back, and merging the runs of the capture index.

Writing.  Payloads that occurred before become ``revisit`` records.  Which ones is decided on digests
only; the page bodies are shuffled once at most, to part the two kinds, and are written by Spark's text
writer whose line separator is the blank line after a record, so an archive is a plain WARC file
(gzip-compressed as a whole).  The records of a file are bounded in number by size class, since a file
is read by one task.

Reading.  Each task unpacks its archives piece by piece, gzip member by member (own archives have one, record-compressed
ones one per record), walks through them by Content-Length and returns index
entries, sorted by URL key and time and numbered: a run.  An entry leads back to its record: archive, start of the gzip
member in it, start and length of the record in the unpacked member; ``fetch`` reads records by their entries.  The runs are
written as a table of the shared folder.  An archive that ends inside of a member or record stops the job.

Merging.  The entries are range-partitioned by (URL key, time, page), so a hot URL is split as well;
each task then merges the slices of the runs it received with a loser tree; a slice that the shuffle delivers in several
blocks is as many sorted runs, told apart by their numbers, so nothing is sorted again.  The ranges follow each
other, which gives the global order: (``run_range``, ``line``) number it.

Defined cases: a null body is an empty payload; a null URL has no target field and the empty key; of
equal payloads the rows with the smallest page_id are responses; a null page_id is never the smallest
unless all are null, then all are responses; repeated rows are records of their own; an empty table
gives an empty index.  Blanks and control characters in a URL are percent-encoded in the header.
"""
from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.common import map_rows, materialise, shared_folder

#: Payloads with fewer bytes are always stored in full.
MIN_REVISIT_BYTES = 100
#: Upper payload size of a class and the most records a file of it has: files stay near 128 MB.
SIZE_CLASSES = [(1 << 16, 2000), (1 << 20, 128), (None, 1)]
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
END = "\r\n\r\n"
ENTRY = ("urlkey string, captured string, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, "
         "archive string, member bigint, start bigint, length bigint")
#: Bytes unpacked at a time, and the most that the fields of a record may take.
PIECE, MOST_FIELDS = 1 << 18, 1 << 24


def decide(pages: DataFrame) -> DataFrame:
    """page_id, digest and first page of the rows that revisit an earlier payload."""
    d = pages.select("page_id", "digest", "bytes").where(F.col("bytes") >= MIN_REVISIT_BYTES)
    first = d.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return d.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to").distinct()


def _record(kind: str, block: Column, length: Column) -> Column:
    """Header and block of a record; what follows it is the writer's line separator."""
    url = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    field = lambda k, v: F.concat(F.lit(f"{k}: "), v, F.lit("\r\n"))
    head = [F.lit("WARC/1.1\r\n"), field("WARC-Type", F.lit(kind)), field("WARC-Record-ID", name("page_id")), field("WARC-Date", F.col("captured")),
            F.coalesce(field("WARC-Target-URI", url), F.lit("")), field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
            field("X-Payload-Length", F.col("bytes").cast("string"))]
    if kind == "revisit":
        head += [field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), field("WARC-Refers-To", name("refers_to"))]
    head += [field("Content-Type", F.lit("application/http; msgtype=response")), field("Content-Length", length.cast("string"))]
    return F.concat(*head, F.lit("\r\n"), block).alias("value")


def write(pages: DataFrame, folder: str, captured: Column) -> None:
    """Archive files of all pages (page_id, url, html) below ``folder``."""
    rows = pages.select("page_id", "url", captured.alias("captured"), F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumns({"bytes": F.octet_length("payload").cast("long"), "digest": F.sha2(F.encode("payload", "UTF-8"), 256)})
    again = materialise(decide(rows), "revisits")
    same = rows["page_id"].eqNullSafe(again["page_id"]) & (rows["digest"] == again["digest"])
    options = {"lineSep": END, "compression": "gzip"}
    low = -1
    if again.isEmpty():
        response = rows
    else:
        response = rows.join(again, same, "left_anti")
        revisit = rows.drop("payload").join(again.withColumnRenamed("digest", "_d"), rows["page_id"].eqNullSafe(again["page_id"]) & (rows["digest"] == F.col("_d")))
        revisit = revisit.select(rows["page_id"], "url", "captured", "bytes", "digest", "refers_to")
        revisit.select(_record("revisit", F.lit(""), F.lit(0))).write.mode("append").options(**options, maxRecordsPerFile=100_000).text(folder)
    for high, records in SIZE_CLASSES:
        part = response.where((F.col("bytes") > low) & (F.col("bytes") <= high if high else F.lit(True)))
        block = F.concat(F.lit(HTTP), F.col("payload"))
        part.select(_record("response", block, F.col("bytes") + len(HTTP))).write.mode("append").options(**options, maxRecordsPerFile=records).text(folder)
        low = high


def unpacked(raw: bytes, packed: bool) -> Iterator[tuple[int, bytes]]:
    """(start of the gzip member, piece of its unpacked bytes) of an archive; plain archives are one member at 0."""
    view, at = memoryview(raw), 0
    if not packed:
        for at in range(0, len(view), PIECE):
            yield 0, bytes(view[at:at + PIECE])
        return
    while at < len(view):
        member, unpack = at, zlib.decompressobj(31)
        while not unpack.eof:
            if at >= len(view):
                raise ValueError(f"archive ends inside of the gzip member at byte {member}")
            feed = view[at:at + PIECE]
            piece = unpack.decompress(feed, PIECE)
            while piece:
                yield member, piece
                # a full piece may have left output behind although all input is consumed
                more = not unpack.eof and (unpack.unconsumed_tail or len(piece) == PIECE)
                piece = unpack.decompress(unpack.unconsumed_tail, PIECE) if more else b""
            at += len(feed) - len(unpack.unused_data)


def records(pieces: Iterator[tuple[int, bytes]]) -> Iterator[tuple[dict[str, str], bytes, int, int, int]]:
    """Header fields and block of every record, with the start of its member and its start and length inside of it."""
    held, base, member, head, size = bytearray(), 0, 0, None, 0
    for m, piece in pieces:
        if m != member:
            if held:
                raise ValueError(f"a record runs over the end of the member at byte {member}")
            member, base = m, 0
        held += piece
        at = 0
        while True:
            if head is None:
                end = held.find(b"\r\n\r\n", at)
                if end < 0:
                    if len(held) - at > MOST_FIELDS:
                        raise ValueError(f"no end of header fields after byte {base + at} of the member at byte {member}")
                    break
                first, *lines = held[at:end].decode("utf-8").split("\r\n")
                if not first.startswith("WARC/"):
                    raise ValueError(f"no WARC record at byte {base + at} of the member at byte {member}")
                head = dict(line.split(": ", 1) for line in lines)
                size = end + 4 - at + int(head["Content-Length"])
            if len(held) < at + size + 4:
                break
            if held[at + size:at + size + 4] != b"\r\n\r\n":
                raise ValueError(f"record does not end at byte {base + at + size} of the member at byte {member}")
            block = size - int(head["Content-Length"])
            yield head, bytes(held[at + block:at + size]), member, base + at, size
            at, head = at + size + 4, None
        del held[:at]
        base += at
    if held:
        raise ValueError(f"archive ends inside of a record at byte {base} of the member at byte {member}")


def url_key(url: str) -> str:
    """Host labels from the last to the first, then the rest of the URL: captures of a site sort together."""
    rest = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", url)
    host = re.match(r"[^/?#]*", rest)[0]
    return ",".join(reversed(host.lower().split("."))) + ")" + rest[len(host):].split("#")[0]


def _page(field: str | None) -> int | None:
    name = field[len("<urn:page:"):-1] if field else "null"
    return None if name == "null" else int(name)


def entry(head: dict[str, str], block: bytes, archive: str, member: int, start: int, length: int) -> tuple:
    """Index entry of a record; size and digest of a response are those of its block."""
    key, page = url_key(head.get("WARC-Target-URI", "")), _page(head["WARC-Record-ID"])
    if head["WARC-Type"] == "revisit":
        return key, head["WARC-Date"], page, int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha256:"), "revisit", _page(head["WARC-Refers-To"]), archive, member, start, length
    payload = block[block.index(b"\r\n\r\n") + 4:]
    return key, head["WARC-Date"], page, len(payload), hashlib.sha256(payload).hexdigest(), "response", None, archive, member, start, length


def sort_key(e: tuple) -> tuple:
    return e[0], e[1], e[2] is not None, e[2] or 0, e[5]


def _archives(spark: SparkSession, folder: str) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    return spark.read.format("binaryFile").load(folder).select(name.alias("archive"), "content")


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """(run, number, entries sorted by URL key and time): the index of every archive, one sorted run per file."""
    schema = pa.schema([("run", pa.string()), ("number", pa.int64()), *[(f.split(" ")[0], pa.int64() if f.endswith("bigint") else pa.string()) for f in ENTRY.split(", ")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("archive").to_pylist(), b.column("content")):
                found = sorted((entry(h, block, name, *place) for h, block, *place in records(unpacked(content.as_py(), name.endswith(".gz")))), key=sort_key)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([[name] * len(found), range(len(found)), *zip(*found)], schema.types)], schema=schema)
    return map_rows(_archives(spark, folder), run, f"run string, number bigint, {ENTRY}")


def fetch(spark: SparkSession, folder: str, entries: DataFrame) -> DataFrame:
    """The entries with the ``block`` of their record; each archive is read by one task, as far as its last wanted record."""
    places = entries.groupBy("archive").agg(F.sort_array(F.collect_set(F.struct("member", "start"))).alias("wanted"))  # at most the records of a file
    files = _archives(spark, folder).join(places, "archive")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content, wanted in zip(b.column("archive").to_pylist(), b.column("content"), b.column("wanted").to_pylist()):
                left = {(w["member"], w["start"]) for w in wanted}
                for _, block, member, start, _ in records(unpacked(content.as_py(), name.endswith(".gz"))):
                    if (member, start) in left:
                        left.remove((member, start))
                        yield pa.RecordBatch.from_pydict({"archive": [name], "member": [member], "start": [start], "block": pa.array([block], pa.binary())})
                        if not left:
                            break
    found = map_rows(files, read, "archive string, member bigint, start bigint, block binary")
    return entries.join(found, ["archive", "member", "start"])


class LoserTree:
    """k-way merge of sorted runs: inner nodes keep the loser of their match, so a new head meets one opponent per level."""

    def __init__(self, runs: list[list[tuple]]) -> None:
        self.runs, self.at = runs, [0] * len(runs)
        self.size = 1 << max(0, (len(runs) - 1).bit_length())
        self.head = [self._key(i) for i in range(self.size)]
        winner = [0] * (2 * self.size)
        winner[self.size:] = range(self.size)
        self.loser = [0] * self.size
        for node in range(self.size - 1, 0, -1):
            a, b = winner[2 * node], winner[2 * node + 1]
            winner[node], self.loser[node] = (a, b) if self.head[a] <= self.head[b] else (b, a)
        self.best = winner[1] if self.size > 1 else 0

    def _key(self, i: int) -> tuple:
        """Finished runs lose against all others; equal keys go to the earlier run."""
        if i >= len(self.runs) or self.at[i] >= len(self.runs[i]):
            return (1,)
        return 0, sort_key(self.runs[i][self.at[i]]), i

    def __iter__(self) -> Iterator[tuple]:
        while self.head[self.best] != (1,):
            i = self.best
            yield self.runs[i][self.at[i]]
            self.at[i] += 1
            self.head[i] = self._key(i)
            node = (self.size + i) // 2
            while node:
                if self.head[self.loser[node]] < self.head[i]:
                    i, self.loser[node] = self.loser[node], i
                node //= 2
            self.best = i


def merge_runs(runs: DataFrame, entries_per_range: int = 50_000) -> DataFrame:
    """The entries of all runs in one global order, numbered by (run_range, line)."""
    spark = runs.sparkSession
    n = runs.count()
    ranges = max(1, -(-n // entries_per_range), min(spark.sparkContext.defaultParallelism, -(-n // 1000)))
    # the last two keys split captures that share URL, time and page
    dealt = runs.repartitionByRange(ranges, "urlkey", "captured", "page_id", "record_type", "run").withColumn("run_range", F.spark_partition_id())
    names = [f.split(" ")[0] for f in ENTRY.split(", ")]
    schema = pa.schema([*[(c, pa.int64() if f.endswith("bigint") else pa.string()) for c, f in zip(names, ENTRY.split(", "))], ("run_range", pa.int32()), ("line", pa.int64())])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[tuple[str, int], list[tuple]] = {}
        last: dict[str, tuple[int, int]] = {}  # per run the number of its last entry and of its block
        number = 0
        for b in batches:
            number = b.column("run_range")[0].as_py() if b.num_rows else number
            for run, at, *e in zip(b.column("run").to_pylist(), b.column("number").to_pylist(), *(b.column(c).to_pylist() for c in names)):
                # a shuffle may deliver the blocks of a run in any order
                before, block = last.get(run, (-1, 0))
                block += at < before
                last[run] = at, block
                blocks.setdefault((run, block), []).append(tuple(e))
        tree = LoserTree([blocks[k] for k in sorted(blocks)])
        line, out = 0, []
        for e in tree:
            out.append(e)
            if len(out) == 10_000:
                yield _lines(out, number, line)
                line, out = line + len(out), []
        if out:
            yield _lines(out, number, line)

    def _lines(out: list[tuple], number: int, line: int) -> pa.RecordBatch:
        cols = [*zip(*out), np.full(len(out), number, np.int32), np.arange(line, line + len(out))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)

    return map_rows(dealt, merge, f"{ENTRY}, run_range int, line bigint")


def capture_index(pages: DataFrame, captured: Column | None = None, folder: str | None = None) -> DataFrame:
    """Write all pages as archives, read them back and return the merged index.

    ``captured`` is the capture time as text; without one it is counted up in seconds by page_id.
    """
    spark = pages.sparkSession
    folder = folder or shared_folder(spark, "warc")
    if captured is None:
        second = F.coalesce(F.col("page_id"), F.lit(0)) % F.lit(3_000_000_000)
        captured = F.date_format(F.timestamp_seconds(second + 946_684_800), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    write(pages, folder, captured)
    return merge_runs(materialise(read_runs(spark, folder), "runs"))
