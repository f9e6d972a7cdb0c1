"""WARC archives with an externally merged capture index.

Writers cut their captures into runs of bounded size, sort each by (URL key, timestamp) and write it as
one archive of gzip members together with its index lines. The index lines are range-partitioned by
(URL key, timestamp), and in each range a loser tree merges the sorted slices of all runs, which gives
capture histories in one global order: each capture's place in the history of its URL key, and the capture
before it. Histories that cross ranges are joined by one row a range. Archives are read back record by record
through that index.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from base64 import b32decode, b32encode
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import text as tx

#: Payloads of at least so many bytes are written once, and the other captures of them as revisits.
LEAST_REVISIT = 1_000
RUN_BYTES = 32 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "url_key string, captured_at string, record string, file string, offset long, length long"
HISTORY = INDEX + ", part int, place long, before string"
#: Index lines meant for one range of the merge, which are in its task's memory.
RANGE_LINES = 200_000


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    for ours, theirs in (("s3a://", "s3://"), ("s3n://", "s3://"), ("abfss://", "abfs://")):
        path = theirs + path.removeprefix(ours) if path.startswith(ours) else path
    return fs.FileSystem.from_uri(path)


def qualified(spark: SparkSession, path: str) -> str:
    """path with the scheme of the file system that Spark takes it to be on: the default one where it names none."""
    jvm = spark._jvm
    given = jvm.org.apache.hadoop.fs.Path(path)
    return given.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(given).toString()


def url_key(url: str | None) -> str:
    """Host labels in reverse, then the rest: ``http://a.Example.org/x?q`` is ``org,example,a)/x?q``."""
    scheme, found, rest = (url or "").partition("://")
    if not found:
        return url or ""
    cut = min((k for k in (rest.find(c) for c in "/?#") if k >= 0), default=len(rest))
    return ",".join(reversed(rest[:cut].lower().split("."))) + ")" + rest[cut:].partition("#")[0]


def captured_at(page_id: int | None) -> str:
    """The tables hold no capture time: one second for each page_id from 2024 on."""
    return (datetime(2024, 1, 1) + timedelta(seconds=(page_id or 0) % (1 << 31))).strftime("%Y-%m-%dT%H:%M:%SZ")


def _printable(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    digest = b32encode(hashlib.sha1(payload).digest()).decode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {captured_at(page_id)}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_printable(url)}")
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return ("WARC/1.1\r\n" + "".join(h + "\r\n" for h in [*head, f"Content-Length: {len(block)}"]) + "\r\n").encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload bytes, payload digest (hex), record type, refers_to. A response's payload must have its digest."""
    top, _, rest = data.partition(b"\r\n\r\n")
    head = dict(line.split(": ", 1) for line in top.decode().split("\r\n")[1:])
    block = rest[: int(head["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    of = lambda name: None if (x := head[name].removeprefix("<urn:page:").removesuffix(">")) == "None" else int(x)
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    if head["WARC-Type"] == "response" and (len(payload) != size or b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"damaged record {head['WARC-Record-ID']}")
    return of("WARC-Record-ID"), size, b32decode(digest).hex(), head["WARC-Type"], of("WARC-Refers-To") if "WARC-Refers-To" in head else None


def _write_runs(folder: str, run_bytes: int):
    def write(rows: list[tuple]) -> pa.RecordBatch:
        files, base = open_folder(folder)
        rows.sort(key=lambda r: (r[0], r[1], str(r[2])))
        name, at, lines = f"run-{uuid.uuid4().hex}.warc.gz", 0, []
        files.create_dir(base, recursive=True)
        # a name of its own for each attempt: only archives named in the committed index are read
        with files.open_output_stream(f"{base}/{name}", compression=None) as out:
            for key, when, page_id, url, payload, refers_to in rows:
                member = gzip.compress(record(page_id, url, payload, refers_to), 1, mtime=0)
                out.write(member)
                lines.append((key, when, str(page_id), name, at, len(member)))
                at += len(member)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*lines)], ["url_key", "captured_at", "record", "file", "offset", "length"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                payload = (html or "").encode()
                rows.append((url_key(url), captured_at(page_id), page_id, url, payload, refers_to))
                size += len(payload) + 1_000
                if size > run_bytes:
                    yield write(rows)
                    rows, size = [], 0
        if rows:
            yield write(rows)

    return run


class LoserTree:
    """Merges sorted iterables: inner nodes keep the losers of a tournament, so each row costs one path to the root."""

    def __init__(self, sources: Iterable[Iterable]):
        self.sources = [iter(s) for s in sources]
        self.k = len(self.sources)
        self.heads = [next(s, None) for s in self.sources]
        self.losers = [-1] * max(self.k, 1)
        self.winner = self._build(1) if self.k else -1

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) <= (y, b))

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        best, self.losers[node] = (a, b) if self._beats(a, b) else (b, a)
        return best

    def __iter__(self):
        while self.k and self.heads[self.winner] is not None:
            leaf = self.winner
            yield self.heads[leaf]
            self.heads[leaf] = next(self.sources[leaf], None)
            node = (leaf + self.k) // 2
            while node:
                if self._beats(self.losers[node], leaf):
                    leaf, self.losers[node] = self.losers[node], leaf
                node //= 2
            self.winner = leaf


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one key range, sorted by (file, key, time): the slices of the runs one after another. With each line's
    place among those of its key in this range, and the record before it there.
    """
    rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns))]
    edges = [i for i in range(len(rows)) if i == 0 or rows[i][3] != rows[i - 1][3]] + [len(rows)]
    names = [c.split()[0] for c in HISTORY.split(", ")]
    part, out, last, place = TaskContext.get().partitionId(), [], None, 0
    for row in LoserTree(rows[a:b] for a, b in zip(edges[:-1], edges[1:])):
        follows = last is not None and last[0] == row[0]
        place = place + 1 if follows else 1
        out.append((*row, part, place, last[2] if follows else None))
        last = row
        if len(out) == 10_000:
            yield _lines(out, names)
            out = []
    if out:
        yield _lines(out, names)


def _lines(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"offset": pa.int64(), "length": pa.int64(), "place": pa.int64(), "part": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(k, pa.string())) for k, c in zip(names, zip(*rows))], names)


def write_archives(pages: DataFrame, folder: str, run_bytes: int = RUN_BYTES) -> DataFrame:
    """Writes an archive for each sorted run to folder and returns the runs' index lines (INDEX), written to a table."""
    html = F.coalesce("html", F.lit(""))
    pages = pages.select("page_id", "url", "html", F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("bytes"))
    large = pages.where(F.col("bytes") >= LEAST_REVISIT).groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    written = pages.join(large, "digest", "left").select("page_id", "url", "html", refers.alias("refers_to"))
    return tx.written(written.mapInArrow(_write_runs(folder, run_bytes), INDEX), "warc-index")


def capture_index(lines: DataFrame) -> DataFrame:
    """The index lines of all runs (HISTORY) in global order of (url_key, captured_at, record, file, offset): by part, and inside each.

    place counts the captures of a URL key from 1 in this order, before is the record of the capture before.
    """
    n = max(1, -(-lines.count() // RANGE_LINES))
    order = ["url_key", "captured_at", "record", "file", "offset"]
    # written once: the numbers of the parts are those of this one run
    merged = tx.written(lines.repartitionByRange(n, *order).sortWithinPartitions("file", *order[:3], "offset").mapInArrow(_merge, HISTORY), "warc-merged")
    # one row a range of RANGE_LINES lines; a key's ranges follow each other
    last = F.max_by(F.struct("url_key", "place", "record"), F.struct("url_key", "place"))
    ends = merged.groupBy("part").agg(last.alias("last"), F.min("url_key").alias("first_key")).select("part", "first_key", "last.*")
    upto = F.sum("place").over(Window.partitionBy("url_key").orderBy("part"))
    before = Window.orderBy("part")
    carried = ends.withColumn("upto", upto).select("part", "first_key", *[F.lag(k).over(before).alias(f"last_{k}") for k in ("url_key", "upto", "record")])
    carried = carried.where("first_key = last_url_key").select("part", F.col("first_key").alias("url_key"), "last_upto", "last_record")
    whole = merged.join(carried, ["part", "url_key"], "left")
    names = [c.split()[0] for c in HISTORY.split(", ")]
    out = whole.withColumn("before", F.when(F.col("place") == 1, F.col("last_record")).otherwise(F.col("before"))).withColumn("place", F.col("place") + F.coalesce("last_upto", F.lit(0)))
    return out.select(*names)


_READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url_key", pa.string()), ("captured_at", pa.string()), ("place", pa.int64()), ("before", pa.int64())])


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The indexed records: page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, captured_at, and the
    capture's place in the history of its url_key with the page_id of the capture before it.
    """
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = open_folder(folder)
        name, source = None, None
        for batch in batches:
            out = []
            for key, when, file, offset, length, place, before in zip(*(c.to_pylist() for c in batch.columns)):
                if file != name:
                    name, source = file, files.open_input_file(f"{base}/{file}")
                source.seek(offset)
                out.append((*parse(zlib.decompress(source.read(length), 31)), key, when, place, None if before in (None, "None") else int(before)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _READ)], schema=_READ)

    lines = index.select("url_key", "captured_at", "file", "offset", "length", "place", "before")
    dealt = lines.repartition(n, "file", F.expr(f"offset div {RUN_BYTES // 8}")).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, tx.ddl(_READ))


def archived(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Every row of pages written to archives, indexed and read back through the merged capture index (see read_records).

    Null html is an empty payload, a null url has the empty key. Of equal payloads of LEAST_REVISIT bytes or
    more the greatest page_id (nulls least) responds; rows repeating it respond as well, all others revisit it.
    An empty table writes nothing and gives an empty result. Other columns are not looked at.
    """
    folder = qualified(pages.sparkSession, folder or f"{tx.shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}")
    return read_records(capture_index(write_archives(pages, folder)), folder)
