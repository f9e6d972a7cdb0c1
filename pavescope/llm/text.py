"""Words, hashes and shards shared by the corpus operators.

Words are maximal runs of bytes outside ``\\x20`` and ``\\x09-\\x0D`` of the UTF-8 text, which are
the matches of ``[^\\x20\\x09-\\x0D]+``. All hashing is vectorised over the bytes of many documents.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
WORD = r"[^\x20\x09-\x0D]+"
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = U64(0xD6E8FEB86659FD93)
#: A second multiplier: sums by the two collide independently, sums by one with other salts do not.
OTHER_STEP = U64(0xA0761D6478BD642F)
CHUNK_BYTES = 1 << 19
#: Text bytes meant for one partition, and groups (shards) in it.
PARTITION_BYTES, SHARDS_EACH = 20 << 20, 4

_separator = np.zeros(256, bool)
_separator[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_byte_value = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@functools.lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _BASE_INVERSE):
        steps = np.full(1 << bits, base, U64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=U64))
    return out[0], out[1]


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The concatenated UTF-8 bytes and the offsets of each text; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    return data, offsets


@dataclass
class Words:
    """Hashed words of consecutive documents ``first … first+len(bounds)-2``; document i has words bounds[i]:bounds[i+1]."""

    first: int
    hashes: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray
    stems: dict[int, np.ndarray]

    def doc(self, at: np.ndarray) -> np.ndarray:
        """Of word positions, the document's place in this chunk."""
        return np.searchsorted(self.bounds, at, side="right") - 1

    def room(self) -> np.ndarray:
        """For each word, how many words its document has from it on."""
        return np.repeat(self.bounds[1:], np.diff(self.bounds)) - np.arange(len(self.hashes))


def hashed_words(data: np.ndarray, offsets: np.ndarray, stems: tuple[int, ...] = (), lower: bool = False) -> Iterator[Words]:
    """Word hashes of whole documents, some half megabyte of text at a time (or one longer document).

    lower: with A-Z in lower case. stems: byte lengths; for each, the hash of a word's first bytes as if they were the word (0 for shorter words).
    """
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, side="right")) - 1)
        own, edges = data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        if lower:
            own = np.where((own >= 65) & (own <= 90), own + np.uint8(32), own)
        inside = ~_separator[own]
        starting, ending = inside.copy(), inside.copy()
        starting[1:] &= ~inside[:-1]
        ending[:-1] &= ~inside[1:]
        if len(own):
            cut = edges[1:-1][(edges[1:-1] > 0) & (edges[1:-1] < len(own))]
            starting[cut] = inside[cut]
            ending[cut - 1] = inside[cut - 1]
        starts, ends = np.flatnonzero(starting), np.flatnonzero(ending) + 1
        up, down = _powers(max(20, int(len(own)).bit_length()))
        sums = np.zeros(len(own) + 1, U64)
        np.cumsum(_byte_value[own] * up[: len(own)], dtype=U64, out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64) * _STEP)
        cut = {}
        for size in stems:
            to_size = np.minimum(starts + size, ends)
            cut[size] = np.where(ends - starts >= size, mix((sums[to_size] - sums[starts]) * down[starts] + np.full(1, size, U64) * _STEP), U64(0))
        yield Words(at, hashes, np.searchsorted(starts, edges), starts, ends, own, cut)
        at = to


def rolling(hashes: np.ndarray, k: int, salt: int = 0, step: np.uint64 = _STEP) -> np.ndarray:
    """A hash of each run of k consecutive words (document edges are not looked at)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.full(n, salt, U64)
    for j in range(k):
        out *= step
        out += hashes[j : j + n]
    return mix(out)


def sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """The minimum (or maximum) of each run of ``width`` values."""
    best, have, op = values, 1, np.minimum if least else np.maximum
    while have < width:
        step = min(have, width - have)
        best = op(best[:-step], best[step:]) if len(best) > step else best[:0]
        have += step
    return best


def doc_shard(shards: int, doc_id: str = "doc_id") -> Column:
    return F.pmod(F.xxhash64(F.col(doc_id)), F.lit(shards)).cast("int")


def partitions_for(docs: DataFrame, text: str = "text") -> int:
    """Partitions that hold about PARTITION_BYTES of text each; one aggregate over the whole column."""
    size = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES))


def by_shard(docs: DataFrame, carried: list[str] | None = None) -> tuple[DataFrame, int]:
    """(doc_id, text, shard, and a struct of carried columns) dealt out so that a shard lies in one task; and the number of partitions.

    Plans that use the returned frame more than once share its exchange.
    """
    n = partitions_for(docs)
    more = [F.struct(*carried).alias("carried")] if carried else []
    return docs.select("doc_id", "text", doc_shard(n * SHARDS_EACH).alias("shard"), *more).repartition(n, "shard"), n


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset (tests), one under the warehouse."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared").rstrip("/")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of an Arrow batch where whole texts go to Python: the JVM and the worker each hold a batch or two of every task.
TEXT_ROWS = 512


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def text_batches(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """What runs inside moves rows to Python TEXT_ROWS at a time."""
    return setting(spark, _BATCH_ROWS, str(TEXT_ROWS))


def written(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet to the shared folder and read back: a cut in the lineage that outlives executors.

    The shuffle files of the write are removed with its end.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with setting(spark, _CLEANUP, "true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Deletes what written() made, once nothing reads it any more."""
    jvm = table.sparkSession._jvm
    for file in table.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Rows that one task of a summing level takes.
FAN_IN = 1_024


def in_levels(parts: DataFrame, key: str, add) -> DataFrame:
    """Rows of one key added up by add (a table to a table of one row, same schema): FAN_IN tasks' rows at a time, then those sums.

    A task holds a row of a key for each of FAN_IN tasks, or for each such lot, and never one for all.
    """
    schema = parts.schema
    lots = parts.withColumn("_lot", F.expr(f"spark_partition_id() div {FAN_IN}"))
    first = lots.groupBy(key, "_lot").applyInArrow(lambda table: add(table.drop(["_lot"])), schema)
    return first.groupBy(key).applyInArrow(add, schema)


def ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.float64(): "double", pa.string(): "string", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in smaller ones, so that what is made of one is small, here and in the JVM."""
    for whole in batches:
        for a in range(0, whole.num_rows, rows):
            yield whole.slice(a, rows)


def given_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; after the last one the worker hands what it has freed back to the system.

    Workers stay alive between stages, beside a JVM that needs the executor's memory next.
    """
    yield from batches
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def sorted_docs(table: pa.Table) -> pa.Table:
    """Documents by doc_id (nulls last), rows of one doc_id by text (nulls last)."""
    order = pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("text", "ascending")], null_placement="at_end")
    return table.take(order)
