"""Corpus-wide counts of hashed keys in a table of fixed size.

Every occurrence in the corpus is counted; keys share a counter when their leading hash bits are equal.
The table has 2 ** bits counters whatever the corpus, so it may be broadcast; what tasks send for it
grows with the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import text as tx

BITS, BLOCK_BITS = 20, 14


def counter_of(hashes: np.ndarray, bits: int = BITS) -> np.ndarray:
    return (hashes >> tx.U64(64 - bits)).astype(np.int64)


def corpus_counts(docs: DataFrame, keys: Callable[[tx.Words], np.ndarray], lower: bool = True, bits: int = BITS, as_kept: Callable[[np.ndarray], np.ndarray] = lambda sums: sums.astype(float)) -> tuple[np.ndarray, int]:
    """The summed counters of keys(words) over all texts, block by block as_kept, and the number of rows of docs.

    as_kept runs before blocks are sent, so the driver gets and holds no more than what is kept.
    """
    none = as_kept(np.zeros(1, np.int64))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows = np.zeros(1 << bits, np.uint32), 0
        for batch in tx.slices(batches):
            rows += batch.num_rows
            for words in tx.hashed_words(*tx.text_bytes(batch.column("text")), lower=lower):
                np.add.at(own, counter_of(keys(words), bits), 1)
        if rows:
            blocks = own.reshape(-1, 1 << BLOCK_BITS)
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(blocks)), pa.int32()), pa.array([str(rows).encode(), *(zlib.compress(b.astype(np.int64).tobytes(), 1) for b in blocks)], pa.binary())], ["block", "sums"])

    def add(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        if block < 0:
            total = str(sum(int(x.as_py()) for x in table.column("sums"))).encode()
        else:
            summed = np.zeros(1 << BLOCK_BITS, np.int64)
            for x in table.column("sums"):
                summed += np.frombuffer(zlib.decompress(x.as_py()), np.int64)
            total = zlib.compress(summed.tobytes(), 1)
        return pa.table({"block": pa.array([block], pa.int32()), "sums": pa.array([total], pa.binary())})

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column("block").to_pylist()
            sums = [x.as_py() if b < 0 else zlib.compress(as_kept(np.frombuffer(zlib.decompress(x.as_py()), np.int64)).tobytes(), 6) for b, x in zip(blocks, batch.column("sums"))]
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(sums, pa.binary())], ["block", "sums"])

    parts = docs.select("text").mapInArrow(count, "block int, sums binary")
    out, rows = np.full(1 << bits, none[0]), 0
    with tx.text_batches(docs.sparkSession):
        for r in tx.in_levels(parts, "block", add).mapInArrow(kept, "block int, sums binary").collect():
            if r.block < 0:
                rows = int(r.sums)
            else:
                out[r.block << BLOCK_BITS : (r.block + 1) << BLOCK_BITS] = np.frombuffer(zlib.decompress(r.sums), none.dtype)
    return out, rows


MARK_BITS = 24


def marks(df: DataFrame, column: str) -> np.ndarray:
    """One bit (2 ** MARK_BITS in all, whatever the input) for each leading-bits value of a 64-bit hash column, set where it occurs."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << MARK_BITS, bool)
        for batch in batches:
            own[counter_of(batch.column(0).to_numpy(zero_copy_only=False).view(tx.U64), MARK_BITS)] = True
        blocks = np.packbits(own).reshape(256, -1)
        full = np.flatnonzero(blocks.any(1))
        if len(full):
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([blocks[b].tobytes() for b in full], pa.binary())], ["block", "bits"])

    def join(table: pa.Table) -> pa.Table:
        bits = np.bitwise_or.reduce([np.frombuffer(x.as_py(), np.uint8) for x in table.column("bits")])
        return pa.table({"block": table.column("block").slice(0, 1), "bits": pa.array([bits.tobytes()], pa.binary())})

    out = np.zeros((256, 1 << (MARK_BITS - 11)), np.uint8)
    for r in tx.in_levels(df.select(column).mapInArrow(mark, "block int, bits binary"), "block", join).collect():
        out[r.block] = np.frombuffer(bytes(r.bits), np.uint8)
    return out.ravel()


def marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = counter_of(hashes.view(tx.U64), (8 * len(bits)).bit_length() - 1)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
