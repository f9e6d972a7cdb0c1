"""Many small groups at once: rows dealt and sorted by key, handed to NumPy in tables of whole groups."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that hold whole groups, of batches sorted by keys: the last group of a batch waits for its next rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        tail = np.ones(batch.num_rows, bool)
        for key in keys:
            column, last = batch.column(key), batch.column(key)[batch.num_rows - 1]
            tail &= (pc.fill_null(pc.equal(column, last), False) if last.is_valid else pc.is_null(column)).to_numpy(zero_copy_only=False)
        cut = batch.num_rows - int(tail.sum())
        if cut or (held and not _same(held[-1], batch, keys)):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _same(before: pa.RecordBatch, after: pa.RecordBatch, keys: list[str]) -> bool:
    return all(before.column(k)[before.num_rows - 1].as_py() == after.column(k)[0].as_py() for k in keys)


def starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where each group begins, and the end of the last."""
    fresh = np.zeros(max(table.num_rows - 1, 0), bool)
    for key in keys:
        column = table.column(key).combine_chunks()
        a, b = column[:-1], column[1:]
        fresh |= pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False) | pc.xor(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
    return np.r_[0, np.flatnonzero(fresh) + 1, table.num_rows] if table.num_rows else np.zeros(1, np.int64)


def map_groups(rows: DataFrame, keys: list[str], order: list[str], over: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """over applied to tables of whole groups of rows, sorted by keys and order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys):
            yield from over(table.combine_chunks()).to_batches()

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
