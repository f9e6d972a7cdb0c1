"""Principal components of vectors: standardised by a fitting part, from sums that tasks add up, with fixed signs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Dimensions up to which the moments (a square of doubles) are held by one task: 8 MB.
MOST_DIMENSIONS = 1024
#: Sums that one task of the next level adds up, and levels.
FAN_IN, LEVELS = 32, 3


@dataclass
class Fit:
    """mean, deviation and components (a row each) of vectors; shares: each component's part of the variance."""

    mean: np.ndarray
    deviation: np.ndarray
    components: np.ndarray
    shares: np.ndarray


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Vectors of ``size`` finite components, as rows; others as rows of NaN."""
    out = np.full((len(column), size), np.nan)
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    whole = np.flatnonzero(sizes == size)
    if len(whole):
        out[whole] = column.take(pa.array(whole)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, size)
    out[~np.isfinite(out).all(axis=1)] = np.nan
    return out


def moments(vectors: DataFrame, column: str, size: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, mean and centred products of the vectors; those of another size, or with a missing or infinite component, are left out.

    Each task centres its own sums, and sums are merged by pairs of counts and means in levels of FAN_IN tasks, so what a
    task or the driver holds is a square of the dimensions, whatever the rows.
    """

    def merge(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
        n, mean, products = 0, np.zeros(size), np.zeros((size, size))
        for m, other, more in parts:
            if m:
                shift = other - mean
                products = products + more + np.outer(shift, shift) * (n * m / (n + m))
                mean, n = mean + shift * (m / (n + m)), n + m
        return n, mean, products

    def packed(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        n, mean, products = merge(parts)
        return pa.RecordBatch.from_arrays([pa.array([n]), pa.array([mean.tobytes()], pa.binary()), pa.array([products.tobytes()], pa.binary())], ["n", "mean", "products"])

    def unpacked(n: int, mean: bytes, products: bytes) -> tuple[int, np.ndarray, np.ndarray]:
        return n, np.frombuffer(mean), np.frombuffer(products).reshape(size, size)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = (0, np.zeros(size), np.zeros((size, size)))
        for batch in batches:
            rows = _matrix(batch.column(0), size)
            rows = rows[~np.isnan(rows[:, 0])]
            if len(rows):
                mean = rows.mean(axis=0)
                total = merge([total, (len(rows), mean, (rows - mean).T @ (rows - mean))])
        yield packed([total])

    def level(table: pa.Table) -> pa.Table:
        summed = pa.Table.from_batches([packed([unpacked(*row.values()) for row in table.select(["n", "mean", "products"]).to_pylist()])])
        return summed.append_column("lot", table.column("lot").slice(0, 1).cast(pa.int32()))

    schema = "n long, mean binary, products binary"
    parts = vectors.select(column).mapInArrow(own, schema)
    lots = parts.withColumn("lot", F.spark_partition_id())
    for _ in range(LEVELS):
        lots = lots.withColumn("lot", F.expr(f"lot div {FAN_IN}").cast("int")).groupBy("lot").applyInArrow(level, f"{schema}, lot int")
    return merge([unpacked(*row) for row in lots.drop("lot").collect()])  # a row for FAN_IN ** LEVELS tasks


def fit(vectors: DataFrame, column: str, size: int, n: int) -> Fit:
    """The n leading components of standardised vectors (population deviation and a millionth).

    A component points where its largest entry, by amount, is positive (the first on ties), so that signs are the same
    every time. Without vectors the components are zeros.
    """
    if size > MOST_DIMENSIONS:
        raise ValueError(f"{size} dimensions; at most {MOST_DIMENSIONS}")
    rows, mean, products = moments(vectors, column, size)
    deviation = np.sqrt(np.diag(products) / max(rows, 1)) + 1e-6
    values, modes = np.linalg.eigh(products / np.outer(deviation, deviation))
    order = np.argsort(values, kind="stable")[::-1][:n]
    modes = modes[:, order].T
    heads = modes[np.arange(len(modes)), np.abs(modes).argmax(axis=1)]
    modes = modes * np.where(heads < 0, -1.0, 1.0)[:, None]
    return Fit(mean, deviation, modes if rows else np.zeros_like(modes), values[order] / max(values.sum(), 1e-300))


def projected(vectors: DataFrame, key: str, column: str, fitted: Fit, prefix: str = "emb_pc") -> DataFrame:
    """key and one column for each component of each vector; nulls where a vector has another size or misses a component."""
    names = [f"{prefix}{k:02d}" for k in range(len(fitted.components))]
    kind = vectors.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = ((_matrix(batch.column(1), len(fitted.mean)) - fitted.mean) / fitted.deviation) @ fitted.components.T
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[:, k], from_pandas=True) for k in range(len(names)))], [key, *names])

    return vectors.select(key, column).mapInArrow(run, ", ".join([f"{key} {kind}", *(f"{k} double" for k in names)]))
