"""Approximate nearest neighbours over shifted Hilbert curves.

Each of CURVES curves rotates the unit vectors by its own random projection to DIMS dimensions, shifts them and
orders them by the Hilbert index of their grid cell. Keys are range-partitioned into blocks. A query visits
the blocks within a window around its own on every curve, where all vectors are ranked by their exact cosine,
and the curves' finds are merged. How many of the curves are used and how wide the window is: the cheapest choice whose
recall, measured against brute force for a bounded sample of queries, reaches GOAL. Every row is indexed on each used
curve and every query answered.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from . import text as tx

CURVES, LEAST_CURVES, DIMS, GRID_BITS = 4, 2, 8, 7
NEIGHBOURS, QUERY_STEP = 5, 50
#: Queries that fit the window (at most), and the recall it aims at.
SAMPLE, GOAL = 128, 0.95
BLOCK_ROWS, LEAST_BLOCKS, MOST_BLOCKS = 4_096, 32, 65_536


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of integer points (rows), by the transpose method."""
    x = cells.astype(np.uint64).T.copy()
    n, one = len(x), np.uint64(1)
    q = 1 << (bits - 1)
    while q > 1:
        p, bit = np.uint64(q - 1), np.uint64(q)
        for i in range(n):
            high = (x[i] & bit) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & np.uint64(q)) != 0, np.uint64(q - 1), np.uint64(0))
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << one) | ((x[i] >> np.uint64(b)) & one)
    return out.astype(np.int64)


@functools.lru_cache(maxsize=CURVES)
def _curve(width: int, curve: int) -> tuple[np.ndarray, np.ndarray]:
    """Its projection and its shift."""
    rng = np.random.default_rng(1_000 + curve)
    plane = np.linalg.qr(rng.standard_normal((width, width)))[0][:, :DIMS]
    return plane, rng.random(plane.shape[1]) * 0.25


def curve_keys(unit: np.ndarray, curve: int) -> np.ndarray:
    plane, shift = _curve(unit.shape[1], curve)
    at = unit @ plane * np.sqrt(unit.shape[1])
    cells = np.floor((at / 6 + 0.5 + shift) / 1.25 * (1 << GRID_BITS))
    return hilbert_index(np.clip(cells, 0, (1 << GRID_BITS) - 1), GRID_BITS)


def _matrix(column: pa.Array | pa.ChunkedArray, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Vectors in double precision, shorter ones padded with zeros, and which take part: all finite, none null, not zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(sizes.max(initial=0)) if width is None else width
    values = pc.fill_null(column.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out, np.isfinite(out).all(1) & (out != 0).any(1)


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def top(queries: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k nearest ids of x other than its own, by the nearest row of each: query, id and exact score; ties to the smaller id."""
    order = np.argsort(ids, kind="stable")
    x, ids = x[order], ids[order]
    begun = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])[: len(ids)]
    qn, xn = _norms(queries), _norms(x)
    unit = x / xn[:, None]
    out = ([], [], [])
    for a in range(0, len(queries), 256):
        near = (queries[a : a + 256] / qn[a : a + 256, None]) @ unit.T
        near[query_ids[a : a + 256, None] == ids[None, :]] = -np.inf
        nearest_rows = near if len(begun) == len(ids) else np.maximum.reduceat(near, begun, axis=1)
        least = np.partition(nearest_rows, -k, axis=1)[:, -k] if len(begun) > k else np.full(len(near), -2.0)
        for i, row in enumerate(near):
            at = np.flatnonzero(row >= max(least[i] - 1e-9, -2.0))
            # as products of whole matrices may differ in the last bit, what counts is computed row by row
            score = np.clip(np.einsum("j,ij->i", queries[a + i], x[at]) / (qn[a + i] * xn[at]), -1, 1)
            best = np.lexsort((-score, ids[at]))
            best = best[np.r_[True, ids[at[best[1:]]] != ids[at[best[:-1]]]][: len(best)]]
            best = best[np.lexsort((ids[at[best]], -score[best]))[:k]]
            out[0].append(np.full(len(best), query_ids[a + i]))
            out[1].append(ids[at[best]])
            out[2].append(score[best])
    return tuple(np.concatenate(o) if o else np.zeros(0) for o in out)


_FOUND = "query_id long, vec_id long, score double"


def _found(query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> pa.Table:
    return pa.table({"query_id": pa.array(query.astype(np.int64)), "vec_id": pa.array(ids.astype(np.int64)), "score": pa.array(score.astype(float))})


def _rows(batch: pa.RecordBatch, width: int) -> tuple[pa.Array, np.ndarray]:
    """vec_ids and vectors of the rows that take part."""
    x, good = _matrix(batch.column("embedding"), width)
    good &= ~batch.column("vec_id").is_null().to_numpy(zero_copy_only=False)
    at = np.flatnonzero(good)
    return batch.column("vec_id").take(pa.array(at)), x[at]


def _keys(width: int):
    """Keys on every curve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = _rows(batch, width)
            unit = x / _norms(x)[:, None]
            for c in range(CURVES):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c, np.int32)), pa.array(curve_keys(unit, c)), ids], ["curve", "key", "vec_id"])

    return run


def _blocks(width: int, edges: dict[int, np.ndarray], curves: int, kind: type):
    """Rows on so many curves, each with its block, and the vector in the table's own precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.slices(batches, 4_096):
            ids, x = _rows(batch, width)
            unit, packed = x / _norms(x)[:, None], pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())
            for c in range(curves):
                block = np.searchsorted(edges[c], curve_keys(unit, c), side="right").astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c, np.int32)), pa.array(block), ids, packed], ["curve", "block", "vec_id", "vector"])

    return run


def _packed(table: pa.Table, kind: type) -> tuple[np.ndarray, np.ndarray]:
    raw = table.column("vector").to_pylist()
    return table.column("vec_id").to_numpy(), np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(float)


def nearest(embeddings: DataFrame, step: int = QUERY_STEP, k: int = NEIGHBOURS, goal: float = GOAL) -> DataFrame:
    """query_id, rank, vec_id and score: for rows whose vec_id is divisible by step, the k nearest found among all others.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do null vec_ids;
    shorter vectors count as padded with zeros. Rows that share a query's vec_id are not its candidates, other
    repeated vec_ids count once (the nearest). An empty table gives an empty result. Other columns are not looked at.
    """
    spark = embeddings.sparkSession
    source = embeddings.select("vec_id", "embedding")
    width = source.agg(F.max(F.size("embedding"))).first()[0] or 0
    if width <= 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    kind = np.float32 if isinstance(source.schema["embedding"].dataType.elementType, FloatType) else np.float64
    keyed = source.mapInArrow(_keys(width), "curve int, key long, vec_id long")
    rows = keyed.where("curve = 0").count()
    blocks = int(np.clip(rows // BLOCK_ROWS, LEAST_BLOCKS, MOST_BLOCKS))
    found = keyed.groupBy("curve").agg(F.percentile_approx("key", [(i + 1) / blocks for i in range(blocks - 1)], 10 * blocks).alias("edges")).collect()
    edges = {r.curve: np.unique(np.array(r.edges, np.int64)) for r in found}
    if not edges:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    curves, reach = _fit(source, width, edges, blocks, step, k, goal)
    schema = "curve int, block int, vec_id long, vector binary"
    placed = source.mapInArrow(_blocks(width, edges, curves, kind), schema)
    # blocks with more rows than usual (equal vectors have equal keys) are cut by vec_id; curves * blocks counts come to the driver
    sizes = {(r.curve, r.block): -(-r.n // (2 * BLOCK_ROWS)) for r in placed.groupBy("curve", "block").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = F.broadcast(spark.createDataFrame([(c, b, s) for (c, b), s in sizes.items()], "curve int, block int, cuts int"))  # at most CURVES * MOST_BLOCKS rows
    candidates = placed.join(table, ["curve", "block"]).withColumn("cut", F.pmod(F.xxhash64("vec_id"), F.col("cuts")).cast("int")).select("curve", "block", "cut", "vec_id", "vector")
    asked = source.where(F.col("vec_id") % step == 0).mapInArrow(_blocks(width, edges, curves, kind), schema)
    around = F.sequence(F.greatest(F.col("block") - reach, F.lit(0)), F.least(F.col("block") + reach, F.lit(blocks)))
    visits = asked.select("curve", F.explode(around).alias("block"), "vec_id", "vector").join(table, ["curve", "block"])
    visits = visits.select("curve", "block", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"), "vec_id", "vector")
    visits = visits.toDF("at_curve", "at_block", "at_cut", "asking_id", "asking")

    def rank(asking: pa.Table, here: pa.Table) -> pa.Table:
        if not asking.num_rows or not here.num_rows:
            return _found(np.zeros(0), np.zeros(0), np.zeros(0))
        (qi, q), (xi, x) = _packed(asking.rename_columns(here.column_names), kind), _packed(here, kind)
        return _found(*top(q, qi, x, xi, k))

    near = visits.groupBy("at_curve", "at_block", "at_cut").cogroup(candidates.groupBy("curve", "block", "cut")).applyInArrow(rank, _FOUND)
    once = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def cheapest(far: np.ndarray, blocks: int, goal: float) -> tuple[int, int]:
    """Curves to use and blocks to visit on either side, of those with recall ``goal`` the choice with the fewest visited blocks.

    far: for each true neighbour (rows) and curve how many blocks it is away from its query.
    """
    choices = []
    for curves in range(min(LEAST_CURVES, far.shape[1]), far.shape[1] + 1):
        reach = int(np.quantile(far[:, :curves].min(1), goal, method="higher")) if len(far) else 0
        choices.append((curves * min(2 * reach + 1, blocks), curves, reach))
    return min(choices)[1:]


def _fit(source: DataFrame, width: int, edges: dict[int, np.ndarray], blocks: int, step: int, k: int, goal: float) -> tuple[int, int]:
    """cheapest() for at most SAMPLE queries, against brute force over all rows."""
    queries = source.where((F.col("vec_id") % step == 0) & F.col("embedding").isNotNull())
    chosen = queries.select("vec_id").distinct().orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE)
    # rows that share a query's vec_id are asked each
    ids, q = _rows(queries.join(F.broadcast(chosen), "vec_id").distinct().toArrow().combine_chunks().to_batches()[0], width) if not chosen.isEmpty() else (pa.array([], pa.int64()), np.zeros((0, width)))
    if not len(q):
        return LEAST_CURVES, 0
    qi = ids.to_numpy(zero_copy_only=False)

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xi, x = _rows(batch, width)
            if len(x):
                yield from _found(*top(q, qi, x, xi.to_numpy(zero_copy_only=False), k)).to_batches()

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    true = source.mapInArrow(brute, _FOUND).groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "vec_id").collect()
    # at most SAMPLE * k neighbours; of rows that repeat a vec_id the farthest counts
    wanted = {r.vec_id for r in true}
    at = lambda xi, x: [(i, [int(np.searchsorted(edges[c], curve_keys(v, c), side="right")[0]) for c in range(CURVES)]) for i, v in ((i, (r / np.sqrt(r @ r))[None]) for i, r in zip(xi, x))]
    found = source.join(F.broadcast(source.sparkSession.createDataFrame([(i,) for i in wanted], "vec_id long")), "vec_id").distinct() if wanted else None
    theirs: dict[int, list[list[int]]] = {}
    for batch in found.toArrow().to_batches() if found is not None else []:
        xi, x = _rows(batch, width)
        for i, places in at(xi.to_pylist(), x):
            theirs.setdefault(i, []).append(places)
    mine: dict[int, list[list[int]]] = {}
    for i, places in at(qi.tolist(), q):
        mine.setdefault(i, []).append(places)
    far = [[max(min(abs(m[c] - t[c]) for m in mine[r.query_id]) for t in theirs[r.vec_id]) for c in range(CURVES)] for r in true]
    return cheapest(np.array(far).reshape(-1, CURVES), blocks, goal)
