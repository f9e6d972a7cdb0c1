"""How well a linear classifier tells batches of rows from a reference: logistic models of a small batch in its task, of all large batches and folds in the same jobs."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import sampling

ROUNDS = 12
#: Rows of a batch, and of the reference, up to which one task fits all models of the batch.
OWN = 1 << 16


def auroc(reference: DataFrame, batches: DataFrame, batch: str, key: str, values: list[str], k: int = 5, penalty: float = 1.0, fold: Column | None = None) -> DataFrame:
    """batch, n, auroc: the area under the curve of probabilities that models without a row's fold give, ties counting a half.

    A row's fold is that of the CRC32 of its key, so repeated keys lie together, or what ``fold`` says (0 to k - 1). Both classes weigh the same. Values are standardised by the reference; nulls and values that are not finite become
    its mean. A batch without rows in two classes has null. Batches of OWN rows at most are fitted in a task each, beside a reference of as many at most, which comes to
    the driver. Of others, names and, each round, a gradient and Hessian of each batch and fold come to the driver; the reference is ranked once a batch.
    """
    own = [F.when(F.abs(F.col(v).cast("double")) < float("inf"), F.col(v).cast("double")).alias(f"_v{i}") for i, v in enumerate(values)]
    fold = (F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(k)) if fold is None else fold).cast("int").alias("fold")
    named = batches.where(F.col(batch).isNotNull()).select(batch, fold, *own)
    reference = cut(reference.select(fold, *own))  # read whole, and beside large batches
    sizes = cut(named.groupBy(batch).agg(F.count(F.lit(1)).alias("n")))
    held = reference.limit(OWN + 1).toArrow()
    small = F.col("n") <= (OWN if held.num_rows <= OWN else 0)
    kind = batches.schema[batch].dataType.simpleString()
    out = named.join(sizes.where(small).select(batch), batch).groupBy(batch).applyInArrow(_alone(held, len(values), k, penalty), f"`{batch}` {kind}, n long, auroc double")
    names = [r[0] for r in sizes.where(~small).orderBy(batch).collect()]
    return out.unionByName(_together(reference, named, batch, names, len(values), k, penalty)) if names else out


def _alone(held: pa.Table, many: int, k: int, penalty: float):
    """Of one batch's rows: its name, n and auroc, all folds fitted beside the reference."""
    wide = np.column_stack([held.column(i + 1).to_numpy() for i in range(many)]) if held.num_rows else np.zeros((0, many))
    known, of = ~np.isnan(wide), np.maximum((~np.isnan(wide)).sum(axis=0), 1)
    mean = np.where(known, wide, 0).sum(axis=0) / of
    spread = np.sqrt((np.where(known, wide - mean, 0) ** 2).sum(axis=0) / of)
    spread[spread == 0] = 1
    other = held.column("fold").to_numpy()

    def run(part: pa.Table) -> pa.Table:
        own = np.column_stack([part.column(i + 2).to_numpy() for i in range(many)])
        x = np.vstack([wide, own])
        x = np.column_stack([np.where(np.isnan(x), 0.0, (x - mean) / spread), np.ones(len(x))])
        fold, y = np.concatenate([other, part.column("fold").to_numpy()]), np.repeat([0, 1], [len(wide), len(own)])
        used = fold[:, None] != np.arange(k)
        counts = np.stack([used[y == c].sum(axis=0) for c in (0, 1)])
        share = used * (counts.sum(axis=0) / 2 / np.maximum(counts, 1))[y]
        hold, weights = np.diag([penalty] * many + [1e-9]), np.zeros((k, many + 1))
        for _ in range(ROUNDS):
            said = 1 / (1 + np.exp(-np.clip(x @ weights.T, -35, 35)))
            slope = (share * (y[:, None] - said)).T @ x - weights * np.diag(hold)
            curve = share * said * (1 - said)
            step = np.linalg.solve(np.stack([(x * curve[:, f, None]).T @ x for f in range(k)]) + hold, slope[..., None])[..., 0]
            weights = weights + step
            if np.abs(step).max() < 1e-8:
                break
        s = np.round((x * weights[fold]).sum(axis=1), 9)
        less, more = np.sort(s[y == 0]), s[y == 1]
        above = (np.searchsorted(less, more) + np.searchsorted(less, more, "right")).sum() / 2
        return pa.table([part.column(0).slice(0, 1), pa.array([len(more)]), pa.array([above / len(less) / len(more) if len(less) else None], pa.float64())], names=[part.schema.names[0], "n", "auroc"])

    return run


def _together(reference: DataFrame, batches: DataFrame, batch: str, names: list, many: int, k: int, penalty: float) -> DataFrame:
    """batch, n and auroc of the named batches, fitted by sums of all tasks."""
    numbers = batches.sparkSession.createDataFrame([(i, n) for i, n in enumerate(names)], batches.select(F.lit(0).alias("b"), F.col(batch)).schema)
    mine = batches.join(F.broadcast(numbers), batch)  # a row a large batch
    cols = [f"_v{i}" for i in range(many)]
    rows = reference.select(F.lit(-1).alias("b"), "fold", *cols).unionByName(mine.select("b", "fold", *cols))
    rows = cut(rows.repartitionByRange("b", "fold", *cols).sortWithinPartitions("b"))  # a part of a task holds few batches
    stats = rows.where("b < 0").agg(*[f(v) for v in cols for f in (F.avg, F.stddev_pop)]).first()
    mean, spread = np.array([s or 0.0 for s in stats[::2]]), np.array([s or 1.0 for s in stats[1::2]])
    weights, balance = np.zeros((len(names), k, many + 1)), _balance(rows, len(names), k)
    for _ in range(ROUNDS):
        step = _step(rows, weights, balance, mean, spread, penalty)
        weights = weights + step
        if np.abs(step).max() < 1e-8:
            break
    scored = _scored(rows, weights, mean, spread)
    counts = scored.groupBy("b", "s").agg(F.sum(1 - F.col("y")).alias("n0"), F.sum("y").alias("n1"))
    ranked = sampling.running(counts, ["b", "s"], "n0", "before")
    totals = ranked.groupBy("b").agg(F.sum("n1").alias("n"), F.try_divide(F.sum(F.col("n1") * (F.col("before") + F.col("n0") / 2)) - F.min("before") * F.sum("n1"), F.sum("n0") * F.sum("n1")).alias("auroc"))
    return totals.join(numbers, "b").select(F.col(batch), "n", "auroc")


def _design(batch: pa.RecordBatch, mean: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    wide = np.column_stack([batch.column(i + 2).to_numpy(zero_copy_only=False) for i in range(len(mean))])
    x = np.where(np.isnan(wide), 0.0, (wide - mean) / spread)
    return batch.column(0).to_numpy(), batch.column(1).to_numpy(), np.column_stack([x, np.ones(len(x))])


def _models(b: np.ndarray, batches: int) -> Iterable[int]:
    """Batches that some rows have a part in: their own, or all where rows of the reference are among them."""
    return range(batches) if (b < 0).any() else np.unique(b)


def _balance(rows: DataFrame, batches: int, k: int) -> np.ndarray:
    """Weights of reference and batch rows in each model, so that both have half of its sum."""
    counts = np.zeros((batches + 1, k))  # the reference last
    for r in rows.groupBy("b", "fold").count().collect():
        counts[r["b"], r["fold"]] = r["count"]
    other = counts.sum(axis=1, keepdims=True) - counts
    both = np.stack([np.broadcast_to(other[-1], (batches, k)), other[:-1]], -1)
    return both.sum(axis=-1, keepdims=True) / 2 / np.maximum(both, 1)


def _step(rows: DataFrame, weights: np.ndarray, balance: np.ndarray, mean: np.ndarray, spread: np.ndarray, penalty: float) -> np.ndarray:
    """Newton's step of every model: tasks send sums, by model and place in (Hessian, gradient)."""
    batches, k, p = weights.shape

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((batches, k, p + 1, p))
        for part in parts:
            b, fold, x = _design(part, mean, spread)
            for m in _models(b, batches):
                for f in range(k):
                    use = ((b == m) | (b < 0)) & (fold != f)
                    own, y = x[use], (b[use] == m).astype(float)
                    said = 1 / (1 + np.exp(-np.clip(own @ weights[m, f], -35, 35)))
                    share = balance[m, f][y.astype(int)]
                    total[m, f, :p] += (own * (share * said * (1 - said))[:, None]).T @ own
                    total[m, f, p] += own.T @ (share * (y - said))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["cell", "v"])

    total = np.zeros(batches * k * (p + 1) * p)
    for r in rows.mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():
        total[r["cell"]] = r["v"]
    total = total.reshape(batches, k, p + 1, p)
    hold = np.diag([penalty] * (p - 1) + [1e-9])
    return np.linalg.solve(total[:, :, :p] + hold, (total[:, :, p] - weights * np.diag(hold))[..., None])[..., 0]


def _scored(rows: DataFrame, weights: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> DataFrame:
    """b, s, y: each batch's rows (1) and all of the reference (0), by the log-odds of the model without their fold."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            b, fold, x = _design(part, mean, spread)
            for m in _models(b, len(weights)):
                use = (b == m) | (b < 0)
                s = np.round((x[use] * weights[m][fold[use]]).sum(axis=1), 9) + 0.0
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), m, np.int32)), pa.array(s), pa.array((b[use] == m).astype(np.int64))], names=["b", "s", "y"])

    return rows.mapInArrow(run, "b int, s double, y long")
