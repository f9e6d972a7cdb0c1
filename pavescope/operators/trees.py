"""Boosted regression trees: the models of all folds grow together, from histograms that tasks make and Spark sums."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..session import cut
from . import sampling

#: Residuals are summed as whole numbers, so the sums are the same whatever the order of rows and tasks.
STEPS = 1 << 24
#: Rounds after which predictions so far are written beside the rows; between them each round is held in the tasks and made from the one before.
KEEP = 25
#: Rows that one task of a round goes through, about: rows of a small file may lie in one partition, whatever their number.
TASK_ROWS = 50_000


@dataclass(frozen=True)
class Settings:
    rounds: int = 40
    rate: float = 0.1
    depth: int = 3
    bins: int = 32
    least: int = 20
    penalty: float = 1.0


@dataclass
class Forest:
    """Models 0 to folds - 1, each grown without the rows of its fold, and the last, grown from all. Held by the driver and sent to tasks:
    its size is models x rounds x 2^depth, whatever the rows."""

    features: list[str]
    edges: list[np.ndarray]
    folds: int
    settings: Settings
    base: np.ndarray
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def binned(self, batch: pa.RecordBatch) -> np.ndarray:
        """Bins of each row and feature: 0 where the value is null or NaN, else one more than the edges below it."""
        out = np.zeros((batch.num_rows, len(self.features)), np.uint8)
        for i, name in enumerate(self.features):
            v = batch.column(batch.schema.get_field_index(name)).cast(pa.float64()).to_numpy(zero_copy_only=False)
            out[:, i] = np.where(np.isnan(v), 0, np.searchsorted(self.edges[i], v, "left") + 1)
        return out

    def added(self, bins: np.ndarray) -> np.ndarray:
        """What the trees add to each row, by model."""
        out = np.zeros((len(bins), self.folds + 1))
        for splits in self.trees:
            for m in range(self.folds + 1):
                out[:, m] += splits[3][m][_descend(bins, *(s[m] for s in splits[:3]), self.settings.depth)]
        return out

    def scored(self, rows: DataFrame, fold: str | None = None) -> DataFrame:
        """rows with ``fitted`` (the model of all rows) and, with a fold column, ``out_of_fold`` (the model that its fold had no part in; null without a fold).

        Null where a model had no rows to grow from. Raises where rows has such columns.
        """
        new = ["fitted", *(["out_of_fold"] if fold else [])]
        if clash := set(new) & set(rows.columns):
            raise ValueError(f"columns are in the way: {sorted(clash)}")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                every = self.base + self.added(self.binned(batch))
                columns = [every[:, -1]]
                if fold:
                    own = batch.column(batch.schema.get_field_index(fold)).cast(pa.float64()).to_numpy(zero_copy_only=False)
                    held = np.where(np.isnan(own), 0, own).astype(int)
                    columns.append(np.where(np.isnan(own), np.nan, every[np.arange(len(held)), held]))
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, mask=np.isnan(c)) for c in columns)], names=[*batch.schema.names, *new])

        return rows.mapInArrow(run, StructType([*rows.schema.fields, *(StructField(name, DoubleType()) for name in new)]))


def _descend(bins: np.ndarray, feature: np.ndarray, most: np.ndarray, blank_left: np.ndarray, depth: int) -> np.ndarray:
    """The node of each row ``depth`` levels down (0 to 2^depth - 1)."""
    node = np.zeros(len(bins), np.int64)
    for level in range(depth):
        at = node + (1 << level) - 1
        own = bins[np.arange(len(bins)), feature[at]]
        node = 2 * node + np.where(own == 0, ~blank_left[at], own > most[at])
    return node


def edges(rows: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Where each feature is cut: its exact quantiles, from one melted table; features x bins numbers come to the driver."""
    if not 2 <= bins <= 200:
        raise ValueError("bins are 2 to 200")
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(k).cast("double").alias("v")) for i, k in enumerate(features)])).alias("p")).select("p.f", "p.v")
    found = {r["f"]: np.unique([r[f"q{i}"] for i in range(1, bins)]) for r in sampling.quantiles(long, "v", {f"q{i}": i / bins for i in range(1, bins)}, ["f"]).collect()}
    return [found.get(i, np.zeros(0)) for i in range(len(features))]


def fit(rows: DataFrame, features: list[str], target: str, fold: str | None = None, folds: int = 0, settings: Settings = Settings()) -> Forest:
    """Models for squared error of the rows with a finite target; with a fold column (0 to folds - 1), also those without each fold.

    Splits send nulls and NaN to the better side; ties go to the first feature and the least edge. Rows with a null fold train every model.
    Bins come from the features of all training rows, held-out ones included. A round takes one job of one stage a level: each task sends at most
    models x nodes x features x bins sums, and their totals are made by the driver. Rows stay packed in tasks, with predictions so far beside them.
    """
    y = F.col(target).cast("double")
    known = rows.where(y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf")))
    own = F.coalesce(F.col(fold).cast("int"), F.lit(-1)) if fold else F.lit(-1)
    forest = Forest(features, edges(known, features, settings.bins), folds, settings, np.full(folds + 1, np.nan))
    forest.base, reach, n = _starts(known.select(y.alias("y"), own.alias("f")), folds)
    if not reach > 0:
        return forest
    dealt = known.select(own.alias("_fold"), y.alias("_y"), *[F.col(k).cast("double") for k in features]).repartition(-(-n // TASK_ROWS))
    packed = cut(dealt.mapInArrow(_pack(forest), "fold binary, y binary, bins binary"))  # a row a batch
    state = _State(packed.rdd.map(_unpack(forest)).persist(StorageLevel.MEMORY_AND_DISK))
    for r in range(settings.rounds):
        forest.trees.append(_tree(state, forest, STEPS / reach))
        if r + 1 < settings.rounds:
            state = state.after(forest, (r + 1) % KEEP == 0)
    state.free()
    return forest


def _starts(rows: DataFrame, folds: int) -> tuple[np.ndarray, float, int]:
    """The mean target of each model's rows (NaN without rows), how far targets lie from one another at most, and how many rows there are."""
    sums = {r["f"]: r for r in rows.groupBy("f").agg(F.sum(F.col("y").cast("decimal(38,9)")).cast("double").alias("s"), F.count(F.lit(1)).alias("n"), F.min("y").alias("low"), F.max("y").alias("high")).collect()}
    if not sums:
        return np.full(folds + 1, np.nan), 0.0, 0
    mean = lambda out: sum(r["s"] for k, r in sorted(sums.items()) if k != out) / n if (n := sum(r["n"] for k, r in sums.items() if k != out)) else np.nan
    return np.array([*[mean(k) for k in range(folds)], mean(None)]), max(r["high"] for r in sums.values()) - min(r["low"] for r in sums.values()), sum(r["n"] for r in sums.values())


@dataclass
class _State:
    """Rows of one round in tasks, by blocks: folds, targets, bins and the predictions so far of every model."""

    rdd: RDD
    old: _State | None = None

    def after(self, forest: Forest, keep: bool) -> _State:
        """Rows with the last tree added. keep: they are also written, so that their lineage ends there."""
        splits, depth = forest.trees[-1], forest.settings.depth

        def run(block: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
            fold, y, bins, sofar = block
            new = [sofar[:, m] + splits[3][m][_descend(bins, *(s[m] for s in splits[:3]), depth)] for m in range(sofar.shape[1])]
            return fold, y, bins, np.stack(new, 1)

        if self.old:
            self.old.free()  # this round's rows are held by now
        out = _State(self.rdd.map(run).persist(StorageLevel.MEMORY_AND_DISK), self)
        if keep:
            out.rdd.checkpoint()
        return out

    def free(self) -> None:
        if self.old:
            self.old.free()
        self.rdd.unpersist()
        self.old = None


def _pack(forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                parts = [batch.column(0).to_numpy().astype(np.int32), batch.column(1).to_numpy(), forest.binned(batch)]
                yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], names=["fold", "y", "bins"])

    return run


def _unpack(forest: Forest):
    base, wide = forest.base, len(forest.features)

    def run(row: tuple) -> tuple[np.ndarray, ...]:
        fold, y, bins = (np.frombuffer(bytes(part), kind) for part, kind in zip(row, (np.int32, np.float64, np.uint8)))
        return fold, y, bins.reshape(len(y), wide), np.tile(base, (len(y), 1))

    return run


def _histograms(state: _State, forest: Forest, scale: float, splits: tuple, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of residuals and numbers of rows by model, node of this level, feature and bin."""
    models, wide, nodes, folds = forest.folds + 1, forest.settings.bins + 1, 1 << level, forest.folds
    shape = (models, len(forest.features), nodes, wide)

    def run(blocks: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
        total, count = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        first = np.arange(shape[1]) * nodes * wide
        for fold, y, bins, sofar in blocks:
            for m in range(models):
                mine = fold != m if m < folds else slice(None)
                own = bins[mine]
                node = _descend(own, *(s[m] for s in splits), level)
                left = np.rint((y[mine] - sofar[mine, m]) * scale)
                at = (own + (node * wide)[:, None] + first).ravel()
                total[m] += np.rint(np.bincount(at, np.repeat(left, shape[1]), total[m].size)).astype(np.int64).reshape(shape[1:])
                count[m] += np.bincount(at, minlength=count[m].size).reshape(shape[1:])
        at = np.flatnonzero(count)
        yield at, total.ravel()[at], count.ravel()[at]

    total, count = np.zeros(int(np.prod(shape)), np.int64), np.zeros(int(np.prod(shape)), np.int64)
    for at, g, n in state.rdd.mapPartitions(run).collect():
        total[at] += g
        count[at] += n
    return total.reshape(shape).swapaxes(1, 2), count.reshape(shape).swapaxes(1, 2)


def _tree(state: _State, forest: Forest, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One more tree a model: feature, greatest bin that goes left and side of blanks by node, and the values of the leaves."""
    s, models = forest.settings, forest.folds + 1
    inner = (models, (1 << s.depth) - 1)
    feature, most, blank_left = np.zeros(inner, np.int64), np.full(inner, s.bins + 1), np.ones(inner, bool)
    leaves = np.zeros((models, 1 << s.depth))
    for level in range(s.depth):
        total, count = _histograms(state, forest, scale, (feature, most, blank_left), level)
        for m in range(models):
            for node in range(1 << level):
                best, sides = _split(total[m, node], count[m, node], s)
                at = (1 << level) - 1 + node
                if best:
                    feature[m, at], most[m, at], blank_left[m, at] = best
                if level == s.depth - 1:
                    leaves[m, 2 * node : 2 * node + 2] = [s.rate * g / scale / (n + s.penalty) for g, n in sides]
    return feature, most, blank_left, leaves


def _split(total: np.ndarray, count: np.ndarray, s: Settings) -> tuple[tuple[int, int, bool] | None, list[tuple[float, float]]]:
    """The split of a node that lowers the error most (None if none does), and sum and number of both sides."""
    g, n = float(total[0].sum()), float(count[0].sum())
    below, under = np.cumsum(total[:, 1:], axis=1)[:, :-1].astype(float), np.cumsum(count[:, 1:], axis=1)[:, :-1].astype(float)
    sides = [np.stack([below, below + total[:, :1]], -1), np.stack([under, under + count[:, :1]], -1)]  # blanks right, blanks left
    rest, over = g - sides[0], n - sides[1]
    gain = sides[0] ** 2 / (sides[1] + s.penalty) + rest**2 / (over + s.penalty) - g**2 / (n + s.penalty)
    gain[(sides[1] < s.least) | (over < s.least)] = -1
    if not gain.size or gain.max() <= 0:
        return None, [(g, n), (0.0, 0.0)]
    f, edge, blank = np.unravel_index(int(gain.argmax()), gain.shape)
    return (int(f), int(edge) + 1, bool(blank)), [(sides[0][f, edge, blank], sides[1][f, edge, blank]), (rest[f, edge, blank], over[f, edge, blank])]
