"""Learned baselines of the pavement score, and the importance of roads, by boosted trees."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as x
from ..session import cut
from . import dealing, evaluation, trees


def boosted(frames: DataFrame, features: list[str], target: str = "icv", settings: trees.Settings = trees.Settings(rounds=400, rate=0.05)) -> DataFrame:
    """segment_id, split, icv: the mean over a segment's frames of the score that trees give, grown from the frames of the fusion split.

    Frames with a null target teach nothing and are scored; without any to learn from all scores are null. A segment's split is its least.
    """
    known = cut(frames.select("segment_id", "split", *dict.fromkeys([*features, target])))  # read for edges, starts, bins and scores
    forest = trees.fit(known.where(F.col("split") == "fusion"), features, target, settings=settings)
    said = forest.scored(known.select("segment_id", "split", *features))
    return said.groupBy("segment_id").agg(F.min("split").alias("split"), F.avg("fitted").alias("icv"))


def blocked(roads: DataFrame, k: int = 5, length: int = 5) -> DataFrame:
    """roads (lat, lon and more) with ``block`` (the geohash of each) and ``fold``: whole blocks, largest first, to the lightest fold. Both null without a place."""
    placed = roads.withColumn("block", F.when(evaluation.finite("lat", "lon"), x.geohash(F.col("lat"), F.col("lon"), length)))
    sizes = placed.where("block IS NOT NULL").groupBy(F.col("block").alias("key")).agg(F.count(F.lit(1)).alias("size"))
    return placed.join(dealing.lightest(sizes, k).select(F.col("key").alias("block"), "fold"), "block", "left")


def importance(roads: DataFrame, features: list[str], targets: list[str], k: int = 5, settings: trees.Settings = trees.Settings(rounds=300, rate=0.08)) -> DataFrame:
    """roads with block and fold and, for each target, ``<target>_predicted`` (by all roads) and ``<target>_held`` (by those of other folds).

    Roads with a null target, or without a place, are predicted too; those without a place teach every model and have no ``_held``.
    """
    out = known = cut(blocked(roads, k))  # read once a target and pass
    grow = lambda target: trees.fit(known, features, target, "fold", k, settings)
    with ThreadPoolExecutor(len(targets)) as side_by_side:  # rounds are many small jobs, and targets know nothing of each other
        forests = list(side_by_side.map(inheritable_thread_target(known.sparkSession)(grow), targets))
    for target, forest in zip(targets, forests):
        out = forest.scored(out, "fold").withColumnsRenamed({"fitted": f"{target}_predicted", "out_of_fold": f"{target}_held"})
    return out


def held_out_scores(predicted: DataFrame, targets: list[str]) -> DataFrame:
    """target, n, r2, spearman of the predictions made without a road's own blocks."""
    predicted = cut(predicted.select(*targets, *[f"{k}_held" for k in targets]))  # trees predict once, whatever reads it
    rows = [evaluation.regression(predicted.select(F.col(k).cast("double").alias("y"), F.col(f"{k}_held").alias("p"))).select(F.lit(k).alias("target"), "n", "r2", "spearman") for k in targets]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out
