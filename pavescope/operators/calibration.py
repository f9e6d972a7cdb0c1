"""Calibration of the field thresholds by one multiplier."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .. import config as c
from ..functions import exprs as x
from . import boxes as bx
from . import pavement

# Score ranges of the three official states.
RANGES = {"bueno": (90.0, 100.0), "regular": (56.0, 90.0), "malo": (0.0, 56.0)}


def official(score):
    return F.when(score >= RANGES["bueno"][0], "bueno").when(score >= RANGES["regular"][0], "regular").otherwise("malo")


def segment_curve(boxes: DataFrame, frames: DataFrame, truth: DataFrame, cuts: DataFrame, steps: Iterable[int], unit: float) -> DataFrame:
    """truth (segment_id, truth and more) with step, score, loss, hit and centre of each segment for each multiplier step * unit.

    A box survives thresholds times m while m is at most its own ratio of confidence to threshold and that of some
    partner in near frames: so each box has one limit, and the sweep needs no join of its own.
    """
    grid = list(steps)
    limits = bx.limits(boxes, frames)
    rho = pavement.weighted(limits, cuts)
    kept = rho.withColumn("step", F.explode(F.filter(F.array(*map(F.lit, grid)), lambda s: s * unit <= F.col("limit") + 1e-9)))
    sums = kept.groupBy("segment_id", "step").pivot("cls", list(c.CLASSES)).agg(F.sum("rho"))
    spine = frames.groupBy("segment_id").agg(F.count(F.lit(1)).alias("frames")).withColumn("step", F.explode(F.array(*map(F.lit, grid))))
    dens = spine.join(sums, ["segment_id", "step"], "left").select("segment_id", "step", *[(F.coalesce(k, F.lit(0.0)) / F.col("frames")).alias(f"rho_{k}") for k in c.CLASSES])
    score = F.col("pci_vis")
    s = pavement.scored(dens).join(truth, "segment_id")
    low, high = (x.by_class({k: F.lit(v[i]) for k, v in RANGES.items()}, F.col("truth")) for i in (0, 1))
    over = F.when(F.col("truth") == "bueno", 0.0).otherwise(F.greatest(score - high, F.lit(0.0)))
    loss, hit = F.greatest(low - score, F.lit(0.0)) + over, (official(score) == F.col("truth")).cast("double")
    return s.select(*truth.columns, "step", score.alias("score"), loss.alias("loss"), hit.alias("hit"), ((low + high) / 2).alias("centre"))


def _chosen(means: DataFrame, keys: list[str]) -> DataFrame:
    """means (step, loss, off and keys) with ``best``: of steps with the least loss that with the least off, then the least. A row a key and step."""
    every = Window.partitionBy(*keys)
    tied = means.withColumn("_tied", F.col("loss") <= F.min("loss").over(every) + 1e-9)
    best = F.min(F.when(F.col("_tied"), F.struct("off", "step"))).over(every)
    return tied.withColumn("best", best["step"]).drop("_tied")


def curve(boxes: DataFrame, frames: DataFrame, truth: DataFrame, cuts: DataFrame, steps: Iterable[int], unit: float) -> DataFrame:
    """step, m, loss, accuracy and chosen for each multiplier m = step * unit.

    Of multipliers with the least loss the one whose mean score is nearest to the ranges' mean centre is chosen (to nine
    decimals), then the least.
    """
    return chosen(segment_curve(boxes, frames, truth, cuts, steps, unit), unit)


def chosen(segments: DataFrame, unit: float) -> DataFrame:
    """The same from what segment_curve() gives."""
    out = segments.groupBy("step").agg(F.avg("loss").alias("loss"), F.avg("hit").alias("accuracy"), F.round(F.abs(F.avg("score") - F.avg("centre")), 9).alias("off"))
    return _chosen(out, []).select("step", F.round(F.col("step") * unit, 6).alias("m"), "loss", "accuracy", (F.col("step") == F.col("best")).alias("chosen"))


def left_out(segments: DataFrame, capture: str, unit: float, plain: int) -> DataFrame:
    """A row a capture: the multiplier that all other captures choose, and what it gives on this one, beside step ``plain`` (m = 1).

    segments: as of segment_curve(), with a column capture. Sums of the others are those of all less the capture's own, so
    a sweep is read once whatever the number of captures. A null capture is one of its own; one capture alone gives no rows.
    Columns capture, m, n, accuracy, loss, accuracy_plain, loss_plain.
    """
    parts = ["loss", "hit", "score", "centre"]
    own = segments.groupBy(capture, "step").agg(F.count(F.lit(1)).alias("n"), *[F.sum(k).alias(k) for k in parts])
    every = Window.partitionBy("step")  # a row a capture
    rest = lambda k: F.sum(k).over(every) - F.col(k)
    others = own.select("*", rest("n").alias("_n"), *[rest(k).alias(f"_{k}") for k in parts]).where("_n > 0")
    means = others.withColumnRenamed("loss", "_own").withColumn("loss", F.col("_loss") / F.col("_n")).withColumn("off", F.round(F.abs(F.col("_score") - F.col("_centre")) / F.col("_n"), 9))
    picked = _chosen(means, [capture])
    at = lambda step, v: F.max(F.when(F.col("step") == step, F.col(v) / F.col("n")))
    return picked.groupBy(capture, "best").agg(
        F.max("n").alias("n"), at(F.col("best"), "hit").alias("accuracy"), at(F.col("best"), "_own").alias("loss"), at(F.lit(plain), "hit").alias("accuracy_plain"), at(F.lit(plain), "_own").alias("loss_plain"),
    ).select(capture, F.round(F.col("best") * unit, 6).alias("m"), "n", "accuracy", "loss", "accuracy_plain", "loss_plain")
