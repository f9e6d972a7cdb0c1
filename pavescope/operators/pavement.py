"""Pavement index: boxes to densities, deducts, scores and states."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as c
from ..functions import exprs as x
from . import sampling


def sized(boxes: DataFrame) -> DataFrame:
    col = F.col
    return boxes.withColumn("density", x.box_density(col("cls"), col("w"), col("h"))).withColumn("size", x.size_proxy(col("cls"), col("cy"), col("w"), col("h")))


def cutoffs(boxes: DataFrame) -> DataFrame:
    """Median and 85th percentile of apparent size of each class: at most one row a class."""
    return sampling.quantiles(sized(boxes), "size", {"low": 0.5, "high": 0.85}, ["cls"])


def with_defaults(cuts: DataFrame) -> DataFrame:
    """cuts with a row for every class: 1 and 2 where the class has no boxes."""
    every = cuts.sparkSession.createDataFrame([(k,) for k in c.CLASSES], "cls string")
    return every.join(F.broadcast(cuts), "cls", "left").select("cls", F.coalesce("low", F.lit(1.0)).alias("low"), F.coalesce("high", F.lit(2.0)).alias("high"))


def weighted(boxes: DataFrame, cuts: DataFrame) -> DataFrame:
    # cuts has a row for each class, so four at most
    joined = sized(boxes).join(F.broadcast(cuts), "cls", "left")
    return joined.withColumn("rho", x.kappa(F.col("size"), F.col("low"), F.col("high")) * F.col("density"))


def frame_density(boxes: DataFrame, cuts: DataFrame, frames: DataFrame) -> DataFrame:
    """Weighted density of each class in each frame, zero where it has no boxes."""
    sums = weighted(boxes, cuts).groupBy("image_id").pivot("cls", list(c.CLASSES)).agg(F.sum("rho"))
    sums = sums.select("image_id", *[F.col(k).alias(f"rho_{k}") for k in c.CLASSES])
    return frames.join(sums, "image_id", "left").fillna(0.0, [f"rho_{k}" for k in c.CLASSES])


def scored(densities: DataFrame) -> DataFrame:
    """Deducts, the combined one, score and state of rows with rho_ columns."""
    out = densities
    for k in c.CLASSES:
        out = out.withColumn(f"dv_{k}", x.deduct(k, F.col(f"rho_{k}")))
    out = out.withColumn("pci_vis", 100 - x.combined_deduct([F.col(f"dv_{k}") for k in c.CLASSES]))
    top = F.array(*[F.col(f"dv_{k}") for k in c.CLASSES])
    dominant = F.when(F.array_max(top) > 0, F.element_at(F.array(*map(F.lit, c.CLASSES)), F.array_position(top, F.array_max(top)).cast("int")))
    return out.withColumn("state", x.state(F.col("pci_vis"))).withColumn("dominant", dominant)


def segment_scores(densities: DataFrame) -> DataFrame:
    """Densities averaged over a segment's frames and only then scored: the score of a mean is no mean of scores."""
    means = densities.groupBy("segment_id").agg(*[F.avg(f"rho_{k}").alias(f"rho_{k}") for k in c.CLASSES], F.count(F.lit(1)).alias("n_frames"))
    return scored(means)


def rule_scores(boxes: DataFrame, roughness: DataFrame | None = None) -> DataFrame:
    """First rule score of segments: 100 less weighted severities (count times 1 + 10 mean area) and 25 times roughness (0 to 1)."""
    own = lambda k: F.col("cls") == k
    severity = lambda k: F.count_if(own(k)) * (1 + 10 * F.coalesce(F.avg(F.when(own(k), F.col("w") * F.col("h"))), F.lit(0.0)))
    out = boxes.groupBy("segment_id").agg(reduce(lambda a, b: a + b, [w * severity(k) for k, w in c.RULE_WEIGHTS.items()]).alias("penalty"))
    if roughness is not None:
        out = out.join(roughness, "segment_id", "left").withColumn("penalty", F.col("penalty") + 25.0 * F.coalesce("roughness", F.lit(0.0)))
    out = out.withColumn("score", F.round(F.least(F.greatest(100 - F.col("penalty"), F.lit(0.0)), F.lit(100.0)), 1))
    return out.withColumn("category", F.when(F.col("score") >= 75, "bueno").when(F.col("score") >= 50, "regular").otherwise("malo"))
