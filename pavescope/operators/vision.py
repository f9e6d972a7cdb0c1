"""Features of an image from its detections: one conditional aggregate, and covered areas from bit masks of a raster."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as c
from ..functions import exprs as x
from . import pavement

GRID = 64


def _spans(boxes: DataFrame) -> DataFrame:
    """The raster rows _y0 to _y1 - 1 that a box meets, and its columns as the bits of a long; boxes that meet none have no mask."""
    low = lambda m, n: F.greatest(F.lit(0), ((F.col(m) - F.col(n) / 2) * GRID).cast("int"))
    high = lambda m, n: F.least(F.lit(GRID), F.ceil((F.col(m) + F.col(n) / 2) * GRID).cast("int"))
    spans = boxes.withColumn("_x0", low("cx", "w")).withColumn("_x1", high("cx", "w")).withColumn("_y0", low("cy", "h")).withColumn("_y1", high("cy", "h"))
    # (-1 >>> (64 - width)) << x0
    mask = F.expr(f"CASE WHEN _x1 > _x0 AND _y1 > _y0 THEN shiftleft(shiftrightunsigned(-1L, {GRID} - (_x1 - _x0)), _x0) END")
    return spans.withColumn("mask", mask).drop("_x0", "_x1")


def covered(boxes: DataFrame) -> DataFrame:
    """image_id, cls and the share of the raster that the boxes of a class cover."""
    spans = _spans(boxes.select("image_id", "cls", "cx", "cy", "w", "h")).where("mask IS NOT NULL").select("image_id", "cls", "mask", "_y0", "_y1")
    # boxes are dealt once and stay boxes; those of the same raster rows are one, so a class has GRID * (GRID + 1) / 2 at most
    merged = spans.repartition("image_id", "cls").groupBy("image_id", "cls", "_y0", "_y1").agg(F.bit_or("mask").alias("mask"))
    held = merged.groupBy("image_id", "cls").agg(F.collect_list(F.struct("mask", "_y0", "_y1")).alias("_s"))
    return held.select("image_id", "cls", _union(F.col("_s")).alias("area"))


def _union(spans: Column) -> Column:
    """Share of the raster that spans (an array of mask, _y0, _y1) cover; 0 without any."""

    def cells(lists: pa.Array) -> pa.Array:
        many, flat = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), lists.flatten()
        mask, low, high = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
        owner, out = np.repeat(np.arange(len(lists)), many), np.zeros(len(lists))
        for y in range(GRID):
            at = np.flatnonzero((low <= y) & (y < high))
            if len(at):
                own = owner[at]
                first = np.flatnonzero(np.diff(own, prepend=-1))
                out[own[first]] += np.bitwise_count(np.bitwise_or.reduceat(mask[at].view(np.uint64), first))
        return pa.array(out / (GRID * GRID))

    return F.arrow_udf(cells, "double")(spans)


def covered_together(boxes: DataFrame) -> DataFrame:
    """image_id and the share of the raster that its boxes cover, all classes together."""
    spans = _spans(boxes.select("image_id", "cx", "cy", "w", "h")).where("mask IS NOT NULL")
    return spans.groupBy("image_id").agg(F.collect_list(F.struct("mask", "_y0", "_y1")).alias("_s")).select("image_id", _union(F.col("_s")).alias("area"))


def frame_features(boxes: DataFrame, frames: DataFrame, cuts: DataFrame, tau: dict[str, float]) -> DataFrame:
    """Fifty features of every frame; zeros where it has no boxes. Hard boxes reach their class's tau, soft ones 0.05.

    Boxes of other classes, and null confidences, count for max_conf alone. Repeated boxes count each.
    """
    b = _spans(pavement.weighted(boxes, cuts)).withColumn("tau", x.by_class({k: F.lit(v) for k, v in tau.items()}, F.col("cls")))
    col, area = F.col, F.col("w") * F.col("h")
    hard, soft = col("conf") >= col("tau"), col("conf") >= c.SOFT
    some = lambda cond, e: F.sum(F.when(cond, e))
    # dealt once by image: then by class, and the classes side by side
    by = b.where(F.col("image_id").isNotNull()).repartition("image_id").groupBy("image_id", "cls").agg(
        F.count_if(hard).alias("n"), F.sum("conf").alias("soft"), F.max("conf").alias("maxconf"), F.count_if(soft & (col("conf") < col("tau"))).alias("nsub"), some(hard, area).alias("area"),
        F.max(F.when(hard, area)).alias("area_max"), some(hard, col("cy")).alias("cy"), some(hard, col("rho")).alias("hard"), some(soft, col("rho") * col("conf")).alias("softrho"),
        some(hard & (F.abs(col("cx") - 0.5) <= 0.3), area).alias("wheel"),
        # the boxes of an image, of which a detector gives some hundreds at most
        F.collect_list(F.when(hard & F.col("mask").isNotNull(), F.struct("mask", "_y0", "_y1"))).alias("spans"),
    )
    wide: list[Column] = [F.sum("wheel").alias("_wheel"), F.sum("area").alias("_area"), F.max("maxconf").alias("max_conf")]
    parts = ("n", "soft", "maxconf", "nsub", "area", "area_max", "cy", "hard", "softrho", "spans")
    wide += [F.first(F.when(col("cls") == k, F.struct(*parts)), ignorenulls=True).alias(k) for k in c.CLASSES]
    every = frames.select("image_id").where(F.col("image_id").isNotNull()).distinct()
    out = every.join(by.groupBy("image_id").agg(*wide), "image_id", "left")
    of = lambda k, p: F.coalesce(col(f"{k}.{p}"), F.lit(0.0))
    shown = [col("image_id"), F.coalesce(F.try_divide("_wheel", "_area"), F.lit(0.0)).alias("rodada_share"), F.coalesce("max_conf", F.lit(0.0)).alias("max_conf"), _union(F.flatten(F.array_compact(F.array(*[col(f"{k}.spans") for k in c.CLASSES])))).alias("union_total")]
    for k in c.CLASSES:
        mean = lambda p: F.coalesce(F.try_divide(col(f"{k}.{p}"), col(f"{k}.n")), F.lit(0.0))  # noqa: B023, E731
        shown += [F.coalesce(col(f"{k}.{p}"), F.lit(0)).alias(f"{p}_{k}") for p in ("n", "nsub")] + [of(k, p).alias(f"{p}_{k}") for p in ("soft", "maxconf", "area_max")] + [_union(col(f"{k}.spans")).alias(f"union_{k}")]
        shown += [mean("area").alias(f"area_mean_{k}"), mean("cy").alias(f"cy_mean_{k}"), of(k, "hard").alias(f"rho_det_{k}"), of(k, "softrho").alias(f"rho_soft_{k}")]
        shown += [x.deduct(k, of(k, "hard")).alias(f"dv_det_{k}"), x.deduct(k, of(k, "softrho")).alias(f"_dv_soft_{k}")]
    out = out.select(*shown).fillna(0)
    all_n = reduce(lambda p, q: p + q, [col(f"n_{k}") for k in c.CLASSES])
    share = lambda k: col(f"n_{k}") / F.greatest(all_n, F.lit(1))
    entropy = -reduce(lambda p, q: p + q, [F.when(col(f"n_{k}") > 0, share(k) * F.ln(share(k))).otherwise(0.0) for k in c.CLASSES])
    index = lambda p: 100 - x.combined_deduct([col(f"{p}_{k}") for k in c.CLASSES])
    return out.withColumns({"entropia_clases": entropy, "pci_det": index("dv_det"), "pci_soft": index("_dv_soft")}).select("image_id", *FEATURES)


FEATURES = [f"{p}_{k}" for k in c.CLASSES for p in ("n", "soft", "maxconf", "nsub", "area_mean", "area_max", "cy_mean", "union")] + ["union_total", "rodada_share", "entropia_clases", "max_conf"] + [f"{p}_{k}" for k in c.CLASSES for p in ("rho_det", "dv_det")] + ["pci_det"] + [f"rho_soft_{k}" for k in c.CLASSES] + ["pci_soft"]
