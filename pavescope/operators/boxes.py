"""Box filters and matching: each is an equi-join on the image or run with a narrow condition."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.window import WindowSpec

from .. import config as c
from ..functions import exprs as x

#: Frames of a run that one task looks through for lasting boxes.
STRETCH = 256
KEY = ("image_id", "cls", "l_partkey", "l_suppkey", "l_linenumber", "conf", "cx", "cy", "w", "h")


def _surface_bars(surface: Column) -> Column:
    """Whether a class has no place on a surface; unknown and missing surfaces take all."""
    bars = [(surface == s) & ~F.col("cls").isin(*classes) for s, classes in c.SURFACES.items() if set(classes) != set(c.CLASSES)]
    return F.coalesce(reduce(lambda a, b: a | b, bars), F.lit(False))


def _stretches() -> tuple[Column, Column]:
    """The stretch of a frame, and those that its boxes are looked at in."""
    own = F.floor(F.col("chain_pos") / STRETCH)
    return own, F.array_distinct(F.array(own, F.floor((F.col("chain_pos") - c.NEIGHBOURS) / STRETCH), F.floor((F.col("chain_pos") + c.NEIGHBOURS) / STRETCH)))


def _near() -> WindowSpec:
    return Window.partitionBy("segment_id", "cls", "stretch").orderBy("chain_pos").rangeBetween(-c.NEIGHBOURS, c.NEIGHBOURS)


def _alike(b: Column) -> Column:
    """Whether a box of a near frame is the row's own (a) again."""
    return (b["chain_pos"] != F.col("chain_pos")) & (F.greatest(*[x.iou(F.col("a"), b, s) for s in (0.0, c.SHIFT, -c.SHIFT)]) >= c.PERSIST_IOU)


def _again(lists: pa.Array, place: pa.Array, own: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Of lists of boxes: those that are the row's own again, as _alike() says, and the rows that they lie in, in order. For boxes without null or NaN."""
    many, flat = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), lists.flatten()
    owner = np.repeat(np.arange(len(lists)), many)
    other = flat.field("chain_pos").to_numpy(zero_copy_only=False) != place.to_numpy(zero_copy_only=False)[owner]
    owner, flat = owner[other], flat.filter(pa.array(other))
    of = lambda boxes: [boxes.field(k).cast(pa.float64()).to_numpy(zero_copy_only=False) for k in ("cx", "cy", "w", "h")]
    (ax, ay, aw, ah), (bx, by, bw, bh) = ([k[owner] for k in of(own)]), of(flat)
    span = lambda a, an, b, bn: np.maximum(0.0, np.minimum(a + an / 2, b + bn / 2) - np.maximum(a - an / 2, b - bn / 2))
    across, alike = span(ax, aw, bx, bw), np.zeros(len(owner), bool)
    for shift in (0.0, c.SHIFT, -c.SHIFT):
        both = across * span(ay, ah, by + shift, bh)
        alike |= both / (aw * ah + bw * bh - both + 1e-9) >= c.PERSIST_IOU
    return owner[alike], flat.filter(pa.array(alike))


def _once(f, kind: str):
    """An Arrow function that is not run again for each condition and column that reads its result."""
    return F.arrow_udf(f, kind).asNondeterministic()


def _lasting(near: Column) -> Column:
    """Whether any of near (structs of chain_pos, cx, cy, w, h) is the row's own box again, as _alike() says: for boxes without null or NaN, in batches."""

    def any_alike(lists: pa.Array, place: pa.Array, own: pa.Array) -> pa.Array:
        out = np.zeros(len(lists), bool)
        out[_again(lists, place, own)[0]] = True
        return pa.array(out)

    return _once(any_alike, "boolean")(near, F.col("chain_pos"), F.col("a"))


def _partner(near: Column) -> Column:
    """The greatest ratio of near boxes that are the row's own again, null where none is: as _lasting(), for ratios without null or NaN too."""

    def greatest(lists: pa.Array, place: pa.Array, own: pa.Array) -> pa.Array:
        owner, alike = _again(lists, place, own)
        out = np.full(len(lists), np.nan)
        if len(owner):
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            out[owner[first]] = np.maximum.reduceat(alike.field("ratio").cast(pa.float64()).to_numpy(zero_copy_only=False), first)
        return pa.array(out, from_pandas=True)

    return _once(greatest, "double")(near, F.col("chain_pos"), F.col("a"))


def filtered(boxes: DataFrame, frames: DataFrame, surface: Column | None = None) -> DataFrame:
    """Boxes with the first reason to discard them, or none: confidence, band, road, surface, persistence among near frames."""
    col = F.col
    reason = (
        F.when(col("conf") < x.by_class(c.TAU_FIELD, col("cls")), "1_confianza").when(x.wide_band(col("cls"), col("w"), col("h")), "2_banda")
        .when(~x.in_road(col("cx"), col("cy")), "2_fuera_de_via")
    )
    if surface is not None:
        reason = reason.when(_surface_bars(surface), "2_superficie")
    # boxes of images that are no frames have no neighbours to last in, and stay
    early = boxes.select(*KEY).withColumn("early", reason).join(frames.select("image_id", "segment_id", "chain_pos"), "image_id", "left")
    # a run is dealt to stretches, with the boxes of the frames just before and after each: no run is in one task
    own, reach = _stretches()
    alive = early.where(col("early").isNull() & col("segment_id").isNotNull()).withColumn("own", own).withColumn("stretch", F.explode(reach))
    alive = alive.withColumn("a", F.struct("cx", "cy", "w", "h")).withColumn("near", F.collect_list(F.struct("chain_pos", "cx", "cy", "w", "h")).over(_near()))
    odd = reduce(lambda a, b: a | b, [col(k).isNull() | F.isnan(k) for k in ("cx", "cy", "w", "h")])
    alive = alive.withColumn("odd", F.bool_or(odd).over(_near())).where("own = stretch")
    lasts = F.when(col("odd"), F.exists("near", _alike)).otherwise(_lasting(col("near")))
    judged = alive.select(*KEY, F.when(lasts, "").otherwise("3_sin_persistencia").alias("reason"))
    return early.where(col("early").isNotNull() | col("segment_id").isNull()).select(*KEY, F.coalesce("early", F.lit("")).alias("reason")).unionByName(judged)


def matched(detections: DataFrame, truth: DataFrame, least: float = 0.5) -> DataFrame:
    """Detections with whether they are true: each bids for its best truth box, the most confident bid wins it."""
    d = detections.select(*KEY).distinct().withColumn("d", F.struct(*KEY)).withColumn("a", F.struct("cx", "cy", "w", "h"))
    t = truth.select(*KEY).distinct().select("image_id", "cls", F.struct("cx", "cy", "w", "h").alias("b"), F.struct("l_partkey", "l_suppkey", "l_linenumber").alias("g")).distinct()
    pairs = d.join(t, ["image_id", "cls"]).withColumn("iou", x.iou("a", "b"))
    bids = pairs.groupBy("image_id", "cls", "d").agg(F.max_by(F.struct("g", "b"), F.struct("iou", "g", "b")).alias("t"), F.max("iou").alias("iou"))
    won = Window.partitionBy("image_id", "cls", "t").orderBy(F.desc("d.conf"), "d")
    good = bids.where(F.col("iou") >= least).withColumn("r", F.row_number().over(won)).where("r = 1").select("d").withColumn("tp", F.lit(1))
    return d.join(good, "d", "left").select(*KEY, F.coalesce("tp", F.lit(0)).alias("tp"))


def presence_thresholds(frame_max: DataFrame, grid: list[int]) -> DataFrame:
    """The least threshold (hundredths) of the greatest presence F1 in each class, from a histogram of frame maxima.

    frame_max: cls, top (greatest confidence), truth (0 or 1). The histogram has a row a class and grid step.
    """
    step = F.floor(F.col("top") * 100 + 1e-9).cast("int")
    hist = frame_max.select("cls", F.least(F.greatest(step, F.lit(grid[0] - 1)), F.lit(grid[-1])).alias("step"), "truth").groupBy("cls", "step").agg(F.sum("truth").alias("pos"), F.count(F.lit(1)).alias("n"))
    every = hist.select("cls").distinct().select("cls", F.explode(F.sequence(F.lit(grid[0] - 1), F.lit(grid[-1]))).alias("step"))
    over = Window.partitionBy("cls").orderBy(F.desc("step"))
    total = Window.partitionBy("cls")
    full = every.join(hist, ["cls", "step"], "left").fillna(0, ["pos", "n"])
    full = full.withColumn("tp", F.sum("pos").over(over)).withColumn("hits", F.sum("n").over(over)).withColumn("all", F.sum("pos").over(total))
    f1 = F.try_divide(2 * F.col("tp"), F.col("hits") + F.col("all"))
    ranked = full.where(F.col("step") >= grid[0]).withColumn("f1", F.coalesce(f1, F.lit(0.0))).withColumn("r", F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("f1"), "step")))
    return ranked.where("r = 1").select("cls", F.col("step").alias("tau_hundredths"), "f1")


def consensus(judged: DataFrame, scales: list[DataFrame], least: int = 1, share: float = 0.6, iou: float = 0.5) -> DataFrame:
    """Judged boxes (with reason) that stay only if seen at ``least`` of the other scales, there with a share of the confidence."""
    seen = reduce(DataFrame.unionByName, [s.where(F.col("conf") >= share * x.by_class(c.TAU_FIELD, F.col("cls"))).select("image_id", "cls", F.struct("cx", "cy", "w", "h").alias("b"), F.lit(i).alias("scale")) for i, s in enumerate(scales)])
    # judged rows go through one join, with the other scales' boxes of an image and class side by side
    beside = seen.groupBy("image_id", "cls").agg(F.collect_list(F.struct("b", "scale")).alias("_seen"))
    alike = F.filter("_seen", lambda s: x.iou(F.struct("cx", "cy", "w", "h"), s["b"]) >= iou)
    hits = F.size(F.array_distinct(F.transform(alike, lambda s: s["scale"])))
    missed = (F.col("reason") == "") & (F.col("_seen").isNull() | (hits < max(least, 1)))
    out = judged.join(beside, ["image_id", "cls"], "left")
    return out.select(*KEY, F.when(missed, "4_sin_consenso_escala").otherwise(F.col("reason")).alias("reason"))


def limits(boxes: DataFrame, frames: DataFrame) -> DataFrame:
    """Boxes inside the road with the greatest multiplier of the thresholds at which they stay; those without a partner go."""
    col = F.col
    # dealt by image for the repeats and the frames, then by stretches as in filtered()
    inside = boxes.select(*KEY).where(~x.wide_band(col("cls"), col("w"), col("h")) & x.in_road(col("cx"), col("cy"))).repartition("image_id").distinct().join(frames, "image_id")
    inside = inside.where(col("segment_id").isNotNull() & col("cls").isNotNull()).withColumn("ratio", col("conf") / x.by_class(c.TAU_FIELD, col("cls")))
    own, reach = _stretches()
    inside = inside.withColumn("own", own).withColumn("stretch", F.explode(reach)).withColumn("a", F.struct("cx", "cy", "w", "h"))
    beside = F.collect_list(F.struct("chain_pos", "cx", "cy", "w", "h", "ratio")).over(_near())
    odd = reduce(lambda a, b: a | b, [col(k).isNull() | F.isnan(k) for k in ("cx", "cy", "w", "h", "ratio")])
    inside = inside.withColumn("near", beside).withColumn("odd", F.bool_or(odd).over(_near())).where("own = stretch")
    # near boxes go through batches; with an odd one among them through _alike(), where a partner may be there and have no ratio
    alike = F.when(col("odd"), F.filter("near", _alike))
    inside = inside.withColumn("found", F.when(~col("odd"), _partner(col("near")))).withColumn("alike", alike).where(F.when(col("odd"), F.size("alike") > 0).otherwise(col("found").isNotNull()))
    partner = F.when(col("odd"), F.array_max(F.transform("alike", lambda b: b["ratio"]))).otherwise(col("found"))
    return inside.withColumn("partner", partner).withColumn("limit", F.least("ratio", "partner")).drop("a", "own", "stretch", "near", "odd", "found", "alike")


def precision_grid(judged: DataFrame, grid: list[int], least: float) -> DataFrame:
    """Precision of each class at each threshold (hundredths), from a histogram; the least one that reaches ``least`` is chosen."""
    last = F.size(F.filter(F.array(*map(F.lit, grid)), lambda g: g <= F.col("conf") * 100 + 1e-9))
    hist = judged.groupBy("cls", last.alias("reach")).agg(F.count(F.lit(1)).alias("n"), F.sum("tp").alias("tp"))
    spine = hist.select("cls").distinct().select("cls", F.explode(F.sequence(F.lit(1), F.lit(len(grid)))).alias("reach"))
    down = Window.partitionBy("cls").orderBy(F.desc("reach"))
    out = spine.join(hist, ["cls", "reach"], "left").fillna(0, ["n", "tp"]).select("cls", F.element_at(F.array(*map(F.lit, grid)), F.col("reach")).alias("tau"), F.sum("n").over(down).alias("n"), F.sum("tp").over(down).alias("tp"))
    out = out.withColumn("precision", F.col("tp") / F.greatest("n", F.lit(1)))
    first = F.min(F.when((F.col("n") > 0) & (F.col("precision") >= least), F.col("tau"))).over(Window.partitionBy("cls"))
    return out.withColumn("chosen", F.coalesce(F.col("tau") == first, F.lit(False)))
