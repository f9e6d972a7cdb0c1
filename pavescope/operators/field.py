"""From field captures to labels: frames in stretches, depth beside them, damage by frame, and rows by stretch and site.

Frames: image_id, segment_id (the run), chain_pos. Boxes as in operators.boxes. Depth readings: user_id, us, depth, t_norm.
Nulls: a frame without boxes has zeros, without depth readings null depths. Repeated boxes count each. Empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .. import config as c
from ..functions import exprs as x
from ..session import cut
from . import boxes as bx
from . import pavement, tracks, vision

PRESENT_SHARE, DEEP_CM = 0.2, 3.0


def severity(depth: Column) -> Column:
    """L, M or H of a depth in centimetres; null for none and for negative ones."""
    return F.when(depth.isNull() | (depth < 0), None).when(depth < 2.5, "L").when(depth < 5, "M").otherwise("H")


def label(state: Column, depth: Column, conf: Column) -> Column:
    deep = F.coalesce(depth, F.lit(float("-inf")))
    return F.when(state.isin("malo", "muy_malo") | (deep >= 8) | (conf >= 0.5), "intervencion").when((state == "regular") | (deep >= 3), "mantenimiento").otherwise("prevencion")


def city_state(score: Column) -> Column:
    return F.when(score >= 90, "bueno").when(score >= 56, "regular").otherwise("malo")


def uncertainty(satellites: Column, least: int = 12, metres: float = 5.0) -> Column:
    """GPS uncertainty, doubled where there are too few satellites (or none known)."""
    return F.when(satellites >= least, metres).otherwise(2 * metres)


def timed(frames: DataFrame) -> DataFrame:
    """frames with t_norm: the place in the run over its last place, from 0 to 1."""
    return frames.withColumn("t_norm", F.col("chain_pos") / F.greatest(F.max("chain_pos").over(Window.partitionBy("segment_id")), F.lit(1)))


def shared_names(names: DataFrame) -> DataFrame:
    """Photos without positions (run, name): the time sent and the suffix of names like ``X 2026-01-31 at 3.04.05 PM (2).jpeg`` order
    each run; ``us`` is that time plus a millisecond a place, t_norm deals them evenly. Other names go.
    """
    part = lambda i: F.regexp_extract("name", r"(\d{4}-\d{2}-\d{2}) at (\d{1,2})\.(\d{2})\.(\d{2})\s*([AaPp][Mm])(?: \((\d+)\))?", i)
    hour = part(2).cast("int") % 12 + F.when(F.upper(part(5)) == "PM", 12).otherwise(0)
    known = names.where(part(1) != "").select("run", "name", F.to_timestamp(part(1), "yyyy-MM-dd").alias("day"), (hour * 3600 + part(3).cast("int") * 60 + part(4).cast("int")).alias("sec"), F.when(part(6) == "", 0).otherwise(F.expr("try_cast(nullif(regexp_extract(name, '[(]([0-9]+)[)]', 1), '') as int)")).alias("suffix"))
    run = Window.partitionBy("run")
    placed = known.withColumn("place", F.row_number().over(run.orderBy("sec", "suffix", "name")) - 1)
    us = F.unix_micros(F.first("day").over(run.orderBy("sec", "suffix", "name"))) + F.col("sec").cast("long") * 1_000_000 + F.col("place") * 1_000
    return placed.withColumn("us", us).withColumn("t_norm", F.col("place") / F.greatest(F.count(F.lit(1)).over(run) - 1, F.lit(1))).select("run", "name", "place", "us", "t_norm")


def frame_depth(frames: DataFrame, readings: DataFrame) -> DataFrame:
    """image_id and the deepest reading near each frame's time in its run's series (user_id of frames)."""
    asked = timed(frames).select("user_id", F.col("image_id").alias("query"), F.col("t_norm").alias("q"))
    return tracks.near_in_time(asked, readings).select(F.col("query").alias("image_id"), "depth")


def weights(kept: DataFrame, cuts: DataFrame, depth: DataFrame) -> DataFrame:
    """kept boxes with their weighted density; the severity of a measured depth stands in for that of size on potholes."""
    measured = x.by_class({"L": F.lit(c.KAPPA_LOW), "M": F.lit(c.KAPPA_MID), "H": F.lit(c.KAPPA_HIGH)}, severity(F.col("depth")))
    out = pavement.weighted(kept, pavement.with_defaults(cuts)).join(depth, "image_id", "left")
    return out.withColumn("rho", F.when((F.col("cls") == "D40") & severity(F.col("depth")).isNotNull(), measured * F.col("density")).otherwise(F.col("rho")))


def frame_table(boxes: DataFrame, frames: DataFrame, cuts: DataFrame, depth: DataFrame) -> DataFrame:
    """Per frame: all boxes over their thresholds (n_tau, conf_tau, n25_*) beside the kept ones (n_*, conf_*, rho_*, pci, area, max_conf)."""
    judged, depth = bx.filtered(boxes, frames), cut(depth)  # depth is read for boxes and for frames
    own = lambda k: F.col("cls") == k
    over = F.col("conf") >= x.by_class(c.TAU_FIELD, F.col("cls"))
    before = boxes.groupBy("image_id").agg(F.count_if(over).alias("n_tau"), F.avg(F.when(over, F.col("conf"))).alias("conf_tau"), *[F.count_if(own(k) & (F.col("conf") >= 0.25)).alias(f"n25_{k}") for k in c.CLASSES])
    kept = cut(judged.where("reason = ''"))  # read for sums and for areas
    sums = weights(kept, cuts, depth).groupBy("image_id").agg(
        *[F.count_if(own(k)).alias(f"n_{k}") for k in c.CLASSES], *[F.max(F.when(own(k), F.col("conf"))).alias(f"conf_{k}") for k in c.CLASSES],
        *[F.sum(F.when(own(k), F.col("rho"))).alias(f"rho_{k}") for k in c.CLASSES], F.max("conf").alias("max_conf"),
    )
    area = vision.covered_together(kept)
    zero = [f"{p}_{k}" for p in ("n25", "n", "conf", "rho") for k in c.CLASSES] + ["n_tau", "max_conf", "area"]
    out = frames.join(before, "image_id", "left").join(sums, "image_id", "left").join(area, "image_id", "left").fillna(0, zero).join(depth, "image_id", "left")
    return pavement.scored(out).withColumn("severity", severity(F.col("depth")))


def series_features(readings: DataFrame) -> DataFrame:
    """Per series: all its valid readings in a few sums, to be added over the series of a group."""
    d = F.col("depth")
    return readings.groupBy("user_id").agg(F.max(d).alias("s_max"), F.sum(d).alias("s_sum"), F.count(d).alias("s_n"), F.count_if(d >= DEEP_CM).alias("s_deep"), F.count(F.lit(1)).alias("s_all"))


def levels(table: DataFrame, size: int = 5) -> DataFrame:
    """Each frame once in its stretch (of ``size`` places) and once in its site, or in its run where a frame of the run declares none."""
    table = table.withColumn("_declared", F.min(F.col("site").isNotNull()).over(Window.partitionBy("segment_id")))
    stretch = F.concat_ws("-", F.col("segment_id").cast("string"), F.floor(F.col("chain_pos") / size).cast("string"))
    other = F.when(F.col("_declared"), F.struct(F.lit("sitio").alias("level"), F.col("site").cast("string").alias("id"))).otherwise(F.struct(F.lit("prueba").alias("level"), F.col("segment_id").cast("string").alias("id")))
    return table.withColumn("_l", F.explode(F.array(F.struct(F.lit("tramo").alias("level"), stretch.alias("id")), other))).select("*", "_l.level", "_l.id").drop("_l", "_declared")


def _by_level(leveled: DataFrame, readings: DataFrame, sums: dict[str, Column] | None = None, most: dict[str, Column] | None = None) -> DataFrame:
    """level, id, the columns of depth_by_level(), and sums and maxima of more columns.

    leveled is read once: frames are added up by run of a group, where the series of the run joins them, and the runs by group.
    """
    group, d = ["level", "id"], F.col("depth")
    added = {"_d_sum": d, "_d_n": d.isNotNull().cast("long"), "_d_deep": (d >= DEEP_CM).cast("long")} | (sums or {})
    topped = {"a_max": d, "_late": F.col("t_norm")} | (most or {})
    runs = leveled.groupBy(*group, "user_id").agg(F.min("t_norm").alias("_early"), *[F.sum(e).alias(k) for k, e in added.items()], *[F.max(e).alias(k) for k, e in topped.items()])
    runs = runs.join(series_features(readings), "user_id", "left")
    of_series = ("s_sum", "s_n", "s_deep", "s_all")
    out = runs.groupBy(*group).agg(F.min("_early").alias("_early"), *[F.sum(k).alias(k) for k in (*added, *of_series)], *[F.max(k).alias(k) for k in (*topped, "s_max")])
    whole = (F.col("level") != "tramo") | ((F.col("_early") <= 0) & (F.col("_late") >= 1))
    of = lambda series, aligned: F.when(whole, series).otherwise(aligned)
    source = F.when(F.col("s_all").isNull(), "sin_sensor").when(whole, F.when(F.col("s_n") > 0, "ultrasonico_prueba_completa").otherwise("sin_lecturas_validas"))
    source = source.when(F.col("a_max").isNotNull(), "ultrasonico_alineado_tiempo_normalizado").when(F.col("s_n") == 0, "sin_lecturas_validas").otherwise("sin_sensor")
    depths = {
        "depth_max": of(F.col("s_max"), F.col("a_max")), "depth_mean": of(F.try_divide("s_sum", "s_n"), F.try_divide("_d_sum", "_d_n")), "depth_deep": of(F.try_divide("s_deep", "s_n"), F.try_divide("_d_deep", "_d_n")),
        "depth_source": source, "readings_valid": F.coalesce("s_n", F.lit(0)), "readings": F.coalesce("s_all", F.lit(0)),
    }
    return out.select(*group, *[e.alias(k) for k, e in depths.items()], *(sums or {}), *(most or {}))


def depth_by_level(leveled: DataFrame, readings: DataFrame) -> DataFrame:
    """level, id, deepest, mean and share of deep readings, and where they come from: whole series for sites, runs and
    stretches that span their run, else the readings beside the frames.
    """
    return _by_level(leveled, readings)


def via_table(leveled: DataFrame, readings: DataFrame) -> DataFrame:
    """A row a stretch and a site: densities averaged and then scored, damages on a fifth of the photos or more, label, action, depth, confidence."""
    own = lambda p: [(k, F.col(f"{p}_{k}")) for k in c.CLASSES]
    some = reduce(lambda a, b: a + b, [n for _, n in own("n")]) > 0
    sums = {"n_frames": F.lit(1), "_area": F.col("area"), "_some": some.cast("long")}
    sums |= {f"rho_{k}": e for k, e in own("rho")} | {f"n_{k}": e for k, e in own("n")} | {f"_with_{k}": (e > 0).cast("long") for k, e in own("n")}
    sums |= {f"_sure_{k}": F.when(e > 0, e) for k, e in own("conf")} | {f"_sured_{k}": (e > 0).cast("long") for k, e in own("conf")}
    found = _by_level(leveled, readings, sums, {"max_conf": F.col("max_conf")} | {f"conf_{k}": e for k, e in own("conf")})
    share = lambda k: F.col(k) / F.col("n_frames")
    means = {f"rho_{k}": share(f"rho_{k}") for k in c.CLASSES} | {f"share_{k}": share(f"_with_{k}") for k in c.CLASSES} | {f"sure_{k}": F.try_divide(f"_sure_{k}", f"_sured_{k}") for k in c.CLASSES}
    out = pavement.scored(found.withColumns(means | {"area_pct": 100 * share("_area"), "share_any": share("_some")}))
    damages = F.concat_ws(";", *[F.when(F.col(f"share_{k}") >= PRESENT_SHARE, F.lit(k)) for k in c.CLASSES])
    return out.select(
        "level", "id", "n_frames", F.col("pci_vis").alias("score"), "state", city_state(F.col("pci_vis")).alias("city_state"), "dominant", damages.alias("damages"),
        label(F.col("state"), F.col("depth_max"), F.col("conf_D40")).alias("label"), x.action(F.col("state"), F.coalesce("dominant", F.lit("D00"))).alias("action"),
        *[f"n_{k}" for k in c.CLASSES], *[f"share_{k}" for k in c.CLASSES], *[f"conf_{k}" for k in c.CLASSES], *[(100 - F.col(f"dv_{k}")).alias(f"sub_{k}") for k in c.CLASSES],
        "area_pct", "max_conf", "share_any", x.by_class({k: F.col(f"sure_{k}") for k in c.CLASSES}, F.col("dominant")).alias("confidence"),
        "depth_max", "depth_mean", "depth_deep", "depth_source", "readings_valid", "readings", severity(F.col("depth_max")).alias("severity"),
    )


def stretch_rows(fixes: DataFrame) -> DataFrame:
    """A row a stretch of a run's fixes (user_id, stretch, us, event_id, lat, lon, dist_m, sat): ends, centre, length, times, uncertainty, digest."""
    first, last = (lambda k: F.min_by(k, F.struct("us", "event_id"))), (lambda k: F.max_by(k, F.struct("us", "event_id")))
    names = F.concat_ws("", F.array_sort(F.collect_list(F.sha1(F.col("event_id").cast("string")))))
    clock = lambda us: F.date_format(F.timestamp_micros(us), "HH:mm:ss")
    out = fixes.groupBy("user_id", "stretch").agg(
        F.count(F.lit(1)).alias("n"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), first("lat").alias("lat_from"), first("lon").alias("lon_from"), last("lat").alias("lat_to"), last("lon").alias("lon_to"),
        (F.max("dist_m") - F.min("dist_m")).alias("length_m"), clock(F.min("us")).alias("from_time"), clock(F.max("us")).alias("to_time"), F.max(uncertainty(F.col("sat"))).alias("uncertainty_m"), F.substring(F.sha1(names), 1, 12).alias("digest"),
    )
    via = F.concat(F.lit("VIA-"), F.substring(F.sha1(F.concat_ws("|", F.col("user_id").cast("string"), F.col("stretch").cast("string"))), 1, 12))
    run = F.concat(F.lit("PRU-"), F.substring(F.sha1(F.col("user_id").cast("string")), 1, 8))
    return out.withColumn("via", via).withColumn("run_id", run).withColumn("geohash7", x.geohash(F.col("lat"), F.col("lon"), 7))
