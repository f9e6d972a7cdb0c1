"""Every registered road-condition query beside the DuckDB SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .. import config as c
from ..functions import exprs as x
from ..operators import boxes as bx
from ..operators import evaluation as ev
from ..operators import geo, graph, pavement, sampling, tracks, vision
from ..sources import tables as t

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *frames: str):
    """Registers a query under its function's name, with its SQL after the named frames."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = ("WITH " + ", ".join(t.SQL[k] for k in frames) + (", " if sql.lstrip().startswith("+") else " ") if frames else "") + sql.lstrip().removeprefix("+")
        return f

    return add


r6 = lambda k, name=None: F.round(F.col(k) if isinstance(k, str) else k, 6).alias(name or k)

_SIZE = "(CASE WHEN cy - 0.4 > 0 THEN least(greatest(0.6 / greatest(cy - 0.4, 1e-6), 1), 3) ELSE 3 END) * (CASE cls WHEN 'D00' THEN h WHEN 'D10' THEN w ELSE sqrt(w * h) END)"
_DENSITY = "CASE cls WHEN 'D00' THEN 10.5 * h WHEN 'D10' THEN 4.2 * w WHEN 'D20' THEN 41.0 * w * h ELSE 0.7 END"
_CUTS = f"det AS (SELECT *, {_SIZE} AS size, {_DENSITY} AS density FROM boxes WHERE conf >= {c.DETECTION}), cuts AS (SELECT cls, quantile_cont(size, 0.5) AS low, quantile_cont(size, 0.85) AS high FROM det GROUP BY cls)"
_RHO = f"{_CUTS}, rho AS (SELECT image_id, cls, sum(density * CASE WHEN size < low THEN 0.33 WHEN size >= high THEN 3.0 ELSE 1.0 END) AS rho FROM det JOIN cuts USING (cls) GROUP BY image_id, cls), wide AS (SELECT image_id, " + ", ".join(f"coalesce(sum(rho) FILTER (cls = '{k}'), 0) AS rho_{k}" for k in c.CLASSES) + " FROM rho GROUP BY image_id), fr AS (SELECT f.*, " + ", ".join(f"coalesce(rho_{k}, 0) AS rho_{k}" for k in c.CLASSES) + " FROM frames f LEFT JOIN wide USING (image_id))"
_DV = ", ".join(f"CASE WHEN rho_{k} > 0 THEN least(greatest({a} + {b} * log10(greatest(rho_{k}, 1e-9)), 0), {m}) ELSE 0 END AS dv_{k}" for k, (a, b, m) in c.DEDUCT.items())
_TOP, _SUM = "greatest(dv_D00, dv_D10, dv_D20, dv_D40)", "(dv_D00 + dv_D10 + dv_D20 + dv_D40)"
_PCI = f"100 - least(100, {_TOP} + 0.35 * ({_SUM} - {_TOP}))"
_STATE = "CASE WHEN {0} >= 86 THEN 'bueno' WHEN {0} >= 71 THEN 'satisfactorio' WHEN {0} >= 56 THEN 'regular' WHEN {0} >= 41 THEN 'malo' ELSE 'muy_malo' END"
_DOMINANT = f"CASE WHEN {_TOP} <= 0 THEN NULL " + " ".join(f"WHEN dv_{k} = {_TOP} THEN '{k}'" for k in c.CLASSES) + " END"


def _detections(spark: SparkSession, d: str) -> DataFrame:
    return t.all_boxes(spark, d).where(F.col("conf") >= c.DETECTION)


def _densities(spark: SparkSession, d: str) -> DataFrame:
    boxes = _detections(spark, d)
    return pavement.frame_density(boxes, pavement.cutoffs(boxes), t.frames(spark, d))


@query(f"+{_RHO}, seg AS (SELECT segment_id, count(*) AS n_frames, " + ", ".join(f"avg(rho_{k}) AS rho_{k}" for k in c.CLASSES) + f" FROM fr GROUP BY segment_id), dv AS (SELECT *, {_DV} FROM seg), p AS (SELECT *, {_PCI} AS pci FROM dv) SELECT segment_id, n_frames, round(pci, 6) AS pci_vis, {_STATE.format('pci')} AS state, {_DOMINANT} AS dominant FROM p", "boxes", "frames")
def pci_segment_state(spark, d):
    return pavement.segment_scores(_densities(spark, d)).select("segment_id", "n_frames", r6("pci_vis"), "state", "dominant")


@query(f"+{_CUTS} SELECT cls, round(low, 6) AS low, round(high, 6) AS high FROM cuts", "boxes")
def pci_cutoffs(spark, d):
    return pavement.cutoffs(_detections(spark, d)).select("cls", r6("low"), r6("high"))


@query(f"+{_RHO}, dv AS (SELECT *, {_DV} FROM fr) SELECT image_id, " + ", ".join(f"round(rho_{k}, 6) AS rho_{k}, round(dv_{k}, 6) AS dv_{k}" for k in c.CLASSES) + f", round({_PCI}, 6) AS pci_vis FROM dv", "boxes", "frames")
def pci_frame_score(spark, d):
    return pavement.scored(_densities(spark, d)).select("image_id", *[r6(f"{p}_{k}") for k in c.CLASSES for p in ("rho", "dv")], r6("pci_vis"))


@query("SELECT o_orderkey, round(100 * exp(-0.18 * greatest(0, o_totalprice / 50000 - 1)), 6) AS ride, round(0.65 * (o_orderkey % 101) + 0.35 * 100 * exp(-0.18 * greatest(0, o_totalprice / 50000 - 1)), 6) AS icv FROM orders")
def pci_ride_icv(spark, d):
    ride = x.ride(F.col("o_totalprice") / 50000)
    return t.read(spark, d, "orders").select("o_orderkey", r6(ride, "ride"), r6(x.icv((F.col("o_orderkey") % 101).cast("double"), ride), "icv"))


_KEY = "image_id, cls, l_partkey, l_suppkey, l_linenumber, conf, cx, cy, w, h"
_TAU = "CASE cls WHEN 'D00' THEN 0.25 WHEN 'D10' THEN 0.15 ELSE 0.20 END"
_SPAN = "greatest(0, least({a}.{x} + {a}.{n} / 2, {b}.{x} + {s} + {b}.{n} / 2) - greatest({a}.{x} - {a}.{n} / 2, {b}.{x} + {s} - {b}.{n} / 2))"


def _iou(a: str, b: str, shift: float = 0.0) -> str:
    both = "(" + _SPAN.format(a=a, b=b, x="cx", n="w", s=0.0) + " * " + _SPAN.format(a=a, b=b, x="cy", n="h", s=shift) + ")"
    return f"({both} / ({a}.w * {a}.h + {b}.w * {b}.h - {both} + 1e-9))"


_EARLY = f"e AS (SELECT {_KEY}, segment_id, chain_pos, CASE WHEN conf < {_TAU} THEN '1_confianza' WHEN cls = 'D10' AND w > 0.5 AND h < 0.15 THEN '2_banda' WHEN NOT (cy > 0.35 AND abs(cx - 0.5) < 0.38 + 0.12 * cy) THEN '2_fuera_de_via' END AS early FROM boxes JOIN frames USING (image_id))"


@query(f"+{_EARLY}, k AS (SELECT * FROM e WHERE early IS NULL), ok AS (SELECT DISTINCT a.segment_id, a.cls, a.chain_pos, a.cx, a.cy, a.w, a.h FROM k a JOIN k b ON a.segment_id = b.segment_id AND a.cls = b.cls AND abs(a.chain_pos - b.chain_pos) BETWEEN 1 AND 2 AND greatest({_iou('a', 'b')}, {_iou('a', 'b', 0.15)}, {_iou('a', 'b', -0.15)}) >= 0.3) SELECT {_KEY}, coalesce(early, CASE WHEN ok.cls IS NULL THEN '3_sin_persistencia' END, '') AS reason FROM e LEFT JOIN ok USING (segment_id, cls, chain_pos, cx, cy, w, h)", "boxes", "frames")
def fld_filter(spark, d):
    return bx.filtered(t.all_boxes(spark, d), t.frames(spark, d))


_MATCH = f"dt AS (SELECT DISTINCT {_KEY} FROM boxes WHERE flag <> 'R'), tr AS (SELECT DISTINCT {_KEY} FROM boxes WHERE flag = 'R'), pr AS (SELECT d.*, {{'p': g.l_partkey, 's': g.l_suppkey, 'l': g.l_linenumber}} AS g, {{'cx': g.cx, 'cy': g.cy, 'w': g.w, 'h': g.h}} AS b, {_iou('d', 'g')} AS iou FROM dt d JOIN tr g USING (image_id, cls)), bid AS (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY iou DESC, g DESC, b DESC) AS r FROM pr), won AS (SELECT *, row_number() OVER (PARTITION BY image_id, cls, g, b ORDER BY conf DESC, l_partkey, l_suppkey, l_linenumber, cx, cy, w, h) AS n FROM bid WHERE r = 1 AND iou >= 0.5)"


@query(f"+{_MATCH} SELECT dt.*, CASE WHEN won.n = 1 THEN 1 ELSE 0 END AS tp FROM dt LEFT JOIN won USING ({_KEY})", "boxes")
def jn_iou_greedy(spark, d):
    boxes = t.all_boxes(spark, d)
    return bx.matched(boxes.where("flag != 'R'"), boxes.where("flag = 'R'"))


@query("+top AS (SELECT image_id, cls, max(conf) FILTER (flag <> 'R') AS top, max(CASE WHEN flag = 'R' THEN 1 ELSE 0 END) AS truth FROM boxes GROUP BY ALL), g AS (SELECT range AS s FROM range(2, 81)), f AS (SELECT cls, s, coalesce(2 * sum(truth) FILTER (top * 100 + 1e-9 >= s) / nullif(count(*) FILTER (top * 100 + 1e-9 >= s) + sum(truth), 0), 0) AS f1 FROM top, g GROUP BY cls, s) SELECT cls, arg_min(s, (-f1, s))::INT AS tau_hundredths, round(max(f1), 6) AS f1 FROM f GROUP BY cls", "boxes")
def vis_thresholds(spark, d):
    boxes = t.all_boxes(spark, d)
    top = boxes.groupBy("image_id", "cls").agg(F.coalesce(F.max(F.when(F.col("flag") != "R", F.col("conf"))), F.lit(0.0)).alias("top"), F.max((F.col("flag") == "R").cast("int")).alias("truth"))
    return bx.presence_thresholds(top, [2, 80]).select("cls", "tau_hundredths", r6("f1"))


n6 = lambda e, name=None: F.round((F.col(e) if isinstance(e, str) else e) + 1e-9, 6).alias(name or e)  # off the ties of six decimals

_RASTER = (
    "SELECT DISTINCT image_id, cls, x, y FROM {0}, "
    "LATERAL (SELECT unnest(range(greatest(0, trunc((cx - w / 2) * 64))::INT, least(64, ceil((cx + w / 2) * 64))::INT)) AS x), "
    "LATERAL (SELECT unnest(range(greatest(0, trunc((cy - h / 2) * 64))::INT, least(64, ceil((cy + h / 2) * 64))::INT)) AS y)"
)
_KAPPA = "CASE WHEN size < low THEN 0.33 WHEN size >= high THEN 3.0 ELSE 1.0 END"


def _vis_sql(k: str) -> str:
    own, hard = f"cls = '{k}'", f"cls = '{k}' AND conf >= tau"
    return (
        f"count(*) FILTER ({hard}) AS n_{k}, coalesce(sum(conf) FILTER ({own}), 0) AS soft_{k}, coalesce(max(conf) FILTER ({own}), 0) AS maxconf_{k}, "
        f"count(*) FILTER ({own} AND conf >= 0.05 AND conf < tau) AS nsub_{k}, coalesce(avg(w * h) FILTER ({hard}), 0) AS area_mean_{k}, "
        f"coalesce(max(w * h) FILTER ({hard}), 0) AS area_max_{k}, coalesce(avg(cy) FILTER ({hard}), 0) AS cy_mean_{k}, "
        f"coalesce(sum(rho) FILTER ({hard}), 0) AS hard_{k}, coalesce(sum(rho * conf) FILTER ({own} AND conf >= 0.05), 0) AS weak_{k}"
    )


_N = "(" + " + ".join(f"n_{k}" for k in c.CLASSES) + ")"
_DV_OF = {k: f"CASE WHEN {{0}}_{k} > 0 THEN least(greatest({a} + {b} * log10(greatest({{0}}_{k}, 1e-9)), 0), {m}) ELSE 0 END" for k, (a, b, m) in c.DEDUCT.items()}


def _pci_of(p: str) -> str:
    dv = [_DV_OF[k].format(p) for k in c.CLASSES]
    top = f"greatest({', '.join(dv)})"
    return f"100 - least(100, {top} + 0.35 * ({' + '.join(f'({e})' for e in dv)} - {top}))"


_VIS = (
    f"{_CUTS}, sb AS (SELECT b.*, {_TAU} AS tau, {_SIZE} AS size, {_DENSITY} AS density FROM boxes b), "
    f"wb AS (SELECT sb.*, density * {_KAPPA} AS rho FROM sb LEFT JOIN cuts USING (cls)), hb AS (SELECT * FROM wb WHERE conf >= tau), "
    f"ag AS (SELECT image_id, {', '.join(map(_vis_sql, c.CLASSES))}, "
    "coalesce(sum(w * h) FILTER (conf >= tau AND abs(cx - 0.5) <= 0.3) / sum(w * h) FILTER (conf >= tau), 0) AS rodada_share, coalesce(max(conf), 0) AS max_conf FROM wb GROUP BY image_id), "
    f"ce AS ({_RASTER.format('hb')}), un AS (SELECT image_id, {', '.join(f'count(*) FILTER (cls = {chr(39)}{k}{chr(39)}) / 4096.0 AS union_{k}' for k in c.CLASSES)}, "
    "count(DISTINCT x * 64 + y) / 4096.0 AS union_total FROM ce GROUP BY image_id), "
    "wide AS (SELECT f.image_id, coalesce(COLUMNS(ag.* EXCLUDE (image_id)), 0), coalesce(COLUMNS(un.* EXCLUDE (image_id)), 0) "
    "FROM frames f LEFT JOIN ag ON f.image_id = ag.image_id LEFT JOIN un ON f.image_id = un.image_id), "
    f"vis AS (SELECT *, -({' + '.join(f'CASE WHEN n_{k} > 0 THEN n_{k} / {_N} * ln(n_{k} / {_N}) ELSE 0 END' for k in c.CLASSES)}) AS entropia_clases, "
    + ", ".join(f"hard_{k} AS rho_det_{k}, {_DV_OF[k].format('hard')} AS dv_det_{k}, weak_{k} AS rho_soft_{k}" for k in c.CLASSES)
    + f", {_pci_of('hard')} AS pci_det, {_pci_of('weak')} AS pci_soft FROM wide)"
)
_COUNTS = [f"{p}_{k}" for p in ("n", "nsub") for k in c.CLASSES]


@query(f"+{_VIS} SELECT image_id, " + ", ".join(k if k in _COUNTS else f"round({k} + 1e-9, 6) AS {k}" for k in vision.FEATURES) + " FROM vis", "boxes", "frames")
def vis_frame(spark, d):
    """Fifty features of each frame."""
    boxes = t.all_boxes(spark, d)
    out = vision.frame_features(boxes, t.frames(spark, d), pavement.cutoffs(_detections(spark, d)), c.TAU_FIELD)
    return out.select("image_id", *[F.col(k) if k in _COUNTS else n6(k) for k in vision.FEATURES])


@query("+has AS (SELECT segment_id, chain_pos, f.image_id, max(CASE WHEN conf >= 0.9 THEN 1 ELSE 0 END) AS has FROM frames f LEFT JOIN boxes USING (image_id) GROUP BY ALL), l AS (SELECT *, lag(has) OVER (PARTITION BY segment_id ORDER BY chain_pos) AS prev FROM has) SELECT segment_id, count(*) AS n, round(avg(has), 6) AS share, coalesce(round(avg(has * prev), 6), 0) AS persistence FROM l GROUP BY segment_id", "boxes", "frames")
def vis_segment(spark, d):
    has = t.frames(spark, d).join(t.all_boxes(spark, d).select("image_id", "conf"), "image_id", "left").groupBy("segment_id", "chain_pos", "image_id").agg(F.max(F.when(F.col("conf") >= 0.9, 1).otherwise(0)).alias("has"))
    prev = F.lag("has").over(Window.partitionBy("segment_id").orderBy("chain_pos"))
    return has.withColumn("prev", prev).groupBy("segment_id").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("has"), "share"), F.coalesce(F.round(F.avg(F.col("has") * F.col("prev")), 6), F.lit(0.0)).alias("persistence"))


#: A piece of these tracks, of a fix or so an hour.
_PIECE_US = 30 * 24 * 3600 * tracks.SECOND


@query("SELECT event_id, round(quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 3599999999 PRECEDING AND 3600000000 FOLLOWING), 6) AS smooth FROM track", "track")
def win_time_median(spark, d):
    return tracks.smoothed(t.track(spark, d), 3600 * tracks.SECOND, piece_us=_PIECE_US).select("event_id", r6("smooth"))


_HAV = "2 * 6371000.0 * asin(sqrt(pow(sin(radians({2} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({2})) * pow(sin(radians({3} - {1}) / 2), 2)))"
_DIST = "s AS (SELECT *, coalesce(" + _HAV.format("lag(lat) OVER w", "lag(lon) OVER w", "lat", "lon") + ", 0) AS step_m FROM track WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)), c AS (SELECT *, sum(step_m) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS dist_m FROM s)"


@query(f"+{_DIST} SELECT event_id, user_id, round(step_m, 4) AS step_m, round(dist_m, 3) AS dist_m FROM c", "track")
def win_cumdist(spark, d):
    return tracks.cumulative(t.track(spark, d), piece_us=_PIECE_US).select("event_id", "user_id", F.round("step_m", 4).alias("step_m"), F.round("dist_m", 3).alias("dist_m"))


@query(f"+{_DIST}, b AS (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY floor(dist_m / 2000)) - 1 AS dense FROM c), k AS (SELECT *, max(dense) OVER (PARTITION BY user_id) AS last, count(*) OVER (PARTITION BY user_id, dense) AS m FROM b) SELECT event_id, user_id, CASE WHEN dense = last AND m < 5 AND last > 0 THEN dense - 1 ELSE dense END::INT AS stretch FROM k", "track")
def win_cut_dense(spark, d):
    return tracks.stretches(tracks.cumulative(t.track(spark, d), piece_us=_PIECE_US), 2000.0, 5).select("event_id", "user_id", F.col("stretch").cast("int").alias("stretch"))


def _times(spark: SparkSession, d: str) -> DataFrame:
    return t.read(spark, d, "orders").select((F.col("o_custkey") % 150).alias("user_id"), F.col("o_orderkey").alias("query"), (F.lit(1704067200000000) + (F.col("o_orderkey") * 7919 % 2600000) * 1000000).alias("us"))


_INTERP = "q AS (SELECT o_custkey % 150 AS user_id, o_orderkey AS query, 1704067200000000 + ((o_orderkey * 7919) % 2600000) * 1000000 AS us FROM orders), one AS (SELECT user_id, us, arg_max(value, event_id) AS value FROM track GROUP BY ALL), a AS (SELECT q.*, o.us AS au, o.value AS av FROM q ASOF LEFT JOIN one o ON q.user_id = o.user_id AND q.us >= o.us), b AS (SELECT a.*, o.us AS bu, o.value AS bv FROM a ASOF LEFT JOIN one o ON a.user_id = o.user_id AND a.us <= o.us)"


@query(f"+{_INTERP} SELECT user_id, query, us, round(CASE WHEN au IS NULL THEN bv WHEN bu IS NULL OR au = bu THEN av ELSE av + (us - au)::DOUBLE / (bu - au) * (bv - av) END, 6) AS value, CASE WHEN au IS NULL THEN bu WHEN bu IS NULL OR us - au <= bu - us THEN au ELSE bu END AS nearest_us, au IS NOT NULL AND bu IS NOT NULL AS inside FROM b", "track")
def jn_interp(spark, d):
    return tracks.interpolated(t.track(spark, d), _times(spark, d), _PIECE_US).select("user_id", "query", "us", r6("value"), "nearest_us", "inside")


_SPAN_OF = "OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 3599999999 PRECEDING AND 3600000000 FOLLOWING)"
_LOCATED = (
    f"sm AS (SELECT user_id, event_id, us, value / 100 AS speed, event_id % 20 AS sat, quantile_cont(lat, 0.5) {_SPAN_OF} AS lat, quantile_cont(lon, 0.5) {_SPAN_OF} AS lon FROM track), "
    "st AS (SELECT *, coalesce(" + _HAV.format("lag(lat) OVER w", "lag(lon) OVER w", "lat", "lon") + ", 0) AS step_m FROM sm WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)), "
    "di AS (SELECT *, sum(step_m) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS dist_m FROM st), "
    "fx AS (SELECT user_id, us, arg_max({'us': us, 'lat': lat, 'lon': lon, 'dist_m': dist_m, 'speed': speed, 'sat': sat}, event_id) AS f FROM di GROUP BY ALL), "
    "q AS (SELECT o_custkey % 150 AS user_id, o_orderkey AS query, 1704067200000000 + ((o_orderkey * 7919) % 2600000) * 1000000 AS us FROM orders), "
    "aa AS (SELECT q.*, fx.f AS a FROM q ASOF LEFT JOIN fx ON q.user_id = fx.user_id AND q.us >= fx.us), bb AS (SELECT aa.*, fx.f AS b FROM aa ASOF LEFT JOIN fx ON aa.user_id = fx.user_id AND aa.us <= fx.us)"
)
_LINE = "CASE WHEN a IS NULL THEN b.{0} WHEN b IS NULL OR a.us = b.us THEN a.{0} ELSE a.{0} + (us - a.us)::DOUBLE / (b.us - a.us) * (b.{0} - a.{0}) END"
_CLOSE = "CASE WHEN a IS NULL THEN b.{0} WHEN b IS NULL OR us - a.us <= b.us - us THEN a.{0} ELSE b.{0} END"


@query(f"+{_LOCATED} SELECT user_id, query, " + ", ".join(f"round({_LINE.format(k)} + 1e-10, {n}) AS {k}" for k, n in (("lat", 7), ("lon", 7), ("dist_m", 2), ("speed", 4))) + f", {_CLOSE.format('sat')} AS sat, abs(us - {_CLOSE.format('us')}) AS gps_dt_us, a IS NOT NULL AND b IS NOT NULL AS inside FROM bb", "track")
def fld_gpx(spark, d):
    """Tracks smoothed, measured and read at photo times."""
    track = t.track(spark, d).withColumn("speed", F.col("value") / 100).withColumn("sat", F.col("event_id") % 20)
    out = tracks.located(track, _times(spark, d), 3600 * tracks.SECOND, piece_us=_PIECE_US)
    read = lambda k, n: F.round(F.col(k) + 1e-10, n).alias(k)  # off the ties of a few decimals
    return out.select("user_id", "query", read("lat", 7), read("lon", 7), read("dist_m", 2), read("speed", 4), "sat", F.round(F.col("gps_dt_s") * 1_000_000).cast("long").alias("gps_dt_us"), "inside")


_DEPTH = "d AS (SELECT *, (floor(value)::BIGINT % 60)::DOUBLE AS cm FROM track), v AS (SELECT *, CASE WHEN cm <= 0 THEN 'lectura_nula' WHEN cm > 35 THEN 'fuera_de_rango' ELSE '' END AS reason, (us - min(us) OVER w)::DOUBLE / greatest(max(us) OVER w - min(us) OVER w, 1000000) AS t_norm FROM d WINDOW w AS (PARTITION BY user_id)), x AS (SELECT *, CASE WHEN reason = '' THEN cm - 8 END AS depth FROM v)"


@query(f"+{_DEPTH} SELECT event_id, cm, reason, depth, round(t_norm, 6) AS t_norm FROM x", "track")
def fld_depth_clean(spark, d):
    return tracks.depths(t.track(spark, d)).select("event_id", "cm", "reason", "depth", r6("t_norm"))


@query(f"+{_DEPTH}, f AS (SELECT user_id, max(depth) AS deepest, quantile_cont(depth, 0.95) AS p95, avg(depth) AS mean, stddev_pop(depth) AS std, avg((depth >= 3)::INT) AS share_3, count(depth) AS n FROM x GROUP BY user_id) SELECT user_id, deepest, round(p95, 6) AS p95, round(mean, 6) AS mean, round(std, 6) AS std, round(share_3, 6) AS share_3, n, CASE WHEN p95 IS NULL OR p95 < 0 THEN NULL WHEN p95 < 2.5 THEN 'L' WHEN p95 < 5 THEN 'M' ELSE 'H' END AS severity FROM f", "track")
def fld_depth_features(spark, d):
    return tracks.depth_features(tracks.depths(t.track(spark, d))).select("user_id", "deepest", r6("p95"), r6("mean"), r6("std"), r6("share_3"), "n", "severity")


@query(f"+{_DEPTH}, q AS (SELECT DISTINCT o_custkey % 150 AS user_id, o_orderkey AS query, (o_orderkey % 1000) / 1000.0::DOUBLE AS q FROM orders) SELECT user_id, query, q, max(depth) AS depth FROM (SELECT q.*, x.depth FROM q LEFT JOIN x ON q.user_id = x.user_id AND abs(x.t_norm - q.q) <= 0.03) GROUP BY ALL", "track")
def jn_range_norm(spark, d):
    q = t.read(spark, d, "orders").select((F.col("o_custkey") % 150).alias("user_id"), F.col("o_orderkey").alias("query"), (F.col("o_orderkey") % 1000 / 1000.0).cast("double").alias("q")).distinct()
    return tracks.near_in_time(q, tracks.depths(t.track(spark, d)))


@query("+p AS (SELECT q.id, count(r.id) AS n, min(" + _HAV.format("q.lat", "q.lon", "r.lat", "r.lon") + ") AS m FROM q LEFT JOIN r ON " + _HAV.format("q.lat", "q.lon", "r.lat", "r.lon") + " <= 500 GROUP BY q.id) SELECT id, n, round(m, 4) AS nearest_m FROM p", "customers", "suppliers")
def geo_proximity(spark, d):
    near = geo.within(t.points(spark, d, "customer", "c_custkey"), t.points(spark, d, "supplier", "s_suppkey"), 500.0)
    return near.select("id", "n", F.round("nearest_m", 4).alias("nearest_m"))


@query("SELECT id, round(100.0 * (SELECT count(*) FROM part WHERE p_retailprice <= v) / (SELECT count(*) FROM part), 6) AS score FROM (SELECT c_custkey AS id, 900 + c_acctbal / 10 AS v FROM customer)")
def win_pct_rank_ref(spark, d):
    values = t.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), (900 + F.col("c_acctbal") / 10).alias("v0"))
    return geo.percentile_of(values, t.read(spark, d, "part"), "v0", "p_retailprice", "score").select("id", r6("score"))


_HASH32 = "'0123456789bcdefghjkmnpqrstuvwxyz'"


def _geohash_sql(length: int) -> str:
    n_lon, n_lat = (length * 5 + 1) // 2, length * 5 // 2
    out = []
    for i in range(length):
        bits = [f"((floor((lon + 180) / 360 * {1 << n_lon})::BIGINT >> {n_lon - 1 - k // 2}) & 1)" if k % 2 == 0 else f"((floor((lat + 90) / 180 * {1 << n_lat})::BIGINT >> {n_lat - 1 - k // 2}) & 1)" for k in range(5 * i, 5 * i + 5)]
        out.append(f"substr({_HASH32}, 1 + " + " + ".join(f"{b} * {1 << (4 - j)}" for j, b in enumerate(bits)) + ", 1)")
    return " || ".join(out)


@query(f"SELECT id, {_geohash_sql(7)} AS geohash7, {_geohash_sql(5)} AS geohash5 FROM q", "customers")
def fn_geohash(spark, d):
    return t.points(spark, d, "customer", "c_custkey").select("id", x.geohash(F.col("lat"), F.col("lon"), 7).alias("geohash7"), x.geohash(F.col("lat"), F.col("lon"), 5).alias("geohash5"))


_DAY = "d AS (SELECT event_type, ts::DATE AS day, sum(value) AS v FROM events GROUP BY ALL)"


@query(f"WITH {_DAY} SELECT event_type, day, round(sum(v) OVER w7, 4) AS sum_7, round(avg(v) OVER w30, 4) AS mean_30, count(*) FILTER (v >= 3000) OVER w7 AS wet_7 FROM d WINDOW w7 AS (PARTITION BY event_type ORDER BY day ROWS 6 PRECEDING), w30 AS (PARTITION BY event_type ORDER BY day ROWS 29 PRECEDING)")
def win_rows_rolling(spark, d):
    day = t.read(spark, d, "events").groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.sum("value").alias("v"))
    w = Window.partitionBy("event_type").orderBy("day")
    return day.select("event_type", "day", F.round(F.sum("v").over(w.rowsBetween(-6, 0)), 4).alias("sum_7"), F.round(F.avg("v").over(w.rowsBetween(-29, 0)), 4).alias("mean_30"), F.count_if(F.col("v") >= 3000).over(w.rowsBetween(-6, 0)).alias("wet_7"))


_YP = "yp AS (SELECT o_orderkey AS id, o_totalprice / 1000 AS y, round(o_totalprice / 1000 + (o_orderkey * 7919) % 97 - 48, 2) AS p FROM orders)"


def _yp(spark: SparkSession, d: str) -> DataFrame:
    # sums from left to right and halves of a hundredth judged on the double, as the SQL has them
    shifted = F.col("o_totalprice") / 1000 + F.col("o_orderkey") * 7919 % 97 - 48
    return t.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 1000).alias("y"), (F.round(shifted * 100, 0) / 100).alias("p"))


@query(f"WITH {_YP}, rk AS (SELECT *, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rp FROM yp) SELECT count(*) AS n, round(avg(abs(p - y)), 5) AS mae, round(sqrt(avg((p - y) * (p - y))), 5) AS rmse, round(1 - sum((p - y) * (p - y)) / (var_pop(y) * count(y)), 5) AS r2, round(corr(y, p), 5) AS pearson, round(corr(ry, rp), 5) AS spearman, round(avg(p - y), 5) AS bias FROM rk")
def ev_regression(spark, d):
    m = ev.regression(_yp(spark, d))
    return m.select("n", *[F.round(k, 5).alias(k) for k in m.columns[1:]])


_CELLS = f"{_YP}, st AS (SELECT {_STATE.format('(y / 4)')} AS truth, {_STATE.format('(p / 4)')} AS predicted FROM yp), nm AS (SELECT unnest(['bueno','satisfactorio','regular','malo','muy_malo']) AS s, unnest([0,1,2,3,4]) AS i), cell AS (SELECT a.s AS truth, b.s AS predicted, a.i AS i, b.i AS j, (SELECT count(*) FROM st WHERE st.truth = a.s AND st.predicted = b.s) AS n FROM nm a, nm b)"


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return ev.confusion(_yp(spark, d).select(x.state(F.col("y") / 4).alias("truth"), x.state(F.col("p") / 4).alias("predicted")))


@query(f"WITH {_CELLS} SELECT truth, predicted, n FROM cell")
def ev_confusion(spark, d):
    return _cells(spark, d)


@query(f"WITH {_CELLS}, m AS (SELECT *, sum(n) OVER (PARTITION BY i) AS ni, sum(n) OVER (PARTITION BY j) AS nj, sum(n) OVER () AS t FROM cell) SELECT round(sum(n) FILTER (i = j) / max(t), 6) AS accuracy, round(sum(n) FILTER (abs(i - j) <= 1) / max(t), 6) AS within_one, round(avg(coalesce(2.0 * n / nullif(ni + nj, 0), 0)) FILTER (i = j), 6) AS macro_f1, round(1 - sum((i - j) * (i - j) * n) / sum((i - j) * (i - j) * ni * nj / t), 6) AS kappa, "
    "round(avg(n / nullif(ni, 0)) FILTER (i = j), 6) AS balanced, round(sum(n) FILTER (i >= 3 AND j >= 3) / nullif(sum(n) FILTER (i >= 3), 0), 6) AS recall_bad, "
    "round(sum(n) FILTER (i >= 3 AND j >= 3) / nullif(sum(n) FILTER (j >= 3), 0), 6) AS precision_bad FROM m")
def ev_ordinal(spark, d):
    m = ev.ordinal(_cells(spark, d))
    return m.select(*[F.round(F.col(k).cast("double"), 6).alias(k) for k in m.columns])


@query("WITH s AS (SELECT l_quantity / 50 AS conf, l_returnflag = 'R' AS hit FROM lineitem), b AS (SELECT least(greatest(ceil(round(conf * 10, 9)), 1), 10) AS bin, count(*) AS n, avg(conf) AS cf, avg(hit::INT) AS h FROM s WHERE conf > 0 GROUP BY 1) SELECT round(sum(n * abs(cf - h)) / sum(n), 6) AS ece, sum(n)::BIGINT AS n FROM b")
def ev_ece(spark, d):
    m = ev.calibration_error(t.read(spark, d, "lineitem").select((F.col("l_quantity") / 50).alias("conf"), (F.col("l_returnflag") == "R").cast("int").alias("hit")))
    return m.select(r6("ece"), "n")


@query("WITH s AS (SELECT l_quantity AS score, (l_returnflag = 'R')::INT AS truth FROM lineitem), k AS (SELECT score, sum(truth) AS p, count(*) AS k FROM s GROUP BY score), c AS (SELECT *, sum(p) OVER w AS tp, sum(k) OVER w AS hits, sum(p) OVER () AS pos, sum(k) OVER () AS n FROM k WINDOW w AS (ORDER BY score DESC)) SELECT round(sum(p * ((n - pos) - (hits - tp) + (k - p) / 2.0)) / (max(pos) * (max(n) - max(pos))), 6) AS auroc, round(sum(p * tp / hits) / max(pos), 6) AS average_precision, round(sum(p) FILTER (score >= 25) / greatest(sum(k) FILTER (score >= 25), 1), 6) AS precision, round(sum(p) FILTER (score >= 25) / max(pos), 6) AS recall, round(2 * sum(p) FILTER (score >= 25) / (sum(k) FILTER (score >= 25) + max(pos)), 6) AS f1 FROM c")
def ev_presence(spark, d):
    m = ev.presence(t.read(spark, d, "lineitem").select(F.col("l_quantity").alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("truth")), 25.0)
    return m.select(*[r6(k) for k in m.columns])


@query("WITH e AS (SELECT list_distinct([quantile_cont(o_totalprice, i / 10.0) FOR i IN [1]]) AS z FROM orders), r AS (SELECT o_totalprice AS v FROM orders WHERE o_orderkey % 2 = 0), cu AS (SELECT o_totalprice * 1.1 AS v FROM orders WHERE o_orderkey % 2 = 1), q AS (SELECT quantile_cont(v, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS edges FROM r), b AS (SELECT len(list_filter(edges, lambda e: e <= v)) AS bin, ref FROM (SELECT v, 1 AS ref FROM r UNION ALL SELECT v, 0 FROM cu), q), n AS (SELECT bin, sum(ref) AS r, sum(1 - ref) AS c FROM b GROUP BY bin), s AS (SELECT greatest(r / sum(r) OVER (), 1e-4) AS r, greatest(c / sum(c) OVER (), 1e-4) AS c FROM n) SELECT round(sum((c - r) * ln(c / r)), 6) AS psi FROM s".replace("e AS (SELECT list_distinct([quantile_cont(o_totalprice, i / 10.0) FOR i IN [1]]) AS z FROM orders), ", ""))
def ev_psi(spark, d):
    orders = t.read(spark, d, "orders")
    ref = orders.where("o_orderkey % 2 = 0").select(F.col("o_totalprice").alias("v"))
    return ev.stability_index(ref, orders.where("o_orderkey % 2 = 1").select((F.col("o_totalprice") * 1.1).alias("v")), "v").select(r6("psi"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN CASE WHEN v >= 0.7 THEN 'OK' WHEN v >= 0.5 THEN 'ALERTA' ELSE 'FALLA' END WHEN p_size % 3 = 1 THEN CASE WHEN v <= 0.1 THEN 'OK' WHEN v <= 0.25 THEN 'ALERTA' ELSE 'FALLA' END ELSE 'INFO' END AS status FROM (SELECT *, p_retailprice % 1 AS v FROM part)")
def ev_status(spark, d):
    v, s = F.col("p_retailprice") % 1, F.col("p_size") % 3
    return t.read(spark, d, "part").select("p_partkey", ev.status(v, F.when(s == 0, 0.7).otherwise(0.1), F.when(s == 0, 0.5).otherwise(0.25), F.when(s == 0, "mayor").when(s == 1, "menor").otherwise("otro")).alias("status"))


@query("SELECT c_custkey, rule, action FROM (SELECT c_custkey, " + _STATE.format("(c_acctbal / 100)") + " AS rule, ['D00','D10','D20','D40'][1 + c_nationkey % 4] AS dom FROM customer), LATERAL (SELECT CASE rule WHEN 'bueno' THEN 'mantenimiento_rutinario' WHEN 'satisfactorio' THEN 'sellado_de_fisuras' WHEN 'regular' THEN CASE dom WHEN 'D40' THEN 'bacheo' WHEN 'D20' THEN 'parcheo' ELSE 'sellado_de_fisuras' END WHEN 'malo' THEN CASE dom WHEN 'D40' THEN 'bacheo' WHEN 'D20' THEN 'rehabilitacion' ELSE 'parcheo' END ELSE CASE dom WHEN 'D20' THEN 'reconstruccion' ELSE 'rehabilitacion' END END AS action)")
def prj_action(spark, d):
    dom = F.element_at(F.array(*map(F.lit, c.CLASSES)), (F.col("c_nationkey") % 4 + 1).cast("int"))
    return t.read(spark, d, "customer").select("c_custkey", x.state(F.col("c_acctbal") / 100).alias("rule"), x.action(x.state(F.col("c_acctbal") / 100), dom).alias("action"))


@query("SELECT page_id, m AS entry, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS m FROM pages) GROUP BY ALL")
def src_drive_html(spark, d):
    found = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("entry")
    return t.read(spark, d, "pages").select("page_id", found).groupBy("page_id", "entry").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def agg_latest(spark, d):
    orders = t.read(spark, d, "orders")
    return orders.groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_orderstatus", "o_totalprice"), F.struct("o_orderdate", "o_orderkey")).alias("l")).select("o_custkey", "l.*")


@query("SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS \"F\", count(*) FILTER (l_linestatus = 'O') AS \"O\", round(stddev_samp(l_tax), 6) AS sd1, round(stddev_pop(l_tax), 6) AS sd0, round(median(l_quantity), 6) AS med, round(quantile_cont(l_extendedprice, 0.85), 4) AS p85, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag")
def agg_pivot(spark, d):
    rows, key = t.read(spark, d, "lineitem"), "l_returnflag"
    plain = rows.groupBy(key).agg(F.count_if(F.col("l_linestatus") == "F").alias("F"), F.count_if(F.col("l_linestatus") == "O").alias("O"), r6(F.stddev_samp("l_tax"), "sd1"), r6(F.stddev_pop("l_tax"), "sd0"), F.count_distinct("l_suppkey").alias("suppliers"))
    med = sampling.quantiles(rows, "l_quantity", {"med": 0.5}, [key]).select(key, r6("med"))
    p85 = sampling.quantiles(rows, "l_extendedprice", {"p85": 0.85}, [key]).select(key, F.round("p85", 4).alias("p85"))
    return plain.join(F.broadcast(med), key, "left").join(F.broadcast(p85), key, "left")  # a row a flag


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderstatus, o_orderpriority) AS margin FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def agg_crosstab(spark, d):
    return t.read(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("margin"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000 AND o_custkey IS NOT NULL)")
def jn_anti(spark, d):
    return t.read(spark, d, "customer").join(t.read(spark, d, "orders").where("o_totalprice > 450000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT p_partkey, (row_number() OVER (ORDER BY p_retailprice DESC, p_partkey))::INT AS ranking FROM part QUALIFY ranking <= 400")
def rep_client(spark, d):
    best = t.read(spark, d, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(400)
    return best.select("p_partkey", F.row_number().over(Window.orderBy(F.desc("p_retailprice"), "p_partkey")).alias("ranking"))


@query("WITH e AS (SELECT quantile_cont(p_retailprice, 1 / 3.0) AS a, quantile_cont(p_retailprice, 2 / 3.0) AS b FROM part) SELECT p_partkey, CASE WHEN p_retailprice <= a THEN 0 WHEN p_retailprice <= b THEN 1 ELSE 2 END AS tercile FROM part, e")
def win_qcut(spark, d):
    part = t.read(spark, d, "part")
    edges = sampling.quantiles(part, "p_retailprice", {"a": 1 / 3, "b": 2 / 3})
    return part.crossJoin(F.broadcast(edges)).select("p_partkey", F.when(F.col("p_retailprice") <= F.col("a"), 0).when(F.col("p_retailprice") <= F.col("b"), 1).otherwise(2).alias("tercile"))  # edges: one row


@query("SELECT user_id, ws AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, time_bucket(INTERVAL 6 HOUR, ts) AS ws FROM events) GROUP BY ALL")
def ext_tumbling(spark, d):
    from ..streaming.windows import tumbling

    return tumbling(t.read(spark, d, "events")).select("user_id", F.col("start"), "event_type", "n", F.round("total", 4).alias("total"))


_WORDS = ", ".join(
    f"list_sum([CASE WHEN embedding[1 + (((32 * {w} + k) // 16) * 17 + (32 * {w} + k) % 16 + 1) % 64] > embedding[1 + (((32 * {w} + k) // 16) * 17 + (32 * {w} + k) % 16) % 64] THEN 1::BIGINT << (31 - k) ELSE 0::BIGINT END FOR k IN range(32)])::BIGINT AS w{w}"
    for w in range(8)
)
_IMAGES = "SELECT vec_id, embedding, label FROM embeddings UNION ALL SELECT vec_id + 1000000, list_concat([-embedding[1]], embedding[2:]), label FROM embeddings WHERE vec_id % 20 = 0"
_FAR = " + ".join(f"bit_count(xor(a.w{w}, b.w{w}))::INT" for w in range(8))


def _images(spark: SparkSession, d: str) -> DataFrame:
    """Vectors that stand for 17 x 16 grey images, and near copies of some."""
    e = t.read(spark, d, "embeddings").select("vec_id", "embedding", "label")
    copy = F.concat(F.array(-F.get("embedding", F.lit(0))), F.slice("embedding", F.lit(2), F.size("embedding")))
    return e.unionByName(e.where("vec_id % 20 = 0").select((F.col("vec_id") + 1_000_000).alias("vec_id"), copy.alias("embedding"), "label"))


def _gradient_hash(spark: SparkSession, d: str) -> DataFrame:
    return graph.gradient_hash(_images(spark, d), "embedding")


@query(f"SELECT vec_id, {_WORDS} FROM ({_IMAGES})")
def gr_dhash(spark, d):
    """256 bits: whether a pixel is brighter than the one before it in its row."""
    return _gradient_hash(spark, d).select("vec_id", *graph.words())


@query(f"WITH h AS (SELECT vec_id, {_WORDS} FROM ({_IMAGES})) SELECT a.vec_id AS a, b.vec_id AS b, ({_FAR})::INT AS bits FROM h a JOIN h b ON a.vec_id < b.vec_id AND {_FAR} <= 16")
def jn_hamming(spark, d):
    return graph.near_hashes(_gradient_hash(spark, d), "vec_id", 16)


_NUMBER = "[0-9]+(?:[.,][0-9]+)?"


@query(f"SELECT doc_id, len(m)::INT AS numbers, coalesce(list_bool_and([abs(x - n_chars) <= greatest(0.6, 0.005 * abs(n_chars)) OR abs(x - 90) <= 0.6 OR abs(x - 100) <= 0.6 OR abs(x - 30) <= 0.6 OR abs(x - 6) <= 0.6 OR abs(x - 12) <= 0.6 OR abs(x - 250) <= 1.25 OR abs(x - 3) <= 0.6 FOR x IN m]), true) AS faithful FROM (SELECT doc_id, n_chars, [replace(v, ',', '.')::DOUBLE FOR v IN regexp_extract_all(text, '{_NUMBER}')] AS m FROM documents)")
def txt_faithful(spark, d):
    """Whether every number of a text is near its fact or a rule's constant."""
    values = F.transform(F.regexp_extract_all("text", F.lit(_NUMBER), 0), lambda v: F.replace(v, F.lit(","), F.lit(".")).cast("double"))
    facts = F.array(F.col("n_chars").cast("double"), *[F.lit(float(v)) for v in (90, 100, 30, 6, 12, 250, 3)])
    near = lambda v: F.exists(facts, lambda f: F.abs(v - f) <= F.greatest(F.lit(0.6), 0.005 * F.abs(f)))
    return t.read(spark, d, "documents").select("doc_id", F.size(values).alias("numbers"), F.forall(values, near).alias("faithful"))


@query("SELECT segment_id, substr(sha1(string_agg(image_id::VARCHAR, '' ORDER BY image_id::VARCHAR)), 1, 12) AS digest, 'VIA-' || substr(sha1(segment_id::VARCHAR), 1, 12) AS via FROM frames GROUP BY segment_id", "frames")
def agg_sorted_hash(spark, d):
    names = F.concat_ws("", F.array_sort(F.collect_list(F.col("image_id").cast("string"))))
    return t.frames(spark, d).groupBy("segment_id").agg(F.substring(F.sha1(names), 1, 12).alias("digest")).withColumn("via", F.concat(F.lit("VIA-"), F.substring(F.sha1(F.col("segment_id").cast("string")), 1, 12)))


@query("WITH s AS (SELECT c_custkey, " + _STATE.format("(c_acctbal / 100)") + " AS state, CASE WHEN c_custkey % 4 > 0 THEN (c_custkey % 110) / 10.0 END AS depth, (c_custkey % 9) / 10.0 AS conf FROM customer) SELECT c_custkey, state, CASE WHEN depth IS NULL THEN NULL WHEN depth < 2.5 THEN 'L' WHEN depth < 5 THEN 'M' ELSE 'H' END AS severity, CASE WHEN state IN ('malo', 'muy_malo') OR coalesce(depth, -1) >= 8 OR conf >= 0.5 THEN 'intervencion' WHEN state = 'regular' OR coalesce(depth, -1) >= 3 THEN 'mantenimiento' ELSE 'prevencion' END AS label FROM s")
def prj_label_rules(spark, d):
    s = t.read(spark, d, "customer").select("c_custkey", x.state(F.col("c_acctbal") / 100).alias("state"), F.when(F.col("c_custkey") % 4 > 0, F.col("c_custkey") % 110 / 10.0).alias("depth"), (F.col("c_custkey") % 9 / 10.0).alias("conf"))
    deep = F.coalesce("depth", F.lit(float("-inf")))
    severity = F.when(F.col("depth").isNull(), None).when(F.col("depth") < 2.5, "L").when(F.col("depth") < 5, "M").otherwise("H")
    label = F.when(F.col("state").isin("malo", "muy_malo") | (deep >= 8) | (F.col("conf") >= 0.5), "intervencion").when((F.col("state") == "regular") | (deep >= 3), "mantenimiento").otherwise("prevencion")
    return s.select("c_custkey", "state", severity.alias("severity"), label.alias("label"))


@query("SELECT o_custkey, round(stddev_samp(o_totalprice), 4) AS sd, round(max(o_totalprice) - min(o_totalprice), 4) AS spread, count(DISTINCT o_orderpriority) = 1 AS agree, count(*) AS n FROM orders GROUP BY o_custkey")
def fld_repeat(spark, d):
    price = F.col("o_totalprice")
    return t.read(spark, d, "orders").groupBy("o_custkey").agg(F.round(F.stddev_samp(price), 4).alias("sd"), F.round(F.max(price) - F.min(price), 4).alias("spread"), (F.count_distinct("o_orderpriority") == 1).alias("agree"), F.count(F.lit(1)).alias("n"))


@query("SELECT bool_and(cx BETWEEN 0 AND 1 AND cy BETWEEN 0 AND 1) AS centres, bool_and(w > 0 AND h > 0) AS sizes, bool_and(cls IN ('D00', 'D10', 'D20', 'D40')) AS classes, count(*) FILTER (conf IS NULL) = 0 AS complete, count(DISTINCT image_id) AS images FROM boxes", "boxes")
def dq_validate(spark, d):
    inside = F.col("cx").between(0, 1) & F.col("cy").between(0, 1)
    return t.all_boxes(spark, d).agg(F.bool_and(inside).alias("centres"), F.bool_and((F.col("w") > 0) & (F.col("h") > 0)).alias("sizes"), F.bool_and(F.col("cls").isin(*c.CLASSES)).alias("classes"), (F.count_if(F.col("conf").isNull()) == 0).alias("complete"), F.count_distinct("image_id").alias("images"))


@query("WITH s AS (SELECT p_partkey, CASE WHEN p_size % 5 > 0 THEN ln(1 + p_retailprice) END AS v FROM part), f AS (SELECT p_partkey, coalesce(v, (SELECT median(v) FROM s)) AS v FROM s) SELECT p_partkey, round(least(greatest((v - avg(v) OVER ()) / stddev_samp(v) OVER (), -8), 8), 6) AS z FROM f")
def ml_preproc(spark, d):
    """log1p, median for missing, z-scores (ddof 1) clipped at 8: one row of statistics, then a projection."""
    s = t.read(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 5 > 0, F.log1p("p_retailprice")).alias("v"))
    filled = s.crossJoin(F.broadcast(sampling.quantiles(s, "v", {"m": 0.5}))).select("p_partkey", F.coalesce("v", "m").alias("v"))  # one row
    stats = filled.agg(F.avg("v").alias("mu"), F.stddev_samp("v").alias("sd"))
    z = (F.col("v") - F.col("mu")) / F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd"))
    return filled.crossJoin(F.broadcast(stats)).select("p_partkey", F.round(F.least(F.greatest(z, F.lit(-8.0)), F.lit(8.0)), 6).alias("z"))  # one row


@query(f"WITH {_YP} SELECT round(avg((y BETWEEN p - 30 AND p + 25)::INT), 6) AS coverage, round(avg(55.0), 6) AS width, round(quantile_cont(abs(y - p), 0.9), 5) AS q90 FROM yp")
def ev_coverage(spark, d):
    hit = F.col("y").between(F.col("p") - 30, F.col("p") + 25).cast("double")
    yp = _yp(spark, d)
    q90 = sampling.quantiles(yp.select(F.abs(F.col("y") - F.col("p")).alias("e")), "e", {"q90": 0.9})
    return yp.agg(r6(F.avg(hit), "coverage"), r6(F.avg(F.lit(55.0)), "width")).crossJoin(q90.select(F.round("q90", 5).alias("q90")))  # one row each


@query("SELECT o_orderkey AS run_id, o_orderstatus AS status FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, 'new' FROM orders WHERE o_orderkey % 6 = 0")
def snk_upsert(spark, d):
    """History with the rows of new runs in place of old ones: anti join and union."""
    old = t.read(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status"))
    gone, new = old.where("run_id % 3 = 0").select("run_id"), old.where("run_id % 6 = 0").select("run_id", F.lit("new").alias("status"))
    return old.join(gone, "run_id", "left_anti").unionByName(new)


@query(f"+cells AS ({_RASTER.format('boxes')}) SELECT image_id, cls, round(count(*) / 4096.0, 6) AS area FROM cells GROUP BY image_id, cls", "boxes")
def vis_union_area(spark, d):
    """Share of a 64 x 64 raster that the boxes of a class cover."""
    return vision.covered(t.all_boxes(spark, d)).select("image_id", "cls", r6("area"))
