"""Field queries: from filtered boxes, depth and positions to stretches, sites, labels and quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as c
from ..functions import exprs as x
from ..operators import boxes as bx
from ..operators import calibration, domain, field, pavement, quality, sampling, study, tracks
from ..session import cut
from ..sources import tables as t
from . import deliveries
from . import queries as q
from .study import _drawn
from .queries import ORACLES, _CUTS, _DEPTH, _DIST, _DOMINANT, _DV, _EARLY, _KAPPA, _KEY, _PCI, _RASTER, _STATE, _TAU, _iou, n6, query

K = c.CLASSES
each = lambda f, sep=", ": sep.join(f(k) for k in K)

_SITE = "CASE WHEN segment_id % 4 > 0 THEN segment_id % 25 END"
_SEVERITY = "CASE WHEN {0} IS NULL OR {0} < 0 THEN NULL WHEN {0} < 2.5 THEN 'L' WHEN {0} < 5 THEN 'M' ELSE 'H' END"
_FRAMES = (
    f"fr0 AS (SELECT *, segment_id % 150 AS user_id, {_SITE} AS site, chain_pos::DOUBLE / greatest(max(chain_pos) OVER (PARTITION BY segment_id), 1) AS t_norm FROM frames), "
    f"{_DEPTH}, fd AS (SELECT f.image_id, max(x.depth) AS depth FROM fr0 f LEFT JOIN x ON x.user_id = f.user_id AND abs(x.t_norm - f.t_norm) <= 0.03 GROUP BY f.image_id)"
)
_JUDGED = (
    f"{_EARLY}, k AS (SELECT * FROM e WHERE early IS NULL), "
    "ok AS (SELECT DISTINCT a.segment_id, a.cls, a.chain_pos, a.cx, a.cy, a.w, a.h FROM k a JOIN k b ON a.segment_id = b.segment_id AND a.cls = b.cls "
    f"AND abs(a.chain_pos - b.chain_pos) BETWEEN 1 AND 2 AND greatest({_iou('a', 'b')}, {_iou('a', 'b', 0.15)}, {_iou('a', 'b', -0.15)}) >= 0.3), "
    f"ju AS (SELECT {_KEY}, coalesce(early, CASE WHEN ok.cls IS NULL THEN '3_sin_persistencia' END, '') AS reason FROM e LEFT JOIN ok USING (segment_id, cls, chain_pos, cx, cy, w, h))"
)
_TABLE = (
    f"{_FRAMES}, {_JUDGED}, {_CUTS}, kb AS (SELECT * FROM ju WHERE reason = ''), "
    f"kd AS (SELECT kb.*, fd.depth, {q._SIZE} AS size, {q._DENSITY} AS density FROM kb LEFT JOIN fd USING (image_id)), "
    f"kr AS (SELECT kd.*, density * CASE WHEN cls = 'D40' AND depth >= 0 THEN CASE WHEN depth < 2.5 THEN 0.33 WHEN depth < 5 THEN 1.0 ELSE 3.0 END ELSE {_KAPPA} END AS rho FROM kd LEFT JOIN cuts USING (cls)), "
    f"b4 AS (SELECT image_id, count(*) FILTER (conf >= {_TAU}) AS n_tau, avg(conf) FILTER (conf >= {_TAU}) AS conf_tau, {each(lambda k: f'count(*) FILTER (cls = {chr(39)}{k}{chr(39)} AND conf >= 0.25) AS n25_{k}')} FROM boxes GROUP BY image_id), "
    f"ks AS (SELECT image_id, {each(lambda k: f'count(*) FILTER (cls = {chr(39)}{k}{chr(39)}) AS n_{k}, max(conf) FILTER (cls = {chr(39)}{k}{chr(39)}) AS conf_{k}, sum(rho) FILTER (cls = {chr(39)}{k}{chr(39)}) AS rho_{k}')}, max(conf) AS max_conf FROM kr GROUP BY image_id), "
    f"kc AS ({_RASTER.format('kb')}), ka AS (SELECT image_id, count(DISTINCT x * 64 + y) / 4096.0 AS area FROM kc GROUP BY image_id), "
    f"ft AS (SELECT f.*, coalesce(n_tau, 0) AS n_tau, conf_tau, {each(lambda k: f'coalesce(n25_{k}, 0) AS n25_{k}, coalesce(n_{k}, 0) AS n_{k}, coalesce(conf_{k}, 0) AS conf_{k}, coalesce(rho_{k}, 0) AS rho_{k}')}, coalesce(max_conf, 0) AS max_conf, coalesce(area, 0) AS area, depth "
    "FROM fr0 f LEFT JOIN b4 USING (image_id) LEFT JOIN ks USING (image_id) LEFT JOIN ka USING (image_id) LEFT JOIN fd USING (image_id))"
)
_LEVELS = (
    f"{_TABLE}, lv AS (SELECT 'tramo' AS level, segment_id || '-' || (chain_pos // 5) AS id, * FROM ft "
    "UNION ALL SELECT CASE WHEN site IS NULL THEN 'prueba' ELSE 'sitio' END, coalesce(site, segment_id)::VARCHAR, * FROM ft)"
)
_BY_LEVEL = (
    f"{_LEVELS}, al AS (SELECT level, id, level <> 'tramo' OR (min(t_norm) <= 0 AND max(t_norm) >= 1) AS whole, max(depth) AS a_max, avg(depth) AS a_mean, avg((depth >= 3)::INT) AS a_deep FROM lv GROUP BY level, id), "
    "s1 AS (SELECT user_id, max(depth) AS s_max, sum(depth) AS s_sum, count(depth) AS s_n, count(*) FILTER (depth >= 3) AS s_deep, count(*) AS s_all FROM x GROUP BY user_id), "
    "s2 AS (SELECT level, id, max(s_max) AS s_max, sum(s_sum) AS s_sum, sum(s_n) AS s_n, sum(s_deep) AS s_deep, sum(s_all) AS s_all FROM (SELECT DISTINCT level, id, user_id FROM lv) JOIN s1 USING (user_id) GROUP BY level, id), "
    "dl AS (SELECT level, id, CASE WHEN whole THEN s_max ELSE a_max END AS depth_max, CASE WHEN whole THEN s_sum / nullif(s_n, 0) ELSE a_mean END AS depth_mean, CASE WHEN whole THEN s_deep / nullif(s_n, 0) ELSE a_deep END AS depth_deep, "
    "CASE WHEN s_all IS NULL THEN 'sin_sensor' WHEN whole THEN CASE WHEN s_n > 0 THEN 'ultrasonico_prueba_completa' ELSE 'sin_lecturas_validas' END WHEN a_max IS NOT NULL THEN 'ultrasonico_alineado_tiempo_normalizado' WHEN s_n = 0 THEN 'sin_lecturas_validas' ELSE 'sin_sensor' END AS depth_source, "
    "coalesce(s_n, 0) AS readings_valid, coalesce(s_all, 0) AS readings FROM al LEFT JOIN s2 USING (level, id))"
)


def _field_frames(spark: SparkSession, d: str) -> DataFrame:
    seg = F.col("segment_id")
    return t.frames(spark, d).withColumn("user_id", seg % 150).withColumn("site", F.when(seg % 4 > 0, seg % 25))


def _readings(spark: SparkSession, d: str) -> DataFrame:
    return tracks.depths(t.track(spark, d))


def _table(spark: SparkSession, d: str) -> DataFrame:
    frames = _field_frames(spark, d)
    return field.timed(field.frame_table(t.all_boxes(spark, d), frames, pavement.cutoffs(q._detections(spark, d)), field.frame_depth(frames, _readings(spark, d))))


_R = lambda k: f"round({k} + 1e-9, 6) AS {k}"


@query(f"+{_FRAMES} SELECT image_id, depth, {_SEVERITY.format('depth')} AS severity FROM fd", "track", "frames")
def fld_frame_depth(spark, d):
    """The deepest reading beside each frame and its severity."""
    return field.frame_depth(_field_frames(spark, d), _readings(spark, d)).select("image_id", "depth", field.severity(F.col("depth")).alias("severity"))


@query(f"+{_TABLE} SELECT image_id, cls, l_partkey, l_suppkey, l_linenumber, round(rho + 1e-9, 6) AS rho FROM kr", "boxes", "frames", "track")
def fld_astm_weight(spark, d):
    """Weighted density of kept boxes; measured depth stands in for size on potholes."""
    frames, boxes = _field_frames(spark, d), t.all_boxes(spark, d)
    kept = bx.filtered(boxes, frames).where("reason = ''")
    out = field.weights(kept, pavement.cutoffs(q._detections(spark, d)), field.frame_depth(frames, _readings(spark, d)))
    return out.select("image_id", "cls", "l_partkey", "l_suppkey", "l_linenumber", n6("rho"))


@query(f"+{_TABLE}, dv AS (SELECT *, {_DV} FROM ft) SELECT image_id, n_tau, round(conf_tau + 1e-9, 6) AS conf_tau, {each(lambda k: f'n25_{k}, n_{k}, conf_{k}, round(rho_{k} + 1e-9, 6) AS rho_{k}')}, max_conf, {_R('area')}, depth, {_SEVERITY.format('depth')} AS severity, round({_PCI} + 1e-9, 6) AS pci FROM dv", "boxes", "frames", "track")
def fld_frame_table(spark, d):
    """Each frame before and after the field filters."""
    out = _table(spark, d)
    return out.select("image_id", "n_tau", n6("conf_tau"), *[e for k in K for e in (F.col(f"n25_{k}"), F.col(f"n_{k}"), F.col(f"conf_{k}"), n6(f"rho_{k}"))], "max_conf", n6("area"), "depth", "severity", n6("pci_vis", "pci"))


@query(f"+{_BY_LEVEL} SELECT level, id, depth_max, {_R('depth_mean')}, {_R('depth_deep')}, depth_source, readings_valid::BIGINT AS readings_valid, readings::BIGINT AS readings FROM dl", "boxes", "frames", "track")
def fld_depth_assoc(spark, d):
    """Depth of stretches, sites and runs, from whole series or beside the frames."""
    out = field.depth_by_level(field.levels(_table(spark, d)), _readings(spark, d))
    return out.select("level", "id", "depth_max", n6("depth_mean"), n6("depth_deep"), "depth_source", "readings_valid", "readings")


@query(f"+{_LEVELS} SELECT level, id, count(*) AS n FROM lv GROUP BY level, id", "boxes", "frames", "track")
def fld_agg_level(spark, d):
    """Frames by stretch, and by site where all photos of a run declare one, else by run."""
    return field.levels(_table(spark, d)).groupBy("level", "id").agg(F.count(F.lit(1)).alias("n"))


_VIAS = (
    f"{_BY_LEVEL}, vs AS (SELECT level, id, count(*) AS n_frames, {each(lambda k: f'avg(rho_{k}) AS rho_{k}, sum(n_{k})::BIGINT AS n_{k}, avg((n_{k} > 0)::INT) AS share_{k}, max(conf_{k}) AS conf_{k}, avg(conf_{k}) FILTER (conf_{k} > 0) AS sure_{k}')}, "
    f"100 * avg(area) AS area_pct, max(max_conf) AS max_conf, avg(({each(lambda k: f'n_{k}', ' + ')} > 0)::INT) AS share_any FROM lv GROUP BY level, id), "
    f"dv AS (SELECT *, {_DV} FROM vs), p AS (SELECT *, {_PCI} AS pci, {_DOMINANT} AS dominant FROM dv), st AS (SELECT *, {_STATE.format('pci')} AS state FROM p), "
    f"vi AS (SELECT *, concat_ws(';', {each(lambda k: f'CASE WHEN share_{k} >= 0.2 THEN {chr(39)}{k}{chr(39)} END')}) AS damages FROM st LEFT JOIN dl USING (level, id))"
)
_LABEL = "CASE WHEN state IN ('malo', 'muy_malo') OR coalesce(depth_max, -1) >= 8 OR conf_D40 >= 0.5 THEN 'intervencion' WHEN state = 'regular' OR coalesce(depth_max, -1) >= 3 THEN 'mantenimiento' ELSE 'prevencion' END"
_ACTION = "CASE state WHEN 'bueno' THEN 'mantenimiento_rutinario' WHEN 'satisfactorio' THEN 'sellado_de_fisuras' WHEN 'regular' THEN CASE dominant WHEN 'D40' THEN 'bacheo' WHEN 'D20' THEN 'parcheo' ELSE 'sellado_de_fisuras' END WHEN 'malo' THEN CASE dominant WHEN 'D40' THEN 'bacheo' WHEN 'D20' THEN 'rehabilitacion' ELSE 'parcheo' END ELSE CASE dominant WHEN 'D20' THEN 'reconstruccion' ELSE 'rehabilitacion' END END"
_OUT = ["area_pct", "share_any", "depth_mean", "depth_deep", *[f"share_{k}" for k in K]]


@query(
    f"+{_VIAS} SELECT level, id, n_frames, round(pci + 1e-9, 6) AS score, state, CASE WHEN pci >= 90 THEN 'bueno' WHEN pci >= 56 THEN 'regular' ELSE 'malo' END AS city_state, dominant, damages, {_LABEL} AS label, {_ACTION} AS action, "
    f"{each(lambda k: f'n_{k}, conf_{k}, round(100 - dv_{k} + 1e-9, 6) AS sub_{k}')}, {', '.join(map(_R, _OUT))}, max_conf, round(CASE dominant {each(lambda k: f'WHEN {chr(39)}{k}{chr(39)} THEN sure_{k}', ' ')} END + 1e-9, 6) AS confidence, "
    f"depth_max, depth_source, readings_valid::BIGINT AS readings_valid, readings::BIGINT AS readings, {_SEVERITY.format('depth_max')} AS severity FROM vi",
    "boxes", "frames", "track",
)
def fld_via_table(spark, d):
    """The labelled rows of stretches, sites and runs."""
    out = field.via_table(field.levels(_table(spark, d)), _readings(spark, d))
    rounded = {"score", "confidence", *_OUT, *[f"sub_{k}" for k in K]}
    return out.select(*[n6(k) if k in rounded else F.col(k) for k in out.columns])


# ---- stretches, photos without positions, filter summaries, quality

_FIXES = f"{_DIST}, cu AS (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY floor(dist_m / 2000)) - 1 AS dense FROM c), cm AS (SELECT *, max(dense) OVER (PARTITION BY user_id) AS last, count(*) OVER (PARTITION BY user_id, dense) AS m FROM cu), fx AS (SELECT *, CASE WHEN dense = last AND m < 5 AND last > 0 THEN dense - 1 ELSE dense END::INT AS stretch, event_id % 20 AS sat FROM cm)"


@query(
    f"+{_FIXES}, g AS (SELECT user_id, stretch, count(*) AS n, avg(lat) AS lat, avg(lon) AS lon, arg_min(lat, (us, event_id)) AS lat_from, arg_max(lon, (us, event_id)) AS lon_to, max(dist_m) - min(dist_m) AS length_m, "
    "strftime(make_timestamp(min(us)), '%H:%M:%S') AS from_time, strftime(make_timestamp(max(us)), '%H:%M:%S') AS to_time, max(CASE WHEN sat >= 12 THEN 5.0 ELSE 10.0 END)::DOUBLE AS uncertainty_m, "
    "substr(sha1(string_agg(sha1(event_id::VARCHAR), '' ORDER BY sha1(event_id::VARCHAR))), 1, 12) AS digest FROM fx GROUP BY user_id, stretch) "
    f"SELECT user_id, stretch, n, round(lat + 1e-9, 6) AS lat, round(lat_from + 1e-9, 6) AS lat_from, round(lon_to - 1e-9, 6) AS lon_to, round(length_m, 3) AS length_m, from_time, to_time, uncertainty_m, digest, 'VIA-' || substr(sha1(user_id || '|' || stretch), 1, 12) AS via, 'PRU-' || substr(sha1(user_id::VARCHAR), 1, 8) AS run_id, {q._geohash_sql(7)} AS geohash7 FROM g",
    "track",
)
def fld_tramos(spark, d):
    """Stretches of each run: ends, length, times, uncertainty, digest and ids."""
    fixes = tracks.stretches(tracks.cumulative(t.track(spark, d)), 2000.0, 5).withColumn("sat", F.col("event_id") % 20)
    out = field.stretch_rows(fixes.withColumn("stretch", F.col("stretch").cast("int")))
    return out.select("user_id", "stretch", "n", n6("lat"), n6("lat_from"), F.round(F.col("lon_to") - 1e-9, 6).alias("lon_to"), F.round("length_m", 3).alias("length_m"), "from_time", "to_time", "uncertainty_m", "digest", "via", "run_id", "geohash7")


@query("SELECT event_id, CASE WHEN event_id % 20 >= 12 THEN 5.0 ELSE 10.0 END::DOUBLE AS uncertainty_m FROM events")
def fld_uncertainty(spark, d):
    return t.read(spark, d, "events").select("event_id", field.uncertainty(F.col("event_id") % 20).alias("uncertainty_m"))


@query(
    "WITH n AS (SELECT o_custkey AS run, o_orderkey, (o_orderkey * 7919) % 86400 AS sec, o_orderkey % 3 AS suffix FROM orders), "
    "w AS (SELECT *, 'WhatsApp Image 2024-03-05 at ' || CASE WHEN (sec // 3600) % 12 = 0 THEN 12 ELSE (sec // 3600) % 12 END || '.' || printf('%02d', (sec // 60 % 60)::INT) || '.' || printf('%02d', (sec % 60)::INT) || CASE WHEN sec >= 43200 THEN ' PM' ELSE ' AM' END || CASE WHEN suffix > 0 THEN ' (' || suffix || ')' ELSE '' END || '.jpeg' AS name FROM n), "
    "p AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY sec, suffix, name) - 1 AS place, count(*) OVER (PARTITION BY run) AS m FROM w) "
    "SELECT run, name, place, 1709596800000000 + sec * 1000000 + place * 1000 AS us, round(place / greatest(m - 1, 1), 6) AS t_norm FROM p"
)
def fld_no_gps(spark, d):
    """Photos without positions, ordered by the time and suffix in their names."""
    o = t.read(spark, d, "orders").select(F.col("o_custkey").alias("run"), (F.col("o_orderkey") * 7919 % 86400).alias("sec"), (F.col("o_orderkey") % 3).alias("suffix"))
    hour = F.expr("sec div 3600 % 12")
    name = F.concat(F.lit("WhatsApp Image 2024-03-05 at "), F.when(hour == 0, 12).otherwise(hour).cast("string"), F.date_format(F.timestamp_seconds("sec"), ".mm.ss"), F.when(F.col("sec") >= 43200, " PM").otherwise(" AM"), F.when(F.col("suffix") > 0, F.concat(F.lit(" ("), F.col("suffix").cast("string"), F.lit(")"))).otherwise(""), F.lit(".jpeg"))
    return field.shared_names(o.select("run", name.alias("name"))).withColumn("place", F.col("place").cast("long")).withColumn("t_norm", F.round("t_norm", 6))


_REASONS = ("", "1_confianza", "2_banda", "2_fuera_de_via", "3_sin_persistencia")
_SUMMARY = ", ".join(f"count(*) FILTER (reason = '{r}') AS \"{r or 'conservada'}\"" for r in _REASONS)


@query(f"+{_JUDGED} SELECT cls, {_SUMMARY} FROM ju GROUP BY cls", "boxes", "frames")
def fld_outputs(spark, d):
    """Boxes of each class by the reason that discards them: the summary beside the deliverable."""
    judged = bx.filtered(t.all_boxes(spark, d), t.frames(spark, d))
    return judged.groupBy("cls").agg(*[F.count_if(F.col("reason") == r).alias(r or "conservada") for r in _REASONS])


@query(
    f"+{_JUDGED}, pr AS (SELECT cls, image_id, max((reason = '')::INT) AS said, max((flag = 'R')::INT) AS truly FROM ju JOIN (SELECT image_id, cls, l_partkey, l_suppkey, l_linenumber, flag FROM boxes) USING (image_id, cls, l_partkey, l_suppkey, l_linenumber) GROUP BY cls, image_id) "
    "SELECT cls, sum(said * truly)::BIGINT AS tp, sum(said * (1 - truly))::BIGINT AS fp, sum((1 - said) * truly)::BIGINT AS fn, round(sum(said * truly) / greatest(sum(said), 1), 6) AS precision, round(sum(said * truly) / greatest(sum(truly), 1), 6) AS recall FROM pr GROUP BY cls",
    "boxes", "frames",
)
def fld_visual_pr(spark, d):
    """Presence by photo and class against reviewed truth."""
    boxes = t.all_boxes(spark, d)
    flags = boxes.select("image_id", "cls", "l_partkey", "l_suppkey", "l_linenumber", "flag")
    judged = bx.filtered(boxes, t.frames(spark, d)).join(flags, ["image_id", "cls", "l_partkey", "l_suppkey", "l_linenumber"])
    pr = judged.groupBy("cls", "image_id").agg(F.max((F.col("reason") == "").cast("int")).alias("said"), F.max((F.col("flag") == "R").cast("int")).alias("truly"))
    s, y = F.col("said"), F.col("truly")
    return pr.groupBy("cls").agg(F.sum(s * y).alias("tp"), F.sum(s * (1 - y)).alias("fp"), F.sum((1 - s) * y).alias("fn"), F.round(F.sum(s * y) / F.greatest(F.sum(s), F.lit(1)), 6).alias("precision"), F.round(F.sum(s * y) / F.greatest(F.sum(y), F.lit(1)), 6).alias("recall"))


# the seven blocks of quality: photos of segments 13 to 18 of each twenty are the reference

_REFERENCE = "segment_id % 20 BETWEEN 13 AND 18"
_PHOTO = {"brillo": (7919, 1000, 4, 0), "contraste": (104729, 700, 10, 0), "nitidez": (31, 5003, 10, 0), "jpeg_kb": (17, 1601, 10, 40)}
q6 = lambda e: f"round({e} + 1e-9, 6)"
_DRIFT = {**{k: k for k in _PHOTO}, "max_conf": "raw_max", "pci_det": "pci_det", **{f"n_{k}": f"raw_n_{k}" for k in K}}
_KEPT = each(lambda k: f"n_{k}", " + ")
_BY_GROUP = {
    "calidad_imagen": {**{f"{k}_media": f"avg({k})" for k in _PHOTO}, **{f"frac_fotos_{k}": f"avg(cast({k} AS INT))" for k in ("borrosa", "oscura", "sobreexpuesta")}},
    "confianza_modelo": {
        "n_cajas_tau": "avg(n_tau)", "conf_media_tau": "avg(conf_tau)", "max_conf_media": "avg(max_conf)", "area_media": "avg(area)", "frac_con_deteccion": f"avg(cast({_KEPT} > 0 AS INT))",
        "max_conf_sin_filtros_media": "avg(raw_max)", "max_conf_sin_filtros_max": "max(raw_max)", "frac_con_deteccion_tau": "avg(cast(n_tau > 0 AS INT))",
        "frac_con_deteccion_conf25": f"avg(cast({each(lambda k: f'n25_{k}', ' + ')} > 0 AS INT))", "n_cajas_campo": f"avg({_KEPT})", "conf_media_campo": "avg(CASE WHEN max_conf > 0 THEN max_conf END)",
    },
}
_PAIRS = {"depth_max__n_D40": ("depth_max", "n_D40"), "depth_max__conf_D40": ("depth_max", "conf_D40"), "depth_mean__n_D40": ("depth_mean", "n_D40"), "depth_deep__share_D40": ("depth_deep", "share_D40"), "depth_max__score": ("depth_max", "score"), "depth_max__n_D00": ("depth_max", "n_D00"), "depth_max_base40__n_D40": ("depth_max_base40", "n_D40")}
#: The same with the side of few values last, as resamples are numbered.
_TURNED, _REPS = {k: (a, b) if a in ("depth_mean", "depth_deep") else (b, a) for k, (a, b) in _PAIRS.items()}, 2000
_GROUP_PAIRS = {k: _PAIRS.get(k, ("depth_mean", "score")) for k in ("depth_max__n_D40", "depth_mean__score")}
_PHOTO_PAIRS = {f"spearman_foto_depth__{k}": ("depth", v) for k, v in {"conf_campo_D40": "conf_D40", "n_campo_D40": "n_D40", "conf_D40": "raw_conf_D40", "conf_D00": "raw_conf_D00"}.items()}
_REPEATED, _LABELS = ["score", "score_tau", "depth_max", "depth_mean"], {"etiqueta_coincide": "label", "etiqueta_coincide_tau": "label_tau"}
_SAID = {"tau": "raw_n", "campo": "n"}
_REVIEWED = {f"{name}_{mode}": (" + ".join(f"{p}_{k}" for k in of), " + ".join(f"true_{k}" for k in of)) for mode, p in _SAID.items() for name, of in {"piel_cocodrilo": ["D20"], "bache": ["D40"], "cualquier_dano": K}.items()}
_PATCH = "image_id % 11 = 0"

_melt = lambda names: "unnest([" + ", ".join(f"{{'metric': '{k}', 'a': ({a})::DOUBLE, 'b': ({b})::DOUBLE}}" for k, (a, b) in names.items()) + "]) AS u"
_ranks = lambda table, keys: f"SELECT {keys}, a, b, rank() OVER (PARTITION BY {keys} ORDER BY a) + (count(*) OVER (PARTITION BY {keys}, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY {keys} ORDER BY b) + (count(*) OVER (PARTITION BY {keys}, b) - 1) / 2.0 AS rb FROM {table} WHERE a IS NOT NULL AND b IS NOT NULL"
_rho = lambda a, b: f"CASE WHEN min({a}) < max({a}) AND min({b}) < max({b}) THEN corr({a}, {b}) END"
_FACTS = (
    f"{_VIAS}, rx AS (SELECT image_id, max(conf) AS raw_max, {each(lambda k: f'max(conf) FILTER (cls = {chr(39)}{k}{chr(39)}) AS raw_conf_{k}, count(*) FILTER (cls = {chr(39)}{k}{chr(39)} AND conf >= {_TAU}) AS raw_n_{k}, coalesce(sum(density * {_KAPPA}) FILTER (cls = {chr(39)}{k}{chr(39)} AND conf >= {_TAU}), 0) AS raw_rho_{k}, max((cls = {chr(39)}{k}{chr(39)} AND flag = {chr(39)}R{chr(39)})::INT) AS true_{k}')} "
    f"FROM (SELECT b.*, {q._SIZE} AS size, {q._DENSITY} AS density FROM boxes b) LEFT JOIN cuts USING (cls) GROUP BY image_id), "
    "f4 AS (SELECT f.image_id, max(x.cm - 40) AS d40 FROM fr0 f LEFT JOIN x ON x.user_id = f.user_id AND abs(x.t_norm - f.t_norm) <= 0.03 GROUP BY f.image_id), "
    f"q0 AS (SELECT ft.*, d40, {', '.join(f'{plus} + (image_id * {a} % {m})::DOUBLE / {by} AS {k}' for k, (a, m, by, plus) in _PHOTO.items())}, coalesce(raw_max, 0) AS raw_max, {each(lambda k: f'coalesce(raw_conf_{k}, 0) AS raw_conf_{k}, coalesce(raw_n_{k}, 0) AS raw_n_{k}, coalesce(raw_rho_{k}, 0) AS raw_rho_{k}, coalesce(true_{k}, 0) AS true_{k}')} FROM ft LEFT JOIN rx USING (image_id) LEFT JOIN f4 USING (image_id)), "
    f"q1 AS (SELECT *, {q6(q._pci_of('raw_rho'))} AS pci_det FROM q0), qc AS (SELECT quantile_cont(nitidez, 0.05) AS sharp, quantile_cont(brillo, 0.02) AS dark, quantile_cont(brillo, 0.98) AS bright FROM q1 WHERE {_REFERENCE}), "
    "qf AS (SELECT q1.*, nitidez < sharp AS borrosa, brillo < dark AS oscura, brillo > bright AS sobreexpuesta FROM q1, qc), "
    "lq AS (SELECT 'tramo' AS level, segment_id || '-' || (chain_pos // 5) AS id, * FROM qf UNION ALL SELECT CASE WHEN site IS NULL THEN 'prueba' ELSE 'sitio' END, coalesce(site, segment_id)::VARCHAR, * FROM qf), "
    f"wq AS (SELECT level, id, count(*) AS n, {', '.join(f'{e} AS {k}' for m in _BY_GROUP.values() for k, e in m.items())} FROM lq GROUP BY level, id), "
    f"tq AS (SELECT level, id, min(t_norm) <= 0 AND max(t_norm) >= 1 AS spans, min(user_id) AS user_id, max(d40) AS d40, max(raw_conf_D40) AS top_D40, {each(lambda k: f'avg(raw_rho_{k}) AS raw_rho_{k}')} FROM lq WHERE level = 'tramo' GROUP BY level, id), "
    f"t1 AS (SELECT tq.* EXCLUDE (user_id), m40, {q6(q._pci_of('raw_rho'))} AS score_tau FROM tq LEFT JOIN (SELECT user_id, max(cm - 40) AS m40 FROM x GROUP BY user_id) USING (user_id)), "
    f"vj AS (SELECT level, id, n_D00, n_D40, conf_D40, {q6('share_D40')} AS share_D40, {q6('pci')} AS score, state, depth_max, {q6('depth_mean')} AS depth_mean, {q6('depth_deep')} AS depth_deep FROM vi), "
    f"vk AS (SELECT vj.*, CASE WHEN spans THEN m40 ELSE d40 END AS depth_max_base40, score_tau, top_D40, CASE WHEN split_part(id, '-', 1)::BIGINT % 4 > 0 THEN split_part(id, '-', 1)::BIGINT % 25 END AS site, {_STATE.format('score_tau')} AS state_tau FROM vj JOIN t1 USING (level, id)), "
    f"vt AS (SELECT *, {_LABEL} AS label, {_LABEL.replace('state', 'state_tau').replace('conf_D40', 'top_D40')} AS label_tau FROM vk)"
)
_DRIFTED = (
    "ba AS (SELECT level, id, * EXCLUDE (level, id) FROM lq WHERE level <> 'tramo' UNION ALL BY NAME SELECT 'lote' AS level, 'LOTE' AS id, * FROM qf), "
    f"me AS (SELECT level, id, u.metric AS metric, u.a AS v FROM (SELECT level, id, {_melt({k: (v, 'NULL') for k, v in _DRIFT.items()})} FROM ba)), mr AS (SELECT u.metric AS metric, u.a AS v FROM (SELECT {_melt({k: (v, 'NULL') for k, v in _DRIFT.items()})} FROM qf WHERE {_REFERENCE})), "
    f"ed AS (SELECT metric, len(z) AS many, list_filter(z, lambda e: e <> z[1] AND e <> z[len(z)]) AS edges FROM (SELECT metric, list_sort(list_distinct(quantile_cont(v, [{', '.join(str(i / 10) for i in range(11))}]))) AS z FROM mr GROUP BY metric)), "
    "rb AS (SELECT metric, bin, count(*) AS r FROM (SELECT metric, len(list_filter(edges, lambda e: e <= v)) AS bin FROM mr JOIN ed USING (metric)) GROUP BY ALL), "
    "cb AS (SELECT level, id, metric, bin, count(*) AS c FROM (SELECT level, id, metric, len(list_filter(edges, lambda e: e <= v)) AS bin FROM me JOIN ed USING (metric)) GROUP BY ALL), "
    "sb AS (SELECT g.level, g.id, g.n, e.metric, many, b.bin FROM (SELECT level, id, count(*) AS n FROM ba GROUP BY ALL) g, ed e, LATERAL (SELECT unnest(range(0, len(e.edges) + 1)) AS bin) b), "
    "bb AS (SELECT s.*, coalesce(r, 0) AS r, coalesce(c, 0) AS c, greatest(coalesce(r, 0) / sum(coalesce(r, 0)) OVER w, 1e-4) AS rs, greatest(coalesce(c, 0) / sum(coalesce(c, 0)) OVER w, 1e-4) AS cs FROM sb s LEFT JOIN rb USING (metric, bin) LEFT JOIN cb USING (level, id, metric, bin) WHERE coalesce(r, 0) + coalesce(c, 0) > 0 WINDOW w AS (PARTITION BY level, id, metric)), "
    "dr AS (SELECT level, id, metric, any_value(n) AS n, CASE WHEN sum(r) < 20 OR sum(c) < 20 THEN NULL WHEN any_value(many) < 3 THEN 0 ELSE sum((cs - rs) * ln(cs / rs)) END AS psi FROM bb GROUP BY level, id, metric)"
)
_DOMAIN, _LEAST_DOMAIN, _DOMAIN_REFERENCE = [*_PHOTO, "raw_max", "pci_det"], 20, 3000  # as many photos of a group at least, of the reference at most
_P = range(len(_DOMAIN) + 1)
_TRI = [(i, j) for i in _P for j in _P if i <= j]


def _newton() -> str:
    """One step of every model from its sums: elimination and substitution, a SELECT a column."""
    sql = (
        f"SELECT level, id, f, it, {', '.join(f'w{i}' for i in _P)}, {', '.join(f'sum(share * sd * (1 - sd) * x{i} * x{j}) + {(1.0 if i < len(_DOMAIN) else 1e-9) if i == j else 0.0} AS h{i}_{j}' for i, j in _TRI)}, "
        f"{', '.join(f'sum(share * (y - sd) * x{i}) - w{i} * {1.0 if i < len(_DOMAIN) else 1e-9} AS g{i}' for i in _P)} FROM (SELECT *, 1 / (1 + exp(-greatest(least({' + '.join(f'w{i} * x{i}' for i in _P)}, 35), -35))) AS sd FROM nw JOIN dz USING (level, id, f)) GROUP BY level, id, f, it, {', '.join(f'w{i}' for i in _P)}"
    )
    for k in _P:
        rest = [*(f"h{i}_{j} - h{k}_{i} / h{k}_{k} * h{k}_{j} AS h{i}_{j}" for i, j in _TRI if i > k), *(f"g{i} - h{k}_{i} / h{k}_{k} * g{k} AS g{i}" for i in _P if i > k)]
        if rest:
            sql = f"SELECT * REPLACE ({', '.join(rest)}) FROM ({sql})"
    for k in reversed(_P):
        sql = f"SELECT *, (g{k}{''.join(f' - h{k}_{j} * s{j}' for j in _P if j > k)}) / h{k}_{k} AS s{k} FROM ({sql})"
    return f"SELECT level, id, f, it + 1 AS it, {', '.join(f'w{i} + s{i} AS w{i}' for i in _P)} FROM ({sql})"


_CLASSIFIED = (
    f"dn AS (SELECT level, id, count(*) AS n FROM ba GROUP BY ALL HAVING count(*) >= {_LEAST_DOMAIN}), "
    f"dl0 AS (SELECT image_id, {', '.join(f'ln(1 + greatest({v}, 0)) AS v{i}' for i, v in enumerate(_DOMAIN))} FROM qf WHERE {_REFERENCE} QUALIFY row_number() OVER (ORDER BY md5(image_id::VARCHAR || '-0'), image_id) <= {_DOMAIN_REFERENCE}), "
    f"ds AS (SELECT {', '.join(f'avg(v{i}) AS m{i}, coalesce(nullif(stddev_pop(v{i}), 0), 1) AS d{i}' for i in range(len(_DOMAIN)))} FROM dl0), "
    f"da AS (SELECT level, id, 0 AS y, image_id, {', '.join(f'v{i}' for i in range(len(_DOMAIN)))} FROM dn, dl0 UNION ALL SELECT level, id, 1, image_id, {', '.join(f'ln(1 + greatest({v}, 0))' for v in _DOMAIN)} FROM ba JOIN dn USING (level, id)), "
    f"dx AS MATERIALIZED (SELECT level, id, y, image_id % 5 AS fold, {', '.join(f'(v{i} - m{i}) / d{i} AS x{i}' for i in range(len(_DOMAIN)))}, 1.0::DOUBLE AS x{len(_DOMAIN)} FROM da, ds), "
    "dc AS (SELECT level, id, f, y, count(*) AS k FROM dx, (SELECT unnest(range(5)) AS f) WHERE fold <> f GROUP BY ALL), "
    "db AS (SELECT level, id, f, y, sum(k) OVER (PARTITION BY level, id, f) / 2 / k AS share FROM dc), "
    "dz AS MATERIALIZED (SELECT dx.*, f, share FROM dx JOIN db USING (level, id, y) WHERE fold <> f), "
    f"dw AS (WITH RECURSIVE nw AS (SELECT level, id, f, 0 AS it, {', '.join(f'0.0::DOUBLE AS w{i}' for i in _P)} FROM (SELECT DISTINCT level, id, f FROM dz) UNION ALL SELECT * FROM ({_newton()}) WHERE it <= 12) SELECT * FROM nw WHERE it = 12), "
    f"dp AS (SELECT level, id, y, round({' + '.join(f'w{i} * x{i}' for i in _P)}, 9) AS s FROM dx JOIN dw USING (level, id) WHERE f = fold), "
    "dk AS (SELECT *, rank() OVER (PARTITION BY level, id ORDER BY s) + (count(*) OVER (PARTITION BY level, id, s) - 1) / 2.0 AS r FROM dp), "
    "du AS (SELECT level, id, sum(y)::BIGINT AS n, (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * (count(*) - sum(y)), 0) AS auroc FROM dk GROUP BY level, id)"
)
_CORRELATED = (
    f"c1 AS (SELECT u.metric AS metric, u.a AS a, u.b AS b FROM (SELECT {_melt(_PAIRS)} FROM vt WHERE depth_max IS NOT NULL)), c2 AS ({_ranks('c1', 'metric')}), c3 AS (SELECT metric, count(*) AS n, {_rho('ra', 'rb')} AS spearman, {_rho('a', 'b')} AS pearson FROM c2 GROUP BY metric), "
    f"bt1 AS (SELECT u.metric AS metric, u.a AS a, u.b AS b FROM (SELECT {_melt(_TURNED)} FROM vt WHERE depth_max IS NOT NULL)), bt2 AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY a, b) - 1 AS i, count(*) OVER (PARTITION BY metric) AS m FROM bt1 WHERE a IS NOT NULL AND b IS NOT NULL), "
    f"bt3 AS (SELECT m, rep, i, count(*) AS w FROM (SELECT m, r.range AS rep, {_drawn('n.i', 'r.range', 'm')} AS i FROM (SELECT DISTINCT m, i FROM bt2) n, range({_REPS}) r) GROUP BY ALL), bt4 AS (SELECT metric, rep, a, b, sum(w)::BIGINT AS w FROM bt3 JOIN bt2 USING (m, i) GROUP BY ALL), "
    "bt5 AS (SELECT *, sum(w) OVER (PARTITION BY metric, rep ORDER BY a) - (sum(w) OVER (PARTITION BY metric, rep, a) - 1) / 2.0 AS ra, sum(w) OVER (PARTITION BY metric, rep ORDER BY b) - (sum(w) OVER (PARTITION BY metric, rep, b) - 1) / 2.0 AS rb, (sum(w) OVER (PARTITION BY metric, rep) + 1) / 2.0 AS mid FROM bt4), "
    "bt6 AS (SELECT metric, rep, sum(w * (ra - mid) * (rb - mid)) / sqrt(sum(w * (ra - mid) * (ra - mid)) * sum(w * (rb - mid) * (rb - mid))) AS rho FROM bt5 GROUP BY metric, rep HAVING count(DISTINCT a) > 2 AND count(DISTINCT b) > 2), "
    "bt7 AS (SELECT metric, quantile_cont(rho, 0.025) AS low, quantile_cont(rho, 0.975) AS high FROM bt6 GROUP BY metric), "
    f"g1 AS (SELECT level, u.metric AS metric, u.a AS a, u.b AS b FROM (SELECT level, {_melt(_GROUP_PAIRS)} FROM vj WHERE level <> 'tramo' AND depth_max IS NOT NULL)), g2 AS ({_ranks('g1', 'level, metric')}), g3 AS (SELECT level, metric, count(*) AS n, {_rho('ra', 'rb')} AS spearman FROM g2 GROUP BY level, metric), "
    f"p1 AS (SELECT segment_id, u.metric AS metric, u.a AS a, u.b AS b FROM (SELECT segment_id, {_melt(_PHOTO_PAIRS)} FROM qf)), p2 AS ({_ranks('p1', 'segment_id, metric')}), p3 AS (SELECT segment_id, metric, count(*) AS n, {_rho('ra', 'rb')} AS spearman FROM p2 GROUP BY segment_id, metric)"
)
_ROW = lambda level, key, block, metric, value, n, low="NULL", high="NULL": f"SELECT {level} AS level, {key} AS id, '{block}' AS block, {metric} AS metric, ({value})::DOUBLE AS value, {low}::DOUBLE AS low, {high}::DOUBLE AS high, ({n})::BIGINT AS n"
_COUNTED = lambda cond: f"count(*) FILTER ({cond})"
_ROWS = [
    *[_ROW("level", "id", block, f"'{k}'", k, "n") + " FROM wq" for block, m in _BY_GROUP.items() for k in m],
    _ROW("level", "id", "deriva", "'psi_' || metric", "psi", "n") + " FROM dr",
    _ROW("level", "id", "deriva", "'dominio_auroc'", "auroc", "n") + " FROM du",
    _ROW("'tramo'", "'LOTE'", "correlacion_sensor", "'spearman_' || metric", "spearman", "n", "low", "high") + f" FROM c3 LEFT JOIN bt7 USING (metric) WHERE n >= {quality.LEAST_STRETCHES}",
    _ROW("'tramo'", "'LOTE'", "correlacion_sensor", "'pearson_' || metric", "pearson", "n") + f" FROM c3 WHERE n >= {quality.LEAST_STRETCHES}",
    _ROW("level", "'LOTE'", "correlacion_sensor", "'spearman_' || metric", "spearman", "n") + f" FROM g3 WHERE n >= {quality.LEAST_GROUPS}",
    _ROW("'prueba'", "segment_id::VARCHAR", "correlacion_sensor", "metric", "spearman", "n") + f" FROM p3 WHERE n >= {quality.LEAST_PHOTOS}",
    *[_ROW("'lote'", "'LOTE'", "calibracion_idu", f"'{k}'", v, "SELECT count(DISTINCT segment_id) FROM frames") + f" FROM ca WHERE {w}" for k, v, w in (("multiplicador_tau", "m", "chosen"), ("acierto_estado_calibrado", "accuracy", "chosen"), ("acierto_estado_sin_calibrar", "accuracy", "abs(m - 1) < 1e-6"))],
    *[_ROW("'lote'", "'LOTE'", "calibracion_idu", f"'{k}_' || capture", v, "n") + " FROM cl" for k, v in (("acierto_fuera_de_muestra", "accuracy"), ("acierto_fuera_de_muestra_sin_calibrar", "accuracy_plain"), ("multiplicador_fuera_de_muestra", "m"))],
    *[_ROW("'sitio'", "site::VARCHAR", "repetibilidad", f"'{m}_{k}'", e.format(m), f"count({m})") + f" FROM vt WHERE site IS NOT NULL GROUP BY site HAVING count(*) >= 2 AND count({m}) >= 2" for m in _REPEATED for k, e in (("desv_est", "stddev_samp({0})"), ("rango", "max({0}) - min({0})"))],
    *[_ROW("'sitio'", "site::VARCHAR", "repetibilidad", f"'{k}'", f"(count(DISTINCT {v}) = 1)::INT", "count(*)") + " FROM vt WHERE site IS NOT NULL GROUP BY site HAVING count(*) >= 2" for k, v in _LABELS.items()],
    *[_ROW("'foto'", "'MUESTRA'", "validacion_visual", f"'{k}_{name}'", f"{_COUNTED(f'({said}) > 0 AND ({true}) > 0')} / greatest({_COUNTED(f'({of}) > 0')}, 1)", "count(*)") + " FROM qf" for name, (said, true) in _REVIEWED.items() for k, of in (("precision", said), ("recall", true))],
    _ROW("'foto'", "'MUESTRA'", "validacion_visual", "'parches_marcados_como_piel_cocodrilo'", "avg((n_D20 > 0)::INT)", "count(*)") + f" FROM qf WHERE {_PATCH}",
]


def _facts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frames by level with photo measures, detections before and after filters; the same frames once; readings."""
    boxes, frames, readings = t.all_boxes(spark, d), _field_frames(spark, d), _readings(spark, d)
    cuts = cut(pavement.cutoffs(q._detections(spark, d)))  # four rows, read for both kinds of densities
    kept = field.timed(field.frame_table(boxes, frames, cuts, field.frame_depth(frames, readings)))
    firmware = field.frame_depth(frames, readings.withColumn("depth", F.col("cm") - 40)).withColumnRenamed("depth", "d40")
    zero = ["raw_max", *[f"{p}_{k}" for p in ("raw_conf", "raw_n", "raw_rho", "true") for k in K]]
    i = F.col("image_id")
    photos = kept.join(quality.unfiltered(boxes, cuts), "image_id", "left").fillna(0, zero).fillna(100, ["pci_det"]).join(firmware, "image_id", "left")
    photos = cut(photos.select("*", *[(by_plus + (i * a % m).cast("double") / by).alias(k) for k, (a, m, by, by_plus) in _PHOTO.items()]))
    photos = cut(quality.flagged(photos, photos.where(_REFERENCE)))  # read by every block
    return field.levels(photos), photos, readings


@query(
    f"+{_FACTS}, {_DRIFTED}, {_CLASSIFIED}, {_CORRELATED}, ca AS ({ORACLES['fld_calibrate']}), cl AS ({ORACLES['fld_calibrate_left_out']}) "
    f"SELECT level, id, block, metric, {q6('value')} AS value, {q6('low')} AS low, {q6('high')} AS high, n FROM ({' UNION ALL '.join(_ROWS)})",
    "boxes", "frames", "track",
)
def fld_quality_long(spark, d):
    """Quality of photos, confidence, drift, depth against damage, calibration, repeats and reviewed presence in long form: one row a metric."""
    lv, photos, readings = _facts(spark, d)
    rows, lote = [], {"level": F.lit("lote"), "id": F.lit("LOTE")}
    more = [F.min("t_norm").alias("_early"), F.max("t_norm").alias("_late"), F.min("user_id").alias("user_id"), F.max("d40").alias("d40"), F.max("raw_conf_D40").alias("top_D40"), *[F.avg(f"raw_rho_{k}").alias(f"rho_{k}") for k in K]]
    wide = cut(lv.groupBy("level", "id").agg(F.count(F.lit(1)).alias("n"), *[F.expr(e).alias(k) for m in _BY_GROUP.values() for k, e in m.items()], *more))
    rows += [quality.long(wide, block, {k: F.col(k) for k in m}) for block, m in _BY_GROUP.items()]
    # drift of the whole lot, of sites and of runs
    batch = F.concat_ws("|", "level", "id")
    variables = ["image_id", *[F.col(v).alias(k) for k, v in _DRIFT.items()]]
    batches = lv.where("level <> 'tramo'").select(batch.alias("batch"), *variables).unionByName(photos.select(F.lit("lote|LOTE").alias("batch"), *variables))
    sizes = batches.groupBy("batch").agg(F.count(F.lit(1)).alias("n"))
    psi = study.drift(photos.where(_REFERENCE).select(*variables[1:]), batches, "batch", list(_DRIFT))
    # a linear classifier of each group against photos of the reference, as many as the method takes
    tell = [F.log1p(F.greatest(F.col(k), F.lit(0))).alias(k) for k in (*_PHOTO, "max_conf", "pci_det")]
    sample = sampling.least_by_digest(photos.where(_REFERENCE).select(*variables), "image_id", 0, _DOMAIN_REFERENCE).select("image_id", *tell)
    large = batches.join(sizes.where(F.col("n") >= _LEAST_DOMAIN).select("batch"), "batch", "left_semi").select("batch", "image_id", *tell)
    told = domain.auroc(sample, large, "batch", "image_id", [*_PHOTO, "max_conf", "pci_det"], fold=F.pmod("image_id", F.lit(5)))
    named = {"level": F.substring_index("batch", "|", 1), "id": F.substring_index("batch", "|", -1)}
    rows.append(quality.long(told.withColumns(named), "deriva", {"dominio_auroc": F.col("auroc")}))
    psi = psi.join(sizes, "batch").withColumns(named)
    rows.append(psi.select("level", "id", F.lit("deriva").alias("block"), F.concat(F.lit("psi_"), "variable").alias("metric"), F.col("psi").alias("value"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), "n"))
    # stretches and groups, labelled before and after filters
    vias = field.via_table(lv, readings).select("level", "id", "n_D00", "n_D40", "conf_D40", n6("share_D40"), n6("score"), "label", "depth_max", n6("depth_mean"), n6("depth_deep"))
    series = readings.groupBy("user_id").agg(F.max(F.col("cm") - 40).alias("m40"))
    before = pavement.scored(wide).withColumn("score_tau", F.round(F.col("pci_vis") + 1e-9, 6)).join(series, "user_id", "left")
    base40 = F.when((F.col("_early") <= 0) & (F.col("_late") >= 1), F.col("m40")).otherwise(F.col("d40"))
    seg = F.substring_index("id", "-", 1).cast("long")
    vias = cut(vias.join(before.select("level", "id", "score_tau", "top_D40", base40.alias("depth_max_base40")), ["level", "id"]))
    stretches = vias.where("level = 'tramo'").withColumn("site", F.when(seg % 4 > 0, seg % 25)).withColumn("label_tau", field.label(x.state(F.col("score_tau")), F.col("depth_max"), F.col("top_D40")))
    melted = lambda df, key, pairs: df.where("depth_max IS NOT NULL").select(F.explode(F.array(*[F.struct(F.concat(key, F.lit(k)).alias("metric"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")) for k, (a, b) in pairs.items()])).alias("m")).select("m.*")
    found = quality.correlations(melted(stretches, F.lit(""), _PAIRS), "metric", quality.LEAST_STRETCHES).withColumns({"level": F.lit("tramo"), "id": F.lit("LOTE")})
    one = lambda df, metric, value: df.select("level", "id", F.lit("correlacion_sensor").alias("block"), metric.alias("metric"), F.col(value).alias("value"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), "n")
    rows.append(one(found, F.concat(F.lit("pearson_"), "metric"), "pearson"))
    ends = quality.rank_intervals(melted(stretches, F.lit(""), _TURNED), "metric", _REPS)
    rows.append(found.join(ends, "metric", "left").select("level", "id", F.lit("correlacion_sensor").alias("block"), F.concat(F.lit("spearman_"), "metric").alias("metric"), F.col("spearman").alias("value"), "low", "high", "n"))
    groups = quality.correlations(melted(vias.where("level <> 'tramo'"), F.concat("level", F.lit("|")), _GROUP_PAIRS), "metric", quality.LEAST_GROUPS)
    rows.append(one(groups.withColumns({"level": F.substring_index("metric", "|", 1), "id": F.lit("LOTE")}), F.concat(F.lit("spearman_"), F.substring_index("metric", "|", -1)), "spearman"))
    beside = quality.photo_correlations(photos, _PHOTO_PAIRS).withColumns({"level": F.lit("prueba"), "id": F.col("segment_id").cast("string")})
    rows.append(one(beside, F.col("metric"), "spearman"))
    # calibration
    swept = cut(deliveries.swept(spark, d))
    curve, out = calibration.chosen(swept, 0.05), calibration.left_out(swept, "capture", 0.05, 20)
    many = photos.agg(F.countDistinct("segment_id").alias("n"))
    own = curve.agg(*[F.max(F.when(w, F.col(v))).alias(k) for k, v, w in (("multiplicador_tau", "m", F.col("chosen")), ("acierto_estado_calibrado", "accuracy", F.col("chosen")), ("acierto_estado_sin_calibrar", "accuracy", F.col("step") == 20))]).crossJoin(many).withColumns(lote)  # one row each
    rows.append(quality.long(own, "calibracion_idu", {k: F.col(k) for k in ("multiplicador_tau", "acierto_estado_calibrado", "acierto_estado_sin_calibrar")}))
    names = {"acierto_fuera_de_muestra": "accuracy", "acierto_fuera_de_muestra_sin_calibrar": "accuracy_plain", "multiplicador_fuera_de_muestra": "m"}
    rows.append(quality.long(out.withColumns(lote).withColumn("capture", F.col("capture").cast("string")), "calibracion_idu", {k: F.col(v) for k, v in names.items()}, keep="capture"))
    rows.append(quality.repeats(stretches, _REPEATED, _LABELS))
    # reviewed presence
    reviewed = {name: (F.expr(said) > 0, F.expr(true) > 0) for name, (said, true) in _REVIEWED.items()}
    rows.append(quality.long(wide := quality.presence(photos, reviewed), "validacion_visual", {k: F.col(k) for k in wide.columns if k.startswith(("precision", "recall"))}))
    patches = photos.where(_PATCH).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("n_D20") > 0).cast("int")).alias("v")).withColumns({"level": F.lit("foto"), "id": F.lit("MUESTRA")})
    rows.append(quality.long(patches, "validacion_visual", {"parches_marcados_como_piel_cocodrilo": F.col("v")}))
    return reduce(DataFrame.unionByName, rows).select("level", "id", "block", "metric", n6("value"), n6("low"), n6("high"), "n")


_CITY = "rd AS (SELECT p_partkey AS code, p_size % 14 AS surface_code, 4.46 + ((p_partkey * 7919) % 3800)::DOUBLE / 10000 AS lat, -74.23 + ((p_partkey * 104729) % 2300)::DOUBLE / 10000 AS lon FROM part), la AS (SELECT l_partkey AS code, arg_max(l_linenumber % 5, (l_shipdate, l_orderkey, l_linenumber, l_suppkey)) AS state_code FROM lineitem GROUP BY l_partkey)"
_when = lambda key, table, other: f"CASE {key} " + " ".join(f"WHEN {a if isinstance(a, int) else chr(39) + a + chr(39)} THEN '{b}'" for a, b in table.items()) + f" ELSE '{other}' END"


@query(
    f"WITH {_CITY}, m AS (SELECT code, lat, lon, {_when('surface_code', c.CITY_SURFACE, 'otro')} AS surface, {_when('state_code', c.CITY_STATE, 'sin_clasificar')} AS state FROM rd LEFT JOIN la USING (code)) "
    f"SELECT code, surface, {_when('surface', c.CITY_GROUP, 'otro')} AS surface_group, state, round(sqrt(pow((lat - {c.CENTRE[0]}) * 111320, 2) + pow((lon - {c.CENTRE[1]}) * 111320 * cos(radians({c.CENTRE[0]})), 2)), 3) AS dist_m FROM m"
)
def fld_idu(spark, d):
    """Carriageways with their latest state, surface group and distance from a place in a local plane."""
    part = t.points(spark, d, "part", "p_partkey").join(t.read(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 14).alias("surface_code")), "id")
    latest = t.read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.max_by(F.col("l_linenumber") % 5, F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey")).alias("state_code"))
    m = part.join(latest, "id", "left")
    surface = x.by_class(c.CITY_SURFACE, F.col("surface_code"), "otro")
    return m.withColumn("surface", surface).select(F.col("id").alias("code"), "surface", x.by_class(c.CITY_GROUP, F.col("surface"), "otro").alias("surface_group"), x.by_class(c.CITY_STATE, F.col("state_code"), "sin_clasificar").alias("state"), F.round(x.local_distance(F.col("lat"), F.col("lon"), *c.CENTRE), 3).alias("dist_m"))
