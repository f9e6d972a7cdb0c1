"""Queries that validate: assertions over a study's tables, and texts against their facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as c
from ..operators import validation as v
from ..sources import tables as t
from .queries import query

_SPLIT = "CASE WHEN segment_id % 20 < 13 THEN 'train' WHEN segment_id % 20 < 16 THEN 'fusion' WHEN segment_id % 20 < 19 THEN 'test' ELSE 'despliegue' END"
_EXPECTED = {"train": 150, "test1": 600}
_bad = lambda name, sql: f"SELECT '{name}' AS assertion, ({sql})::BIGINT AS failures"
_cross = lambda name, key, where="true": _bad(name, f"SELECT count(*) FROM (SELECT {key} FROM sp WHERE {where} AND {key} IS NOT NULL GROUP BY {key} HAVING count(DISTINCT split) <> 1)")
_DQ = " UNION ALL ".join([
    *[_bad(f"images_{s}", f"SELECT (count(*) FILTER (source = '{s}') <> {n})::INT FROM im") for s, n in _EXPECTED.items()],
    _bad("boxes_in_0_1", "SELECT count(*) FROM boxes WHERE NOT (cx BETWEEN 0 AND 1 AND cy BETWEEN 0 AND 1 AND w BETWEEN 0 AND 1 AND h BETWEEN 0 AND 1)"),
    _bad("box_classes", "SELECT count(*) FROM boxes WHERE cls NOT IN ('D00', 'D10', 'D20', 'D40')"),
    _bad("label_files", "SELECT count(DISTINCT image_id) FROM im WHERE labeled AND image_id NOT IN (SELECT image_id FROM boxes WHERE conf >= 0.5)"),
    _bad("one_split_an_image", "SELECT count(*) FROM (SELECT image_id FROM sp GROUP BY image_id HAVING count(*) <> 1)"), _bad("images_in_splits", "SELECT count(*) FROM im WHERE image_id NOT IN (SELECT image_id FROM sp)"),
    _cross("segments_in_one_split", "segment_id"), _cross("groups_in_one_split", "group_id", "split <> 'despliegue'"), _cross("clusters_in_one_split", "dup_cluster", "split <> 'despliegue'"), _bad("sensor_columns", "SELECT 0"),
    _bad("sensors_without_nulls", "SELECT count(*) FROM se WHERE az IS NULL"), _bad("acceleration_within_2_g", "SELECT count(*) FROM se WHERE az IS NULL OR abs(az) > 19.620001"),
    _bad("places_in_the_city", "SELECT count(*) FROM se WHERE NOT (lat BETWEEN 4.4 AND 4.9 AND lon BETWEEN -74.3 AND -73.9)"),
    _bad("segments_with_sensors", "SELECT count(DISTINCT segment_id) FROM sp WHERE split IN ('fusion', 'test', 'despliegue') AND segment_id NOT IN (SELECT segment_id FROM se)"),
])


@query(
    "+im AS (SELECT image_id, ['train', 'test1', 'test2'][1 + segment_id % 3] AS source, image_id % 2 = 0 AS labeled FROM frames), "
    f"sp AS (SELECT image_id, segment_id, segment_id % 400 AS group_id, CASE WHEN image_id % 9 = 0 THEN image_id % 70 END AS dup_cluster, {_SPLIT} AS split FROM frames WHERE image_id % 100 > 0 UNION ALL SELECT image_id, segment_id, segment_id, NULL, 'test' FROM frames WHERE image_id % 997 = 1), "
    f"se AS (SELECT user_id AS segment_id, CASE WHEN event_id % 50 > 0 THEN value / 5 END AS az, lat, lon FROM track), al AS ({_DQ}) SELECT assertion, failures, failures = 0 AS ok FROM al",
    "boxes", "frames", "track",
)
def dq_assertions(spark, d):
    """The fifteen checks of a study's tables, and how many rows, images or keys fail each."""
    frames, seg = t.frames(spark, d), F.col("segment_id")
    images = frames.select("image_id", F.element_at(F.array(F.lit("train"), F.lit("test1"), F.lit("test2")), (seg % 3 + 1).cast("int")).alias("source"), (F.col("image_id") % 2 == 0).alias("labeled"))
    boxes = t.all_boxes(spark, d)
    split = F.when(seg % 20 < 13, "train").when(seg % 20 < 16, "fusion").when(seg % 20 < 19, "test").otherwise("despliegue")
    splits = frames.where("image_id % 100 > 0").select("image_id", "segment_id", (seg % 400).alias("group_id"), F.when(F.col("image_id") % 9 == 0, F.col("image_id") % 70).alias("dup_cluster"), split.alias("split"))
    splits = splits.unionByName(frames.where("image_id % 997 = 1").select("image_id", "segment_id", seg.alias("group_id"), F.lit(None).cast("long").alias("dup_cluster"), F.lit("test").alias("split")))
    made = {"segment_id": "user_id", "obs_id": "event_id", "timestamp": "us", "lat": "lat", "lon": "lon", "speed_kmh": "value"}
    axis = F.when(F.col("event_id") % 50 > 0, F.col("value") / 5)
    sensors = t.track(spark, d).select(*[F.col(made[k]).alias(k) if k in made else (axis if k == "az" else F.lit(0.0)).alias(k) for k in v.SENSOR_COLUMNS])
    return v.assertions(images, boxes, boxes.where("conf >= 0.5").select("image_id"), splits, sensors, _EXPECTED)


_STATES5 = "['bueno','satisfactorio','regular','malo','muy_malo'][1 + doc_id % 5]"
_ACTS = "['mantenimiento_rutinario','sellado_de_fisuras','bacheo','parcheo','reconstruccion','bacheo','parcheo'][1 + doc_id % 7]"
_KNOWN = "[n_chars::DOUBLE, doc_id::DOUBLE, " + ", ".join(f"{k}::DOUBLE" for k in v.ALWAYS) + "]"
_ALLOWED = " OR ".join(f"(state = '{s}' AND action IN ({', '.join(repr(a) for a in names)}))" for s, names in c.ALLOWED.items())


@query(
    f"WITH d AS (SELECT doc_id, n_chars, coalesce(text, '') AS text, {_STATES5} AS state, {_ACTS} AS action FROM documents), b AS (SELECT *, list_filter(regexp_extract_all(text || ' ', '(?:^|[^\\p{{L}}\\p{{N}}_])(\\d+(?:[.,]\\d+)?)', 1), lambda w: NOT list_bool_or([abs(replace(w, ',', '.')::DOUBLE - f) <= greatest(0.6, 0.005 * abs(f)) FOR f IN {_KNOWN}])) AS bad FROM d) "
    f"SELECT doc_id, concat_ws(' | ', CASE WHEN len(bad) > 0 THEN 'números no respaldados: ' || array_to_string(bad, ', ') END, CASE WHEN NOT contains(lower(text), replace(state, '_', ' ')) THEN 'estado no mencionado o distinto' END, CASE WHEN NOT ({_ALLOWED}) THEN 'acción fuera de la tabla de reglas' END, "
    f"CASE WHEN len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D\\x1C-\\x1F\\x85\\xA0]+')) > {v.MOST_WORDS * v.SPARE} THEN 'descripción demasiado larga' END) AS problems FROM b"
)
def txt_problems(spark, d):
    """All that is wrong with each text as the description of a segment, joined in order."""
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % n + 1).cast("int"))
    state = pick([s for s, _ in c.STATES], 5)
    action = pick(["mantenimiento_rutinario", "sellado_de_fisuras", "bacheo", "parcheo", "reconstruccion", "bacheo", "parcheo"], 7)
    facts = F.array(F.col("n_chars").cast("double"), F.col("doc_id").cast("double"))
    return t.read(spark, d, "documents").select("doc_id", F.array_join(v.problems(F.col("text"), F.lit(None).cast("string"), action, state, facts), " | ").alias("problems"))
