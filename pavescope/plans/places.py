"""Queries over places and vectors: points in polygons, roads, the vibration factor, and principal components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as c
from ..operators import components, matching, polygons, sampling
from ..sources import city
from ..sources import tables as t
from .queries import query

# ---- polygons

#: Corners of each polygon about its centre: a wide outline, and a hole in it.
_OUTER, _HOLE = ((0.0, 0.01), (0.013, 0.001), (0.002, -0.012), (-0.009, -0.002)), ((0.001, 0.003), (0.004, 0.001), (0.001, -0.003))
_list = lambda ring: "[" + ", ".join(f"[x + {a}, y + {b}]" for a, b in ring) + "]"
_RING = f"po AS (SELECT id AS polygon, {_list(_OUTER)} AS outer_, {_list(_HOLE)} AS hole FROM (SELECT id, lon AS x, lat AS y FROM r))"
_EDGES = f"{_RING}, ed AS (" + " UNION ALL ".join(f"SELECT polygon, unnest({r}) AS a, unnest(list_concat({r}[2:], {r}[1:1])) AS b FROM po" for r in ("outer_", "hole")) + ")"
_T = "least(greatest(((lon - a[1]) * (b[1] - a[1]) + (lat - a[2]) * (b[2] - a[2])) / (pow(b[1] - a[1], 2) + pow(b[2] - a[2], 2)), 0), 1)"
_PLACED = (
    f"{_EDGES}, hi AS (SELECT q.id, polygon, sum(CASE WHEN (a[2] > lat) <> (b[2] > lat) AND lon < (b[1] - a[1]) * (lat - a[2]) / (b[2] - a[2]) + a[1] THEN 1 ELSE 0 END) AS n, "
    f"min(111000.0 * sqrt(pow(lon - a[1] - {_T} * (b[1] - a[1]), 2) + pow(lat - a[2] - {_T} * (b[2] - a[2]), 2))) AS m FROM q, ed GROUP BY q.id, polygon), "
    "pl AS (SELECT id, coalesce(min(polygon) FILTER (n % 2 = 1), arg_min(polygon, (m, polygon)) FILTER (m <= 200)) AS polygon FROM hi GROUP BY id)"
)


def _placed(spark: SparkSession, d: str) -> DataFrame:
    corner = lambda a, b: F.array(F.col("lon") + a, F.col("lat") + b)
    shapes = t.points(spark, d, "supplier", "s_suppkey").select(F.col("id").alias("polygon"), F.array(*[F.array(*[corner(a, b) for a, b in ring]) for ring in (_OUTER, _HOLE)]).alias("rings"))
    return polygons.placed(t.points(spark, d, "customer", "c_custkey"), shapes, 0.005, 200.0)


@query(f"+{_PLACED} SELECT id, polygon FROM pl", "customers", "suppliers")
def jn_point_in_polygon(spark, d):
    """The least polygon that holds each point, or else the nearest within 200 m; polygons have holes."""
    return _placed(spark, d).select("id", "polygon")


@query(f"+{_PLACED}, k AS (SELECT id % 60 AS stretch, polygon, count(polygon) AS n FROM pl GROUP BY ALL) SELECT stretch, CASE WHEN sum(n) > 0 THEN arg_max(polygon, (n, -polygon)) END AS polygon, round(coalesce(max(n) / nullif(sum(n), 0), 0), 6) AS share FROM k GROUP BY stretch", "customers", "suppliers")
def fld_carriageways(spark, d):
    """The polygon that most photos of a stretch lie in, and its share."""
    return polygons.majority(_placed(spark, d).withColumn("stretch", F.col("id") % 60), "stretch").select("stretch", "polygon", F.round("share", 6).alias("share"))


# ---- shapes of the city's table

#: Corners of a road's area about its place, of a hole in it, and of a second area; by size of the road.
_AREA, _GAP, _OTHER = ((0.0, 0.0), (5.0, 0.5), (5.5, 2.0), (2.0, 1.0), (0.5, 2.5)), ((1.0, 0.6), (2.0, 0.7), (1.5, 0.9)), ((7.0, 1.0), (9.0, 1.5), (8.0, 3.0))
_at = lambda ring: "[" + ", ".join(f"[x + {a} * s, y + {b} * s]" for a, b in ring) + "]"
_about = lambda k: f"sum((a[1] * b[2] - b[1] * a[2]) * (a[{k}] + b[{k}]) * sg) / 3 / sum((a[1] * b[2] - b[1] * a[2]) * sg)"
_UMV = (
    f"sh AS (SELECT id, lon AS x, lat AS y, (1 + id % 7) * 0.00025 AS s FROM r), rg AS (" + " UNION ALL ".join(f"SELECT id, x, y, {_at(ring)} AS p, {sign} AS role FROM sh" for ring, sign in ((_AREA, 1), (_GAP, -1), (_OTHER, 1))) + "), "
    "eg AS (SELECT id, x, y, role, unnest(list_transform(p, lambda q: [q[1] - x, q[2] - y])) AS a, unnest(list_transform(list_concat(p[2:], p[1:1]), lambda q: [q[1] - x, q[2] - y])) AS b, list_sum(list_transform(range(1, len(p) + 1), lambda i: p[i][1] * p[i % len(p) + 1][2] - p[i % len(p) + 1][1] * p[i][2])) AS way FROM rg), "
    f"ce AS (SELECT id, y + {_about(2)} AS lat, x + {_about(1)} AS lon FROM (SELECT *, role * sign(way) AS sg FROM eg) GROUP BY id, x, y), "
    "pt AS (SELECT id, a[1] AS px, a[2] AS py FROM eg), "
    "di AS (SELECT p.id, (q.px - p.px) / sqrt(pow(q.px - p.px, 2) + pow(q.py - p.py, 2)) AS ux, (q.py - p.py) / sqrt(pow(q.px - p.px, 2) + pow(q.py - p.py, 2)) AS uy FROM pt p JOIN pt q ON p.id = q.id AND (p.px, p.py) < (q.px, q.py)), "
    "sp AS (SELECT id, ux, uy, min(px * ux + py * uy) AS a0, max(px * ux + py * uy) AS a1, min(py * ux - px * uy) AS b0, max(py * ux - px * uy) AS b1 FROM di JOIN pt USING (id) GROUP BY id, ux, uy), "
    "re AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY (a1 - a0) * (b1 - b0), ux) AS n FROM sp), "
    "en AS (SELECT id, CASE WHEN a1 - a0 >= b1 - b0 THEN [a0 * ux - (b0 + b1) / 2 * uy, a0 * uy + (b0 + b1) / 2 * ux] ELSE [(a0 + a1) / 2 * ux - b0 * uy, (a0 + a1) / 2 * uy + b0 * ux] END AS e, "
    "CASE WHEN a1 - a0 >= b1 - b0 THEN [a1 * ux - (b0 + b1) / 2 * uy, a1 * uy + (b0 + b1) / 2 * ux] ELSE [(a0 + a1) / 2 * ux - b1 * uy, (a0 + a1) / 2 * uy + b1 * ux] END AS f FROM re WHERE n = 1)"
)


def _shapes(spark: SparkSession, d: str) -> DataFrame:
    """The table of priorities as its file has it: text in every column, shapes of two areas and a hole; every tenth row has none."""
    r = t.points(spark, d, "supplier", "s_suppkey").withColumn("s", (1 + F.col("id") % 7) * F.lit(0.00025))
    ring = lambda at: F.concat(F.lit("("), F.concat_ws(", ", *[F.concat((F.col("lon") + F.lit(a) * F.col("s")).cast("string"), F.lit(" "), (F.col("lat") + F.lit(b) * F.col("s")).cast("string")) for a, b in (*at, at[0])]), F.lit(")"))
    shape = F.concat(F.lit("MULTIPOLYGON (("), ring(_AREA), F.lit(", "), ring(_GAP), F.lit("), ("), ring(_OTHER), F.lit("))"))
    known = {c.ROAD_SHAPE: F.when(F.col("id") % 10 > 0, shape), "CIV": F.format_string("%,d", F.col("id") * 1001), "PK_ID_CALZ": F.col("id").cast("string"), "AREACALZAD": F.when(F.col("id") % 3 > 0, F.lit("1,234.5")).otherwise("s/d")}
    return r.select(*[known.get(k, F.col("id").cast("string")).alias(k) for k in (c.ROAD_SHAPE, *c.ROAD_IDS, *c.ROAD_SIZES, *c.ROAD_SCORES, *c.ROAD_RANGE)])


@query(
    f"+{_UMV} SELECT id * 1001 AS civ, id AS pk_calzada, CASE WHEN id % 3 > 0 THEN 1234.5 END::DOUBLE AS area_m2, id::DOUBLE AS ip_umv, round(lat, 8) AS lat, round(lon, 8) AS lon, "
    "round(y + least(e, f)[2], 7) AS lat_a, round(x + least(e, f)[1], 7) AS lon_a, round(y + greatest(e, f)[2], 7) AS lat_b, round(x + greatest(e, f)[1], 7) AS lon_b FROM ce JOIN en USING (id) JOIN sh USING (id) WHERE id % 10 > 0",
    "suppliers",
)
def src_umv(spark, d):
    """Ids, numbers, centroids and long axes of roads whose areas come as text."""
    rows = city.roads(_shapes(spark, d))
    return rows.select("civ", "pk_calzada", "area_m2", "ip_umv", F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"), *[F.round(k, 7).alias(k) for k in ("lat_a", "lon_a", "lat_b", "lon_b")])


# ---- roads

_VERTICES = 12
_LINES = f"li AS (SELECT id AS road, k AS seq, lat + k * 0.0005 AS lat, lon + ((k * 37 + id) % 10) * 0.0001 AS lon FROM r, (SELECT range AS k FROM range({_VERTICES})))"
_DEG = repr(matching.DEGREE)
_flat = lambda a, b, c, d: f"sqrt(pow(({c} - {a}) * {_DEG}, 2) + pow(({d} - {b}) * {_DEG} * cos(radians({a})), 2))"
_TRIP = (
    "tp AS (SELECT o_orderkey AS id, o_custkey AS trip, CASE WHEN o_custkey % 5 > 0 THEN o_orderkey ELSE -o_orderkey END AS us, "
    "r.lat + (o_orderkey % 97) / 97.0::DOUBLE * 0.0055 AS lat, r.lon + 0.00045 + ((o_orderkey * 7919) % 21 - 10) * 0.00004 AS lon, o_totalprice FROM orders JOIN r ON r.id = 1 + o_custkey % 10)"
)
_MATCHED = (
    f"{_LINES}, {_TRIP}, s0 AS (SELECT road, seq, lat AS a, lon AS b, lead(lat) OVER w AS c, lead(lon) OVER w AS d FROM li WINDOW w AS (PARTITION BY road ORDER BY seq)), "
    f"s1 AS (SELECT *, {_flat('a', 'b', 'c', 'd')} AS len FROM s0 WHERE c IS NOT NULL), s2 AS (SELECT *, sum(len) OVER (PARTITION BY road ORDER BY seq) - len AS start FROM s1), "
    f"s3 AS (SELECT tp.*, road, seq, start, len, (d - b) * {_DEG} * cos(radians(a)) AS dx, (c - a) * {_DEG} AS dy, (lon - b) * {_DEG} * cos(radians(a)) AS px, (lat - a) * {_DEG} AS py FROM tp JOIN s2 ON tp.lat BETWEEN a - 0.01 AND c + 0.01 AND tp.lon BETWEEN b - 0.01 AND b + 0.01), "
    "s4 AS (SELECT *, least(greatest((px * dx + py * dy) / (dx * dx + dy * dy), 0), 1) AS t FROM s3), s5 AS (SELECT *, sqrt(pow(px - t * dx, 2) + pow(py - t * dy, 2)) AS off_m, start + t * len AS at_m FROM s4), "
    f"ma AS (SELECT * FROM s5 WHERE off_m <= {matching.REACH_M} QUALIFY row_number() OVER (PARTITION BY id, road ORDER BY off_m, seq) = 1)"
)
_FOLLOWED = (
    f"{_MATCHED}, sp AS (SELECT trip, road, at_m - lag(at_m) OVER (PARTITION BY trip, road ORDER BY us, id) AS step FROM ma), fw AS (SELECT trip, road FROM sp WHERE step <> 0 GROUP BY ALL HAVING median(step) > 0), "
    f"al AS (SELECT trip, count(*) AS n FROM tp GROUP BY trip), fo AS (SELECT trip, road FROM ma JOIN al USING (trip) GROUP BY trip, road, al.n HAVING count(*) >= {matching.SHARE} * al.n), "
    f"on_ AS (SELECT ma.*, floor(at_m / {matching.SECTION_M})::BIGINT AS section FROM ma SEMI JOIN fw USING (trip, road) SEMI JOIN fo USING (trip, road))"
)


def _roads(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    r = t.points(spark, d, "supplier", "s_suppkey")
    k = F.explode(F.sequence(F.lit(0), F.lit(_VERTICES - 1))).alias("seq")
    lines = r.select(F.col("id").alias("road"), "lat", "lon", k).select("road", "seq", (F.col("lat") + F.col("seq") * 0.0005).alias("lat"), (F.col("lon") + (F.col("seq") * 37 + F.col("road")) % 10 * 0.0001).alias("lon"))
    o = F.col("o_orderkey")
    trips = t.read(spark, d, "orders").join(r, F.col("id") == 1 + F.col("o_custkey") % 10).select(
        o.alias("id"), F.col("o_custkey").alias("trip"), F.when(F.col("o_custkey") % 5 > 0, o).otherwise(-o).alias("us"),
        (F.col("lat") + o % 97 / F.lit(97.0) * 0.0055).alias("lat"), (F.col("lon") + 0.00045 + (o * 7919 % 21 - 10) * 0.00004).alias("lon"), "o_totalprice",
    )
    return trips, lines


@query(f"+{_MATCHED} SELECT id, road, round(at_m, 4) AS at_m, round(off_m, 4) AS off_m, floor(at_m / {matching.SECTION_M})::BIGINT AS section FROM ma", "suppliers")
def jn_road_match(spark, d):
    """Each point on each road within 15 m: metres along it, metres off it, section of 200 m."""
    return matching.sections(matching.matched(*_roads(spark, d))).select("id", "road", F.round("at_m", 4).alias("at_m"), F.round("off_m", 4).alias("off_m"), "section")


@query(
    f"+{_FOLLOWED}, ag AS (SELECT road, section, median(0.1 + o_totalprice % 97 / 50) AS rms_sqrtv, count(DISTINCT trip) AS passes, 1 + (road * 31 + section * 7) % 17 / 4.0 AS iri FROM on_ GROUP BY ALL), "
    "k AS (SELECT f.road, exp(median(ln(iri) - ln(rms_sqrtv))) AS k FROM (SELECT DISTINCT road FROM ag) f JOIN ag o ON o.road <> f.road GROUP BY f.road) "
    "SELECT road, section, passes, round(rms_sqrtv, 6) AS rms_sqrtv, round(k * rms_sqrtv, 6) AS predicted FROM ag LEFT JOIN k USING (road)",
    "suppliers",
)
def sns_zenodo(spark, d):
    """Sections of roads that trips follow forward: median vibration, passes, and roughness by the factor that the other roads give."""
    on = matching.sections(matching.trips_on_roads(*_roads(spark, d))).withColumn("rms", 0.1 + F.col("o_totalprice") % 97 / 50)
    passes = on.groupBy("road", "section").agg(F.count_distinct("trip").alias("passes"))
    both = sampling.quantiles(on.select("road", "section", "rms"), "rms", {"rms_sqrtv": 0.5}, ["road", "section"]).join(passes, ["road", "section"])
    both = both.withColumn("iri", 1 + (F.col("road") * 31 + F.col("section") * 7) % 17 / 4.0)
    return matching.left_out_factor(both, "iri", "rms_sqrtv", "road").select("road", "section", "passes", F.round("rms_sqrtv", 6).alias("rms_sqrtv"), F.round("predicted", 6).alias("predicted"))


# ---- components


@query()
def vis_pca(spark, d):
    """32 components of each embedding, standardised and fitted on four of five."""
    e = t.read(spark, d, "embeddings").select("vec_id", "embedding")
    size = e.agg(F.max(F.size("embedding"))).first()[0]
    return components.projected(e, "vec_id", "embedding", components.fit(e.where("vec_id % 5 != 0"), "embedding", size, 32))
