"""Queries of what is delivered and of what is around the learned scores: pages, context, priorities, ensembles, intervals and calibration by captures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as c
from ..functions import exprs as x
from ..operators import calibration, fusion, geo, pavement, reports
from ..sources import tables as t
from . import queries as q
from . import study as st
from .field import _SWEEP
from .queries import _DV, _HAV, _PCI, _RHO, _YP, n6, query, r6

# ---- pages

_SEARCH = "PIEL DE COCODRILO"
_LINES = f"{st._SEGS}, ln AS (SELECT id, score, state, level, {st._RULE} AS action, {st._TEXT} AS text FROM sg)"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    score = t.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 100).alias("score"))
    segs = st._segments(spark, d)
    return segs.select("id", "state", "level", x.action(F.col("state"), F.col("dom")).alias("action"), st._text().alias("text")).join(score, "id")


@query(
    f"WITH {_LINES}, k AS (SELECT *, count(*) OVER () AS matches, row_number() OVER (ORDER BY score DESC, id) AS place FROM ln "
    f"WHERE level = 'media' AND contains(lower(id || ' ' || action || ' ' || text), lower('{_SEARCH}'))) "
    f"SELECT id, state, level, action, score, matches, place::INT AS place FROM k WHERE place <= {reports.PAGE}"
)
def rep_client_page(spark, d):
    """The page of segments of one level whose id, action or text hold a phrase, best score first."""
    found = reports.page(_lines(spark, d), "id", "score", True, {"level": "media", "state": ""}, _SEARCH, ("id", "action", "text"))
    return found.select("id", "state", "level", "action", "score", "matches", "place")


_MEASURES = ("l_quantity", "l_extendedprice", "l_discount")
_WIDE = ", ".join(f"avg({k}) AS {k}_media, max({k}) AS {k}_max" for k in _MEASURES)
_NAMES = [f"{k}_{s}" for k in _MEASURES for s in ("media", "max")]


@query(
    f"WITH w AS (SELECT l_suppkey, count(*) AS n, {_WIDE} FROM lineitem GROUP BY l_suppkey) "
    + " UNION ALL ".join(f"SELECT l_suppkey, 'calidad' AS block, '{k}' AS metric, round({k}::DOUBLE + 1e-9, 6) AS value, n FROM w" for k in _NAMES)
)
def rep_quality_long(spark, d):
    """Measures of each supplier as a long table: one pass of sums, then a row a measure."""
    wide = t.read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), *[e for k in _MEASURES for e in (F.avg(k).alias(f"{k}_media"), F.max(k).alias(f"{k}_max"))])
    return reports.melted(wide, ["l_suppkey"], "calidad", "n").withColumn("value", n6("value"))


# ---- context and priority

_KINDS = (
    "sc AS (SELECT * FROM r WHERE id % 3 = 0), he AS (SELECT *, id % 2 = 0 AS hospital FROM r WHERE id % 3 = 1), ho AS (SELECT * FROM he WHERE hospital), "
    "cr AS (SELECT p_partkey AS id, 4.46 + ((p_partkey * 7919) % 3800)::DOUBLE / 10000 AS lat, -74.23 + ((p_partkey * 104729) % 2300)::DOUBLE / 10000 AS lon, 2015 + p_size % 8 AS anio, [1, 3, 10][1 + p_partkey % 3] AS peso FROM part), "
    "re AS (SELECT * FROM cr WHERE anio >= (SELECT max(anio) FROM cr) - 2)"
)


def _around(name: str, table: str, radii: tuple[int, ...], weight: bool = False) -> str:
    m = _HAV.format("q.lat", "q.lon", "k.lat", "k.lon")
    counts = "".join(f", count(*) FILTER (m <= {r}) AS {name}_{r}m" for r in radii)
    sums = "".join(f", coalesce(sum(peso) FILTER (m <= {r}), 0)::DOUBLE AS {name}_pond_{r}m" for r in radii) if weight else ""
    return f"a_{name} AS (SELECT id{counts}{sums}, round(min(m), 4) AS dist_{name}_m FROM (SELECT q.id, {m} AS m{', peso' if weight else ''} FROM q, {table} k) GROUP BY id)"


_AROUND = ", ".join(_around(n, k, c.RADII[n], n == "siniestros") for n, k in (("colegio", "sc"), ("ips", "he"), ("hospital", "ho"), ("siniestros", "re")))


@query(
    f"+{_KINDS}, {_AROUND} SELECT *, round(" + _HAV.format("lat", "lon", c.CENTRE[0], c.CENTRE[1]) + ", 4) AS dist_centro_m "
    "FROM q JOIN a_colegio USING (id) JOIN a_ips USING (id) JOIN a_hospital USING (id) JOIN a_siniestros USING (id)",
    "customers", "suppliers",
)
def geo_context(spark, d):
    """Schools, health centres, hospitals and recent crashes around every point, and the distance of the centre."""
    points, places = t.points(spark, d, "customer", "c_custkey"), t.points(spark, d, "supplier", "s_suppkey")
    more = t.read(spark, d, "part").select(F.col("p_partkey").alias("id"), (2015 + F.col("p_size") % 8).alias("anio"))
    weight = F.element_at(F.array(*map(F.lit, (1, 3, 10))), (F.col("id") % 3 + 1).cast("int")).alias("peso")
    crashes = t.points(spark, d, "part", "p_partkey").join(more, "id").select("*", weight)
    health = places.where("id % 3 = 1").withColumn("hospital", F.col("id") % 2 == 0)
    out = geo.context(points, places.where("id % 3 = 0"), health, crashes)
    return out.select(*[F.round(k, 4).alias(k) if k.startswith("dist_") else F.col(k) for k in out.columns])


_ROADS = "ro AS (SELECT CASE WHEN p_partkey % 11 > 0 THEN p_retailprice END AS dim_social, p_size * 1.0 AS malla, (p_partkey % 17) * 1.0 AS rutas FROM part)"
_OWN = (
    "ow AS (SELECT c_custkey AS id, least(greatest(c_acctbal / 100, 0), 100) AS icv, CASE WHEN c_custkey % 5 > 0 THEN 900 + c_acctbal / 10 END AS dim_social, "
    "CASE WHEN c_custkey % 7 > 0 THEN (c_custkey % 43) * 1.0 END AS malla, (c_custkey % 19) * 1.0 AS rutas, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 29 END AS crashes, "
    "CASE WHEN c_custkey % 4 > 0 THEN (c_custkey * 37 % 101) * 1.0 END AS rain, CASE WHEN c_custkey % 13 > 0 THEN c_custkey % 700 END AS school_m, c_custkey % 2100 AS hospital_m FROM customer)"
)
_SHARE = "100.0 * (SELECT count(*) FROM {0} x WHERE x.{1} <= f.{2}) / (SELECT count({1}) FROM {0})"


@query(
    f"WITH {_ROADS}, rm AS (SELECT *, malla + rutas AS moved FROM ro), {_OWN}, f AS (SELECT *, coalesce(dim_social, (SELECT median(dim_social) FROM ro)) AS s, "
    "coalesce(malla + rutas, (SELECT median(moved) FROM rm)) AS m, coalesce(crashes, 0) AS cr, coalesce(rain, (SELECT median(rain) FROM ow)) AS ra FROM ow), "
    f"sc AS (SELECT *, {_SHARE.format('ro', 'dim_social', 's')} AS social, {_SHARE.format('rm', 'moved', 'm')} AS mobility, {_SHARE.format('ow', 'crashes', 'cr')} AS safety, {_SHARE.format('ow', 'rain', 'ra')} AS wet FROM f), "
    "im AS (SELECT *, 0.4 * social + 0.35 * mobility + 0.25 * safety AS importance FROM sc), "
    "pr AS (SELECT *, least(greatest(0.6 * (100 - icv) + 0.4 * importance + CASE WHEN school_m <= 300 THEN 5 ELSE 0 END + CASE WHEN hospital_m <= 1000 THEN 5 ELSE 0 END + CASE WHEN wet >= 75 AND icv < 56 THEN 3 ELSE 0 END, 0), 100) AS p FROM im) "
    "SELECT id, round(social, 4) AS social, round(mobility, 4) AS mobility, round(safety, 4) AS safety, round(wet, 4) AS score_rain, round(importance + 1e-9, 4) AS importance, round(p + 1e-9, 4) AS priority, CASE WHEN p >= 60 THEN 'alta' WHEN p >= 40 THEN 'media' ELSE 'baja' END AS level FROM pr"
)
def geo_priority_whole(spark, d):
    """Priorities from raw columns: medians where values are missing, percentile scores among references, then the rule."""
    k, p = F.col("c_custkey"), F.col("p_partkey")
    real = lambda e: e.cast("double")
    roads = t.read(spark, d, "part").select(F.when(p % 11 > 0, F.col("p_retailprice")).alias("dim_social"), real(F.col("p_size")).alias("malla"), real(p % 17).alias("rutas"))
    own = t.read(spark, d, "customer").select(
        k.alias("id"), F.least(F.greatest(F.col("c_acctbal") / 100, F.lit(0.0)), F.lit(100.0)).alias("icv"), F.when(k % 5 > 0, 900 + F.col("c_acctbal") / 10).alias("dim_social"),
        F.when(k % 7 > 0, real(k % 43)).alias("malla"), real(k % 19).alias("rutas"), F.when(k % 3 > 0, k % 29).alias("crashes"), F.when(k % 4 > 0, real(k * 37 % 101)).alias("rain"),
        F.when(k % 13 > 0, k % 700).alias("school_m"), (k % 2100).alias("hospital_m"),
    )
    out = geo.whole_priority(own, roads)
    r4 = lambda v, off=0.0: F.round(F.col(v) + off, 4).alias(v)
    return out.select("id", r4("social"), r4("mobility"), r4("safety"), r4("score_rain"), r4("importance", 1e-9), r4("priority", 1e-9), "level")


# ---- around the fusion

_HEAVY = "pow((o_custkey % 100) / 10.0, 9)"
_PREPARED = f"s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 > 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 5 > 0 THEN ln(1 + {_HEAVY}) END AS heavy, ((o_orderkey % 7) - 3)::DOUBLE AS flat, 4.0::DOUBLE AS same FROM orders)"
_FILLED = "f AS (SELECT o_orderkey, " + ", ".join(f"coalesce({k}, (SELECT median({k}) FROM s)) AS {k}" for k in ("price", "heavy", "flat", "same")) + " FROM s)"


@query(f"WITH {_PREPARED}, {_FILLED} SELECT o_orderkey, " + ", ".join(f"round(least(greatest((f.{k} - avg(f.{k}) OVER ()) / (CASE WHEN stddev_samp(f.{k}) OVER () > 0 THEN stddev_samp(f.{k}) OVER () ELSE 1 END), -8), 8) + 1e-9, 6) AS {k}" for k in ("price", "heavy", "flat", "same")) + " FROM f")
def ml_prepared(spark, d):
    """Columns as z-scores: the skewed one as logarithms, medians where values are missing."""
    k, heavy = F.col("o_orderkey"), F.pow(F.col("o_custkey") % 100 / 10.0, F.lit(9.0))
    rows = t.read(spark, d, "orders").select("o_orderkey", F.when(k % 9 > 0, F.col("o_totalprice")).alias("price"), F.when(k % 5 > 0, heavy).alias("heavy"), (k % 7 - 3).alias("flat"), F.lit(4.0).alias("same"))
    names = ["price", "heavy", "flat", "same"]
    return fusion.scaled(rows, names).select("o_orderkey", *[n6(v) for v in names])


_IRI = "(1 + image_id % 97 / 20.0)"
_MEMBERS = f"{_RHO}, me AS (SELECT m.range AS member, image_id, segment_id, " + ", ".join(f"rho_{k} * (0.8 + 0.1 * m.range) AS rho_{k}" for k in c.CLASSES) + f", {_IRI} * (1 + m.range / 10.0) AS iri FROM fr, range(5) m)"
_ICV = f"0.65 * ({_PCI}) + 0.35 * (100 * exp(-0.18 * greatest(0, iri - 1)))"
_MEAN = ", ".join(f"avg(rho_{k}) AS rho_{k}" for k in c.CLASSES)


@query(
    f"+{_MEMBERS}, f2 AS (SELECT segment_id, image_id, {_MEAN}, exp(avg(ln(iri))) AS iri FROM me GROUP BY ALL), "
    f"s2 AS (SELECT segment_id, {_MEAN}, avg(iri) AS iri FROM f2 GROUP BY ALL), d2 AS (SELECT *, {_DV} FROM s2), "
    f"s3 AS (SELECT segment_id, member, {_MEAN}, avg(iri) AS iri FROM me GROUP BY ALL), d3 AS (SELECT *, {_DV} FROM s3), "
    f"sp AS (SELECT segment_id, stddev_samp({_ICV}) AS sd FROM d3 GROUP BY ALL) "
    f"SELECT segment_id, round({_PCI} + 1e-9, 6) AS pci_vis, round(iri + 1e-9, 6) AS iri, round({_ICV} + 1e-9, 6) AS icv, round(sd + 1e-9, 6) AS icv_std FROM d2 JOIN sp USING (segment_id)",
    "boxes", "frames",
)
def ml_ensemble(spark, d):
    """Scores of segments from five members' predictions, and how far the members are apart."""
    dens = q._densities(spark, d).withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("iri", (1 + F.col("image_id") % 97 / 20.0) * (1 + F.col("member") / 10.0))
    members = dens.select("member", "image_id", "segment_id", *[(F.col(f"rho_{k}") * (0.8 + 0.1 * F.col("member"))).alias(f"rho_{k}") for k in c.CLASSES], "iri")
    return fusion.ensemble(members).select("segment_id", n6("pci_vis"), n6("iri"), n6("icv"), n6("icv_std"))


# the SQL sums the same distribution by its terms' logarithms
_PHI = (
    "(0.5 + sign({0}) * list_sum([CASE WHEN {0} = 0 THEN 0 ELSE exp((2 * k + 1) * ln(abs({0})) - (k + 1) * ln(2) - lgamma(k + 1.5) + 0.5 * ln(pi()) - {0} * {0} / 2) END FOR k IN range(151)]) / sqrt(2 * pi()))"
)
_BOUND = {name: low for name, low in c.STATES}
_CUT = ", ".join(f"least(greatest(({low} - score) / sigma, -8), 8) AS z_{name}" for name, low in c.STATES if low)


def _chances() -> str:
    out, above = [], "1"
    for name, low in c.STATES:
        below = f"b_{name}" if low else "0"
        out.append(f"round({above} - {below}, 6) AS p_{name}")
        above = below
    return ", ".join(out)


@query(
    f"WITH {_YP}, sg AS (SELECT sqrt(avg((y - p) * (y - p))) / 4 AS sigma FROM yp), sc AS (SELECT c_custkey AS id, c_acctbal / 100 AS score, sigma, FROM customer, sg), "
    f"z AS (SELECT id, {_CUT} FROM sc), b AS (SELECT id, " + ", ".join(f"{_PHI.format(f'z_{name}')} AS b_{name}" for name, low in c.STATES if low) + f" FROM z) SELECT id, {_chances()} FROM b"
)
def ev_state_shares(spark, d):
    """The chance of each state for every segment, its score taken as normal with the deviation of known errors."""
    error = F.col("y") - F.col("p")
    sigma = q._yp(spark, d).agg((F.sqrt(F.avg(error * error)) / 4).alias("sigma"))
    rows = t.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 100).alias("score")).crossJoin(F.broadcast(sigma))  # one row
    out = rows.select("id", *fusion.state_shares(F.col("score"), F.col("sigma")))
    return out.select("id", *[r6(f"p_{name}") for name, _ in c.STATES])


# ---- calibration by captures

_SEGMENT = _SWEEP[: _SWEEP.rindex(", cv AS")]
_SEGMENT = _SEGMENT.replace("ds AS (SELECT step, m, pci", "ds AS (SELECT segment_id % 4 AS capture, step, m, pci")


@query(
    f"+{_SEGMENT}, tr AS (SELECT c.capture, step, any_value(m) AS m, avg(dist) AS loss, round(abs(avg(pci) - avg(centre)), 9) AS off FROM (SELECT DISTINCT capture FROM ds) c JOIN ds ON ds.capture <> c.capture GROUP BY ALL), "
    "lo AS (SELECT capture, min(loss) AS low FROM tr GROUP BY capture), ch AS (SELECT capture, arg_min(step, (off, step)) AS best, arg_min(m, (off, step)) AS m FROM tr JOIN lo USING (capture) WHERE loss <= low + 1e-9 GROUP BY capture) "
    "SELECT ch.capture, round(any_value(ch.m), 6) AS m, count(*) FILTER (step = best) AS n, round(avg(hit) FILTER (step = best), 6) AS accuracy, round(avg(dist) FILTER (step = best), 6) AS loss, "
    "round(avg(hit) FILTER (step = 20), 6) AS accuracy_plain, round(avg(dist) FILTER (step = 20), 6) AS loss_plain FROM ch JOIN ds USING (capture) GROUP BY ch.capture",
    "boxes", "frames",
)
def fld_calibrate_left_out(spark, d):
    """Each capture judged with the multiplier that the other captures choose."""
    out = calibration.left_out(swept(spark, d), "capture", 0.05, 20)
    return out.select("capture", "m", "n", r6("accuracy"), r6("loss"), r6("accuracy_plain"), r6("loss_plain"))


def swept(spark: SparkSession, d: str) -> DataFrame:
    """Segments with their true states and captures under each multiplier."""
    boxes, frames = t.all_boxes(spark, d), t.frames(spark, d)
    kind = F.col("segment_id") % 3
    truth = frames.select("segment_id").distinct().select("segment_id", F.when(kind == 0, "bueno").when(kind == 1, "regular").otherwise("malo").alias("truth"), (F.col("segment_id") % 4).alias("capture"))
    return calibration.segment_curve(boxes, frames, truth, pavement.cutoffs(boxes.where(F.col("conf") >= c.DETECTION)), range(4, 25), 0.05)
