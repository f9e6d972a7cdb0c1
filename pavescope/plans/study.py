"""Queries of evaluation, splits, drift, geography, texts and the plain relational primitives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .. import config as c
from ..functions import exprs as x
from ..operators import evaluation as ev
from ..operators import geo, graph, sampling, study
from ..sources import tables as t
from . import queries as q
from .queries import _HAV, _STATE, _YP, n6, query, r6

REPS = 300


def _drawn(a: str, b: str, n: str) -> str:
    first = f"(((({a} * 48271 + {b} * 69621 + 12345) % 2147483647) * 16807) % 2147483647)"
    return f"(((xor({first}, {first} >> 13) * 39373) % 2147483647) * 48271) % 2147483647 % {n}"


# ---- evaluation

_ERRORS = f"{_YP}, er AS (SELECT o.o_custkey AS g, abs(y - p) AS e, abs(y - p) * 0.5 + o.o_orderkey % 40 AS e2 FROM yp JOIN orders o ON o.o_orderkey = yp.id)"
_times = lambda key, reps: "(" + " + ".join(f"({_drawn(key, reps, str(study.PRIME))} >= {step})::INT" for step in study.POISSON_STEPS) + ")"
_BOOT = f"{_ERRORS}, gs AS (SELECT g, sum(e) AS s, sum(e2) AS s2, count(*) AS n FROM er GROUP BY g), dr AS (SELECT r.range AS rep, s, s2, n, {_times('gs.g', 'r.range')} AS k FROM gs, range({REPS}) r)"

_DRAWS = f"{_ERRORS}, gs AS (SELECT g, sum(e) AS s, sum(e2) AS s2, count(*) AS n, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS m FROM er GROUP BY g), dr AS (SELECT r.range AS rep, {_drawn('gs.i', 'r.range', 'gs.m')} AS i FROM gs, range({REPS}) r)"


def _errors(spark: SparkSession, d: str) -> DataFrame:
    rows = q._yp(spark, d).join(t.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("g")), "id")
    e = F.abs(F.col("y") - F.col("p"))
    sums = rows.groupBy("g").agg(F.sum(e).alias("s"), F.sum(e * 0.5 + F.col("id") % 40).alias("s2"), F.count(F.lit(1)).alias("n"))
    return sums.withColumn("ds", F.col("s2") - F.col("s"))


@query(f"WITH {_DRAWS}, v AS (SELECT rep, sum(s) / sum(n) AS v FROM dr JOIN gs USING (i) GROUP BY rep) SELECT round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high FROM v")
def ev_bootstrap(spark, d):
    """95 % interval of the mean absolute error, groups resampled with replacement."""
    return study.bootstrap_ratio(_errors(spark, d), "g", "s", "n", REPS, replaced=True).select(r6("low"), r6("high"))


@query(f"WITH {_BOOT}, v AS (SELECT rep, sum(k * (s2 - s)) / nullif(sum(k * n), 0) AS v FROM dr GROUP BY rep) SELECT round((SELECT sum(s2 - s) / sum(n) FROM gs), 6) AS delta, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high FROM v")
def ev_paired_delta(spark, d):
    """The second model's error less the first one's, with its interval over the same resamples."""
    sums = _errors(spark, d)
    whole = sums.agg((F.sum("ds") / F.sum("n")).alias("delta"))
    return whole.crossJoin(study.bootstrap_ratio(sums, "g", "ds", "n", REPS)).select(r6("delta"), r6("low"), r6("high"))  # one row each


@query(f"WITH s AS (SELECT s_suppkey, s_acctbal AS v, row_number() OVER (ORDER BY s_suppkey) - 1 AS i, count(*) OVER () AS m FROM supplier), dr AS (SELECT r.range AS rep, {_drawn('s.i', 'r.range', 's.m')} AS i FROM s, range(2000) r), v AS (SELECT rep, avg(v) AS v, count(DISTINCT i) AS u FROM dr JOIN s USING (i) GROUP BY rep) SELECT round(quantile_cont(v, 0.025), 4) AS low, round(quantile_cont(v, 0.975), 4) AS high FROM v WHERE u > 2")
def ev_boot_rows(spark, d):
    """The same with rows for groups; resamples of two distinct rows or fewer are left out."""
    rows = t.read(spark, d, "supplier").select(F.col("s_suppkey").alias("g"), F.col("s_acctbal").cast("double").alias("v"))
    reps = study.replaced_sums(rows, "g", ["v"], 2000).where("groups > 2").select(F.try_divide("v", "v_known").alias("m"))
    return reps.agg(F.round(F.percentile("m", F.lit(0.025)), 4).alias("low"), F.round(F.percentile("m", F.lit(0.975)), 4).alias("high"))


@query(f"WITH {_YP}, m AS (SELECT avg(abs(p - y)) AS mae, sqrt(avg((p - y) * (p - y))) AS rmse, avg(p - y) AS sesgo, count(*) AS n FROM yp) " + " UNION ALL ".join(f"SELECT 'fusion' AS area, '{k}' AS metric, round({k} + 1e-9, 4) AS value, n, CASE WHEN {k} <= 30 THEN 'OK' WHEN {k} <= 60 THEN 'ALERTA' ELSE 'FALLA' END AS status FROM m" for k in ("mae", "rmse", "sesgo")))
def ev_collect(spark, d):
    """Metrics as typed rows: area, metric, value to four decimals, n and status."""
    m = ev.regression(q._yp(spark, d)).withColumnRenamed("bias", "sesgo")
    long = m.unpivot(["n"], ["mae", "rmse", "sesgo"], "metric", "value")
    status = ev.status(F.col("value"), F.lit(30.0), F.lit(60.0), F.lit("menor"))
    return long.select(F.lit("fusion").alias("area"), "metric", F.round(F.col("value") + 1e-9, 4).alias("value"), "n", status.alias("status"))


_PSI = "round((SELECT sum((cs - rs) * ln(cs / rs)) FROM (SELECT greatest(sum(ref) / sum(sum(ref)) OVER (), 1e-4) AS rs, greatest(sum(1 - ref) / sum(sum(1 - ref)) OVER (), 1e-4) AS cs FROM (SELECT len(list_filter((SELECT quantile_cont({0}, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) FROM ref), lambda e: e <= v)) AS bin, ref FROM (SELECT {0} AS v, 1 AS ref FROM ref UNION ALL SELECT {0}, 0 FROM cur WHERE batch = '{1}')) GROUP BY bin)), 6)"


@query("WITH ref AS (SELECT l_extendedprice AS price, l_quantity::DOUBLE AS quantity FROM lineitem WHERE l_orderkey % 3 = 0), cur AS (SELECT l_extendedprice * CASE WHEN l_orderkey % 3 = 2 THEN 1.3 ELSE 1.0 END AS price, l_quantity::DOUBLE AS quantity, CASE WHEN l_orderkey % 3 = 1 THEN 'control' ELSE 'shifted' END AS batch FROM lineitem WHERE l_orderkey % 3 > 0) " + " UNION ALL ".join(f"SELECT '{b}' AS batch, '{v}' AS variable, {_PSI.format(v, b)} AS psi" for b in ("control", "shifted") for v in ("price", "quantity")))
def ev_drift(spark, d):
    """Stability of two variables in a control batch and in a shifted one."""
    third = F.col("l_orderkey") % 3
    rows = t.read(spark, d, "lineitem").select(third.alias("third"), (F.col("l_extendedprice") * F.when(third == 2, 1.3).otherwise(1.0)).alias("price"), F.col("l_quantity").cast("double").alias("quantity"), F.when(third == 1, "control").otherwise("shifted").alias("batch"))
    return study.drift(rows.where("third = 0"), rows.where("third > 0"), "batch", ["price", "quantity"]).withColumn("psi", F.round("psi", 6))


@query(f"WITH {q._CELLS}, m AS (SELECT *, sum(n) OVER (PARTITION BY i) AS ni, sum(n) OVER (PARTITION BY j) AS nj FROM cell) SELECT truth AS level, round(coalesce(n / nullif(nj, 0), 0), 6) AS precision, round(coalesce(n / nullif(ni, 0), 0), 6) AS recall, round(coalesce(2.0 * n / nullif(ni + nj, 0), 0), 6) AS f1, ni::BIGINT AS support FROM m WHERE i = j")
def ev_ordinal_levels(spark, d):
    m = ev.per_level(q._cells(spark, d))
    return m.select("level", r6("precision"), r6("recall"), r6("f1"), "support")


# ---- splits and samples

@query("SELECT image_id, printf('TR-CO%03d-%04d', (segment_id % 1000)::INT, (chain_pos // 10)::INT) AS segment, printf('TR-CO%03d-B%03d', (segment_id % 1000)::INT, (chain_pos // 50)::INT) AS block FROM frames", "frames")
def win_bucket(spark, d):
    """Places in a chain cut into segments of ten and blocks of five segments, with padded ids."""
    seg = F.expr("chain_pos div 10")
    return t.frames(spark, d).select("image_id", F.format_string("TR-CO%03d-%04d", F.col("segment_id") % 1000, seg).alias("segment"), F.format_string("TR-CO%03d-B%03d", F.col("segment_id") % 1000, F.expr("chain_pos div 50")).alias("block"))


def _items(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("image_id")
    return t.frames(spark, d).select("image_id", F.col("segment_id").alias("block"), F.when(i % 1201 == 0, -(i % 7) - 1).otherwise(i).alias("cluster"))


_MERGED = "it AS (SELECT image_id, segment_id AS block, CASE WHEN image_id % 1201 = 0 THEN -(image_id % 7) - 1 ELSE image_id END AS cluster FROM frames), fi AS (SELECT cluster, min(block) AS a FROM it GROUP BY cluster), eg AS (SELECT DISTINCT a, block AS b FROM it JOIN fi USING (cluster) WHERE a <> block), bo AS (SELECT a, b FROM eg UNION SELECT b, a FROM eg), reach(node, peer) AS (SELECT a, b FROM bo UNION SELECT reach.node, bo.b FROM reach JOIN bo ON reach.peer = bo.a), gr AS (SELECT node, least(node, min(peer)) AS g FROM reach GROUP BY node), mb AS (SELECT DISTINCT it.block, coalesce(gr.g, it.block) AS grp FROM it LEFT JOIN gr ON gr.node = it.block)"


def _recursive(sql: str) -> str:
    return "WITH RECURSIVE " + t.SQL["frames"] + ", " + sql


@query(_recursive(f"{_MERGED} SELECT block, grp AS \"group\" FROM mb"))
def gr_merge_blocks(spark, d):
    """Blocks that share near copies belong together; the label is their least block."""
    return study.merged_blocks(_items(spark, d))


_SPLITS = (
    f"{_MERGED}, ge AS (SELECT grp AS key, count(*) AS size, avg(image_id % 101) AS pci FROM it JOIN mb USING (block) GROUP BY grp), qe AS (SELECT quantile_cont(pci, 1 / 3.0) AS a, quantile_cont(pci, 2 / 3.0) AS b FROM ge), "
    "ts AS (SELECT key, size, CASE WHEN pci <= a THEN 0 WHEN pci <= b THEN 1 ELSE 2 END AS stratum FROM ge, qe), rk AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY size DESC, md5(key::VARCHAR), key) - 1 AS r FROM ts), "
    "fo AS (SELECT key, size, stratum, (CASE WHEN r % 40 < 20 THEN r % 40 ELSE 39 - r % 40 END)::INT AS fold FROM rk), sp AS (SELECT *, CASE WHEN fold < 13 THEN 'train' WHEN fold < 17 THEN 'fusion' ELSE 'test' END AS split FROM fo)"
)


def _splits(spark: SparkSession, d: str) -> DataFrame:
    """Groups with size, stratum, fold and split; every frame with its group."""
    items = _items(spark, d)
    of = study.merged_blocks(items)
    groups = items.join(of, "block").groupBy(F.col("group").alias("key")).agg(F.count(F.lit(1)).alias("size"), F.avg(F.col("image_id") % 101).alias("pci"))
    edges = sampling.quantiles(groups, "pci", {"a": 1 / 3, "b": 2 / 3})
    tercile = F.when(F.col("pci") <= F.col("a"), 0).when(F.col("pci") <= F.col("b"), 1).otherwise(2)
    dealt = study.folds(groups.crossJoin(F.broadcast(edges)).select("key", "size", tercile.alias("stratum")), 20, "stratum")  # one row
    return dealt.withColumn("split", F.when(F.col("fold") < 13, "train").when(F.col("fold") < 17, "fusion").otherwise("test"))


@query(_recursive(f"{_SPLITS} SELECT key, size, stratum, fold, split FROM sp"))
def gr_splits(spark, d):
    """Whole groups dealt to twenty stratified folds: 13 to train, 4 to fusion, 3 to test."""
    return _splits(spark, d)


@query(_recursive(f"{_SPLITS} SELECT split, count(*) AS groups, sum(size)::BIGINT AS frames, round(sum(size) / sum(sum(size)) OVER (), 6) AS share, round(100 * (max(s) - min(s)), 4) AS spread_pp FROM (SELECT *, sum(size) OVER (PARTITION BY split, stratum) / sum(size) OVER (PARTITION BY split) AS s FROM sp) GROUP BY split"))
def agg_balance(spark, d):
    """Frames by split, and how far apart (percentage points) a split's largest and least strata are."""
    split = Window.partitionBy("split")
    s = _splits(spark, d).groupBy("split", "stratum").agg(F.count(F.lit(1)).alias("g"), F.sum("size").alias("n")).withColumn("s", F.col("n") / F.sum("n").over(split))
    out = s.groupBy("split").agg(F.sum("g").alias("groups"), F.sum("n").alias("frames"), F.round(100 * (F.max("s") - F.min("s")), 4).alias("spread_pp"))
    return out.withColumn("share", F.round(F.col("frames") / F.sum("frames").over(Window.partitionBy()), 6))  # three rows


@query("WITH g AS (SELECT o_custkey AS key, count(*) AS size FROM orders GROUP BY o_custkey), r AS (SELECT *, row_number() OVER (ORDER BY size DESC, md5(key::VARCHAR), key) - 1 AS r FROM g) SELECT key, size, (CASE WHEN r % 10 < 5 THEN r % 10 ELSE 9 - r % 10 END)::INT AS fold FROM r")
def smp_groupkfold(spark, d):
    """Groups in five folds of like sizes."""
    return study.folds(t.read(spark, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count(F.lit(1)).alias("size")), 5)


@query("WITH a AS (SELECT s_suppkey AS segment, row_number() OVER (ORDER BY s_suppkey) AS n FROM supplier), b AS (SELECT p_partkey AS road, 40 + p_size * 4.0 AS axis_m, md5(p_partkey || '-11') AS h, row_number() OVER (ORDER BY md5(p_partkey || '-11'), p_partkey) AS n FROM part WHERE 40 + p_size * 4.0 >= 60) SELECT segment, road, least(axis_m, 150)::DOUBLE AS length_m, substr(h, 32, 1) < '8' AS flipped FROM a JOIN b USING (n)")
def geo_assign(spark, d):
    """A carriageway of some length for each segment, none twice, in a seeded order and direction; lengths up to 150 m."""
    segs = t.read(spark, d, "supplier").select(F.col("s_suppkey").alias("segment"))
    roads = t.read(spark, d, "part").select(F.col("p_partkey").alias("road"), (40 + F.col("p_size") * 4.0).cast("double").alias("axis_m"), F.md5(F.concat(F.col("p_partkey").cast("string"), F.lit("-11"))).alias("h")).where("axis_m >= 60")
    return study.paired(segs, roads, ["segment"], ["h", "road"]).select("segment", "road", F.least("axis_m", F.lit(150.0)).alias("length_m"), (F.substring("h", 32, 1) < "8").alias("flipped"))


@query(f"WITH n AS (SELECT count(*) AS n FROM supplier) SELECT p_partkey, ({_drawn('p_partkey', '17', 'n')} + 1)::BIGINT AS pick FROM part, n")
def smp_choice(spark, d):
    """A supplier for each part, drawn with replacement."""
    n = t.read(spark, d, "supplier").agg(F.count(F.lit(1)).alias("n"))
    return t.read(spark, d, "part").crossJoin(F.broadcast(n)).select("p_partkey", (study.drawn(F.col("p_partkey"), F.lit(17), F.col("n")) + 1).alias("pick"))  # one row


_SEQ = f"h AS (SELECT vec_id, label, {q._WORDS} FROM ({q._IMAGES})), li AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS m FROM h)"


@query(f"WITH {_SEQ}, co AS (SELECT a.label, median({q._FAR}) AS near FROM li a JOIN li b ON a.label = b.label AND a.i = b.i - 1 GROUP BY a.label), ra AS (SELECT a.label, median({q._FAR}) AS random FROM li a JOIN li b ON a.label = b.label AND b.i = {_drawn('a.vec_id', 'a.label', 'a.m')} GROUP BY a.label) SELECT label, near, random, near < 0.5 * random AS sequential FROM co JOIN ra USING (label)")
def gr_sequentiality(spark, d):
    """Median distance of following images against that of random pairs in a group: under half of it, the group is a sequence."""
    names = [f"w{w}" for w in range(8)]
    order = Window.partitionBy("label").orderBy("vec_id")
    h = q._gradient_hash(spark, d).select("vec_id", "label", *graph.words()).withColumn("i", F.row_number().over(order) - 1).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("label")))
    other = h.select(F.col("label"), F.col("i").alias("j"), *[F.col(w).alias(f"o{w}") for w in names])
    far = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"o{w}"))) for w in names), F.lit(0))
    at = lambda place, name: h.withColumn("j", place).join(other, ["label", "j"]).groupBy("label").agg(F.median(far).alias(name))
    both = at(F.col("i") + 1, "near").join(at(study.drawn(F.col("vec_id"), F.col("label"), F.col("m")), "random"), "label")
    return both.withColumn("sequential", F.col("near") < 0.5 * F.col("random"))


_TOUR = (
    f"WITH RECURSIVE h AS (SELECT vec_id, label, {q._WORDS} FROM ({q._IMAGES})), "
    "go(label, vec_id, pos, seen) AS (SELECT label, min(vec_id), 0::BIGINT, [min(vec_id)] FROM h GROUP BY label UNION ALL "
    f"SELECT g.label, arg_min(b.vec_id, (({q._FAR}), b.vec_id)), any_value(g.pos) + 1, list_append(any_value(g.seen), arg_min(b.vec_id, (({q._FAR}), b.vec_id))) "
    "FROM go g JOIN h a ON a.vec_id = g.vec_id JOIN h b ON b.label = g.label AND NOT list_contains(g.seen, b.vec_id) GROUP BY g.label) "
    "SELECT label, vec_id, pos AS chain_pos FROM go"
)


@query(_TOUR)
def gr_chain(spark, d):
    """The greedy tour through each label's images."""
    return study.chained(q._gradient_hash(spark, d), "label", "vec_id")


# ---- geography

@query("+nr AS (SELECT q.id, arg_min(r.id, (" + _HAV.format("q.lat", "q.lon", "r.lat", "r.lon") + ", r.id)) AS ref_id, min(" + _HAV.format("q.lat", "q.lon", "r.lat", "r.lon") + ") AS m FROM q, r GROUP BY q.id) SELECT id, ref_id, round(m, 4) AS nearest_m FROM nr", "customers", "suppliers")
def jn_spatial_knn1(spark, d):
    """The nearest reference of every point, however far."""
    near = geo.nearest(t.points(spark, d, "customer", "c_custkey"), t.points(spark, d, "supplier", "s_suppkey"), 2000.0)
    return near.select("id", "ref_id", F.round("nearest_m", 4).alias("nearest_m"))


_NEAR = "(SELECT {1} FROM r WHERE " + _HAV.format("q.lat", "q.lon", "r.lat", "r.lon") + " <= {0})"


@query(f"+w AS (SELECT id, lat, lon, {_NEAR.format(1000, 'count(*)')} AS n_1000, {_NEAR.format(3000, 'coalesce(sum(id % 10), 0)')} AS weight_3000, " + _HAV.format("lat", "lon", c.CENTRE[0], c.CENTRE[1]) + " AS centre_m FROM q) SELECT id, n_1000, weight_3000::BIGINT AS weight_3000, round(centre_m, 4) AS centre_m FROM w", "customers", "suppliers")
def geo_point_features(spark, d):
    """Counts and weighted sums of references around points, and the distance of the centre."""
    points = t.points(spark, d, "customer", "c_custkey")
    refs = t.points(spark, d, "supplier", "s_suppkey").withColumn("w", F.col("id") % 10)
    out = geo.within(points, refs, 1000.0).select("id", F.col("n").alias("n_1000")).join(geo.within(points, refs, 3000.0, "w").select("id", F.col("weight").alias("weight_3000")), "id").join(points, "id")
    centre = x.haversine(F.col("lat"), F.col("lon"), F.lit(c.CENTRE[0]), F.lit(c.CENTRE[1]))
    return out.select("id", "n_1000", "weight_3000", F.round(centre, 4).alias("centre_m"))


@query("WITH da AS (SELECT event_type AS cell, ts::DATE AS day, sum(value) / 1000 AS rain, max(value) AS warm, min(value) AS cold FROM events GROUP BY ALL), ro AS (SELECT cell, day, rain, sum(rain) OVER (w ROWS 6 PRECEDING) AS r7, sum(rain) OVER (w ROWS 29 PRECEDING) AS r30, sum(rain) OVER (w ROWS 364 PRECEDING) AS r365, count(*) FILTER (rain >= 1) OVER (w ROWS 29 PRECEDING) AS wet, avg(warm) OVER (w ROWS 6 PRECEDING) AS wa, avg(cold) OVER (w ROWS 6 PRECEDING) AS co FROM da WINDOW w AS (PARTITION BY cell ORDER BY day)), qs AS (SELECT DISTINCT user_id, event_type AS cell, ts::DATE AS day FROM events WHERE event_id % 7 = 0) SELECT user_id, cell, day, round(r7 + 1e-9, 4) AS rain_7d, round(r30 + 1e-9, 4) AS rain_30d, round(r365 + 1e-9, 4) AS rain_365d, wet AS wet_days_30d, round(wa + 1e-9, 4) AS warm_7d, round(co + 1e-9, 4) AS cold_7d FROM qs LEFT JOIN ro USING (cell, day)")
def geo_weather(spark, d):
    """Rolled weather of a cell, joined to visits by cell and day (two keys)."""
    e = t.read(spark, d, "events").withColumn("day", F.col("ts").cast("date")).withColumnRenamed("event_type", "cell")
    daily = e.groupBy("cell", "day").agg((F.sum("value") / 1000).alias("rain"), F.max("value").alias("warm"), F.min("value").alias("cold"))
    visits = e.where("event_id % 7 = 0").select("user_id", "cell", "day").distinct()
    out = visits.join(study.rolled(daily, "cell", "day"), ["cell", "day"], "left")
    n4 = lambda k: F.round(F.col(k) + 1e-9, 4).alias(k)
    return out.select("user_id", "cell", "day", n4("rain_7d"), n4("rain_30d"), n4("rain_365d"), "wet_days_30d", n4("warm_7d"), n4("cold_7d"))


@query("WITH k AS (SELECT p_partkey AS id, p_partkey % 97 * 1000 AS x5, p_partkey % 89 * 1000 AS y5, 40 + p_size * 4.0 AS axis_m FROM part), known AS (SELECT s_suppkey % 97 * 1000 AS x5, s_suppkey % 89 * 1000 AS y5, avg(s_acctbal) AS elev FROM supplier GROUP BY ALL) SELECT id, round(elev, 4) AS elev, elev IS NULL AS missing, round(100 * abs(elev - 2600) / greatest(axis_m, 1), 4) AS slope_pct FROM k LEFT JOIN known USING (x5, y5)")
def geo_elevation(spark, d):
    """Cached heights by rounded coordinates (as integers); what is missing, and slopes in per cent."""
    p = t.read(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 97 * 1000).alias("x5"), (F.col("p_partkey") % 89 * 1000).alias("y5"), (40 + F.col("p_size") * 4.0).alias("axis_m"))
    known = t.read(spark, d, "supplier").groupBy((F.col("s_suppkey") % 97 * 1000).alias("x5"), (F.col("s_suppkey") % 89 * 1000).alias("y5")).agg(F.avg("s_acctbal").alias("elev"))
    out = p.join(known, ["x5", "y5"], "left")
    return out.select("id", F.round("elev", 4).alias("elev"), F.col("elev").isNull().alias("missing"), F.round(100 * F.abs(F.col("elev") - 2600) / F.greatest("axis_m", F.lit(1.0)), 4).alias("slope_pct"))


# ---- texts

_LIST = "['bueno','satisfactorio','regular','malo','muy_malo']"
_SEGS = f"sg AS (SELECT c_custkey AS id, c_acctbal / 100 AS score, {_STATE.format('(c_acctbal / 100)')} AS state, (40 + c_custkey % 111)::INT AS length_m, c_custkey % 4 AS n_bache, c_custkey % 3 AS n_piel, ['alta','media','baja'][1 + c_custkey % 3] AS level, ['D00','D10','D20','D40'][1 + c_nationkey % 4] AS dom FROM customer)"
_RULE = "CASE state WHEN 'bueno' THEN 'mantenimiento_rutinario' WHEN 'satisfactorio' THEN 'sellado_de_fisuras' WHEN 'regular' THEN CASE dom WHEN 'D40' THEN 'bacheo' WHEN 'D20' THEN 'parcheo' ELSE 'sellado_de_fisuras' END WHEN 'malo' THEN CASE dom WHEN 'D40' THEN 'bacheo' WHEN 'D20' THEN 'rehabilitacion' ELSE 'parcheo' END ELSE CASE dom WHEN 'D20' THEN 'reconstruccion' ELSE 'rehabilitacion' END END"
_URGENCY = "CASE level WHEN 'alta' THEN 'inmediata_30_dias' WHEN 'media' THEN 'programada_6_meses' ELSE 'rutinaria_12_meses' END"
_TEXT = "'Segmento de ' || length_m || ' m en estado ' || replace(state, '_', ' ') || '. ' || CASE WHEN n_bache + n_piel > 0 THEN 'Detecciones: ' || concat_ws(', ', CASE WHEN n_piel > 0 THEN n_piel || ' piel de cocodrilo' END, CASE WHEN n_bache > 0 THEN n_bache || ' bache' END) || '.' ELSE 'Sin daños visibles detectados.' END || ' Prioridad ' || level || '.'"


def _segments(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    dom = F.element_at(F.array(*map(F.lit, c.CLASSES)), (F.col("c_nationkey") % 4 + 1).cast("int"))
    level = F.element_at(F.array(F.lit("alta"), F.lit("media"), F.lit("baja")), (k % 3 + 1).cast("int"))
    return t.read(spark, d, "customer").select(k.alias("id"), x.state(F.col("c_acctbal") / 100).alias("state"), (40 + k % 111).cast("int").alias("length_m"), (k % 4).alias("n_bache"), (k % 3).alias("n_piel"), level.alias("level"), dom.alias("dom"))


def _text() -> Column:
    found = F.concat_ws(", ", F.when(F.col("n_piel") > 0, F.concat(F.col("n_piel").cast("string"), F.lit(" " + c.DAMAGE_TEXT["D20"]))), F.when(F.col("n_bache") > 0, F.concat(F.col("n_bache").cast("string"), F.lit(" " + c.DAMAGE_TEXT["D40"]))))
    seen = F.when(F.col("n_bache") + F.col("n_piel") > 0, F.concat(F.lit("Detecciones: "), found, F.lit("."))).otherwise("Sin daños visibles detectados.")
    return F.concat(F.lit("Segmento de "), F.col("length_m").cast("string"), F.lit(" m en estado "), F.translate("state", "_", " "), F.lit(". "), seen, F.lit(" Prioridad "), F.col("level"), F.lit("."))


@query(f"WITH {_SEGS} SELECT id, {_TEXT} AS text, {_RULE} AS action, {_URGENCY} AS urgency FROM sg")
def txt_template(spark, d):
    """A description, action and urgency of each segment from its facts."""
    return _segments(spark, d).select("id", _text().alias("text"), x.action(F.col("state"), F.col("dom")).alias("action"), x.by_class(c.URGENCY, F.col("level")).alias("urgency"))


@query(f"WITH {_SEGS}, given AS (SELECT doc_id AS id, text FROM documents WHERE doc_id % 3 = 0) SELECT id, coalesce(g.text, {_TEXT}) AS text, CASE WHEN g.text IS NULL THEN 'plantilla' ELSE 'modelo' END AS source FROM sg LEFT JOIN given g USING (id)")
def jn_fallback(spark, d):
    """A model's text where there is one, else the template's."""
    given = t.read(spark, d, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), F.col("text").alias("given"))
    return _segments(spark, d).join(given, "id", "left").select("id", F.coalesce("given", _text()).alias("text"), F.when(F.col("given").isNull(), "plantilla").otherwise("modelo").alias("source"))


_ALLOW = "CASE state " + " ".join(f"WHEN '{s}' THEN [{', '.join(repr(a) for a in v)}]" for s, v in c.ALLOWED.items()) + " END"


@query(f"WITH {_SEGS} SELECT id, {_URGENCY} AS urgency, list_sort({_ALLOW}) AS allowed, list_contains({_ALLOW}, {_RULE}) AS fits FROM sg".replace("list_sort(", "array_to_string(list_sort(").replace(") AS allowed", "), ',') AS allowed"))
def prj_allowed(spark, d):
    """Actions that a state allows and the urgency of a level; whether the rule's action is allowed."""
    allowed = x.by_class({s: F.array(*map(F.lit, v)) for s, v in c.ALLOWED.items()}, F.col("state"))
    out = _segments(spark, d)
    return out.select("id", x.by_class(c.URGENCY, F.col("level")).alias("urgency"), F.array_join(F.array_sort(allowed), ",").alias("allowed"), F.array_contains(allowed, x.action(F.col("state"), F.col("dom"))).alias("fits"))


@query("SELECT p_partkey, 'Parte ' || p_partkey || ' (' || p_brand || '), talla ' || p_size || '.' AS text, false AS unfilled FROM part")
def rep_template(spark, d):
    """{{KEY}} replaced by columns; whether any is left."""
    text = F.lit("Parte {{ID}} ({{MARCA}}), talla {{TALLA}}.")
    for key, column in (("ID", "p_partkey"), ("MARCA", "p_brand"), ("TALLA", "p_size")):
        text = F.replace(text, F.lit("{{" + key + "}}"), F.col(column).cast("string"))
    return t.read(spark, d, "part").select("p_partkey", text.alias("text"), F.contains(text, F.lit("{{")).alias("unfilled"))


# ---- relational primitives

@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def jn_semi(spark, d):
    return t.read(spark, d, "customer").join(t.read(spark, d, "orders").where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT o_orderkey, c_nationkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def jn_left_diffkeys(spark, d):
    return t.read(spark, d, "orders").join(t.read(spark, d, "customer").where("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_nationkey")


@query("SELECT c_custkey AS key, c_acctbal, s_acctbal FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def jn_index(spark, d):
    """Two tables side by side on their index."""
    s = t.read(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), "s_acctbal")
    return t.read(spark, d, "customer").select(F.col("c_custkey").alias("key"), "c_acctbal").join(s, "key", "left")


@query("SELECT q.id, count(r.id) AS n FROM q LEFT JOIN r ON floor(q.lat * 50) = floor(r.lat * 50) AND floor(q.lon * 50) = floor(r.lon * 50) GROUP BY q.id".replace("SELECT q.id", "+g AS (SELECT 1) SELECT q.id"), "customers", "suppliers")
def jn_composite(spark, d):
    """On two rounded coordinates at once."""
    cell = lambda df: df.withColumn("a", F.floor(F.col("lat") * 50)).withColumn("b", F.floor(F.col("lon") * 50))
    r = cell(t.points(spark, d, "supplier", "s_suppkey")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return cell(t.points(spark, d, "customer", "c_custkey")).join(r, ["a", "b"], "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark, d):
    return t.read(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("nation")).intersect(t.read(spark, d, "supplier").select("s_nationkey"))


@query("WITH g AS (SELECT o_orderpriority AS fold, count(*) AS n, sum(o_totalprice) AS s FROM orders GROUP BY 1) SELECT a.fold, sum(b.n)::BIGINT AS n_rest, round(sum(b.s) / sum(b.n), 4) AS mean_rest FROM g a JOIN g b ON a.fold <> b.fold GROUP BY a.fold")
def set_except(spark, d):
    """Leave one group out: the mean of all others, from the totals of groups."""
    g = t.read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("s"))
    rest = g.crossJoin(F.broadcast(g.agg(F.sum("n").alias("all_n"), F.sum("s").alias("all_s"))))  # one row
    return rest.select("fold", (F.col("all_n") - F.col("n")).alias("n_rest"), F.round((F.col("all_s") - F.col("s")) / (F.col("all_n") - F.col("n")), 4).alias("mean_rest"))


@query("SELECT o_orderkey, o_orderstatus, n, price FROM orders JOIN (SELECT l_orderkey, count(*) AS n, round(max(l_extendedprice), 2) AS price FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def set_concat_cols(spark, d):
    """Columns of two tables of one index."""
    other = t.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"), F.round(F.max("l_extendedprice"), 2).alias("price"))
    return t.read(spark, d, "orders").select("o_orderkey", "o_orderstatus").join(other, "o_orderkey")


@query("SELECT o_custkey, o_orderpriority, min(o_orderkey) AS o_orderkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1, 2")
def set_distinct(spark, d):
    """The first row of each pair of keys, in order of another."""
    first = F.min_by(F.struct("o_orderkey", "o_totalprice"), "o_orderkey").alias("f")
    return t.read(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(first).select("o_custkey", "o_orderpriority", "f.*")


_NUMERIC = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("SELECT l_suppkey, " + ", ".join(f"round(avg({k}) + 1e-9, 6) AS {k}_mean, max({k}) AS {k}_max" for k in _NUMERIC) + " FROM lineitem GROUP BY l_suppkey")
def agg_multi(spark, d):
    """Mean and maximum of every numeric column, suffixed."""
    return t.read(spark, d, "lineitem").groupBy("l_suppkey").agg(*[e for k in _NUMERIC for e in (n6(F.avg(k), f"{k}_mean"), F.max(k).alias(f"{k}_max"))])


@query("SELECT o_orderstatus AS source, o_orderpriority AS country, count(*) AS n, CASE WHEN o_orderstatus = 'F' THEN count(*) FILTER (o_totalprice > 200000) END AS damaged, trunc(median(o_custkey))::BIGINT AS middle FROM orders GROUP BY 1, 2")
def agg_profile(spark, d):
    """A profile by source and country; sources without labels have nulls."""
    keys, rows = ["source", "country"], t.read(spark, d, "orders").withColumnsRenamed({"o_orderstatus": "source", "o_orderpriority": "country"})
    plain = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_totalprice") > 200000).alias("_over"))
    middle = sampling.quantiles(rows, "o_custkey", {"middle": 0.5}, keys).select(*keys, F.col("middle").cast("long").alias("middle"))
    return plain.join(middle, keys, "left").select(*keys, "n", F.when(F.col("source") == "F", F.col("_over")).alias("damaged"), "middle")


@query("SELECT c_nationkey, c_custkey % 7 AS part, sum(CASE WHEN c_acctbal < -900 THEN c_acctbal END) AS debt FROM customer GROUP BY 1, 2")
def agg_sum_min_count(spark, d):
    """Sums that are null where nothing counts."""
    return t.read(spark, d, "customer").groupBy("c_nationkey", (F.col("c_custkey") % 7).alias("part")).agg(F.sum(F.when(F.col("c_acctbal") < -900, F.col("c_acctbal"))).alias("debt"))


@query("SELECT o_custkey, arg_min(o_orderpriority, (-n, o_orderpriority)) AS mode, max(n) AS n FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1")
def agg_mode(spark, d):
    """The most frequent value, the least on ties."""
    n = t.read(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("o_custkey").agg(F.min_by("o_orderpriority", F.struct(-F.col("n"), F.col("o_orderpriority"))).alias("mode"), F.max("n").alias("n"))


@query("WITH m AS (SELECT l_suppkey, avg(l_extendedprice) AS mu FROM lineitem GROUP BY 1) SELECT l_suppkey, round(avg(pow(l_extendedprice - mu, 3)) / pow(var_pop(l_extendedprice), 1.5), 6) AS skew, round(sqrt(count(*) * (count(*) - 1.0)) / nullif(count(*) - 2, 0) * avg(pow(l_extendedprice - mu, 3)) / pow(var_pop(l_extendedprice), 1.5), 6) AS skew_unbiased FROM lineitem JOIN m USING (l_suppkey) GROUP BY l_suppkey")
def agg_moments(spark, d):
    """Skewness, biased and corrected."""
    n, skew = F.count(F.lit(1)), F.skewness("l_extendedprice")
    return t.read(spark, d, "lineitem").groupBy("l_suppkey").agg(r6(skew, "skew"), r6(F.try_divide(F.sqrt(n * (n - 1.0)), n - 2) * skew, "skew_unbiased"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY CASE p_size % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END DESC, p_brand, p_retailprice DESC, p_partkey) AS place FROM part")
def srt_multi(spark, d):
    """Places in an order of several keys, mixed directions and a custom order of one of them."""
    p = t.read(spark, d, "part").select("p_partkey", "p_brand", (-F.when(F.col("p_size") % 3 == 0, 2).when(F.col("p_size") % 3 == 1, 1).otherwise(0)).alias("a"), (-F.col("p_retailprice")).alias("b"))
    return sampling.numbered(p, ["a", "p_brand", "b", "p_partkey"], "place").select("p_partkey", "place")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate FROM lineitem")
def prj_group_cols(spark, d):
    """Columns by the prefixes of their groups."""
    rows = t.read(spark, d, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[k for k in rows.columns if k.startswith("l_ship")])


@query("WITH e AS (SELECT quantile_cont(l_extendedprice, 0.05) AS p05, quantile_cont(l_quantity, 0.02) AS lo, quantile_cont(l_quantity, 0.98) AS hi FROM lineitem WHERE l_returnflag = 'R') SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice < p05 AS blurred, l_quantity < lo AS dark, l_quantity > hi AS overexposed FROM lineitem, e")
def prj_size_flags(spark, d):
    """Flags against quantiles of a reference."""
    rows = t.read(spark, d, "lineitem")
    ref = rows.where("l_returnflag = 'R'")
    edges = sampling.quantiles(ref, "l_extendedprice", {"p05": 0.05}).crossJoin(sampling.quantiles(ref, "l_quantity", {"lo": 0.02, "hi": 0.98}))  # one row each
    return rows.crossJoin(F.broadcast(edges)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_extendedprice") < F.col("p05")).alias("blurred"), (F.col("l_quantity") < F.col("lo")).alias("dark"), (F.col("l_quantity") > F.col("hi")).alias("overexposed"))


@query("WITH f AS (SELECT p_partkey AS id, p_retailprice AS det, p_retailprice + p_size % 7 - 3 AS vis FROM part WHERE p_partkey % 2 = 0), e AS (SELECT list_sort(list_distinct(quantile_cont(det, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS edges FROM f), r AS (SELECT *, least(greatest(len(list_filter(edges, lambda z: z <= det)) - 1, 0), len(edges) - 2) AS dec FROM f, e), rr AS (SELECT *, row_number() OVER (PARTITION BY dec ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY dec) AS m FROM r), p AS (SELECT p_partkey AS id, p_retailprice AS det, least(greatest(len(list_filter(edges, lambda z: z <= p_retailprice)) - 1, 0), len(edges) - 2) AS dec FROM part, e WHERE p_partkey % 2 = 1), n AS (SELECT dec, max(m) AS m FROM rr GROUP BY dec), k AS (SELECT p.*, " + _drawn("p.id", "p.dec", "n.m") + " AS i FROM p JOIN n USING (dec)) SELECT k.id, k.dec::INT AS decile, round(k.det + rr.vis - rr.det, 4) AS score FROM k JOIN rr USING (dec, i)")
def sco_dep_pci(spark, d):
    """A reference score for unlabelled rows: their own plus a residual drawn among labelled rows of the same decile."""
    p = t.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("det"), (F.col("p_retailprice") + F.col("p_size") % 7 - 3).alias("vis"))
    known = p.where("id % 2 = 0")
    edges = sampling.quantiles(known, "det", {f"q{i}": i / 10 for i in range(11)}).select(F.array_distinct(F.array(*[f"q{i}" for i in range(11)])).alias("edges"))
    at = F.size(F.filter("edges", lambda e: e <= F.col("det"))) - 1
    dealt = lambda df: df.crossJoin(F.broadcast(edges)).withColumn("decile", F.least(F.greatest(at, F.lit(0)), F.size("edges") - 2)).drop("edges")  # one row
    r = sampling.numbered(dealt(known), ["decile", "id"], "n")
    start = r.groupBy("decile").agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("m"))  # ten rows at most
    own = dealt(p.where("id % 2 = 1")).join(F.broadcast(start), "decile").withColumn("n", F.col("first") + study.drawn(F.col("id"), F.col("decile"), F.col("m")))
    return own.join(r.select("n", (F.col("vis") - F.col("det")).alias("rest")), "n").select("id", "decile", F.round(F.col("det") + F.col("rest"), 4).alias("score"))


@query("WITH s AS (SELECT p_partkey, ln(1 + p_size) AS rho, ln(p_retailprice / 100) AS iri FROM part), m AS (SELECT avg(rho) AS rm, stddev_pop(rho) + 1e-6 AS rs, avg(iri) AS im, stddev_pop(iri) + 1e-6 AS si FROM s) SELECT p_partkey, round((rho - rm) / rs + 1e-9, 6) AS rho, round((iri - im) / si + 1e-9, 6) AS iri, round(exp(rho) - 1 + 1e-9, 6) AS rho_back FROM s, m")
def ml_targets(spark, d):
    """Standardised log targets, and the way back."""
    s = t.read(spark, d, "part").select("p_partkey", F.log1p("p_size").alias("rho"), F.ln(F.col("p_retailprice") / 100).alias("iri"))
    m = s.agg(F.avg("rho").alias("rm"), (F.stddev_pop("rho") + 1e-6).alias("rs"), F.avg("iri").alias("im"), (F.stddev_pop("iri") + 1e-6).alias("si"))
    z = s.crossJoin(F.broadcast(m)).withColumn("z", (F.col("rho") - F.col("rm")) / F.col("rs"))  # one row
    back = F.greatest(F.expm1(F.col("z") * F.col("rs") + F.col("rm")), F.lit(0.0))
    return z.select("p_partkey", n6("z", "rho"), n6((F.col("iri") - F.col("im")) / F.col("si"), "iri"), n6(back, "rho_back"))
