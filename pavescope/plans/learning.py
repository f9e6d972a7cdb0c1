"""Queries that learn or deal: importance of roads, boosted baselines, greedy folds and what leaks between splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as c
from ..functions import exprs as x
from ..operators import baselines, dealing, domain, geo, pavement
from ..sources import images
from ..sources import tables as t
from .queries import _densities, query

# ---- folds

_K = 5
_ADD = "list_transform(loads, lambda x, i: x + CASE WHEN i = list_position(loads, list_min(loads)) THEN size ELSE 0 END)"


@query(
    "WITH RECURSIVE g AS (SELECT o_custkey AS key, count(*) AS size FROM orders GROUP BY o_custkey), "
    "r AS (SELECT *, row_number() OVER (ORDER BY size DESC, md5(key::VARCHAR), key) AS r FROM g), "
    f"go(r, loads, fold) AS (SELECT 0::BIGINT, [{', '.join(['0::BIGINT'] * _K)}], -1 UNION ALL "
    f"SELECT r.r, {_ADD}, list_position(loads, list_min(loads)) - 1 FROM go JOIN r ON r.r = go.r + 1) "
    "SELECT key, size, fold FROM go JOIN r USING (r)"
)
def smp_lightest(spark, d):
    """Groups in five folds: largest first, each to the lightest."""
    groups = t.read(spark, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count(F.lit(1)).alias("size"))
    return dealing.lightest(groups, _K)


def _stratified(spark: SparkSession, d: str) -> DataFrame:
    """Customers with how many orders they have of each priority, in 20 folds."""
    names = ["urgent", "high", "other"]
    o = t.read(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.substring("o_orderpriority", 1, 1).alias("p"))
    counts = [F.sum(F.when(cond, 1).otherwise(0)).alias(n) for n, cond in zip(names, (F.col("p") == "1", F.col("p") == "2", ~F.col("p").isin("1", "2")))]
    dealt = dealing.stratified(o.groupBy("key").agg(*counts), names, 20)
    return dealt.withColumn("split", F.when(F.col("fold") < 13, "train").when(F.col("fold") < 17, "fusion").otherwise("test"))


@query()
def gr_stratified(spark, d):
    """Customers with orders of several priorities in twenty folds, by the rule that keeps strata even."""
    return _stratified(spark, d)


_SPLIT = "CASE WHEN segment_id % 20 < 13 THEN 'train' WHEN segment_id % 20 < 16 THEN 'fusion' WHEN segment_id % 20 < 19 THEN 'test' ELSE 'despliegue' END"
_ITEMS = f"it AS (SELECT image_id, segment_id, segment_id % 37 AS stratum, image_id % 5000 AS cluster, CASE WHEN image_id % 499 = 0 THEN 'test' ELSE {_SPLIT} END AS split FROM frames)"
_CROSS = " UNION ALL ".join(f"SELECT '{k}' AS key, count(*) AS crossing FROM (SELECT {k} FROM it GROUP BY {k} HAVING count(DISTINCT split) > 1)" for k in ("segment_id", "cluster", "image_id"))


def _split(seg):
    return F.when(seg % 20 < 13, "train").when(seg % 20 < 16, "fusion").when(seg % 20 < 19, "test").otherwise("despliegue")


def _items(spark: SparkSession, d: str) -> DataFrame:
    i, seg = F.col("image_id"), F.col("segment_id")
    split = F.when(i % 499 == 0, "test").otherwise(_split(seg))
    return t.frames(spark, d).select("image_id", "segment_id", (seg % 37).alias("stratum"), (i % 5000).alias("cluster"), split.alias("split"))


@query(f"+{_ITEMS} {_CROSS}", "frames")
def gr_leaks(spark, d):
    """Segments, clusters and images that lie in more than one split."""
    return dealing.leaks(_items(spark, d), ["segment_id", "cluster", "image_id"])


@query(
    f"+{_ITEMS}, sh AS (SELECT s.split, k.stratum, coalesce(n, 0) / tot AS s FROM (SELECT split, count(*) AS tot FROM it GROUP BY split) s, (SELECT DISTINCT stratum FROM it) k "
    "LEFT JOIN (SELECT split AS sp, stratum AS st, count(*) AS n FROM it GROUP BY ALL) ON sp = s.split AND st = k.stratum) "
    "SELECT round(max(w), 6) AS spread_pp FROM (SELECT 100 * (max(s) - min(s)) AS w FROM sh GROUP BY stratum)",
    "frames",
)
def gr_imbalance(spark, d):
    """The most that a stratum's shares of two splits differ."""
    return dealing.imbalance(_items(spark, d), "stratum").select(F.round("spread_pp", 6).alias("spread_pp"))


# ---- learned scores

_PLACE = ["nearest_m", "n_1000", "weight_3000", "n_300", "centre_m", "width_m"]
_TARGETS = ["social", "index"]


def _roads(spark: SparkSession, d: str) -> DataFrame:
    """Customers as roads: what is around each, and two scores to be predicted."""
    points = t.points(spark, d, "customer", "c_custkey")
    refs = t.points(spark, d, "supplier", "s_suppkey").withColumn("w", F.col("id") % 10)
    near = geo.within(points, refs, 1000.0).select("id", F.col("n").alias("n_1000"), "nearest_m")
    wide = geo.within(points, refs, 3000.0, "w").select("id", F.col("weight").alias("weight_3000"))
    own = geo.within(points, points, 300.0).select("id", F.col("n").alias("n_300"))
    more = t.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), (6 + F.col("c_nationkey") % 5 * 1.5).cast("double").alias("width_m"), F.col("c_acctbal").cast("double").alias("b"))
    out = points.join(near, "id").join(wide, "id").join(own, "id").join(more, "id")
    out = out.withColumn("centre_m", x.haversine(F.col("lat"), F.col("lon"), F.lit(c.CENTRE[0]), F.lit(c.CENTRE[1])))
    social = 2 * F.col("n_1000") + F.col("b") / 2000
    return out.withColumn("social", social).withColumn("index", social + F.col("width_m") - F.col("centre_m") / 4000)


def _important(spark: SparkSession, d: str) -> DataFrame:
    return baselines.importance(_roads(spark, d), _PLACE, _TARGETS)


@query()
def geo_importance(spark, d):
    """Two scores of every road as trees predict them, by all roads and by those of other blocks of geohash-5."""
    return _important(spark, d).select("id", "block", "fold", *[F.round(f"{k}_{s}", 6).alias(f"{k}_{s}") for k in _TARGETS for s in ("predicted", "held")])


@query()
def geo_importance_cv(spark, d):
    """How well roads of other blocks predict each score."""
    return baselines.held_out_scores(_important(spark, d), _TARGETS)


def _learning(spark: SparkSession, d: str) -> DataFrame:
    """Frames with densities of detections and the score of the true boxes and roughness."""
    said = pavement.scored(_densities(spark, d)).select("image_id", "segment_id", *[f"{p}_{k}" for k in c.CLASSES for p in ("rho", "dv")])
    true = t.all_boxes(spark, d).where("flag = 'R'")
    truth = pavement.scored(pavement.frame_density(true, pavement.with_defaults(pavement.cutoffs(true)), t.frames(spark, d)))
    ride = t.read(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"), x.ride(F.col("o_totalprice") / 50000).alias("ride"))
    icv = truth.join(ride, "image_id").select("image_id", "ride", x.icv(F.col("pci_vis"), F.col("ride")).alias("icv"))
    return said.join(icv, "image_id").withColumn("split", _split(F.col("segment_id"))).where("split <> 'train'")


@query()
def sco_b2(spark, d):
    """The score of each segment by trees over its frames' detections."""
    features = [f"{p}_{k}" for k in c.CLASSES for p in ("rho", "dv")]
    return baselines.boosted(_learning(spark, d), features).withColumn("icv", F.round("icv", 6))


@query()
def sco_c1(spark, d):
    """The score of each segment by trees over its surroundings only, which say nothing about it."""
    around = _roads(spark, d).select(F.col("id").alias("segment_id"), *_PLACE)
    return baselines.boosted(_learning(spark, d).select("image_id", "segment_id", "split", "icv").join(around, "segment_id", "left"), _PLACE).withColumn("icv", F.round("icv", 6))

# ---- lists

_NEGATIVES, _VAL, _SEED = 0.2, 50, 42
_LISTS = (
    f"im AS (SELECT image_id, 'img/' || image_id || '.jpg' AS path, image_id % 3 = 0 AS has_damage, {_SPLIT} AS split FROM frames), h AS (SELECT *, md5(image_id || '-{_SEED}') AS h FROM im), "
    f"n AS (SELECT path FROM (SELECT *, row_number() OVER (ORDER BY h, image_id) AS r FROM h WHERE split = 'train' AND NOT has_damage) WHERE r <= (SELECT floor({_NEGATIVES} * count(*) / {1 - _NEGATIVES} + 1e-9) FROM im WHERE split = 'train' AND has_damage)), "
    f"v AS (SELECT path FROM (SELECT *, row_number() OVER (ORDER BY h, image_id) AS r FROM h WHERE split = 'fusion') WHERE r <= {_VAL})"
)


@query(
    f"+{_LISTS} SELECT 'train' AS list, path FROM im WHERE split = 'train' AND has_damage UNION ALL SELECT 'train', path FROM n UNION ALL SELECT 'val', path FROM v "
    "UNION ALL SELECT split, path FROM im WHERE split <> 'train' UNION ALL SELECT 'all', path FROM im",
    "frames",
)
def prep_lists(spark, d):
    """Paths of the photos of each list; of those for training at most a fifth show no damage."""
    f = t.frames(spark, d)
    i = F.col("image_id")
    photos = f.select("image_id", F.concat(F.lit("img/"), i.cast("string"), F.lit(".jpg")).alias("path"), (i % 3 == 0).alias("has_damage"))
    return images.lists(photos, f.select("image_id", _split(F.col("segment_id")).alias("split")), _NEGATIVES, _VAL, _SEED)


# ---- domain


@query()
def ev_domain(spark, d):
    """How well eight components of vectors tell each of two batches from the rest; of one, a component is moved."""
    e = t.read(spark, d, "embeddings").select("vec_id", *[F.get("embedding", F.lit(i)).alias(f"c{i}") for i in range(8)])
    batch = F.when(F.col("vec_id") % 10 == 1, "same").when(F.col("vec_id") % 10 == 2, "moved")
    batches = e.withColumn("batch", batch).where("batch IS NOT NULL").withColumn("c0", F.when(F.col("batch") == "moved", F.col("c0") + 0.2).otherwise(F.col("c0")))
    return domain.auroc(e.where("vec_id % 10 NOT IN (1, 2)"), batches, "batch", "vec_id", [f"c{i}" for i in range(8)]).withColumn("auroc", F.round("auroc", 6))
