"""Map matching: points projected on road lines, sections along them, and the vibration factor with one road left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import sampling

#: Metres of a degree of latitude on the sphere that distances use.
DEGREE = 6_371_000.0 * 3.141592653589793 / 180
#: Metres of a section, metres to a road that a point is on, its share of a trip's points.
SECTION_M, REACH_M, SHARE = 200.0, 15.0, 0.2


def segments(lines: DataFrame) -> DataFrame:
    """road, part, ends (lat0, lon0, lat1, lon1), length_m and from_m (metres along the road) of each segment of lines (road, seq, lat, lon).

    Vertices stand by seq; those without a coordinate are left out. A road has a window of its own, in order of seq.
    """
    road = Window.partitionBy("road").orderBy("seq")
    ends = lines.dropna(subset=["lat", "lon"]).select("road", "seq", F.col("lat").alias("lat0"), F.col("lon").alias("lon0"), F.lead("lat").over(road).alias("lat1"), F.lead("lon").over(road).alias("lon1"))
    ends = ends.where("lat1 IS NOT NULL").withColumn("length_m", flat_m(F.col("lat0"), F.col("lon0"), F.col("lat1"), F.col("lon1")))
    return ends.withColumn("from_m", F.sum("length_m").over(road) - F.col("length_m")).withColumnRenamed("seq", "part")


def flat_m(lat0: Column, lon0: Column, lat1: Column, lon1: Column) -> Column:
    """Metres between near points, in the plane that touches the earth at the first."""
    return F.hypot((lat1 - lat0) * DEGREE, (lon1 - lon0) * DEGREE * F.cos(F.radians(lat0)))


def matched(points: DataFrame, lines: DataFrame, reach_m: float = REACH_M) -> DataFrame:
    """points (id, lat, lon and more) with road, at_m (metres along it) and off_m of the nearest place on each road within reach_m.

    A point is projected on the segments of the cells around it: segments are dealt to all cells of reach_m (and more)
    that their box meets, so the join is on equality. Of a road, the nearest segment counts, the earlier on ties. Points
    on no road, or without a coordinate, are left out. Segments are short beside the earth; roads must not cross the date line.
    """
    size = max(10 * reach_m, 100.0) / DEGREE
    cell = lambda v: F.floor(v / size)
    margin = reach_m / DEGREE
    wide = margin / F.cos(F.radians(F.greatest(F.abs("lat0"), F.abs("lat1")))) * 1.001
    span = lambda a, b, m: F.explode(F.sequence(cell(F.least(a, b) - m), cell(F.greatest(a, b) + m)))
    dealt = segments(lines).withColumn("_row", span("lat0", "lat1", margin * 1.001)).withColumn("_column", span("lon0", "lon1", wide))
    here = points.dropna(subset=["lat", "lon"]).withColumn("_row", cell(F.col("lat"))).withColumn("_column", cell(F.col("lon")))
    both = here.join(dealt, ["_row", "_column"])
    shrink = DEGREE * F.cos(F.radians("lat0"))
    dx, dy = (F.col("lon1") - F.col("lon0")) * shrink, (F.col("lat1") - F.col("lat0")) * DEGREE
    px, py = (F.col("lon") - F.col("lon0")) * shrink, (F.col("lat") - F.col("lat0")) * DEGREE
    share = F.coalesce(F.try_divide(px * dx + py * dy, dx * dx + dy * dy), F.lit(0.0))
    share = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))
    both = both.withColumn("_t", share).withColumn("off_m", F.hypot(px - F.col("_t") * dx, py - F.col("_t") * dy)).where(F.col("off_m") <= reach_m)
    best = F.min_by(F.struct(*points.columns, (F.col("from_m") + F.col("_t") * F.col("length_m")).alias("at_m"), "off_m"), F.struct("off_m", "part"))
    return both.groupBy(F.col("id").alias("_id"), "road").agg(best.alias("b")).select("road", "b.*")


def trips_on_roads(points: DataFrame, lines: DataFrame, reach_m: float = REACH_M, share: float = SHARE) -> DataFrame:
    """matched() rows of the trips that follow a road: share of their points or more are on it, and they go along it.

    points: id, trip, us, lat, lon and more. A trip goes along a road if the median of its steps there, those of no metre
    left out, is forward.
    """
    on = matched(points, lines, reach_m)
    trip = Window.partitionBy("trip", "road").orderBy("us", "id")
    steps = on.withColumn("_step", F.col("at_m") - F.lag("at_m").over(trip)).where("_step != 0").select("trip", "road", "_step")
    forward = sampling.quantiles(steps, "_step", {"_m": 0.5}, ["trip", "road"]).where("_m > 0").select("trip", "road")
    all_ = points.groupBy("trip").agg(F.count(F.lit(1)).alias("_all"))
    often = on.groupBy("trip", "road").agg(F.count(F.lit(1)).alias("_on")).join(all_, "trip").where(F.col("_on") >= share * F.col("_all")).select("trip", "road")
    return on.join(often.join(forward, ["trip", "road"]), ["trip", "road"], "left_semi")


def sections(on: DataFrame, length_m: float = SECTION_M) -> DataFrame:
    """rows of matched() with the section of their road."""
    return on.withColumn("section", F.floor(F.col("at_m") / length_m).cast("long"))


def left_out_factor(rows: DataFrame, known: str, base: str, fold: str) -> DataFrame:
    """rows with ``predicted``: base times the factor that fits the other folds, exp(median(ln known - ln base)).

    Rows where either is not above zero take no part in a fit. There is a fit for each fold, over the rows of all others:
    folds are few. Rows without others have null.
    """
    named = F.to_json(F.struct(F.col(fold).alias("f")))  # never null
    logs = rows.where((F.col(known) > 0) & (F.col(base) > 0)).select(named.alias("_of"), (F.ln(known) - F.ln(base)).alias("_l"))
    names = rows.select(named.alias("_fold")).distinct()
    # a row a fold
    others = logs.join(F.broadcast(names), F.col("_of") != F.col("_fold"))
    fits = sampling.quantiles(others, "_l", {"_m": 0.5}, ["_fold"]).select("_fold", F.exp("_m").alias("_k"))
    return rows.join(F.broadcast(fits), named == fits["_fold"], "left").withColumn("predicted", F.col("_k") * F.col(base)).drop("_fold", "_k")
