"""Proximity by cells and ranks against a reference population."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as c
from ..functions import exprs as x
from ..session import cut
from . import sampling

#: A little less than the metres of a degree of latitude.
DEGREE_M = 110_000.0


def _cell(row: Column, radius: float) -> Column:
    """Columns that a row of cells has around the earth: none narrower than radius, nor in the rows beside it; one near the poles."""
    shrink = F.cos(F.radians(F.least((F.abs(row) + 2) * radius / DEGREE_M, F.lit(90.0))))
    return F.when(shrink < 20 * radius / 6_371_000.0, 1).otherwise(F.greatest(F.floor(360 * DEGREE_M * shrink / radius), F.lit(1))).cast("long")


def _column(lon: Column, columns: Column) -> Column:
    return F.least(F.floor(F.pmod(lon + 180, F.lit(360.0)) / 360 * columns).cast("long"), columns - 1)


def pairs_within(points: DataFrame, refs: DataFrame, radius: float) -> DataFrame:
    """Points with each reference (columns ref_*) within radius metres and their distance d: an equi-join over cells.

    Cells are as wide as the radius at every latitude and go around the date line. Rows with a null or NaN coordinate take no part.
    """
    known = lambda df: df.where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon"))
    row = F.floor(F.col("lat") * DEGREE_M / radius).cast("long")
    q = known(points).withColumn("_row", F.explode(F.array(*[row + d for d in (-1, 0, 1)]))).withColumn("_n", _cell(F.col("_row"), radius))
    around = F.array_distinct(F.array(*[F.pmod(_column(F.col("lon"), F.col("_n")) + d, F.col("_n")) for d in (-1, 0, 1)]))
    r = known(refs).select(*[F.col(k).alias(f"ref_{k}") for k in refs.columns], row.alias("_row"))
    r = r.withColumn("_column", _column(F.col("ref_lon"), _cell(F.col("_row"), radius)))
    d = x.haversine(F.col("lat"), F.col("lon"), F.col("ref_lat"), F.col("ref_lon"))
    return q.withColumn("_column", F.explode(around)).join(r, ["_row", "_column"]).withColumn("d", d).where(F.col("d") <= radius).drop("_row", "_column", "_n")


def _spots(points: DataFrame) -> DataFrame:
    """Each place of points once; rows without a coordinate have none."""
    return points.where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon")).select("lat", "lon").distinct()


def _places(refs: DataFrame, weight: str | None = None) -> DataFrame:
    """Each place of refs once: its least id, how many there are (n) and, with weight, their sum of it."""
    more = [F.sum(weight).alias("weight")] if weight else []
    return refs.groupBy("lat", "lon").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), *more)


def _dealt(spots: DataFrame, places: DataFrame, radius: float) -> DataFrame:
    """pairs_within() in as many tasks as a shuffle has: small tables make many pairs, which sizes in bytes do not tell."""
    n = int(spots.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs_within(spots.repartition(n), places, radius)


def within(points: DataFrame, refs: DataFrame, radius: float, weight: str | None = None) -> DataFrame:
    """Per point: id, n references within radius metres, the distance of the nearest of them (null if none) and, with weight, their sum of it.

    Points of one place, and references of one place, are judged once.
    """
    more = [F.sum("ref_weight").alias("weight")] if weight else []
    near = _dealt(_spots(points), _places(refs, weight), radius).groupBy("lat", "lon").agg(F.sum("ref_n").alias("n"), F.min("d").alias("nearest_m"), *more)
    zero = [F.coalesce("weight", F.lit(0)).alias("weight")] if weight else []
    return points.select("id", "lat", "lon").join(near, ["lat", "lon"], "left").select("id", F.coalesce("n", F.lit(0)).alias("n"), "nearest_m", *zero)


def _nearest(spots: DataFrame, places: DataFrame, radius: float) -> DataFrame:
    """lat, lon, ref_id and nearest_m of spots, null without places. Rings of eight times the radius follow for the spots that have found none."""
    found, left = [], spots
    while True:
        best = F.min(F.struct("d", F.col("ref_id"))).alias("b")
        here = cut(_dealt(left, places, radius).groupBy("lat", "lon").agg(best).select("lat", "lon", "b.ref_id", F.col("b.d").alias("nearest_m")))
        found.append(here)
        left = cut(left.join(here, ["lat", "lon"], "left_anti"))
        if radius > 2.1e7 or left.isEmpty():
            break
        radius *= 8
    every = reduce(DataFrame.unionByName, found)
    return every.unionByName(left.select("lat", "lon", F.lit(None).cast(places.schema["id"].dataType).alias("ref_id"), F.lit(None).cast("double").alias("nearest_m")))


def nearest(points: DataFrame, refs: DataFrame, radius: float = 500.0) -> DataFrame:
    """id, ref_id and distance of the nearest reference of every point, however far (ties to the least ref_id); null without references.

    Points of one place, and references of one place, are judged once.
    """
    found = _nearest(_spots(points), cut(_places(refs)), radius)
    return points.select("id", "lat", "lon").join(found, ["lat", "lon"], "left").select("id", "ref_id", "nearest_m")


def percentile_of(values: DataFrame, refs: DataFrame, value: str, ref: str, name: str) -> DataFrame:
    """100 * share of the reference population at or below each value; null without references. From counts of distinct values, ranged over tasks."""
    counts = refs.where(F.col(ref).isNotNull()).groupBy(F.col(ref).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("k"))
    steps = values.select(F.col(value).cast("double").alias("v")).distinct().withColumn("k", F.lit(0).cast("long")).unionByName(counts).groupBy("v").agg(F.sum("k").alias("k"))
    upto = sampling.running(steps.where("v IS NOT NULL"), ["v"], "k", "before").crossJoin(F.broadcast(counts.agg(F.sum("k").alias("all"))))  # one row
    upto = upto.select("v", F.try_divide(100 * (F.col("before") + F.col("k")), F.col("all")).alias(name))
    return values.join(upto, values[value].cast("double") == upto["v"], "left").drop("v")


def _around(spots: DataFrame, refs: DataFrame, prefix: str, radii: tuple[float, ...], weight: str | None = None) -> DataFrame:
    """lat, lon and the columns of around() of each spot."""
    of = lambda r, k: F.sum(F.when(F.col("d") <= r, F.col(k)))
    more = [of(r, "ref_weight").cast("double").alias(f"{prefix}_pond_{r}m") for r in radii] if weight else []
    places, widest = cut(_places(refs, weight)), float(max(radii))
    near = cut(_dealt(spots, places, widest).groupBy("lat", "lon").agg(F.min("d").alias("_m"), *[of(r, "ref_n").alias(f"{prefix}_{r}m") for r in radii], *more))
    far = _nearest(cut(spots.join(near, ["lat", "lon"], "left_anti")), places, 8 * widest).select("lat", "lon", F.col("nearest_m").alias("_far"))
    out = spots.join(near, ["lat", "lon"], "left").fillna(0, [k for k in near.columns if k not in ("lat", "lon", "_m")])
    return out.join(far, ["lat", "lon"], "left").withColumn(f"dist_{prefix}_m", F.coalesce("_m", "_far")).drop("_m", "_far")


def around(points: DataFrame, refs: DataFrame, prefix: str, radii: tuple[float, ...], weight: str | None = None) -> DataFrame:
    """id, dist_<prefix>_m (of the nearest reference, however far), <prefix>_<r>m (how many within r metres) and, with weight, <prefix>_pond_<r>m (their sum of it).

    All radii come from one join at the widest of them. Points without a coordinate, and all where there are no references,
    have a null distance and zeros. Points of one place, and references of one place, are judged once.
    """
    found = _around(cut(_spots(points)), refs, prefix, radii, weight)
    return points.select("id", "lat", "lon").join(found, ["lat", "lon"], "left").drop("lat", "lon").fillna(0, [k for k in found.columns if k not in ("lat", "lon", f"dist_{prefix}_m")])


def context(points: DataFrame, schools: DataFrame, health: DataFrame, crashes: DataFrame) -> DataFrame:
    """Surroundings of points (id, lat, lon): schools, health centres, hospitals (health.hospital) and crashes of the last years (crashes.anio, peso), and the centre's distance.

    The last years are CRASH_YEARS up to the latest year that any crash has; crashes without a year are left out.
    All is found for each place once and joined to the points at the end.
    """
    latest = crashes.agg(F.max("anio").alias("_latest"))
    recent = crashes.crossJoin(F.broadcast(latest)).where(F.col("anio") >= F.col("_latest") - c.CRASH_YEARS + 1).drop("_latest")  # one row
    groups = (("colegio", schools, None), ("ips", health, None), ("hospital", health.where("hospital"), None), ("siniestros", recent, "peso"))
    spots = cut(_spots(points))
    found = spots
    for prefix, refs, weight in groups:
        found = cut(found.join(_around(spots, refs, prefix, c.RADII[prefix], weight), ["lat", "lon"]))
    names = [k for k in found.columns if k not in ("lat", "lon")]
    out = points.join(found, ["lat", "lon"], "left").fillna(0, [k for k in names if not k.startswith("dist_")]).select(*points.columns, *names)
    return out.withColumn("dist_centro_m", x.haversine(F.col("lat"), F.col("lon"), F.lit(c.CENTRE[0]), F.lit(c.CENTRE[1])))


def whole_priority(segments: DataFrame, roads: DataFrame) -> DataFrame:
    """segments with their percentile scores, importance, priority and level, what is missing filled first.

    segments: id, icv, dim_social, malla, rutas, crashes, rain, school_m, hospital_m. roads, the reference of social value and
    mobility: dim_social, malla, rutas. Missing social values and mobility take the roads' median, missing rain the segments'
    median, missing crashes 0; a missing distance earns nothing. Scores of crashes and rain are among the segments' own known values.
    """
    moved = lambda df: df.withColumn("_moved", F.col("malla") + F.col("rutas"))
    roads, own = moved(roads), moved(segments)
    middle = lambda df, k: sampling.quantiles(df, k, {f"_mid_{k}": 0.5})
    mids = middle(roads, "dim_social").crossJoin(middle(roads, "_moved")).crossJoin(middle(segments, "rain"))  # one row each
    fills = {"_s": F.coalesce("dim_social", "_mid_dim_social"), "_m": F.coalesce("_moved", "_mid__moved"), "_c": F.coalesce("crashes", F.lit(0)), "_r": F.coalesce("rain", "_mid_rain")}
    out = own.crossJoin(F.broadcast(mids)).withColumns(fills)
    for value, refs, ref, name in (("_s", roads, "dim_social", "social"), ("_m", roads, "_moved", "mobility"), ("_c", segments, "crashes", "safety"), ("_r", segments, "rain", "score_rain")):
        out = percentile_of(out, refs, value, ref, name)
    ranked = out.select(*[k for k in segments.columns if k != "rain"], "social", "mobility", "safety", F.col("score_rain").alias("rain"))
    return priority(ranked).withColumnRenamed("rain", "score_rain")


def priority(segments: DataFrame) -> DataFrame:
    """importance, priority (0 to 100) and level of segments with icv, social, mobility, safety, rain (0 to 100), school_m and hospital_m."""
    importance = (0.4 * F.col("social") + 0.35 * F.col("mobility") + 0.25 * F.col("safety")) / (0.4 + 0.35 + 0.25)
    extra = F.when(F.col("school_m") <= 300, 5).otherwise(0) + F.when(F.col("hospital_m") <= 1000, 5).otherwise(0) + F.when((F.col("rain") >= 75) & x.state(F.col("icv")).isin("malo", "muy_malo"), 3).otherwise(0)
    out = segments.withColumn("importance", importance)
    out = out.withColumn("priority", F.least(F.greatest(0.6 * (100 - F.col("icv")) + 0.4 * F.col("importance") + extra, F.lit(0.0)), F.lit(100.0)))
    return out.withColumn("level", F.when(F.col("priority") >= 60, "alta").when(F.col("priority") >= 40, "media").otherwise("baja"))
