"""Points in polygons with holes, the nearest edge where a point is in none, and the polygon that most photos of a stretch are in.

Polygons are dealt edge by edge. An edge lies in the cells that its box meets, for distances; for the ray to the east it is
needed by the points of its rows to the west of it, and there a column only has to know how often a polygon's edges cross.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import cut

#: Metres of a degree, as the distance to the nearest polygon is judged; metres to it that still count.
FLAT_DEGREE, NEAR_M = 111_000.0, 15.0


def edges(polygons: DataFrame) -> DataFrame:
    """polygon and ends (x0, y0, x1, y1) of all edges. polygons: polygon and rings, an array of rings (holes too), each an array of [lon, lat], open or closed."""
    ring = F.col("_ring")
    ends = F.transform(F.sequence(F.lit(1), F.size(ring)), lambda i: F.struct(F.get(ring, i - 1).alias("a"), F.get(ring, F.pmod(i, F.size(ring))).alias("b")))
    rows = polygons.select("polygon", F.explode("rings").alias("_ring")).where(F.size(ring) > 0).select("polygon", F.explode(ends).alias("e"))
    xy = lambda p, i: F.get(F.col(f"e.{p}"), F.lit(i))
    return rows.select("polygon", xy("a", 0).alias("x0"), xy("a", 1).alias("y0"), xy("b", 0).alias("x1"), xy("b", 1).alias("y1")).where("x0 IS NOT NULL AND y0 IS NOT NULL AND x1 IS NOT NULL AND y1 IS NOT NULL AND (x0 != x1 OR y0 != y1)")


def _known(points: DataFrame) -> DataFrame:
    return points.where("lon IS NOT NULL AND lat IS NOT NULL AND NOT isnan(lon) AND NOT isnan(lat)")


def holding(points: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """id and polygon of all polygons that hold each point (id, lon, lat; ids are unique), holes left out; points on an edge may fall on either side.

    Per polygon and row of cells, the columns between its first and last edge are the ones whose points may be inside. A
    point meets the edges of its own cell one by one; of the cells further east in its row it needs the parity of the
    crossings at its own height, and those edges that begin or end inside the row are the few that it meets as well.
    """
    e = edges(polygons)
    row = lambda v: F.floor(v / cell)
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    dealt = e.withColumn("_row", F.explode(F.sequence(row(low), row(high))))
    # an edge that passes the whole row crosses the ray of every point west of it; others are met one by one
    left, right = F.least("x0", "x1"), F.greatest("x0", "x1")
    bottom, top = F.col("_row") * cell, (F.col("_row") + 1) * cell
    at = lambda y: F.col("x0") + (F.least(F.greatest(y, low), high) - F.col("y0")) * F.try_divide(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    flat = F.col("y0") == F.col("y1")
    first = row(F.when(flat, left).otherwise(F.least(at(bottom), at(top))))
    last = row(F.when(flat, right).otherwise(F.greatest(at(bottom), at(top))))
    dealt = dealt.where(~flat).withColumn("_first", first - 1).withColumn("_last", last + 1).withColumn("_whole", (low <= bottom) & (high > top))
    whole, part = dealt.where("_whole"), dealt.where("NOT _whole")
    spans = dealt.groupBy("polygon", "_row").agg(F.min("_first").alias("_from"), F.max("_last").alias("_to"))
    cells = spans.withColumn("_column", F.explode(F.sequence("_from", "_to"))).select("polygon", "_row", "_column")
    # crossings by whole edges that lie east of a column, counted by column from the east
    ends = whole.groupBy("polygon", "_row", F.col("_first").alias("_column")).agg(F.count(F.lit(1)).alias("_k"))
    further = Window.partitionBy("polygon", "_row").orderBy(F.desc("_column")).rowsBetween(Window.unboundedPreceding, -1)
    ahead = cells.join(ends, ["polygon", "_row", "_column"], "left").select("polygon", "_row", "_column", F.coalesce(F.sum("_k").over(further), F.lit(0)).alias("_ahead"))
    here = _known(points).select("id", "lon", "lat", row(F.col("lat")).alias("_row"), row(F.col("lon")).alias("_column")).distinct()
    base = here.join(ahead, ["_row", "_column"]).select("id", "polygon", F.col("_ahead").alias("_n"))
    # edges whose cells hold the point, and edges that only pass part of the row: one by one
    near = whole.withColumn("_column", F.explode(F.sequence("_first", "_last"))).select("polygon", "_row", "_column", "x0", "y0", "x1", "y1")
    reach = part.join(spans.select("polygon", "_row", "_from"), ["polygon", "_row"]).withColumn("_column", F.explode(F.sequence("_from", "_last"))).select("polygon", "_row", "_column", "x0", "y0", "x1", "y1")
    met = here.join(near.unionByName(reach), ["_row", "_column"]).select("id", "polygon", crosses(F.col("lon"), F.col("lat")).cast("long").alias("_n"))
    return base.unionByName(met).groupBy("id", "polygon").agg(F.sum("_n").alias("_n")).where("_n % 2 = 1").select("id", "polygon")


def crosses(lon: Column, lat: Column) -> Column:
    """1 where the ray to the east of a point crosses the edge x0, y0, x1, y1, else 0."""
    spans = (F.col("y0") > lat) != (F.col("y1") > lat)
    east = lon < F.try_divide((F.col("x1") - F.col("x0")) * (lat - F.col("y0")), F.col("y1") - F.col("y0")) + F.col("x0")
    return F.when(spans & east, 1).otherwise(0)


def nearest_edges(points: DataFrame, polygons: DataFrame, reach_m: float = NEAR_M) -> DataFrame:
    """id, polygon and away_m of the polygon whose edge is nearest to each point, within reach_m; the least polygon on ties.

    Distances are those of degrees, FLAT_DEGREE metres each, in both directions.
    """
    reach = reach_m / FLAT_DEGREE
    cell = 10 * reach
    span = lambda a, b: F.explode(F.sequence(F.floor((F.least(a, b) - reach) / cell), F.floor((F.greatest(a, b) + reach) / cell)))
    dealt = edges(polygons).withColumn("_row", span("y0", "y1")).withColumn("_column", span("x0", "x1"))
    here = _known(points).select("id", "lon", "lat", F.floor(F.col("lat") / cell).alias("_row"), F.floor(F.col("lon") / cell).alias("_column"))
    dx, dy, px, py = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("lon") - F.col("x0"), F.col("lat") - F.col("y0")
    t = F.least(F.greatest((px * dx + py * dy) / (dx * dx + dy * dy), F.lit(0.0)), F.lit(1.0))
    near = here.join(dealt, ["_row", "_column"]).select("id", "polygon", (F.hypot(px - t * dx, py - t * dy) * FLAT_DEGREE).alias("away_m")).where(F.col("away_m") <= reach_m)
    return near.groupBy("id").agg(F.min(F.struct("away_m", "polygon")).alias("b")).select("id", "b.polygon", "b.away_m")


def placed(points: DataFrame, polygons: DataFrame, cell: float, reach_m: float = NEAR_M) -> DataFrame:
    """points (id, lon, lat and more) with the least polygon that holds each, or else the nearest within reach_m; null for others.

    Points of one place are judged once, and so are polygons of the same rings, as the least of them: it stands for the others in both choices.
    """
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shapes = cut(polygons.groupBy("rings").agg(F.min("polygon").alias("polygon")))
    spots = cut(_known(points).select("lon", "lat").distinct().withColumn("id", F.monotonically_increasing_id()).repartition(n))
    inside = cut(holding(spots, shapes, cell).groupBy("id").agg(F.min("polygon").alias("_in")))
    near = nearest_edges(spots.join(inside, "id", "left_anti").repartition(n), shapes, reach_m).select("id", F.col("polygon").alias("_near"))
    found = spots.join(inside, "id", "left").join(near, "id", "left").select("lon", "lat", F.coalesce("_in", "_near").alias("polygon"))
    return points.join(found, ["lon", "lat"], "left").select(*points.columns, "polygon")


def majority(placed_points: DataFrame, group: str) -> DataFrame:
    """group, polygon and share: the polygon that most of a group's placed points are in (the least on ties), and its share of them; null and 0 without any."""
    counts = placed_points.groupBy(group, "polygon").agg(F.count("polygon").alias("_n"))
    best = F.max_by(F.struct("polygon", "_n"), F.struct("_n", -F.col("polygon")))
    out = counts.groupBy(group).agg(best.alias("b"), F.sum("_n").alias("_all"))
    return out.select(group, F.when(F.col("_all") > 0, F.col("b.polygon")).alias("polygon"), F.coalesce(F.try_divide(F.col("b._n"), F.col("_all")), F.lit(0.0)).alias("share"))
