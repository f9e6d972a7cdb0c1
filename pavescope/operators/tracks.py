"""Track, time-series and depth operators. A run is cut into pieces of time, so that a long one spreads over tasks.

What a piece needs of its neighbours is carried to it: the fixes before and after it, the sum of what came earlier,
the rows that its windows reach. Per run, only a row for each piece meets in a task.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import exprs as x
from . import grouped

SECOND = 1_000_000
#: Length of a piece of a run.
PIECE_US = 3600 * SECOND


def sliding_medians(us: np.ndarray, values: np.ndarray, at: np.ndarray, half_us: int) -> np.ndarray:
    """Median of the values with times in (t - half, t + half] for each row t of at; NaN where there are none.

    us is sorted. The window's values are kept in order: each enters and leaves once, by bisection.
    """
    low, high = np.searchsorted(us, us[at] - half_us, side="right").tolist(), np.searchsorted(us, us[at] + half_us, side="right").tolist()
    known, listed = (~np.isnan(values)).tolist(), values.tolist()
    held: list[float] = []
    out, start, end = np.full(len(at), np.nan), 0, 0
    for k, (a, b) in enumerate(zip(low, high)):
        for i in range(end, b):
            if known[i]:
                insort(held, listed[i])
        for i in range(start, a):
            if known[i]:
                del held[bisect_left(held, listed[i])]
        start, end, n = a, b, len(held)
        if n:
            out[k] = (held[(n - 1) // 2] + held[n // 2]) / 2
    return out


def smoothed(track: DataFrame, half_us: int, values: dict[str, str] | None = None, run: str = "user_id", piece_us: int = PIECE_US) -> DataFrame:
    """track with the centred median over (t - half, t + half] of each column of values, under its new name.

    A row goes to its piece of time, and to those whose windows reach it. Null values are left out of medians; rows without a time have none.
    """
    values = values or {"value": "smooth"}
    width = max(piece_us, 2 * half_us)
    own = F.floor(F.col("us") / width)
    dealt = track.where("us IS NOT NULL").withColumn("_piece", F.explode(F.sequence(F.floor((F.col("us") - half_us) / width), F.floor((F.col("us") + half_us) / width)))).withColumn("_own", own == F.col("_piece"))

    def over(table: pa.Table) -> pa.Table:
        edges = grouped.starts(table, [run, "_piece"])
        us, sizes = table.column("us").to_numpy(), np.diff(edges)
        # times of all groups on one line, so far apart that no window meets two of them
        us = us - np.repeat(us[edges[:-1]], sizes)
        span = us[edges[1:] - 1] + 2 * half_us + 1
        us = us + np.repeat(np.cumsum(span) - span, sizes)
        at = np.flatnonzero(table.column("_own").to_numpy(zero_copy_only=False))
        out = table.take(pa.array(at)).drop(["_piece", "_own"])
        for name, new in values.items():
            out = out.append_column(new, pa.array(sliding_medians(us, table.column(name).cast(pa.float64()).to_numpy(), at, half_us), from_pandas=True))
        return out

    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in track.schema] + [f"`{k}` double" for k in values.values()])
    out = grouped.map_groups(dealt, [run, "_piece"], ["us"], over, kinds)
    return out.unionByName(track.where("us IS NULL"), allowMissingColumns=True)


def _pieced(track: DataFrame, piece_us: int) -> DataFrame:
    return track.withColumn("_piece", F.floor(F.col("us") / piece_us))


def cumulative(track: DataFrame, lat: str = "lat", lon: str = "lon", run: str = "user_id", key: str = "event_id", piece_us: int = PIECE_US) -> DataFrame:
    """track with step_m, the metres from the fix before (0 at the first), and dist_m, their running sum; fixes stand by time, then key."""
    pieced = _pieced(track, piece_us)
    last = pieced.groupBy(run, "_piece").agg(F.max(F.struct("us", key, F.col(lat).alias("_lat"), F.col(lon).alias("_lon"))).alias("_last"))
    pieces = Window.partitionBy(run).orderBy("_piece")
    before = last.select(run, "_piece", F.lag("_last").over(pieces).alias("_before"))
    inside = Window.partitionBy(run, "_piece").orderBy("us", key)
    joined = _met(pieced, before, run)
    prior = lambda k, own: F.coalesce(F.lag(own).over(inside), F.when(F.row_number().over(inside) == 1, F.col(f"_before.{k}")))
    stepped = joined.withColumn("step_m", F.coalesce(x.haversine(prior("_lat", lat), prior("_lon", lon), F.col(lat), F.col(lon)), F.lit(0.0))).drop("_before")
    sums = stepped.groupBy(run, "_piece").agg(F.sum("step_m").alias("_sum"))
    ahead = sums.select(run, "_piece", F.coalesce(F.sum("_sum").over(pieces.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_ahead"))
    out = _met(stepped, ahead, run)
    return out.withColumn("dist_m", F.col("_ahead") + F.sum("step_m").over(inside.rowsBetween(Window.unboundedPreceding, 0))).drop("_piece", "_ahead")


def _met(rows: DataFrame, pieces: DataFrame, run: str) -> DataFrame:
    """rows with what pieces says of their run and piece; null runs and times meet too."""
    named = pieces.withColumnsRenamed({run: "_run", "_piece": "_at"})
    return rows.join(named, rows[run].eqNullSafe(named["_run"]) & rows["_piece"].eqNullSafe(named["_at"])).drop("_run", "_at")


def stretches(distances: DataFrame, length: float, least: int, run: str = "user_id") -> DataFrame:
    """Stretches of a length, renumbered without gaps; a short last one joins the one before. Per run, a row for each stretch meets in a task."""
    out = distances.withColumn("_piece", F.floor(F.col("dist_m") / length))
    cells = out.groupBy(run, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(run)
    cells = cells.withColumn("_dense", F.row_number().over(whole.orderBy("_piece")) - 1).withColumn("_last", F.count(F.lit(1)).over(whole) - 1)
    short = (F.col("_dense") == F.col("_last")) & (F.col("_n") < least) & (F.col("_last") > 0)
    numbered = cells.select(run, "_piece", F.when(short, F.col("_dense") - 1).otherwise(F.col("_dense")).alias("stretch"))
    return _met(out, numbered, run).drop("_piece")


def bracketed(track: DataFrame, queries: DataFrame, values: list[str], run: str = "user_id", key: str = "event_id", piece_us: int = PIECE_US) -> DataFrame:
    """queries (run, query, us and more) with a and b: the fixes (us and values) at or before, and at or after each; null where there is none.

    An as-of join both ways. Fixes and queries meet in pieces of time; a piece that has queries gets the last fix before
    it and the first after it. Of fixes of one time the one of the greatest key counts. Fixes without a time are left out.
    """
    fix = F.struct("us", *values)
    one = track.where("us IS NOT NULL").groupBy(run, "us").agg(F.max_by(F.struct(*values), key).alias("_v")).select(run, "us", *[F.col(f"_v.{v}").alias(v) for v in values])
    fixes, asked = _pieced(one.select(run, "us", fix.alias("fix")), piece_us), _pieced(queries, piece_us)
    ends = fixes.groupBy(run, "_piece").agg(F.min("fix").alias("_first"), F.max("fix").alias("_last"), F.lit(False).alias("_asked"))
    ends = ends.unionByName(asked.select(run, "_piece", F.lit(None).cast(ends.schema["_first"].dataType).alias("_first"), F.lit(None).cast(ends.schema["_last"].dataType).alias("_last"), F.lit(True).alias("_asked")).distinct())
    ends = ends.groupBy(run, "_piece").agg(F.max("_first").alias("_first"), F.max("_last").alias("_last"), F.max("_asked").alias("_asked"))
    past = Window.partitionBy(run).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    coming = Window.partitionBy(run).orderBy(F.desc("_piece")).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(run, "_piece", "_asked", F.last("_last", True).over(past).alias("_p"), F.last("_first", True).over(coming).alias("_c")).where("_asked")
    carried = carried.select(run, "_piece", F.explode(F.array("_p", "_c")).alias("fix")).where("fix IS NOT NULL").select(run, F.col("fix.us").alias("us"), "fix", "_piece")
    rest = F.struct(*[F.col(k) for k in queries.columns if k not in (run, "us")])
    none = F.lit(None)
    both = fixes.unionByName(carried).withColumn("_query", none.cast(asked.select(rest.alias("r")).schema["r"].dataType))
    both = both.unionByName(asked.select(run, "us", none.cast(fixes.schema["fix"].dataType).alias("fix"), "_piece", rest.alias("_query")))
    inside = Window.partitionBy(run, "_piece")
    back = inside.orderBy("us").rangeBetween(Window.unboundedPreceding, 0)
    ahead = inside.orderBy(F.desc("us")).rangeBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("a", F.last("fix", True).over(back)).withColumn("b", F.last("fix", True).over(ahead)).where("_query IS NOT NULL")
    return out.select(run, "us", "_query.*", "a", "b")


def between(value: str) -> Column:
    """Of bracketed() rows: a value on the line between the fixes, and that of the one fix outside them."""
    share = F.try_divide((F.col("us") - F.col("a.us")).cast("double"), (F.col("b.us") - F.col("a.us")).cast("double"))
    a, b = F.col(f"a.{value}"), F.col(f"b.{value}")
    return F.when(F.col("a").isNull(), b).when(F.col("b").isNull() | (F.col("a.us") == F.col("b.us")), a).otherwise(a + share * (b - a))


def nearer(value: str) -> Column:
    """Of bracketed() rows: the value of the nearest fix, the earlier on ties."""
    to_a, to_b = F.col("us") - F.col("a.us"), F.col("b.us") - F.col("us")
    return F.when(F.col("a").isNull(), F.col(f"b.{value}")).when(F.col("b").isNull() | (to_a <= to_b), F.col(f"a.{value}")).otherwise(F.col(f"b.{value}"))


def interpolated(track: DataFrame, queries: DataFrame, piece_us: int = PIECE_US) -> DataFrame:
    """Value at query times: linear between fixes, clamped outside; and the nearest fix, the earlier on ties."""
    out = bracketed(track, queries, ["value"], piece_us=piece_us)
    return out.select("user_id", "query", "us", between("value").alias("value"), nearer("us").alias("nearest_us"), (F.col("a").isNotNull() & F.col("b").isNotNull()).alias("inside"))


def located(track: DataFrame, queries: DataFrame, half_us: int, run: str = "user_id", key: str = "event_id", piece_us: int = PIECE_US) -> DataFrame:
    """Where each query (run, query, us) was on its run's track (run, key, us, lat, lon, speed, sat).

    lat and lon are smoothed by medians, dist_m runs along the smoothed track; these and speed are read between fixes.
    sat and gps_dt_s are of the nearest fix, inside tells whether the time lies within the track. Queries of runs without
    a fix have nulls, and inside false.
    """
    smooth = cumulative(smoothed(track, half_us, {"lat": "lat_s", "lon": "lon_s"}, run, piece_us), "lat_s", "lon_s", run, key, piece_us)
    out = bracketed(smooth, queries, ["lat_s", "lon_s", "dist_m", "speed", "sat"], run, key, piece_us)
    inside = F.col("a").isNotNull() & F.col("b").isNotNull()
    return out.select(run, "query", "us", between("lat_s").alias("lat"), between("lon_s").alias("lon"), between("dist_m").alias("dist_m"), between("speed").alias("speed"), nearer("sat").alias("sat"), (F.abs(F.col("us") - nearer("us")) / SECOND).alias("gps_dt_s"), inside.alias("inside"))


def depths(track: DataFrame, base: float = 8.0, most: float = 35.0) -> DataFrame:
    """Depth readings with validity, reason, depth below the base and normalised time."""
    d = F.pmod(F.floor("value"), F.lit(60)).cast("double")
    run = Window.partitionBy("user_id")
    out = track.withColumn("cm", d).withColumn("reason", F.when(F.col("cm") <= 0, "lectura_nula").when(F.col("cm") > most, "fuera_de_rango").otherwise(""))
    out = out.withColumn("depth", F.when(F.col("reason") == "", F.col("cm") - base))
    first, last = F.min("us").over(run), F.max("us").over(run)
    return out.withColumn("t_norm", (F.col("us") - first) / F.greatest(last - first, F.lit(SECOND)))


def depth_features(readings: DataFrame) -> DataFrame:
    p95 = F.percentile("depth", F.lit(0.95))
    out = readings.groupBy("user_id").agg(F.max("depth").alias("deepest"), p95.alias("p95"), F.avg("depth").alias("mean"), F.stddev_pop("depth").alias("std"), F.avg((F.col("depth") >= 3).cast("double")).alias("share_3"), F.count("depth").alias("n"))
    severity = F.when(F.col("p95").isNull() | (F.col("p95") < 0), None).when(F.col("p95") < 2.5, "L").when(F.col("p95") < 5, "M").otherwise("H")
    return out.withColumn("severity", severity)


def _greatest(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The greatest of values[low:high] for each pair, NaN where that is empty; from maxima of 1, 2, 4... neighbours, whatever the widths."""
    rows, out, width = [values], np.full(len(low), np.nan), high - low
    while 2 * (step := 1 << (len(rows) - 1)) <= width.max(initial=0):
        rows.append(np.maximum(rows[-1][:-step], rows[-1][step:]))
    for k, row in enumerate(rows):
        at = np.flatnonzero((width >> k) == 1)
        out[at] = np.maximum(row[low[at]], row[high[at] - (1 << k)])
    return out


def near_in_time(queries: DataFrame, readings: DataFrame, reach: float = 0.03, cell: float = 0.05) -> DataFrame:
    """Deepest reading within reach of each query's normalised time.

    Equal times of a run are asked once. A reading goes to the cells of time that its reach meets; there times and readings
    are sorted and maxima looked up, so no time is paired with the readings around it.
    """
    here, slack = lambda t: F.floor(F.col(t) / cell), reach + 1e-9
    times = queries.where("user_id IS NOT NULL AND q IS NOT NULL AND NOT isnan(q)").select("user_id", F.col("q").cast("double").alias("t")).distinct()
    r = readings.where("user_id IS NOT NULL AND depth IS NOT NULL AND t_norm IS NOT NULL AND NOT isnan(t_norm)").join(times.select("user_id").distinct(), "user_id", "left_semi")
    r = r.groupBy("user_id", F.col("t_norm").cast("double").alias("t")).agg(F.max("depth").cast("double").alias("depth"))
    r = r.withColumn("_cell", F.explode(F.sequence(F.floor((F.col("t") - slack) / cell), F.floor((F.col("t") + slack) / cell))))
    both = r.unionByName(times.withColumn("_cell", here("t")), allowMissingColumns=True)

    def over(table: pa.Table) -> pa.Table:
        edges, t = grouped.starts(table, ["user_id", "_cell"]), table.column("t").to_numpy()
        asked = table.column("depth").is_null().to_numpy()
        depth, out = table.column("depth").to_numpy(zero_copy_only=False), np.full(len(t), np.nan)
        for start, end in zip(edges[:-1], edges[1:]):
            at, known = start + np.flatnonzero(asked[start:end]), start + np.flatnonzero(~asked[start:end])
            if len(at) and len(known):
                q, own = t[at], t[known]
                low, high = np.searchsorted(own, q - slack), np.searchsorted(own, q + slack, "right")
                # the few readings between reach and slack go, by the same difference as anywhere
                while (far := (low < high) & (np.abs(own[np.minimum(low, len(own) - 1)] - q) > reach)).any():
                    low += far
                while (far := (low < high) & (np.abs(own[high - 1] - q) > reach)).any():
                    high -= far
                out[at] = _greatest(depth[known], low, high)
        found = np.flatnonzero(asked)
        return table.take(pa.array(found)).select(["user_id", "t"]).append_column("depth", pa.array(out[found], from_pandas=True))

    kind = both.schema["user_id"].dataType.simpleString()
    found = grouped.map_groups(both, ["user_id", "_cell"], ["t"], over, f"user_id {kind}, t double, depth double").withColumnRenamed("t", "q")
    return queries.join(found, ["user_id", "q"], "left").select("user_id", "query", "q", "depth")
