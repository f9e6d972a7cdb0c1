"""Tracks against brute force: pieces of time, ties, nulls, repeats, empty tables, long runs, and a GPX file end to end."""

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pavescope.operators import grouped, tracks
from pavescope.sources import files

FIXES = "user_id long, event_id long, us long, lat double, lon double, value double, speed double, sat int"


def made(spark, seed=3, n=400):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        user = [None, 1, 2, 3][i % 4]
        value = None if i % 17 == 0 else float(rng.integers(0, 50))
        rows.append((user, i, int(rng.integers(0, 400)) * 50_000, float(4.6 + rng.integers(0, 99) / 1e5), float(-74.1 + rng.integers(0, 99) / 1e5), value, float(rng.integers(0, 9)), i % 20))
    return rows + [(1, 5000, None, 4.6, -74.1, 1.0, 1.0, 1), (9, 6000, 77, 4.6, -74.1, 1.0, 1.0, 3)]


@pytest.mark.parametrize("piece", [1, 700_000, tracks.PIECE_US])
def test_medians(spark, piece):
    rows = made(spark)
    half = 250_000
    got = {r["event_id"]: r["smooth"] for r in tracks.smoothed(spark.createDataFrame(rows, FIXES), half, piece_us=piece).collect()}
    assert len(got) == len(rows)
    for r in rows:
        own = [s[5] for s in rows if s[0] == r[0] and r[2] is not None and s[2] is not None and r[2] - half < s[2] <= r[2] + half and s[5] is not None]
        assert got[r[1]] == (np.median(own) if own else None)


@pytest.mark.parametrize("piece", [1, 700_000, tracks.PIECE_US])
def test_distance_and_stretches(spark, piece):
    rows = [r for r in made(spark) if r[2] is not None]
    got = tracks.stretches(tracks.cumulative(spark.createDataFrame(rows, FIXES), piece_us=piece), 900.0, 5)
    got = {r["event_id"]: (r["dist_m"], r["stretch"]) for r in got.collect()}
    for user in (None, 1, 2, 3, 9):
        own = sorted((r for r in rows if r[0] == user), key=lambda r: (r[2], r[1]))
        lat, lon = np.radians([r[3] for r in own]), np.radians([r[4] for r in own])
        a = np.sin(np.diff(lat) / 2) ** 2 + np.cos(lat[:-1]) * np.cos(lat[1:]) * np.sin(np.diff(lon) / 2) ** 2
        dist = np.r_[0, np.cumsum(2 * 6_371_000 * np.arcsin(np.sqrt(a)))]
        assert np.allclose([got[r[1]][0] for r in own], dist, atol=1e-6)
        cells, dense, counts = np.unique(np.floor(dist / 900), return_inverse=True, return_counts=True)
        if len(cells) > 1 and counts[-1] < 5:
            dense = np.where(dense == len(cells) - 1, dense - 1, dense)
        assert [got[r[1]][1] for r in own] == dense.tolist()


@pytest.mark.parametrize("piece", [1, 700_000, tracks.PIECE_US])
def test_as_of(spark, piece):
    rows = [r[:5] + (float(r[5] or 0),) + r[6:] for r in made(spark)]
    queries = [(u, 10 * i + j, int(us)) for j, u in enumerate((None, 1, 2, 3, 8, 9)) for i, us in enumerate([-5, 0, 77, 123_456, 5_000_000, 5_000_000, 19_950_000, 99_000_000])]
    track, asked = spark.createDataFrame(rows, FIXES), spark.createDataFrame(queries, "user_id long, query long, us long")
    got = {r["query"]: r for r in tracks.interpolated(track, asked, piece).collect()}
    assert len(got) == len(queries)
    for user, query, us in queries:
        own = {r[2]: r[5] for r in sorted(rows, key=lambda r: r[1]) if r[0] == user and r[2] is not None}
        r = got[query]
        if not own:
            assert (r["value"], r["nearest_us"], r["inside"]) == (None, None, False)
            continue
        x = np.array(sorted(own))
        assert np.isclose(r["value"], np.interp(us, x, [own[k] for k in x.tolist()]))
        assert r["nearest_us"] == x[np.abs(x - us).argmin()] and r["inside"] == bool(x[0] <= us <= x[-1])


def test_empty_tracks(spark):
    track, asked = spark.createDataFrame([], FIXES), spark.createDataFrame([(1, 1, 5)], "user_id long, query long, us long")
    assert tracks.smoothed(track, 5).count() == 0 and tracks.cumulative(track).count() == 0
    assert tracks.interpolated(track, asked).first()["value"] is None
    assert tracks.interpolated(track, asked.limit(0)).count() == 0


def test_a_long_run_spreads_over_tasks(spark):
    """A run of a million fixes: linear time, and no task holds more than some of it."""
    n = 1_000_000
    track = spark.range(n).select(F.lit(1).alias("user_id"), F.col("id").alias("event_id"), (F.col("id") * 1_000_000).alias("us"), (F.col("id") % 1000).cast("double").alias("value"))
    asked = spark.range(n // 10).select(F.lit(1).alias("user_id"), F.col("id").alias("query"), (F.col("id") * 10_000_000 + 500_000).alias("us"))
    began = time.time()
    got = tracks.interpolated(track, asked)
    parts = got.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in parts) == n // 10
    smooth = tracks.smoothed(track, 2_500_000)
    sizes = [r["count"] for r in smooth.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == n and max(sizes) < n // 2
    assert time.time() - began < 60


def test_whole_groups():
    table = pa.table({"k": [1, 1, 1, 2, None, None, 3], "v": range(7)})
    for size in range(1, 8):
        parts = list(grouped.whole_groups(table.to_batches(max_chunksize=size), ["k"]))
        assert pa.concat_tables(parts).equals(table)
        assert sum(len(grouped.starts(p, ["k"])) - 1 for p in parts) == 4


def test_gpx_file_to_positions(spark, tmp_path):
    """Points of a file, smoothed, measured, and read at photo times."""
    n = 30
    point = lambda i: f'<trkpt lat="{4.6 + i * 1e-5:.7f}" lon="-74.1"><ele>2600.5</ele><time>2024-03-01T10:00:{i:02d}Z</time>' + (f"<speed>{i}.0</speed><sat>{i % 12}</sat>" if i != 7 else "") + "</trkpt>"
    (tmp_path / "t.gpx").write_text('<?xml version="1.0"?><gpx xmlns="http://www.topografix.com/GPX/1/0"><trk><trkseg>' + "".join(map(point, range(n))) + "</trkseg></trk></gpx>")
    fixes = files.read_gpx(spark, str(tmp_path / "t.gpx")).select(F.lit("t").alias("user_id"), F.unix_micros("timestamp").alias("us"), "lat", "lon", "speed", "sat").withColumn("event_id", F.col("us"))
    zero = fixes.agg(F.min("us")).first()[0]
    asked = spark.createDataFrame([("t", k, zero + int(s * 1e6)) for k, s in enumerate((-3, 10, 12.25, 99))], "user_id string, query long, us long")
    got = {r["query"]: r for r in tracks.located(fixes, asked, 2_500_000).collect()}
    lat = 4.6 + np.arange(n) * 1e-5
    smooth = np.array([np.median(lat[max(0, i - 2) : i + 3]) for i in range(n)])
    metres = np.r_[0, np.cumsum(np.radians(np.diff(smooth)) * 6_371_000)]
    assert np.isclose(got[1]["lat"], smooth[10]) and got[1]["sat"] == 10 and got[1]["inside"] and got[1]["gps_dt_s"] == 0
    assert np.isclose(got[2]["dist_m"], np.interp(12.25, np.arange(n), metres), atol=1e-4) and np.isclose(got[2]["speed"], 12.25) and np.isclose(got[2]["gps_dt_s"], 0.25)
    assert not got[0]["inside"] and np.isclose(got[0]["lat"], smooth[0]) and not got[3]["inside"] and np.isclose(got[3]["dist_m"], metres[-1], atol=1e-4)
