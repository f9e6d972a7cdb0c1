"""Sensor numerics, samples, graph and file formats against brute force, known values and round trips."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pavescope.functions import signals as sg
from pavescope.operators import graph, sampling, sensors
from pavescope.sources import files


def profile_index(spark, heights, dx=0.25, piece=sensors.PIECE):
    rows = [(1, i, float(h)) for i, h in enumerate(heights)]
    return sensors.roughness(spark.createDataFrame(rows, "run long, pos long, height double"), dx, piece).first()["iri"]


def test_roughness(spark):
    assert profile_index(spark, np.zeros(400)) == 0
    rng = np.random.default_rng(3)
    road = np.cumsum(rng.normal(0, 0.002, 800))
    once = profile_index(spark, road)
    assert once > 0 and np.isclose(profile_index(spark, 3 * road), 3 * once)
    assert profile_index(spark, np.zeros(20)) is None
    assert sensors.roughness(spark.createDataFrame([], "run long, pos long, height double"), 0.25).count() == 0


@pytest.mark.parametrize("dx", [0.05, 0.25, 0.4])
def test_roughness_in_pieces(spark, dx):
    """Pieces compose to the whole profile, as a loop over its steps has it; null runs, and null heights as 0."""
    rng = np.random.default_rng(4)
    roads = {None: np.cumsum(rng.normal(0, 0.002, 700)), 2: np.cumsum(rng.normal(0, 0.001, 311)), 3: np.zeros(3)}
    rows = [(run, i, None if i == 7 else float(h)) for run, road in roads.items() for i, h in enumerate(road)]
    frame = spark.createDataFrame(rows, "run long, pos long, height double").repartition(5)
    step, push = sensors.golden_car()
    for piece in (16, 50, sensors.PIECE):
        got = {r["run"]: r["iri"] for r in sensors.roughness(frame, dx, piece).collect()}
        for run, road in roads.items():
            road = road.copy()
            road[7:8] = 0
            reach = round(sensors.STEP / dx) // 2
            smooth = np.array([road[max(0, i - reach) : i + reach + 1].mean() for i in range(len(road))])
            at = np.arange(int(np.ceil((len(road) - 1) * dx / sensors.STEP - 1e-9))) * sensors.STEP
            state, slopes = np.zeros(4), []
            for h in np.interp(at, np.arange(len(road)) * dx, smooth) - road[0]:
                slopes.append(abs(state[1] - state[3]) / sensors.SPEED)
                state = step @ state + push * h
            kept = np.array(slopes)[at >= sensors.LEAD_IN]
            assert (got[run] is None and not len(kept)) or np.isclose(got[run], 1000 * kept.mean(), rtol=1e-9)


def test_roughness_gain_of_a_sine(spark):
    """The gain on a long sine is that of the quarter car's transfer function."""
    wave, high = 20.0, 0.01
    x = np.arange(0, 2000, 0.25)
    got = profile_index(spark, high * np.sin(2 * np.pi * x / wave))
    w = 2j * np.pi * sensors.SPEED / wave
    k1, k2, c, m = sensors.TYRE, sensors.SPRING, sensors.DAMPER, sensors.MASS
    body, wheel = np.linalg.solve(np.array([[w * w + c * w + k2, -(c * w + k2)], [-(c * w + k2), m * w * w + c * w + k1 + k2]]), np.array([0, k1]))
    want = 1000 * abs(w * (body - wheel)) * high / sensors.SPEED * 2 / np.pi
    assert abs(got / want - 1) < 0.03


def test_band_filter_gains():
    """Half power at the edges, one in the middle, none far out; a constant rests; twice over, forth and back, no shift."""
    for low, high in ((0.5, 20.0), (0.2, 15.0)):
        b, a = sg.band_filter(low, high, 50.0)
        gain = lambda f: abs(np.polyval(b, np.exp(2j * np.pi * f / 50)) / np.polyval(a, np.exp(2j * np.pi * f / 50)))  # noqa: B023, E731
        assert np.isclose(gain(low), 2**-0.5) and np.isclose(gain(high), 2**-0.5) and gain(1e-3) < 1e-4 and abs(gain(np.sqrt(low * high)) - 1) < 0.05
        assert np.all(np.abs(np.roots(a)) < 1) and np.allclose(sg.recurred(b, a, np.ones((1, 50))), 0, atol=1e-12)
    at = np.arange(3000) / 50
    tone = np.sin(2 * np.pi * 4 * at)
    assert np.abs(sg.zero_phase(tone, np.array([0, 3000]), *sg.band_filter(0.5, 20.0, 50.0)) - tone)[300:-300].max() < 0.01


def test_windows_of_any_length_are_filtered_alike():
    rng = np.random.default_rng(6)
    sizes = [20, 400, 21, 15, 16, 150, 150, 3]
    edges = np.r_[0, np.cumsum(sizes)]
    values = rng.normal(size=edges[-1])
    b, a = sg.band_filter(0.5, 20.0, 50.0)
    whole = sg.zero_phase(values, edges, b, a)
    for x, y in zip(edges[:-1], edges[1:]):
        assert np.allclose(whole[x:y], sg.zero_phase(values[x:y], np.array([0, y - x]), b, a))
    assert np.array_equal(whole[edges[3] : edges[4]], values[edges[3] : edges[4]])  # too short to filter
    for share in (0, 0.3, 0.95, 1):
        assert np.allclose(sg.quantile(values, edges, share), [np.quantile(values[x:y], share) for x, y in zip(edges[:-1], edges[1:])])


def test_spectrum_finds_tone_and_power():
    at = np.arange(2048) / 50
    (_, f, p), = sg.spectra(2 * np.sin(2 * np.pi * 6.25 * at), np.array([0, 2048]), 50.0, 64)
    assert f[p[0].argmax()] == 6.25 and np.isclose(p.sum() * (f[1] - f[0]), 2, rtol=0.02)


def test_features_of_odd_windows(spark):
    """Windows under 20 samples and samples with nulls are left out; rows at rest give zeros; an empty table none."""
    kinds = "run long, us long, ax double, ay double, az double, gx double, gy double, gz double, lat double, lon double, speed_kmh double"
    rows = [(1, i * 20_000, 0.0, 0.0, 9.81, 0.0, 0.0, 0.0, 4.6, -74.1, 36.0) for i in range(30)] + [(2, i, 0.0, 0.0, 9.81, 0.0, 0.0, 0.0, 4.6, -74.1, 0.0) for i in range(19)]
    rows += [(3, i, 0.0, 0.0, None if i else 9.8, 0.0, 0.0, 0.0, 4.6, -74.1, 0.0) for i in range(40)] + [(None, 5, 0.0, 0.0, 9.81, 1.0, 0.0, 0.5, 4.6, -74.1, 0.0)] * 25
    samples = spark.createDataFrame(rows, kinds)
    got = {r["run"]: r.asDict() for r in sensors.window_features(samples, ["run"]).collect()}
    assert set(got) == {1, None} and set(sensors.FEATURES) < set(got[1])
    assert got[1]["dq_muestras"] == 30 and abs(got[1]["imu_rms"]) < 1e-9 and np.isclose(got[1]["vel_media_kmh"], 36) and abs(got[1]["dq_jitter_ms"]) < 1e-9 and got[1]["gps_distancia_m"] == 0
    assert np.isclose(got[None]["gyro_yaw_rms"], 0.5) and got[None]["frac_detenido"] == 1
    assert sensors.window_features(samples.limit(0), ["run"]).count() == 0


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 137, 5000])
def test_least_by_digest(spark, n):
    rows = spark.range(3000).withColumnRenamed("id", "k")
    want = sorted(range(3000), key=lambda k: hashlib.md5(f"{k}-7".encode()).hexdigest())[:n]
    assert sorted(r["k"] for r in sampling.least_by_digest(rows, "k", 7, n).collect()) == sorted(want)


def test_numbered(spark):
    rows = spark.range(2000).select("id", (F.col("id") * 7919 % 50).alias("v"))
    got = {r["id"]: r["n"] for r in sampling.numbered(rows, ["v", "id"], "n").collect()}
    want = {i: k + 1 for k, i in enumerate(sorted(range(2000), key=lambda i: (i * 7919 % 50, i)))}
    assert got == want


def test_samples_in(spark):
    rng = np.random.default_rng(2)
    frames = [(int(r), i, int(u)) for i, (r, u) in enumerate(zip(rng.integers(0, 3, 40), rng.integers(-50, 200, 40)))]
    rows = [(int(r), int(u), float(i)) for i, (r, u) in enumerate(zip(rng.integers(0, 3, 200), rng.integers(-60, 220, 200)))]
    got = sensors.samples_in(spark.createDataFrame(frames, "run long, frame long, us long"), spark.createDataFrame(rows, "run long, us long, value double"), 5, 25)
    want = sorted((f, v) for r, f, u in frames for s, w, v in rows if r == s and u - 5 <= w < u + 25)
    assert sorted((x["frame"], x["value"]) for x in got.collect()) == want


def test_gpx(spark, tmp_path):
    path = tmp_path / "a.gpx"
    path.write_text('<?xml version="1.0"?><gpx xmlns="http://www.topografix.com/GPX/1/1"><trk><trkseg><trkpt lat="4.6" lon="-74.1"><ele>2600.5</ele><time>2026-01-02T03:04:05Z</time><sat>9</sat></trkpt><trkpt lat="4.7" lon="-74.2"><time>2026-01-02T03:04:15Z</time><speed>1.5</speed></trkpt></trkseg></trk></gpx>')
    rows = files.read_gpx(spark, str(path)).orderBy("lat").collect()
    assert [(r.lat, r.lon, r.ele, r.speed, r.sat) for r in rows] == [(4.6, -74.1, 2600.5, None, 9), (4.7, -74.2, None, 1.5, -1)]
    assert (rows[1].timestamp - rows[0].timestamp).seconds == 10


def test_voc(spark, tmp_path):
    thing = "<object><name> {} </name><bndbox><xmin>{}</xmin><ymin>{}</ymin><xmax>{}</xmax><ymax>{}</ymax></bndbox></object>"
    (tmp_path / "a.xml").write_text("<annotation><filename>a.jpg</filename><size><width>600</width><height>600</height></size>" + thing.format("d00", 0, 300, 300, 600) + thing.format("D20", 700, 0, 800, 10) + "<object><name>D10</name></object></annotation>")
    boxes = files.read_voc(spark, str(tmp_path / "a.xml"))
    assert sorted(r.cls for r in boxes.collect()) == ["D00", "D20"]
    assert [tuple(r) for r in files.normalised(boxes).collect()] == [("a.jpg", "D00", 0.25, 0.75, 0.5, 0.5)]


def test_features_and_writers(spark, tmp_path):
    (tmp_path / "f.json").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Point","coordinates":[-74.1,4.6]},"properties":{"nombre":"A"}}]}')
    assert [tuple(r) for r in files.read_features(spark, str(tmp_path / "f.json"), "nombre string").collect()] == [(4.6, -74.1, "A")]
    df = spark.createDataFrame([(1, 0.123456), (2, None)], "id long, v double")
    files.write_csv(df, str(tmp_path / "c"))
    assert sorted(tuple(r) for r in files.read_csv(spark, str(tmp_path / "c"), "id long, v double").collect())[0] == (1, 0.1235)
    files.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    with pytest.raises(ValueError):
        files.ordered(df, ["id"])
    assert files.ordered(df, ["v", "id"]).columns == ["v", "id"]
    boxes = spark.createDataFrame([("i", "train", 3, 0.5, 0.5, 0.1, 0.2)], "image_id string, split string, class_id int, cx double, cy double, w double, h double")
    files.write_yolo(boxes, str(tmp_path / "y"))
    assert [r.value for r in spark.read.text(str(tmp_path / "y" / "split=train")).collect()] == ["i\t3 0.500000 0.500000 0.100000 0.200000"]
