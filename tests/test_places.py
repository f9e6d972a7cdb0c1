"""Polygons, roads and components against brute force: holes, edges, nulls, repeats and empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pavescope.operators import components, matching, polygons

SHAPES = "polygon long, rings array<array<array<double>>>"


def star(rng, x, y, size, n):
    angles = np.sort(rng.uniform(0, 2 * np.pi, n))
    reach = size * rng.uniform(0.3, 1, n)
    return [[float(x + r * np.cos(a)), float(y + r * np.sin(a))] for a, r in zip(angles, reach)]


def inside(x, y, rings):
    odd = False
    for ring in rings:
        for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
            if (y0 > y) != (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0:
                odd = not odd
    return odd


def away(x, y, rings):
    best = np.inf
    for ring in rings:
        for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
            dx, dy = x1 - x0, y1 - y0
            t = min(max(((x - x0) * dx + (y - y0) * dy) / (dx * dx + dy * dy or 1), 0), 1)
            best = min(best, np.hypot(x - x0 - t * dx, y - y0 - t * dy) * 111_000)
    return best


@pytest.mark.parametrize("cell", [0.0005, 0.003, 0.2])
def test_polygons(spark, cell):
    """Stars of many corners with holes, over one cell or hundreds; the nearest edge for points in none."""
    rng = np.random.default_rng(7)
    shapes = {k: [star(rng, *rng.uniform(0, 0.02, 2), 0.008, 60)] for k in range(8)}
    shapes[3].append(star(rng, 0.01, 0.01, 0.002, 9))
    shapes[4][0].append(shapes[4][0][0])  # closed
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-0.01, 0.03, (600, 2)))] + [(900, None, 0.01), (901, float("nan"), 0.01)]
    got = {r["id"]: r["polygon"] for r in polygons.placed(spark.createDataFrame(points, "id long, lon double, lat double"), spark.createDataFrame([*shapes.items(), (99, []), (98, [[]]), (97, None)], SHAPES), cell, 60.0).collect()}
    assert got.pop(900) is None and got.pop(901) is None
    held = 0
    for i, x, y in points[:-2]:
        own = [k for k, rings in shapes.items() if inside(x, y, rings)]
        near = min((away(x, y, rings), k) for k, rings in shapes.items())
        held += bool(own)
        assert got[i] == (min(own) if own else near[1] if near[0] <= 60 else None), i
    assert held > 50


def test_majority(spark):
    rows = [(1, 5), (1, 7), (1, 5), (2, 9), (2, 8), (3, None), (4, None), (4, 6), (None, 2)]
    got = {r["g"]: (r["polygon"], r["share"]) for r in polygons.majority(spark.createDataFrame(rows, "g long, polygon long"), "g").collect()}
    assert got == {1: (5, 2 / 3), 2: (8, 0.5), 3: (None, 0.0), 4: (6, 1.0), None: (2, 1.0)}


def test_empty_places(spark):
    points, shapes = spark.createDataFrame([(1, 0.0, 0.0)], "id long, lon double, lat double"), spark.createDataFrame([], SHAPES)
    assert polygons.placed(points, shapes, 0.01).first()["polygon"] is None
    assert polygons.placed(points.limit(0), shapes, 0.01).count() == 0
    lines = spark.createDataFrame([], "road long, seq long, lat double, lon double")
    assert matching.matched(points, lines).count() == 0


def test_roads(spark):
    """Projection on bent roads by brute force; trips backward or mostly elsewhere go."""
    rng = np.random.default_rng(9)
    metre = 1 / matching.DEGREE
    roads = {r: np.cumsum(rng.uniform(-40, 160, (15, 2)), axis=0) * metre + [4.6, -74.1] for r in (1, 2)}
    lines = [(r, k, float(a), float(b)) for r, line in roads.items() for k, (a, b) in enumerate(line)] + [(1, 500, None, 1.0), (3, 0, 4.6, -74.1)]
    points, n = [], 0
    for trip, forward in (("go", 1), ("back", -1), ("off", 1)):
        for k in range(40)[::forward]:
            at = roads[1][k // 3] + (roads[1][k // 3 + 1] - roads[1][k // 3]) * (k % 3) / 3
            lat, lon = at + rng.uniform(-8, 8, 2) * metre + (0.5 if trip == "off" and k > 4 else 0)
            points.append((n, trip, n, float(lat), float(lon)))
            n += 1
    points.append((n, "go", n, None, -74.1))
    frame, lanes = spark.createDataFrame(points, "id long, trip string, us long, lat double, lon double"), spark.createDataFrame(lines, "road long, seq long, lat double, lon double")
    got = {(r["id"], r["road"]): (r["at_m"], r["off_m"]) for r in matching.matched(frame, lanes).collect()}
    want = {}
    for i, _, _, lat, lon in points[:-1]:
        for road, line in roads.items():
            start, best = 0.0, None
            for (a, b), (c, d) in zip(line[:-1], line[1:]):
                shrink = matching.DEGREE * np.cos(np.radians(a))
                dx, dy, px, py = (d - b) * shrink, (c - a) * matching.DEGREE, (lon - b) * shrink, (lat - a) * matching.DEGREE
                t = min(max((px * dx + py * dy) / (dx * dx + dy * dy), 0), 1)
                off = np.hypot(px - t * dx, py - t * dy)
                best = min(best or (off, start + t * np.hypot(dx, dy)), (off, start + t * np.hypot(dx, dy)))
                start += np.hypot(dx, dy)
            if best[0] <= 15:
                want[i, road] = best[::-1]
    assert got.keys() == want.keys() and len(want) > 80
    assert all(np.allclose(got[k], want[k], atol=1e-6) for k in want)
    on = matching.sections(matching.trips_on_roads(frame, lanes))
    assert {(r["trip"], r["road"]) for r in on.select("trip", "road").distinct().collect()} >= {("go", 1)}
    assert not {"back", "off"} & {r["trip"] for r in on.where("road = 1").select("trip").distinct().collect()}


def test_left_out_factor(spark):
    rng = np.random.default_rng(2)
    rows = [(f, float(b * 3), float(b)) for f in "abc" for b in rng.uniform(1, 2, 5)] + [("a", 100.0, 1.0), ("b", 0.0, 1.0), (None, 8.0, 2.0)]
    got = matching.left_out_factor(spark.createDataFrame(rows, "f string, y double, x double"), "y", "x", "f").collect()
    assert len(got) == len(rows)
    for r in got:
        logs = [np.log(y) - np.log(b) for f, y, b in rows if f != r["f"] and y > 0]
        assert np.isclose(r["predicted"], np.exp(np.median(logs)) * r["x"])


def test_components(spark):
    """Projections equal those of a singular value decomposition; odd vectors are left out of the fit and get nulls."""
    rng = np.random.default_rng(11)
    x = (rng.normal(size=(700, 12)) @ rng.normal(size=(12, 12)) * np.geomspace(1, 50, 12) + 100).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [1.0]), (902, [float("nan")] * 12), (903, [None] * 12)]
    frame = spark.createDataFrame(rows, "id long, v array<float>").repartition(40)
    fitted = components.fit(frame.where("id % 3 != 0"), "v", 12, 5)
    own = x[np.arange(700) % 3 != 0].astype(float)
    mean, sd = own.mean(0), own.std(0) + 1e-6
    _, s, vt = np.linalg.svd((own - mean) / sd, full_matrices=False)
    modes = vt[:5] * np.sign(vt[np.arange(5), np.abs(vt[:5]).argmax(1)])[:, None]
    assert np.allclose(fitted.components, modes, atol=1e-6) and np.allclose(fitted.shares, (s**2 / (s**2).sum())[:5])
    got = {r["id"]: list(r)[1:] for r in components.projected(frame, "id", "v", fitted).collect()}
    assert np.allclose([got[i] for i in range(700)], (x - mean) / sd @ modes.T, atol=1e-5)
    assert all(got[i] == [None] * 5 for i in (900, 901, 902, 903))
    empty = components.fit(frame.limit(0), "v", 12, 5)
    assert not empty.components.any() and components.projected(frame.limit(0), "id", "v", empty).count() == 0
    with pytest.raises(ValueError):
        components.fit(frame, "v", components.MOST_DIMENSIONS + 1, 5)


def test_components_of_the_query(spark, sf):
    from pavescope.plans import QUERIES

    got = QUERIES["vis_pca"](spark, sf).toPandas().sort_values("vec_id")
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").toPandas().sort_values("vec_id")
    x, fit = np.stack(e["embedding"]).astype(float), e["vec_id"].to_numpy() % 5 != 0
    z = (x - x[fit].mean(0)) / (x[fit].std(0) + 1e-6)
    _, _, vt = np.linalg.svd(z[fit], full_matrices=False)
    modes = vt[:32] * np.sign(vt[np.arange(32), np.abs(vt[:32]).argmax(1)])[:, None]
    assert np.allclose(got.drop(columns="vec_id").to_numpy(), z @ modes.T, atol=1e-5)
