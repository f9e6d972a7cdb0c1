"""The city's tables from files; shapes against brute force: holes, broken text, lines, points and very long rings."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pavescope import config as c
from pavescope.functions import shapes
from pavescope.sources import city


def brute_axis(points):
    """The least rectangle over the directions of all pairs of points, in steps of none: its area and the length of its long side."""
    best = None
    for i in range(len(points)):
        for j in range(len(points)):
            d = points[j] - points[i]
            if i != j and np.hypot(*d) > 0:
                u = d / np.hypot(*d)
                a, b = points @ u, points @ np.array([-u[1], u[0]])
                size = (np.ptp(a) * np.ptp(b), max(np.ptp(a), np.ptp(b)))
                best = size if best is None or size[0] < best[0] - 1e-12 else best
    return best


def test_long_axis():
    rng = np.random.default_rng(1)
    for n in (3, 4, 7, 25):
        points = rng.uniform(-1, 1, (n, 2)) * [1, 0.3]
        axis = shapes.long_axis(points)
        area, long = brute_axis(points)
        assert np.hypot(*(axis[2:] - axis[:2])) == pytest.approx(long) and tuple(axis[:2]) < tuple(axis[2:])
        u = (axis[2:] - axis[:2]) / long
        assert np.ptp(points @ u) * np.ptp(points @ np.array([-u[1], u[0]])) == pytest.approx(area)
    assert shapes.long_axis(np.array([[1.0, 2.0]] * 3)).tolist() == [1, 2, 1, 2]
    assert shapes.long_axis(np.array([[2.0, 2], [0, 0], [1, 1]])).tolist() == [0, 0, 2, 2]
    assert shapes.long_axis(np.array([[0.0, 0], [4, 0], [4, 1], [0, 1], [0, 0]])).tolist() == [0, 0.5, 4, 0.5]


def test_rings_and_centroids(spark):
    square = "((0 0, 4 0, 4 4, 0 4, 0 0)"
    long = ", ".join(f"{np.cos(a)} {np.sin(a)}" for a in np.linspace(0, 2 * np.pi, 60_001))
    texts = {
        "plain": (f"POLYGON {square})", (2, 2)), "turned": ("polygon((0 0,0 4,4 4,4 0,0 0))", (2, 2)), "z": ("POLYGON Z ((0 0 9, 2 0 9, 2 2 9, 0 2 9, 0 0 9))", (1, 1)),
        "hole": (f"POLYGON {square}, (2 0, 4 0, 4 4, 2 4, 2 0))", (1, 2)), "two": (f"MULTIPOLYGON ({square}), ( (10 0, 14 0, 14 4, 10 4, 10 0)))", (7, 2)),
        "two_hole": (f"SRID=4326;MULTIPOLYGON({square},(2 0,4 0,4 4,2 4,2 0)),((10 0,14 0,14 4,10 4,10 0)))", ((1 * 8 + 12 * 16) / 24, 2)),
        "line": ("POLYGON ((0 0, 4 0, 0 0))", (2, 0)), "dot": ("POLYGON ((3 1, 3 1))", (3, 1)), "exp": ("POLYGON ((0 0, 4e0 0, 4 +.4E1, -0 4))", (2, 2)), "long": (f"POLYGON (({long}))", (0, 0)),
        "empty": ("MULTIPOLYGON EMPTY", None), "point": ("POINT (1 2)", None), "broken": ("POLYGON ((0 0, 1 1, 2", None), "bare": ("POLYGON (0 0, 1 1, 2 0)", None), "word": ("POLYGON ((0 0, x 1))", None), "one": ("POLYGON ((0, 1 1))", None), "none": (None, None), "blank": ("", None),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in texts.items()], "k string, t string")
    got = {r["k"]: r for r in shapes.placed(df.select("k", shapes.rings(F.col("t")).alias("s")), "s").collect()}
    for k, (_, want) in texts.items():
        assert (got[k]["centre"] is None) == (got[k]["axis"] is None) == (want is None), k
        if want:
            assert got[k]["centre"] == pytest.approx(want, abs=1e-9), k
    assert got["two"]["axis"] == [0, 2, 14, 2] and np.hypot(*np.subtract(got["long"]["axis"][2:], got["long"]["axis"][:2])) == pytest.approx(2, abs=1e-6)


def test_road_file(spark, tmp_path):
    names = [c.ROAD_SHAPE, *c.ROAD_IDS, *c.ROAD_SIZES, *c.ROAD_SCORES, *c.ROAD_RANGE]
    row = {k: "1" for k in names} | {c.ROAD_SHAPE: '"POLYGON ((0 0, 4 0, 4 1, 0 1, 0 0))"', "CIV": '"50,001,234"', "PUNTAJE_DI": "5", "PUNTAJE__4": "7", "PUNTAJE__6": "x", "PUNTAJE_IP": "12.04", "RANGOS_IP": "Alto"}
    none = row | {c.ROAD_SHAPE: ""}
    path = tmp_path / "roads.csv"
    path.write_text("﻿" + "\n".join([",".join(names), *[",".join(r[k] for k in names) for r in (row, row, none)]]), encoding="utf-8")
    got = city.read_roads(spark, str(path))
    rows = got.collect()
    assert len(rows) == 2 and rows[0] == rows[1]
    r = rows[0]
    assert (r["civ"], r["pk_calzada"], r["dim_tecnica"], r["rango_ip_umv"], r["lat"], r["lon"]) == (50001234, 1, None, "Alto", 0.5, 2.0)
    assert (r["lat_a"], r["lon_a"], r["lat_b"], r["lon_b"]) == (0.5, 0.0, 0.5, 4.0)
    assert city.road_sums(got).first().asDict() == {"social": 1.0, "index": 1.0}
    assert city.road_sums(got.limit(0)).first()["social"] is None


def test_other_files(spark, tmp_path):
    (tmp_path / "c.csv").write_text("﻿LATITUD,LONGITUD,GRAVEDAD,ANO_OCURRENCIA_ACC,CIV,X\n\"4,6\",\"-74,1\",CON MUERTOS,2019,7,a\n4.6,-74.1,OTRA,x,,b\n4.6,-74.1,,2020,8,b\n9,-74,SOLO DANOS,2020,1,c\n,-74,SOLO DANOS,2020,1,c\n", encoding="utf-8")
    got = city.read_crashes(spark, str(tmp_path / "c.csv")).collect()
    assert [(r["lat"], r["anio"], r["peso"]) for r in got] == [(4.6, 2019, 10), (4.6, None, 1), (4.6, 2020, 1)]
    save = lambda name, rows: (tmp_path / name).write_text(json.dumps({"features": [{"geometry": {"coordinates": xy}, "properties": p} for xy, p in rows]}))
    save("m.json", [([-8248000.0, 512000.0], {"NOMBRE_EST": "A"}), ([10.0, 20.0], {})])
    save("d.json", [([-74.1, 4.6], {"NOMBRE_EST": "A"})])
    m = city.read_schools(spark, str(tmp_path / "m.json")).collect()
    assert m[0]["lon"] == pytest.approx(-74.0931, abs=1e-3) and m[0]["lat"] == pytest.approx(4.594, abs=1e-2) and abs(m[1]["lat"]) < 0.001
    assert city.read_schools(spark, str(tmp_path / "d.json")).first().asDict() == {"nombre": "A", "lat": 4.6, "lon": -74.1}
    save("h.json", [([-74.1, 4.6, 3.0], {"nombre": "Clínica X", "naturaleza": "Publica"}), ([-74.0, 4.7], {"nombre": "", "nombre_pre": "Centro", "ese": "si"}), ([-74.0, 4.7], {"nombre_pre": "Centro"})])
    assert [(r["nombre"], r["hospital"], r["publica"]) for r in city.read_health(spark, str(tmp_path / "h.json")).collect()] == [("Clínica X", True, True), ("Centro", True, False), ("Centro", False, False)]
