"""Pages, context, priorities, ensembles, preparation, calibration by captures and tours, against plain loops on small tables with nulls, ties and nothing."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pavescope.operators import calibration, fusion, geo, graph, reports, study


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_page_filters_searches_and_orders(spark):
    data = [(1, "malo", "Bacheo en la VIA", 3.0), (2, "malo", None, None), (3, "bueno", "bacheo", 9.0), (4, "malo", "bacheo", 3.0), (5, "malo", "sello", 8.0), (None, "malo", "bacheo", 1.0)]
    df = spark.createDataFrame(data, "id int, state string, text string, score double")
    ask = lambda **k: [(r["id"], r["place"], r["matches"]) for r in reports.page(df, "id", "score", **k).orderBy("place").collect()]
    assert ask(equal={"state": "malo"}, search="BACHEO", over=("id", "text")) == [(None, 1, 3), (1, 2, 3), (4, 3, 3)]
    assert ask(equal={"state": "malo"}, descending=True) == [(5, 1, 5), (1, 2, 5), (4, 3, 5), (None, 4, 5), (2, 5, 5)]  # ties by id, nulls last
    assert ask(equal={"state": "", "text": None}, most=2) == [(None, 1, 6), (1, 2, 6)]
    assert ask(search="nothing", over=("text",)) == []
    assert reports.page(df.limit(0), "id", "score").count() == 0


def test_melted_keeps_nulls(spark):
    wide = spark.createDataFrame([(1, 2, 0.5, None)], "id int, n int, a double, b int")
    assert sorted(rows_of(reports.melted(wide, ["id"], "q", "n")), key=str) == sorted([(1, "q", "a", 0.5, 2), (1, "q", "b", None, 2)], key=str)
    assert reports.melted(wide.limit(0), ["id"], "q", "n").count() == 0


def test_scaled_like_pandas(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"id": range(200), "heavy": rng.exponential(1, 200) ** 4, "plain": rng.normal(size=200), "same": 5.0, "signed": -(rng.exponential(1, 200) ** 4)})
    frame.loc[::7, "heavy"], frame.loc[::5, "plain"] = np.nan, np.nan
    cols = ["heavy", "plain", "same", "signed"]
    kept = frame[cols].copy()
    logged = [k for k in cols if kept[k].min() >= 0 and kept[k].skew() > 2]
    assert logged == ["heavy"]
    kept["heavy"] = np.log1p(kept["heavy"])
    full = kept.fillna(kept.median())
    want = ((full - full.mean()) / full.std().replace(0, 1)).clip(-8, 8)
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None).values.tolist(), "id int, heavy double, plain double, same double, signed double")
    got = fusion.scaled(df, cols).orderBy("id").toPandas()
    assert list(got.columns) == ["id", *cols] and np.allclose(got[cols].to_numpy(float), want.to_numpy(), atol=1e-9)
    assert fusion.scaled(df.limit(0), cols).count() == 0
    assert set(rows_of(fusion.scaled(df, ["plain"], df.limit(0)).select("plain"))) == {(0.0,)}  # nothing to learn from


def test_scaled_other_values_than_learned(spark):
    fit = spark.createDataFrame([(float(v),) for v in (1, 2, 3)], "v double")
    new = spark.createDataFrame([(2.0,), (None,), (float("nan"),), (1e9,), (-1e9,), (float("inf"),)], "v double")
    assert [r[0] for r in fusion.scaled(new, ["v"], fit).collect()] == [0.0, 0.0, 0.0, 8.0, -8.0, 0.0]


def test_normal_share(spark):
    z = [-9.0, -8.0, -5.5, -1.0, 0.0, 0.3, 2.0, 6.0, 9.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in z], "z double").select(fusion.normal_share(F.col("z"))).collect()]
    want = [0.5 * math.erfc(-min(max(v, -8), 8) / math.sqrt(2)) for v in z]
    assert np.allclose(got, want, atol=1e-14)


def test_state_shares_sum_to_one(spark):
    df = spark.createDataFrame([(50.0, 10.0), (100.0, 0.1), (None, 1.0)], "s double, d double")
    got = df.select(*fusion.state_shares(F.col("s"), F.col("d"))).collect()
    assert sum(got[0]) == pytest.approx(1) and max(got[0]) == got[0]["p_malo"]
    assert got[1]["p_bueno"] == pytest.approx(1)
    assert got[2]["p_regular"] is None


def test_ensemble_of_one_and_of_equal_members(spark):
    rho = {f"rho_{k}": 0.0 for k in ("D00", "D10", "D20", "D40")}
    make = lambda rows: spark.createDataFrame([dict(member=m, image_id=i, segment_id=s, iri=v, **rho) for m, i, s, v in rows], "member int, image_id int, segment_id int, iri double, rho_D00 double, rho_D10 double, rho_D20 double, rho_D40 double")
    one = fusion.ensemble(make([(0, 1, 1, 2.0), (0, 2, 1, 4.0)])).first()
    assert one["iri"] == pytest.approx(3.0) and one["icv_std"] is None
    two = fusion.ensemble(make([(0, 1, 1, 2.0), (1, 1, 1, 8.0), (1, 2, 1, 0.0), (0, 2, 1, 4.0)])).first()
    assert two["iri"] == pytest.approx((4.0 + 4.0) / 2)  # sqrt(2 * 8), and the value that is not positive is left out
    assert fusion.ensemble(make([])).count() == 0


def test_left_out_like_loops(spark):
    rng = np.random.default_rng(5)
    rows = [(cap, s, float(np.round(rng.uniform(0, 3), 1)), float(rng.integers(0, 2)), float(rng.uniform(0, 100)), 70.0) for cap in (1, 2, 3) for _ in range(4) for s in (18, 20, 22)]
    df = spark.createDataFrame(rows, "capture int, step int, loss double, hit double, score double, centre double")
    frame = pd.DataFrame(rows, columns=df.columns)
    got = {r["capture"]: r for r in calibration.left_out(df, "capture", 0.05, 20).collect()}
    for cap in (1, 2, 3):
        rest, own = frame[frame.capture != cap], frame[frame.capture == cap]
        means = rest.groupby("step").mean()
        tied = means[means.loss <= means.loss.min() + 1e-9]
        best = (tied.score - tied.centre).abs().round(9).idxmin()
        assert got[cap]["m"] == pytest.approx(best * 0.05) and got[cap]["n"] == 4
        assert got[cap]["loss"] == pytest.approx(own[own.step == best].loss.mean()) and got[cap]["accuracy"] == pytest.approx(own[own.step == best].hit.mean())
        assert got[cap]["loss_plain"] == pytest.approx(own[own.step == 20].loss.mean())
    assert calibration.left_out(df.where("capture = 1"), "capture", 0.05, 20).count() == 0  # nothing to learn from


def _places(spark, rows, kinds="id int, lat double, lon double"):
    return spark.createDataFrame(rows, kinds)


def test_around_without_references_or_coordinates(spark):
    points = _places(spark, [(1, 4.6, -74.0), (2, None, -74.0)])
    refs = _places(spark, [(7, 4.6, -74.0, 3), (8, 4.601, -74.0, 5), (9, 5.6, -74.0, 1)], "id int, lat double, lon double, w int")
    got = {r["id"]: r for r in geo.around(points, refs, "x", (100, 250), "w").collect()}
    assert (got[1]["x_100m"], got[1]["x_250m"], got[1]["x_pond_100m"], got[1]["x_pond_250m"], got[1]["dist_x_m"]) == (1, 2, 3.0, 8.0, 0.0)
    assert (got[2]["x_250m"], got[2]["x_pond_250m"], got[2]["dist_x_m"]) == (0, 0.0, None)
    none = {r["id"]: r for r in geo.around(points, refs.limit(0), "x", (100, 250)).collect()}
    assert none[1]["x_250m"] == 0 and none[1]["dist_x_m"] is None


def test_context_counts_recent_crashes(spark):
    points = _places(spark, [(1, 4.6, -74.0)])
    crashes = _places(spark, [(1, 4.6, -74.0, 2020, 10), (2, 4.6, -74.0, 2022, 3), (3, 4.6, -74.0, 2019, 1), (4, 4.6, -74.0, None, 1)], "id int, lat double, lon double, anio int, peso int")
    health = _places(spark, [(1, 4.6, -74.0, False)], "id int, lat double, lon double, hospital boolean")
    got = geo.context(points, _places(spark, []), health, crashes).first()
    assert (got["siniestros_100m"], got["siniestros_pond_250m"]) == (2, 13.0)
    assert got["ips_500m"] == 1 and got["hospital_1000m"] == 0 and got["dist_hospital_m"] is None and got["dist_colegio_m"] is None


def test_whole_priority_fills(spark):
    roads = spark.createDataFrame([(1.0, 1.0, 1.0), (2.0, 2.0, 2.0), (3.0, 3.0, 3.0), (None, None, 1.0)], "dim_social double, malla double, rutas double")
    kinds = "id int, icv double, dim_social double, malla double, rutas double, crashes int, rain double, school_m int, hospital_m int"
    own = spark.createDataFrame([(1, 50.0, None, None, 1.0, None, None, None, 500), (2, 90.0, 3.0, 5.0, 5.0, 4, 10.0, 300, 2000)], kinds)
    got = {r["id"]: r for r in geo.whole_priority(own, roads).collect()}
    assert got[1]["social"] == pytest.approx(200 / 3) and got[1]["mobility"] == pytest.approx(200 / 3)  # the medians of 1, 2, 3
    assert got[1]["safety"] == 0 and got[1]["score_rain"] == 100
    assert got[1]["priority"] == pytest.approx(0.6 * 50 + 0.4 * got[1]["importance"] + 5 + 3)
    assert got[2]["importance"] == pytest.approx(100) and got[2]["priority"] == pytest.approx(0.6 * 10 + 40 + 5)


def test_hash_edges_connect_like_pairs(spark):
    rng = np.random.default_rng(2)
    base = [rng.random(289).tolist() for _ in range(4)]
    near = [[v + (0.3 if i == 5 else 0) for i, v in enumerate(base[0])], base[1], base[1], base[1]]
    df = graph.gradient_hash(spark.createDataFrame(list(enumerate(base + near)), "id int, px array<double>"), "px")
    pairs, edges = graph.near_hashes(df, "id", 16), graph.hash_edges(df, "id", 16)
    assert sorted(rows_of(graph.components(pairs))) == sorted(rows_of(graph.components(edges)))
    assert edges.count() < pairs.count()  # four equal ones: three edges, six pairs
    assert graph.hash_edges(df.limit(0), "id", 16).count() == 0


def test_tour_like_a_loop(spark):
    rng = np.random.default_rng(4)
    images = [(i, i % 2, rng.integers(0, 4, 289).astype(float).tolist()) for i in range(30)]
    images.append((30, 0, images[2][2]))  # a tie
    df = graph.gradient_hash(spark.createDataFrame(images, "id int, label int, px array<double>"), "px")
    bits = {r["id"]: np.array(r["bits"]) for r in df.collect()}
    got = rows_of(study.chained(df, "label", "id").select("label", "chain_pos", "id"))
    for label in (0, 1):
        left = sorted(i for i, g, _ in images if g == label)
        tour = [left.pop(0)]
        while left:
            best = min(left, key=lambda i: (int((bits[i] != bits[tour[-1]]).sum()), i))
            left.remove(best)
            tour.append(best)
        assert [i for g, _, i in sorted(got) if g == label] == tour
