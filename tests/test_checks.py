"""Validation, resampling and drift: known failures, nulls, empty tables, and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pavescope.operators import evaluation, study
from pavescope.operators import validation as v

BOX = "image_id long, cls string, cx double, cy double, w double, h double"


def tables(spark, boxes, splits, sensors, images=((1, "train", True), (2, "train", False))):
    return (
        spark.createDataFrame(list(images), "image_id long, source string, labeled boolean"), spark.createDataFrame(boxes, BOX), spark.createDataFrame([(1,)], "image_id long"),
        spark.createDataFrame(splits, "image_id long, segment_id long, group_id long, dup_cluster long, split string"),
        spark.createDataFrame(sensors, "segment_id long, obs_id long, timestamp long, ax double, ay double, az double, gx double, gy double, gz double, lat double, lon double, speed_kmh double"),
    )


GOOD_BOX, GOOD_SPLIT, SAMPLE = [(1, "D00", 0.5, 0.5, 0.1, 0.1)], [(1, 10, 1, 5, "train"), (2, 11, 2, None, "test")], (11, None, 5, 0.0, 0.0, 9.8, 0.0, 0.0, 0.0, 4.6, -74.1, 20.0)


def failing(found):
    return {r["assertion"]: r["failures"] for r in found.where("NOT ok").collect()}


def test_a_sound_study(spark):
    found = v.assertions(*tables(spark, GOOD_BOX, GOOD_SPLIT, [SAMPLE]), {"train": 2, "test1": 0})
    assert found.count() == 15 and failing(found) == {}
    v.require(found)


def test_each_failure_is_told(spark):
    boxes = GOOD_BOX + [(1, "D99", 0.5, 0.5, 0.1, 0.1), (1, "D00", 1.5, 0.5, 0.1, 0.1), (1, None, None, 0.5, 0.1, 0.1)]
    splits = [(1, 10, 1, 5, "train"), (1, 10, 2, 5, "test"), (3, 12, 2, None, "fusion")]
    sensors = [SAMPLE, SAMPLE[:5] + (30.0,) + SAMPLE[6:], SAMPLE[:9] + (None, -70.0, 1.0)]
    found = v.assertions(*tables(spark, boxes, splits, sensors, [(1, "train", True), (2, "x", True)]), {"train": 2, "test1": 0})
    assert failing(found) == {
        "images_train": 1, "boxes_in_0_1": 2, "box_classes": 2, "label_files": 1, "one_split_an_image": 1, "images_in_splits": 1, "segments_in_one_split": 1, "groups_in_one_split": 1,
        "clusters_in_one_split": 1, "sensors_without_nulls": 1, "acceleration_within_2_g": 1, "places_in_the_city": 1, "segments_with_sensors": 2,
    }
    with pytest.raises(v.Failed, match="box_classes: 2"):
        v.require(found)
    images, boxes_, labels, splits_, sensors_ = tables(spark, GOOD_BOX, GOOD_SPLIT, [SAMPLE])
    assert "sensor_columns" in failing(v.assertions(images, boxes_, labels, splits_, sensors_.drop("az"), {}))
    empty = [df.limit(0) for df in (images, boxes_, labels, splits_, sensors_)]
    assert failing(v.assertions(*empty, {"train": 0})) == {}


def test_problems_of_texts(spark):
    rows = [
        (1, "Vía en estado muy malo, 12,5 m y 7 baches.", None, "bacheo", "muy_malo", [12.4, 7.0]), (2, "Estado REGULAR, 41 daños, mes6x y 2024", "por 55", "parcheo", "regular", [41.0]),
        (3, "malo " * 93, "", "sellado_de_fisuras", "malo", []), (4, None, None, None, None, []), (5, "bueno " * 92, "90 100 30", "mantenimiento_rutinario", "bueno", None),
    ]
    df = spark.createDataFrame(rows, "id long, t string, r string, a string, s string, f array<double>").withColumn("f", F.coalesce("f", F.array().cast("array<double>")))
    got = {r["id"]: r["p"] for r in df.select("id", v.problems(F.col("t"), F.col("r"), F.col("a"), F.col("s"), F.col("f")).alias("p")).collect()}
    assert got == {
        1: [], 2: ["números no respaldados: 2024, 55"], 3: ["acción fuera de la tabla de reglas", "descripción demasiado larga"],
        4: ["estado no mencionado o distinto", "acción fuera de la tabla de reglas"], 5: [],
    }


def test_resamples(spark):
    """Counts have the mean and spread of a Poisson variable of mean one, and the interval is that of plain resampling."""
    rng = np.random.default_rng(5)
    values = rng.normal(10, 3, 400)
    groups = spark.createDataFrame([(i, float(x), 1) for i, x in enumerate(values)], "g long, v double, n int").repartition(7)
    times = np.array([r["t"] for r in groups.select(F.explode(F.sequence(F.lit(0), F.lit(49))).alias("rep"), "g").select(study.resampled(F.col("g"), F.col("rep")).alias("t")).collect()])
    assert abs(times.mean() - 1) < 0.03 and abs(times.var() - 1) < 0.06 and abs((times == 0).mean() - np.exp(-1)) < 0.01
    low, high = study.bootstrap_ratio(groups, "g", "v", "n", 500).first()
    plain = np.quantile([rng.choice(values, 400).mean() for _ in range(2000)], [0.025, 0.975])
    assert np.allclose([low, high], plain, atol=0.06)
    assert study.bootstrap_ratio(groups.limit(0), "g", "v", "n", 10).first()["low"] is None
    assert "repartition" not in groups.columns and study.bootstrap_sums(groups, "g", ["v"], 5).count() == 5


def test_drift_of_all_variables_at_once(spark):
    """As the index of each variable and batch alone; nulls, infinities, constants, few rows, batches of one side only."""
    rng = np.random.default_rng(6)
    rows = [(b, float(rng.normal(m, 1)), 5.0, float("inf") if i % 9 == 0 else float(rng.integers(0, 4)), None if i % 2 else float(i)) for b, m, n in (("ref", 0, 300), ("a", 0, 200), ("b", 2, 150), ("c", 0, 9)) for i in range(n)]
    frame = spark.createDataFrame(rows, "batch string, x double, k double, d double, s double")
    ref, rest = frame.where("batch = 'ref'"), frame.where("batch != 'ref'")
    got = {(r["batch"], r["variable"]): r["psi"] for r in study.drift(ref, rest, "batch", ["x", "k", "d", "s"]).collect()}
    assert len(got) == 12
    for (b, name), psi in got.items():
        want = evaluation.stability_index(ref, rest.where(F.col("batch") == b), name).first()["psi"]
        assert (psi is None and want is None) or np.isclose(psi, want), (b, name)
    assert got["b", "x"] > 1 > got["a", "x"] and got["c", "x"] is None and got["a", "k"] == 0
