"""Boosted baselines and importance: rules of splits and blocks, scores that can be learnt and scores that cannot."""

import numpy as np
import pytest

from pavescope.operators import baselines, trees

S = trees.Settings(rounds=6, rate=0.4, least=5)


def test_boosted(spark):
    """Learns from the fusion split alone; frames without a target are scored; segments get the mean of their frames."""
    rng = np.random.default_rng(4)
    rows = [(i, i // 5, "fusion" if i < 200 else "test", float(a), None if i % 50 == 0 else float(90 if a > 0 else 20) if i < 200 else 0.0) for i, a in enumerate(rng.normal(size=300))]
    df = spark.createDataFrame(rows, "image_id long, segment_id long, split string, a double, icv double")
    got = {r["segment_id"]: r for r in baselines.boosted(df, ["a"], settings=S).collect()}
    frame = {r["image_id"]: r["fitted"] for r in trees.fit(df.where("split = 'fusion'"), ["a"], "icv", settings=S).scored(df).collect()}
    assert len(got) == 60 and got[50]["split"] == "test"
    for k, r in got.items():
        assert r["icv"] == pytest.approx(np.mean([frame[i] for i in range(5 * k, 5 * k + 5)]))
    assert min(abs(frame[i] - 90) for i, r in enumerate(rows) if r[3] > 0.3) < 15 and frame[250] > 0
    assert {r["icv"] for r in baselines.boosted(df.where("split = 'test'"), ["a"], settings=S).collect()} == {None}


def test_importance(spark):
    """A block lies in one fold; a score of the features is predicted for roads of other blocks, noise is not."""
    rng = np.random.default_rng(5)
    rows = [(i, 4.5 + float(a), -74.1 + float(b), float(f), float(3 * f), float(g)) for i, (a, b, f, g) in enumerate(np.c_[rng.uniform(0, 0.3, (400, 2)), rng.normal(size=(400, 2))])]
    rows.append((400, None, -74.1, 0.5, 1.5, 0.0))
    df = spark.createDataFrame(rows, "id long, lat double, lon double, f double, good double, noise double")
    out = baselines.importance(df, ["f"], ["good", "noise"], 4, S)
    got = out.collect()
    folds = {}
    for r in got:
        folds.setdefault(r["block"], set()).add(r["fold"])
    assert len(folds) > 10 and all(len(f) == 1 for f in folds.values()) and folds[None] == {None}
    lone = [r for r in got if r["id"] == 400][0]
    assert lone["good_held"] is None and lone["good_predicted"] is not None
    scores = {r["target"]: r for r in baselines.held_out_scores(out, ["good", "noise"]).collect()}
    assert scores["good"]["r2"] > 0.8 and scores["good"]["spearman"] > 0.9 and scores["noise"]["r2"] < 0.1 and scores["good"]["n"] == 400


def test_whole_rounds_of_scores(spark, sf, monkeypatch):
    """The queries ask for every round of the method: 400 at a rate of 0.05."""
    from pavescope.plans import learning

    seen = rounds_asked(monkeypatch)
    learning.sco_b2(spark, sf)
    learning.sco_c1(spark, sf)
    assert seen == [("icv", 400, 0.05)] * 2


def test_whole_rounds_of_importance(spark, monkeypatch):
    """Each target by 300 rounds at a rate of 0.08."""
    from pavescope.plans import learning

    seen = rounds_asked(monkeypatch)
    roads = spark.createDataFrame([(1, 4.5, -74.1, *[1.0] * 8)], "id long, lat double, lon double, " + ", ".join(f"`{k}` double" for k in [*learning._PLACE, *learning._TARGETS]))
    monkeypatch.setattr(learning, "_roads", lambda spark, d: roads)
    learning._important(spark, "")
    assert sorted(seen) == [("index", 300, 0.08), ("social", 300, 0.08)]


def rounds_asked(monkeypatch):
    """What fits are asked for, in place of growing them."""
    seen = []

    def fit(rows, features, target, fold=None, folds=0, settings=S):
        seen.append((target, settings.rounds, settings.rate))
        return trees.Forest(features, [], folds, settings, np.full(folds + 1, np.nan))

    monkeypatch.setattr(trees, "fit", fit)
    return seen
