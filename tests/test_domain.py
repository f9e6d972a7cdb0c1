"""The domain classifier against a plain fit by fold and all pairs of ranks."""

import zlib

import numpy as np
import pytest

from pavescope.operators import domain


def brute(x, y, fold, k):
    """Gradient ascent to the optimum, one fold after another."""
    score = np.zeros(len(y))
    for f in range(k):
        own = np.c_[x, np.ones(len(x))]
        w = np.zeros(own.shape[1])
        for _ in range(60_000):
            use = fold != f
            share = len(y[use]) / 2 / np.where(y[use] == 1, y[use].sum(), (1 - y[use]).sum())
            w = w + 0.002 * (own[use].T @ (share * (y[use] - 1 / (1 + np.exp(-own[use] @ w)))) - np.r_[w[:-1], 0])
        score[fold == f] = (own @ w)[fold == f]
    a, b = score[y == 1], score[y == 0]
    return float(np.mean((a[:, None] > b) + (a[:, None] == b) / 2))


def test_auroc(spark):
    rng = np.random.default_rng(8)
    ref = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(120, 2)))]
    ref[3] = (3, None, float("inf"))
    near, far = rng.normal(size=(60, 2)), rng.normal(size=(60, 2)) + [1.5, -0.5]
    rows = [(500 + i, name, float(a), float(b)) for name, pts in (("near", near), ("far", far)) for i, (a, b) in enumerate(pts)]
    r, b = spark.createDataFrame(ref, "id long, u double, v double"), spark.createDataFrame([*rows, (1, None, 1.0, 1.0)], "id long, batch string, u double, v double")
    got = {x["batch"]: x for x in domain.auroc(r, b.repartition(3), "batch", "id", ["u", "v"]).collect()}
    assert set(got) == {"near", "far"} and got["far"]["n"] == 60
    raw = np.array([[np.nan if q is None or not np.isfinite(q) else q for q in row[1:]] for row in ref])
    mean, sd = np.nanmean(raw, axis=0), np.nanstd(raw, axis=0)
    for name in got:
        mine = [row for row in rows if row[1] == name]
        x = np.vstack([raw, [row[2:] for row in mine]])
        x = np.where(np.isnan(x), 0, (x - mean) / sd)
        fold = np.array([zlib.crc32(str(i).encode()) % 5 for i in [row[0] for row in ref] + [row[0] for row in mine]])
        assert got[name]["auroc"] == pytest.approx(brute(x, np.r_[np.zeros(len(ref)), np.ones(len(mine))], fold, 5), abs=2e-4), name
    assert got["far"]["auroc"] > 0.8
    assert domain.auroc(r, b.limit(0), "batch", "id", ["u"]).count() == 0
    assert [x["auroc"] for x in domain.auroc(r.limit(0), b.where("batch = 'far'"), "batch", "id", ["u"]).collect()] == [None]


def test_small_batches_are_fitted_alone(spark, monkeypatch):
    """No sums of small batches come to the driver, and areas are those of models fitted together; large batches are still fitted together."""
    rng = np.random.default_rng(9)
    ref = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(rng.normal(size=(200, 2)))], "id long, u double, v double")
    rows = [(500 + i, f"b{i % 4}", float(u) + i % 4, None if i % 11 == 0 else float(v)) for i, (u, v) in enumerate(rng.normal(size=(130, 2)))] + [(900 + i, "b9", 1.0, float(i)) for i in range(50)]
    batches = spark.createDataFrame(rows, "id long, batch string, u double, v double").repartition(5)
    found = lambda: {r["batch"]: (r["n"], pytest.approx(r["auroc"], abs=1e-9)) for r in domain.auroc(ref, batches, "batch", "id", ["u", "v"]).collect()}
    steps, plain = [], domain._step
    monkeypatch.setattr(domain, "_step", lambda rows, weights, *more: (steps.append(len(weights)), plain(rows, weights, *more))[1])
    alone = found()
    assert not steps and len(alone) == 5
    monkeypatch.setattr(domain, "OWN", 40)  # the reference is larger
    together = found()
    assert set(steps) == {5} and {k: (n, a.expected) for k, (n, a) in together.items()} == alone
    steps.clear()
    ref = ref.limit(40)
    assert len(found()) == 5 and set(steps) == {1}
