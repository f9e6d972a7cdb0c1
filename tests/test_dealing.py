"""Folds against the sequential rules, group by group; leaks and imbalance by hand."""

import hashlib

import numpy as np
import pytest

from pavescope.operators import dealing


def sequence(vectors, k):
    """The folds of groups in turn, one group at a time."""
    loads, totals, out = np.zeros((k, len(vectors[0])), int), np.maximum(np.sum(vectors, axis=0), 1), []
    for v in vectors:
        scores = []
        for f in range(k):
            after = loads.copy()
            after[f] += v
            scores.append((round(float(np.mean(np.std(after / totals, axis=0))), 11), int(loads[f].sum()), f))
        out.append(min(scores)[2])
        loads[out[-1]] += v
    return out


def unrolled(plan):
    out = []
    for (_, first, runs), n in plan:
        assert first == len(out)
        for (start, folds), end in zip(runs, [*[s for s, _ in runs[1:]], n]):
            out += [folds[i % len(folds)] for i in range(end - start)]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_plan_equals_one_by_one(seed):
    """A hot group, many of a size, one stratum and several."""
    rng = np.random.default_rng(seed)
    strata = 1 if seed < 3 else 3
    found = {}
    for _ in range(12):
        v = rng.integers(1, 9, strata) if seed > 4 or strata == 1 else np.eye(strata, dtype=int)[rng.integers(strata)] * rng.integers(1, 9)
        found[tuple(int(x) for x in v)] = int(rng.integers(1, 60))
    found[(120,) + (0,) * (strata - 1)] = 1
    signatures = sorted(found.items(), key=lambda p: (-np.std(p[0]), *(-x for x in p[0])))
    if strata == 1:
        signatures.sort(reverse=True)
    plan = dealing.plan(signatures, 5)
    assert unrolled(zip(plan, [n for _, n in signatures])) == sequence([v for v, n in signatures for _ in range(n)], 5)
    if seed < 5:
        assert max(len(runs) for _, _, runs in plan) <= 25


def test_millions_of_groups_take_few_steps():
    runs = dealing.plan([((3_000_000_000,), 1), ((2,), 10**9), ((1,), 10**9 + 7)], 4)
    assert sum(len(r) for _, _, r in runs) < 30


def test_lightest_and_stratified(spark):
    rows = [(i, int(s)) for i, s in enumerate(np.random.default_rng(2).integers(1, 6, 300))] + [(999, 400), (None, 3), (1000, None)]
    got = {r["key"]: r["fold"] for r in dealing.lightest(spark.createDataFrame(rows, "key long, size long").repartition(5), 4).collect()}
    order = sorted(rows, key=lambda r: (-(r[1] or 0), hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest()))
    positive = [r for r in order if r[1]]
    assert [got[key] for key, _ in positive] == sequence([(s,) for _, s in positive], 4)
    assert got[1000] in range(4) and len(got) == 303
    many = [(i, *(int(c) for c in np.eye(3, dtype=int)[i % 3] * (1 + i % 4))) for i in range(200)] + [(500, 2, 3, 1), (501, 2, 3, 1)]
    got = {r["key"]: r["fold"] for r in dealing.stratified(spark.createDataFrame(many, "key long, a long, b long, c long"), ["a", "b", "c"], 5).collect()}
    order = sorted(many, key=lambda r: (-np.std(r[1:]), *(-x for x in r[1:]), hashlib.md5(str(r[0]).encode()).hexdigest()))
    assert [got[r[0]] for r in order] == sequence([r[1:] for r in order], 5)
    assert dealing.lightest(spark.createDataFrame([], "key long, size long"), 3).count() == 0


def test_leaks_and_imbalance(spark):
    rows = [(1, "x", "train", "p"), (1, "y", "test", "p"), (2, "x", "train", "q"), (3, None, "test", "p"), (4, None, "train", "p"), (5, "z", None, "p"), (5, "z", "test", "p")]
    items = spark.createDataFrame(rows, "g long, d string, split string, s string")
    assert {r["key"]: r["crossing"] for r in dealing.leaks(items, ["g", "d"]).collect()} == {"g": 1, "d": 0}
    assert dealing.imbalance(items, "s").first()["spread_pp"] == pytest.approx(100 / 3)
    assert dealing.imbalance(items.limit(0), "s").first()["spread_pp"] is None
    assert {r["crossing"] for r in dealing.leaks(items.limit(0), ["g"]).collect()} == {0}
