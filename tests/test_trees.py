"""Boosted trees against plain loops over rows and nodes; nulls, folds without rows, empty tables."""

import numpy as np
import pytest

from pavescope.operators import trees

S = trees.Settings(rounds=10, rate=0.3, depth=2, bins=8, least=5)


def table(spark, n=400):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        a, b, c = rng.normal(), float(rng.integers(0, 3)), rng.normal()
        y = 3 * (a > 0.2) + b * a + (2 if i % 11 == 0 else 0) + rng.normal() * 0.1
        rows.append((i, None if i % 11 == 0 else float(a), b, float("nan") if i % 7 == 0 else float(c), float(y), i % 3 if i % 10 else None))
    return rows, spark.createDataFrame(rows, "id long, a double, b double, c double, y double, fold int")


def brute(rows, cuts, out, s):
    """Predictions for all rows of the model that fold ``out`` has no part in."""
    bins = [[0 if v is None or v != v else 1 + sum(e < v for e in cuts[k]) for k, v in enumerate(r[1:4])] for r in rows]
    train = [i for i, r in enumerate(rows) if out is None or r[5] != out]
    start = sum(rows[i][4] for i in train) / len(train)
    sofar = [start] * len(rows)

    def grow(members, depth):
        g, n = sum(rows[i][4] - sofar[i] for i in members), len(members)
        best, pick = 1e-9, None
        if depth:
            for f in range(3):
                for edge in range(1, s.bins):
                    for blank in (False, True):
                        go = lambda i: blank if bins[i][f] == 0 else bins[i][f] <= edge  # noqa: B023, E731
                        left = [rows[i][4] - sofar[i] for i in members if go(i)]
                        if min(len(left), n - len(left)) < s.least:
                            continue
                        gain = sum(left) ** 2 / (len(left) + s.penalty) + (g - sum(left)) ** 2 / (n - len(left) + s.penalty) - g**2 / (n + s.penalty)
                        if gain > best * (1 + 1e-9) + 1e-9:
                            best, pick = gain, (f, edge, blank)
        if pick is None:
            return s.rate * g / (n + s.penalty)
        f, edge, blank = pick
        go = lambda i: blank if bins[i][f] == 0 else bins[i][f] <= edge
        return go, grow([i for i in members if go(i)], depth - 1), grow([i for i in members if not go(i)], depth - 1)

    for _ in range(s.rounds):
        tree = grow(train, s.depth)
        for i in range(len(rows)):
            at = tree
            while isinstance(at, tuple):
                at = at[1] if at[0](i) else at[2]
            sofar[i] = sofar[i] + at
    return sofar


def test_trees_by_loops(spark):
    """Ten rounds, so that predictions are written once on the way; three folds and rows without one."""
    rows, df = table(spark)
    forest = trees.fit(df.repartition(7), ["a", "b", "c"], "y", "fold", 3, S)
    got = {r["id"]: r for r in forest.scored(df, "fold").collect()}
    want = {k: brute(rows, forest.edges, k, S) for k in (0, 1, 2, None)}
    for i, r in enumerate(rows):
        assert got[i]["fitted"] == pytest.approx(want[None][i], abs=1e-5), i
        assert (got[i]["out_of_fold"] is None) == (r[5] is None)
        if r[5] is not None:
            assert got[i]["out_of_fold"] == pytest.approx(want[r[5]][i], abs=1e-5), i
    error = np.mean([(got[i]["fitted"] - rows[i][4]) ** 2 for i in got])
    assert error < 0.3 * np.var([r[4] for r in rows])
    again = trees.fit(df.repartition(3), ["a", "b", "c"], "y", "fold", 3, S)
    assert all((a == b).all() for x, y in zip(forest.trees, again.trees) for a, b in zip(x, y))


def test_trees_edge_cases(spark):
    _, df = table(spark, 30)
    none = trees.fit(df.limit(0), ["a", "b"], "y", None, 0, S)
    assert [r["fitted"] for r in none.scored(df.limit(3)).collect()] == [None] * 3
    flat = trees.fit(df.selectExpr("a", "2.5D AS y"), ["a"], "y", None, 0, S)
    assert {r["fitted"] for r in flat.scored(df.select("a")).collect()} == {2.5}
    one = trees.fit(df.selectExpr("a", "CASE WHEN id = 1 THEN double('inf') ELSE y END AS y", "0 AS fold"), ["a"], "y", "fold", 1, S)
    assert {r["out_of_fold"] for r in one.scored(df.selectExpr("a", "0 AS fold"), "fold").collect()} == {None}
    blank = trees.fit(df.selectExpr("CAST(NULL AS double) AS a", "y"), ["a"], "y", None, 0, S)
    assert len({r["fitted"] for r in blank.scored(df.select("a")).collect()}) == 1
    with pytest.raises(ValueError):
        none.scored(df.withColumnRenamed("y", "fitted"))


def test_rows_of_one_partition_are_dealt_to_tasks(spark, monkeypatch):
    """Rounds go through TASK_ROWS rows a task, about, however the rows lie; the trees are the same."""
    rows = spark.createDataFrame([(float(i % 17), float(i * 7 % 23), float(i % 17 * 2 + i % 3)) for i in range(400)], "a double, b double, y double").coalesce(1)
    seen, histograms = [], trees._histograms
    monkeypatch.setattr(trees, "_histograms", lambda state, *rest: seen.append(state.rdd.getNumPartitions()) or histograms(state, *rest))
    quick = trees.Settings(rounds=2, depth=2)
    one = trees.fit(rows, ["a", "b"], "y", settings=quick)
    monkeypatch.setattr(trees, "TASK_ROWS", 100)
    many = trees.fit(rows, ["a", "b"], "y", settings=quick)
    assert seen == [1] * 4 + [4] * 4
    assert all((p == q).all() for a, b in zip(one.trees, many.trees) for p, q in zip(a, b))


def test_rounds_written_on_the_way_change_nothing(spark, monkeypatch):
    """Predictions beside the rows are held and, each KEEP rounds, written; one tree follows from the other either way, and nothing stays held."""
    _, df = table(spark, 200)
    rows, held = df.repartition(3), lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    before, quick = held(), trees.Settings(rounds=7, depth=2, least=5)
    once = trees.fit(rows, ["a", "b", "c"], "y", "fold", 3, quick)
    monkeypatch.setattr(trees, "KEEP", 2)
    often = trees.fit(rows, ["a", "b", "c"], "y", "fold", 3, quick)
    assert len(once.trees) == 7 and all((p == q).all() for a, b in zip(once.trees, often.trees) for p, q in zip(a, b))
    assert held() == before
