"""Whole groups dealt to folds by the greedy rules, one kind of group at a time, and reports of what leaks between splits."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sampling


def lightest(groups: DataFrame, k: int) -> DataFrame:
    """groups (key, size) with ``fold``: largest first, each to the fold with the fewest rows so far, ties to the least fold.

    Groups of one size come in the order of MD5 and key; null keys are a group of their own, null sizes count as 0.
    """
    return _dealt(groups, [F.coalesce(F.col("size"), F.lit(0)).cast("long")], k, 0.0)


def stratified(groups: DataFrame, strata: list[str], k: int) -> DataFrame:
    """groups (key, and a column of row counts for each stratum) with ``fold``: the groups that are least even over strata first,
    each to the fold where strata then spread least (mean over strata of the standard deviation of the folds' shares), ties to the
    fold with fewest rows, then to the least.

    Groups with the same counts come in the order of MD5 and key. Null counts are 0.
    """
    return _dealt(groups, [F.coalesce(F.col(s), F.lit(0)).cast("long") for s in strata], k, None)


def _dealt(groups: DataFrame, counts: list[Column], k: int, spread: float | None) -> DataFrame:
    """The driver holds a row for each distinct vector of counts (at most some sqrt(2 x rows) for one stratum), never one for each group."""
    if k < 1:
        raise ValueError("there must be a fold")
    names = [f"_c{i}" for i in range(len(counts))]
    own = groups.withColumns(dict(zip(names, counts))).withColumn("_h", F.md5(F.coalesce(F.col("key").cast("string"), F.lit(""))))
    found = [(tuple(r[:-1]), r[-1]) for r in own.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).collect()]
    order = lambda v: (-float(np.std(v)) if spread is None else spread, *(-c for c in v))
    plans = plan(sorted(found, key=lambda p: order(p[0])), k)
    rows = [(*v, first, runs) for v, first, runs in plans]
    schema = ", ".join(f"{n} long" for n in names) + ", _first long, _runs array<struct<start:long,folds:array<int>>>"
    planned = groups.sparkSession.createDataFrame(rows, schema)
    joined = own.join(planned, names)
    numbered = sampling.numbered(joined, ["_first", "_h", "key"], "_r").withColumn("_r", F.col("_r") - 1 - F.col("_first"))
    run = F.element_at(F.filter("_runs", lambda r: r["start"] <= F.col("_r")), -1)
    fold = F.get(run["folds"], ((F.col("_r") - run["start"]) % F.size(run["folds"])).cast("int"))
    return numbered.withColumn("fold", fold).drop(*names, "_h", "_first", "_runs", "_r")


def plan(signatures: list[tuple[tuple[int, ...], int]], k: int) -> list[tuple[tuple[int, ...], int, list[tuple[int, list[int]]]]]:
    """For each vector and number of groups in turn: the vector, groups before it, and runs (first rank, folds that take turns from it on).

    A greedy rule looks only at how folds differ, so folds that took one group each do so again until one that was left out catches up:
    the steps depend on folds and distinct vectors, not on groups. For vectors with rows in several strata only turns of all folds
    are taken at once.
    """
    loads = np.zeros((k, len(signatures[0][0]) if signatures else 1), np.int64)
    totals = np.sum([np.array(v, np.int64) * n for v, n in signatures], axis=0) if signatures else loads[0]
    out, before = [], 0
    for vector, n in signatures:
        out.append((vector, before, _turns(loads, totals, np.array(vector, np.int64), n)))
        before += n
    return out


def _turns(loads: np.ndarray, totals: np.ndarray, vector: np.ndarray, n: int) -> list[tuple[int, list[int]]]:
    held = np.flatnonzero(vector)
    choose = _one_stratum(int(held[0])) if len(held) == 1 else _least_spread(totals, vector) if len(held) else _one_stratum(0)
    runs, done, k = [], 0, len(loads)
    while done < n:
        turn: list[int] = []
        while done + len(turn) < n and (f := choose(loads)) not in turn:
            loads[f] += vector
            turn.append(f)
        runs.append((done, turn))
        done += len(turn)
        whole = 0
        if len(turn) == k:
            whole = (n - done) // k
            for f in turn[: (n - done) % k]:
                loads[f] += vector
            done = n - whole * k
        elif len(held) == 1 and done < n:
            left = [f for f in range(k) if f not in turn]
            room = loads[left, held[0]].min() - 1 - loads[turn, held[0]].max()
            whole = min(int(room // vector[held[0]]) + 1 if room >= 0 else 0, (n - done) // len(turn))
        elif not len(held):
            whole = 0
            done = n  # groups without rows change nothing: one fold takes them all
        loads[turn] += vector * whole
        done += whole * len(turn)
    return runs


def _one_stratum(s: int) -> Callable[[np.ndarray], int]:
    return lambda loads: min(range(len(loads)), key=lambda f: (loads[f, s], loads[f].sum(), f))


def _least_spread(totals: np.ndarray, vector: np.ndarray) -> Callable[[np.ndarray], int]:
    def choose(loads: np.ndarray) -> int:
        best, pick = None, 0
        for f in range(len(loads)):
            after = loads - loads.min(axis=0)
            after[f] += vector
            spread = float(np.mean(np.std(after / np.maximum(totals, 1), axis=0)))
            if best is None or spread < best[0] - 1e-12 or (abs(spread - best[0]) <= 1e-12 and loads[f].sum() < best[1]):
                best, pick = (spread, loads[f].sum()), f
        return pick

    return choose


def leaks(items: DataFrame, keys: list[str], split: str = "split") -> DataFrame:
    """key, crossing: how many values of each key (nulls apart) lie in more than one split. Null splits are none."""
    long = items.where(F.col(split).isNotNull()).select(F.col(split).alias("split"), F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys])).alias("p"))
    crossing = long.where("p.value IS NOT NULL").groupBy("p.key", "p.value").agg((F.min("split") != F.max("split")).cast("long").alias("c"))
    every = items.sparkSession.createDataFrame([(k,) for k in keys], "key string")
    return every.join(crossing.groupBy("key").agg(F.sum("c").alias("crossing")), "key", "left").fillna(0, ["crossing"])


def imbalance(items: DataFrame, stratum: str, split: str = "split") -> DataFrame:
    """One row, spread_pp: the most that a stratum's shares (percentage points) of two splits differ. A split without a stratum's rows has a share of 0 of it."""
    cells = items.where(F.col(split).isNotNull()).groupBy(F.col(split).alias("split"), F.col(stratum).alias("stratum")).agg(F.count(F.lit(1)).alias("n"))
    totals = cells.groupBy("split").agg(F.sum("n").alias("all"))
    count = totals.agg(F.count(F.lit(1)).alias("splits"))
    shares = cells.join(F.broadcast(totals), "split").withColumn("s", F.col("n") / F.col("all"))  # a row a split
    by = shares.groupBy("stratum").agg(F.max("s").alias("most"), F.min("s").alias("least"), F.count(F.lit(1)).alias("k"))
    gap = F.col("most") - F.when(F.col("k") < F.col("splits"), 0.0).otherwise(F.col("least"))
    return by.crossJoin(F.broadcast(count)).agg((100 * F.max(gap)).alias("spread_pp"))  # one row
