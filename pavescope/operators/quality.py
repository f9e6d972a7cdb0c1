"""Quality of captures in long form: photos, confidence, drift, depth against damage, repeats and reviewed presence.

Rows are level, id, block, metric, value, low, high (of a 95 % interval, else null) and n.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .. import config as c
from ..functions import exprs as x
from ..session import cut
from . import evaluation, pavement, sampling, study

PHOTO = ("brillo", "contraste", "nitidez", "jpeg_kb")
#: A correlation needs so many stretches, groups and photos of a run.
LEAST_STRETCHES, LEAST_GROUPS, LEAST_PHOTOS = 4, 3, 10
#: Resamples whose draws one task adds up at a time.
LOT = 25
#: Pairs of a key, and twice as many distinct ones of all keys, up to which a task makes whole resamples: four bytes a pair, and two or three a distinct one.
WHOLE = 1 << 25
#: Draws made at a time, and the multipliers of study.drawn() before and after its shift, taken together.
_CHUNK, _BEFORE, _AFTER = 1 << 16, 48_271 * 16_807 % study.PRIME, 39_373 * 48_271 % study.PRIME
_STEPS = (np.arange(_CHUNK) * _BEFORE % study.PRIME).astype(np.uint32)
OUT = ("level", "id", "block", "metric", "value", "low", "high", "n")


def long(wide: DataFrame, block: str, metrics: dict[str, Column], n: Column | str = "n", low: dict[str, Column] | None = None, high: dict[str, Column] | None = None, keep: str | None = None) -> DataFrame:
    """A row a metric of each row of wide (level, id and more). keep: a column whose value ends the names of metrics."""
    none, d = F.lit(None), lambda e: e.cast("double")
    name = lambda k: F.concat(F.lit(f"{k}_"), keep) if keep else F.lit(k)
    rows = [F.struct(name(k).alias("metric"), d(e).alias("value"), d((low or {}).get(k, none)).alias("low"), d((high or {}).get(k, none)).alias("high")) for k, e in metrics.items()]
    n = F.col(n) if isinstance(n, str) else n
    return wide.select(F.col("level"), F.col("id"), F.lit(block).alias("block"), n.cast("long").alias("n"), F.explode(F.array(*rows)).alias("m")).select("level", "id", "block", "m.*", "n").select(*OUT)


def unfiltered(boxes: DataFrame, cuts: DataFrame) -> DataFrame:
    """Per image, of all boxes: the most confidence, and by class the most confidence, the number and density over thresholds, and whether
    a true box (flag R) is there; the score of those densities."""
    own, over = (lambda k: F.col("cls") == k), F.col("conf") >= x.by_class(c.TAU_FIELD, F.col("cls"))
    sums = pavement.weighted(boxes, cuts).groupBy("image_id").agg(
        F.max("conf").alias("raw_max"), *[F.max(F.when(own(k), F.col("conf"))).alias(f"raw_conf_{k}") for k in c.CLASSES], *[F.count_if(own(k) & over).alias(f"raw_n_{k}") for k in c.CLASSES],
        *[F.coalesce(F.sum(F.when(own(k) & over, F.col("rho"))), F.lit(0.0)).alias(f"rho_{k}") for k in c.CLASSES], *[F.max((own(k) & (F.col("flag") == "R")).cast("int")).alias(f"true_{k}") for k in c.CLASSES],
    )
    scored = pavement.scored(sums).withColumn("pci_det", F.round(F.col("pci_vis") + 1e-9, 6))
    return scored.select("image_id", "raw_max", "pci_det", *[f"{p}_{k}" for p in ("raw_conf", "raw_n", "true") for k in c.CLASSES], *[F.col(f"rho_{k}").alias(f"raw_rho_{k}") for k in c.CLASSES])


def flagged(photos: DataFrame, reference: DataFrame) -> DataFrame:
    """photos with borrosa, oscura and sobreexpuesta: outside what the reference's photos are (its 5th percentile of nitidez, its 2nd and 98th of brillo)."""
    sharp = sampling.quantiles(reference, "nitidez", {"_sharp": 0.05})
    light = sampling.quantiles(reference, "brillo", {"_dark": 0.02, "_bright": 0.98})
    out = photos.crossJoin(F.broadcast(sharp)).crossJoin(F.broadcast(light))  # one row each
    return out.withColumn("borrosa", F.col("nitidez") < F.col("_sharp")).withColumn("oscura", F.col("brillo") < F.col("_dark")).withColumn("sobreexpuesta", F.col("brillo") > F.col("_bright")).drop("_sharp", "_dark", "_bright")


def _ranked(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """rows with average ranks of value by key, from counts of distinct values: no key lies in one task. A row a key is sent to all tasks."""
    counts = sampling.running(rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("_k")), [key, value], "_k", "_before")
    first = counts.groupBy(key).agg(F.min("_before").alias("_first"))
    ranks = counts.join(F.broadcast(first), key).select(key, value, (F.col("_before") - F.col("_first") + (F.col("_k") + 1) / 2).alias(name))
    return rows.join(ranks, [key, value])


def _corr(a: str, b: str) -> Column:
    return F.when((F.min(a) < F.max(a)) & (F.min(b) < F.max(b)), F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a)) * F.sqrt(F.var_pop(b))))


def correlations(rows: DataFrame, key: str, least: int) -> DataFrame:
    """key, n, spearman and pearson of a and b by key (few keys); null for a constant side, no row for fewer than ``least`` pairs."""
    known = rows.where(evaluation.finite("a", "b"))
    ranked = _ranked(_ranked(known, key, "a", "ra"), key, "b", "rb")
    return ranked.groupBy(key).agg(F.count(F.lit(1)).alias("n"), _corr("ra", "rb").alias("spearman"), _corr("a", "b").alias("pearson")).where(F.col("n") >= least)


def rank_intervals(rows: DataFrame, key: str, reps: int) -> DataFrame:
    """key, low and high of the 95 % interval of Spearman's correlation of a and b by key (few keys): reps resamples of as many pairs, drawn with replacement.

    b takes few values, a any number. Pairs are numbered by key in order of a and b; draws are those of study.drawn(). Up to WHOLE pairs a task makes whole resamples
    beside packed cells, which all tasks get, and nothing is shuffled. Of more, tasks draw for batches of numbers and send each block of BLOCK numbers, by lots of LOT resamples, what was drawn of it; keys with as many pairs share their draws. A block adds up its own ranks
    by value of b, and those of its first and last value of a apart, which other blocks may share; blocks of a lot are then put in order. Resamples with two distinct values of a side or fewer are left out.
    """
    cells = rows.where(evaluation.finite("a", "b")).groupBy(key, "a", "b").agg(F.count(F.lit(1)).alias("_k"))
    cells = sampling.running(cells, [key, "a", "b"], "_k", "_before")
    totals = cells.groupBy(key).agg(F.min("_before").alias("_first"), F.sum("_k").alias("_m"))
    start = F.col("_before") - F.col("_first")
    placed = cut(cells.join(F.broadcast(totals), key).select(key, "a", "b", start.alias("_from"), (start + F.col("_k")).alias("_to"), "_m"))  # a row a key
    sizes = placed.groupBy("_m").agg(F.count(F.lit(1)).alias("cells")).orderBy("_m").collect()
    whole, sizes = [[r["_m"] for r in sizes if (max(r["_m"], r["cells"] / 2) <= WHOLE) == w] for w in (True, False)]
    block, spark = study.BLOCK, rows.sparkSession
    blocks = F.explode(F.sequence(F.expr(f"_from div {block}"), F.expr(f"(_to - 1) div {block}"))).alias("block")
    tables = placed.select("_m", key, "a", "b", "_from", "_to", blocks).select("_m", "block", F.col(key).alias("key"), "a", "b", F.greatest(F.col("_from") - F.col("block") * block, F.lit(0)).cast("int").alias("at"))
    packed = tables.groupBy("_m", "block").applyInArrow(_tables, "_m long, block long, key string, a binary, b binary, at binary")
    found = [_whole(packed.where(F.col("_m") == m), m, reps, block) for m in whole]
    if sizes:
        found.append(_by_blocks(packed.where(F.col("_m").isin(sizes)), sizes, reps, block))
    found = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "key string, rho double")
    ends = found.groupBy("key").agg(*[F.percentile("rho", F.lit(q)).alias(k) for k, q in (("low", study.LOW), ("high", study.HIGH))])  # reps values a key
    return ends.withColumnRenamed("key", key)


def _by_blocks(packed: DataFrame, sizes: list[int], reps: int, block: int) -> DataFrame:
    """key and rho of every resample of keys with these numbers of pairs: draws go to the blocks that they fall in."""
    spark = packed.sparkSession
    lots = F.explode(F.sequence(F.lit(0), F.lit(reps - 1), F.lit(LOT))).alias("lot")
    sent = packed.select("_m", "block", lots, F.lit(None).cast("binary").alias("drawn"), "key", "a", "b", "at")
    for m in sizes:
        drawn = spark.range(0, m, 1, max(1, -(-m * reps // study.DRAWS))).mapInArrow(_draws(m, reps, block), "block long, lot int, drawn binary")
        sent = sent.unionByName(drawn.withColumn("_m", F.lit(m).cast("long")), allowMissingColumns=True)
    added = sent.groupBy("_m", "block", "lot").applyInArrow(_added(reps, block), "key string, block long, lot int, values binary, sums binary, first double, last double, groups long")
    return added.groupBy("key", "lot").applyInArrow(_joined, "key string, rho double").where("NOT isnan(rho)")


def _whole(packed: DataFrame, m: int, reps: int, block: int) -> DataFrame:
    """key and rho of every resample of keys with m pairs: a task makes all draws of a resample and holds them in order."""
    spark = packed.sparkSession
    dense = packed.groupBy("key", "block").applyInArrow(_dense(m, block), "key string, block long, `values` binary, code binary, heads binary, at binary, first double, last double")
    tables = spark.sparkContext.broadcast(dense.toArrow())
    return spark.range(0, reps, 1, max(1, min(reps, -(-m * reps // study.DRAWS)))).mapInArrow(_resampled(tables, m, block), "key string, rho double")


def _narrow(v: np.ndarray) -> bytes:
    """Whole numbers below 2^32 in as few bytes as they need, after one byte that says how many."""
    kind = np.min_scalar_type(int(v.max(initial=0)))
    return bytes([kind.itemsize]) + v.astype(kind).tobytes()


def _wide(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"u{packed[0]}", offset=1)


def _dense(m: int, block: int):
    """The cells of one key in one block: values of b and which of them a cell has, where values of a begin, and cells where they are not all places."""

    def run(part: pa.Table) -> pa.Table:
        row = part.to_pylist()[0]
        a, b, at = np.frombuffer(row["a"]), np.frombuffer(row["b"]), np.frombuffer(row["at"], np.uint16)
        values, code = np.unique(b, return_inverse=True)
        heads = np.r_[True, a[1:] != a[:-1]]
        places = None if len(at) == min(block, m - row["block"] * block) else at.tobytes()
        kinds = [pa.string(), pa.int64(), *[pa.binary()] * 4, pa.float64(), pa.float64()]
        out = [row["key"], row["block"], values.tobytes(), _narrow(code), np.packbits(heads).tobytes(), places, a[0], a[-1]]
        return pa.table([pa.array([v], k) for v, k in zip(out, kinds)], names=["key", "block", "values", "code", "heads", "at", "first", "last"])

    return run


def _places(start: int, many: int, rep: int, m: int) -> np.ndarray:
    """study.drawn() of up to _CHUNK numbers from start: what one resample draws. A sum or fold below 2 PRIME loses PRIME where it holds it."""
    p = np.uint32(study.PRIME)
    h = _STEPS[:many] + np.uint32((start * _BEFORE + (rep * 69_621 + 12_345) * 16_807) % study.PRIME)
    h = np.minimum(h, h - p)
    h ^= h >> np.uint32(13)
    h = h * np.uint64(_AFTER)
    h = ((h >> np.uint64(31)) + (h & np.uint64(p))).astype(np.uint32)
    h = np.minimum(h, h - p)
    return h - h // np.uint32(m) * np.uint32(m)


def _resampled(tables, m: int, block: int):
    centre = (m + 1) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = {}
        for row in tables.value.sort_by([("key", "ascending"), ("block", "ascending")]).to_pylist():
            keys.setdefault(row["key"], []).append(row)
        every = {k: np.unique(np.concatenate([np.frombuffer(r["values"]) for r in rows])) for k, rows in keys.items()}
        place, starts = np.empty(m, np.uint32), np.append(np.arange(0, m, block), m)
        for batch in batches:
            for rep in batch.column(0).to_pylist():
                for i in range(0, m, _CHUNK):
                    place[i : i + _CHUNK] = _places(i, min(_CHUNK, m - i), rep, m)
                place.sort()
                ends = np.searchsorted(place, starts)
                sums = {k: _Sums(len(v)) for k, v in every.items()}
                for i, start in enumerate(starts[:-1]):
                    taken = np.bincount(place[ends[i] : ends[i + 1]] - np.uint32(start), minlength=min(block, m - start))
                    for k, rows in keys.items():
                        joined = [0 <= j < len(rows) and rows[min(i, j)]["last"] == rows[max(i, j)]["first"] for j in (i - 1, i + 1)]
                        sums[k].add(rows[i], taken, every[k], centre, *joined)
                rho = {k: s.correlation(centre) for k, s in sums.items()}
                out = [(k, v) for k, v in rho.items() if not np.isnan(v)]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.string()), pa.array([v for _, v in out], pa.float64())], names=["key", "rho"])

    return run


class _Sums:
    """One resample of a key, added up block after block: weights by value of b, alone and times the centred rank of a, and squares of that rank."""

    def __init__(self, many: int):
        self.total, self.crossed, self.squares, self.distinct, self.base, self.ends = np.zeros(many), np.zeros(many), 0.0, 0, 0, []

    def add(self, row: dict, taken: np.ndarray, every: np.ndarray, centre: float, before: bool, after: bool) -> None:
        """before, after: whether the block's first or last value of a is also in the block before or after. Those are ranked at the end."""
        weight = taken if row["at"] is None else np.add.reduceat(taken, np.frombuffer(row["at"], np.uint16).astype(np.int64))
        code, many = _wide(row["code"]), len(row["values"]) // 8
        to = np.searchsorted(every, np.frombuffer(row["values"]))
        heads = np.unpackbits(np.frombuffer(row["heads"], np.uint8), count=len(weight)).view(bool)
        at = np.flatnonzero(heads)
        own = weight if len(at) == len(weight) else np.add.reduceat(weight, at)
        past = np.cumsum(own) - own + self.base
        self.base += int(own.sum())
        mid = past + (own + 1) / 2 - centre
        counted = slice(int(before), len(own) - after if len(own) - after >= before else int(before))
        for first, open_ in ((True, before), (False, after)):
            if not open_:
                continue
            if first or len(at) > 1 or not before:
                cells = slice(0, at[1] if len(at) > 1 else len(weight)) if first else slice(at[-1], len(weight))
                held = np.zeros(len(every))
                held[to] = np.bincount(code[cells], weight[cells], many)
                if first:
                    self.ends[-1][1] += held
                else:
                    self.ends.append([past[-1], held])
            mid[0 if first else -1] = 0
        self.squares += float((own[counted] * mid[counted] ** 2).sum())
        self.distinct += int((own[counted] > 0).sum())
        self.total[to] += np.bincount(code, weight, many)
        self.crossed[to] += np.bincount(code, weight * (mid if len(at) == len(weight) else mid[np.cumsum(heads) - 1]), many)

    def correlation(self, centre: float) -> float:
        """NaN where a side has two distinct values or fewer."""
        for past, held in self.ends:
            own = held.sum()
            mid = past + (own + 1) / 2 - centre
            self.crossed, self.squares, self.distinct = self.crossed + held * mid, self.squares + own * mid**2, self.distinct + (own > 0)
        if self.distinct <= 2 or (self.total > 0).sum() <= 2:
            return float("nan")
        place = np.cumsum(self.total) - self.total + (self.total + 1) / 2 - centre
        return float((place * self.crossed).sum() / np.sqrt(self.squares * (self.total * place**2).sum()))


def _draws(m: int, reps: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy().astype(np.int64)
            for lot in range(0, reps, LOT):
                rep = np.arange(lot, min(lot + LOT, reps))
                h = (own[:, None] * 48_271 + rep * 69_621 + 12_345) % study.PRIME
                h = h * 16_807 % study.PRIME
                h = (h ^ (h >> 13)) * 39_373 % study.PRIME
                place = (h * 48_271 % study.PRIME % m).ravel()
                pairs = np.stack([np.tile(rep - lot, len(own)), place % size], 1).astype(np.uint16)[np.argsort(place // size, kind="stable")]
                ends = np.cumsum(np.bincount(place // size))
                out = [(b, pairs[i:j].tobytes()) for b, (i, j) in enumerate(zip([0, *ends[:-1]], ends)) if j > i]
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out]), pa.array([lot] * len(out), pa.int32()), pa.array([p for _, p in out], pa.binary())], names=["block", "lot", "drawn"])

    return run


def _tables(part: pa.Table) -> pa.Table:
    """The cells of one block, packed by key: values of both sides and where each cell begins."""
    part = part.sort_by([("key", "ascending"), ("at", "ascending")])
    key, out = np.array(part.column("key").to_pylist()), []
    for k in np.unique(key).tolist():
        at = np.flatnonzero(key == k)
        out.append((k, *(part.column(c).to_numpy()[at].astype(kind).tobytes() for c, kind in (("a", float), ("b", float), ("at", np.uint16)))))
    n, m, block = len(out), part.column("_m")[0].as_py(), part.column("block")[0].as_py()
    return pa.table([pa.array([m] * n), pa.array([block] * n), *(pa.array([r[i] for r in out], pa.string() if i == 0 else pa.binary()) for i in range(4))], names=["_m", "block", "key", "a", "b", "at"])


def _added(reps: int, most: int):
    def run(part: pa.Table) -> pa.Table:
        m, block, lot = (part.column(k)[0].as_py() for k in ("_m", "block", "lot"))
        size, many = min(most, m - block * most), min(LOT, reps - lot)
        pairs = np.frombuffer(b"".join(part.column("drawn").drop_null().to_pylist()), np.uint16).reshape(-1, 2).astype(np.int64)
        taken = np.bincount(pairs[:, 0] * size + pairs[:, 1], minlength=many * size).reshape(many, size)
        out = []
        for row in part.filter(pa.compute.is_valid(part.column("key"))).select(["key", "a", "b", "at"]).to_pylist():
            a, b, at = np.frombuffer(row["a"]), np.frombuffer(row["b"]), np.frombuffer(row["at"], np.uint16).astype(np.int64)
            values, code = np.unique(b, return_inverse=True)
            weight = np.add.reduceat(taken, at, axis=1).astype(float)
            heads = np.flatnonzero(np.diff(a, prepend=np.nan) != 0)
            group = np.cumsum(np.diff(a, prepend=a[0]) != 0)
            whole = np.add.reduceat(weight, heads, axis=1)
            mid = np.cumsum(whole, axis=1) - whole + (whole + 1) / 2
            last = len(heads) - 1
            inner = (group > 0) & (group < last)
            by_value = lambda w: np.stack([np.bincount(code, x, len(values)) for x in w])  # noqa: B023, E731
            own, centre = whole[:, 1:last], mid[:, 1:last]
            sums = [by_value(weight * inner), by_value(weight * inner * mid[:, group]), by_value(weight * (group == 0)), by_value(weight * ((group == last) & (last > 0)))]
            sums += [x.sum(axis=1)[:, None] for x in (own * centre**2, own * centre, own > 0)]
            out.append((row["key"], block, lot, values.tobytes(), np.hstack(sums).astype(float).tobytes(), a[0], a[-1], len(heads)))
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int64()]
        return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["key", "block", "lot", "values", "sums", "first", "last", "groups"])

    return run


def _joined(part: pa.Table) -> pa.Table:
    """Correlations of a lot's resamples from the sums of its blocks, in order; NaN where a side has two distinct values or fewer."""
    rows = part.sort_by("block").to_pylist()
    every = np.unique(np.concatenate([np.frombuffer(r["values"]) for r in rows]))
    base, ends = 0.0, []  # ends: values of a that blocks begin or end with, with what is before them and their weights by value of b
    total = crossed = squares = distinct = 0.0
    for r in rows:
        values = np.frombuffer(r["values"])
        f = len(values)
        sums, to = np.frombuffer(r["sums"]).reshape(-1, 4 * f + 3), np.searchsorted(every, values)
        inner, ranked, first, last = (_spread(sums[:, i * f : i * f + f], to, len(every)) for i in range(4))
        square, line, seen = sums[:, 4 * f :].T
        base = base + np.zeros(len(sums))
        if ends and ends[-1][0] == r["first"]:
            ends[-1][2] += first
        else:
            ends.append([r["first"], base, first])
        total, crossed = total + inner, crossed + ranked + base[:, None] * inner
        squares, distinct = squares + square + 2 * base * line + base**2 * inner.sum(axis=1), distinct + seen
        after = base + inner.sum(axis=1) + first.sum(axis=1)
        if r["groups"] > 1:
            ends.append([r["last"], after, last])
        base = after + last.sum(axis=1)
    for _, before, weight in ends:
        own = weight.sum(axis=1)
        mid = before + (own + 1) / 2
        total, crossed, squares, distinct = total + weight, crossed + weight * mid[:, None], squares + own * mid**2, distinct + (own > 0)
    place = np.cumsum(total, axis=1) - total + (total + 1) / 2
    flat = base * ((base + 1) / 2) ** 2
    with np.errstate(invalid="ignore", divide="ignore"):
        rho = ((place * crossed).sum(axis=1) - flat) / np.sqrt((squares - flat) * ((total * place**2).sum(axis=1) - flat))
    rho = np.where((distinct > 2) & ((total > 0).sum(axis=1) > 2), rho, np.nan)
    return pa.table([pa.array([rows[0]["key"]] * len(rho)), pa.array(rho)], names=["key", "rho"])


def _spread(sums: np.ndarray, to: np.ndarray, wide: int) -> np.ndarray:
    out = np.zeros((len(sums), wide))
    out[:, to] = sums
    return out


def photo_correlations(frames: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """segment_id, metric, n and spearman inside each run, of photos where both are known; runs of LEAST_PHOTOS such photos at least."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")) for k, (a, b) in pairs.items()])).alias("m")
    rows = frames.select("segment_id", each).select("segment_id", "m.*").where(evaluation.finite("a", "b"))
    of = Window.partitionBy("segment_id", "metric")
    rank = lambda v: F.rank().over(of.orderBy(v)) + (F.count(F.lit(1)).over(Window.partitionBy("segment_id", "metric", v)) - 1) / 2
    ranked = rows.select("segment_id", "metric", rank("a").alias("ra"), rank("b").alias("rb"))
    return ranked.groupBy("segment_id", "metric").agg(F.count(F.lit(1)).alias("n"), _corr("ra", "rb").alias("spearman")).where(F.col("n") >= LEAST_PHOTOS)


def repeats(stretches: DataFrame, measures: list[str], labels: dict[str, str]) -> DataFrame:
    """Rows of each site with two stretches or more: standard deviation and range of measures known twice, and whether labels agree."""
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [e.alias(f"{m}_{s}") for m in measures for s, e in (("n", F.count(m)), ("desv_est", F.stddev_samp(m)), ("rango", F.max(m) - F.min(m)))]
    aggs += [(F.min(v) == F.max(v)).cast("double").alias(k) for k, v in labels.items()]
    wide = stretches.where("site IS NOT NULL").groupBy(F.col("site").cast("string").alias("id")).agg(*aggs).where("n >= 2").withColumn("level", F.lit("sitio"))
    out = long(wide, "repetibilidad", {k: F.col(k) for k in labels})
    for m in measures:
        out = out.unionByName(long(wide.where(F.col(f"{m}_n") >= 2), "repetibilidad", {f"{m}_{s}": F.col(f"{m}_{s}") for s in ("desv_est", "rango")}, f"{m}_n"))
    return out


def presence(photos: DataFrame, judged: dict[str, tuple[Column, Column]]) -> DataFrame:
    """level, id, n and for each name its precision and recall over photos: said and truly are conditions."""
    aggs, ratio = [F.count(F.lit(1)).alias("n")], lambda hits, of: F.count_if(hits) / F.greatest(F.count_if(of), F.lit(1))
    for k, (said, truly) in judged.items():
        aggs += [ratio(said & truly, said).alias(f"precision_{k}"), ratio(said & truly, truly).alias(f"recall_{k}")]
    return photos.agg(*aggs).withColumns({"level": F.lit("foto"), "id": F.lit("MUESTRA")})
