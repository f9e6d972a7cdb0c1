"""Resampling, splits, drift and geography around a study: draws by arithmetic hashes, folds by ranks, polygons by cells."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import cut
from . import evaluation, graph, sampling

LOW, HIGH = 0.025, 0.975
PRIME = 2_147_483_647
#: Where a count of a Poisson variable of mean one grows, in numbers below PRIME.
POISSON_STEPS = [int(PRIME * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(9)]
#: Numbers of groups, and resamples, whose counts one task of a bootstrap by draws holds at a time.
BLOCK, LOT = 1 << 16, 25
#: Draws that one task of such a bootstrap makes, about.
DRAWS = 1 << 24


def drawn(a: Column, b: Column, n: Column) -> Column:
    """A number from 0 to n - 1 that two numbers (up to some 10^9 and 10^6) fix, evenly spread: multiplications modulo 2^31 - 1."""
    p = PRIME
    h = (a * 48_271 + b * 69_621 + 12_345) % p
    h = (h * 16_807) % p
    h = (h.bitwiseXOR(F.shiftright(h, 13)) * 39_373) % p
    return (h * 48_271) % p % n


def resampled(key: Column, rep: Column) -> Column:
    """How often replicate rep takes the group of a whole-number key: a Poisson count of mean one, fixed by both, made where the group lies."""
    u = drawn(key, rep, F.lit(PRIME))
    return reduce(lambda a, b: a + b, [F.when(u >= step, 1).otherwise(0) for step in POISSON_STEPS])


def bootstrap_sums(groups: DataFrame, key: str, values: list[str], reps: int) -> DataFrame:
    """rep, groups (distinct ones taken), times and the sums of each of values over each of reps resamples. groups: one row a group, a whole-number key.

    The bootstrap with Poisson counts: groups are taken independently, so a row's replicates are added up in its own task and
    a task sends reps rows, whatever its groups.
    """
    each = groups.select(key, *values).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("_t", resampled(F.col(key), F.col("rep"))).where("_t > 0")
    return each.groupBy("rep").agg(F.count(F.lit(1)).alias("groups"), F.sum("_t").alias("times"), *[F.sum(F.col("_t") * F.col(v)).alias(v) for v in values])


def replaced_sums(groups: DataFrame, key: str, values: list[str], reps: int) -> DataFrame:
    """As bootstrap_sums(), but each resample draws as many groups as there are, with replacement. Groups are numbered in order of key, nulls last.

    Sums are as in SQL: null values add nothing, and a sum of nulls alone is null. ``<value>_known`` counts the draws with a value.
    A task draws for a batch of numbers and sends, to each block of BLOCK numbers and lot of LOT resamples, which of them were
    drawn: two bytes of place and two of resample a draw. A block's task then holds its own values and counts.
    """
    known = [f"{v}_known" for v in values]
    held = [*values, *known]
    given = groups.select(key, *[F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(v) for v in values], *[F.col(v).isNotNull().cast("double").alias(k) for v, k in zip(values, known)])
    numbered = cut(sampling.numbered(given, [F.col(key).asc_nulls_last()], "_n"))
    n, width = numbered.count(), len(held)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy().astype(np.int64)
            table = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], 1)
            blocks = own // BLOCK
            lying = [(b, np.flatnonzero(blocks == b)) for b in np.unique(blocks).tolist()]
            for lot in range(0, reps, LOT):
                rep = np.arange(lot, min(lot + LOT, reps))
                h = (own[:, None] * 48_271 + rep * 69_621 + 12_345) % PRIME
                h = h * 16_807 % PRIME
                h = (h ^ (h >> 13)) * 39_373 % PRIME
                place = (h * 48_271 % PRIME % n).ravel()
                pairs = np.stack([np.tile(rep - lot, len(own)), place % BLOCK], 1).astype(np.uint16)
                order = np.argsort(place // BLOCK, kind="stable")
                pairs, ends = pairs[order], np.cumsum(np.bincount(place // BLOCK, minlength=-(-n // BLOCK)))
                rows = [(b, pairs[start:end].tobytes(), None, None) for b, (start, end) in enumerate(zip([0, *ends[:-1]], ends)) if end > start]
                rows += [(b, None, (own[at] % BLOCK).astype(np.uint16).tobytes(), table[at].tobytes()) for b, at in lying]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([lot] * len(rows)), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3))], names=["block", "lot", "drawn", "place", "table"])

    def add(part: pa.Table) -> pa.Table:
        lot, size = part.column("lot")[0].as_py(), BLOCK if n > BLOCK else n
        pairs = np.frombuffer(b"".join(part.column("drawn").drop_null().to_pylist()), np.uint16).reshape(-1, 2).astype(np.int64)
        counts = np.bincount(pairs[:, 0] * size + pairs[:, 1], minlength=LOT * size).reshape(LOT, size)[: min(LOT, reps - lot)]
        table = np.zeros((size, width))
        for place, own in zip(part.column("place").drop_null().to_pylist(), part.column("table").drop_null().to_pylist()):
            table[np.frombuffer(place, np.uint16)] = np.frombuffer(own).reshape(-1, width)
        sound = np.isfinite(table)
        sums = counts @ np.where(sound, table, 0.0)
        if not sound.all():  # times 0 they would be NaN in resamples that did not draw them
            with np.errstate(invalid="ignore"):  # both infinities are NaN
                for odd, at in ((np.inf, table == np.inf), (-np.inf, table == -np.inf), (np.nan, np.isnan(table))):
                    sums += np.where(counts @ at > 0, odd, 0.0)
        return pa.table([pa.array(np.arange(lot, lot + len(counts))), pa.array((counts > 0).sum(1)), pa.array(counts.sum(1)), *map(pa.array, sums.T)], names=["rep", "groups", "times", *held])

    dealt = numbered.repartition(max(1, -(-n * reps // DRAWS)))  # few bytes a row, but reps draws
    sent = dealt.select((F.col("_n") - 1).alias("_n"), *held).mapInArrow(deal, "block long, lot long, drawn binary, place binary, table binary")
    kinds = ", ".join(f"`{v}` double" for v in held)
    parts = sent.groupBy("block", "lot").applyInArrow(add, f"rep long, groups long, times long, {kinds}")
    summed = parts.groupBy("rep").agg(*[F.sum(k).alias(k) for k in ("groups", "times", *held)])
    return summed.select("rep", "groups", "times", *[F.when(F.col(k) > 0, F.col(v)).alias(v) for v, k in zip(values, known)], *known)


def bootstrap_ratio(sums: DataFrame, key: str, over: str, under: str, reps: int, replaced: bool = False) -> DataFrame:
    """low and high of the 95 % interval of sum(over) / sum(under), resampled by group. sums: one row a group. Replicates without weight are left out.

    replaced: by draws with replacement, as many as groups, in place of independent counts.
    """
    resamples = replaced_sums if replaced else bootstrap_sums
    ratio = resamples(sums, key, [over, under], reps).select(F.try_divide(over, under).alias("v"))
    return ratio.agg(F.percentile("v", F.lit(LOW)).alias("low"), F.percentile("v", F.lit(HIGH)).alias("high"))  # reps values


def folds(groups: DataFrame, k: int, stratum: str | None = None) -> DataFrame:
    """groups (key, size and more) with ``fold`` (0 to k - 1): in each stratum, largest first, dealt forth and back, so folds have like sizes."""
    first = [stratum] if stratum else []
    order = [*first, "_less", "_h", "key"]
    ranked = sampling.numbered(groups.withColumn("_less", -F.col("size")).withColumn("_h", F.md5(F.col("key").cast("string"))), order, "_n")
    if stratum:
        start = ranked.groupBy(stratum).agg(F.min("_n").alias("_first"))
        ranked = ranked.join(F.broadcast(start), stratum).withColumn("_n", F.col("_n") - F.col("_first") + 1).drop("_first")  # a row a stratum
    place = F.pmod(F.col("_n") - 1, F.lit(2 * k))
    return ranked.withColumn("fold", F.when(place < k, place).otherwise(2 * k - 1 - place).cast("int")).drop("_n", "_less", "_h")


def merged_blocks(items: DataFrame) -> DataFrame:
    """block and group: blocks that share a cluster (items: block, cluster) belong together; the group is their least block."""
    first = items.groupBy("cluster").agg(F.min("block").alias("a"))
    edges = items.select("cluster", F.col("block").alias("b")).distinct().join(first, "cluster").where("a != b").select("a", "b").distinct()
    found = graph.components(edges).select(F.col("node").alias("block"), "component")
    return items.select("block").distinct().join(found, "block", "left").select("block", F.coalesce("component", "block").alias("group"))


def greedy_chain(hashes: np.ndarray) -> np.ndarray:
    """A tour from the first row, always to the nearest row not yet seen (Hamming distance; the first on ties)."""
    left, order, at = np.arange(len(hashes)), [], 0
    while len(left):
        here = left[at]
        order.append(here)
        left = np.delete(left, at)
        if len(left):
            at = int(np.bitwise_count(hashes[left] ^ hashes[here]).sum(1).argmin())
    return np.array(order, np.int64)


def chained(hashed: DataFrame, group: str, key: str) -> DataFrame:
    """group, key and chain_pos: the greedy tour of each group's hashes from its least key. A tour is sequential, so a group is one task."""
    names = [f"w{w}" for w in range(graph.HASH_BITS // graph.WORD_BITS)]

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by(key)
        tour = greedy_chain(np.stack([table.column(w).to_numpy() for w in names], 1))
        return pa.table({group: table.column(group).take(pa.array(tour)), key: table.column(key).take(pa.array(tour)), "chain_pos": pa.array(np.arange(len(tour)))})

    kinds = dict(hashed.dtypes)
    return hashed.select(group, key, *graph.words()).groupBy(group).applyInArrow(one, f"{group} {kinds[group]}, {key} {kinds[key]}, chain_pos long")


def drift(reference: DataFrame, batches: DataFrame, batch: str, values: list[str], bins: int = 10) -> DataFrame:
    """batch, variable and psi of every value in every batch against the reference: one plan, whatever their number. Rules as in stability_index()."""
    melted = lambda df, more: df.select(*more, F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("v")) for v in values])).alias("m")).select(*more, "m.*").where(evaluation.finite("v"))
    ref, cur = melted(reference, []), melted(batches, [batch])
    shares = {f"_q{i}": i / bins for i in range(bins + 1)}
    found = sampling.quantiles(ref, "v", shares, ["variable"]).select("variable", F.array_distinct(F.array(*shares)).alias("_all"))
    edges = found.select("variable", F.size("_all").alias("_many"), F.filter("_all", lambda e: (e != F.col("_all")[0]) & (e != F.array_max("_all"))).alias("_edges"))
    # a row a variable; as many comparisons as edges at most, which are compiled where a lambda is not
    place = reduce(lambda a, b: a + b, [F.when(F.get("_edges", F.lit(i)) <= F.col("v"), 1).otherwise(0) for i in range(bins)])
    binned = lambda df, keys, n: df.join(F.broadcast(edges), "variable").groupBy(*keys, "variable", place.alias("bin")).agg(F.count(F.lit(1)).alias(n))
    old, new = binned(ref, [], "r"), binned(cur, [batch], "c")
    # a row a batch, variable and bin
    bins_of = edges.select("variable", "_many", F.explode(F.sequence(F.lit(0), F.size("_edges"))).alias("bin"))
    spine = batches.select(batch).distinct().crossJoin(F.broadcast(bins_of))
    both = spine.join(old, ["variable", "bin"], "left").join(new, [batch, "variable", "bin"], "left").fillna(0, ["r", "c"]).where("r + c > 0")
    every = Window.partitionBy(batch, "variable")
    share = lambda k: F.greatest(F.try_divide(F.col(k), F.sum(k).over(every)), F.lit(1e-4))
    terms = both.select(batch, "variable", share("r").alias("rs"), share("c").alias("cs"), "r", "c", "_many")
    few = (F.sum("r") < evaluation.LEAST_ROWS) | (F.sum("c") < evaluation.LEAST_ROWS)
    psi = F.sum((F.col("cs") - F.col("rs")) * F.ln(F.col("cs") / F.col("rs")))
    return terms.groupBy(batch, "variable").agg(F.when(few, None).when(F.max("_many") < 3, 0.0).otherwise(psi).alias("psi"))


def rolled(daily: DataFrame, key: str, day: str) -> DataFrame:
    """Daily rain and temperatures of each cell with sums and means over the last 7, 30 and 365 rows, and wet days of the last 30."""
    last = lambda n: Window.partitionBy(key).orderBy(day).rowsBetween(1 - n, 0)
    rain = F.coalesce("rain", F.lit(0.0))
    return daily.select(
        key, day, rain.alias("rain_1d"), *[F.sum(rain).over(last(n)).alias(f"rain_{n}d") for n in (7, 30, 365)], F.count_if(rain >= 1).over(last(30)).alias("wet_days_30d"),
        F.avg("warm").over(last(7)).alias("warm_7d"), F.avg("cold").over(last(7)).alias("cold_7d"),
    )


def paired(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """The rows of left, in order, beside as many of right: no right row twice. Left rows beyond right's number go."""
    return sampling.numbered(left, left_order, "_n").join(sampling.numbered(right, right_order, "_n"), "_n").drop("_n")
