"""Gradient hashes of images, joins of hashes, components of edge tables, and orders and folds of groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut


def components(edges: DataFrame) -> DataFrame:
    """node and component (the least node reachable) of edges a, b: least labels of neighbours, then of the label's own label.

    Each round is checkpointed; rounds grow with the logarithm of the longest path in practice.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    both = cut(both)
    label = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("near")).withColumnRenamed("a", "node")
        best = label.join(near, "node").select("node", F.col("component").alias("before"), F.least("component", "near").alias("best"))
        jump = label.select(F.col("node").alias("best"), F.col("component").alias("jumped"))
        after = cut(best.join(jump, "best", "left").select("node", "before", F.least("best", F.coalesce("jumped", "best")).alias("component")))
        label = after.select("node", "component")
        if after.where("before != component").isEmpty():
            return label


HASH_BITS, WORD_BITS, ROW = 256, 32, 16


def gradient_hash(images: DataFrame, pixels: str) -> DataFrame:
    """images with ``bits``: for 16 rows of 17 pixels, whether a pixel is over the one before it. Fewer pixels go round again; null pixels give 0."""
    at = F.array(*[F.lit(i // ROW * (ROW + 1) + i % ROW) for i in range(HASH_BITS)])
    size = F.size(pixels)
    over = lambda i: F.coalesce(F.get(pixels, F.pmod(i + 1, size)) > F.get(pixels, F.pmod(i, size)), F.lit(False))
    return images.where(size > 0).withColumn("bits", F.transform(at, lambda i: over(i).cast("long")))


def _number(first: int, n: int) -> Column:
    return F.aggregate(F.slice("bits", first + 1, n), F.lit(0).cast("long"), lambda acc, b: acc * 2 + b)


def words() -> list[Column]:
    """bits as longs of 32 bits, w0 and on."""
    return [_number(WORD_BITS * w, WORD_BITS).alias(f"w{w}") for w in range(HASH_BITS // WORD_BITS)]


def _met(hashed: DataFrame, key: str, most: int) -> tuple[DataFrame, DataFrame]:
    """k and first (the least key of equal bits) of every key, and pairs a < b of such firsts whose bits differ in at most ``most`` places, with how many.

    Of most + 1 bands such a pair has one in common, so candidates come from an equi-join of bands.
    """
    same = hashed.groupBy("bits").agg(F.min(key).alias("first"))
    one = same.select("first", "bits", *words())
    edges = [HASH_BITS * b // (most + 1) for b in range(most + 2)]
    bands = F.posexplode(F.array(*[_number(a, b - a) for a, b in zip(edges, edges[1:])])).alias("band", "value")
    names = [f"w{w}" for w in range(HASH_BITS // WORD_BITS)]
    dealt = one.select("first", *names, bands)
    left, right = (dealt.select("band", "value", F.col("first").alias(k), *[F.col(w).alias(f"{k}_{w}") for w in names]) for k in "ab")
    apart = reduce(lambda p, q: p + q, [F.bit_count(F.col(f"a_{w}").bitwiseXOR(F.col(f"b_{w}"))) for w in names])
    pairs = left.join(right, ["band", "value"]).where((F.col("a") < F.col("b")) & (apart <= most)).select("a", "b", apart.alias("bits")).distinct()
    return hashed.select(F.col(key).alias("k"), "bits").join(same, "bits").select("k", "first"), pairs


def hash_edges(hashed: DataFrame, key: str, most: int) -> DataFrame:
    """Edges a, b that connect what near_hashes() connects: every key with the least one of its bits, and those with each other.

    A group of m equal hashes gives m - 1 edges, not m * m.
    """
    of, pairs = _met(hashed, key, most)
    return of.where("k != first").select(F.col("first").alias("a"), F.col("k").alias("b")).unionByName(pairs.select("a", "b"))


def near_hashes(hashed: DataFrame, key: str, most: int) -> DataFrame:
    """Pairs a < b of keys whose bits differ in at most ``most`` places, with how many: exact. All pairs of equal bits are in it; for components use hash_edges()."""
    of, pairs = _met(hashed, key, most)
    firsts, seconds = of.toDF("ka", "a"), of.toDF("kb", "b")
    other = pairs.join(firsts, "a").join(seconds, "b").select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"), "bits")
    equal = of.toDF("ka", "first").join(of.toDF("kb", "first"), "first").where("ka < kb").select(F.col("ka").alias("a"), F.col("kb").alias("b"), F.lit(0).alias("bits"))
    return other.unionByName(equal)
