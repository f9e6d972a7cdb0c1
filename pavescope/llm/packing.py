"""Packing by optimal length buckets.

Dynamic programming over the global histogram of lengths chooses the bucket boundaries with the least
padding. Inside each bucket, documents in hash order form batches of at most a token budget, padding included.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .running import hash_bucket, running_before

BUCKETS, BUDGET = 16, 65_536


def boundaries(lengths: np.ndarray, counts: np.ndarray, tokens: np.ndarray, buckets: int) -> list[int]:
    """The upper lengths of at most so many buckets with the least padding. lengths ascend; tokens: sum of true lengths of each."""
    n = len(lengths)
    if not n:
        return []
    c, t = np.r_[0, np.cumsum(counts)].astype(float), np.r_[0, np.cumsum(tokens)].astype(float)
    best = lengths * c[1:] - t[1:]
    froms = []
    for _ in range(min(buckets, n) - 1):
        now, back = best.copy(), np.full(n, -1)
        # the best split moves up with the length: halves of a range of lengths look on either side of its middle's
        open_ = [(1, n, 0, n - 1)]
        while open_:
            low, high, least, most = open_.pop()
            if low >= high:
                continue
            j = (low + high) // 2
            i = np.arange(least, min(most, j - 1) + 1)
            cost = best[i] + lengths[j] * (c[j + 1] - c[i + 1]) - (t[j + 1] - t[i + 1])
            at = int(cost.argmin())
            if cost[at] < now[j]:
                now[j], back[j] = cost[at], i[at]
            open_ += [(low, j, least, int(i[at])), (j + 1, high, int(i[at]), most)]
        froms.append(back)
        best = now
    out, j = {int(lengths[-1])}, n - 1
    for back in reversed(froms):
        if back[j] >= 0:  # else as good with one bucket less
            j = back[j]
            out.add(int(lengths[j]))
    return sorted(out)


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """doc_id, n_tokens (words), bucket, bucket_length, batch, slot and padding for each row of docs.

    Rows without words (null, empty) are in no bucket: nulls there and padding 0. A document longer than
    the budget is a batch of its own. Repeated rows are packed each. An empty table gives an empty result.
    """
    n_tokens = F.coalesce(F.regexp_count("text", F.lit(tx.WORD)), F.lit(0)).cast("long")
    sized = tx.written(docs.select("doc_id", n_tokens.alias("n_tokens")).withColumn("row", F.xxhash64("doc_id", "n_tokens")), "packing-lengths")
    histogram = sized.where("n_tokens > 0").groupBy(F.col("n_tokens").alias("length")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("tokens")).orderBy("length").toPandas()
    tops = boundaries(histogram.length.to_numpy(np.int64), histogram.n.to_numpy(np.int64), histogram.tokens.to_numpy(np.int64), buckets)
    bucket = F.lit(None).cast("int")
    top = F.lit(None).cast("long")
    for b in reversed(range(len(tops))):
        fits = (F.col("n_tokens") > 0) & (F.col("n_tokens") <= tops[b])
        bucket, top = F.when(fits, F.lit(b)).otherwise(bucket), F.when(fits, F.lit(tops[b]).cast("long")).otherwise(top)
    placed = sized.select("doc_id", "n_tokens", "row", bucket.alias("bucket"), top.alias("bucket_length"))
    full = running_before(placed.where("bucket IS NOT NULL"), ["bucket"], hash_bucket(int(histogram.n.sum()), "row"), ["row", "doc_id"], F.lit(1), "rank")
    room = F.greatest(F.lit(1), F.expr(f"{budget} div bucket_length"))
    full = full.withColumn("room", room).select("doc_id", "n_tokens", "bucket", "bucket_length", F.expr("rank div room").alias("batch"), F.expr("rank % room").alias("slot"), (F.col("bucket_length") - F.col("n_tokens")).alias("padding"))
    bare = placed.where("bucket IS NULL").select("doc_id", "n_tokens", "bucket", "bucket_length", F.lit(None).cast("long").alias("batch"), F.lit(None).cast("long").alias("slot"), F.lit(0).cast("long").alias("padding"))
    return full.unionByName(bare)
