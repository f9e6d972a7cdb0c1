"""Seeded samples and row numbers of whole tables, without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Keys whose totals quantiles() sends to every task, at most.
FEW_KEYS = 10_000


def least_by_digest(rows: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """The n rows least by MD5 of key and seed: whole buckets of digests below the cut, and a rank inside its own bucket."""
    keyed = rows.withColumn("_d", F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")))).withColumn("_b", F.substring("_d", 1, 4))
    counts = keyed.groupBy("_b").agg(F.count(F.lit(1)).alias("_k"))  # 65,536 rows at most
    before = F.coalesce(F.sum("_k").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = counts.select("_b", "_k", (n - before).alias("_room")).where("_room > 0")
    near = keyed.join(F.broadcast(room), "_b")
    whole = near.where("_k <= _room")
    cut = near.where("_k > _room").withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("_d", key))).where("_r <= _room")
    return whole.select(*rows.columns).unionByName(cut.select(*rows.columns))


def numbered(rows: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """Rows numbered from 1 in an order: sorted by ranges, counted by partition, then numbered inside each."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    from ..session import cut

    ranged = cut(ranged)  # the ranges must be the same for counts and rows
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_k"))  # one row a partition
    start = F.coalesce(F.sum("_k").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(F.broadcast(counts.select("_part", start.alias("_start"))), "_part").withColumn(name, F.col("_start") + place).drop("_part", "_start")


def running(rows: DataFrame, order: list[str], amount: str, name: str) -> DataFrame:
    """rows with ``name``: the sum of amount over all rows earlier in an order. Rows are ranged as in numbered(); order must be unique."""
    from ..session import cut

    ranged = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))  # the ranges must be the same for sums and rows
    sums = ranged.groupBy("_part").agg(F.sum(amount).alias("_s"))  # one row a partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    start = sums.select("_part", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_start"))
    return ranged.join(F.broadcast(start), "_part").withColumn(name, F.col("_start") + F.coalesce(F.sum(amount).over(inside), F.lit(0))).drop("_part", "_start")


def quantiles(rows: DataFrame, value: str, shares: dict[str, float | Column], keys: list[str] | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation: one row a key (one row without keys; nulls where there are no values).

    Distinct values are counted and ranged over tasks, so neither a group nor the table is in one buffer.
    Null and NaN values are left out. A share may be a column over the group's ``n``.
    """
    keys = keys or []
    own = rows.select(*keys, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    counts = running(own.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_k")), [*keys, "_v"], "_k", "_before")
    totals = counts.groupBy(*keys).agg(F.sum("_k").alias("n"), F.min("_before").alias("_first"))
    if keys:
        from ..session import cut

        totals = cut(totals)  # keys may be nearly as many as rows: then their totals stay in the tasks
        full = counts.join(totals if totals.count() > FEW_KEYS else F.broadcast(totals), keys)
    else:
        full = counts.crossJoin(F.broadcast(totals))  # one row
    at, to = F.col("_before") - F.col("_first"), F.col("_before") - F.col("_first") + F.col("_k")
    out = []
    for name, share in shares.items():
        place = (F.col("n") - 1) * share
        pick = lambda rank: F.max(F.when((at <= rank) & (rank < to), F.col("_v")))  # noqa: E731, B023
        low, high = pick(F.floor(place)), pick(F.ceil(place))
        out.append((low + F.max(place - F.floor(place)) * (high - low)).alias(name))
    return full.groupBy(*keys).agg(*out)
