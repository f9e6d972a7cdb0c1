"""Running totals inside groups of any size: a hot group is spread over buckets of its order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_A_BUCKET = 50_000


def hash_bucket(rows: int, order: str) -> Column:
    """Leading bits of a 64-bit hash, so many that a bucket of a group holds about ROWS_A_BUCKET rows at most."""
    bits = max(1, -(-rows // ROWS_A_BUCKET)).bit_length()
    return F.shiftrightunsigned(F.col(order), 64 - bits)


def running_before(df: DataFrame, keys: list[str], bucket: Column, order: list[str], amount: Column, name: str) -> DataFrame:
    """df with ``name``: the sum of amount over the earlier rows of its group.

    Rows are ordered by (bucket, *order). Buckets are summed first, so a window sees a bucket's rows, or
    one row for each bucket of a group, and never a whole group. Keys must not be null.
    """
    df = df.withColumn("_bucket", bucket).withColumn("_amount", amount)
    sums = df.groupBy(*keys, "_bucket").agg(F.sum("_amount").alias("_sum"))
    ahead = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_bucket", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_inside", F.coalesce(F.sum("_amount").over(inside), F.lit(0)))
    return df.join(sums, [*keys, "_bucket"]).withColumn(name, F.col("_ahead") + F.col("_inside")).drop("_bucket", "_amount", "_ahead", "_inside")
