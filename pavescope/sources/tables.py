"""Canonical frames of the engine, projected from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _class(key: str) -> Column:
    return F.element_at(F.array(*map(F.lit, ("D00", "D10", "D20", "D40"))), (F.col(key) % 4 + 1).cast("int"))


def all_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes in normalised image coordinates, truth ones included."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("image_id"), _class("l_partkey").alias("cls"), (F.col("l_quantity") / 50).alias("conf"),
        ((F.col("l_partkey") * 7 % 13 + 0.5) / 13).cast("double").alias("cx"), ((F.col("l_suppkey") * 13 % 11 + 0.5) / 11).cast("double").alias("cy"),
        (0.05 + 6 * F.col("l_discount")).alias("w"), (0.05 + 5 * F.col("l_tax")).alias("h"), F.col("l_returnflag").alias("flag"),
        "l_partkey", "l_suppkey", "l_linenumber",
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    place = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return orders.select(F.col("o_orderkey").alias("image_id"), F.col("o_custkey").alias("segment_id"), (F.row_number().over(place) - 1).alias("chain_pos"))


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes of each user: microseconds, and a walk of coordinates."""
    e = read(spark, sf_dir, "events")
    return e.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), (4.6 + (F.col("event_id") * 7919 % 1000) / 100000.0).cast("double").alias("lat"), (-74.1 + (F.col("event_id") * 104729 % 1000) / 100000.0).cast("double").alias("lon"), "value", "event_type")


def points(spark: SparkSession, sf_dir: str, table: str, key: str) -> DataFrame:
    return read(spark, sf_dir, table).select(F.col(key).alias("id"), (4.46 + (F.col(key) * 7919 % 3800) / 10000.0).cast("double").alias("lat"), (-74.23 + (F.col(key) * 104729 % 2300) / 10000.0).cast("double").alias("lon"))


#: The same frames for DuckDB.
SQL = {
    "boxes": "boxes AS (SELECT l_orderkey AS image_id, ['D00','D10','D20','D40'][1 + l_partkey % 4] AS cls, l_quantity / 50 AS conf, ((l_partkey * 7) % 13 + 0.5)::DOUBLE / 13 AS cx, ((l_suppkey * 13) % 11 + 0.5)::DOUBLE / 11 AS cy, 0.05 + 6 * l_discount AS w, 0.05 + 5 * l_tax AS h, l_returnflag AS flag, l_partkey, l_suppkey, l_linenumber FROM lineitem)",
    "frames": "frames AS (SELECT o_orderkey AS image_id, o_custkey AS segment_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS chain_pos FROM orders)",
    "track": "track AS (SELECT event_id, user_id, epoch_us(ts) AS us, 4.6 + ((event_id * 7919) % 1000)::DOUBLE / 100000 AS lat, -74.1 + ((event_id * 104729) % 1000)::DOUBLE / 100000 AS lon, value, event_type FROM events)",
    "customers": "q AS (SELECT c_custkey AS id, 4.46 + ((c_custkey * 7919) % 3800)::DOUBLE / 10000 AS lat, -74.23 + ((c_custkey * 104729) % 2300)::DOUBLE / 10000 AS lon FROM customer)",
    "suppliers": "r AS (SELECT s_suppkey AS id, 4.46 + ((s_suppkey * 7919) % 3800)::DOUBLE / 10000 AS lat, -74.23 + ((s_suppkey * 104729) % 2300)::DOUBLE / 10000 AS lon FROM supplier)",
}
