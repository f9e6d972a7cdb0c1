"""Readers of the city's open tables: road priorities with their shapes, crashes, schools and health centres."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as c
from ..functions import exprs as x
from ..functions import shapes


def _number(name: str) -> Column:
    """A number written with commas between thousands; null where there is none."""
    return F.expr(f"try_cast(replace(`{name}`, ',', '') AS double)")


def _read(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; a byte-order mark is no part of the first name."""
    raw = spark.read.csv(path, header=True, multiLine=False, escape='"', quote='"')
    return raw.toDF(*[k.lstrip("﻿") for k in raw.columns])


def read_roads(spark: SparkSession, path: str) -> DataFrame:
    """Road priorities from a CSV file, see roads()."""
    return roads(_read(spark, path))


def roads(raw: DataFrame) -> DataFrame:
    """Ids, sizes, scores, centroid (lat, lon) and both ends of the long axis (lat_a, lon_a, lat_b, lon_b; a is the western one).

    Rows whose shape is null, empty, broken or no polygon go; repeated rows stay. What is no number is null.
    """
    whole = lambda k: F.expr(f"try_cast(try_cast(replace(`{k}`, ',', '') AS decimal(38, 6)) AS bigint)")
    named = raw.select(
        *[whole(k).alias(n) for k, n in c.ROAD_IDS.items()], *[_number(k).alias(n) for k, n in (c.ROAD_SIZES | c.ROAD_SCORES).items()],
        *[F.col(k).alias(n) for k, n in c.ROAD_RANGE.items()], shapes.rings(F.col(c.ROAD_SHAPE)).alias("_shape"),
    ).where("_shape IS NOT NULL")
    ends = {k: F.get(of, F.lit(i)) for k, of, i in (("lat", "centre", 1), ("lon", "centre", 0), ("lat_a", "axis", 1), ("lon_a", "axis", 0), ("lat_b", "axis", 3), ("lon_b", "axis", 2))}
    return shapes.placed(named, "_shape").withColumns(ends).drop("centre", "axis")


def road_sums(read: DataFrame) -> DataFrame:
    """One row: shares of roads whose social score is the sum of its parts, and whose index is that of its dimensions. Null parts count as 0, null sums as wrong; null without roads."""
    total = lambda names: reduce(Column.__add__, [F.coalesce(k, F.lit(0.0)) for k in names])
    like = lambda names, whole: F.avg(F.coalesce(F.abs(total(names) - F.col(whole)) <= c.SUM_SLACK + 1e-5 * F.abs(F.col(whole)), F.lit(False)).cast("int"))
    return read.agg(like(c.SOCIAL_PARTS, "dim_social").alias("social"), like(c.INDEX_PARTS, "ip_umv").alias("index"))


def read_crashes(spark: SparkSession, path: str) -> DataFrame:
    """Crashes from a CSV file, see crashes()."""
    return crashes(_read(spark, path))


def crashes(raw: DataFrame) -> DataFrame:
    """lat, lon, gravedad, anio, civ, peso: crashes inside the city's bounds; decimal commas are read, unknown gravities weigh 1."""
    decimal = lambda k: F.expr(f"try_cast(replace(`{k}`, ',', '.') AS double)")
    named = raw.select(*[(decimal(k) if n in ("lat", "lon", "anio") else F.col(k)).alias(n) for k, n in c.CRASH_COLUMNS.items()])
    (south, north), (west, east) = c.CRASH_AREA
    weight = F.coalesce(reduce(lambda w, p: w.when(F.col("gravedad") == p[0], p[1]), c.CRASH_WEIGHT.items(), F), F.lit(1))
    return named.where(F.col("lat").between(south, north) & F.col("lon").between(west, east)).withColumn("peso", weight)


def _features(spark: SparkSession, path: str, properties: str) -> DataFrame:
    schema = f"features array<struct<geometry:struct<coordinates:array<double>>,properties:struct<{properties}>>>"
    rows = spark.read.json(path, schema=schema, multiLine=True).select(F.explode("features").alias("f"))
    return rows.select(F.get("f.geometry.coordinates", F.lit(0)).alias("x"), F.get("f.geometry.coordinates", F.lit(1)).alias("y"), "f.properties.*")


def read_schools(spark: SparkSession, path: str) -> DataFrame:
    """nombre, lat, lon. Where any coordinate of the file is beyond 180 all are metres of the web's Mercator projection, else degrees."""
    rows = _features(spark, path, "NOMBRE_EST:string")
    metres = rows.agg(F.coalesce(F.max(F.abs("x")) > 180, F.lit(False)).alias("_m"))
    lat, lon = x.mercator(F.col("x"), F.col("y"))
    pick = lambda a, b: F.when(F.col("_m"), a).otherwise(F.col(b))
    return rows.crossJoin(F.broadcast(metres)).select(F.col("NOMBRE_EST").alias("nombre"), pick(lat, "y").alias("lat"), pick(lon, "x").alias("lon"))  # one row


def read_health(spark: SparkSession, path: str) -> DataFrame:
    """nombre, lat, lon, hospital (a state enterprise, or named like one), publica. The second name stands in for a null or empty first."""
    name = F.coalesce(F.nullif("nombre", F.lit("")), F.nullif("nombre_pre", F.lit("")), F.lit(""))
    like = reduce(Column.__or__, [F.upper(name).contains(w) for w in c.HOSPITAL_WORDS])
    rows = _features(spark, path, "nombre:string,nombre_pre:string,ese:string,naturaleza:string")
    return rows.select(name.alias("nombre"), F.col("y").alias("lat"), F.col("x").alias("lon"), (like | (F.upper(F.coalesce("ese", F.lit(""))) == "SI")).alias("hospital"), (F.lower(F.coalesce("naturaleza", F.lit(""))) == "publica").alias("publica"))
