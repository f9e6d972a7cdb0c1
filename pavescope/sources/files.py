"""Readers and writers of the file formats beside Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as c

GPX = "_lat double, _lon double, time timestamp, ele double, speed double, sat int"
VOC = "filename string, size struct<width:int,height:int>, object array<struct<name:string,bndbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>>"


def read_gpx(spark: SparkSession, path: str) -> DataFrame:
    """Track points; a missing satellite count is -1, a missing speed null."""
    points = spark.read.format("xml").option("rowTag", "trkpt").schema(GPX).load(path)
    return points.select(F.col("time").alias("timestamp"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), "ele", "speed", F.coalesce("sat", F.lit(-1)).alias("sat"))


def read_voc(spark: SparkSession, path: str) -> DataFrame:
    """A row for each annotated object with a whole box; names stripped, in upper case."""
    notes = spark.read.format("xml").option("rowTag", "annotation").schema(VOC).load(path)
    rows = notes.select("filename", "size.width", "size.height", F.explode("object").alias("o"))
    out = rows.select("filename", "width", "height", F.upper(F.trim("o.name")).alias("cls"), "o.bndbox.*")
    return out.dropna(subset=["xmin", "ymin", "xmax", "ymax"])


def normalised(objects: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Boxes of the known classes clipped to the image, in shares of its size to six decimals; boxes without extent go.

    sizes: filename, width and height of images, which stand in for sizes of zero; images without any size go.
    """
    if sizes is not None:
        objects = objects.join(sizes.select("filename", F.col("width").alias("_w"), F.col("height").alias("_h")), "filename", "left")
        real = lambda k, other: F.when(F.coalesce(k, F.lit(0)) > 0, F.col(k)).otherwise(F.col(other)).alias(k)
        objects = objects.select(*[real(k, f"_{k[0]}") if k in ("width", "height") else F.col(k) for k in objects.columns if k not in ("_w", "_h")])
    objects = objects.where(F.col("cls").isin(*c.CLASSES))
    inside = lambda k, n: F.least(F.greatest(F.col(k), F.lit(0.0)), F.col(n).cast("double"))
    clipped = objects.where("width > 0 AND height > 0").select("filename", "cls", "width", "height", *[inside(k, n).alias(k) for k, n in (("xmin", "width"), ("ymin", "height"), ("xmax", "width"), ("ymax", "height"))]).where("xmax > xmin AND ymax > ymin")
    share = lambda e, n: F.round(e / F.col(n), 6)
    return clipped.select("filename", "cls", share((F.col("xmin") + F.col("xmax")) / 2, "width").alias("cx"), share((F.col("ymin") + F.col("ymax")) / 2, "height").alias("cy"), share(F.col("xmax") - F.col("xmin"), "width").alias("w"), share(F.col("ymax") - F.col("ymin"), "height").alias("h"))


def read_csv(spark: SparkSession, path: str, schema: str, separator: str = ",", encoding: str = "UTF-8") -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, sep=separator, encoding=encoding)


def read_features(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """GeoJSON points: lat, lon and the named properties (a DDL list)."""
    schema = f"features array<struct<geometry:struct<coordinates:array<double>>,properties:struct<{properties}>>>"
    rows = spark.read.json(path, schema=schema, multiLine=True).select(F.explode("features").alias("f"))
    return rows.select(F.get("f.geometry.coordinates", F.lit(1)).alias("lat"), F.get("f.geometry.coordinates", F.lit(0)).alias("lon"), "f.properties.*")


def ordered(df: DataFrame, dictionary: list[str]) -> DataFrame:
    """The columns of a data dictionary, in its order; fails where df lacks one or has others."""
    if odd := set(df.columns) ^ set(dictionary):
        raise ValueError(f"columns differ from the dictionary: {sorted(odd)}")
    return df.select(*dictionary)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, floating-point columns with four decimals."""
    kinds = dict(df.dtypes)
    df.select(*[F.format_string("%.4f", k).alias(k) if kinds[k] in ("double", "float") else F.col(k) for k in df.columns]).write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_yolo(boxes: DataFrame, path: str) -> None:
    """One line of text a box (class number, cx, cy, w, h), in a folder for each split."""
    line = F.format_string("%d %.6f %.6f %.6f %.6f", "class_id", "cx", "cy", "w", "h")
    boxes.select("split", F.concat_ws("\t", F.col("image_id").cast("string"), line).alias("value")).write.mode("overwrite").partitionBy("split").text(path)
