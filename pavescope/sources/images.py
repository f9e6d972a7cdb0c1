"""Folders of photos with annotations: manifests of files, the index of images, and lists of paths for training."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .. import config as c
from ..operators import sampling
from ..session import cut

NOTE = "size struct<width:int,height:int>, object array<struct<name:string,bndbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>>"


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """file (below the folder), sha1 and bytes of every file of a folder and those in it. A file is read whole by one task; no order.

    Files without bytes are left out, as in every scan by Spark.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath().rstrip("/")
    return files.select(F.split_part("path", F.lit(root + "/"), F.lit(-1)).alias("file"), F.sha1("content").alias("sha1"), F.col("length").alias("bytes"))


def changed(now: DataFrame, before: DataFrame) -> DataFrame:
    """file, change ('new', 'gone' or 'other'): files of two manifests that differ in content."""
    both = now.select("file", F.col("sha1").alias("_now")).join(before.select("file", F.col("sha1").alias("_before")), "file", "full")
    kind = F.when(F.col("_before").isNull(), "new").when(F.col("_now").isNull(), "gone").otherwise("other")
    return both.where("NOT _now <=> _before").select("file", kind.alias("change"))


def read_notes(spark: SparkSession, folder: str) -> DataFrame:
    """One row an annotation file: image_id (its name), width, height and objects (name in upper case, box), also where there are none."""
    notes = spark.read.format("xml").option("rowTag", "annotation").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xml").schema(NOTE).load(folder)
    name = F.regexp_extract(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), r"([^/]+)\.xml$", 1)
    objects = F.transform(F.coalesce("object", F.array()), lambda o: F.struct(F.upper(F.trim(o["name"])).alias("name"), o["bndbox"].alias("box")))
    return notes.select(name.alias("image_id"), "size.width", "size.height", objects.alias("objects"))


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """image_id, source, country, path and bytes of the photos at <source>/<country>/images/<image_id>.jpg; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jpg").load(folder).select("path", F.col("length").alias("bytes"))
    part = lambda i: F.regexp_extract("path", r"([^/]+)/([^/]+)/images/([^/]+)\.jpg$", i)
    return files.select(part(3).alias("image_id"), part(1).alias("source"), part(2).alias("country"), "path", "bytes").where("image_id != ''")


def index(photos: DataFrame, notes: DataFrame) -> DataFrame:
    """A row for each photo: its number (the digits of its name, -1 without or over 18), whether it has an annotation and one of no size,
    objects by class, others and their names, and whether it shows damage.

    Repeated annotations of an image count once, the first by width, height and objects; objects without a name are of another class.
    """
    first = F.row_number().over(Window.partitionBy("image_id").orderBy("width", "height", F.to_json("objects")))
    one = notes.where("image_id IS NOT NULL").withColumn("_n", first).where("_n = 1").drop("_n")
    joined = photos.join(one.withColumn("_note", F.lit(True)), "image_id", "left")
    named = F.transform(F.coalesce("objects", F.array()), lambda o: F.coalesce(o["name"], F.lit("")))
    joined = joined.withColumn("_names", named)
    count = lambda test: F.size(F.filter("_names", test))
    of = lambda k: count(lambda n: n == k)
    known = F.array(*map(F.lit, c.CLASSES))
    digits = F.regexp_replace("image_id", r"[^0-9]", "")
    size = F.coalesce("width", F.lit(0)), F.coalesce("height", F.lit(0))
    out = joined.select(
        *photos.columns, F.coalesce(digits.try_cast("bigint"), F.lit(-1)).alias("frame_num"), F.col("_note").isNotNull().alias("labeled"),
        (F.col("_note").isNotNull() & ((size[0] <= 0) | (size[1] <= 0))).alias("xml_zero_size"), (F.col("bytes") / 1024).alias("jpeg_kb"),
        *[of(k).alias(f"n_{k}") for k in c.CLASSES], count(lambda n: ~F.array_contains(known, n)).alias("n_otros"),
        F.array_join(F.array_sort(F.array_distinct(F.filter("_names", lambda n: ~F.array_contains(known, n)))), ",").alias("otros_clases"),
    )
    return out.withColumn("has_damage", F.greatest(*[F.col(f"n_{k}") for k in c.CLASSES]) > 0)


def lists(images: DataFrame, splits: DataFrame, negatives: float = 0.2, n_val: int = 1000, seed: int = 42) -> DataFrame:
    """list, path: photos (image_id, path, has_damage) by split; 'train' with at most that share of photos without damage, 'val' so many
    of the fusion split, 'all' all of them. Picks are the least by MD5 of image and seed; photos without a split are in no list.
    """
    # joined once and written: read for the room, the picks and the lists
    df = cut(splits.select("image_id", "split").join(images.select("image_id", "path", F.coalesce("has_damage", F.lit(False)).alias("has_damage")), "image_id"))
    train = df.where("split = 'train'")
    room = int(negatives * train.where("has_damage").count() / (1 - negatives) + 1e-9)
    picks = {"train": sampling.least_by_digest(train.where("NOT has_damage"), "image_id", seed, room), "val": sampling.least_by_digest(df.where("split = 'fusion'"), "image_id", seed, n_val)}
    own = F.when(F.col("split").isin("fusion", "test", "despliegue") | (F.col("split") == "train") & F.col("has_damage"), F.col("split"))
    out = df.select(F.explode(F.array_compact(F.array(F.lit("all"), own))).alias("list"), "path")
    for name, rows in picks.items():
        out = out.unionByName(rows.select(F.lit(name).alias("list"), "path"))
    return out


def write_lists(rows: DataFrame, folder: str) -> None:
    """A folder of text for each list, sorted by path inside each of its files, which follow one another in order."""
    rows.repartitionByRange("list", "path").sortWithinPartitions("list", "path").select("list", F.col("path").alias("value")).write.mode("overwrite").partitionBy("list").text(folder)
