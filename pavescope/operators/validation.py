"""Assertions over the tables of a study, one row each, and texts held against their facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as c

#: Columns of the sensor table in order, most acceleration (m/s2), and the city's box (latitudes, longitudes).
SENSOR_COLUMNS = ("segment_id", "obs_id", "timestamp", "ax", "ay", "az", "gx", "gy", "gz", "lat", "lon", "speed_kmh")
MOST_G, CITY = 2 * 9.81 + 1e-6, ((4.4, 4.9), (-74.3, -73.9))
#: Numbers that texts may always hold, tolerances, words of a description and what is over.
ALWAYS, NEAR, NEAR_SHARE, MOST_WORDS, SPARE = (90, 100, 30, 6, 12, 250, 3), 0.6, 0.005, 80, 1.15
NUMBER = r"(?<![\p{L}\p{N}_])\d+(?:[.,]\d+)?"


class Failed(ValueError):
    """Assertions that did not hold."""


def _counted(name: str, rows: DataFrame, bad: Column) -> DataFrame:
    """One row: how many rows are bad; null counts as bad."""
    return rows.agg(F.count_if(F.coalesce(bad, F.lit(True))).alias("failures")).select(F.lit(name).alias("assertion"), "failures")


def _crossing(name: str, rows: DataFrame, key: str) -> DataFrame:
    """How many keys lie in several splits; null keys are none."""
    return _counted(name, rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct("split").alias("k")), F.col("k") != 1)


def _missing(name: str, needed: DataFrame, there: DataFrame, key: str) -> DataFrame:
    return _counted(name, needed.select(key).distinct().join(there.select(key).distinct(), key, "left_anti"), F.lit(True))


def assertions(images: DataFrame, boxes: DataFrame, labels: DataFrame, splits: DataFrame, sensors: DataFrame, expected: dict[str, int]) -> DataFrame:
    """assertion, failures and ok of the fifteen checks of a study; each is an aggregate or an anti join, and none stops the others.

    images: image_id, source, labeled. boxes: image_id, cls, cx, cy, w, h. labels: image_id of written label files. splits:
    image_id, segment_id, group_id, dup_cluster, split. sensors: SENSOR_COLUMNS. expected: images of each source. An
    empty table holds what is asked of every row. A sensor table without the columns fails its checks.
    """
    sized = [_counted(f"images_{s}", images.agg(F.count_if(F.col("source") == s).alias("n")), F.col("n") != n) for s, n in expected.items()]
    kept = splits.where("split != 'despliegue'")
    part = lambda k: F.col(k).between(0, 1)
    out = [
        *sized, _counted("boxes_in_0_1", boxes, ~(part("cx") & part("cy") & part("w") & part("h"))), _counted("box_classes", boxes, ~F.col("cls").isin(*c.CLASSES)),
        _missing("label_files", images.where("labeled"), labels, "image_id"), _counted("one_split_an_image", splits.groupBy("image_id").agg(F.count(F.lit(1)).alias("k")), F.col("k") != 1),
        _missing("images_in_splits", images, splits, "image_id"), _crossing("segments_in_one_split", splits, "segment_id"), _crossing("groups_in_one_split", kept, "group_id"), _crossing("clusters_in_one_split", kept, "dup_cluster"),
    ]
    whole = tuple(sensors.columns) == SENSOR_COLUMNS
    out.append(_counted("sensor_columns", sensors.limit(0).agg(F.count(F.lit(1)).alias("k")), F.lit(not whole)))
    if set(SENSOR_COLUMNS) <= set(sensors.columns):
        nulls = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in SENSOR_COLUMNS if k != "obs_id"])
        out += [
            _counted("sensors_without_nulls", sensors, nulls), _counted("acceleration_within_2_g", sensors, F.abs("az") > MOST_G),
            _counted("places_in_the_city", sensors, ~(F.col("lat").between(*CITY[0]) & F.col("lon").between(*CITY[1]))),
            _missing("segments_with_sensors", splits.where(F.col("split").isin("fusion", "test", "despliegue")), sensors, "segment_id"),
        ]
    return reduce(DataFrame.unionByName, out).withColumn("ok", F.col("failures") == 0)


def require(found: DataFrame) -> None:
    """Raises Failed with the assertions that did not hold; a command line ends with its code."""
    if bad := found.where("NOT ok").orderBy("assertion").collect():  # a row a check
        raise Failed("; ".join(f"{r['assertion']}: {r['failures']}" for r in bad))


def unbacked(text: Column, facts: Column) -> Column:
    """Numbers of a text that are near none of its facts (an array of doubles) nor of ALWAYS, as written."""
    known = F.concat(facts, F.array(*[F.lit(float(v)) for v in ALWAYS]))
    near = lambda v: F.exists(known, lambda f: F.abs(v - f) <= F.greatest(F.lit(NEAR), NEAR_SHARE * F.abs(f)))
    return F.filter(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda t: ~near(F.replace(t, F.lit(","), F.lit(".")).cast("double")))


def problems(description: Column, reason: Column, action: Column, state: Column, facts: Column) -> Column:
    """What is wrong with a described segment, as a list: numbers not backed, state not named, action not allowed, too long.

    Null texts are empty; a null or unknown state allows no action.
    """
    description, reason = F.coalesce(description, F.lit("")), F.coalesce(reason, F.lit(""))
    bad = unbacked(F.concat(description, F.lit(" "), reason), facts)
    allowed = reduce(lambda a, b: a | b, [(state == s) & action.isin(*names) for s, names in c.ALLOWED.items()])
    words = F.regexp_count(description, F.lit(r"[^\x20\x09-\x0D\x1C-\x1F\x85\xA0]+"))
    listed = F.array(
        F.when(F.size(bad) > 0, F.concat(F.lit("números no respaldados: "), F.array_join(bad, ", "))),
        F.when(~F.coalesce(F.contains(F.lower(description), F.translate(state, "_", " ")), F.lit(False)), "estado no mencionado o distinto"),
        F.when(~F.coalesce(allowed, F.lit(False)), "acción fuera de la tabla de reglas"), F.when(words > MOST_WORDS * SPARE, "descripción demasiado larga"),
    )
    return F.array_compact(listed)
