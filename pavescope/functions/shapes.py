"""Polygons written as text: their rings, centroids, and the long axis of the least rotated rectangle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

_HEAD = r"(?i)^\s*(?:SRID=\d+;)?\s*(?:MULTI)?POLYGON\s*(?:ZM|Z|M)?\s*(?=\()"


def rings(text: Column) -> Column:
    """Rings of the text of a POLYGON or MULTIPOLYGON as array<struct<outer, points: array<struct<x, y>>>>; null for null, empty, other or broken ones.

    A ring that two parentheses or more open bounds a polygon, one that a single one opens is a hole in the polygon before it.
    A third and fourth coordinate are left out.
    """
    body = F.regexp_replace(text, _HEAD, "")
    frame = F.regexp_replace(F.regexp_replace(body, r"\([^()]+\)", "R"), r"\s", "")  # each ring as a letter
    whole = F.when(F.upper(text).contains("MULTI"), F.replace(F.replace(frame, F.lit(",R"), F.lit("")), F.lit(",(R)"), F.lit("")) == "((R))").otherwise(F.replace(frame, F.lit(",R"), F.lit("")) == "(R)")

    def point(p: Column) -> Column:
        parts = F.split(F.trim(F.regexp_replace(p, r"\s+", " ")), " ")
        return F.struct(F.get(parts, F.lit(0)).try_cast("double").alias("x"), F.get(parts, F.lit(1)).try_cast("double").alias("y"))

    one = lambda r: F.struct(
        (F.length(F.regexp_extract(F.regexp_replace(r, r"\s", ""), r"^\(+", 0)) > 1).alias("outer"),
        F.transform(F.split(F.regexp_replace(r, r"[()]", ""), ","), point).alias("points"),
    )
    found = F.transform(F.regexp_extract_all(body, F.lit(r"([(\s]*\([^()]+\))"), F.lit(1)), one)
    sound = F.forall(found, lambda r: F.forall(r["points"], lambda p: p["x"].isNotNull() & p["y"].isNotNull()))
    return F.when(text.rlike(_HEAD) & body.rlike(r"^[-+.,eE\d\s()]+$") & whole & sound, found)


def centroid(outer: list[bool], rings: list[np.ndarray]) -> np.ndarray:
    """x, y: the mean of the area, holes apart; of the edges where there is no area. Rings count by their bounds, whichever way they turn."""
    first = rings[0][0]
    area, moment, length, middle = 0.0, np.zeros(2), 0.0, np.zeros(2)
    for bounds, ring in zip(outer, rings):
        a = ring - first
        b = np.roll(a, -1, axis=0)
        cross, long = a[:, 0] * b[:, 1] - b[:, 0] * a[:, 1], np.hypot(*(b - a).T)
        way = np.sign(cross.sum()) * (1 if bounds else -1)
        area, moment = area + way * cross.sum(), moment + way * (cross @ (a + b)) / 3
        length, middle = length + long.sum(), middle + long @ (a + b) / 2
    return first + (moment / area if area > 0 else middle / length if length > 0 else 0.0)


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counterclockwise from the least (x, y); the ends alone where all lie on a line."""
    points = np.unique(points, axis=0)

    def chain(run: np.ndarray) -> list:
        out: list = []
        for p in run:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out

    return points if len(points) < 3 else np.array(chain(points)[:-1] + chain(points[::-1])[:-1])


def long_axis(points: np.ndarray) -> np.ndarray:
    """Ends (x, y, x, y) of the line through the middles of the shorter sides of the least rectangle about points; the lesser end first.

    Of rectangles of one area (to a billionth) the first along the hull counts. Points on a line give its ends.
    """
    corners = hull(points - points[0])
    if len(corners) < 3:
        return np.concatenate([corners[0], corners[-1]]) + np.tile(points[0], 2)
    edges = np.roll(corners, -1, axis=0) - corners
    along = edges / np.hypot(*edges.T)[:, None]
    across = np.stack([-along[:, 1], along[:, 0]], 1)
    angles = np.unwrap(np.arctan2(edges[:, 1], edges[:, 0]))

    def reach(to: np.ndarray) -> np.ndarray:
        """How far the hull goes in each direction: the corner where its edges turn past the normal, or one beside it."""
        turn = (np.arctan2(to[:, 1], to[:, 0]) + np.pi / 2 - angles[0]) % (2 * np.pi) + angles[0]
        at = np.searchsorted(angles, turn)
        return np.max([(corners[(at + k) % len(corners)] * to).sum(axis=1) for k in (-1, 0, 1)], axis=0)

    spans = [(-reach(-d), reach(d)) for d in (along, across)]
    area = (spans[0][1] - spans[0][0]) * (spans[1][1] - spans[1][0])
    i = int(np.flatnonzero(area <= area.min() * (1 + 1e-9))[0])
    (a0, a1), (b0, b1) = ((low[i], high[i]) for low, high in spans)
    if a1 - a0 >= b1 - b0:
        ends = [a * along[i] + (b0 + b1) / 2 * across[i] for a in (a0, a1)]
    else:
        ends = [(a0 + a1) / 2 * along[i] + b * across[i] for b in (b0, b1)]
    return np.concatenate(sorted(ends, key=tuple)) + np.tile(points[0], 2)


def placed(rows: DataFrame, shape: str) -> DataFrame:
    """rows without the rings in ``shape`` and with ``centre`` (x, y) and ``axis`` (x, y, x, y: both ends of the long axis), null for null."""
    keep = [f for f in rows.schema.fields if f.name != shape]
    kind = ArrayType(DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centres, axes = [], []
            for rings in batch.column(batch.schema.get_field_index(shape)).to_pylist():
                corners = [np.array([(p["x"], p["y"]) for p in r["points"]]) for r in rings or []]
                centres.append(centroid([r["outer"] for r in rings], corners) if rings else None)
                axes.append(long_axis(np.concatenate(corners)) if rings else None)
            own = [batch.column(batch.schema.get_field_index(f.name)) for f in keep]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(v, pa.list_(pa.float64())) for v in (centres, axes))], names=[*(f.name for f in keep), "centre", "axis"])

    return rows.mapInArrow(run, StructType([*keep, StructField("centre", kind), StructField("axis", kind)]))
