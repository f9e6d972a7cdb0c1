"""Column builders: box geometry, pavement index formulas, states and geography. All stay in generated code."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as c


def by_class(values: dict[str, float | Column], cls: Column, default: float | None = None) -> Column:
    pairs = list(values.items())
    first = F.when(cls == pairs[0][0], pairs[0][1])
    out = reduce(lambda e, kv: e.when(cls == kv[0], kv[1]), pairs[1:], first)
    return out if default is None else out.otherwise(default)


def box_density(cls: Column, w: Column, h: Column) -> Column:
    extent = {"D00": h, "D10": w, "D20": w * h, "D40": F.lit(1.0)}
    return by_class({k: F.lit(c.DENSITY[k]) * v for k, v in extent.items()}, cls, 0.0)


def size_proxy(cls: Column, cy: Column, w: Column, h: Column) -> Column:
    """Apparent size corrected for perspective: far boxes look smaller, and those over the horizon count three times."""
    below = cy - c.HORIZON
    scale = F.when(below > 0, F.least(F.greatest(0.6 / F.greatest(below, F.lit(1e-6)), F.lit(1.0)), F.lit(3.0))).otherwise(3.0)
    return scale * F.when(cls == "D00", h).when(cls == "D10", w).otherwise(F.sqrt(w * h))


def kappa(size: Column, low: Column, high: Column) -> Column:
    """Severity weight; a class without cutoffs stays in the middle."""
    return F.when(size < low, c.KAPPA_LOW).when(size >= high, c.KAPPA_HIGH).otherwise(c.KAPPA_MID)


def deduct(cls: str, rho: Column) -> Column:
    a, b, most = c.DEDUCT[cls]
    curve = F.least(F.greatest(a + b * F.log10(F.greatest(rho, F.lit(1e-9))), F.lit(0.0)), F.lit(most))
    return F.when(rho > 0, curve).otherwise(0.0)


def combined_deduct(values: list[Column]) -> Column:
    top, total = F.greatest(*values), reduce(lambda a, b: a + b, values)
    return F.least(F.lit(100.0), top + c.CDV_REST * (total - top))


def ride(iri: Column) -> Column:
    return 100.0 * F.exp(-c.RIDE_RATE * F.greatest(F.lit(0.0), iri - c.RIDE_FROM))


def icv(visual: Column, ride_index: Column) -> Column:
    return c.VISUAL * visual + (1 - c.VISUAL) * ride_index


def state(score: Column) -> Column:
    """Five levels by their lower bounds; null, NaN and negative scores are the worst."""
    out = F.when(score.isNull() | F.isnan(score), c.STATES[-1][0])
    for name, low in c.STATES:
        out = out.when(score >= low, name)
    return out.otherwise(c.STATES[-1][0])


def action(level: Column, dominant: Column) -> Column:
    return (
        F.when(level == "bueno", "mantenimiento_rutinario").when(level == "satisfactorio", "sellado_de_fisuras")
        .when(level == "regular", by_class({"D40": "bacheo", "D20": "parcheo"}, dominant, "sellado_de_fisuras"))
        .when(level == "malo", by_class({"D40": "bacheo", "D20": "rehabilitacion"}, dominant, "parcheo"))
        .otherwise(F.when(dominant == "D20", "reconstruccion").otherwise("rehabilitacion"))
    )


def in_road(cx: Column, cy: Column) -> Column:
    return (cy > 0.35) & (F.abs(cx - 0.5) < 0.38 + 0.12 * cy)


def wide_band(cls: Column, w: Column, h: Column) -> Column:
    return (cls == "D10") & (w > 0.5) & (h < 0.15)


def iou(a: str | Column, b: str | Column, shift: float = 0.0) -> Column:
    """Of the boxes in structs a and b (cx, cy, w, h), b moved down by shift."""
    of = lambda s, f: (F.col(s) if isinstance(s, str) else s)[f]
    span = lambda x, n: F.greatest(F.lit(0.0), F.least(of(a, x) + of(a, n) / 2, of(b, x) + (shift if x == "cy" else 0.0) + of(b, n) / 2) - F.greatest(of(a, x) - of(a, n) / 2, of(b, x) + (shift if x == "cy" else 0.0) - of(b, n) / 2))
    both = span("cx", "w") * span("cy", "h")
    return both / (of(a, "w") * of(a, "h") + of(b, "w") * of(b, "h") - both + 1e-9)


def haversine(lat: Column, lon: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat) / 2), 2) + F.cos(F.radians(lat)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon) / 2), 2)
    return 2 * c.EARTH_M * F.asin(F.sqrt(a))


def local_distance(lat: Column, lon: Column, lat0: float, lon0: float) -> Column:
    """Metres from a place in the plane that touches the earth there."""
    return F.hypot((lat - lat0) * 111320, (lon - lon0) * 111320 * F.cos(F.radians(F.lit(lat0))))


def mercator(x: Column, y: Column) -> tuple[Column, Column]:
    """Latitude and longitude of web-mercator metres."""
    half = math.pi * 6378137.0
    return F.degrees(2 * F.atan(F.exp(y / 6378137.0)) - math.pi / 2), x / half * 180


def geohash(lat: Column, lon: Column, length: int) -> Column:
    """Interleaved bits of the scaled coordinates, five to a character."""
    bits = length * 5
    n_lon, n_lat = (bits + 1) // 2, bits // 2
    scaled = lambda x, low, span, n: F.floor((x - low) / span * float(1 << n)).cast("long")
    x, y = scaled(lon, -180.0, 360.0, n_lon), scaled(lat, -90.0, 180.0, n_lat)
    alphabet = F.lit("0123456789bcdefghjkmnpqrstuvwxyz")

    def char(i: int) -> Column:
        value = F.lit(0).cast("long")
        for k in range(5 * i, 5 * i + 5):
            source, left = (x, n_lon - 1 - k // 2) if k % 2 == 0 else (y, n_lat - 1 - k // 2)
            value = value * 2 + F.shiftright(source, left).bitwiseAND(F.lit(1))
        return F.substring(alphabet, (value + 1).cast("int"), F.lit(1))

    return F.concat(*[char(i) for i in range(length)])


def capture_time(name: Column) -> Column:
    """Timestamp of a name like captura_20240131_235959_123_4.jpg; null for others."""
    digits = F.regexp_extract(name, r"^captura_(\d{8}_\d{6}_\d{3})_\d+\.jpg$", 1)
    return F.try_to_timestamp(F.nullif(digits, F.lit("")), F.lit("yyyyMMdd_HHmmss_SSS"))
