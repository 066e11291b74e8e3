"""Distances on the globe as column expressions, in metres."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The mean radius of the Earth; semi-major axis, flattening of WGS84.
RADIUS, AXIS, FLAT = 6_371_000.0, 6_378_137.0, 1 / 298.257223563

MEASURES = ("cheap", "haversine", "geodesic")


def haversine(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    a = F.pow(F.sin(F.radians(y1 - y0) / 2), 2) + F.cos(F.radians(y0)) * F.cos(F.radians(y1)) * F.pow(F.sin(F.radians(x1 - x0) / 2), 2)
    return 2 * RADIUS * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def cheap(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The flat ruler at the middle latitude of each pair; for distances of a town."""
    e2 = FLAT * (2 - FLAT)
    c = F.cos(F.radians((y0 + y1) / 2))
    w2 = 1 / (1 - e2 * (1 - c * c))
    w = F.sqrt(w2)
    kx, ky = F.radians(F.lit(1.0)) * AXIS * w * c, F.radians(F.lit(1.0)) * AXIS * w * w2 * (1 - e2)
    span = F.pmod(x1 - x0 + 180, F.lit(360.0)) - 180
    return F.sqrt(F.pow(span * kx, 2) + F.pow((y1 - y0) * ky, 2))


def geodesic(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Distance on the ellipsoid to about its flattening squared (Andoyer and Lambert's correction of the great circle)."""
    u0, u1 = F.atan((1 - FLAT) * F.tan(F.radians(y0))), F.atan((1 - FLAT) * F.tan(F.radians(y1)))
    h = F.pow(F.sin((u1 - u0) / 2), 2) + F.cos(u0) * F.cos(u1) * F.pow(F.sin(F.radians(x1 - x0) / 2), 2)
    s = 2 * F.asin(F.least(F.lit(1.0), F.sqrt(h)))
    p, q = (u0 + u1) / 2, (u1 - u0) / 2
    big_x = (s - F.sin(s)) * F.pow(F.sin(p) * F.cos(q), 2) / F.pow(F.cos(s / 2), 2)
    big_y = (s + F.sin(s)) * F.pow(F.cos(p) * F.sin(q), 2) / F.pow(F.sin(s / 2), 2)
    return F.when(s < 1e-12, 0.0).otherwise(AXIS * (s - FLAT / 2 * (big_x + big_y)))


def distance(measure: str):
    if measure not in MEASURES:
        raise ValueError(f"unknown measure {measure!r}")
    return {"cheap": cheap, "haversine": haversine, "geodesic": geodesic}[measure]


def measure_for(points: DataFrame, x: str, y: str) -> str:
    """``cheap`` for tables whose box has a diagonal under 100 km, else ``haversine``."""
    lo = points.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    d = lo.select(haversine(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))).first()[0]
    return "cheap" if d is not None and d < 100_000 else "haversine"
