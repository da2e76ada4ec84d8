"""Great-circle distances and boxes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_KM = 6371.0087714


def distance_km(lat: Column, lon: Column, at_lat: float, at_lon: float) -> Column:
    p, q = F.radians(lat), F.radians(F.lit(at_lat))
    h = F.pow(F.sin((p - q) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lon - F.lit(at_lon)) / 2), 2)
    return 2 * RADIUS_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def in_box(lat: Column, lon: Column, south: float, north: float, west: float, east: float) -> Column:
    """A box whose west lies east of its east crosses the date line."""
    inside = lon.between(west, east) if west <= east else (lon >= west) | (lon <= east)
    return lat.between(south, north) & inside
