"""Great-circle distances of ``lon,lat`` columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_METRES = 6372797.560856
# Metres of each unit.
UNITS = {"m": 1.0, "km": 1000.0, "mi": 1609.34, "ft": 0.3048}


def lon_lat(c: Column) -> tuple[Column, Column]:
    """The two numbers of a ``"lon,lat"`` text; null if it is no such text."""
    parts = F.split(c, ",")
    two = F.size(parts) == 2
    number = lambda i: F.when(two, F.trim(F.get(parts, F.lit(i))).try_cast("double"))
    return number(0), number(1)


def metres(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_METRES * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def within(c: Column, lon: float, lat: float, radius: float, unit: str) -> Column:
    """Points within ``radius`` of a point. A band of latitudes, cheap to test, comes before the exact distance."""
    x, y = lon_lat(c)
    limit = radius * UNITS[unit]
    band = math.degrees(limit / EARTH_METRES) + 1e-9
    return y.between(lat - band, lat + band) & (metres(F.lit(lon), F.lit(lat), x, y) <= limit)
