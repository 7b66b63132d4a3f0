"""Distances on the Earth's sphere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The mean radius of the Earth in metres (fixed value).
EARTH_RADIUS_M = 6_371_008.8


def geo_distance_m(lat1, lon1, lat2, lon2) -> Column:
    """Metres along the great circle, by the haversine formula; degrees in."""
    col = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    a, b, c, d = (F.radians(col(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((c - a) / 2), F.lit(2.0)) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), F.lit(2.0))
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), h))))
