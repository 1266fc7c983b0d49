"""Distances on the sphere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import arg, finite, named

#: Kilometres.
RADIUS = 6371.0


@named("distance", args=(4, 4))
def distance(lon1: object, lat1: object, lon2: object, lat2: object) -> Column:
    """Kilometres on a great circle, by haversines; over the antimeridian where that is shorter."""
    lon1, lat1, lon2, lat2 = (arg(x).cast("double") for x in (lon1, lat1, lon2, lat2))
    turn = lon2 - lon1
    turn = F.when(turn > 180, turn - 360).when(turn < -180, turn + 360).otherwise(turn)
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(turn) / 2), 2)
    return finite(2 * RADIUS * F.asin(F.sqrt(F.least(a, F.lit(1.0)))))
