"""Geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..settings import EARTH_RADIUS_KM, KM_PER_NM


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Null if a coordinate is: ``least`` alone would pass a null over and say half the earth."""
    a = (
        F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0))
        + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    )
    return F.when((lat1 + lon1 + lat2 + lon2).isNotNull(), 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0)))))


def implied_speed_kt(km: Column, seconds: Column) -> Column:
    """0 where no time passed."""
    return F.when(seconds <= 0, F.lit(0.0)).otherwise(km / KM_PER_NM / (seconds / 3600.0))


def equirect_nm(lat: Column, lon: Column, lat0: Column, lon0: Column) -> Column:
    """Flat distance in nautical miles: 60 to a degree of latitude."""
    return F.hypot((lat - lat0) * 60.0, (lon - lon0) * 60.0 * F.cos(F.radians(lat0)))


def cell(x: Column, deg: float | Column) -> Column:
    return F.floor(x / deg).cast("long")


def ring_bounds(ring: Column) -> Column:
    """Bounding box of an array of (lat, lon) structs."""
    lats, lons = F.transform(ring, lambda p: p["lat"]), F.transform(ring, lambda p: p["lon"])
    return F.struct(
        F.array_min(lats).alias("min_lat"), F.array_min(lons).alias("min_lon"), F.array_max(lats).alias("max_lat"), F.array_max(lons).alias("max_lon")
    )


def in_ring(lat: Column, lon: Column, ring: Column) -> Column:
    """Is the point in the polygon, an array of (lat, lon) structs? Even-odd rule behind a box test; false for under 3 corners."""
    n = F.size(ring)
    box = ring_bounds(ring)

    def crossed(inside: Column, i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, F.when(i == 0, n - 1).otherwise(i - 1))
        spans = (a["lat"] > lat) != (b["lat"] > lat)
        where = (b["lon"] - a["lon"]) * (lat - a["lat"]) / F.when(b["lat"] != a["lat"], b["lat"] - a["lat"]).otherwise(1.0) + a["lon"]
        return F.when(spans & (lon < where), ~inside).otherwise(inside)

    walked = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(False), crossed)
    near = lat.between(box["min_lat"], box["max_lat"]) & lon.between(box["min_lon"], box["max_lon"])
    return F.when((n >= 3) & near, walked).otherwise(False)
