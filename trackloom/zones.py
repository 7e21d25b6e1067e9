"""The zone registry. All zones are rectangles, so containment is a half-open box test without a join."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Zone:
    zone_id: str
    name: str
    kind: str
    country: str | None
    sensitive: bool
    lat: tuple[float, float]
    lon: tuple[float, float]

    @property
    def ring(self) -> list[tuple[float, float]]:
        (a, b), (c, d) = self.lat, self.lon
        return [(a, c), (a, d), (b, d), (b, c)]


# The registry, in its order.
REGISTRY = (
    Zone("changi-terminal", "Changi Terminal Area (coarse)", "terminal", "SG", False, (1.25, 1.48), (103.90, 104.15)),
    Zone("seletar-terminal", "Seletar Terminal Area (coarse)", "terminal", "SG", False, (1.38, 1.46), (103.82, 103.92)),
    Zone("sg-strait-corridor", "Singapore Strait Overwater Corridor", "corridor", "SG", True, (1.05, 1.30), (103.50, 104.30)),
    Zone("riau-border-watch", "Riau Archipelago Border Watch", "border", None, True, (0.50, 1.10), (103.80, 104.70)),
    Zone("malacca-air-approach", "Malacca Strait Air Approaches", "corridor", None, False, (1.60, 3.20), (101.80, 103.30)),
    Zone("scs-gray-zone", "South China Sea (central) Watch", "watch", None, True, (4.0, 16.0), (109.0, 118.0)),
)
#: Sensitive zones first, each part in registry order: who a place in several zones is attributed to.
PRIORITY = tuple(sorted(REGISTRY, key=lambda z: not z.sensitive))


def inside(zone: Zone, lat: Column, lon: Column) -> Column:
    return (lat >= zone.lat[0]) & (lat < zone.lat[1]) & (lon >= zone.lon[0]) & (lon < zone.lon[1])


def zones_at(lat: Column, lon: Column, kind: str | None = None) -> Column:
    """Ids of all zones at a place, in registry order."""
    return F.array_compact(F.array(*[F.when(inside(z, lat, lon), F.lit(z.zone_id)) for z in REGISTRY if kind in (None, z.kind)]))


def zone_for(lat: Column, lon: Column, sensitive_only: bool = False) -> Column:
    """The zone a place is attributed to, or null."""
    return F.coalesce(*[F.when(inside(z, lat, lon), F.lit(z.zone_id)) for z in PRIORITY if z.sensitive or not sensitive_only])


def lookup(zone_id: Column, what: str) -> Column:
    """A registry field by zone id: six constants, no join."""
    out = None
    for z in REGISTRY:
        value = F.lit(getattr(z, what))
        out = F.when(zone_id == z.zone_id, value) if out is None else out.when(zone_id == z.zone_id, value)
    return out


def frame(spark: SparkSession) -> DataFrame:
    rows = [(i, z.zone_id, z.name, z.kind, z.country, z.sensitive, [{"lat": a, "lon": b} for a, b in z.ring]) for i, z in enumerate(REGISTRY)]
    return spark.createDataFrame(rows, "ordinal int, zone_id string, name string, kind string, country string, sensitive boolean, polygon array<struct<lat:double,lon:double>>")


def geojson(spark: SparkSession) -> DataFrame:
    """zone_id and the GeoJSON feature: a closed ring of [lon, lat]."""
    ring = F.transform(F.concat("polygon", F.slice("polygon", 1, 1)), lambda p: F.array(p["lon"], p["lat"]))
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"),
        F.struct("zone_id", "name", "kind", "country", "sensitive").alias("properties"),
    )
    return frame(spark).select("zone_id", F.to_json(feature).alias("feature"))
