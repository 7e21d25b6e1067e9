"""What an interface reads: lookups, bounded lists and GeoJSON. Limits here are the feature of a list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.timefn import iso
from .tracks import geometry


def _time(us: str) -> Column:
    return iso(F.timestamp_micros(us).cast("timestamp_ntz"))


def incident_rows(incidents: DataFrame) -> DataFrame:
    """Incidents as an interface shows them: times as text, empty lists for missing ones, ``evidence`` as JSON text."""
    return incidents.select(
        "incident_id", "icao24", "track_id", "detector", "incident_type", "score", "severity", "reliability", _time("start_us").alias("ts_start"), _time("end_us").alias("ts_end"),
        "lat", "lon", F.col("zone_id").alias("zone"), "affected_count", F.coalesce("techniques", F.array().cast("array<string>")).alias("techniques"), F.coalesce("evidence", F.lit("{}")).alias("evidence"),
    )


def incident(incidents: DataFrame, incident_id: str) -> DataFrame:
    """The incident of an id; no rows if there is none."""
    return incident_rows(incidents.where(F.col("incident_id") == incident_id))


def aircraft_list(identities: DataFrame, limit: int = 200) -> DataFrame:
    """Identities by address; the limit, at most 1,000, is the list's feature."""
    return identities.orderBy("icao24").limit(min(limit, 1_000))


def track_list(tracks: DataFrame, limit: int = 300) -> DataFrame:
    """Tracks by start; the limit, at most 2,000, is the list's feature."""
    return tracks.orderBy("start_us", "track_id").limit(min(limit, 2_000))


def track_features(tracks: DataFrame, positions: DataFrame) -> DataFrame:
    """track_id and its GeoJSON feature: a line of [lon, lat]."""
    line = geometry(tracks, positions).select("track_id", F.transform("points", lambda p: F.array(p["lon"], p["lat"])).alias("line"))
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("LineString").alias("type"), F.col("line").alias("coordinates")).alias("geometry"),
        F.struct("track_id", "icao24", _time("start_us").alias("start_ts"), _time("end_us").alias("end_ts"), "point_count", "distance_km").alias("properties"),
    )
    return tracks.join(line, "track_id").select("track_id", F.to_json(feature).alias("feature"))


def aircraft_track(positions: DataFrame, icao24: str, region: str | None = None) -> DataFrame:
    """One aircraft's reports with place and integrity, in order, of one region: the one given, or that of its newest report, which may be null."""
    own = positions.where(F.col("icao24") == icao24)
    if region is None:
        newest = F.max_by(F.struct("region"), F.struct("us", "id")).over(W.partitionBy("icao24"))
        own = own.withColumn("_r", newest).where(F.col("region").eqNullSafe(F.col("_r.region"))).drop("_r")
    else:
        own = own.where(F.col("region") == region)
    return own.select("icao24", "region", "us", _time("us").alias("ts"), "lon", "lat", F.coalesce("alt_baro_ft", F.lit(0.0)).alias("alt_ft"), "nic", "nac_p").orderBy("us")


def coarse_first(cells: DataFrame) -> DataFrame:
    """Cells in the order to draw them: large ones under small ones."""
    return cells.orderBy(F.desc("cell_deg"), "lat", "lon")


def last_runs(runs: DataFrame, n: int = 3) -> DataFrame:
    """The newest runs of a collector; the number is the report's feature."""
    return runs.orderBy(F.desc("id")).limit(n)


def scrubbed(x: Column) -> Column:
    """A double as JSON can hold it: as text, with the names of what is no number."""
    return F.when(F.isnan(x), F.lit("nan")).when(F.abs(x) == float("inf"), F.when(x > 0, F.lit("inf")).otherwise(F.lit("-inf"))).otherwise(x.cast("string"))
