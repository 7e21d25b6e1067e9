"""Where positions come from: a Parquet table of them, or the adapter over a generic event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: 2026-07-01 00:00 UTC, in microseconds since 1970.
EPOCH_US = 1_782_864_000_000_000


def scan(positions: DataFrame, region: str | None = None, since_us: int | None = None, until_us: int | None = None) -> DataFrame:
    """Reports with an integrity value that are airborne, of a region and a time (both ends included)."""
    out = positions.where(F.col("nic").isNotNull() & ~F.col("on_ground"))
    if region:
        out = out.where(F.col("region") == region)
    if since_us is not None:
        out = out.where(F.col("us") >= since_us)
    if until_us is not None:
        out = out.where(F.col("us") <= until_us)
    return out


#: The adapter as SQL text: a query parses it in one call, where columns put together one by one cost hundreds.
_REL = "timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts) div 720"
_BASE = ["event_id AS id", "user_id AS u", "cast(k AS bigint) AS k", f"{_REL} AS rel", f"({_REL}) / 1e6D AS t", "event_type", "user_id % 10 AS cls"]
_LAT = "CASE WHEN cls = 6 THEN 0.8D WHEN cls = 8 AND id % 2 = 0 THEN 3.9D WHEN cls = 8 THEN 1.2D ELSE 0.6D + cast(u % 13 AS double) * 0.1D END"
_LON = """CASE WHEN cls = 6 THEN 104.2D + cast(k - 50 AS double) * 0.0001D WHEN cls = 8 AND id % 2 = 0 THEN 104.4D WHEN cls = 8 THEN 103.6D
    ELSE 102.9D + cast(u % 17 AS double) * 0.1D + if(u % 2 = 0, 1D, -1D) * 0.002D * (t - 1800D) END"""
_JAMMED = "(abs(lat - 1.15D) <= 0.36D AND abs(lon - 103.9D) <= 0.36D AND t >= 1200 AND t < 2400 AND cls <> 8)"
_REPORT = [
    "id",
    "concat('a', lpad(cast(u AS string), 5, '0')) AS icao24",
    "timestamp_ntz'2026-07-01 00:00:00' + make_dt_interval(0, 0, 0, cast(cast(rel AS decimal(18,6)) / 1000000 AS decimal(18,6))) AS ts",
    f"{EPOCH_US} + rel AS us",
    "lat",
    "lon",
    "CASE WHEN k = 17 THEN NULL WHEN cls = 6 THEN cast(1800 + k AS double) ELSE cast(30000 + (u % 7) * 1500 AS double) END AS alt_baro_ft",
    "CASE WHEN k = 23 THEN NULL WHEN cls = 6 AND u % 20 = 16 THEN -1400D WHEN cls = 7 AND u % 30 = 17 THEN -1800D ELSE 0D END AS baro_rate_fpm",
    "CASE WHEN k = 29 THEN NULL ELSE 450D END AS gs_kt",
    "CASE WHEN event_type = 'signup' THEN NULL WHEN cls = 9 AND t >= 600 AND t < 900 THEN '7700' ELSE '2000' END AS squawk",
    "event_type = 'purchase' AND cls = 5 AND t < 300 AS on_ground",
    f"CASE WHEN k = 13 THEN NULL WHEN {_JAMMED} THEN element_at(array(0, 1, 2, 4), cast(k % 4 + 1 AS int)) ELSE 8 END AS nic",
    f"CASE WHEN k = 13 THEN NULL WHEN {_JAMMED} THEN element_at(array(0, 2, 4), cast(k % 3 + 1 AS int)) ELSE 9 END AS nac_p",
    "'synthetic' AS source",
    "if(u % 2 = 0, 'north', 'south') AS region",
]


def from_events(events: DataFrame) -> DataFrame:
    """Positions from an event table (event_id, ts, user_id, event_type, value, props): 30 days become one hour.

    One aircraft a user; its user number decides what it does: fly level, go silent, lose integrity,
    visit a zone, jump, or send an emergency code.
    """
    # A generator runs once a row: filters on what depends on k stay above it and don't parse JSON again for each mention.
    parsed = events.selectExpr("event_id", "user_id", "event_type", "ts", "json_tuple(props, 'k') AS k")
    placed = parsed.selectExpr(*_BASE).where("NOT (cls = 7 AND t >= 1200 AND t < 2400)").selectExpr("*", f"{_LAT} AS lat", f"{_LON} AS lon")
    return placed.selectExpr(*_REPORT)


def read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(ship(spark).read.parquet(f"{sf_dir}/events.parquet"))
