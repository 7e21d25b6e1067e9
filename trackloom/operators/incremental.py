"""Keeping tracks and incidents current: what changed, what to derive again, what to replace."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timefn import floor_to
from ..settings import DEFAULTS, HOUR_US, MINUTE_US, Settings
from ..sources.positions import scan
from . import gaps, jamming, visits
from .incidents import flat
from .tracks import tracks


def of_region(df: DataFrame, region: str | None) -> DataFrame:
    """Rows of a region; all without one."""
    return df if region is None else df.where(F.col("region") == region)


def dirty(positions: DataFrame, watermark_us: int | None, region: str | None = None) -> DataFrame:
    """Aircraft with a report (of the region) newer than the watermark; all without one."""
    rows = of_region(positions, region)
    rows = rows if watermark_us is None else rows.where(F.col("us") > watermark_us)
    return rows.select("icao24").distinct()


def refreshed_tracks(stored: DataFrame, positions: DataFrame, watermark_us: int | None, s: Settings = DEFAULTS, region: str | None = None) -> DataFrame:
    """Stored tracks with those of dirty aircraft (and of the region) derived again from their whole history (in the region)."""
    keys = dirty(positions, watermark_us, region)
    new = tracks(of_region(positions, region).join(keys, "icao24", "left_semi"), s)
    if region is None:
        return stored.join(keys, "icao24", "left_anti").unionByName(new)
    own = F.col("region") == region
    others = stored.where(~F.coalesce(own, F.lit(False)))
    return others.unionByName(stored.where(own).join(keys, "icao24", "left_anti")).unionByName(new)


def window_start(now_us: int, s: Settings = DEFAULTS) -> int:
    """The refresh window's start, aligned down so that no grid bucket is judged in part."""
    since = now_us - s.refresh_hours * HOUR_US
    return since - since % (s.window_minutes * MINUTE_US)


def recent_incidents(positions: DataFrame, runs: DataFrame, outages: DataFrame, since_us: int, s: Settings = DEFAULTS, region: str | None = None) -> DataFrame:
    """All detectors' incidents (of the region) derived again since an aligned time; pairs are seeded, visits and streaks see whole histories."""
    own = of_region(positions, region)
    parts = [
        jamming.detect(scan(own, since_us=since_us), s, region),
        gaps.detect(own, runs, outages, s, since_us),
        visits.incursions(own, s, since_us),
        visits.spoofs(own, s, since_us),
        visits.squawks(own, s, since_us),
    ]
    return reduce(DataFrame.unionByName, map(flat, parts))


def refreshed_incidents(stored: DataFrame, recent: DataFrame, since_us: int, region: str | None = None) -> DataFrame:
    """Stored incidents with those from ``since_us`` on, and those with a new version, replaced: of the region, if one is given, and of no other.

    An id that two regions have is two incidents. ``anomaly`` incidents, which no cycle derives, stay.
    """
    mine = F.col("detector") != "anomaly"
    if region is not None:
        mine = mine & F.coalesce(F.col("region") == region, F.lit(False))
    ids = recent.select(F.col("incident_id").alias("_id"), F.col("region").alias("_region"))
    again = (F.col("incident_id") == F.col("_id")) & (F.lit(True) if region is None else F.col("region").eqNullSafe(F.col("_region")))
    kept = stored.where(~(mine & (F.col("start_us") >= since_us))).join(ids, again, "left_anti")
    return kept.unionByName(recent.dropDuplicates(["incident_id", "region"]))


@dataclass(frozen=True)
class Cycle:
    tracks: DataFrame
    incidents: DataFrame
    watermark_us: int | None


def cycle(
    positions: DataFrame, stored_tracks: DataFrame, stored_incidents: DataFrame, runs: DataFrame, outages: DataFrame, watermark_us: int | None, s: Settings = DEFAULTS, region: str | None = None
) -> Cycle:
    """One processing cycle, of a region if one is given. The new watermark is the newest event time seen, not the clock."""
    newest = of_region(positions, region).agg(F.max("us")).first()[0]
    if newest is None:
        return Cycle(stored_tracks, stored_incidents, watermark_us)
    since = window_start(newest, s)
    recent = recent_incidents(positions, runs, outages, since, s, region)
    return Cycle(refreshed_tracks(stored_tracks, positions, watermark_us, s, region), refreshed_incidents(stored_incidents, recent, since, region), newest)


def replaced_partitions(df: DataFrame, path: str, *partition: str) -> None:
    """Delete-and-rebuild of the slices that ``df`` holds, others untouched."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def bucket_of(us: str, s: Settings = DEFAULTS):
    return floor_to(F.col(us), s.window_minutes * MINUTE_US)
