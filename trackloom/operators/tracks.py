"""Tracks: an aircraft's airborne reports, split by silence, and their shape descriptors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import haversine_km
from ..functions.timefn import iso
from ..settings import DAY_US, DEFAULTS, MINUTE_US, Settings
from .sequences import first_by, islands, last_by, order


def segments(positions: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Airborne reports with their ``island``; ground reports go first, so taxiing is silence."""
    return islands(positions.where(~F.col("on_ground")), s.track_gap_minutes * MINUTE_US)


def with_steps(rows: DataFrame, keys: tuple[str, ...] = ("icao24", "island")) -> DataFrame:
    """``step_km``: distance from the report before; null at a start."""
    w = order(*keys)
    return rows.withColumn("step_km", haversine_km(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")))


def stepped(positions: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """``with_steps`` of ``segments`` from one look at each report's predecessor, so from one sort."""
    w = order()
    airborne = positions.where(~F.col("on_ground")).withColumn("_p", F.lag(F.struct("us", "lat", "lon")).over(w))
    new = F.col("us") - F.col("_p.us") > s.track_gap_minutes * MINUTE_US
    step = F.when(~new, haversine_km(F.col("_p.lat"), F.col("_p.lon"), F.col("lat"), F.col("lon")))
    island = F.sum(F.coalesce(new, F.lit(False)).cast("int")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    return airborne.withColumns({"island": island, "step_km": step}).drop("_p")


def tracks(positions: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    found = stepped(positions, s).groupBy("icao24", "island").agg(
        F.count(F.lit(1)).alias("point_count"),
        F.sum("step_km").alias("distance_km"),
        F.min("us").alias("start_us"),
        F.max("us").alias("end_us"),
        first_by("ts", "start_ts"),
        first_by("region", "region"),
        first_by("lat", "start_lat"),
        first_by("lon", "start_lon"),
        last_by("lat", "end_lat"),
        last_by("lon", "end_lon"),
    )
    out = found.where(F.col("point_count") >= s.track_min_points)
    return out.select(F.concat_ws(":", "icao24", iso(F.col("start_ts"))).alias("track_id"), *[c for c in out.columns if c not in ("island", "start_ts")])


def resampled(t: np.ndarray, lat: np.ndarray, lon: np.ndarray, alt_kft: np.ndarray, n: int) -> np.ndarray:
    grid = np.linspace(t[0], t[-1], n)
    return np.column_stack([grid, np.interp(grid, t, lat), np.interp(grid, t, lon), np.interp(grid, t, alt_kft)])


def descriptor(points: np.ndarray) -> np.ndarray:
    """(n-1) x 5 of a resampled track: north and east steps, their length (km), the turn, the climb (kft)."""
    _, lat, lon, alt = points.T
    north = np.diff(lat) * 111.0
    east = np.diff(lon) * 111.0 * np.cos(np.radians((lat[1:] + lat[:-1]) / 2))
    heading = np.arctan2(east, north)
    turn = np.diff(heading, prepend=heading[:1])
    return np.column_stack([north, east, np.hypot(north, east), np.arctan2(np.sin(turn), np.cos(turn)), np.diff(alt)])


def resample(positions: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """track_id, icao24, point_count, k, lat, lon, alt_kft on a grid of equal times, and the track's ends (start_us, end_us, end_lat, end_lon).

    Every report covers the grid's places up to the next report, where values are linear between the two, so a row is
    made from a row and its successor.
    """
    n = s.track_resample_points
    w = order("icao24", "island")
    whole = W.partitionBy("icao24", "island")
    rows = segments(positions, s).select("icao24", "island", "us", "id", "ts", "lat", "lon", (F.coalesce("alt_baro_ft", F.lit(0.0)) / 1000.0).alias("alt"))
    ends = {
        "point_count": F.count(F.lit(1)).over(whole), "start_us": F.min("us").over(whole), "end_us": F.max("us").over(whole),
        "start_ts": F.min_by("ts", F.struct("us", "id")).over(whole), "last": F.max_by(F.struct("lat", "lon"), F.struct("us", "id")).over(whole),
        "next": F.lead(F.struct("us", "lat", "lon", "alt")).over(w), "after": F.lead("us", 2).over(w),
    }
    rows = rows.withColumns(ends).where(F.col("point_count") >= s.track_min_points)
    span = (F.col("end_us") - F.col("start_us")) / 1e6
    seconds = lambda us: (us - F.col("start_us")) / 1e6
    time = lambda k: span * k / (n - 1)

    def place(us: Column) -> Column:
        """The first place at or behind a report; the quotient may be one off."""
        k = F.ceil(seconds(us) / span * (n - 1))
        k = k + F.when(time(k) < seconds(us), 1).when(time(k - 1) >= seconds(us), -1).otherwise(0)
        return F.when(span > 0, k).otherwise(F.lit(0)).cast("int")

    # The last pair has the grid's last place too; a track without duration has all of its places there.
    upto = F.when(F.col("after").isNull(), F.lit(n - 1)).otherwise(place(F.col("next.us")) - 1)
    low = F.when((span <= 0) & F.col("after").isNull(), F.lit(0)).otherwise(place(F.col("us")))
    rows = rows.where(F.col("next").isNotNull()).withColumn("upto", upto).withColumn("low", low).where("low <= upto")
    rows = rows.withColumn("k", F.explode(F.sequence("low", "upto")))
    t, t0, t1 = time(F.col("k")), seconds(F.col("us")), seconds(F.col("next.us"))
    # At a report, its own values: rounding would leave a step of an aircraft that stands, and with it a turn.
    at = lambda c: F.when(t < t1, F.col(c) + (F.col(f"next.{c}") - F.col(c)) * (t - t0) / (t1 - t0)).otherwise(F.col(f"next.{c}"))
    return rows.select(
        F.concat_ws(":", "icao24", iso(F.col("start_ts"))).alias("track_id"), "icao24", "point_count", F.col("k").cast("long").alias("k"), at("lat").alias("lat"), at("lon").alias("lon"), at("alt").alias("alt_kft"),
        "start_us", "end_us", F.col("last.lat").alias("end_lat"), F.col("last.lon").alias("end_lon"),
    )


def sequences(positions: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """track_id, icao24, point_count, start_us, end_us, end_lat, end_lon, sequence, features (the sequence, flattened): what ``descriptor`` says, a fixed number of steps a track."""
    keys = ["track_id", "icao24", "point_count", "start_us", "end_us", "end_lat", "end_lon"]
    per = resample(positions, s).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "lat", "lon", "alt_kft"))).alias("p"))
    steps = F.sequence(F.lit(0), F.size("p") - 2)

    def step(i: Column) -> Column:
        a, b = F.get("p", i), F.get("p", i + 1)
        north = (b["lat"] - a["lat"]) * 111.0
        east = (b["lon"] - a["lon"]) * 111.0 * F.cos(F.radians((a["lat"] + b["lat"]) / 2))
        return F.struct(north.alias("north"), east.alias("east"), F.atan2(east, north).alias("heading"), (b["alt_kft"] - a["alt_kft"]).alias("climb"))

    def shown(d: Column, before: Column) -> Column:
        turn = d["heading"] - before["heading"]
        return F.array(d["north"], d["east"], F.hypot(d["north"], d["east"]), F.atan2(F.sin(turn), F.cos(turn)), d["climb"])

    # All steps are the one element of an array: bound to a lambda, so that Catalyst can't put their expression, to be run again for each step, in its place.
    # No lambda uses another's variable inside: Spark takes no Python function of such a column out of a plan, and the plan then fails.
    moved = F.array(F.transform(steps, step))
    out = per.select(*keys, F.transform(moved, lambda m: F.zip_with(m, F.concat(F.slice(m, 1, 1), F.slice(m, 1, F.size(m) - 1)), shown))[0].alias("sequence"))
    return out.withColumn("features", F.flatten("sequence"))


def geometry(tracks_: DataFrame, positions: DataFrame) -> DataFrame:
    """Per track, the reports between its start and end, of its region if it has one, in order.

    They meet by aircraft and day, so an address that very many reports share is split by days.
    """
    day = lambda us: F.floor(us / DAY_US).cast("long")
    t = tracks_.withColumn("day", F.explode(F.sequence(day(F.col("start_us")), day(F.col("end_us"))))).alias("t")
    p = positions.withColumn("day", day(F.col("us"))).alias("p")
    on = (
        (F.col("t.icao24") == F.col("p.icao24"))
        & (F.col("t.day") == F.col("p.day"))
        & F.col("p.us").between(F.col("t.start_us"), F.col("t.end_us"))
        & (F.col("t.region").isNull() | F.col("t.region").eqNullSafe(F.col("p.region")))
    )
    point = F.struct(F.col("p.us"), F.col("p.id"), F.col("p.lon"), F.col("p.lat"))
    return t.join(p, on).groupBy("t.track_id").agg(F.array_sort(F.collect_list(point)).alias("points"))
