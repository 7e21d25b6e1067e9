"""Low visits to border zones, emergency codes and impossible motion."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_km, implied_speed_kt
from ..functions.timefn import iso
from ..settings import DEFAULTS, MINUTE_US, Settings
from ..zones import zones_at
from .incidents import Spec, described
from .sequences import first_by, islands, last_by, pairs


def touched(positions: DataFrame, keys: DataFrame) -> DataFrame:
    """The whole history of the aircraft in ``keys``."""
    return positions.join(keys.select("icao24").distinct(), "icao24", "left_semi")


def low_in_zone(positions: DataFrame, s: Settings = DEFAULTS, kind: str = "border") -> DataFrame:
    """Low airborne reports, one row for each zone of the kind they lie in; a null altitude is low."""
    low = positions.where(~F.col("on_ground") & (F.coalesce("alt_baro_ft", F.lit(0.0)) < s.incursion_max_alt_ft))
    return low.withColumn("zone", F.explode(zones_at(F.col("lat"), F.col("lon"), kind)))


def visits(positions: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Visits of enough reports: dwell, median rate of climb or descent (null: none known), place of the middle report."""
    runs = islands(low_in_zone(positions, s), s.incursion_gap_minutes * MINUTE_US, ("icao24", "zone"))
    found = runs.groupBy("icao24", "zone", "island").agg(
        F.count(F.lit(1)).alias("samples"),
        F.min("us").alias("start_us"),
        F.max("us").alias("end_us"),
        F.percentile(F.abs("baro_rate_fpm"), 0.5).alias("median_rate"),
        F.min(F.coalesce("alt_baro_ft", F.lit(0.0))).alias("min_alt"),
        F.max(F.coalesce("alt_baro_ft", F.lit(0.0))).alias("max_alt"),
        first_by("ts", "start_ts"),
        first_by("region", "region"),
        # A visit is one stay of one aircraft.
        F.array_sort(F.collect_list(F.struct("us", "id", "lat", "lon"))).alias("path"),
    )
    middle = F.get("path", F.floor(F.size("path") / 2).cast("int"))
    return found.where(F.col("samples") >= s.incursion_min_samples).withColumns(
        {"lat": middle["lat"], "lon": middle["lon"], "dwell_minutes": (F.col("end_us") - F.col("start_us")) / 60e6}
    )


def incursions(positions: DataFrame, s: Settings = DEFAULTS, since_us: int | None = None) -> DataFrame:
    """With ``since_us``: aircraft low in a zone since then, over their whole history, but no visit that ended before."""
    if since_us is not None:
        positions = touched(positions, low_in_zone(positions.where(F.col("us") >= since_us), s))
    level = visits(positions, s).where(F.col("median_rate").isNull() | (F.col("median_rate") < s.incursion_max_rate_fpm))
    if since_us is not None:
        level = level.where(F.col("end_us") >= since_us)
    return described(level, incursion_spec(s))


@cache
def incursion_spec(s: Settings) -> Spec:
    evidence = [
        F.col("zone").alias("zone_id"),
        F.col("samples").alias("samples_in_visit"),
        F.bround("dwell_minutes", 1).alias("dwell_minutes"),
        F.col("min_alt").alias("min_alt_ft"),
        F.col("max_alt").alias("max_alt_ft"),
        F.bround("median_rate", 0).cast("long").alias("median_abs_vertical_rate_fpm"),
        F.lit(s.incursion_max_alt_ft).alias("altitude_floor_ft"),
        F.lit("low flight in a watch box may be routine").alias("caveat"),
    ]
    columns = dict(
        incident_id=F.concat_ws(":", F.lit("incursion"), "icao24", "zone", iso(F.col("start_ts"))),
        score=F.least(F.lit(1.0), 0.5 + 0.02 * F.col("dwell_minutes")),
        reliability=F.lit("C"), start_us=F.col("start_us"), end_us=F.col("end_us"), lat=F.col("lat"), lon=F.col("lon"),
    )
    return Spec("incursion", "AT-ZONE-INCURSION", "low-level watch-box incursion", evidence, columns)


def squawk_runs(positions: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Runs of one code; any other code, or a silence, ends a run. Only emergency codes are kept."""
    runs = islands(positions.where(F.col("squawk").isNotNull()), s.incursion_gap_minutes * MINUTE_US, value="squawk")
    return runs.where(F.col("squawk").isin(*s.squawk_codes)).groupBy("icao24", "island").agg(
        F.first("squawk").alias("squawk"),
        F.count(F.lit(1)).alias("samples"),
        F.min("us").alias("start_us"),
        F.max("us").alias("end_us"),
        first_by("ts", "start_ts"),
        last_by("lat", "lat"),
        last_by("lon", "lon"),
        last_by("region", "region"),
    )


#: What the codes mean.
MEANING = {"7500": "unlawful-interference code", "7600": "radio-communication-failure code", "7700": "general-emergency code"}


def squawks(positions: DataFrame, s: Settings = DEFAULTS, since_us: int | None = None) -> DataFrame:
    if since_us is not None:
        positions = touched(positions, positions.where((F.col("us") >= since_us) & F.col("squawk").isin(*s.squawk_codes)))
    runs = squawk_runs(positions, s).where(F.col("samples") >= s.squawk_min_samples)
    if since_us is not None:
        runs = runs.where(F.col("end_us") >= since_us)
    return described(runs, squawk_spec(s))


@cache
def squawk_spec(s: Settings) -> Spec:
    means = F.create_map(*[F.lit(x) for kv in MEANING.items() for x in kv])
    evidence = [
        F.col("squawk"),
        F.coalesce(means[F.col("squawk")], F.lit("configured emergency code")).alias("meaning"),
        F.col("samples"),
        ((F.col("end_us") - F.col("start_us")) / 1e6).alias("duration_seconds"),
        F.lit("self-reported; miscoding is possible").alias("caveat"),
    ]
    columns = dict(
        incident_id=F.concat_ws(":", F.lit("squawk"), "icao24", "squawk", iso(F.col("start_ts"))),
        score=F.lit(0.55), reliability=F.lit("C"), start_us=F.col("start_us"), end_us=F.col("end_us"), lat=F.col("lat"), lon=F.col("lon"),
    )
    return Spec("squawk", "AT-EMERGENCY-SQUAWK", F.concat(F.lit("emergency squawk "), F.col("squawk")), evidence, columns)


def speed_steps(positions: DataFrame, since_us: int | None = None) -> DataFrame:
    """Pairs with seconds, km, speed_kt (0 where no time passed) and the reported speed."""
    p = pairs(positions, since_us)
    km = haversine_km(F.col("p.lat"), F.col("p.lon"), F.col("lat"), F.col("lon"))
    seconds = (F.col("us") - F.col("p.us")) / 1e6
    return p.withColumns({"seconds": seconds, "km": km}).withColumn("speed_kt", implied_speed_kt(F.col("km"), F.col("seconds")))


def spoofs(positions: DataFrame, s: Settings = DEFAULTS, since_us: int | None = None) -> DataFrame:
    """With ``since_us``: aircraft with a violation since then, over their whole history."""
    if since_us is not None:
        recent = speed_steps(positions, since_us).where(F.col("speed_kt") > s.spoof_max_speed_kt)
        positions = touched(positions, recent)
    hits = speed_steps(positions).where(F.col("speed_kt") > s.spoof_max_speed_kt)
    found = hits.groupBy("icao24").agg(
        F.count(F.lit(1)).alias("violations"),
        F.max("speed_kt").alias("max_speed"),
        F.min("us").alias("start_us"),
        F.max("us").alias("end_us"),
        first_by("ts", "start_ts"),
        first_by("lat", "lat"),
        first_by("lon", "lon"),
        first_by("region", "region"),
    ).where(F.col("violations") >= s.spoof_min_violations)
    return described(found, spoof_spec(s))


@cache
def spoof_spec(s: Settings) -> Spec:
    evidence = [
        F.col("violations"),
        F.bround("max_speed", 0).alias("max_implied_speed_kt"),
        F.lit(s.spoof_max_speed_kt).alias("ceiling_kt"),
        F.col("max_speed").alias("exact_max_kt"),
        F.lit("two aircraft may share an address").alias("caveat"),
    ]
    columns = dict(
        incident_id=F.concat_ws(":", F.lit("spoof"), "icao24", iso(F.col("start_ts"))),
        score=F.least(F.lit(1.0), 0.6 + 0.1 * F.col("violations")),
        reliability=F.lit("C"), start_us=F.col("start_us"), end_us=F.col("end_us"), lat=F.col("lat"), lon=F.col("lon"),
    )
    return Spec("spoof", "AT-KINEMATIC-SPOOF", "kinematic impossibility / identity anomaly", evidence, columns)
