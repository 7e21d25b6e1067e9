"""Transponder silences at altitude, unless an outage, a descent or the edge of coverage explains them."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import equirect_nm, haversine_km
from ..functions.timefn import iso
from ..settings import DAY_US, DEFAULTS, MINUTE_US, Settings
from .incidents import Spec, described
from .sequences import pairs


def days(lo: Column, hi: Column) -> Column:
    """The days that a span touches: the equi-join key of spans that may overlap."""
    return F.explode(F.sequence(_day(lo), _day(hi)))


def _day(us: Column) -> Column:
    return F.floor(us / F.lit(DAY_US)).cast("long")


def boundary(rows: DataFrame, runs: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Rows (us, region, and a unique id) with the circle that collected them: c_lat, c_lon, c_radius, c_source.

    Of the runs with a circle, of the same region (both may be null), that were on at the time, from a
    minute before their start, the one that started last; without any, the configured circle.

    Runs meet rows by region and day: an ended run on the days it lasted, an open one on the day it started. For
    later days a region has one list, of the last open run of each day.
    """
    began = F.col("started_us") - s.max_position_age_seconds * 1_000_000
    own = runs.where(F.col("center_lat").isNotNull() & F.col("center_lon").isNotNull() & F.col("radius_nm").isNotNull()).select(
        F.col("region").alias("run_region"), began.alias("began"), F.coalesce("last_message_us", "stopped_us").alias("ended_us"),
        F.struct("started_us", F.col("id").alias("run_id"), "center_lat", "center_lon", "radius_nm").alias("run"),
    )
    open_ = F.col("ended_us").isNull()
    dated = own.where(open_ | (F.col("ended_us") >= F.col("began"))).select("*", days(F.col("began"), F.when(open_, F.col("run.started_us")).otherwise(F.col("ended_us"))).alias("day"))
    last = own.where(open_).groupBy("run_region", _day(F.col("run.started_us")).alias("day")).agg(F.max("run").alias("run"))
    later = last.groupBy(F.col("run_region").alias("later_region")).agg(F.array_sort(F.collect_list(F.struct("day", "run"))).alias("later"))
    placed = rows.withColumn("_day", _day(F.col("us")))
    on = (
        F.col("region").eqNullSafe(F.col("run_region")) & (F.col("_day") == F.col("day"))
        & (F.col("us") >= F.col("began")) & (F.col("ended_us").isNull() | (F.col("us") <= F.col("ended_us")))
    )
    row = F.struct(*rows.columns)
    met = placed.select("_day", row.alias("row"), *rows.columns).join(dated, on, "left").groupBy("id").agg(F.any_value("row").alias("row"), F.any_value("_day").alias("_day"), F.max("run").alias("run"))
    met = met.join(later, F.col("row.region").eqNullSafe(F.col("later_region")), "left")
    past = F.array_max(F.transform(F.filter("later", lambda x: x["day"] < F.col("_day")), lambda x: x["run"]))
    found = met.select("row.*", F.array_max(F.array_compact(F.array("run", past))).alias("run"))
    return found.select(
        *rows.columns,
        F.coalesce("run.center_lat", F.lit(s.center_lat)).alias("c_lat"),
        F.coalesce("run.center_lon", F.lit(s.center_lon)).alias("c_lon"),
        F.coalesce("run.radius_nm", F.lit(s.radius_nm)).alias("c_radius"),
        F.coalesce(F.concat(F.lit("collector-run:"), F.col("run.run_id")), F.lit("config-fallback")).alias("c_source"),
    )


def could_have_left(lat: Column, lon: Column, gs_kt: Column, gap_minutes: Column, c_lat: Column, c_lon: Column, c_radius: Column) -> Column:
    """Was there time to fly out of the circle and back? Never for unknown speed or a start outside."""
    off = equirect_nm(lat, lon, c_lat, c_lon)
    return F.coalesce((gs_kt > 0) & (off <= c_radius) & (gap_minutes >= 2 * (c_radius - off) / gs_kt * 60.0), F.lit(False))


def without_outage(silences: DataFrame, outages: DataFrame, applies: Column | None = None) -> DataFrame:
    """Silences (start_us, end_us, and a unique id) that no outage of any region touches; an open outage has no end.

    Ended outages meet silences by the days both touch. Of the open ones the first decides, a single number.
    Rows to which it doesn't apply are kept.
    """
    applies = F.lit(True) if applies is None else applies
    first_open = outages.where(F.col("closed_us").isNull()).agg(F.min("opened_us").alias("first")).scalar()
    ended = outages.where(F.col("closed_us") >= F.col("opened_us")).select(F.col("opened_us").alias("_o"), F.col("closed_us").alias("_c"), days(F.col("opened_us"), F.col("closed_us")).alias("_day"))
    row = F.struct(*silences.columns).alias("row")
    span = F.when(applies, F.sequence(_day(F.col("start_us")), _day(F.col("end_us")))).otherwise(F.array(F.lit(None).cast("long")))
    placed = silences.where(~applies | F.coalesce(F.col("end_us") < first_open, F.lit(True))).select(row, "id", "start_us", "end_us", F.explode(span).alias("day"))
    hit = (F.col("day") == F.col("_day")) & (F.col("_o") <= F.col("end_us")) & (F.col("start_us") <= F.col("_c"))
    met = placed.join(ended, hit, "left").groupBy("id").agg(F.any_value("row").alias("row"), F.count("_o").alias("hits"))
    return met.where("hits = 0").select("row.*")


def silences(positions: DataFrame, s: Settings = DEFAULTS, since_us: int | None = None) -> DataFrame:
    """Pairs with a silence that is long, far and at altitude, not in a descent; the cheap conditions come first."""
    p = pairs(positions, since_us)
    gap = (F.col("us") - F.col("p.us")) / 60e6
    km = haversine_km(F.col("p.lat"), F.col("p.lon"), F.col("lat"), F.col("lon"))
    return (
        p.where(F.col("us") - F.col("p.us") >= int(s.gap_min_minutes * MINUTE_US))
        .where(F.coalesce("p.alt_baro_ft", F.lit(0.0)) >= s.gap_min_alt_ft)
        .where(F.coalesce("p.baro_rate_fpm", F.lit(0.0)) >= s.gap_max_descent_fpm)
        .withColumns({"gap_minutes": gap, "km": km})
        .where(F.col("km") >= s.gap_min_km)
        .select(
            "icao24", "gap_minutes", "km", F.col("p.id").alias("id"), F.col("p.ts").alias("start_ts"), F.col("p.us").alias("start_us"), F.col("us").alias("end_us"),
            F.col("p.us").alias("us"), F.col("p.region").alias("region"), F.col("p.lat").alias("p_lat"), F.col("p.lon").alias("p_lon"), F.col("lat").alias("n_lat"), F.col("lon").alias("n_lon"),
            F.col("p.alt_baro_ft").alias("alt"), F.col("p.baro_rate_fpm").alias("rate"), F.col("p.gs_kt").alias("gs_kt"),
        )
    )


def detect(positions: DataFrame, runs: DataFrame, outages: DataFrame, s: Settings = DEFAULTS, since_us: int | None = None) -> DataFrame:
    held = boundary(without_outage(silences(positions, s, since_us), outages), runs, s)
    left = could_have_left(F.col("p_lat"), F.col("p_lon"), F.col("gs_kt"), F.col("gap_minutes"), F.col("c_lat"), F.col("c_lon"), F.col("c_radius"))
    return described(held.where(~left), gap_spec(s))


@cache
def gap_spec(s: Settings) -> Spec:
    evidence = [
        F.bround("gap_minutes", 1).alias("gap_minutes"),
        F.bround("km", 1).alias("displacement_km"),
        F.col("alt").alias("last_alt_baro_ft"),
        F.lit(s.gap_min_alt_ft).alias("altitude_floor_ft"),
        F.col("rate").alias("vertical_rate_fpm"),
        F.col("gs_kt").alias("ground_speed_kt"),
        F.col("c_source").alias("coverage_boundary_source"),
        F.col("gap_minutes").alias("exact_minutes"),
        F.col("km").alias("exact_km"),
        F.lit("a silence may be benign loss of coverage").alias("caveat"),
    ]
    columns = dict(
        incident_id=F.concat_ws(":", F.lit("gap"), "icao24", iso(F.col("start_ts"))),
        score=F.least(F.lit(1.0), 0.4 + 0.3 * F.col("gap_minutes") / 30.0 + 0.3 * F.col("km") / 300.0),
        reliability=F.when(F.col("gap_minutes") < 30, "D").otherwise("C"),
        start_us=F.col("start_us"), end_us=F.col("end_us"), lat=(F.col("p_lat") + F.col("n_lat")) / 2, lon=(F.col("p_lon") + F.col("n_lon")) / 2,
    )
    return Spec("gap", "AT-DARK-AIRCRAFT", "dark aircraft (transponder gap)", evidence, columns)
