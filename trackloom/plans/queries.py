"""The registered queries: each operator over the adapter's positions, as flat columns that an SQL twin can produce."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grading
from ..functions.geo import equirect_nm, in_ring
from ..functions.lines import simplified
from ..functions.timefn import micros
from ..operators import anomaly, baselines, evaluation, gaps, incremental, ingest, jamming, picture, sequences, serving, tracks, visits
from ..settings import DEFAULTS, HOUR_US
from ..sources import features, ledger, positions, snapshots
from ..sources.positions import EPOCH_US, scan
from ..storage import kept, shared_folder
from ..streaming import grid, live, ordered, store
from . import streams
from ..zones import frame, geojson, zone_for, zones_at

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def at(seconds: int) -> int:
    return EPOCH_US + seconds * 1_000_000


def r(c: str | Column, digits: int = 6, name: str | None = None) -> Column:
    return F.round(c, digits).alias(name or c)


def pos(spark: SparkSession, d: str) -> DataFrame:
    return positions.read(spark, d)


def flat(df: DataFrame, *more: Column) -> DataFrame:
    return df.select(
        "incident_id", "icao24", "detector", "incident_type", r("score"), "severity", "reliability", "start_us", "end_us", r("lat"), r("lon"), "zone_id", "affected_count",
        F.array_join("techniques", ",").alias("technique"), "region", *more,
    )


def every(spark: SparkSession, d: str) -> DataFrame:
    return picture.all_incidents(pos(spark, d), ledger.runs(spark), ledger.outages(spark))


def gap_incidents_of(spark: SparkSession, d: str, since: int | None = None) -> DataFrame:
    return gaps.detect(pos(spark, d), ledger.runs(spark), ledger.outages(spark), since_us=since)


@query
def positions_view(spark, d):
    return pos(spark, d).select("id", "icao24", "us", r("lat"), r("lon"), "alt_baro_ft", "squawk", "on_ground", "nic", "nac_p", "region")


@query
def pair_steps(spark, d):
    return visits.speed_steps(pos(spark, d)).select("icao24", "id", F.col("p.id").alias("prev_id"), r("seconds"), r("km"), r("speed_kt", 4))


@query
def spoof_pairs(spark, d):
    return visits.speed_steps(pos(spark, d)).where(F.col("speed_kt") > DEFAULTS.spoof_max_speed_kt).select("icao24", "id", r("speed_kt", 4))


@query
def spoof_incidents(spark, d):
    found = visits.spoofs(pos(spark, d))
    return flat(found, F.col("evidence.violations").alias("violations"), r(F.col("evidence.exact_max_kt"), 4, "max_speed_kt"))


@query
def track_segments(spark, d):
    return tracks.segments(pos(spark, d)).groupBy("icao24", "island").agg(F.count(F.lit(1)).alias("points"), F.min("us").alias("start_us"), F.max("us").alias("end_us"))


@query
def haversine_steps(spark, d):
    rows = tracks.with_steps(tracks.segments(pos(spark, d))).groupBy("icao24", "island")
    return rows.agg(r(F.sum("step_km"), 6, "distance_km"), r(F.max("step_km"), 6, "longest_km"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")


@query
def tracks_(spark, d):
    return tracks.tracks(pos(spark, d)).select("track_id", "icao24", "point_count", r("distance_km"), "start_us", "end_us", "region", r("start_lat"), r("start_lon"), r("end_lat"), r("end_lon"))


QUERIES["tracks"] = QUERIES.pop("tracks_")


@query
def squawk_incidents(spark, d):
    return flat(visits.squawks(pos(spark, d)), F.col("evidence.samples").alias("samples"))


@query
def worst_nic(spark, d):
    return jamming.worst(scan(pos(spark, d))).select("fi", "fj", "bucket", "icao24", F.col("at.nic").alias("nic"), F.col("at.alt").alias("alt_ft"), "nac_p", "start_us", "end_us")


@query
def coverage_levels(spark, d):
    return jamming.levels(scan(pos(spark, d))).select("level", "scoreable", "ci", "cj", "bucket", F.size("aircraft").cast("long").alias("aircraft"))


@query
def jamming_incidents(spark, d):
    e = lambda n, to: F.col(f"evidence.{n}").alias(to)
    return flat(
        jamming.detect(scan(pos(spark, d))), e("aircraft_observed", "aircraft_observed"), e("aircraft_hard_loss", "aircraft_hard_loss"), e("degraded_altitude_known", "alt_known"),
        e("degraded_alt_ft_min", "alt_min"), e("degraded_alt_ft_median", "alt_median"), e("degraded_alt_ft_max", "alt_max"), e("degraded_in_terminal_phase", "degraded_in_terminal_phase"),
    )


@query
def jamming_stats(spark, d):
    return jamming.stats(scan(pos(spark, d)))


@query
def coverage_cells(spark, d):
    return jamming.coverage(scan(pos(spark, d))).withColumn("degraded_fraction", F.round("degraded_fraction", 6))


@query
def coverage_map(spark, d):
    return jamming.coverage_map(jamming.coverage(scan(pos(spark, d)))).withColumn("degraded_fraction", F.round("degraded_fraction", 6))


@query
def coverage_totals(spark, d):
    merged = jamming.coverage_map(jamming.coverage(scan(pos(spark, d))))
    return merged.groupBy(grading.coverage_state(F.col("scoreable"), F.col("degraded_fraction")).alias("state")).agg(F.count(F.lit(1)).alias("cells"))


@query
def gap_incidents(spark, d):
    e = lambda n: F.col(f"evidence.{n}")
    return flat(gap_incidents_of(spark, d), r(e("exact_minutes"), 6, "gap_minutes"), r(e("exact_km"), 6, "km"), e("coverage_boundary_source").alias("boundary_source"))


@query
def gap_outage_antijoin(spark, d):
    return gaps.without_outage(gaps.silences(pos(spark, d)), ledger.outages(spark, ledger.LATE_OUTAGES)).select("icao24", "start_us", "end_us")


@query
def collection_boundary_asof(spark, d):
    return gaps.boundary(gaps.silences(pos(spark, d)), ledger.runs(spark)).select("id", F.col("c_source").alias("boundary_source"), "c_lat", "c_lon", "c_radius")


@query
def gap_coverage_exit(spark, d):
    b = gaps.boundary(gaps.silences(pos(spark, d)), ledger.runs(spark))
    place = [F.col(c) for c in ("p_lat", "p_lon", "gs_kt", "gap_minutes", "c_lat", "c_lon", "c_radius")]
    off = equirect_nm(F.col("p_lat"), F.col("p_lon"), F.col("c_lat"), F.col("c_lon"))
    return b.select("id", r(off, 6, "off_nm"), gaps.could_have_left(*place).alias("could_have_left"))


@query
def incursion_incidents(spark, d):
    return flat(visits.incursions(pos(spark, d)))


@query
def incursion_visits(spark, d):
    return visits.visits(pos(spark, d)).select("icao24", "zone", "samples", "start_us", "end_us", "median_rate", "min_alt", "max_alt", r("dwell_minutes"))


@query
def zone_membership(spark, d):
    return pos(spark, d).select("id", F.explode(zones_at(F.col("lat"), F.col("lon"))).alias("zone_id"))


@query
def zone_attribution(spark, d):
    return pos(spark, d).groupBy(zone_for(F.col("lat"), F.col("lon")).alias("zone_id")).agg(F.count(F.lit(1)).alias("reports"))


@query
def zone_kind_semi(spark, d):
    return pos(spark, d).where(F.size(zones_at(F.col("lat"), F.col("lon"), "border")) > 0).select("icao24").distinct()


@query
def all_incidents(spark, d):
    return flat(every(spark, d))


@query
def top_incidents(spark, d):
    return picture.top(every(spark, d), 20).select("incident_id", r("score"))


@query
def filtered_incidents(spark, d):
    """One detector's incidents from a score on."""
    return picture.top(every(spark, d), 1_000, 0.62, "gap").select("incident_id", r("score"))


@query
def grade_tones(spark, d):
    """Grades by number of reports and altitude, and the tones that they and risks are shown in."""
    per = pos(spark, d).groupBy("icao24").agg(F.count(F.lit(1)).alias("n"), F.max("alt_baro_ft").alias("alt"))
    grade = grading.reliability(F.floor(F.col("n") / 7), F.coalesce(F.col("alt") >= 33_000, F.lit(False)))
    risk = (F.col("n") % 10) / 10
    return per.select("icao24", grade.alias("grade"), grading.reliability_tone(grade).alias("tone"), grading.risk_tone(risk).alias("risk_tone"))


@query
def air_picture_aircraft(spark, d):
    joined = lambda c: F.array_join(c, ",").alias(c)
    return picture.aircraft_rollup(every(spark, d)).select("icao24", joined("detectors"), joined("techniques"), "reliability", joined("incidents"), "start_us", "in_sensitive", r("risk", 3))


@query
def air_picture_areas(spark, d):
    return picture.areas(every(spark, d)).select("incident_id", r("score"), "zone_id")


@query
def stats_by_detector(spark, d):
    return picture.by_detector(every(spark, d))


@query
def stats_counts(spark, d):
    p = pos(spark, d)
    zero = F.lit(0).cast("long")
    none = F.lit(None).cast("string")
    rows = [
        p.select("icao24", F.lit(1).cast("long").alias("p"), zero.alias("t"), zero.alias("i"), "us"),
        tracks.tracks(p).select(none.alias("icao24"), zero.alias("p"), F.lit(1).cast("long").alias("t"), zero.alias("i"), F.lit(None).cast("long").alias("us")),
        every(spark, d).select(none.alias("icao24"), zero.alias("p"), zero.alias("t"), F.lit(1).cast("long").alias("i"), F.lit(None).cast("long").alias("us")),
    ]
    all_ = rows[0].union(rows[1]).union(rows[2])
    return all_.agg(F.count_distinct("icao24").alias("aircraft"), F.sum("p").alias("positions"), F.sum("t").alias("tracks"), F.sum("i").alias("incidents"), F.max("us").alias("newest_us"))


@query
def evidence_feed(spark, d):
    best = picture.top(every(spark, d), 100)
    return picture.evidence_feed(best).select(
        "doc_id", "reliability", "credibility", "title", "summary", "source", "kind", "detector", "icao24", "url", "zone", "published_us", r("lat"), r("lon"), "affected_count", F.array_join("techniques", ",").alias("technique"), "region", r("score")
    )


@query
def latest_before(spark, d):
    return sequences.latest_before(pos(spark, d), at(1800)).select("icao24", "id", "us")


@query
def dirty_aircraft(spark, d):
    return incremental.dirty(pos(spark, d), at(3590))


@query
def dirty_semi(spark, d):
    p = pos(spark, d)
    return p.join(incremental.dirty(p, at(3590)), "icao24", "left_semi").groupBy("icao24").agg(F.count(F.lit(1)).alias("reports"))


@query
def tracks_incremental(spark, d):
    """Tracks of the first part of the hour, brought up to date: equal to those of the whole hour."""
    p = pos(spark, d)
    before = tracks.tracks(p.where(F.col("us") <= at(3000)))
    return incremental.refreshed_tracks(before, p, at(3000)).select("track_id", "point_count", r("distance_km"), "start_us", "end_us")


@query
def gap_incremental(spark, d):
    return gap_incidents_of(spark, d, at(2400)).select("incident_id")


@query
def spoof_incremental(spark, d):
    return visits.spoofs(pos(spark, d), since_us=at(3000)).select("incident_id", F.col("evidence.violations").alias("violations"))


@query
def incursion_incremental(spark, d):
    return visits.incursions(pos(spark, d), since_us=at(3000)).select("incident_id")


@query
def squawk_incremental(spark, d):
    return visits.squawks(pos(spark, d), since_us=at(800)).select("incident_id", F.col("evidence.samples").alias("samples"))


@query
def track_geometry(spark, d):
    p = pos(spark, d)
    g = tracks.geometry(tracks.tracks(p), p)
    total = lambda c: r(F.aggregate("points", F.lit(0.0), lambda a, x: a + x[c]), 5, f"sum_{c}")
    return g.select("track_id", F.size("points").cast("long").alias("points"), total("lat"), total("lon"), F.get("points", F.lit(0))["us"].alias("first_us"), F.get("points", F.size("points") - 1)["us"].alias("last_us"))


@query
def integrity_series(spark, d):
    s = picture.integrity_series(pos(spark, d))
    shown = F.array_join(F.transform("nic", lambda x: F.coalesce(x.cast("string"), F.lit("-"))), " ")
    return s.select("icao24", "day_us", F.size("us").cast("long").alias("points"), F.size(F.array_compact("nic")).cast("long").alias("known"), shown.alias("nics"))


@query
def integrity_runs(spark, d):
    return picture.integrity_runs(pos(spark, d)).drop("island")


@query
def speed_sensitivity(spark, d):
    return evaluation.speed_sensitivity(pos(spark, d))


@query
def speed_histogram(spark, d):
    return evaluation.speed_histogram(pos(spark, d))


@query
def speed_percentiles(spark, d):
    return evaluation.speed_percentiles(pos(spark, d)).select(r("p50", 4), r("p90", 4), r("p99", 4), r("p999", 3), r("max_kt", 3))


@query
def speed_tail_clues(spark, d):
    return evaluation.speed_tail_clues(pos(spark, d))


@query
def hourly_activity(spark, d):
    return evaluation.activity(pos(spark, d))


@query
def hourly_scoreability(spark, d):
    return evaluation.scoreability(scan(pos(spark, d)))


@query
def hourly_incidents(spark, d):
    return evaluation.incidents_by_hour(every(spark, d))


def region_outages(spark: SparkSession, d: str, region: str | None = None) -> DataFrame:
    """Minutes of outage an hour, of the outages that poll outcomes make."""
    beats = beats_of(spark, d)
    outages = ingest.outages_of_beats(beats).withColumn("run_id", F.col("region").cast("long"))
    runs = beats.select("region", F.col("region").cast("long").alias("id")).distinct()
    lo, hi = beats.agg(F.min("us"), F.max("us")).first()
    return evaluation.outage_minutes(outages.drop("region"), runs, region, lo or 0, (hi or 0) + 1)


@query
def hourly_outage(spark, d):
    return region_outages(spark, d).select("hour_us", r("outage_minutes"))


@query
def hourly_table(spark, d):
    """One row an hour: everything the hourly study reports."""
    p, runs, outages = pos(spark, d), ledger.runs(spark), ledger.outages(spark)
    return evaluation.hourly(p, every(spark, d), runs, outages).withColumn("outage_minutes", F.round("outage_minutes", 6))


def event_hours(spark: SparkSession, d: str) -> DataFrame:
    """Hours of the event table's own 30 days: users stand for cells, purchases for those that can't be scored; outages are those of one region."""
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("us", micros("ts"))
    span = e.agg(F.min("us").alias("lo_us"), F.max("us").alias("hi_us"))
    hours = e.groupBy((F.col("us") - F.pmod("us", F.lit(HOUR_US))).alias("hour_us")).agg(
        F.count(F.lit(1)).alias("reports"), F.count_distinct("user_id").alias("cell_windows"), F.count_if(F.col("event_type") == "purchase").alias("unscoreable")
    )
    hours = hours.join(region_outages(spark, d, "0"), "hour_us", "left").na.fill(0.0, "outage_minutes")
    return hours.withColumns({c: span.select(c).scalar() for c in ("lo_us", "hi_us")})


@query
def clock_hour_profile(spark, d):
    p = evaluation.clock_hours(event_hours(spark, d))
    return p.select("local_hour", "samples", *[r(c) for c in ("reports_mean", "reports_spread", "unscoreable_mean", "unscoreable_spread")])


@query
def missing_clock_hours(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    seen = e.select(F.pmod(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) div 3600000000") + 8, F.lit(24)).alias("local_hour")).distinct()
    return evaluation.missing_hours(seen)


@query
def missing_report_hours(spark, d):
    """The local clock hours without a report: all but one, as the reports cover an hour."""
    local = F.pmod(F.floor(F.col("us") / HOUR_US).cast("long") + 8, F.lit(24))
    return evaluation.missing_hours(pos(spark, d).select(local.alias("local_hour")).distinct())


@query
def busiest_hours(spark, d):
    return evaluation.busiest(evaluation.clock_hours(event_hours(spark, d)))


@query
def merge_intervals(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    start = micros("cast(o_orderdate as timestamp_ntz)")
    spans = o.select(F.col("o_custkey").alias("customer"), start.alias("start_us"), (start + F.col("o_orderkey") % 90 * 86_400_000_000).alias("end_us"))
    return sequences.merged_intervals(spans, ("customer",)).select("customer", "start_us", "end_us")


@query
def detector_mix(spark, d):
    return evaluation.detector_mix(every(spark, d), HOUR_US).select("detector", "incidents", r("per_day"))


@query
def lane_summary(spark, d):
    return evaluation.lane_summary(pos(spark, d)).withColumn("span_minutes", F.round("span_minutes", 6))


@query
def nic_histogram(spark, d):
    return evaluation.nic_histogram(pos(spark, d))


@query
def lane_overlap(spark, d):
    return evaluation.lane_overlap(pos(spark, d))


@query
def calibration_crosstab(spark, d):
    p = pos(spark, d)
    number = F.substring("icao24", 2, 5).cast("long") % 40
    craft = p.select("icao24").distinct().select("icao24", F.when(number == 6, "B738").when(number == 26, "C172").alias("type_code"), F.lit(None).cast("string").alias("registration"))
    return evaluation.calibration(every(spark, d), craft)


@query
def plausibility_class(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    kind = grading.plausible_incursion(F.substring("p_name", 1, 3), F.lit(None).cast("string"))
    return part.groupBy(kind.alias("plausibility")).agg(F.count(F.lit(1)).alias("n"))


@query
def coverage_compare(spark, d):
    return evaluation.coverage_compare(pos(spark, d), "north", "south", source="region")


def events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").withColumn("us", micros("ts"))


@query
def parse_snapshot(spark, d):
    """Snapshots made of the events, with values missing, of other types and out of range."""
    i, u = F.col("event_id"), F.col("user_id")
    entry = F.struct(
        F.when(i % 11 == 0, F.concat(F.lit("~A"), u.cast("string"))).otherwise(F.concat(F.lit(" A"), u.cast("string"))).alias("hex"),
        F.when(i % 17 > 0, F.concat(F.lit(" F"), u.cast("string"), F.lit(" "))).otherwise("  ").alias("flight"),
        (u % 180 - 90).cast("string").alias("lat"),
        F.when(i % 19 == 0, "NaN").otherwise((u % 360 - 180).cast("string")).alias("lon"),
        F.when(i % 5 == 0, "ground").otherwise((i % 40000).cast("string")).alias("alt_baro"),
        F.when(i % 7 == 0, "fast").otherwise((i % 500).cast("string")).alias("gs"),
        F.when(i % 3 == 0, "7.0").when(i % 3 == 1, "8").otherwise("x").alias("nic"),
        F.when(i % 13 > 0, (i % 90).cast("string")).alias("seen_pos"),
    )
    made = events(spark, d).select(F.to_json(F.struct(F.floor(F.col("us") / 1000).alias("now"), F.array(entry).alias("ac"))).alias("value"), F.lit(0).cast("long").alias("received_us"))
    found = snapshots.parse_snapshots(snapshots.from_polls(made))
    return found.select("icao24", "us", "callsign", "lat", "lon", "alt_baro_ft", "gs_kt", "on_ground", "nic")


@query
def parse_state_vectors(spark, d):
    i, u = F.col("event_id"), F.col("user_id")
    text = lambda c: c.cast("string")
    at = F.floor(F.col("us") / 1_000_000)
    v = [F.concat(F.lit("B"), text(u)), F.concat(F.lit("C"), text(u), F.lit("  ")), F.lit("Land"), text(at - i % 70 + 3), text(at), text(u % 360 - 180), text(u % 180 - 90), text(i % 1000), text(i % 9 == 0), text(i % 250), text(i % 360), text(i % 20 - 10), F.lit(None).cast("string"), text(i % 1100), F.lit("2000"), F.lit("false"), F.lit("0"), text(i % 8)]
    rows = events(spark, d).select(at.cast("double").alias("snapshot_s"), F.when(i % 23 == 0, F.slice(F.array(*v), 1, 12)).otherwise(F.array(*v)).alias("v"))
    return snapshots.parse_state_vectors(rows).select("icao24", "callsign", "us", "lat", "lon", r("alt_baro_ft", 4), r("gs_kt", 4), r("baro_rate_fpm", 4), "on_ground", "category")


@query
def parse_evidence(spark, d):
    i = F.col("event_id")
    text = lambda c: c.cast("string")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    rows = events(spark, d).select(
        F.when(i % 29 > 0, F.concat(F.lit("doc"), text(i))).otherwise(" ").alias("doc_id"), F.concat(F.lit(" Title "), text(i % 7)).alias("title"), F.lit(None).cast("string").alias("source"),
        F.when(i % 4 > 0, "b2").alias("reliability"), text(i % 9).alias("credibility"), F.lit("").alias("summary"),
        F.when(i % 3 == 0, F.concat(stamp, F.lit("Z"))).when(i % 3 == 1, F.concat(stamp, F.lit("+08:00"))).otherwise(stamp).alias("published"),
        F.when(i % 2 == 0, F.concat(F.lit("/x/"), text(i))).alias("url"), F.lit(None).cast("string").alias("detector"), text(i % 100).alias("lat"), text(i % 200).alias("lon"), F.lit("z").alias("zone"),
    )
    return snapshots.parse_evidence(rows, "sea", "http://a/").select("doc_id", "title", "source", "reliability", "credibility", "summary", "us", "url", "detector", "lat", "lon")


@query
def poll_pauses(spark, d):
    beats = events(spark, d).select((F.col("user_id") % 5).alias("region"), "us", F.lit(True).alias("ok"))
    return ingest.pauses(beats, replace(DEFAULTS, poll_seconds=300)).drop("reason")


@query
def phase_notes(spark, d):
    found = jamming.detect(scan(pos(spark, d)))
    return found.select("incident_id", grading.phase_note(F.col("evidence.degraded_in_terminal_phase"), F.col("evidence.degraded_altitude_known")).alias("phase"))


@query
def ring_membership(spark, d):
    """Reports in a zone that is no rectangle."""
    ring = F.array(*[F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon")) for a, b in RING])
    return pos(spark, d).where(in_ring(F.col("lat"), F.col("lon"), ring)).select("id")


#: A triangle with corners off the reports' lattice.
RING = [(0.55, 102.95), (2.05, 103.77), (0.57, 104.61)]


@query
def jamming_incremental(spark, d):
    """The grid since an aligned time: the whole's buckets from then on."""
    return jamming.detect(scan(pos(spark, d), since_us=at(1200))).select("incident_id", "affected_count")


@query
def refreshed_incidents(spark, d):
    """A cycle of one region over stored incidents of two: its own are derived again, the other's stay."""
    p, runs, outages = pos(spark, d), ledger.runs(spark), ledger.outages(spark)
    since = at(1200)
    recent = incremental.recent_incidents(p, runs, outages, since, region="north")
    old = every(spark, d).withColumn("score", F.lit(0.0))
    return incremental.refreshed_incidents(old, recent, since, "north").select("incident_id", "detector", "region", r("score"))


@query
def squawk_stays(spark, d):
    """Runs of one code, whatever it is: the batch form of value-aware sessions."""
    return live.run_lengths(pos(spark, d).where("squawk is not null"), "squawk").drop("island")


@query
def track_list(spark, d):
    return serving.track_list(tracks.tracks(pos(spark, d)), 50).select("track_id", "start_us")


@query
def aircraft_list(spark, d):
    rows = pos(spark, d).withColumns({"callsign": F.col("squawk"), **{c: F.lit(None).cast("string") for c in ("registration", "type_code", "category")}})
    return serving.aircraft_list(ingest.identities(rows), 100).select("icao24", "first_us", "last_us")


@query
def incident_lookup(spark, d):
    """The incident of the smallest spoof id, as an interface shows it."""
    found = every(spark, d)
    first = found.where("detector = 'spoof'").agg(F.min("incident_id").alias("i"))
    return serving.incident_rows(found.withColumn("_first", first.scalar()).where("incident_id = _first")).select("incident_id", "icao24", "detector", r("score"), "ts_start", "ts_end", "zone")


@query
def track_features(spark, d):
    """Points of every track's line, read back from its GeoJSON."""
    p = pos(spark, d)
    line = F.from_json("feature", "geometry struct<type:string,coordinates:array<array<double>>>, properties struct<track_id:string,point_count:long>")
    out = serving.track_features(tracks.tracks(p), p).select("track_id", line.alias("f"))
    return out.select("track_id", F.size("f.geometry.coordinates").cast("long").alias("points"), r(F.element_at("f.geometry.coordinates", 1)[0], 6, "first_lon"), r(F.element_at("f.geometry.coordinates", -1)[1], 6, "last_lat"))


@query
def aircraft_track(spark, d):
    return serving.aircraft_track(pos(spark, d), "a00007").select("us", "ts", r("lon"), r("lat"), "alt_ft", "nic", "nac_p", "region")


def runs_of_days(spark: SparkSession, d: str) -> DataFrame:
    """A run a day and region of the events: its first and last message and how many there were."""
    e = events(spark, d).select((F.col("user_id") % 5).alias("region"), "us")
    per = e.groupBy("region", F.floor(F.col("us") / (24 * HOUR_US)).cast("long").alias("day"))
    runs = per.agg(F.min("us").alias("started_us"), F.max("us").alias("last_message_us"), F.count(F.lit(1)).alias("report_count"))
    return runs.select((F.col("day") * 5 + F.col("region")).alias("id"), "started_us", "last_message_us", F.lit(None).cast("long").alias("stopped_us"), "region", "report_count")


@query
def last_runs(spark, d):
    return serving.last_runs(runs_of_days(spark, d), 12).select("id", "region", "report_count")


@query
def eval_scores(spark, d):
    cls = F.substring("icao24", 2, 5).cast("long") % 10
    kind = F.when(cls == 6, "incursion").when(cls == 7, "gap").when(cls == 8, "spoof").when(cls == 9, "squawk")
    labels = pos(spark, d).select("icao24", kind.alias("kind")).distinct().where("kind is not null")
    return evaluation.scores(labels, every(spark, d)).select("detector", "tp", "wanted", "found", r("recall"), r("precision"))


@query
def eval_jam_match(spark, d):
    label = spark.createDataFrame([(1.15, 103.9, at(1200), at(2400))], "lat double, lon double, start_us long, end_us long")
    found = jamming.detect(scan(pos(spark, d))).select("incident_id", "lat", "lon", "start_us", "end_us")
    inside = evaluation.matched_labels(found, label).select("incident_id", F.lit(True).alias("in_label"))
    return inside.unionByName(evaluation.matched_labels(found, label, "left_anti").select("incident_id", F.lit(False).alias("in_label")))


@query
def collector_health(spark, d):
    return ingest.health(pos(spark, d), ledger.outages(spark)).withColumn("reports_per_hour", F.round("reports_per_hour", 4))


@query
def dedup_positions(spark, d):
    return ingest.deduplicated(pos(spark, d)).select("id", "icao24", F.expr("us div 1000000").alias("second"), "region")


@query
def dedup_append(spark, d):
    p = pos(spark, d)
    return ingest.deduplicated(p, p.where(F.col("id") % 3 == 0)).select("id")


@query
def aircraft_identity(spark, d):
    """The last known value of each field; a report has some of them."""
    i, text = F.col("id"), lambda a, n: F.concat(F.lit(a), (F.col("id") % n).cast("string"))
    fields = {"callsign": F.col("squawk"), "registration": F.when(i % 5 == 0, text("9V-", 13)), "type_code": F.when(i % 7 == 0, text("B73", 3)), "category": F.when(i % 11 == 0, text("A", 6))}
    return ingest.identities(pos(spark, d).withColumns(fields)).select("icao24", *fields, "first_us", "last_us")


@query
def retention_prune(spark, d):
    kept = ingest.retained(pos(spark, d), at(3600), 0.5 / 24)
    return kept.agg(F.count(F.lit(1)).alias("kept"), F.min("us").alias("oldest_us"))


@query
def outage_from_heartbeats(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    beats = e.select((F.col("user_id") % 5).alias("region"), micros("ts").alias("us"), (F.col("event_type") != "click").alias("ok"))
    return ingest.outages_of_beats(beats).drop("reason")


@query
def bridge_runs(spark, d):
    return ingest.bridged(runs_of_days(spark, d)).drop("reason")


@query
def air_sea_correlate(spark, d):
    e = every(spark, d).select(F.col("incident_id").alias("doc_id"), "lat", "lon", F.col("start_us").alias("us"), "detector")
    both = picture.correlate(e.where(F.col("detector").isin("spoof", "squawk", "gap")), e.where(F.col("detector").isin("jamming", "incursion")), window_us=20 * 60_000_000)
    return both.select("air_doc_id", "sea_doc_id", r("delta_minutes"), r("distance_km"))


@query
def rate_limit(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), F.col("user_id").alias("client"), micros("ts").alias("us"))
    return picture.request_counts(e, 6 * 3600).select("id", "in_window")


@query
def zones_table(spark, d):
    """The zones, with the reports inside each."""
    box = lambda n, f, k: f(F.transform("polygon", lambda p: p[k])).alias(n)
    seen = pos(spark, d).select(F.explode(zones_at(F.col("lat"), F.col("lon"))).alias("zone_id")).groupBy("zone_id").agg(F.count(F.lit(1)).alias("n"))
    zones = frame(spark).select("zone_id", "kind", "sensitive", box("min_lat", F.array_min, "lat"), box("min_lon", F.array_min, "lon"), box("max_lat", F.array_max, "lat"), box("max_lon", F.array_max, "lon"))
    return zones.join(seen, "zone_id", "left").select(*zones.columns, F.coalesce("n", F.lit(0)).cast("long").alias("reports"))


@query
def zones_geojson(spark, d):
    """The features of the zones that have reports."""
    seen = pos(spark, d).select(F.explode(zones_at(F.col("lat"), F.col("lon"))).alias("zone_id")).distinct()
    return geojson(spark).join(seen, "zone_id", "left_semi")


@query
def track_resample(spark, d):
    return tracks.resample(pos(spark, d)).select("track_id", "k", r("lat"), r("lon"), r("alt_kft"))


@query
def track_sequence(spark, d):
    """Sums of the descriptor's channels; turns by size, as the sign of half a turn is chance."""
    total = lambda i, f=lambda x: x: F.aggregate("sequence", F.lit(0.0), lambda a, x: a + f(x[i]))
    sums = [total(0).alias("north_km"), total(1).alias("east_km"), total(2).alias("length_km"), total(3, F.abs).alias("turned"), total(4).alias("climb_kft")]
    out = tracks.sequences(pos(spark, d)).select("track_id", "point_count", F.size("sequence").alias("steps"), F.size("features").alias("width"), *sums)
    return out.select("track_id", "point_count", "steps", "width", r("north_km", 4), r("east_km", 4), r("length_km", 4), r("turned", 4), r("climb_kft", 4))


@query
def anomaly_incidents(spark, d):
    return flat(anomaly.detect(tracks.sequences(pos(spark, d))))


@query
def anomaly_auc(spark, d):
    seq = kept(tracks.sequences(pos(spark, d)).select("track_id", "icao24", "sequence"))
    scored = anomaly.scored(seq, anomaly.fitted_to(seq, least=1)).select(F.col("error").alias("score"), (F.substring("icao24", 2, 5).cast("long") % 10 == 8).cast("int").alias("label"))
    return evaluation.auc(kept(scored))


@query
def grid_streamed(spark, d):
    """The fall-through grid, of reports that come as a stream of files out of order."""
    home = shared_folder(spark)
    reports = streams.streamed(spark, streams.landed(pos(spark, d)))
    streams.run(grid.judged_buckets(reports, f"{home}/cells", f"{home}/incidents", f"{home}/checkpoint", delay=streams.DELAY))
    return spark.read.parquet(f"{home}/cells").select("level", "scoreable", "ci", "cj", "bucket", F.size("aircraft").cast("long").alias("aircraft"))


@query
def jamming_streamed(spark, d):
    """Area incidents of the same stream."""
    home = shared_folder(spark)
    reports = streams.streamed(spark, streams.landed(pos(spark, d)))
    streams.run(grid.judged_buckets(reports, f"{home}/cells", f"{home}/incidents", f"{home}/checkpoint", delay=streams.DELAY))
    return flat(spark.read.parquet(f"{home}/incidents"))


@query
def squawk_streamed(spark, d):
    """Emergency codes of a stream, by value-aware sessions."""
    home, landed = shared_folder(spark), streams.landed(pos(spark, d))
    groups = ordered.groups_for(spark.read.parquet(landed).count())
    found = ordered.stays(streams.streamed(spark, landed), delay=streams.DELAY, groups=groups)
    streams.run(streams.appended(found, f"{home}/stays", f"{home}/checkpoint"))
    found = ordered.incidents_of_stays(spark.read.parquet(f"{home}/stays"))
    return flat(found, F.col("evidence.samples").alias("samples"))


def beats_of(spark: SparkSession, d: str) -> DataFrame:
    """Poll outcomes made of the events: five regions; a click is a failure."""
    e = events(spark, d)
    return e.select((F.col("user_id") % 5).cast("string").alias("region"), "us", F.col("event_id").alias("id"), (F.col("event_type") != "click").alias("ok"), F.lit(False).alias("stop"))


@query
def outages_streamed(spark, d):
    """The outage ledger's failures, kept by a state machine on a stream of poll outcomes."""
    home = shared_folder(spark)
    beats = streams.streamed(spark, streams.landed(beats_of(spark, d)))
    streams.run(streams.appended(ordered.outages(beats, replace(DEFAULTS, poll_seconds=300), streams.DELAY), f"{home}/changes", f"{home}/checkpoint"))
    told = ordered.ledger(spark.read.parquet(f"{home}/changes"))
    return told.where("reason = 'failures'").select(F.col("region").cast("long").alias("region"), "opened_us", "closed_us")


@query
def pauses_streamed(spark, d):
    """The outage ledger's pauses on the same stream, those that have ended."""
    home = shared_folder(spark)
    beats = streams.streamed(spark, streams.landed(beats_of(spark, d)))
    streams.run(streams.appended(ordered.outages(beats, replace(DEFAULTS, poll_seconds=300), streams.DELAY), f"{home}/changes", f"{home}/checkpoint"))
    told = ordered.ledger(spark.read.parquet(f"{home}/changes"))
    return told.where("reason = 'pause' AND closed_us IS NOT NULL").select(F.col("region").cast("long").alias("region"), "opened_us", "closed_us")


@query
def tracks_streamed(spark, d):
    """Tracks kept current by pruned cycles on a stream whose reports come late: equal to those of all reports."""
    home = shared_folder(spark)
    reports = streams.streamed(spark, streams.landed(pos(spark, d))).where("icao24 IS NOT NULL")
    kept = store.Store(spark, home)
    streams.run(reports.writeStream.foreachBatch(kept.cycle).option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True))
    out = kept.tracks()
    return out.select("track_id", "icao24", "point_count", r("distance_km"), "start_us", "end_us", "region", r("start_lat"), r("start_lon"), r("end_lat"), r("end_lon"))


@query
def pca_errors(spark, d):
    """Every track's error when rebuilt from the components of all tracks."""
    # Components read the features four times: derived once.
    seq = kept(tracks.sequences(pos(spark, d)).select("track_id", "features"))
    fitted = baselines.components(seq)
    return baselines.rebuilt(seq, fitted).select("track_id", r("error", 9))


@query
def isolation_scores(spark, d):
    """Every track's score in an isolation forest whose trees are grown from samples of all tracks."""
    # Tracks are counted, drawn from and scored: derived once.
    seq = kept(tracks.sequences(pos(spark, d)).select("track_id", "features"))
    return baselines.isolated(seq, baselines.forest(seq)).select("track_id", r("score", 9))


@query
def rank_stability(spark, d):
    """How alike three measures rank all tracks: points, distance and duration."""
    measures = [F.col("point_count").cast("double"), F.round("distance_km", 3), F.round((F.col("end_us") - F.col("start_us")) / 60e6, 3)]
    # Stability reads each of them seven times.
    t = kept(tracks.tracks(pos(spark, d)).select("track_id", *[m.alias(f"m{i}") for i, m in enumerate(measures)]))
    found = baselines.stability([t.select("track_id", F.col(f"m{i}").alias("score")) for i in range(len(measures))])
    return spark.createDataFrame([tuple(found.values())], ", ".join(f"{k} double" for k in found)).select(*[r(k) for k in found])


@query
def model_stability(spark, d):
    """How stably the recurrent model and its baselines rank all tracks over seeds."""
    found = anomaly.benchmark(tracks.sequences(pos(spark, d)), (1, 2, 3), epochs=10)
    return spark.createDataFrame([(name, *x.values()) for name, x in found.items()], "model string, spearman double, top_overlap double, separation double")


@query
def track_lines(spark, d):
    """Every track's line without the points that 2 km of tolerance spare."""
    p = pos(spark, d)
    line = F.transform("points", lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon")))
    g = tracks.geometry(tracks.tracks(p), p).select("track_id", F.size("points").cast("long").alias("points"), simplified(line, 2.0).alias("line"))
    total = lambda c: r(F.aggregate("line", F.lit(0.0), lambda a, x: a + x[c]), 5, f"sum_{c}")
    return g.select("track_id", "points", F.size("line").cast("long").alias("kept"), total("lat"), total("lon"))


@query
def track_features_stored(spark, d):
    """Points of every track's line, from features written to a table of part files and read back."""
    p, home = pos(spark, d), shared_folder(spark)
    spark.dataSource.register(features.Features)
    serving.track_features(tracks.tracks(p), p).write.format("trackloom_features").option("path", home).mode("append").save()
    line = F.from_json("feature", "geometry struct<type:string,coordinates:array<array<double>>>")
    out = spark.read.format("trackloom_features").option("path", home).load().select("track_id", line.alias("f"))
    return out.select("track_id", F.size("f.geometry.coordinates").cast("long").alias("points"), r(F.element_at("f.geometry.coordinates", 1)[0], 6, "first_lon"), r(F.element_at("f.geometry.coordinates", -1)[1], 6, "last_lat"))


FLAGSHIP: Query = QUERIES["air_picture_aircraft"]

