"""Statistical studies over positions and incidents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import cell, haversine_km
from ..functions.grading import plausible_gap, plausible_incursion, plausible_jamming
from ..functions.timefn import floor_to
from ..settings import DEFAULTS, HOUR_US, Settings
from . import jamming
from .sequences import merged_intervals
from .visits import speed_steps

# The studies' ceilings and bin edges, in knots.
THRESHOLDS = (750.0, 1000.0, 1200.0, 1400.0)
EDGES = (0.0, 250.0, 500.0, 750.0, 1000.0, 1200.0, 1400.0, 2000.0, 5000.0)


def speed_sensitivity(positions: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Per threshold: steps above it, aircraft with one, aircraft with enough for an incident. One row per aircraft crosses the shuffle."""
    steps = speed_steps(positions)
    over = steps.groupBy("icao24").agg(*[F.count_if(F.col("speed_kt") > t).alias(f"n{i}") for i, t in enumerate(THRESHOLDS)])
    rows = over.select(F.explode(F.array(*[F.struct(F.lit(t).alias("threshold_kt"), F.col(f"n{i}").alias("n")) for i, t in enumerate(THRESHOLDS)])).alias("x")).select("x.*")
    return rows.groupBy("threshold_kt").agg(F.sum("n").alias("steps"), F.count_if(F.col("n") > 0).alias("aircraft"), F.count_if(F.col("n") >= s.spoof_min_violations).alias("candidates"))


def speed_histogram(positions: DataFrame) -> DataFrame:
    """Steps by speed, left-closed bins, with zeros."""
    v = F.col("speed_kt")
    one = speed_steps(positions).agg(*[F.count_if((v >= a) & (v < b)).alias(f"n{i}") for i, (a, b) in enumerate(zip(EDGES, (*EDGES[1:], float("inf")), strict=True))])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("low_kt"), F.col(f"n{i}").alias("steps")) for i, a in enumerate(EDGES)])).alias("x")).select("x.*")


#: Values are ranked in bands of the same width; what lies beyond the last band is in it.
BAND_KT, BANDS = 0.5, 10_000
QUANTILES = {"p50": 0.5, "p90": 0.9, "p99": 0.99, "p999": 0.999}


def ranked(values: DataFrame, value: str, band: Column) -> DataFrame:
    """Each distinct value with ``n``, ``below`` (rows with a smaller one) and ``total``.

    ``band`` is a number that grows with the value, of which there are few: their sums are added up first, so that
    the values of each band are ranked on their own.
    """
    by = values.groupBy(value).agg(F.count(F.lit(1)).alias("n")).withColumn("_band", band)
    # One row a band.
    sums = by.groupBy("_band").agg(F.sum("n").alias("_n"))
    before = W.orderBy("_band").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("_band", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(W.partitionBy(F.lit(0))).alias("total"))
    own = W.partitionBy("_band").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    return by.join(sums, "_band").select(value, "n", (F.col("_before") + F.coalesce(F.sum("n").over(own), F.lit(0))).alias("below"), "total")


#: Bands that are made from the values themselves.
EDGE_COUNT = 200


def banded(values: DataFrame, value: str) -> Column:
    """Bands of about equal numbers of rows for ``ranked``: any edges will do, so they are estimated."""
    edges = values.agg(F.percentile_approx(value, [k / EDGE_COUNT for k in range(1, EDGE_COUNT)], 10_000)).first()[0] or []
    known = F.array(*[F.lit(float(x)) for x in sorted(set(edges))]) if edges else F.array().cast("array<double>")
    return F.size(F.filter(known, lambda e: e <= F.col(value)))


def quantiles(values: DataFrame, value: str, shares: list[float]) -> list[float | None]:
    """Exact quantiles, linear between neighbours, without all values in one task; null without rows."""
    at = ranked(values.where(F.col(value).isNotNull()), value, banded(values, value))
    out = []
    for q in shares:
        place = F.lit(q) * (F.col("total") - 1)
        holds = lambda k: (F.col("below") <= k) & (k < F.col("below") + F.col("n"))
        low, high = (F.max(F.when(holds(k), F.col(value))) for k in (F.floor(place), F.ceil(place)))
        out.append(low + (high - low) * F.max(place - F.floor(place)))
    return list(at.agg(*out).first())


def speed_percentiles(positions: DataFrame) -> DataFrame:
    """Percentiles of the steps' speeds, linear between neighbours, and the highest."""
    band = F.least(F.floor(F.col("speed_kt") / BAND_KT), F.lit(BANDS)).cast("long")
    at = ranked(speed_steps(positions).select("speed_kt"), "speed_kt", band)
    out = []
    for name, q in QUANTILES.items():
        place = F.lit(q) * (F.col("total") - 1)
        holds = lambda k: (F.col("below") <= k) & (k < F.col("below") + F.col("n"))
        low, high = (F.max(F.when(holds(k), F.col("speed_kt"))) for k in (F.floor(place), F.ceil(place)))
        share = F.max(place - F.floor(place))
        out.append((low + (high - low) * share).alias(name))
    return at.agg(*out, F.max("speed_kt").alias("max_kt"))


def speed_tail_clues(positions: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    tail = speed_steps(positions).where(F.col("speed_kt") > s.spoof_max_speed_kt)
    return tail.agg(
        F.count(F.lit(1)).alias("steps"),
        F.count_if((F.col("seconds") <= 10) & (F.col("km") <= 10)).alias("short_and_near"),
        F.count_if((F.col("seconds") <= 120) & (F.col("km") >= 25)).alias("fast_and_far"),
        F.count_if(F.col("gs_kt") <= 650).alias("plausible_reported"),
    )


def spine(positions: DataFrame, width: int = HOUR_US) -> DataFrame:
    """Every bucket from the first report to the last."""
    span = positions.agg(floor_to(F.min("us"), width).alias("lo"), F.max("us").alias("hi")).where("lo is not null")
    return span.select(F.explode(F.sequence("lo", "hi", F.lit(width))).alias("hour_us"))


def activity(positions: DataFrame, width: int = HOUR_US) -> DataFrame:
    found = positions.groupBy(floor_to(F.col("us"), width).alias("hour_us")).agg(F.count(F.lit(1)).alias("reports"), F.count_distinct("icao24").alias("aircraft"))
    zero = F.lit(0).cast("long")
    return spine(positions, width).join(found, "hour_us", "left").select("hour_us", F.coalesce("reports", zero).alias("reports"), F.coalesce("aircraft", zero).alias("aircraft"))


def scoreability(reports: DataFrame, width: int = HOUR_US, s: Settings = DEFAULTS) -> DataFrame:
    """Finest cells seen and left unscoreable per bucket of the clock, each judged on the reports of its bucket.

    Grid buckets divide the clock's, so one pass judges all; only a report exactly on a boundary would
    belong to two, and here belongs to the later one.
    """
    minutes = s.window_minutes * 60_000_000
    seen = jamming.worst(reports, s).select("fi", "fj", "bucket").distinct().groupBy(floor_to(F.col("bucket") * minutes, width).alias("hour_us")).agg(F.count(F.lit(1)).alias("cell_windows"))
    left = jamming.levels(reports, s).groupBy(floor_to(F.col("bucket") * minutes, width).alias("hour_us")).agg(F.count_if(~F.col("scoreable")).alias("unscoreable"))
    return seen.join(left, "hour_us")


def incidents_by_hour(incidents: DataFrame, width: int = HOUR_US) -> DataFrame:
    kinds = ["jamming", "gap", "incursion", "spoof", "squawk"]
    return incidents.groupBy(floor_to(F.col("start_us"), width).alias("hour_us")).agg(*[F.count_if(F.col("detector") == k).alias(k) for k in kinds])


def outage_minutes(outages: DataFrame, runs: DataFrame, region: str | None, lo_us: int, hi_us: int, width: int = HOUR_US) -> DataFrame:
    """Minutes of merged outages (of the region's runs, cut to the span) per bucket."""
    own = outages.join(runs.select(F.col("id").alias("run_id"), "region"), "run_id")
    if region:
        own = own.where(F.col("region") == region)
    cut = own.select(F.greatest("opened_us", F.lit(lo_us)).alias("start_us"), F.least(F.coalesce("closed_us", F.lit(hi_us)), F.lit(hi_us)).alias("end_us")).where("end_us > start_us")
    parts = merged_intervals(cut).withColumn("hour_us", F.explode(F.sequence(floor_to(F.col("start_us"), width), F.col("end_us"), F.lit(width))))
    minutes = (F.least("end_us", F.col("hour_us") + width) - F.greatest("start_us", "hour_us")) / 60e6
    return parts.groupBy("hour_us").agg(F.sum(minutes).alias("outage_minutes")).where("outage_minutes > 0")


def hourly(positions: DataFrame, incidents: DataFrame, runs: DataFrame, outages: DataFrame, width: int = HOUR_US, s: Settings = DEFAULTS) -> DataFrame:
    """One row a bucket from the first report's to the last's: activity, cells seen and left unscoreable, incidents of each detector, minutes of outage."""
    from ..sources.positions import scan

    span = positions.agg(F.min("us"), F.max("us")).first()
    if span[0] is None:
        span = (0, 0)
    parts = [scoreability(scan(positions), width, s), incidents_by_hour(incidents, width), outage_minutes(outages, runs, None, span[0], span[1] + 1, width)]
    out = activity(positions, width)
    for p in parts:
        out = out.join(p, "hour_us", "left")
    return out.na.fill(0)


def clock_hours(hours: DataFrame, offset_hours: int = 8) -> DataFrame:
    """Mean and population spread per local clock hour over complete, clean hours.

    hours: hour_us, reports, cell_windows, unscoreable, outage_minutes, lo_us, hi_us (the span).
    """
    clean = hours.where(
        (F.col("hour_us") >= F.col("lo_us")) & (F.col("hour_us") + HOUR_US <= F.col("hi_us")) & (F.col("outage_minutes") < 5) & (F.col("cell_windows") >= 5)
    )
    share = 100.0 * F.col("unscoreable") / F.col("cell_windows")
    local = F.pmod(F.expr(f"hour_us div {HOUR_US}") + offset_hours, F.lit(24))
    return clean.groupBy(local.alias("local_hour")).agg(
        F.count(F.lit(1)).alias("samples"), F.avg("reports").alias("reports_mean"), F.stddev_pop("reports").alias("reports_spread"),
        F.avg(share).alias("unscoreable_mean"), F.stddev_pop(share).alias("unscoreable_spread"),
    )


def missing_hours(profile: DataFrame) -> DataFrame:
    return profile.sparkSession.range(24).select(F.col("id").alias("local_hour")).join(profile.select("local_hour"), "local_hour", "left_anti")


def busiest(profile: DataFrame) -> DataFrame:
    """The busiest and the quietest clock hour."""
    return profile.agg(F.max_by("local_hour", F.struct("reports_mean", -F.col("local_hour"))).alias("busiest"), F.min_by("local_hour", F.struct("reports_mean", "local_hour")).alias("quietest"))


def detector_mix(incidents: DataFrame, span_us: int) -> DataFrame:
    days = max(span_us / (24 * HOUR_US), 1 / 24)
    return incidents.groupBy("detector").agg(F.count(F.lit(1)).alias("incidents")).withColumn("per_day", F.col("incidents") / F.lit(days))


def lane_summary(positions: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Per region: reports with integrity, aircraft, span, degraded and hard losses."""
    own = positions.where(F.col("nic").isNotNull())
    return own.groupBy("region").agg(
        F.count(F.lit(1)).alias("reports"), F.count_distinct("icao24").alias("aircraft"), ((F.max("us") - F.min("us")) / 60e6).alias("span_minutes"),
        F.count_if(F.col("nic") <= s.bad_nic_max).alias("degraded_reports"),
        F.count_if((F.col("nic") == 0) & (F.coalesce("nac_p", F.lit(0)) == 0)).alias("hard_loss_reports"),
    )


def nic_histogram(positions: DataFrame) -> DataFrame:
    return positions.where(F.col("nic").isNotNull()).groupBy("region", "nic").agg(F.count(F.lit(1)).alias("reports"))


def lane_overlap(positions: DataFrame) -> DataFrame:
    """The time all regions have in common."""
    return positions.where("nic is not null").groupBy("region").agg(F.min("us").alias("lo"), F.max("us").alias("hi")).agg(F.max("lo").alias("start_us"), F.min("hi").alias("end_us"))


def calibration(incidents: DataFrame, aircraft: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """detector, reliability, plausibility, n over gap, incursion and jamming incidents (evidence as JSON)."""
    ev = lambda k: F.get_json_object("evidence", f"$.{k}").cast("double")
    kinds = incidents.where(F.col("detector").isin("gap", "incursion", "jamming")).join(aircraft.select("icao24", "type_code", "registration"), "icao24", "left")
    plausible = (
        F.when(F.col("detector") == "gap", plausible_gap(ev("gap_minutes"), ev("displacement_km"), s.gap_min_minutes, s.gap_min_km))
        .when(F.col("detector") == "incursion", plausible_incursion(F.col("type_code"), F.col("registration")))
        .otherwise(plausible_jamming(ev("aircraft_observed"), s.min_aircraft))
    )
    return kinds.groupBy("detector", "reliability", plausible.alias("plausibility")).agg(F.count(F.lit(1)).alias("n"))


def scores(labels: DataFrame, incidents: DataFrame, kinds: tuple[str, ...] = ("gap", "incursion", "spoof", "squawk")) -> DataFrame:
    """Per detector: precision and recall by sets of aircraft. labels: icao24, kind."""
    want = labels.select(F.col("kind").alias("detector"), "icao24", F.lit(1).alias("w"), F.lit(0).alias("g"))
    got = incidents.select("detector", "icao24", F.lit(0).alias("w"), F.lit(1).alias("g"))
    each = want.unionByName(got).where(F.col("detector").isin(*kinds)).groupBy("detector", "icao24").agg(F.max("w").alias("w"), F.max("g").alias("g"))
    out = each.groupBy("detector").agg(F.sum(F.col("w") * F.col("g")).cast("long").alias("tp"), F.sum("w").cast("long").alias("wanted"), F.sum("g").cast("long").alias("found"))
    share = lambda n: F.when(F.col(n) > 0, F.col("tp") / F.col(n))
    return out.select("detector", "tp", "wanted", "found", share("wanted").alias("recall"), share("found").alias("precision"))


#: Fixed value: how far an incident may be from the label it matches.
MATCH_KM = 0.8 * 111.0
#: Degrees of latitude in a band, and the time in a slot: partners lie in the same or a neighbouring band, in a slot both touch.
MATCH_BAND, MATCH_SLOT = 1.0, HOUR_US


def matched_labels(labels: DataFrame, incidents: DataFrame, how: str = "left_semi") -> DataFrame:
    """Labels (lat, lon, start_us, end_us) with, or by ``left_anti`` without, an incident near in space that overlaps in time.

    With incidents on the left the same function finds those outside any label. Both sides meet by band of
    latitude and time slot.
    """
    slots = lambda lo, hi: F.sequence(F.floor(lo / MATCH_SLOT).cast("long"), F.floor(hi / MATCH_SLOT).cast("long"))
    band = lambda c: F.floor(F.col(c) / MATCH_BAND).cast("long")
    ends = F.coalesce("end_us", "start_us")
    i = incidents.select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.col("start_us").alias("_s"), ends.alias("_e"))
    i = i.withColumn("_band", F.explode(F.array(*[band("_lat") + k for k in (-1, 0, 1)]))).withColumn("_slot", F.explode(slots(F.col("_s"), F.col("_e"))))
    # Equal rows are one here and are counted, so that each comes back as often as it was.
    row = F.struct(*labels.columns)
    each = labels.groupBy(row.alias("_row")).agg(F.count(F.lit(1)).alias("_times")).select("_row", "_times", "_row.*")
    each = each.withColumn("_slots", F.explode_outer(slots(F.col("start_us"), ends))).withColumn("_bands", band("lat"))
    near = haversine_km(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")) <= MATCH_KM
    on = (F.col("_slots") == F.col("_slot")) & (F.col("_bands") == F.col("_band")) & near & (F.col("_s") <= ends) & (F.col("_e") >= F.col("start_us"))
    met = each.join(i, on, "left").groupBy("_row").agg(F.any_value("_times").alias("_times"), F.count("_s").alias("_hits"))
    kept = met.where(F.col("_hits") > 0 if how == "left_semi" else F.col("_hits") == 0)
    return kept.select("_row", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).select("_row.*")


def auc(scored: DataFrame, cuts: int = 200) -> DataFrame:
    """ROC-AUC of (score, label 0/1) by mean ranks: ties count half. Scores are ranked in bands between ``cuts`` approximate quantiles."""
    edges = scored.agg(F.percentile_approx("score", [k / cuts for k in range(1, cuts)], 10_000).alias("edges")).select("edges")
    named = scored.select("score", "label", edges.scalar().alias("_edges"))
    banded = named.select("score", "label", F.size(F.filter("_edges", lambda e: e <= F.col("score"))).alias("_b"))
    by = banded.groupBy("score", "_b").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos"))
    sums = by.groupBy("_b").agg(F.sum("n").alias("_n"))
    sums = sums.select("_b", F.coalesce(F.sum("_n").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # one row a band
    own = F.coalesce(F.sum("n").over(W.partitionBy("_b").orderBy("score").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranks = by.join(sums, "_b").withColumn("rank", F.col("_before") + own + (F.col("n") + 1) / 2)
    p, q = F.sum("pos"), F.sum(F.col("n") - F.col("pos"))
    return ranks.agg(((F.sum(F.col("rank") * F.col("pos")) - p * (p + 1) / 2) / (p * q)).alias("auc"))


def coverage_compare(positions: DataFrame, left: str, right: str, cell_deg: float = 0.5, min_aircraft: int = 4, source: str = "source") -> DataFrame:
    """How two sources' receiver densities complement one another: one aggregation with both sources' sets of aircraft."""
    flags = [F.max((F.col(source) == x).cast("int")).alias(n) for x, n in ((left, "l"), (right, "r"))]
    own = positions.where(F.col(source).isin(left, right))
    planes = own.groupBy("icao24").agg(*flags).agg(F.sum("l").alias("left_aircraft"), F.sum("r").alias("right_aircraft"), F.count_if((F.col("l") == 1) & (F.col("r") == 1)).alias("shared_aircraft"))
    each = own.groupBy(cell(F.col("lat"), cell_deg).alias("ci"), cell(F.col("lon"), cell_deg).alias("cj"), "icao24").agg(*flags)
    cells = each.groupBy("ci", "cj").agg(F.sum("l").alias("l"), F.sum("r").alias("r"), F.count(F.lit(1)).alias("u"))
    k = min_aircraft
    told = cells.agg(
        F.count_if(F.col("l") > 0).alias("left_cells"), F.count_if(F.col("r") > 0).alias("right_cells"), F.count_if((F.col("l") > 0) & (F.col("r") > 0)).alias("shared_cells"),
        F.count_if(F.col("l") >= k).alias("left_dense"), F.count_if(F.col("r") >= k).alias("right_dense"), F.count_if(F.col("u") >= k).alias("union_dense"),
        F.count_if((F.col("l") < k) & (F.col("u") >= k)).alias("density_gain"),
    )
    # Two single rows side by side.
    rows = [d.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("long").alias("n")) for c in d.columns])).alias("x")).select("x.*") for d in (planes, told)]
    return reduce(DataFrame.unionByName, rows)
