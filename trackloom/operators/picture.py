"""The serving layer: all incidents, the composite picture, the evidence feed, correlation and series."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import cell, haversine_km, implied_speed_kt
from ..functions.grading import credibility
from ..functions.timefn import floor_to
from ..settings import DEFAULTS, HOUR_US, MINUTE_US, Settings
from ..sources.positions import scan
from ..zones import REGISTRY, inside, lookup
from . import gaps, jamming, visits
from .incidents import described_by, flat
from .sequences import islands, order

DETECTORS = ("jamming", "gap", "incursion", "spoof", "squawk", "anomaly")


class _Path:
    """The expressions of ``path_incidents``, made once for each ``Settings``."""

    def __init__(self, s: Settings) -> None:
        w = order()
        before, upto = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(W.unboundedPreceding, W.currentRow)
        border = [z for z in REGISTRY if z.kind == "border"]
        low = ~F.col("on_ground") & (F.coalesce("alt_baro_ft", F.lit(0.0)) < s.incursion_max_alt_ft)
        self.here = {f"_low{k}": low & inside(z, F.col("lat"), F.col("lon")) for k, z in enumerate(border)}
        past = F.struct("us", "id", "ts", "lat", "lon", "alt_baro_ft", "baro_rate_fpm", "gs_kt", "region")
        coded = F.when(F.col("squawk").isNotNull(), F.struct("us", "squawk"))
        was = {f"_was{k}": F.last(F.when(F.col(f"_low{k}"), F.col("us")), ignorenulls=True).over(before) for k in range(len(border))}
        self.before = {"p": F.lag(past).over(w), "_code": F.last(coded, ignorenulls=True).over(before)} | was
        gap = s.incursion_gap_minutes * MINUTE_US
        changed = F.col("squawk").isNotNull() & ((F.col("us") - F.col("_code.us") > gap) | (F.col("squawk") != F.col("_code.squawk")))
        new = {"_codes": changed} | {f"_stay{k}": F.col(f"_low{k}") & (F.col("us") - F.col(f"_was{k}") > gap) for k in range(len(border))}
        self.runs = {n: F.sum(F.coalesce(c, F.lit(False)).cast("long")).over(upto) for n, c in new.items()}
        self.km = haversine_km(F.col("p.lat"), F.col("p.lon"), F.col("lat"), F.col("lon"))
        self.speed = implied_speed_kt(F.col("km"), (F.col("us") - F.col("p.us")) / 1e6)
        silent = (
            (F.col("us") - F.col("p.us") >= int(s.gap_min_minutes * MINUTE_US)) & (F.coalesce("p.alt_baro_ft", F.lit(0.0)) >= s.gap_min_alt_ft)
            & (F.coalesce("p.baro_rate_fpm", F.lit(0.0)) >= s.gap_max_descent_fpm) & (F.col("km") >= s.gap_min_km)
        )
        part = lambda when, kind, key, run: F.when(when, F.struct(F.lit(kind).alias("kind"), key.alias("key"), run.cast("long").alias("run")))
        parts = [
            part(silent, "gap", F.lit(""), F.col("p.id")),
            part(F.col("speed") > s.spoof_max_speed_kt, "spoof", F.lit(""), F.lit(0)),
            part(F.col("squawk").isin(*s.squawk_codes), "squawk", F.col("squawk"), F.col("_codes")),
            *[part(F.col(f"_low{k}"), "incursion", F.lit(z.zone_id), F.col(f"_stay{k}")) for k, z in enumerate(border)],
        ]
        self.members = [*map(F.col, ("icao24", "us", "id", "ts", "lat", "lon", "region", "alt_baro_ft", "baro_rate_fpm", "p", "km", "speed")), F.explode(F.array_compact(F.array(*parts))).alias("m")]
        stay = F.col("kind") == "incursion"
        alt = F.coalesce("alt_baro_ft", F.lit(0.0))
        self.sums = [
            F.count(F.lit(1)).alias("samples"), F.min("us").alias("first_us"), F.max("us").alias("end_us"),
            F.min_by(F.struct("ts", "lat", "lon", "region"), F.struct("us", "id")).alias("first"), F.max_by(F.struct("lat", "lon", "region"), F.struct("us", "id")).alias("last"),
            F.max("speed").alias("max_speed"), F.percentile(F.when(stay, F.abs("baro_rate_fpm")), 0.5).alias("median_rate"), F.min(alt).alias("min_alt"), F.max(alt).alias("max_alt"),
            # A visit is one stay of one aircraft.
            F.array_sort(F.collect_list(F.when(stay, F.struct("us", "id", "lat", "lon")))).alias("path"),
            F.any_value(F.when(F.col("kind") == "gap", F.struct("p", "lat", "lon", "km"))).alias("g"),
        ]
        kind, self.silence = F.col("kind"), F.col("kind") == "gap"
        enough = self.silence | ((kind == "spoof") & (F.col("samples") >= s.spoof_min_violations)) | ((kind == "squawk") & (F.col("samples") >= s.squawk_min_samples))
        level = stay & (F.col("samples") >= s.incursion_min_samples) & (F.col("median_rate").isNull() | (F.col("median_rate") < s.incursion_max_rate_fpm))
        self.enough = enough | level
        middle = F.get("path", F.floor(F.size("path") / 2).cast("int"))
        at = lambda c: F.when(stay, middle[c]).when(kind == "squawk", F.col(f"last.{c}")).otherwise(F.col(f"first.{c}"))
        region = F.when(self.silence, F.col("g.p.region")).when(kind == "squawk", F.col("last.region")).otherwise(F.col("first.region"))
        start_us = F.when(self.silence, F.col("g.p.us")).otherwise(F.col("first_us"))
        minutes = (F.col("end_us") - start_us) / 60e6
        self.found = [
            F.concat_ws(":", "kind", "icao24", "key", F.col("run").cast("string")).alias("id"), F.col("icao24"), kind, F.when(stay, F.col("key")).alias("zone"), F.when(kind == "squawk", F.col("key")).alias("squawk"),
            F.col("samples"), F.col("samples").alias("violations"), *map(F.col, ("max_speed", "median_rate", "min_alt", "max_alt")), start_us.alias("start_us"), F.col("end_us"), minutes.alias("dwell_minutes"),
            minutes.alias("gap_minutes"), F.when(self.silence, F.col("g.p.ts")).otherwise(F.col("first.ts")).alias("start_ts"), F.when(self.silence, start_us).alias("us"), region.alias("region"),
            at("lat").alias("lat"), at("lon").alias("lon"), F.col("g.km").alias("km"), F.col("g.p.lat").alias("p_lat"), F.col("g.p.lon").alias("p_lon"), F.col("g.lat").alias("n_lat"), F.col("g.lon").alias("n_lon"),
            F.col("g.p.alt_baro_ft").alias("alt"), F.col("g.p.baro_rate_fpm").alias("rate"), F.col("g.p.gs_kt").alias("gs_kt"),
        ]
        self.stays_in = ~self.silence | ~gaps.could_have_left(*map(F.col, ("p_lat", "p_lon", "gs_kt", "gap_minutes", "c_lat", "c_lon", "c_radius")))


_path = cache(_Path)


def path_incidents(positions: DataFrame, runs: DataFrame, outages: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Silences, low visits, impossible motion and emergency codes in one pass, evidence as JSON.

    One exchange and one sort by aircraft and time serve all four: a report's predecessor, and the predecessors among
    those with a code and among those low in a zone, are looked up in the same window. The few reports that
    are part of something are then grouped by what it is.
    """
    x = _path(s)
    rows = positions.withColumns(x.here).withColumns(x.before).withColumns(x.runs).withColumn("km", x.km).withColumn("speed", x.speed)
    found = rows.select(*x.members).select("*", "m.*").groupBy("icao24", "kind", "key", "run").agg(*x.sums).where(x.enough).select(*x.found)
    held = gaps.boundary(gaps.without_outage(found, outages, x.silence), runs, s)
    return described_by(held.where(x.stays_in), "kind", (gaps.gap_spec(s), visits.incursion_spec(s), visits.spoof_spec(s), visits.squawk_spec(s)))


def all_incidents(positions: DataFrame, runs: DataFrame, outages: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """The five deterministic detectors' incidents, evidence as JSON: two passes over the reports, by place and by aircraft."""
    return flat(jamming.detect(scan(positions), s)).unionByName(path_incidents(positions, runs, outages, s))


def latest_of(incidents: DataFrame, sequence: str) -> DataFrame:
    """One row an incident_id: the one with the highest ``sequence``."""
    row = F.struct(*incidents.columns)
    return incidents.groupBy("incident_id").agg(F.max_by(row, sequence).alias("r")).select("r.*")


def aircraft_rollup(incidents: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """One row an aircraft: what its incidents say together. Of equal scores the smallest incident_id is best."""
    own = incidents.where(F.col("icao24").isNotNull()).withColumn("sensitive", F.coalesce(lookup(F.col("zone_id"), "sensitive"), F.lit(False)))
    best = F.min_by(F.struct("score", "zone_id"), F.struct((-F.col("score")).alias("s"), F.col("incident_id")))
    out = own.groupBy("icao24").agg(
        F.array_sort(F.collect_set("detector")).alias("detectors"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("techniques")))).alias("techniques"),
        best.alias("best"),
        F.bool_or("sensitive").alias("in_sensitive"),
        F.min("reliability").alias("reliability"),
        F.array_sort(F.collect_list("incident_id")).alias("incidents"),
        F.min("start_us").alias("start_us"),
    )
    bonus = s.agreement_bonus * (F.size("detectors") - 1)
    zone_bonus = F.when(F.col("in_sensitive"), F.lit(s.sensitive_bonus)).otherwise(0.0)
    return out.withColumns(
        {
            "best_score": F.col("best.score"),
            "agreement_bonus": F.bround(bonus, 3),
            "sensitive_bonus": zone_bonus,
            "zone": F.col("best.zone_id"),
            "risk": F.bround(F.least(F.lit(1.0), F.col("best.score") + bonus + zone_bonus), 3),
        }
    ).drop("best")


def riskiest(rollup: DataFrame) -> DataFrame:
    """Aircraft in the order of the picture: the highest risk first."""
    return rollup.orderBy(F.desc("risk"), "icao24")


def areas(incidents: DataFrame) -> DataFrame:
    return incidents.where(F.col("icao24").isNull()).orderBy(F.desc("score"), "incident_id")


def top(incidents: DataFrame, limit: int = 200, min_score: float = 0.0, detector: str | None = None) -> DataFrame:
    """The report of the best-scored incidents; the limit, at most 1,000, is its feature."""
    kept = incidents.where(F.col("score") >= min_score)
    if detector:
        kept = kept.where(F.col("detector") == detector)
    return kept.orderBy(F.desc("score"), "incident_id").limit(min(limit, 1_000))


#: How the feed names a detector's incidents; the others are named by their type.
PHRASE = {
    "jamming": "GNSS interference",
    "gap": "Dark aircraft (transponder gap)",
    "incursion": "Low-level watch-box incursion",
    "spoof": "Kinematic impossibility / identity anomaly",
    "anomaly": "Trajectory anomaly",
}


def evidence_feed(incidents: DataFrame) -> DataFrame:
    """Incidents (evidence as JSON) as source-rated evidence items."""
    known = F.create_map(*[F.lit(x) for kv in PHRASE.items() for x in kv])
    phrase = F.coalesce(known[F.col("detector")], F.col("incident_type"))
    zone = lookup(F.col("zone_id"), "name")
    ev = lambda k: F.coalesce(F.get_json_object("evidence", f"$.{k}"), F.lit("?"))

    def tenths(k: str) -> Column:
        """A number as text, also if JSON has it with an exponent."""
        x = F.get_json_object("evidence", f"$.{k}").try_cast("double")
        return F.when(x.isNotNull(), F.format_string("%.1f", x)).otherwise("?")

    # The wording of titles and summaries.
    detail = (
        F.when(F.col("detector") == "jamming", F.concat(F.lit(" — "), ev("aircraft_degraded"), F.lit("/"), ev("aircraft_observed"), F.lit(" aircraft degraded (worst-NIC cluster)")))
        .when(F.col("detector") == "gap", F.concat(F.lit(" — silent "), tenths("gap_minutes"), F.lit(" min at altitude, reappearing "), tenths("displacement_km"), F.lit(" km displaced")))
        .when(F.col("detector") == "incursion", F.concat(F.lit(" — dwelling "), tenths("dwell_minutes"), F.lit(" min below the altitude floor")))
        .when(F.col("detector") == "spoof", F.concat(F.lit(" — implied speed "), tenths("max_implied_speed_kt"), F.lit(" kt (impossible)")))
        .otherwise("")
    )
    plane = F.concat(F.lit("aircraft "), F.col("icao24"))
    caveat = F.when(F.col("detector") == "gap", " A gap may be benign coverage loss.").otherwise("")
    summary = F.concat(
        phrase, F.lit(": "), F.coalesce(plane, F.lit("area-level signal")), F.coalesce(F.concat(F.lit(" in the "), zone), F.lit("")), detail,
        F.lit(". Human-review decision support, not a verdict."), caveat,
    )
    return incidents.select(
        F.col("incident_id").alias("doc_id"), F.concat(phrase, F.lit(" - "), F.coalesce(plane, zone, F.lit("area"))).alias("title"), F.lit("air domain awareness").alias("source"),
        "reliability", credibility(F.col("score")).alias("credibility"), summary.alias("summary"), F.col("start_us").alias("published_us"),
        F.concat(F.lit("/incidents/"), F.col("incident_id")).alias("url"), F.lit("geoint-air").alias("kind"), "detector", "icao24", "lat", "lon", zone.alias("zone"), "affected_count",
        F.coalesce("techniques", F.array().cast("array<string>")).alias("techniques"), "region", "score",
    )


def by_detector(incidents: DataFrame) -> DataFrame:
    """Counts of all six detectors, with zeros."""
    spine = incidents.sparkSession.createDataFrame([(d,) for d in DETECTORS], "detector string")
    counted = incidents.groupBy("detector").agg(F.count(F.lit(1)).alias("n"))
    return spine.join(counted, "detector", "left").select("detector", F.coalesce("n", F.lit(0)).cast("long").alias("incidents"))


def correlate(air: DataFrame, sea: DataFrame, cell_deg: float = 0.5, window_us: int = 3 * 3600 * 1_000_000, bounds: tuple[float, float, float, float] = (0.5, 102.5, 2.0, 104.8)) -> DataFrame:
    """Pairs in the same cell, not further apart in time than the window, both inside the bounds (edges included).

    The cell and the time's bucket are keys of an equi-join: with buckets of one window, partners lie
    in the same or a neighbouring bucket, so a busy cell is dealt by time as well.
    """
    a, b, c, d = bounds

    def placed(e: DataFrame, name: str) -> DataFrame:
        inside = e.where(F.col("lat").between(a, c) & F.col("lon").between(b, d))
        return inside.select(*[F.col(x).alias(f"{name}_{x}") for x in ("doc_id", "lat", "lon", "us")], cell(F.col("lat"), cell_deg).alias("ci"), cell(F.col("lon"), cell_deg).alias("cj"), F.expr(f"us div {window_us}").alias("slot"))

    near = placed(sea, "sea").withColumn("slot", F.explode(F.array(*[F.col("slot") + k for k in (-1, 0, 1)])))
    both = placed(air, "air").join(near, ["ci", "cj", "slot"]).where(F.abs(F.col("air_us") - F.col("sea_us")) <= window_us)
    return both.select(
        "air_doc_id", "sea_doc_id", "ci", "cj", "air_us",
        (F.abs(F.col("air_us") - F.col("sea_us")) / 60e6).alias("delta_minutes"),
        haversine_km(F.col("air_lat"), F.col("air_lon"), F.col("sea_lat"), F.col("sea_lon")).alias("distance_km"),
    ).orderBy(F.desc("air_us"), "delta_minutes", "distance_km", "air_doc_id", "sea_doc_id")


def cell_label(ci: Column, cj: Column, cell_deg: float) -> Column:
    return F.format_string("%.1f-%.1f, %.1f-%.1f", ci * cell_deg, (ci + 1) * cell_deg, cj * cell_deg, (cj + 1) * cell_deg)


def integrity_series(positions: DataFrame) -> DataFrame:
    """Per aircraft and day, in the aircraft's newest region, the aligned series of times and integrity; nulls stay in place. A row holds one day of one aircraft."""
    newest = F.max_by("region", F.struct("us", "id")).over(W.partitionBy("icao24"))
    own = positions.select("icao24", "us", "id", "nic", "nac_p", "region", newest.alias("_region")).where(F.col("region").eqNullSafe(F.col("_region")))
    series = F.array_sort(F.collect_list(F.struct("us", "id", "nic", "nac_p")))
    return own.groupBy("icao24", floor_to(F.col("us"), 24 * HOUR_US).alias("day_us")).agg(series.alias("s")).select(
        "icao24", "day_us", F.transform("s", lambda x: x["us"]).alias("us"), F.transform("s", lambda x: x["nic"]).alias("nic"), F.transform("s", lambda x: x["nac_p"]).alias("nac_p")
    )


def integrity_runs(positions: DataFrame) -> DataFrame:
    """Segments of the series between gaps of unknown integrity: what a sparkline draws."""
    marked = islands(positions.withColumn("known", F.col("nic").isNotNull()), 1 << 62, value="known").where("known")
    return marked.groupBy("icao24", "island").agg(F.count(F.lit(1)).alias("points"), F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.min("nic").alias("min_nic"))


def request_counts(requests: DataFrame, window_seconds: int = 60) -> DataFrame:
    """The rate limiter's count: each client's requests in the window that ends with this one."""
    trailing = W.partitionBy("client").orderBy("us").rangeBetween(-window_seconds * 1_000_000 + 1, 0)
    return requests.withColumn("in_window", F.count(F.lit(1)).over(trailing))
