"""Integrity loss on a space-time grid of several resolutions.

Reports are first reduced to one row per finest cell, time bucket and aircraft: every coarser level
is an aggregate of these, as cells of twice the size are unions of four. A cell with enough
aircraft is judged and leaves the pool; what is left is tried at twice the size. Finest cells are judged in one
aggregation, so no task puts a busy cell's aircraft in order; what they leave, a few aircraft a cell, has all further
levels under one partitioning by the coarsest cell and the bucket.
"""

from __future__ import annotations

from functools import cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import cell
from ..functions.grading import reliability
from ..settings import DEFAULTS, MINUTE_US, Settings
from .incidents import Spec, described


def worst_of() -> list[Column]:
    """What is kept of an aircraft's reports in a finest cell and bucket."""
    return [F.min("at").alias("at"), F.min("nac_p").alias("nac_p"), F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.min("named").alias("named")]


def keyed(reports: DataFrame, s: Settings = DEFAULTS, *more: str) -> DataFrame:
    """Reports with their finest cell (fi, fj) and bucket, and what ``worst_of`` aggregates."""
    return reports.select(
        cell(F.col("lat"), s.cell_deg).alias("fi"),
        cell(F.col("lon"), s.cell_deg).alias("fj"),
        F.expr(f"us div {s.window_minutes * MINUTE_US}").alias("bucket"),
        "icao24",
        F.struct("nic", "id", F.col("alt_baro_ft").alias("alt")).alias("at"),
        "nac_p",
        "us",
        F.when(F.col("region").isNotNull(), F.struct("id", "region")).alias("named"),
        *more,
    )


def worst(reports: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Per finest cell (fi, fj), bucket and aircraft: nic (the worst), alt (at the first report with it), nac_p, times, region."""
    return keyed(reports, s).groupBy("fi", "fj", "bucket", "icao24").agg(*worst_of())


def levels(reports: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Judged cells of all levels and the finest cells that none could judge.

    level, ci, cj, bucket, cell_deg, scoreable, aircraft (array of struct: icao24, nic, alt, nac_p), start_us, end_us, region
    """
    return levels_of(worst(reports, s), s)


def levels_of(rows: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """``levels`` of what ``worst`` gives, of whole buckets."""
    top = s.coarsen_levels
    member = F.struct("icao24", "at", "nac_p", "start_us", "end_us", "named")
    cells = rows.groupBy("fi", "fj", "bucket").agg(F.collect_list(member).alias("each"))
    enough = F.size("each") >= s.min_aircraft
    of = lambda x: F.struct(x["icao24"].alias("icao24"), x["at"]["nic"].alias("nic"), x["at"]["alt"].alias("alt"), x["nac_p"].alias("nac_p"))
    all_ = lambda c: F.transform("each", lambda x: x[c])
    finest = cells.where(enough).select(
        F.lit(0).alias("level"), F.lit(True).alias("scoreable"), F.col("fi").alias("ci"), F.col("fj").alias("cj"), "bucket", F.array_sort(F.transform("each", of)).alias("aircraft"),
        F.array_min(all_("start_us")).alias("start_us"), F.array_max(all_("end_us")).alias("end_us"), F.array_min(all_("named"))["region"].alias("region"),
    )
    out = finest.unionByName(_coarser(cells.where(~enough).select("fi", "fj", "bucket", F.inline("each")), s))
    return out.select("level", "ci", "cj", "bucket", (s.cell_deg * F.pow(F.lit(2.0), F.col("level"))).alias("cell_deg"), "scoreable", "aircraft", "start_us", "end_us", "region")


def _coarser(rows: DataFrame, s: Settings) -> DataFrame:
    """The levels above the finest, of the rows in cells that have too few: so few that those of a coarsest cell are put in order in one task."""
    top = s.coarsen_levels
    keys = {lv: [F.floor(F.col(c) / 2**lv).cast("long") for c in ("fi", "fj")] for lv in range(top + 1)}
    left = rows.withColumns({"_ti": keys[top][0], "_tj": keys[top][1], "_i0": keys[0][0], "_j0": keys[0][1]}).withColumn("_level", F.lit(None).cast("int"))
    left = left.repartition("_ti", "_tj", "bucket")
    for lv in range(1, top + 1):
        names = [f"_i{lv}", f"_j{lv}"]
        left = left.withColumns(dict(zip(names, keys[lv], strict=True)) | {"_pool": F.col("_level").isNull()})
        here = W.partitionBy("_ti", "_tj", "bucket", *names, "_pool")
        # Distinct aircraft: the highest of their ranks.
        left = left.withColumn("_rank", F.dense_rank().over(here.orderBy("icao24")))
        left = left.withColumn("_level", F.coalesce("_level", F.when(F.max("_rank").over(here) >= s.min_aircraft, F.lit(lv))))
    level = F.coalesce("_level", F.lit(0))
    at = lambda c: reduce(lambda a, lv: a.when(level == lv, F.col(f"_{c}{lv}")), range(1, top + 1), F.when(level == 0, F.col(f"_{c}0")))
    placed = left.select(
        "_ti", "_tj", "bucket", level.alias("level"), F.col("_level").isNotNull().alias("scoreable"), at("i").alias("ci"), at("j").alias("cj"),
        "icao24", "at", "nac_p", "start_us", "end_us", "named",
    )
    where = ["_ti", "_tj", "bucket", "level", "scoreable", "ci", "cj"]
    each = placed.groupBy(*where, "icao24").agg(
        F.min("at").alias("at"), F.min("nac_p").alias("nac_p"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.min("named").alias("named")
    )
    one = F.struct("icao24", F.col("at.nic").alias("nic"), F.col("at.alt").alias("alt"), "nac_p")
    return each.groupBy(*where).agg(
        F.array_sort(F.collect_list(one)).alias("aircraft"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.min("named")["region"].alias("region")
    ).drop("_ti", "_tj")


@cache
def _counts(s: Settings) -> tuple[dict[str, Column], dict[str, Column]]:
    bad = F.filter("aircraft", lambda a: a["nic"] <= s.bad_nic_max)
    hard = F.filter(bad, lambda a: (a["nic"] <= s.hard_loss_nic) & (F.coalesce(a["nac_p"], F.lit(s.hard_loss_nac_p)) <= s.hard_loss_nac_p))
    lists = {"degraded": bad, "hard": hard, "observed": F.size("aircraft").cast("long")}
    return lists, {
        "n_degraded": F.size("degraded").cast("long"),
        "n_hard": F.size("hard").cast("long"),
        "lat": (F.col("ci") + 0.5) * F.col("cell_deg"),
        "lon": (F.col("cj") + 0.5) * F.col("cell_deg"),
        "fraction": F.size("degraded") / F.size("aircraft"),
        "hard_fraction": F.size("hard") / F.size("aircraft"),
    }


def judged(cells: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Cells with counts: observed, degraded and hard_loss (arrays of aircraft), and fractions."""
    lists, numbers = _counts(s)
    return cells.withColumns(lists).withColumns(numbers)


def coverage(reports: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """The map behind the incidents: degraded_fraction is null exactly where a cell can't be judged."""
    return judged(levels(reports, s), s).select(
        "lat", "lon", "cell_deg", "level", F.col("observed").alias("aircraft_observed"), "scoreable",
        F.when(F.col("scoreable"), F.col("fraction")).alias("degraded_fraction"), F.col("n_hard").alias("hard_loss"), "start_us", "end_us",
    )


def detect(reports: DataFrame, s: Settings = DEFAULTS, region: str | None = None) -> DataFrame:
    return detected(levels(reports, s), s, region)


@cache
def jamming_spec(s: Settings, region: str | None) -> Spec:
    evidence = [
        F.col("observed").alias("aircraft_observed"),
        F.col("n_degraded").alias("aircraft_degraded"),
        F.bround("fraction", 3).alias("degraded_fraction"),
        F.col("n_hard").alias("aircraft_hard_loss"),
        F.bround("hard_fraction", 3).alias("hard_loss_fraction"),
        F.transform("hard", lambda a: a["icao24"]).alias("hard_loss_aircraft"),
        F.map_from_entries(F.transform("degraded", lambda a: F.struct(a["icao24"], a["nic"]))).alias("worst_nic_by_aircraft"),
        F.lit(s.bad_nic_max).alias("bad_nic_max"),
        F.col("cell_deg"),
        F.col("level").alias("resolution_level"),
        F.lit(s.window_minutes).alias("window_minutes"),
        F.size(F.filter("alts", lambda x: x < s.terminal_alt_ft)).cast("long").alias("degraded_in_terminal_phase"),
        F.size("alts").cast("long").alias("degraded_altitude_known"),
        F.lit(s.terminal_alt_ft).alias("terminal_alt_ft"),
        F.get("alts", F.lit(0)).alias("degraded_alt_ft_min"),
        F.get("alts", F.floor(F.size("alts") / 2).cast("int")).alias("degraded_alt_ft_median"),
        F.get("alts", F.size("alts") - 1).alias("degraded_alt_ft_max"),
    ]
    columns = dict(
        incident_id=F.concat(F.lit("jam:L"), F.concat_ws(":", "level", "ci", "cj", "bucket")),
        score=0.5 + 0.4 * F.col("fraction") + 0.1 * F.col("hard_fraction"),
        reliability=reliability(F.col("observed")),
        start_us=F.col("start_us"), end_us=F.col("end_us"), lat=F.col("lat"), lon=F.col("lon"),
        affected_count=F.col("n_degraded"), region=F.coalesce("region", F.lit(region)),
    )
    return Spec("jamming", "AT-GNSS-JAM", "GNSS interference", evidence, columns)


def detected(cells: DataFrame, s: Settings = DEFAULTS, region: str | None = None) -> DataFrame:
    """The incidents of the cells that ``levels`` gives."""
    fired = judged(cells.where("scoreable"), s).where(F.col("fraction") >= s.bad_fraction)
    alts = F.array_sort(F.transform(F.filter("degraded", lambda a: a["alt"].isNotNull()), lambda a: F.bround(a["alt"], -2)))
    return described(fired.withColumn("alts", alts), jamming_spec(s, region))


def stats(reports: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """One row: cells_seen (finest cells with reports), cells_unscoreable, incidents."""
    cells = judged(levels(reports, s), s)
    no, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    seen = worst(reports, s).select("fi", "fj", "bucket").distinct().select(one.alias("cells_seen"), no.alias("cells_unscoreable"), no.alias("incidents"))
    told = cells.select(
        no.alias("cells_seen"),
        (~F.col("scoreable")).cast("long").alias("cells_unscoreable"),
        (F.col("scoreable") & (F.col("fraction") >= s.bad_fraction)).cast("long").alias("incidents"),
    )
    return seen.unionByName(told).agg(*[F.coalesce(F.sum(c), no).alias(c) for c in seen.columns])


def coverage_map(cells: DataFrame) -> DataFrame:
    """Cells of all times, merged by place: windows that couldn't be judged never count as clear."""
    return cells.groupBy("lat", "lon", "cell_deg").agg(
        F.count(F.lit(1)).alias("windows"),
        F.max("aircraft_observed").alias("aircraft_observed"),
        F.max("hard_loss").alias("hard_loss"),
        F.bool_or("scoreable").alias("scoreable"),
        F.max(F.when(F.col("scoreable"), F.col("degraded_fraction"))).alias("degraded_fraction"),
    )
