"""Idempotent append, identities, retention and the outage ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..settings import DAY_US, DEFAULTS, Settings

SECOND = 1_000_000
#: What makes two reports the same: aircraft, second, source and region.
KEY = ["icao24", "second", "source", "region"]


def keyed(reports: DataFrame) -> DataFrame:
    return reports.withColumn("second", F.expr(f"us div {SECOND}"))


def deduplicated(batch: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """The first report of each key (by id), of those that aren't stored yet.

    The stored side is cut to the batch's time range, a minute more on each side, before the join.
    """
    rows = keyed(batch)
    row = F.struct(*batch.columns)
    first = rows.groupBy(*KEY).agg(F.min_by(row, "id").alias("r")).select("r.*")
    if stored is None:
        return first
    span = batch.agg((F.min("us") - 60 * SECOND).alias("lo"), (F.max("us") + 60 * SECOND).alias("hi")).first()
    if span["lo"] is None:
        return first
    near = keyed(stored.where(F.col("us").between(span["lo"], span["hi"]))).alias("s")
    new = keyed(first).alias("n")
    same = [F.col(f"n.{c}").eqNullSafe(F.col(f"s.{c}")) for c in KEY]
    return new.join(near, same, "left_anti").drop("second")


def identities(reports: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Per aircraft the last non-null callsign, registration, type_code and category, and first and last time.

    Give it reports that were kept: a duplicate doesn't refresh an identity.
    """
    fields = ["callsign", "registration", "type_code", "category"]
    latest = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("id"))).alias(c) for c in fields]
    new = reports.groupBy("icao24").agg(*latest, F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    if stored is None:
        return new
    both = new.alias("n").join(stored.alias("s"), "icao24", "full")
    return both.select("icao24", *[F.coalesce(f"n.{c}", f"s.{c}").alias(c) for c in fields], F.least("n.first_us", "s.first_us").alias("first_us"), F.greatest("n.last_us", "s.last_us").alias("last_us"))


def retained(positions: DataFrame, now_us: int, days: float, floor_us: int | None = None) -> DataFrame:
    """Positions not older than ``days``, nor than ``floor_us`` if that is earlier."""
    cut = now_us - int(days * 86_400 * SECOND)
    return positions.where(F.col("us") >= (cut if floor_us is None else min(cut, floor_us)))


def outages_of_beats(beats: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Outages from poll outcomes (region, us, ok): the third failure in a row opens one, the next success closes it.

    Successes number the runs of failures. They are added up per region and day, then over the days, so that
    no task holds more than a day of a region, or one run.
    """
    dated = beats.select("region", "us", "ok", F.floor(F.col("us") / DAY_US).alias("day"))
    sums = dated.groupBy("region", "day").agg(F.sum(F.col("ok").cast("int")).alias("oks"))
    before = F.coalesce(F.sum("oks").over(W.partitionBy("region").orderBy("day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    own = F.sum(F.col("ok").cast("int")).over(W.partitionBy("region", "day").orderBy("us"))
    run = dated.join(sums.select("region", "day", before.alias("before")), ["region", "day"]).withColumn("run", F.col("before") + own)
    failed = run.where(~F.col("ok")).withColumn("nth", F.row_number().over(W.partitionBy("region", "run").orderBy("us")))
    opened = failed.where(F.col("nth") == s.outage_failures).select("region", "run", F.col("us").alias("opened_us"))
    closed = run.where(F.col("ok")).groupBy("region", (F.col("run") - 1).alias("run")).agg(F.min("us").alias("closed_us"))
    return opened.join(closed, ["region", "run"], "left").select("region", "opened_us", "closed_us", F.lit("failures").alias("reason"))


def pauses(beats: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Closed outages where polls are further apart than the pause threshold."""
    limit = max(s.pause_floor_seconds, s.pause_factor * s.poll_seconds) * SECOND
    before = F.lag("us").over(W.partitionBy("region").orderBy("us"))
    return beats.withColumn("opened_us", before).where(F.col("us") - F.col("opened_us") > limit).select("region", "opened_us", F.col("us").alias("closed_us"), F.lit("pause").alias("reason"))


def bridged(runs: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Between-run outages: from the region's previous run's last message to a run's start, if longer than a pause."""
    limit = max(s.pause_floor_seconds, s.pause_factor * s.poll_seconds) * SECOND
    before = F.lag(F.coalesce("last_message_us", "stopped_us", "started_us")).over(W.partitionBy("region").orderBy("id"))
    return runs.withColumn("opened_us", before).where(F.col("started_us") - F.col("opened_us") > limit).select(
        F.col("id").alias("run_id"), "region", "opened_us", F.col("started_us").alias("closed_us"), F.lit("between runs").alias("reason")
    )


def health(positions: DataFrame, outages: DataFrame) -> DataFrame:
    """One row: positions, aircraft, span, rate an hour, outages in all and open."""
    p = positions.select("icao24", "us", F.lit(0).alias("o"), F.lit(0).alias("open"))
    o = outages.select(F.lit(None).cast("string").alias("icao24"), F.lit(None).cast("long").alias("us"), F.lit(1).alias("o"), F.col("closed_us").isNull().cast("int").alias("open"))
    out = p.unionByName(o).agg(
        F.count("us").alias("positions"), F.count_distinct("icao24").alias("aircraft"), F.min("us").alias("first_us"), F.max("us").alias("last_us"),
        F.sum("o").cast("long").alias("outages"), F.sum("open").cast("long").alias("open_outages"),
    )
    hours = (F.col("last_us") - F.col("first_us")) / 3.6e9
    return out.withColumn("reports_per_hour", F.when(hours > 0, F.col("positions") / hours))


def run_rows(batch: DataFrame, run_id: int, region: str | None, started_us: int) -> DataFrame:
    """A ledger row for what a run has collected so far: one row a batch, the newest of a run counts."""
    return batch.agg(F.max("us").alias("last_message_us"), F.count(F.lit(1)).alias("report_count")).select(
        F.lit(run_id).cast("long").alias("id"), F.lit(started_us).cast("long").alias("started_us"), "last_message_us", F.lit(region).cast("string").alias("region"), "report_count"
    )


def runs_of(ledger: DataFrame) -> DataFrame:
    """One row a run: its last message and all its reports."""
    return ledger.groupBy("id", "started_us", "region").agg(F.max("last_message_us").alias("last_message_us"), F.sum("report_count").alias("report_count"))


def table_bytes(df: DataFrame) -> int:
    """Bytes of the files a table is read from."""
    spark = df.sparkSession
    conf = spark._jsc.hadoopConfiguration()
    paths = [spark._jvm.org.apache.hadoop.fs.Path(f) for f in df.inputFiles()]
    return sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)
