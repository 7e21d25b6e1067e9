"""Structured Streaming: snapshots in, deduplicated positions out, and a processing cycle on every batch.

Each batch is one transaction-like step: it is written under its batch id, so a batch that is run
again after a failure replaces its own output and nothing else.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.incremental import recent_incidents, refreshed_incidents, window_start
from ..operators.ingest import KEY, SECOND, bridged, deduplicated, outages_of_beats, pauses, run_rows, runs_of
from ..operators.sequences import islands
from ..settings import DAY_US, DEFAULTS, MINUTE_US, Settings
from ..sources.snapshots import from_polls, parse_snapshots, read_snapshots
from ..storage import kept, overwritten
from ..zones import zones_at
from .store import Store


def positions_stream(spark: SparkSession, path: str, source: str, region: str | None, s: Settings = DEFAULTS) -> DataFrame:
    """Landed snapshot files as a stream of reports, each (aircraft, second, source, region) once within a minute of lateness."""
    rows = parse_snapshots(read_snapshots(spark, path, streaming=True), s)
    timed = rows.withColumns({"ts": F.timestamp_micros("us"), "second": F.expr(f"us div {SECOND}"), "source": F.lit(source), "region": F.lit(region).cast("string")})
    return timed.withWatermark("ts", "1 minute").dropDuplicatesWithinWatermark(KEY)


def appended(stream: DataFrame, out: str, checkpoint: str) -> DataStreamWriter:
    """Each batch overwrites the slice with its number: exactly once for readers, whatever is run again."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def collected(stream: DataFrame, out: str, ledger: str, checkpoint: str, run_id: int, region: str | None, started_us: int) -> DataStreamWriter:
    """``appended``, with a row in the run ledger for each batch, under its number as well."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        for df, path in ((batch, out), (run_rows(batch, run_id, region, started_us), ledger)):
            df.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
        batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def activity_stream(stream: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Reports and aircraft (estimated) per tumbling window and finest cell."""
    keys = [F.window("ts", f"{s.window_minutes} minutes"), F.floor(F.col("lat") / s.cell_deg).alias("ci"), F.floor(F.col("lon") / s.cell_deg).alias("cj")]
    return stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("reports"), F.approx_count_distinct("icao24").alias("aircraft"))


def session_tracks(stream: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Tracks as session windows, emitted once the watermark passes their end."""
    airborne = stream.where(~F.col("on_ground"))
    keys = ["icao24", F.session_window("ts", f"{s.track_gap_minutes} minutes")]
    return airborne.groupBy(*keys).agg(F.count(F.lit(1)).alias("point_count"), F.min("us").alias("start_us"), F.max("us").alias("end_us")).where(F.col("point_count") >= s.track_min_points)


def session_visits(stream: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Low stays in border zones as session windows, emitted once the watermark passes their end."""
    low = stream.where(~F.col("on_ground") & (F.coalesce("alt_baro_ft", F.lit(0.0)) < s.incursion_max_alt_ft))
    inside = low.withColumn("zone", F.explode(zones_at(F.col("lat"), F.col("lon"), "border")))
    keys = ["icao24", "zone", F.session_window("ts", f"{s.incursion_gap_minutes} minutes")]
    return inside.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"), F.min("us").alias("start_us"), F.max("us").alias("end_us")).where(F.col("samples") >= s.incursion_min_samples)


def session_squawks(stream: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Stays on one emergency code as session windows. Unlike the batch form, another code in between doesn't end one."""
    keys = ["icao24", "squawk", F.session_window("ts", f"{s.incursion_gap_minutes} minutes")]
    coded = stream.where(F.col("squawk").isin(*s.squawk_codes))
    return coded.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"), F.min("us").alias("start_us"), F.max("us").alias("end_us")).where(F.col("samples") >= s.squawk_min_samples)


def run_lengths(rows: DataFrame, value: str, s: Settings = DEFAULTS) -> DataFrame:
    """The batch form of value-aware sessions: runs of one value without a long silence."""
    runs = islands(rows, s.track_gap_minutes * MINUTE_US, value=value)
    return runs.groupBy("icao24", "island", value).agg(F.count(F.lit(1)).alias("samples"), F.min("us").alias("start_us"), F.max("us").alias("end_us"))


class Loop:
    """The live loop as one foreachBatch function over polled snapshots (received_us, value; see ``sources.poll``).

    A batch is some polls. Each is a heartbeat, good if it brought a snapshot; its reports are parsed, and those that are stored already
    are left out. Then the store's cycle lands them and brings tracks up to date, the run's row in the ledger is
    written, and the region's incidents are derived again from the refresh window on. All that a batch writes it writes under its number,
    from what earlier numbers wrote, so a batch that is run again after a failure leaves what it would have left.
    """

    def __init__(self, store: Store, region: str, source: str = "poll", run_id: int = 1, started_us: int | None = None, circle: tuple[float, float, float] | None = None) -> None:
        self.store, self.region, self.source, self.run_id, self.started_us, self.circle = store, region, source, run_id, started_us, circle
        self.spark, self.root, self.s = store.spark, store.root, store.settings

    def _read(self, name: str, schema: str, before: int | None = None) -> DataFrame:
        """What has been written under numbers (``batch``), or before one."""
        if not self.store.there(name):
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        return df if before is None else df.where(F.col("batch") < before)

    def beats(self, before: int | None = None) -> DataFrame:
        return self._read("beats", "region string, us long, ok boolean, batch long", before)

    def runs(self) -> DataFrame:
        """The run ledger, with the circle that was polled."""
        rows = runs_of(self._read("runs", "id long, started_us long, last_message_us long, region string, report_count long, batch long"))
        lat, lon, radius = self.circle or (None, None, None)
        none = F.lit(None).cast("long")
        return rows.select("*", none.alias("stopped_us"), F.lit("running").alias("status"), *[F.lit(v).cast("double").alias(n) for n, v in (("center_lat", lat), ("center_lon", lon), ("radius_nm", radius))])

    def outages(self) -> DataFrame:
        """The outage ledger: failures, pauses and what lies between runs."""
        beats = self.beats().select("region", "us", "ok")
        told = [outages_of_beats(beats, self.s), pauses(beats, self.s), bridged(self.runs(), self.s)]
        return told[0].unionByName(told[1]).unionByName(told[2].select("region", "opened_us", "closed_us", "reason"))

    def incidents(self, before: int | None = None, days: list[int] | None = None) -> DataFrame | None:
        """All incidents, or those that start on some days, as of the newest cycle (before one, if given); None if there are none yet."""
        marks = self._read("incident_marks", "days array<long>, batch long", before)
        # One row a day.
        each = marks.select(F.explode("days").alias("day"), "batch").groupBy("day").agg(F.max("batch").alias("batch")).collect()
        newest = [(r["day"], r["batch"]) for r in each if days is None or r["day"] in days]
        if not newest or not self.store.there("incidents"):
            return None
        return self.spark.read.parquet(f"{self.root}/incidents").where(reduce(lambda a, b: a | b, [(F.col("day") == d) & (F.col("batch") == n) for d, n in newest])).drop("day", "batch")

    def __call__(self, polls: DataFrame, number: int) -> None:
        polls = polls.persist()
        parsed = from_polls(polls)
        beat = parsed.select(F.lit(self.region).alias("region"), F.col("received_us").alias("us"), F.col("ac").isNotNull().alias("ok"), F.lit(number).cast("long").alias("batch"))
        overwritten(beat, f"{self.root}/beats", "batch")
        rows = parse_snapshots(parsed, self.s).withColumns({"source": F.lit(self.source), "region": F.lit(self.region), "ts": F.expr(_NTZ)})
        # Ids order reports of one time and aircraft; they come from the report, so that a batch run again gives them again.
        rows = rows.withColumn("id", F.xxhash64("icao24", "us", "lat", "lon", "region", "source"))
        known = None
        if self.store.there("positions"):
            low = rows.agg(F.min("us")).first()[0]
            known = None if low is None else self.store.positions(since_us=low - 60 * SECOND).where(F.col("cycle") < number)
        new = deduplicated(rows, known).persist()
        overwritten(run_rows(new, self.run_id, self.region, self.started_us or 0).withColumn("batch", F.lit(number).cast("long")), f"{self.root}/runs", "batch")
        self.store.cycle(new, number)
        self._refresh(number)
        new.unpersist()
        polls.unpersist()

    def _refresh(self, number: int) -> None:
        """Writes the incidents anew of the days from the refresh window on, and of those on which something older was found again."""
        newest = self.store.marks().where(F.col("cycle") <= number).agg(F.max("newest_us")).first()[0]
        if newest is None:
            return
        since = window_start(newest, self.s)
        p = self.store.positions().where(F.col("cycle") <= number).drop("bucket", "day", "cycle")
        found = kept(recent_incidents(p, self.runs(), self.outages(), since, self.s, self.region))
        day = F.floor(F.col("start_us") / DAY_US).cast("long")
        days = sorted({r[0] for r in found.select(day).distinct().collect()} | set(range(since // DAY_US, newest // DAY_US + 1)))
        old = self.incidents(number, days)
        now = found if old is None else refreshed_incidents(old, found, since, self.region)
        overwritten(now.withColumns({"day": day, "batch": F.lit(number).cast("long")}), f"{self.root}/incidents", "batch", "day")
        overwritten(self.spark.createDataFrame([(days, number)], "days array<long>, batch long").coalesce(1), f"{self.root}/incident_marks", "batch")


_NTZ = "timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(cast(us AS decimal(28,6)) / 1000000 AS decimal(18,6)))"
