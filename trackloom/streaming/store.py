"""Stored positions and tracks that a processing cycle keeps current, reading only what it must.

Positions lie in partitions by bucket of aircraft and by day. A cycle collects which buckets its batch touches and from what time
on each of its aircraft changes; it reads these buckets, from the earliest such day on, and nothing else.

What can change. Let u be an aircraft's first new report. Tracks that ended more than a gap before u stay. All others are derived
again, from the start of the earliest of them, or from u if there is none, and from as much before that as a stretch too short to be
a track can last: a gap for each report it may have.

Tracks lie by bucket and cycle. A cycle writes the whole new state of the buckets it touches under its number, then a row in
``marks``; readers take the newest cycle of each bucket that has its mark. A cycle that is run again reads the marks before its own and
writes the same rows over what it left, so it may fail at any place.

Late reports. The watermark is the newest event time of the cycles before. A report that isn't newer is recorded in ``late`` with
its cycle, and its aircraft is derived again like any other. With ``late_is_dirty`` off only newer reports make an aircraft dirty: a late one
shows in its tracks when the aircraft next reports.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import DAY_US
from ..operators.tracks import tracks
from ..settings import DEFAULTS, MINUTE_US, Settings
from ..storage import overwritten

BUCKETS = 64
MARK = "cycle long, newest_us long, late long, buckets array<int>"


@dataclass(frozen=True)
class Store:
    """``root``: a folder that all executors share."""

    spark: SparkSession
    root: str
    buckets: int = BUCKETS
    settings: Settings = DEFAULTS
    late_is_dirty: bool = True

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("icao24"), F.lit(self.buckets)).cast("int")

    def there(self, name: str) -> bool:
        """Has a table any partition yet? A write without rows leaves an empty folder."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return fs.exists(path) and any(x.isDirectory() for x in fs.listStatus(path))

    def positions(self, buckets: list[int] | None = None, since_us: int | None = None) -> DataFrame:
        """Stored reports, of some buckets and from the day of a time on: both prune partitions."""
        df = self.spark.read.parquet(f"{self.root}/positions")
        if buckets is not None:
            df = df.where(F.col("bucket").isin(buckets))
        return df if since_us is None else df.where(F.col("day") >= since_us // DAY_US)

    def marks(self, before: int | None = None) -> DataFrame:
        if not self.there("marks"):
            return self.spark.createDataFrame([], MARK)
        df = self.spark.read.schema(MARK).parquet(f"{self.root}/marks")
        return df if before is None else df.where(F.col("cycle") < before)

    def tracks(self, buckets: list[int] | None = None, before: int | None = None) -> DataFrame | None:
        """All tracks, or those of some buckets, as of the newest cycle (before one, if given); None if there are none yet."""
        each = self.marks(before).select(F.explode("buckets").alias("bucket"), "cycle").groupBy("bucket").agg(F.max("cycle").alias("cycle"))
        # One row a bucket.
        newest = [(r["bucket"], r["cycle"]) for r in each.collect() if buckets is None or r["bucket"] in buckets]
        if not newest or not self.there("tracks"):
            return None
        by: dict[int, list[int]] = {}
        for b, c in newest:
            by.setdefault(c, []).append(b)
        own = reduce(lambda a, b: a | b, [(F.col("cycle") == c) & F.col("bucket").isin(bs) for c, bs in by.items()])
        return self.spark.read.parquet(f"{self.root}/tracks").where(own)

    def late(self) -> DataFrame:
        """Late reports with the cycle they came in; there must be positions."""
        if not self.there("late"):
            return self.positions().drop("bucket", "day").limit(0)
        return self.spark.read.parquet(f"{self.root}/late")

    def land(self, batch: DataFrame, cycle: int) -> None:
        """Stores a batch's reports under its number: again, if it is run again."""
        rows = batch.withColumns({"bucket": self._bucket(), "day": F.expr(f"us div {DAY_US}"), "cycle": F.lit(cycle).cast("long")})
        overwritten(rows.repartition("bucket", "day"), f"{self.root}/positions", "day", "bucket", "cycle")

    def cycle(self, batch: DataFrame, number: int) -> None:
        """A foreachBatch function: lands the batch, records late reports and brings the tracks of its aircraft up to date."""
        gap = self.settings.track_gap_minutes * MINUTE_US
        batch = batch.persist()
        self.land(batch, number)
        seen = self.marks(number).agg(F.max("newest_us")).first()[0]
        behind = F.lit(False) if seen is None else F.col("us") <= seen
        overwritten(batch.where(behind).withColumn("cycle", F.lit(number).cast("long")), f"{self.root}/late", "cycle")
        counts = batch.agg(F.max("us").alias("newest"), F.count_if(behind).alias("late")).first()
        fresh = batch if self.late_is_dirty else batch.where(~behind)
        changed = fresh.groupBy("icao24").agg((F.min("us") - gap).alias("from_us")).withColumn("bucket", self._bucket()).persist()
        # At most as many rows as there are buckets.
        touched = {r["bucket"]: r["from_us"] for r in changed.groupBy("bucket").agg(F.min("from_us").alias("from_us")).collect()}
        buckets = sorted(touched)
        if buckets:
            old = self.tracks(buckets, number)
            since = min(touched.values())
            if old is not None:
                open_ = old.join(F.broadcast(changed.select("icao24", "from_us")), "icao24").where("end_us >= from_us").agg(F.min("start_us")).first()[0]
                since = min(since, open_) if open_ is not None else since
            since -= gap * self.settings.track_min_points
            now = tracks(self.positions(buckets, since).where(F.col("us") >= since).join(changed.select("icao24"), "icao24", "left_semi"), self.settings)
            new = now.join(changed.select("icao24", "from_us"), "icao24").where("end_us >= from_us").drop("from_us").withColumn("bucket", self._bucket())
            if old is not None:
                kept = old.join(changed.select("icao24", "from_us"), "icao24", "left").where("from_us IS NULL OR end_us < from_us").drop("from_us", "cycle")
                new = kept.unionByName(new)
            overwritten(new.withColumn("cycle", F.lit(number).cast("long")).repartition("bucket"), f"{self.root}/tracks", "cycle", "bucket")
        newest = max(x for x in (seen, counts["newest"]) if x is not None) if seen is not None or counts["newest"] is not None else None
        mark = self.spark.createDataFrame([(number, newest, counts["late"], buckets)], MARK)
        overwritten(mark.coalesce(1).withColumn("number", F.lit(number)), f"{self.root}/marks", "number")
        changed.unpersist()
        batch.unpersist()
