"""Per-key sequences: consecutive pairs, islands split by silence or by value, and the row before a time.

All windows of an aircraft partition by icao24 and order by (us, id), so one exchange serves pairs,
islands and what follows them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..settings import DAY_US


def order(*keys: str) -> W:
    return W.partitionBy(*(keys or ("icao24",))).orderBy("us", "id")


def pairs(positions: DataFrame, since_us: int | None = None) -> DataFrame:
    """Each report with its aircraft's previous one as ``p``; with ``since_us``, pairs that end then or later.

    Seeding: only the newest report before ``since_us`` of each aircraft is kept from the past.
    """
    if since_us is not None:
        past = latest_before(positions, since_us)
        now = positions.where(F.col("us") >= since_us)
        positions = now.unionByName(past.join(now.select("icao24").distinct(), "icao24", "left_semi"))
    row = F.struct(*[F.col(c) for c in positions.columns if c != "icao24"])
    out = positions.withColumn("p", F.lag(row).over(order())).where(F.col("p").isNotNull())
    return out if since_us is None else out.where(F.col("us") >= since_us)


def latest_before(positions: DataFrame, us: int) -> DataFrame:
    """The newest report of each aircraft strictly before a time: one partial aggregation, no join."""
    row = F.struct(*[F.col(c) for c in positions.columns])
    best = positions.where(F.col("us") < us).groupBy("icao24").agg(F.max_by(row, F.struct("us", "id")).alias("r"))
    return best.select("r.*")


def islands(rows: DataFrame, gap_us: int, keys: tuple[str, ...] = ("icao24",), value: str | None = None) -> DataFrame:
    """``island``: numbers runs that a silence of more than ``gap_us``, or a change of ``value``, ends."""
    w = order(*keys)
    new: Column = F.col("us") - F.lag("us").over(w) > gap_us
    if value:
        new = new | (F.col(value) != F.lag(value).over(w))
    marked = rows.withColumn("_new", F.coalesce(new, F.lit(False)).cast("int"))
    running = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    return marked.withColumn("island", F.sum("_new").over(running)).drop("_new")


def first_by(column: str | Column, name: str) -> Column:
    return F.min_by(column, F.struct("us", "id")).alias(name)


def last_by(column: str | Column, name: str) -> Column:
    return F.max_by(column, F.struct("us", "id")).alias(name)


def merged_intervals(intervals: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(start_us, end_us) with those that touch or overlap merged, per key.

    Intervals are put in order within the day on which they start. What earlier days reach to, and how many merged ones they have,
    comes from one row a day: so no task holds more than a day of a key, with keys or without.
    """
    dated = intervals.select(*keys, "start_us", "end_us", F.floor(F.col("start_us") / DAY_US).cast("long").alias("_day"))
    days = W.partitionBy(*keys, F.lit(0)).orderBy("_day").rowsBetween(W.unboundedPreceding, -1)
    own = W.partitionBy(*keys, "_day").orderBy("start_us", "end_us")

    def met(rows: DataFrame, per_day: DataFrame) -> DataFrame:
        other = per_day.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_day").alias("_d"), per_day.columns[-1])
        on = F.col("_day") == F.col("_d")
        for i, k in enumerate(keys):
            on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        return rows.join(other, on).drop("_d", *[f"_k{i}" for i in range(len(keys))])

    reach = dated.groupBy(*keys, "_day").agg(F.max("end_us").alias("_end")).withColumn("_reach", F.max("_end").over(days)).drop("_end")
    before = F.greatest("_reach", F.max("end_us").over(own.rowsBetween(W.unboundedPreceding, -1)))
    marked = met(dated, reach).withColumn("_before", before).withColumn("_new", (F.col("_before").isNull() | (F.col("start_us") > F.col("_before"))).cast("int"))
    counts = marked.groupBy(*keys, "_day").agg(F.sum("_new").alias("_n")).withColumn("_offset", F.coalesce(F.sum("_n").over(days), F.lit(0))).drop("_n")
    island = F.col("_offset") + F.sum("_new").over(own.rowsBetween(W.unboundedPreceding, W.currentRow))
    return met(marked, counts).withColumn("_island", island).groupBy(*keys, "_island").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us")).drop("_island")
