"""The fall-through grid on a stream: buckets that the watermark has made final, judged level by level.

A row of state is a finest cell, bucket and aircraft. When the watermark passes a bucket's end, all its rows leave the state in one
batch, so that batch has whole buckets: the levels, the map and the incidents are computed from them as from a table. Each batch writes under its
number, so a batch that is run again replaces what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import jamming
from ..operators.incidents import flat
from ..settings import DEFAULTS, MINUTE_US, Settings
from ..storage import overwritten
from .watermark import TIME, only, timed


def finest(reports: DataFrame, s: Settings = DEFAULTS, delay: str = "10 minutes") -> DataFrame:
    """``jamming.worst`` of a stream, each row once, when its bucket is final. Reports without an aircraft only move the watermark."""
    known = F.col("nic").isNotNull() & ~F.col("on_ground") & F.col("icao24").isNotNull()
    keyed = jamming.keyed(only(timed(reports, delay), known), s, TIME)
    window = F.window(TIME, f"{s.window_minutes} minutes")
    return keyed.drop("bucket").groupBy(window, "fi", "fj", "icao24").agg(*jamming.worst_of()).select(
        "fi", "fj", F.expr(f"unix_micros(window.start) div {s.window_minutes * MINUTE_US}").alias("bucket"), "icao24", "at", "nac_p", "start_us", "end_us", "named"
    )


def judged_buckets(reports: DataFrame, cells: str, incidents: str, checkpoint: str, s: Settings = DEFAULTS, region: str | None = None, delay: str = "10 minutes") -> DataStreamWriter:
    """Writes the judged cells of final buckets to ``cells`` and their incidents to ``incidents``, by batch."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        found = jamming.levels_of(batch, s)
        overwritten(found.withColumn("batch", F.lit(number)), cells, "batch")
        overwritten(flat(jamming.detected(found, s, region)).withColumn("batch", F.lit(number)), incidents, "batch")
        batch.unpersist()

    return finest(reports, s, delay).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)
