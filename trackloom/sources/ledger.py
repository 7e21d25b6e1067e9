"""Collector ledgers: runs and outages. Here as tables of fixed rows beside the adapter's hour."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .positions import EPOCH_US

MIN = 60_000_000
RUN_SCHEMA = "id long, started_us long, last_message_us long, stopped_us long, status string, region string, center_lat double, center_lon double, radius_nm double, report_count long"
OUTAGE_SCHEMA = "id long, opened_us long, closed_us long, reason string, run_id long"
#: minutes after the epoch; None: open or unknown
RUNS = [
    (1, 0, 20, 21, "stopped", "north", 1.35, 103.82, 250.0, 900),
    (2, 19, None, None, "running", "north", 1.0, 103.5, 200.0, 2100),
    (3, 5, 55, 56, "stopped", "south", 1.35, 103.82, 60.0, 1500),
]
OUTAGES = [(1, 2, 8, "api", 1), (2, 45, 52, "pause", 3), (3, 58, None, "api", 2)]
LATE_OUTAGES = [(1, 41, 41.5, "api", 1), (2, 58, None, "api", 2)]


def at(minutes: float | None) -> int | None:
    return None if minutes is None else EPOCH_US + int(minutes * MIN)


def run_rows() -> list[tuple]:
    return [(i, at(a), at(b), at(c), *rest) for i, a, b, c, *rest in RUNS]


def outage_rows(rows: list[tuple] = OUTAGES) -> list[tuple]:
    return [(i, at(a), at(b), *rest) for i, a, b, *rest in rows]


def runs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(run_rows(), RUN_SCHEMA)


def outages(spark: SparkSession, rows: list[tuple] = OUTAGES) -> DataFrame:
    return spark.createDataFrame(outage_rows(rows), OUTAGE_SCHEMA)
