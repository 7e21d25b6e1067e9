"""Landed snapshots as a Python data source with filter pushdown: a partition a file, and only the files that can matter.

    spark.dataSource.register(Landed)
    spark.read.format("trackloom_landed").option("path", folder).load().where("region = 'north' AND received_us >= 1782864000000000")

A file is named ``<region>/<microseconds>.json`` after its region and the time when it was received, and holds a JSON object: a
snapshot with ``ac`` (see ``snapshots.parse_snapshots``) or one with ``time`` and ``states`` (positional rows, see
``parse_state_vectors``). Filters on region and received_us are answered by the names; filters on lat and lon by reading no entry outside
their box, when a file is read. ``value`` is the snapshot as JSON text with the entries that are left. Files that hold no JSON object give no row.

Pushdown needs ``spark.sql.python.filterPushdown.enabled``. The folder is reached by its address through Arrow, from the driver to list
it and from the executors to read it.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .snapshots import SNAPSHOT, parse_snapshots, parse_state_vectors

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
SCHEMA = "region string, received_us long, kind string, lat double, lon double, value string"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of an address, and the path in it."""
    return pafs.FileSystem.from_uri(path) if ":" in path else (pafs.LocalFileSystem(), path)


@dataclass
class File(InputPartition):
    path: str
    region: str
    received_us: int

    def __post_init__(self) -> None:
        super().__init__(self.path)


def _named(path: str) -> File | None:
    region, _, name = path.rpartition("/")
    stem = name.removesuffix(".json")
    if stem == name or not stem.isdigit():
        return None
    return File(path, region.rpartition("/")[2], int(stem))


class _Reader(DataSourceReader):
    def __init__(self, folder: str) -> None:
        self.folder = folder
        self.tests: list[Filter] = []
        self.box: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name == "region" and isinstance(f, (EqualTo, In)) or name == "received_us" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                self.tests.append(f)
                continue
            if name in ("lat", "lon") and isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                self.box.append(f)
            yield f  # Spark tests it again

    @staticmethod
    def _meets(f: Filter, value) -> bool:
        if value is None:
            return False
        kind = type(f)
        if kind is In:
            return value in f.value
        return {EqualTo: value == f.value, GreaterThan: value > f.value, GreaterThanOrEqual: value >= f.value, LessThan: value < f.value, LessThanOrEqual: value <= f.value}[kind]

    def partitions(self) -> list[File]:
        fs, path = opened(self.folder)
        found = [_named(i.path) for i in fs.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True)) if i.is_file]
        return [x for x in found if x and all(self._meets(f, getattr(x, f.attribute[0])) for f in self.tests)]

    def read(self, file: File | None) -> Iterator[tuple]:
        if file is None:  # there is no partition
            return
        fs = opened(self.folder)[0]
        with fs.open_input_stream(file.path) as f:
            try:
                whole = json.loads(f.read())
            except ValueError:
                return
        if not isinstance(whole, dict):
            return
        kind, place = ("states", lambda e: (e[6], e[5]) if isinstance(e, list) and len(e) > 6 else (None, None)) if "states" in whole else ("ac", lambda e: (e.get("lat"), e.get("lon")) if isinstance(e, dict) else (None, None))
        entries = whole.pop(kind, None)
        for e in entries if isinstance(entries, list) else []:
            lat, lon = (float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None for v in place(e))
            if all(self._meets(f, lat if f.attribute[0] == "lat" else lon) for f in self.box):
                yield file.region, file.received_us, kind, lat, lon, json.dumps(whole | {kind: [e]})


class Landed(DataSource):
    """region, received_us, kind (ac or states), lat, lon, value: a row an entry."""

    @classmethod
    def name(cls) -> str:
        return "trackloom_landed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def in_box(rows: DataFrame, lamin: float, lomin: float, lamax: float, lomax: float) -> DataFrame:
    """Entries in a box, its edges included; the box must have an extent."""
    if not (lamin < lamax and lomin < lomax):
        raise ValueError("a box needs lamin < lamax and lomin < lomax")
    inside: Column = (F.col("lat") >= lamin) & (F.col("lat") <= lamax) & (F.col("lon") >= lomin) & (F.col("lon") <= lomax)
    return rows.where(inside)


def reports(rows: DataFrame) -> DataFrame:
    """The usable reports of landed entries of kind ``ac``."""
    parsed = rows.where("kind = 'ac'").select("received_us", F.from_json("value", SNAPSHOT).alias("s"))
    return parse_snapshots(parsed.select("received_us", "s.*"))


def state_reports(rows: DataFrame) -> DataFrame:
    """The usable reports of landed entries of kind ``states``; the time is the snapshot's own, or when it was received."""
    s = rows.where("kind = 'states'").select("received_us", F.from_json("value", "time double, states array<array<string>>").alias("s"))
    each = s.select(F.coalesce("s.time", F.col("received_us") / 1e6).alias("snapshot_s"), F.explode("s.states").alias("v"))
    return parse_state_vectors(each)
