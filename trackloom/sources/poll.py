"""Polled JSON snapshots as a Python data source, for batch and streaming.

    spark.dataSource.register(Poll)
    spark.readStream.format("trackloom_poll").option("url", url).load()

Each trigger asks once; a stream with ``trigger(processingTime="30 seconds")`` is the poll loop. What was read can be
landed by any sink and replayed. A ``file:`` address serves tests and replays.
"""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

# Tries, and the shortest and longest wait between them in seconds.
ATTEMPTS, SHORTEST_S, LONGEST_S = 3, 1.0, 10.0


def get_json(url: str, timeout: float = 10.0, wait=time.sleep) -> dict:
    """The JSON object at an address; anything but an object is empty. Tries again with longer waits, then fails."""
    for attempt in range(ATTEMPTS):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as r:
                found = json.loads(r.read())
            return found if isinstance(found, dict) else {}
        except (OSError, ValueError):
            if attempt == ATTEMPTS - 1:
                raise
            wait(min(LONGEST_S, SHORTEST_S * 2**attempt))
    return {}


def point_url(api: str, lat: float, lon: float, radius_nm: float) -> str:
    """The address of all aircraft around a point."""
    return f"{api.rstrip('/')}/point/{lat:g}/{lon:g}/{radius_nm:g}"


def box_query(lamin: float, lomin: float, lamax: float, lomax: float, client_id: str | None = None, client_secret: str | None = None) -> dict[str, float]:
    """The parameters of a bounding box; the box must have an extent, and an id and its secret come together or not at all."""
    if not (lamin < lamax and lomin < lomax):
        raise ValueError("a box needs lamin < lamax and lomin < lomax")
    if bool(client_id) != bool(client_secret):
        raise ValueError("a client id and its secret are given together")
    return {"lamin": lamin, "lomin": lomin, "lamax": lamax, "lomax": lomax}


class _Once(DataSourceReader):
    def __init__(self, url: str) -> None:
        self.url = url

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple[int, str]]:
        yield int(time.time() * 1e6), json.dumps(get_json(self.url))


class _Again(SimpleDataSourceStreamReader):
    def __init__(self, url: str) -> None:
        self.url = url

    def initialOffset(self) -> dict:
        return {"polls": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple[int, str]], dict]:
        return iter([(int(time.time() * 1e6), json.dumps(get_json(self.url)))]), {"polls": start["polls"] + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple[int, str]]:
        # A poll can't be repeated: what was lost before it was landed stays lost, as with any sampled feed.
        return iter([(int(time.time() * 1e6), json.dumps(get_json(self.url)))])


class Poll(DataSource):
    """received_us, value (the snapshot as JSON text)."""

    @classmethod
    def name(cls) -> str:
        return "trackloom_poll"

    def schema(self) -> str:
        return "received_us long, value string"

    def reader(self, schema) -> DataSourceReader:
        return _Once(self.options["url"])

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Again(self.options["url"])
