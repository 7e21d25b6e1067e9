"""Stateful processors that see a key's rows in event order, however they arrive within the watermark's delay.

Rows wait in the key's state until the watermark has passed them; then no earlier one can come, and they are taken one by one, by
time and id. State is what waits (at most what a key reports within the delay) and the processor's own, which is a
row of fixed size. A timer brings a key back when the watermark passes its next waiting row, or its own deadline.

A call to the state costs the same for one row as for thousands. So keys are dealt into ``groups`` by their hash, and a group's rows and those of
its processors are read and written at once: calls a batch are as many as groups, not as keys. A group should have some thousand waiting rows; the
number is part of the checkpoint and may not change with it.

The state store must be RocksDB (``STORE``).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.incidents import described
from ..operators.visits import squawk_spec
from ..settings import DEFAULTS, MINUTE_US, Settings
from .watermark import TIME, only, timed

STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
MS = 1_000
SECOND = 1_000_000
GROUPS, GROUP_ROWS = 256, 20_000
GROUP = "key_group"


def groups_for(rows: int, least: int = GROUPS) -> int:
    """Groups for a stream of about so many rows."""
    return max(least, -(-rows // GROUP_ROWS))


def plain(values: pd.Series, kind: str) -> list:
    """What a column becomes in the state: no pandas or numpy values."""
    whole = int if kind == "long" else lambda v: v
    return [None if gone else whole(v) for v, gone in zip(values.tolist(), values.isna().tolist(), strict=True)] if values.hasnans else values.tolist()


class InOrder(StatefulProcessor):
    """``fields``: schema of the rows that wait, ``us`` and ``id`` among them. ``memory``: schema of the processor's own state. ``out``: schema of what it emits."""

    fields: str
    memory: str
    out: str
    key: str

    def step(self, own: dict[str, Any] | None, row: dict[str, Any]) -> tuple[dict[str, Any] | None, list[dict[str, Any]]]:
        """The next row in order: the new state (None: nothing to remember) and what to emit."""
        raise NotImplementedError

    def deadline(self, own: dict[str, Any]) -> int | None:
        """When something is to be done if no row comes (microseconds)."""
        return None

    def expired(self, own: dict[str, Any]) -> tuple[dict[str, Any] | None, list[dict[str, Any]]]:
        """Called when the watermark has reached the deadline, behind all rows up to then."""
        return None, []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kinds = dict(c.split() for c in f"{self.key} string, {self.fields}".split(", "))
        self.names = list(self.kinds)
        self.own_names = [c.split()[0] for c in self.memory.split(", ")]
        # Columns as arrays: Spark sends a list's rows to and fro one by one.
        arrays = lambda columns: ", ".join(f"{c.split()[0]} array<{c.split()[1]}>" for c in f"{self.key} string, {columns}".split(", "))
        self.waiting = handle.getValueState("waiting", arrays(self.fields))
        self.own = handle.getValueState("own", arrays(self.memory))

    def _advance(self, new: list[tuple], watermark_ms: int) -> list[dict[str, Any]]:
        held = list(zip(*(self.waiting.get() or ()), strict=True))
        us, id_ = self.names.index("us"), self.names.index("id")
        upto = watermark_ms * MS
        rows = [*held, *new]
        ready = sorted((r for r in rows if r[us] <= upto), key=lambda r: (r[0], r[us], r[id_] is not None, r[id_] or 0))
        left = [r for r in rows if r[us] > upto]
        before = {r[0]: r[1:] for r in zip(*(self.own.get() or ()), strict=True)}
        owns = {k: dict(zip(self.own_names, v, strict=True)) for k, v in before.items()}
        out: list[dict[str, Any]] = []
        for key, own_rows in groupby(ready, lambda r: r[0]):
            own = owns.pop(key, None)
            for r in own_rows:
                own, more = self.step(own, dict(zip(self.names, r, strict=True)))
                out += [{self.key: key} | x for x in more]
            if own is not None:
                owns[key] = own
        due = [min(r[us] for r in left)] if left else []
        for key, own in list(owns.items()):
            while own is not None and (at := self.deadline(own)) is not None and at <= upto:
                own, more = self.expired(own)
                out += [{self.key: key} | x for x in more]
            if own is None:
                del owns[key]
                continue
            owns[key] = own
            due += [d for d in [self.deadline(own)] if d is not None]
        self._put(self.waiting, held, left)
        self._put(self.own, [(k, *v) for k, v in before.items()], [(k, *(own[n] for n in self.own_names)) for k, own in owns.items()])
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if due:
            self.handle.registerTimer(max(-(-min(due) // MS), watermark_ms + 1))
        return out

    def _put(self, state, before: list[tuple], now: list[tuple]) -> None:
        if now != before:
            if now:
                state.update(tuple(map(list, zip(*now, strict=True))))
            else:
                state.clear()

    def _frame(self, rows: list[dict[str, Any]]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in self.out.split(", ")]).astype({c.split()[0]: "Int64" for c in self.out.split(", ") if c.split()[1] == "long"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [r for f in rows for r in zip(*(plain(f[c], kind) for c, kind in self.kinds.items()), strict=True)]
        yield from self._frame(self._advance(new, timerValues.getCurrentWatermarkInMs()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._frame(self._advance([], timerValues.getCurrentWatermarkInMs()))

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, processor: InOrder, delay: str, groups: int = GROUPS) -> DataFrame:
    """``processor`` on a stream with ``us``, by its key. Rows whose key is null only move the watermark."""
    names = [c.split()[0] for c in processor.fields.split(", ")]
    kept = only(timed(rows, delay), F.col(processor.key).isNotNull()).select(F.pmod(F.xxhash64(processor.key), F.lit(groups)).alias(GROUP), processor.key, *names, TIME)
    return kept.groupBy(GROUP).transformWithStateInPandas(processor, processor.out, "append", "eventTime")


class Stays(InOrder):
    """Runs of one code of an aircraft. Another code ends a run, and so does a silence; only emergency codes are emitted, when they have ended."""

    key = "icao24"
    fields = "us long, id long, squawk string, lat double, lon double, region string"
    memory = "squawk string, samples long, start_us long, end_us long, lat double, lon double, region string"
    out = "icao24 string, squawk string, samples long, start_us long, end_us long, lat double, lon double, region string"

    def __init__(self, s: Settings = DEFAULTS) -> None:
        self.gap_us = s.incursion_gap_minutes * MINUTE_US
        self.codes = s.squawk_codes

    def _ended(self, own: dict[str, Any] | None) -> list[dict[str, Any]]:
        return [own] if own and own["squawk"] in self.codes else []

    def step(self, own, row):
        if row["squawk"] not in self.codes:  # it ends a run, and nothing is to be told of its own
            return None, self._ended(own)
        new = {c: row[c] for c in ("squawk", "lat", "lon", "region")} | {"samples": 1, "start_us": row["us"], "end_us": row["us"]}
        if own and own["squawk"] == row["squawk"] and row["us"] - own["end_us"] <= self.gap_us:
            return new | {"samples": own["samples"] + 1, "start_us": own["start_us"]}, []
        return new, self._ended(own)

    def deadline(self, own):
        return own["end_us"] + self.gap_us

    def expired(self, own):
        return None, self._ended(own)


def stays(reports: DataFrame, s: Settings = DEFAULTS, delay: str = "10 minutes", groups: int = GROUPS) -> DataFrame:
    """Ended stays on an emergency code, of a stream of reports; reports without a code say nothing."""
    return in_order(reports.where(F.col("squawk").isNotNull() | F.col("icao24").isNull()), Stays(s), delay, groups)


def incidents_of_stays(found: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """The incidents of ended stays, as the batch detector names and grades them."""
    at = F.expr("timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(cast(start_us AS decimal(28,6)) / 1000000 AS decimal(18,6)))")
    return described(found.where(F.col("samples") >= s.squawk_min_samples).withColumn("start_ts", at), squawk_spec(s))


class Outages(InOrder):
    """The outage ledger of a region, from its poll outcomes (us, id, ok; ``stop``: the collector was shut down).

    The third failure in a row opens an outage, the next success or a shutdown closes it. A silence longer than the pause threshold is
    an outage from the last poll: open when the threshold has passed, closed by the next poll. A shutdown ends the polls, so that no pause follows it.
    """

    key = "region"
    fields = "us long, id long, ok boolean, stop boolean"
    memory = "failures long, opened_us long, last_us long, paused boolean"
    out = "region string, opened_us long, closed_us long, reason string"

    def __init__(self, s: Settings = DEFAULTS) -> None:
        self.limit_us = max(s.pause_floor_seconds, s.pause_factor * s.poll_seconds) * SECOND
        self.most = s.outage_failures

    def step(self, own, row):
        now = dict(own) if own else {"failures": 0, "opened_us": None, "last_us": None, "paused": False}
        out = []
        told = lambda opened, closed, reason: out.append({"opened_us": opened, "closed_us": closed, "reason": reason})
        if now["last_us"] is not None and row["us"] - now["last_us"] > self.limit_us:
            told(now["last_us"], row["us"], "pause")
        now["last_us"], now["paused"] = row["us"], False
        if row["stop"] or row["ok"]:
            if now["opened_us"] is not None:
                told(now["opened_us"], row["us"], "failures")
            now["failures"], now["opened_us"] = 0, None
            return (None if row["stop"] else now), out
        now["failures"] += 1
        if now["failures"] == self.most:
            now["opened_us"] = row["us"]
            told(row["us"], None, "failures")
        return now, out

    def deadline(self, own):
        return None if own["paused"] else own["last_us"] + self.limit_us + 1

    def expired(self, own):
        return own | {"paused": True}, [{"opened_us": own["last_us"], "closed_us": None, "reason": "pause"}]


def outages(beats: DataFrame, s: Settings = DEFAULTS, delay: str = "10 minutes") -> DataFrame:
    """Changes of the outage ledger, of a stream of poll outcomes (region, us, id, ok, stop): a row when an outage opens, and one when it closes."""
    return in_order(beats.where((F.col("ok").isNotNull() | F.col("stop")) | F.col("region").isNull()), Outages(s), delay)


def ledger(changes: DataFrame) -> DataFrame:
    """The ledger as it stands: one row an outage, open (closed_us null) or closed. A change that is there twice says nothing new."""
    return changes.groupBy("region", "opened_us", "reason").agg(F.max("closed_us").alias("closed_us"))
