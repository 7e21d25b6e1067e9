"""The live loop from polled snapshots to tracks, ledgers and incidents, against what all reports give at once."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from trackloom.operators import incremental, tracks
from trackloom.settings import Settings
from trackloom.sources import positions
from trackloom.streaming import live, store

T0 = positions.EPOCH_US
S = Settings(track_min_points=3, poll_seconds=30)


def entry(icao, lat, lon, seen=1.0, **more):
    return {"hex": icao, "lat": lat, "lon": lon, "seen_pos": seen, "alt_baro": 30000, "gs": 450, "nic": 8, "nac_p": 9} | more


def polls():
    """A poll each half minute: three aircraft, one of which sends an emergency code and one jumps; then three failures, a pause, and more."""
    out = []
    for k in range(24):
        ac = [entry("a1", 1.0 + k / 100, 103.0), entry("a2", 1.5, 103.0 + k / 50, squawk="7700" if 5 <= k < 9 else "2000"), entry("a3", 3.0 if k % 2 and k > 14 else 1.0, 104.0)]
        if k == 3:
            ac.append(entry("a1", 1.02, 103.0, seen=31.0))  # what the poll before had
        text = json.dumps({"now": (T0 // 1000) + 30_000 * k, "ac": ac})
        out.append((T0 + 30_000_000 * k + (600_000_000 if k > 18 else 0), text if k not in (10, 11, 12) else "[]"))
    return out


def run(spark, root, cuts, again=()):
    df = spark.createDataFrame(polls(), "received_us long, value string")
    loop = live.Loop(store.Store(spark, str(root), buckets=4, settings=S), "r", started_us=T0, circle=(1.35, 103.82, 250.0))
    for n, (a, b) in enumerate(cuts):
        batch = df.where((F.col("received_us") >= polls()[a][0]) & (F.col("received_us") <= polls()[b - 1][0]))
        for _ in range(2 if n in again else 1):
            loop(batch, n)
    return loop


def test_loop_ends_where_all_reports_would(spark, tmp_path):
    loop = run(spark, tmp_path, [(0, 7), (7, 14), (14, 24)], again=(1,))
    p = loop.store.positions().drop("bucket", "day", "cycle")
    # Each report once: the repeated one and the second run of a batch add nothing.
    assert p.count() == 21 * 3 and p.groupBy("icao24", "us").count().where("count > 1").isEmpty()
    shown = lambda df: sorted((r.track_id, r.point_count, round(r.distance_km, 6), r.start_us, r.end_us) for r in df.collect())
    assert shown(loop.store.tracks()) == shown(tracks.tracks(p, S))
    (r,) = loop.runs().collect()
    assert (r.id, r.region, r.started_us, r.report_count, r.last_message_us, r.center_lat) == (1, "r", T0, 63, p.agg(F.max("us")).first()[0], 1.35)
    told = {(x.reason, x.opened_us - T0, x.closed_us - T0) for x in loop.outages().collect()}
    assert told == {("failures", 360_000_000, 390_000_000), ("pause", 540_000_000, 1_170_000_000)}
    since = incremental.window_start(r.last_message_us, S)
    want = incremental.recent_incidents(p, loop.runs(), loop.outages(), since, S, "r")
    ids = lambda df: sorted((x.incident_id, x.detector, round(x.score, 6), x.start_us, x.end_us) for x in df.collect())
    assert ids(loop.incidents()) == ids(want) and {x[1] for x in ids(want)} >= {"spoof", "squawk"}


def test_loop_without_reports(spark, tmp_path):
    loop = live.Loop(store.Store(spark, str(tmp_path), settings=S), "r")
    loop(spark.createDataFrame([(T0 + k, "no json") for k in range(4)], "received_us long, value string"), 0)
    assert loop.beats().where("ok").isEmpty() and loop.beats().count() == 4 and loop.incidents() is None
    assert [(x.opened_us, x.closed_us) for x in loop.outages().collect()] == [(T0 + 2, None)]


@pytest.fixture(autouse=True)
def utc(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
