"""Streams against their batch forms: out of order, late, restarted and run again after a failure."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from trackloom.operators import incremental, ingest, jamming, tracks, visits
from trackloom.plans import streams
from trackloom.settings import MINUTE_US, Settings
from trackloom.sources import positions
from trackloom.sources.positions import scan
from trackloom.streaming import grid, ordered, store

SF = "/root/testdata/sf0.001"
T0 = positions.EPOCH_US
FIELDS = "id long, icao24 string, ts timestamp_ntz, us long, lat double, lon double, alt_baro_ft double, baro_rate_fpm double, gs_kt double, squawk string, on_ground boolean, nic int, nac_p int, source string, region string"
BASE = {"icao24": "a1", "lat": 1.0, "lon": 103.0, "alt_baro_ft": 30_000.0, "baro_rate_fpm": 0.0, "gs_kt": 450.0, "squawk": None, "on_ground": False, "nic": 8, "nac_p": 9, "source": "s", "region": "r"}


def reports(spark, rows):
    """Reports from dicts: ``t`` seconds since the epoch and what differs from ``BASE``."""
    full = [BASE | {"id": n, "us": T0 + int(r["t"] * 1_000_000)} | {k: v for k, v in r.items() if k != "t"} for n, r in enumerate(rows)]
    names = [c.split()[0] for c in FIELDS.split(", ")]
    df = spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], FIELDS)
    return df.withColumn("ts", F.expr("timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(cast(us AS decimal(28,6)) / 1000000 AS decimal(18,6)))"))


def feed(df, path, *more):
    """Appends reports as one file; with ``more`` frames, one file each."""
    for x in (df, *more):
        x.coalesce(1).write.mode("append").parquet(str(path))


def closing(df):
    """A row that only moves the watermark."""
    last = df.agg(F.max("us")).first()[0] + 1_000 * MINUTE_US
    return df.limit(1).select(*[(F.lit(last) if c == "us" else F.lit(None)).cast(t).alias(c) for c, t in df.dtypes])


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_grid_after_a_restart_and_a_failed_batch(spark, tmp_path):
    """Half of the files, a stop, the rest, and one batch that fails behind its writes: each bucket once, as in a table."""
    p = positions.read(spark, SF)
    landed = streams.landed(p)
    files = sorted(f"{landed}/{x.name}" for x in __import__("pathlib").Path(landed.removeprefix("file:")).glob("part-*"))
    files.sort(key=lambda f: __import__("os").path.getmtime(f.removeprefix("file:")))
    home = tmp_path / "in"
    home.mkdir()
    schema = spark.read.parquet(landed).schema
    move = lambda fs: [__import__("shutil").copy(f.removeprefix("file:"), home) for f in fs]
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 3).parquet(str(home))
    write = lambda: grid.judged_buckets(stream(), f"{tmp_path}/cells", f"{tmp_path}/incidents", f"{tmp_path}/cp", delay=streams.DELAY)
    for key, value in ordered.STORE.items():
        spark.conf.set(key, value)
    move(files[: len(files) // 2])
    streams.run(write())
    before = spark.read.parquet(f"{tmp_path}/cells").count()
    move(files[len(files) // 2 :])
    real, calls = grid.overwritten, []

    def fails(df, path, *partition):
        real(df, path, *partition)
        calls.append(path)
        if len(calls) == 2:
            raise RuntimeError("lost")

    grid.overwritten = fails
    try:
        with pytest.raises(Exception, match="lost"):
            streams.run(write())
    finally:
        grid.overwritten = real
    streams.run(write())
    columns = ["level", "scoreable", "ci", "cj", "bucket", "aircraft", "start_us", "end_us", "region"]
    want = jamming.levels(scan(p)).select(*columns)
    assert rows_of(spark.read.parquet(f"{tmp_path}/cells").select(*columns)) == rows_of(want) and before < want.count()
    ids = ["incident_id", "score", "affected_count", "region"]
    assert rows_of(spark.read.parquet(f"{tmp_path}/incidents").select(*ids)) == rows_of(jamming.detect(scan(p)).select(*ids))


CODES = [(0, "7700"), (60, "7700"), (90, None), (120, "2000"), (180, "7700"), (240, "7700"), (300, "7600"), (360, "7600"), (360 + 901, "7600"), (360 + 1802, "7600"), (5000, "7500")]


def test_stays_are_told_apart_by_code_and_silence(spark, tmp_path):
    """Out of order within the delay, in several batches with a restart; 901 seconds of silence end a stay, 900 don't."""
    rows = reports(spark, [{"t": t, "squawk": c, "lat": 1.0 + n / 100} for n, (t, c) in enumerate(CODES)])
    parts = [rows.where(F.col("id").isin(*ids)) for ids in ([1, 0, 4], [3, 2, 5], [8, 6, 7], [9, 10])]
    feed(parts[0], tmp_path / "in", parts[1])
    stream = lambda: streams.streamed(spark, str(tmp_path / "in"), 1)
    run = lambda: streams.run(streams.appended(ordered.stays(stream(), delay="5 minutes"), f"{tmp_path}/out", f"{tmp_path}/cp"))
    run()
    feed(parts[2], tmp_path / "in", parts[3], closing(rows))
    run()
    columns = ["icao24", "squawk", "samples", "start_us", "end_us", "lat", "lon", "region"]
    found = spark.read.parquet(f"{tmp_path}/out").select(*columns)
    assert rows_of(found) == rows_of(visits.squawk_runs(rows).select(*columns))
    assert sorted((r.squawk, r.samples) for r in found.collect()) == [("7500", 1), ("7600", 1), ("7600", 1), ("7600", 2), ("7700", 2), ("7700", 2)]
    ids = ["incident_id", "score", "start_us", "end_us", "lat", "lon", "severity"]
    assert rows_of(ordered.incidents_of_stays(spark.read.parquet(f"{tmp_path}/out")).select(*ids)) == rows_of(visits.squawks(rows).select(*ids))


def test_outages_open_close_and_stop(spark, tmp_path):
    """The third failure opens, a success or a shutdown closes; silences are pauses, but not behind a shutdown."""
    said = [("a", 0, True, False), ("a", 30, False, False), ("a", 60, False, False), ("a", 90, False, False), ("a", 120, False, False), ("a", 150, True, False)]
    said += [("a", 400, True, False), ("a", 430, False, False), ("a", 460, False, False), ("a", 490, False, False), ("a", 520, None, True), ("a", 2000, True, False)]
    said += [("b", 10, False, False), ("b", 40, False, False), ("b", 70, False, False)]
    beats = spark.createDataFrame([(g, T0 + t * 1_000_000, n, ok, stop) for n, (g, t, ok, stop) in enumerate(said)], "region string, us long, id long, ok boolean, stop boolean")
    parts = [beats.where(F.col("id") % 3 == k) for k in (2, 0, 1)]
    feed(parts[0], tmp_path / "in", parts[1])
    stream = lambda: streams.streamed(spark, str(tmp_path / "in"), 1)
    run = lambda: streams.run(streams.appended(ordered.outages(stream(), delay="60 minutes"), f"{tmp_path}/out", f"{tmp_path}/cp"))
    run()
    feed(parts[2], tmp_path / "in", closing(beats))
    run()
    at = lambda t: None if t is None else T0 + t * 1_000_000
    found = {(r.region, r.opened_us, r.closed_us, r.reason) for r in ordered.ledger(spark.read.parquet(f"{tmp_path}/out")).collect()}
    want = [("a", 90, 150, "failures"), ("a", 150, 400, "pause"), ("a", 490, 520, "failures"), ("a", 2000, None, "pause"), ("b", 70, None, "failures"), ("b", 70, None, "pause")]
    assert found == {(g, at(a), at(b), why) for g, a, b, why in want}


def test_ledger_equals_batch_form(spark, tmp_path):
    from trackloom.plans.queries import beats_of

    beats = beats_of(spark, SF)
    streams.run(streams.appended(ordered.outages(streams.streamed(spark, streams.landed(beats), 5), delay=streams.DELAY), f"{tmp_path}/out", f"{tmp_path}/cp"))
    told = ordered.ledger(spark.read.parquet(f"{tmp_path}/out")).where("reason = 'failures'").drop("reason")
    assert rows_of(told.select("region", "opened_us", "closed_us")) == rows_of(ingest.outages_of_beats(beats).select("region", "opened_us", "closed_us"))


# Cycles over stored positions

FAST = Settings(track_min_points=3)


def flight(icao, start, n, step=60):
    return [{"t": start + k * step, "icao24": icao, "lat": 1 + k / 50} for k in range(n)]


def shown(df):
    return sorted((r.track_id, r.point_count, round(r.distance_km, 6), r.start_us, r.end_us) for r in df.collect())


def test_cycles_give_the_tracks_of_all_reports(spark, tmp_path):
    """Batches that prolong tracks, join two, fill one up from too few points, come late, and are run again."""
    rows = flight("a1", 0, 5) + flight("a2", 0, 2) + flight("a1", 1500, 4) + flight("a2", 600, 1) + flight("a3", 4000, 3)
    rows += [{"t": 900, "icao24": "a1"}, {"t": 150, "icao24": "a3"}, *flight("a1", 200_000, 4), *flight("a2", 90_000, 3)]
    df = reports(spark, rows)
    kept = store.Store(spark, str(tmp_path), buckets=4, settings=FAST)
    for n, ids in enumerate([range(0, 7), range(7, 12), range(12, 16), range(16, 17), range(17, 25)]):
        batch = df.where(F.col("id").isin(*ids))
        kept.cycle(batch, n)
        if n == 3:
            kept.cycle(batch, n)  # as after a failure behind the writes
        so_far = df.where(F.col("id") <= max(ids))
        assert shown(kept.tracks()) == shown(tracks.tracks(so_far, FAST))
    assert kept.positions().count() == df.count()
    assert {(r.id, r.cycle) for r in kept.late().collect()} == {(15, 2), (16, 3)}


def test_a_late_report_shows_in_the_next_cycle_or_when_its_aircraft_reports(spark, tmp_path):
    first, late, other, again = flight("a1", 0, 4) + flight("a2", 0, 30), [{"t": 30, "icao24": "a1"}], flight("a2", 1900, 2), flight("a1", 2400, 1)
    df = reports(spark, first + late + other + again)
    batches = [df.where(F.col("id").between(*x)) for x in ((0, 33), (34, 34), (35, 36), (37, 37))]
    points = {}
    for name, flag in (("ingest", True), ("event", False)):
        kept = store.Store(spark, f"{tmp_path}/{name}", buckets=2, settings=FAST, late_is_dirty=flag)
        points[name] = []
        for n, b in enumerate(batches):
            kept.cycle(b, n)
            points[name].append({r.icao24: r.point_count for r in kept.tracks().where("start_us < {}".format(T0 + 1)).collect()}["a1"])
        assert [r.id for r in kept.late().where("icao24 = 'a1'").collect()] == [34]
    assert points["ingest"] == [4, 5, 5, 5]
    # The reference's rule: the watermark is passed by, so the aircraft isn't dirty until it reports again; then the gap ends what is derived anew.
    assert points["event"][:3] == [4, 4, 4]


def test_a_cycle_reads_only_its_buckets_and_days(spark, tmp_path):
    day = 86_400
    rows = [x for n in range(12) for d in range(4) for x in flight(f"b{n:02d}", d * day, 4)]
    df = reports(spark, rows)
    kept = store.Store(spark, str(tmp_path), buckets=8, settings=FAST)
    kept.cycle(df, 0)
    everything = kept.positions()
    some = kept.positions([3, 5], T0 + 2 * day * 1_000_000)
    plan = some._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") :].split("PushedFilters")[0]
    assert "bucket" in filters and "day" in filters
    files = lambda x: x.select(F.input_file_name()).distinct().count()
    assert 0 < files(some) < files(everything) / 2
    assert {r.bucket for r in some.select("bucket").distinct().collect()} <= {3, 5}
    seen = []
    real = store.Store.positions
    try:
        store.Store.positions = lambda self, b=None, since=None: seen.append((b, since)) or real(self, b, since)
        kept.cycle(reports(spark, flight("b03", 3 * day + 300, 2)).withColumn("id", F.col("id") + 1000), 1)
    finally:
        store.Store.positions = real
    ((buckets, since),) = seen
    assert len(buckets) == 1 and since > T0 + 2 * day * 1_000_000
    whole = df.unionByName(reports(spark, flight("b03", 3 * day + 300, 2)).withColumn("id", F.col("id") + 1000))
    assert shown(kept.tracks()) == shown(tracks.tracks(whole, FAST))


def test_dirty_by_event_time_is_the_batch_rule(spark):
    df = reports(spark, flight("a1", 0, 3) + flight("a2", 100, 3))
    assert {r.icao24 for r in incremental.dirty(df, T0 + 120_000_000).collect()} == {"a2"}


def test_state_is_kept_by_groups_of_aircraft(spark, tmp_path):
    """Sixty aircraft in four groups: as many states as groups, and the stays of the batch form, each aircraft by itself, out of order."""
    rows = reports(spark, [{"t": 60 * t + k, "icao24": f"a{k}", "squawk": ("7700", "7700", "2000", "7600")[(t + k) // 2 % 4]} for t in range(12) for k in range(60)])
    parts = [rows.where(F.col("id") % 3 == k) for k in (2, 0, 1)]
    feed(parts[0], tmp_path / "in", *parts[1:])
    stream = lambda: ordered.stays(streams.streamed(spark, str(tmp_path / "in"), 1), delay="30 minutes", groups=4)
    write = lambda: streams.appended(stream(), f"{tmp_path}/out", f"{tmp_path}/cp")
    query = write().start()
    query.awaitTermination()
    assert 4 <= query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 20
    feed(closing(rows), tmp_path / "in")
    streams.run(write())
    columns = ["icao24", "squawk", "samples", "start_us", "end_us", "lat", "lon", "region"]
    found = spark.read.parquet(f"{tmp_path}/out").select(*columns)
    assert found.count() > 60 and rows_of(found) == rows_of(visits.squawk_runs(rows).select(*columns))


def test_a_batch_is_a_slice_of_the_landed_rows(spark, monkeypatch):
    """Slices of many files come as one batch each: with fewer files a batch, its rest would be late."""
    monkeypatch.setattr(streams, "FILE_ROWS", 40)
    rows = positions.read(spark, SF)
    middle = T0 + 1_800_000_000
    rows = rows.where((F.abs(F.col("us") - middle) > 900_000_000) | (F.col("id") % 97 == 0))  # slices of few rows
    landed = streams.landed(rows)
    each = -(-rows.count() // 240)
    assert each > 2 and len(spark.read.parquet(landed).inputFiles()) == 6 * each + 1 and spark.read.parquet(landed).count() == rows.count() + 1
    seen = []
    write = streams.streamed(spark, landed).writeStream.foreachBatch(lambda b, n: seen.append(b.agg(F.min("us"), F.max("us")).first()))
    streams.run(write.option("checkpointLocation", f"{landed}-cp").trigger(availableNow=True))
    assert len(seen) == 7 and all(a[0] > b[1] - 8 * MINUTE_US for b, a in zip(seen, seen[1:], strict=False))
