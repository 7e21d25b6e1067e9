"""The labelled scenario, what an interface reads, regions, streams that come twice, models that are kept."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_engine import T0, none, rows
from trackloom.operators import anomaly, evaluation, gaps, incremental, ingest, jamming, picture, serving, tracks, visits
from trackloom.operators.incidents import flat
from trackloom.plans import reports
from trackloom.settings import Settings
import scenario
from trackloom.sources import ledger, poll, positions, snapshots


@pytest.fixture(scope="module")
def staged(spark):
    return scenario.positions(spark).cache()


def test_scenario_is_deterministic(spark, staged):
    again = {tuple(r) for r in scenario.positions(spark).repartition(3).collect()}
    assert again == {tuple(r) for r in staged.collect()} and len(again) == staged.count()
    assert again != {tuple(r) for r in scenario.positions(spark, seed=8).collect()}
    assert scenario.positions(spark, n_cruise=100).select("icao24").distinct().count() == staged.select("icao24").distinct().count() + 76


def test_scenario_has_its_events_and_look_alikes(spark, staged):
    labels = scenario.labels(spark).collect()
    assert {x.kind for x in labels} == {"jamming", "gap", "incursion", "spoof", "squawk", "anomaly"}
    jam = next(x for x in labels if x.kind == "jamming")
    degraded = staged.where((F.col("nic") <= 4) & (F.col("us") >= jam.start_us) & (F.col("us") < jam.end_us) & ~F.col("icao24").startswith("b"))
    assert degraded.select("icao24").distinct().count() >= 3
    assert staged.where("icao24 = 'b00d1f' and nic <= 4").count() == 1
    low = staged.where("icao24 = 'c00000'").selectExpr("alt_baro_ft", f"(us - {T0}) div 30000000 AS step").collect()
    assert all(r.alt_baro_ft < 10_000 for r in low) and not {r.step for r in low} & set(range(50, 70)) and len(low) == 100
    gap = next(x for x in labels if x.kind == "gap")
    assert staged.where((F.col("icao24") == gap.icao24) & (F.col("us") >= gap.start_us) & (F.col("us") < gap.end_us)).count() == 0
    codes = staged.where("squawk = '7700'").collect()
    assert len(codes) == 4 and {r.icao24 for r in codes} == {"a00000"}


def test_detectors_find_what_is_staged_and_nothing_else(spark, staged):
    runs, outages = ledger.runs(spark).limit(0), ledger.outages(spark).limit(0)
    found = picture.all_incidents(staged, runs, outages).cache()
    scores = evaluation.scores(scenario.labels(spark).select("kind", "icao24"), found).collect()
    assert {r.detector: (r.recall, r.precision) for r in scores} == {k: (1.0, 1.0) for k in ("gap", "incursion", "spoof", "squawk")}
    jam = scenario.labels(spark).where("kind = 'jamming'")
    grid = found.where("detector = 'jamming'")
    assert grid.count() and evaluation.matched_labels(jam, grid).count() == 1 and evaluation.matched_labels(grid.select("lat", "lon", "start_us", "end_us"), jam, "left_anti").count() == 0
    odd = {r.icao24 for r in anomaly.detect(tracks.sequences(staged)).collect()}
    assert odd <= {"ab0001", "ab0002", "f00bad"}


def test_one_pass_equals_the_detectors_on_their_own(spark, staged):
    events = positions.from_events(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    for df, runs, outages in ((events, ledger.runs(spark), ledger.outages(spark)), (staged.select(*events.columns), *none(spark))):
        own = [gaps.detect(df, runs, outages), visits.incursions(df), visits.spoofs(df), visits.squawks(df)]
        want = sorted(tuple(r) for d in own for r in flat(d).collect())
        assert sorted(tuple(r) for r in picture.path_incidents(df, runs, outages).collect()) == want and want


def test_all_incidents_reads_its_input_twice(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(f"{tmp_path}/events.parquet")
    df = positions.read(spark, str(tmp_path))
    plan = picture.all_incidents(df, ledger.runs(spark), ledger.outages(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("events.parquet") <= 2 and "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_open_runs_of_earlier_days(spark):
    """A run that never ended covers later days; of two, the later one; a row before it doesn't see it."""
    day = 86_400_000_000
    at = [(1, T0, "r"), (2, T0 + 3 * day, "r"), (3, T0 + 5 * day, "r"), (4, T0 - day, "r"), (5, T0 + 5 * day, None), (6, T0 + 5 * day, "q")]
    df = spark.createDataFrame(at, "id long, us long, region string")
    run = lambda i, start, end, region: (i, T0 + start, end and T0 + end, None, "x", region, float(i), 100.0, 50.0, 1)
    runs = spark.createDataFrame([run(1, -1000, None, "r"), run(2, 4 * day, None, "r"), run(3, 2 * day, 4 * day, "r"), run(4, 0, None, None)], ledger.RUN_SCHEMA)
    out = {r.id: r.c_source for r in gaps.boundary(df, runs).collect()}
    assert out == {1: "collector-run:1", 2: "collector-run:3", 3: "collector-run:2", 4: "config-fallback", 5: "collector-run:4", 6: "config-fallback"}


def test_a_cycle_of_one_region_leaves_the_other(spark):
    """One aircraft in two regions: ids that both have are two incidents, and a cycle replaces its own alone."""
    quiet = [{"t": 0, "region": r} for r in ("n", "s")] + [{"t": 1800, "lon": 105.0, "region": r} for r in ("n", "s")]
    df = rows(spark, quiet)
    runs, outages = none(spark)
    each = [flat(gaps.detect(df.where(F.col("region") == r), runs, outages)) for r in ("n", "s")]
    stored = each[0].unionByName(each[1]).withColumn("score", F.lit(0.0))
    assert stored.select("incident_id").distinct().count() == 1 and stored.count() == 2
    recent = incremental.recent_incidents(df, runs, outages, T0, region="n")
    out = {r.region: r.score for r in incremental.refreshed_incidents(stored, recent, T0, "n").collect()}
    assert out["s"] == 0.0 and out["n"] > 0
    old = tracks.tracks(df, Settings(track_min_points=1)).withColumn("point_count", F.lit(0).cast("long"))
    both = old.withColumn("region", F.lit("n")).unionByName(old.withColumn("region", F.lit("s")))
    kept = incremental.refreshed_tracks(both, df, None, Settings(track_min_points=1), "n").collect()
    assert {r.point_count for r in kept if r.region == "s"} == {0} and 0 not in {r.point_count for r in kept if r.region == "n"}


def test_two_batches_of_one_track_are_one_track(spark, tmp_path):
    from trackloom.streaming import store

    df = rows(spark, [{"t": 60 * k, "icao24": a} for a in ("a", "b") for k in range(12)])
    kept = store.Store(spark, str(tmp_path))
    kept.cycle(df.where("id % 2 = 0"), 0)
    for _ in range(2):
        kept.cycle(df.where("id % 2 = 1 and icao24 = 'a'"), 1)
    assert {(r.icao24, r.point_count) for r in kept.tracks().collect()} == {("a", 12)}
    assert kept.positions().where("icao24 = 'b'").count() == 6


def test_sessions_of_visits_and_codes(spark):
    """Session windows, here over a batch: two stays in the zone; a code's stay isn't ended by another code."""
    from trackloom.streaming import live

    low = [{"t": 60 * k, "lat": 0.8, "lon": 104.0, "alt": 2000.0} for k in (*range(4), *range(30, 33))]
    found = sorted((r.zone, r.samples) for r in live.session_visits(rows(spark, low)).collect())
    assert found == [("riau-border-watch", 3), ("riau-border-watch", 4)]
    codes = ["7700", "7700", "2000", "7700", None, "7600"]
    held = live.session_squawks(rows(spark, [{"t": 60 * k, "squawk": c} for k, c in enumerate(codes)])).collect()
    assert [(r.squawk, r.samples) for r in held] == [("7700", 3)]


def test_collected_writes_reports_and_ledger_once(spark, tmp_path):
    from trackloom.streaming import live

    df = rows(spark, [{"t": k} for k in range(5)])
    df.write.parquet(f"{tmp_path}/in/a")
    for _ in range(2):
        stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in/*")
        live.collected(stream, f"{tmp_path}/out", f"{tmp_path}/runs", f"{tmp_path}/cp", 3, "r", T0).start().awaitTermination()
    (run,) = ingest.runs_of(spark.read.parquet(f"{tmp_path}/runs")).collect()
    assert (run.id, run.report_count, run.last_message_us) == (3, 5, T0 + 4_000_000)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5 and ingest.table_bytes(spark.read.parquet(f"{tmp_path}/out")) > 0


def test_poll_source(spark, tmp_path):
    snap = {"now": 1_782_864_000_000, "ac": [{"hex": "abc123", "lat": 1.0, "lon": 103.0, "seen_pos": 1}]}
    (tmp_path / "s.json").write_text(json.dumps(snap))
    spark.dataSource.register(poll.Poll)
    url = (tmp_path / "s.json").as_uri()
    got = snapshots.parse_snapshots(snapshots.from_polls(spark.read.format("trackloom_poll").option("url", url).load())).collect()
    assert [(r.icao24, r.us) for r in got] == [("abc123", T0 - 1_000_000)]
    del snap["now"]
    (tmp_path / "s.json").write_text(json.dumps(snap))
    (r,) = spark.read.format("trackloom_poll").option("url", url).load().collect()
    (late,) = snapshots.parse_snapshots(snapshots.from_polls(spark.createDataFrame([r]))).collect()
    assert late.us == r.received_us - 1_000_000
    stream = spark.readStream.format("trackloom_poll").option("url", url).load()
    query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").start()
    query.awaitTermination(8)
    query.stop()
    assert spark.read.parquet(f"{tmp_path}/out").count() >= 1


def test_get_json_tries_three_times(tmp_path):
    waits = []
    with pytest.raises(OSError):
        poll.get_json((tmp_path / "none").as_uri(), wait=waits.append)
    assert waits == [1.0, 2.0]
    (tmp_path / "list").write_text("[1]")
    assert poll.get_json((tmp_path / "list").as_uri()) == {}
    assert poll.point_url("http://x/", 1.35, 103.82, 250) == "http://x/point/1.35/103.82/250"
    assert poll.box_query(1, 2, 3, 4)["lomax"] == 4
    for wrong in ((3, 2, 1, 4), (1, 4, 3, 4), (1, 2, 3, 4, "id")):
        with pytest.raises(ValueError):
            poll.box_query(*wrong)


def test_lists_and_lookups(spark, staged):
    runs, outages = none(spark)
    found = picture.all_incidents(staged, runs, outages)
    top = [r.score for r in picture.top(found, 5).collect()]
    assert top == sorted(top, reverse=True) and len(top) == 5
    (one,) = serving.incident(found, "squawk:a00000:7700:2026-07-01T00:15:00").collect()
    assert one.ts_start == "2026-07-01T00:15:00" and one.ts_end == "2026-07-01T00:16:30" and json.loads(one.evidence)["samples"] == 4
    assert serving.incident(found, "nothing").count() == 0
    t = tracks.tracks(staged)
    starts = [(r.start_us, r.track_id) for r in serving.track_list(t, 7).collect()]
    assert starts == sorted(starts) and len(starts) == 7
    feature = json.loads(serving.track_features(serving.track_list(t, 1), staged).first().feature)
    assert len(feature["geometry"]["coordinates"]) == feature["properties"]["point_count"]
    assert [r.icao24 for r in serving.aircraft_list(ingest.identities(staged), 3).collect()] == ["a00000", "a00001", "a00002"]
    two = rows(spark, [{"t": 0, "region": None}, {"t": 1, "region": "r"}, {"t": 2, "region": None}])
    assert [r.us for r in serving.aircraft_track(two, "a").collect()] == [T0, T0 + 2_000_000]
    assert [r.us for r in serving.aircraft_track(two, "a", "r").collect()] == [T0 + 1_000_000]
    sizes = [r.cell_deg for r in serving.coarse_first(jamming.coverage(staged.where("nic is not null"))).collect()]
    assert sizes == sorted(sizes, reverse=True)
    risks = [r.risk for r in picture.riskiest(picture.aircraft_rollup(found)).collect()]
    assert risks == sorted(risks, reverse=True)
    assert [r[0] for r in spark.sql("select explode(array(double('NaN'), double('-inf'), 1.5D)) x").select(serving.scrubbed(F.col("x"))).collect()] == ["nan", "-inf", "1.5"]


def test_reports(spark, tmp_path):
    text = reports.markdown(spark.createDataFrame([(1, 2.0, "a|b")], "x int, y double, z string"))
    assert text == "| x | y | z |\n| - | - | - |\n| 1 | 2 | a\\|b |"
    path = tmp_path / "r.md"
    path.write_text("head\n<!-- begin one -->\nold\n<!-- end one -->\ntail\n")
    reports.replace_block(path, "one", text)
    reports.replace_block(path, "two", "new")
    assert path.read_text() == f"head\n<!-- begin one -->\n{text}\n<!-- end one -->\ntail\n\n<!-- begin two -->\nnew\n<!-- end two -->\n"
    with pytest.raises(ValueError):
        reports.markdown(spark.range(5), 4)


def test_models_are_kept_and_pinned(spark, staged, tmp_path):
    seq = tracks.sequences(staged).cache()
    info = anomaly.freeze(seq, tmp_path / "m.npz", epochs=3)
    model = anomaly.load(tmp_path / "m.npz", info["sha256"])
    assert model.threshold == pytest.approx(info["threshold"]) and anomaly.load(tmp_path / "none") is None
    with pytest.raises(ValueError):
        anomaly.load(tmp_path / "m.npz", "0" * 64)
    with pytest.raises(ValueError):
        anomaly.freeze(seq.limit(3), tmp_path / "n.npz")
    assert set(anomaly.benchmark(seq, (1, 2), epochs=2)) == {"recurrent", "isolation", "pca"}


def test_resampling_equals_the_plain_one(spark, staged):
    """Native grids and descriptors against numpy's, on tracks with repeated times too."""
    twice = staged.where("icao24 in ('d00001', 'f00bad', 'a00003')").unionByName(staged.where("icao24 = 'a00003' and us % 7 = 0").withColumn("id", F.col("id") + 1))
    per: dict = {}
    for r in tracks.resample(twice).collect():
        per.setdefault(r.track_id, {})[r.k] = (r.lat, r.lon, r.alt_kft)
    whole = {r.track_id: r for r in tracks.sequences(twice).collect()}
    points: dict = {}
    for r in tracks.segments(twice).orderBy("us", "id").collect():
        points.setdefault((r.icao24, r.island), []).append(r)
    assert len(per) == len(whole) == len(points)
    for (a, _), own in points.items():
        name = next(t for t in per if t.startswith(f"{a}:{own[0].ts.isoformat()}"))
        t = np.array([(r.us - own[0].us) / 1e6 for r in own])
        g = tracks.resampled(t, np.array([r.lat for r in own]), np.array([r.lon for r in own]), np.array([(r.alt_baro_ft or 0) / 1000 for r in own]), 64)
        assert sorted(per[name]) == list(range(64))
        assert np.array([per[name][k] for k in range(64)]) == pytest.approx(g[:, 1:], abs=1e-9)
        d, q = tracks.descriptor(g), np.array(whole[name].sequence)
        assert q[:, [0, 1, 2, 4]] == pytest.approx(d[:, [0, 1, 2, 4]], abs=1e-8) and np.abs(q[:, 3]) == pytest.approx(np.abs(d[:, 3]), abs=1e-5)


def test_ranks_in_bands_equal_plain_ones(spark):
    rng = np.random.default_rng(4)
    score = np.round(rng.normal(size=900), 1)
    label = (rng.random(900) < 0.3).astype(int)
    df = spark.createDataFrame([(float(s), int(y)) for s, y in zip(score, label, strict=True)], "score double, label int")
    pos, neg = score[label == 1], score[label == 0]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert evaluation.auc(df, cuts=20).first().auc == pytest.approx(want)
    ranks = {r.score: (r.below, r.n, r.total) for r in evaluation.ranked(df, "score", F.floor("score")).collect()}
    assert ranks == {s: ((score < s).sum(), (score == s).sum(), 900) for s in score}
