"""Behaviours on hand-made rows."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.functions import geo, grading
from trackloom.operators import anomaly, evaluation, gaps, incremental, ingest, jamming, picture, sequences, tracks, visits
from trackloom.settings import Settings
from trackloom.sources import ledger, positions, snapshots
from trackloom.zones import frame, geojson, zone_for, zones_at

T0 = positions.EPOCH_US
SCHEMA = "id long, icao24 string, us long, lat double, lon double, alt_baro_ft double, baro_rate_fpm double, gs_kt double, squawk string, on_ground boolean, nic int, nac_p int, source string, region string"


def rows(spark, items):
    """Dicts with seconds ``t`` and what differs from a level cruise."""
    out = []
    for i, x in enumerate(items):
        base = {"icao24": "a", "lat": 1.2, "lon": 103.7, "alt": 35000.0, "rate": 0.0, "gs": 450.0, "squawk": None, "ground": False, "nic": 8, "nac": 9, "region": "r"} | x
        out.append((i, base["icao24"], T0 + int(base["t"] * 1e6), base["lat"], base["lon"], base["alt"], base["rate"], base["gs"], base["squawk"], base["ground"], base["nic"], base["nac"], "s", base["region"]))
    df = spark.createDataFrame(out, SCHEMA)
    return df.withColumn("ts", F.timestamp_micros("us").cast("timestamp_ntz"))


def cell_of(spark, values, alt=35000.0, t=0):
    return rows(spark, [{"icao24": f"p{k}", "t": t + 60 * j, "nic": n, "nac": c, "alt": alt} for k, (n, c) in enumerate(values) for j in range(3)])


def test_hard_loss_tier(spark):
    df = cell_of(spark, [(0, 0)] * 3 + [(4, 9), (5, 10), (8, 10)])
    (r,) = jamming.detect(df).collect()
    assert (r.evidence.aircraft_observed, r.evidence.aircraft_degraded, r.evidence.aircraft_hard_loss) == (6, 5, 3)
    assert r.score == pytest.approx(0.5 + 0.4 * 5 / 6 + 0.1 * 0.5) and r.reliability == "C" and r.evidence.hard_loss_aircraft == ["p0", "p1", "p2"]
    assert r.evidence.worst_nic_by_aircraft == {"p0": 0, "p1": 0, "p2": 0, "p3": 4, "p4": 5}


def test_unknown_second_channel_agrees_with_hard_loss(spark):
    (r,) = jamming.detect(cell_of(spark, [(0, None)] * 4)).collect()
    assert r.evidence.aircraft_hard_loss == 4


def test_exactly_half_fires_and_less_does_not(spark):
    assert jamming.detect(cell_of(spark, [(0, 0)] * 2 + [(8, 9)] * 2)).count() == 1
    assert jamming.detect(cell_of(spark, [(0, 0)] * 2 + [(8, 9)] * 3)).count() == 0


def test_phase_of_flight(spark):
    for alt, low in ((35000.0, 0), (2500.0, 4)):
        (r,) = jamming.detect(cell_of(spark, [(0, 0)] * 4, alt)).collect()
        assert r.evidence.degraded_in_terminal_phase == low and r.evidence.degraded_alt_ft_median == alt


def test_until_bound_and_epoch_buckets(spark):
    both = cell_of(spark, [(0, 0)] * 4).unionByName(cell_of(spark, [(0, 0)] * 4, t=3600))
    assert jamming.detect(positions.scan(both)).count() == 2
    assert jamming.detect(positions.scan(both, until_us=T0 + 1_800_000_000)).count() == 1
    ids = {r.incident_id for r in jamming.detect(both).collect()}
    early = both.unionByName(rows(spark, [{"icao24": "z", "t": -420}]))
    assert {r.incident_id for r in jamming.detect(early).collect()} == ids


def test_coarse_cells_count_what_is_left(spark):
    near = [{"icao24": f"p{k}", "t": k, "lat": 0.2, "lon": 100.2, "nic": 0, "nac": 0} for k in range(4)]
    far = [{"icao24": f"q{k}", "t": k, "lat": 0.7, "lon": 100.2 + 0.5 * (k % 2), "nic": 8} for k in range(4)]
    cells = {(r.level, r.scoreable): len(r.aircraft) for r in jamming.levels(rows(spark, near + far)).collect()}
    assert cells == {(0, True): 4, (1, True): 4}
    alone = jamming.coverage(rows(spark, near[:3])).collect()
    assert len(alone) == 1 and not alone[0].scoreable and alone[0].degraded_fraction is None and alone[0].level == 0


SILENCE = [{"t": 0, "lon": 103.7}, {"t": 1800, "lon": 104.4}]


def none(spark):
    return spark.createDataFrame([], ledger.RUN_SCHEMA), spark.createDataFrame([], ledger.OUTAGE_SCHEMA)


def gap_count(spark, items, runs=None, outages=None, **s):
    empty = none(spark)
    return gaps.detect(rows(spark, items), runs or empty[0], outages or empty[1], Settings(**s)).count()


def test_gap_rules(spark):
    assert gap_count(spark, SILENCE) == 1
    assert gap_count(spark, [SILENCE[0] | {"rate": -1800.0}, SILENCE[1]]) == 0
    assert gap_count(spark, [SILENCE[0] | {"rate": -300.0}, SILENCE[1]]) == 1
    assert gap_count(spark, [SILENCE[0] | {"alt": None}, SILENCE[1]]) == 0
    assert gap_count(spark, [SILENCE[0] | {"alt": 10000.0, "rate": None, "gs": None}, SILENCE[1]]) == 1
    assert gap_count(spark, [SILENCE[0], SILENCE[1] | {"t": 599}]) == 0
    assert gap_count(spark, [{"t": 0, "lat": 1.35, "lon": 103.82}, {"t": 480 * 60, "lat": 1.35, "lon": 104.5}]) == 0
    assert gap_count(spark, [{"t": 0, "lat": 1.35, "lon": 103.82}, {"t": 11 * 60, "lat": 1.35, "lon": 104.5}]) == 1


def test_gap_outages_of_any_region_and_open_ones(spark):
    for o, c, n in ((600, 700, 0), (1800, 1900, 0), (1801, 1900, 1), (-10, 0, 0), (-20, -1, 1), (1700, None, 0)):
        out = spark.createDataFrame([(1, T0 + o * 1_000_000, None if c is None else T0 + c * 1_000_000, "x", 1)], ledger.OUTAGE_SCHEMA)
        assert gap_count(spark, SILENCE, outages=out) == n


def test_gap_recorded_circle(spark):
    far = [{"t": 0, "lat": 58.0, "lon": 20.0}, {"t": 8 * 3600, "lat": 58.0, "lon": 22.0}]
    run = spark.createDataFrame([(5, T0 + 30_000_000, None, None, "running", "r", 58.0, 20.0, 250.0, 1)], ledger.RUN_SCHEMA)
    assert gap_count(spark, far) == 1 and gap_count(spark, far, runs=run) == 0
    other = spark.createDataFrame([(5, T0 + 61_000_000, None, None, "running", "r", 58.0, 20.0, 250.0, 1)], ledger.RUN_SCHEMA)
    assert gap_count(spark, far, runs=other) == 1


BOX = {"lat": 0.8, "lon": 104.0, "alt": 2000.0}


def test_incursion_rules(spark):
    level = [BOX | {"t": 60 * k} for k in range(5)]
    (r,) = visits.incursions(rows(spark, level)).collect()
    assert r.zone_id == "riau-border-watch" and r.evidence.samples_in_visit == 5 and r.evidence.dwell_minutes == 4.0 and r.severity == "moderate"
    assert visits.incursions(rows(spark, [x | {"rate": -1400.0} for x in level])).count() == 0
    assert visits.incursions(rows(spark, [x | {"rate": None} for x in level])).count() == 1
    assert visits.incursions(rows(spark, [x | {"alt": 8000.0} for x in level])).count() == 0
    assert visits.incursions(rows(spark, [x | {"alt": None} for x in level])).count() == 1
    assert visits.incursions(rows(spark, level[:2])).count() == 0
    assert visits.incursions(rows(spark, level + [x | {"t": x["t"] + 240 + 901} for x in level])).count() == 2
    assert visits.incursions(rows(spark, level + [x | {"t": x["t"] + 240 + 900} for x in level])).count() == 1


def test_squawk_runs(spark):
    codes = ["7700", "7700", "2000", "7700", "7700", "7600"]
    found = visits.squawks(rows(spark, [{"t": 60 * k, "squawk": c} for k, c in enumerate(codes)])).collect()
    assert sorted(r.evidence.samples for r in found) == [2, 2] and {r.incident_type for r in found} == {"emergency squawk 7700"}


def test_spoof_needs_three_violations_and_ignores_no_time(spark):
    jump = [{"t": 60 * k, "lat": 1.0 if k % 2 else 3.5} for k in range(4)]
    (r,) = visits.spoofs(rows(spark, jump)).collect()
    assert r.evidence.violations == 3 and r.score == pytest.approx(0.9) and r.severity == "critical"
    assert visits.spoofs(rows(spark, jump[:3])).count() == 0
    assert visits.speed_steps(rows(spark, [{"t": 0}, {"t": 0, "lat": 9.0}])).first().speed_kt == 0.0


def test_track_splits_only_after_more_than_the_gap(spark):
    t = [60 * k for k in range(10)]
    for gap, n in ((900, 1), (901, 2)):
        df = rows(spark, [{"t": x} for x in t] + [{"t": 540 + gap + x} for x in t])
        assert tracks.tracks(df).count() == n
    assert tracks.tracks(rows(spark, [{"t": x, "ground": x == 60} for x in t])).count() == 0
    two = rows(spark, [{"t": x, "region": "r"} for x in t] + [{"t": 7200 + x, "region": "q"} for x in t])
    assert {r.region for r in tracks.tracks(two).collect()} == {"r", "q"}
    (r,) = tracks.tracks(rows(spark, [{"t": x} for x in t])).collect()
    assert r.track_id == "a:2026-07-01T00:00:00" and r.point_count == 10


def test_track_descriptor():
    p = tracks.resampled(np.array([0.0, 10.0]), np.array([0.0, 1.0]), np.array([0.0, 0.0]), np.array([0.0, 1.0]), 3)
    d = tracks.descriptor(p)
    assert d.shape == (2, 5) and d[:, 0] == pytest.approx([55.5, 55.5]) and d[:, 3] == pytest.approx([0, 0]) and d[:, 4] == pytest.approx([0.5, 0.5])


def test_incremental_equals_batch(spark):
    df = positions.from_events(spark.read.parquet("/root/testdata/sf0.001/events.parquet")).cache()
    runs, out = ledger.runs(spark), ledger.outages(spark)
    whole = picture.all_incidents(df, runs, out)
    ids = {r.incident_id for r in whole.collect()}
    first = df.where(F.col("us") <= T0 + 1_500_000_000)
    stored = picture.all_incidents(first, runs, out)
    c = incremental.cycle(df, tracks.tracks(first), stored, runs, out, T0 + 1_500_000_000, Settings(refresh_hours=1))
    assert {r.incident_id for r in c.incidents.collect()} == ids
    assert sorted(map(tuple, c.tracks.collect())) == sorted(map(tuple, tracks.tracks(df).select(*c.tracks.columns).collect()))
    assert c.watermark_us == df.agg(F.max("us")).first()[0]
    assert incremental.dirty(df, None).count() == df.select("icao24").distinct().count()


def test_seeded_gap(spark):
    df = rows(spark, [{"t": 0}, {"t": 240, "lon": 103.7}, {"t": 1020, "lon": 104.3}])
    empty = none(spark)
    full = {r.incident_id for r in gaps.detect(df, *empty).collect()}
    assert full and {r.incident_id for r in gaps.detect(df, *empty, since_us=T0 + 480_000_000).collect()} == full
    assert gaps.detect(df, *empty, since_us=T0 + 1_021_000_000).count() == 0


def test_order_of_rows_does_not_matter(spark):
    df = positions.from_events(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    empty = none(spark)
    a = {tuple(r) for r in picture.all_incidents(df, *empty).select("incident_id", "score", "evidence").collect()}
    b = {tuple(r) for r in picture.all_incidents(df.orderBy(F.rand(3)).repartition(7), *empty).select("incident_id", "score", "evidence").collect()}
    assert a == b


def test_zones(spark):
    pts = spark.createDataFrame([(1.15, 103.85), (1.36, 103.99), (-30.0, 90.0), (1.05, 103.85)], "lat double, lon double")
    got = [r[0] for r in pts.select(zone_for(F.col("lat"), F.col("lon"))).collect()]
    assert got == ["sg-strait-corridor", "changi-terminal", None, "sg-strait-corridor"]
    assert pts.select(zones_at(F.col("lat"), F.col("lon")).alias("z")).collect()[3].z == ["sg-strait-corridor", "riau-border-watch"]
    crossed = pts.crossJoin(frame(spark)).where(geo.in_ring(F.col("lat"), F.col("lon"), F.col("polygon")))
    assert sorted(r.zone_id for r in crossed.collect()) == sorted(x for r in pts.select(zones_at(F.col("lat"), F.col("lon")).alias("z")).collect() for x in r.z)
    f = json.loads(geojson(spark).first().feature)
    assert f["geometry"]["coordinates"][0][0] == f["geometry"]["coordinates"][0][-1] == [103.90, 1.25]


def test_in_ring_of_a_triangle_and_too_few_corners(spark):
    ring = F.array(*[F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon")) for a, b in ((0.0, 0.0), (0.0, 2.0), (2.0, 0.0))])
    r = spark.range(1).select(geo.in_ring(F.lit(0.5), F.lit(0.5), ring), geo.in_ring(F.lit(1.5), F.lit(1.5), ring), geo.in_ring(F.lit(0.5), F.lit(0.5), F.slice(ring, 1, 2))).first()
    assert tuple(r) == (True, False, False)


def test_grades(spark):
    r = spark.range(1).select(
        grading.severity(F.lit(0.85)), grading.severity(F.lit(0.39)), grading.reliability(F.lit(8)), grading.reliability(F.lit(8), F.lit(False)), grading.reliability(F.lit(2), F.lit(False)),
        grading.credibility(F.lit(0.45)), grading.plausible_gap(F.lit(20.0), F.lit(100.0), 10, 50), grading.plausible_incursion(F.lit(None), F.lit("9v-abc")), grading.plausible_jamming(F.lit(5), 4), grading.phase_note(F.lit(1), F.lit(2)),
    ).first()
    assert tuple(r) == ("critical", "low", "B", "C", "E", 4, "more plausible", "more plausible", "unclear", "mixed")


SNAP = {
    "now": 1_800_000_000_000, "total": 9,
    "ac": [
        {"hex": " ABC123 ", "lat": 1.0, "lon": 103.0, "alt_baro": "ground", "seen_pos": 2.5, "flight": "SQ1 ", "nic": 8, "nac_p": "x", "squawk": " "},
        {"hex": "d1", "lat": "1.5", "lon": 103, "alt_baro": 35000, "seen_pos": 60, "nic": 8.7, "rssi": -3.5, "gs": "fast"},
        {"hex": "~d2", "lat": 1, "lon": 2, "seen_pos": 1}, {"hex": "d3", "lat": None, "lon": 2, "seen_pos": 1}, {"hex": "d4", "lat": 1, "lon": 2}, {"hex": "d5", "lat": 1, "lon": 2, "seen_pos": 61}, {"lat": 1, "lon": 2, "seen_pos": 1},
    ],
}


def test_snapshots(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(SNAP))
    a, b = snapshots.parse_snapshots(snapshots.read_snapshots(spark, str(tmp_path))).orderBy("icao24").collect()
    assert (a.icao24, a.on_ground, a.alt_baro_ft, a.callsign, a.nic, a.nac_p, a.squawk, a.us) == ("abc123", True, None, "SQ1", 8, None, None, 1_799_999_997_500_000)
    assert (b.lat, b.alt_baro_ft, b.nic, b.rssi, b.gs_kt, b.on_ground) == (1.5, 35000.0, 8, -3.5, None, False)


def test_state_vectors(spark):
    v = ["4B1", "SWR ", "CH", "1000", "1001", "8.5", "47.1", "1000", "false", "100", "90", "2", None, "1100", "1000", "false", "0", "3"]
    rows_ = [(1010.0, v), (1061.0, v), (994.0, v), (995.0, v), (1010.0, v[:16]), (1010.0, [*v[:5], None, *v[6:]]), (1010.0, [*v[:8], "true", *v[9:17]])]
    got = snapshots.parse_state_vectors(spark.createDataFrame(rows_, "snapshot_s double, v array<string>")).collect()
    assert len(got) == 3 and got[0].alt_baro_ft == pytest.approx(3280.839895) and got[0].category == "OS3" and got[0].nic is None and got[0].callsign == "SWR"
    assert got[2].on_ground and got[2].alt_baro_ft is None and got[2].category is None


def test_evidence(spark, tmp_path):
    good = {"doc_id": "1", "title": "t", "published": "2026-07-01T02:00:00+02:00", "lat": 1.0, "lon": "103", "credibility": 9, "reliability": "b2", "url": "/x", "source": " "}
    bad = [good | {"doc_id": " "}, good | {"published": "soon"}, good | {"lat": 91}, good | {"lat": "inf"}, good | {"lon": True}, good | {"title": None}]
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, [good, *bad])) + "\nnot json\n")
    items, corrupt = snapshots.lane(spark, str(tmp_path), "air", "http://h/")
    (r,) = items.collect()
    assert (r.us, r.credibility, r.reliability, r.url, r.source, r.summary, r.detector) == (T0, 6, "B", "http://h/x", "air", "t", "unknown")
    assert corrupt.count() == 1


def test_dedup_and_identities(spark):
    df = rows(spark, [{"t": 0.1}, {"t": 0.9}, {"t": 1.0}, {"t": 0.1, "region": None}, {"t": 0.2, "region": None}])
    kept = ingest.deduplicated(df)
    assert sorted(r.id for r in kept.collect()) == [0, 2, 3]
    assert sorted(r.id for r in ingest.deduplicated(df, df.where("id in (1, 4)")).collect()) == [2]
    assert ingest.deduplicated(df.limit(0), df).count() == 0
    named = spark.createDataFrame([(1, "a", 5, "X", None), (2, "a", 9, None, "R"), (3, "a", 7, "Y", None)], "id long, icao24 string, us long, callsign string, registration string")
    named = named.withColumns({"type_code": F.lit(None).cast("string"), "category": F.lit(None).cast("string")})
    r = ingest.identities(named).first()
    assert (r.callsign, r.registration, r.first_us, r.last_us) == ("Y", "R", 5, 9)
    assert ingest.identities(named.where("id = 1"), ingest.identities(named.where("id > 1"))).first().callsign == "X"


def test_outages_of_beats(spark):
    beats = spark.createDataFrame([("r", k * 30_000_000, ok) for k, ok in enumerate([True, False, False, False, False, True, False, False, True])], "region string, us long, ok boolean")
    (r,) = ingest.outages_of_beats(beats).collect()
    assert (r.opened_us, r.closed_us) == (90_000_000, 150_000_000)
    assert ingest.pauses(beats.where("us != 60000000 and us != 90000000 and us != 120000000 and us != 150000000")).count() == 1


def test_interval_union_and_clock_hours(spark):
    iv = spark.createDataFrame([(0, 10), (5, 20), (20, 25), (30, 40)], "start_us long, end_us long")
    assert sorted(map(tuple, sequences.merged_intervals(iv).collect())) == [(0, 25), (30, 40)]
    h = 3_600_000_000
    hours = spark.createDataFrame([(k * 24 * h, n, 10, 5, o, 0, 100 * 24 * h) for k, n, o in ((1, 1000, 0.0), (2, 3000, 0.0), (3, 9000, 5.0))], "hour_us long, reports long, cell_windows long, unscoreable long, outage_minutes double, lo_us long, hi_us long")
    (r,) = evaluation.clock_hours(hours).collect()
    assert (r.local_hour, r.samples, r.reports_mean, r.reports_spread, r.unscoreable_mean) == (8, 2, 2000.0, 1000.0, 50.0)


def test_correlation_rejects(spark):
    item = lambda i, lat=1.1, lon=103.6, t=0: (i, lat, lon, T0 + t * 60_000_000)
    e = lambda *x: spark.createDataFrame(list(x), "doc_id string, lat double, lon double, us long")
    sea = e(item("same"), item("cell", lat=1.6), item("late", t=181), item("edge", t=180), item("out", lat=2.1))
    assert [r.sea_doc_id for r in picture.correlate(e(item("a")), sea).collect()] == ["same", "edge"]


def test_latest_incident_and_rate_limit(spark):
    df = spark.createDataFrame([("x", 1, "old"), ("x", 2, "new"), ("y", 1, "one")], "incident_id string, seq int, what string")
    assert sorted(r.what for r in picture.latest_of(df, "seq").collect()) == ["new", "one"]
    req = spark.createDataFrame([("c", t * 1_000_000) for t in (0, 30, 59, 60, 61)], "client string, us long")
    assert [r.in_window for r in picture.request_counts(req).orderBy("us").collect()] == [1, 2, 3, 3, 4]


def test_autoencoder_gradient_and_training():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3, 6, 5))
    net = anomaly.Autoencoder(5, 4, 1)
    _, grads = net.gradients(x)
    for p, g in zip(net.parts(), grads, strict=True):
        for k in p:
            at = tuple(rng.integers(0, s) for s in p[k].shape)
            keep = p[k][at]
            p[k][at] = keep + 1e-5
            up = ((net(x) - x) ** 2).mean()
            p[k][at] = keep - 1e-5
            down = ((net(x) - x) ** 2).mean()
            p[k][at] = keep
            assert g[k][at] == pytest.approx((up - down) / 2e-5, abs=1e-6)
    straight = np.tile(np.array([1.0, 0, 1, 0, 0]), (30, 20, 1)) + rng.normal(scale=0.01, size=(30, 20, 5)) * np.array([1, 1, 1, 1, 0])
    angle = np.linspace(0, 12, 20)
    orbit = np.column_stack([np.cos(angle), np.sin(angle), np.ones(20), np.full(20, 0.6), np.zeros(20)])
    model = anomaly.train(np.concatenate([straight, orbit[None]]), epochs=30)
    errors = model.errors(np.concatenate([straight[:5], orbit[None]]))
    assert np.isfinite(errors).all() and errors.argmax() == 5 and model.std[4] == 1.0
    assert anomaly.Model.loaded(model.dumped()).errors(straight[:2]) == pytest.approx(model.errors(straight[:2]))
    assert anomaly.pca_errors(np.concatenate([straight, orbit[None]]).reshape(31, -1)).shape == (31,)
    assert anomaly.isolation_scores(np.concatenate([straight, 9 * orbit[None]]).reshape(31, -1), 50).argmax() == 30
    pts = [{"t": float(k), "lat": 1 + k / 100, "lon": 103.0} for k in range(30)]
    assert set(anomaly.score_track(pts, model)) == {"error", "threshold", "anomalous"}
    for wrong in (pts[:1], [*pts, pts[0]], [pts[0] | {"lat": 99.0}, pts[1]]):
        with pytest.raises(ValueError):
            anomaly.score_track(wrong, model)
    assert anomaly.stability([np.arange(20.0), np.arange(20.0)])["spearman"] == pytest.approx(1.0)


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(0.1, 0), (0.5, 1), (0.5, 0), (0.9, 1)], "score double, label int")
    assert evaluation.auc(df).first().auc == pytest.approx(0.875)


def test_streaming_keeps_each_report_once(spark, tmp_path):
    from trackloom.streaming import live, store

    (tmp_path / "in").mkdir()
    one = json.dumps(SNAP)
    (tmp_path / "in" / "a.json").write_text(one)
    stream = live.positions_stream(spark, str(tmp_path / "in"), "s", "r")
    live.appended(stream, str(tmp_path / "out"), str(tmp_path / "cp")).start().awaitTermination()
    (tmp_path / "in" / "b.json").write_text(one)
    live.appended(live.positions_stream(spark, str(tmp_path / "in"), "s", "r"), str(tmp_path / "out"), str(tmp_path / "cp")).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    kept = store.Store(spark, str(tmp_path / "store"), settings=Settings(track_min_points=1))
    landed = spark.read.parquet(str(tmp_path / "out"))
    kept.cycle(landed.withColumns({"id": F.col("us"), "ts": F.col("ts").cast("timestamp_ntz")}), 0)
    assert kept.tracks().count() == 1


def test_partition_overwrite(spark, tmp_path):
    path = str(tmp_path / "t")
    incremental.replaced_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "x int, region string"), path, "region")
    incremental.replaced_partitions(spark.createDataFrame([(3, "a")], "x int, region string"), path, "region")
    assert sorted(r.x for r in spark.read.parquet(path).collect()) == [2, 3]


def test_missing_clock_hours_reads_all_events(spark, tmp_path):
    """Hours seen by any user and any type of event count; UTC 2 and 3 are local 10 and 11."""
    from trackloom.plans.queries import QUERIES

    rows = [(h, f"2024-01-0{1 + h % 2} {h:02d}:30:00", h * 7 + 1, ["click", "purchase"][h % 2]) for h in range(24) if h not in (2, 3)]
    df = spark.createDataFrame(rows, "event_id long, at string, user_id long, event_type string")
    df.selectExpr("event_id", "cast(at as timestamp_ntz) AS ts", "user_id", "event_type").write.parquet(f"{tmp_path}/events.parquet")
    assert sorted(r.local_hour for r in QUERIES["missing_clock_hours"](spark, str(tmp_path)).collect()) == [10, 11]


def test_anomaly_scale_and_threshold_cover_all_tracks(spark):
    """With weights from 20 of 60 tracks, scale and 99th percentile are those of all 60."""
    x = np.random.default_rng(3).normal(size=(60, 6, 5)) * np.linspace(0.1, 9, 60)[:, None, None]
    df = spark.createDataFrame([(f"t{i}", q.tolist()) for i, q in enumerate(x)], "track_id string, sequence array<array<double>>")
    model = anomaly.fitted(df, epochs=3, most=20)
    mean, std = anomaly.scale_of(x)
    assert model.mean == pytest.approx(mean) and model.std == pytest.approx(std)
    assert model.threshold == pytest.approx(np.quantile(model.errors(x), 0.99))


def test_distance_of_a_track_is_that_of_its_steps(spark):
    """The first report has no step; an unknown place has no distance."""
    r = spark.range(1).select(geo.haversine_km(F.lit(None).cast("double"), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("none"), geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("one")).first()
    assert r.none is None and r.one == pytest.approx(111.195, abs=0.01)
    df = rows(spark, [{"t": 60 * k, "lat": 1.0 + k / 10, "lon": 103.0} for k in range(12)] + [{"t": 5_000 + 60 * k, "lat": 3.0, "lon": 103.0} for k in range(10)])
    far, still = sorted(tracks.tracks(df).collect(), key=lambda x: x.start_us)
    assert far.distance_km == pytest.approx(11 * 11.1195, abs=0.01) and still.distance_km == 0.0
    plain = tracks.with_steps(tracks.segments(df)).select("id", "island", "step_km").collect()
    assert {tuple(x) for x in plain} == {tuple(x) for x in tracks.stepped(df).select("id", "island", "step_km").collect()}
