"""Simplified lines, landed snapshots with pushdown, and the feature sink."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.functions.lines import kept_points, simplified
from trackloom.operators import serving, tracks
from trackloom.plans.queries import QUERIES
from trackloom.sources import features, landed, positions

SF = "/root/testdata/sf0.001"


def plain(line, tolerance_km):
    """The same by recursion, one line at a time."""
    if len(line) < 3:
        return list(line)
    scale = np.cos(np.radians(np.mean([a for a, _ in line])))
    at = [np.array([b * scale, a]) * 111.0 for a, b in line]

    def split(lo, hi):
        d = at[hi] - at[lo]
        length = np.hypot(*d)
        off = [abs(d[0] * (p - at[lo])[1] - d[1] * (p - at[lo])[0]) / length if length else np.hypot(*(p - at[lo])) for p in at[lo + 1 : hi]]
        if not off or max(off) <= tolerance_km:
            return []
        k = lo + 1 + int(np.argmax(off))
        return [*split(lo, k), k, *split(k, hi)]

    return [line[k] for k in [0, *split(0, len(line) - 1), len(line) - 1]]


def test_lines_equal_recursion(spark):
    rng = random.Random(3)
    walk = lambda n: [(1 + 0.02 * k + rng.uniform(-0.05, 0.05), 103 + rng.uniform(-0.1, 0.1)) for k in range(n)]
    lines = [walk(n) for n in (0, 1, 2, 3, 4, 10, 50, 200)] + [[(0.0, 0.0), (0.0, 1.0), (0.001, 2.0), (1.0, 3.0)], [(1.0, 1.0)] * 5, [(0.0, 0.0), (1.0, 1.0), (0.0, 0.0)]]
    rows = [(k, [{"lat": a, "lon": b} for a, b in x]) for k, x in enumerate(lines)] + [(90, None), (91, [{"lat": 1.0, "lon": None}, {"lat": 2.0, "lon": 2.0}, {"lat": 1.0, "lon": 1.0}])]
    df = spark.createDataFrame(rows, "k long, line array<struct<lat:double,lon:double>>").repartition(3)
    for tolerance in (0.5, 5.0):
        got = {r.k: r.line and [tuple(p) for p in r.line] for r in df.select("k", simplified(F.col("line"), tolerance).alias("line")).collect()}
        assert {k: v for k, v in got.items() if k < 90} == {k: [tuple(p) for p in plain(x, tolerance)] for k, x in enumerate(lines)}
        assert got[90] is None and len(got[91]) == 3
    assert kept_points(np.zeros(0), np.zeros(0), np.array([0]), 1.0).tolist() == []


def test_a_long_line_takes_linear_memory():
    n = 400_000
    t = np.linspace(0, 60, n)
    keep = kept_points(np.sin(t), t, np.array([0, n]), 1.0)
    assert 100 < keep.sum() < 2_000 and keep[0] and keep[-1]


def test_simplified_tracks(spark):
    p = positions.read(spark, SF)
    lines = {r.track_id: [(x["lat"], x["lon"]) for x in r.points] for r in tracks.geometry(tracks.tracks(p), p).collect()}
    got = {r.track_id: (r.points, r.kept, r.sum_lat) for r in QUERIES["track_lines"](spark, SF).collect()}
    want = {k: plain(x, 2.0) for k, x in lines.items()}
    assert got == {k: (len(lines[k]), len(x), pytest.approx(sum(a for a, _ in x), abs=1e-4)) for k, x in want.items()} and any(len(x) < len(lines[k]) for k, x in want.items())


# Landed snapshots

US = 1_782_864_000_000_000


@pytest.fixture
def folder(tmp_path):
    def entry(n, lat, lon):
        return {"hex": f"a{n}", "lat": lat, "lon": lon, "seen_pos": 1, "alt_baro": 1000, "gs": 100}

    for region, base in (("north", 0), ("south", 100)):
        (tmp_path / region).mkdir()
        for k in range(4):
            us = US + k * 60_000_000
            (tmp_path / region / f"{us}.json").write_text(json.dumps({"now": us / 1000, "total": 2, "ac": [entry(base + k, 1.0 + k, 103.0), entry(base + 50 + k, 60.0, 10.0), "junk", {"hex": "none"}]}))
    state = ["BEEF01", "CS1 ", "Land", US / 1e6 + 59, US / 1e6 + 60, 103.5, 1.5, 1000.0, False, 200.0, 90.0, 0.0, None, 1100.0, "2000", False, 0, 3]
    (tmp_path / "south" / f"{US + 999}.json").write_text(json.dumps({"time": US / 1e6 + 60, "states": [state, state[:3], None]}))
    (tmp_path / "south" / f"{US + 1000}.json").write_text("[1, 2]")
    (tmp_path / "south" / "notes.json").write_text("{}")
    (tmp_path / "south" / f"{US + 1001}.json").write_text("{broken")
    return tmp_path


def load(spark, folder):
    spark.conf.set(landed.PUSHDOWN, "true")
    spark.dataSource.register(landed.Landed)
    return spark.read.format("trackloom_landed").option("path", folder.as_uri()).load()


def test_only_files_that_can_matter_are_opened(spark, folder):
    rows = load(spark, folder)
    parts = lambda df: df.rdd.getNumPartitions()
    assert parts(rows) == 11  # a file each, whatever is in it; those that aren't named so are none
    assert parts(rows.where("region = 'north'")) == 4
    late = rows.where((F.col("received_us") >= US + 60_000_000) & (F.col("received_us") < US + 180_000_000))
    assert parts(late) == 4 and {r.region for r in late.collect()} == {"north", "south"}
    one = late.where("region IN ('north', 'east')")
    assert parts(one) == 2 and {r.received_us for r in one.collect()} == {US + 60_000_000, US + 120_000_000}
    assert rows.where("region = 'west'").count() == 0


def test_box_and_reports_of_landed_snapshots(spark, folder):
    rows = load(spark, folder)
    assert sorted(r.icao24 for r in landed.reports(landed.in_box(rows, 0.0, 102.0, 2.0, 104.0)).collect()) == ["a0", "a1", "a100", "a101"]
    everything = landed.reports(rows).collect()
    assert len(everything) == 16 and {r.us for r in everything if r.icao24 == "a2"} == {US + 119_000_000}
    (r,) = landed.state_reports(rows).collect()
    assert (r.icao24, r.callsign, r.us, r.lat, r.lon, r.category) == ("beef01", "CS1", US + 59_000_000, 1.5, 103.5, "OS3")
    assert landed.state_reports(landed.in_box(rows, 2.0, 103.0, 3.0, 104.0)).count() == 0
    with pytest.raises(ValueError):
        landed.in_box(rows, 2.0, 1.0, 2.0, 3.0)


# Features


def test_features_are_there_when_the_job_has_ended(spark, tmp_path):
    spark.dataSource.register(features.Features)
    p = positions.read(spark, SF)
    made = serving.track_features(tracks.tracks(p), p).repartition(3)
    read = lambda: sorted(map(tuple, spark.read.format("trackloom_features").option("path", tmp_path.as_uri()).load().collect()))
    save = lambda df, mode="append": df.write.format("trackloom_features").option("path", tmp_path.as_uri()).mode(mode).save()
    assert read() == []
    save(made)
    want = sorted(map(tuple, made.collect()))
    assert read() == want and len(list((tmp_path / "manifests").iterdir())) == 1

    @F.udf("string")
    def fails(track):
        if track == want[7][0]:
            raise ValueError("a lost task")
        return track

    with pytest.raises(Exception, match="a lost task"):
        save(made.select(fails("track_id").alias("track_id"), "feature"))
    assert read() == want
    named = {x["name"] for m in features.manifests(tmp_path.as_uri()) for x in m["parts"]}
    save(made.limit(2))
    assert len(read()) == len(want) + 2
    save(made.limit(3), "overwrite")
    assert len(read()) == 3 and not named & {x["name"] for m in features.manifests(tmp_path.as_uri()) for x in m["parts"]}
    save(made.limit(0))
    assert len(read()) == 3
