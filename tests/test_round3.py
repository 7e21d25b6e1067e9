"""What the third review found: rounding at a track's end, work done again for every step or read, states kept while scoring."""

from __future__ import annotations

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from compare import differences
from trackloom.operators import anomaly, baselines, jamming, tracks
from trackloom.plans.oracles import ORACLES
from trackloom.plans.queries import QUERIES
from trackloom.sources import positions

SF = "/root/testdata/sf0.001"


def test_a_track_ends_at_its_last_report(spark, tmp_path):
    """three aircraft that stand still at the end; a step of rounding error had a heading."""
    pq.write_table(duckdb.sql("SELECT * FROM '/root/testdata/sf0.1/events.parquet' WHERE user_id IN (298, 338, 598)").to_arrow_table(), tmp_path / "events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    assert not differences(spark, con, QUERIES["track_sequence"], ORACLES["track_sequence"], str(tmp_path))
    assert not differences(spark, con, QUERIES["track_resample"], ORACLES["track_resample"], str(tmp_path))


def test_steps_are_bound_once(spark):
    """without the features, all steps of a track were made again for every step."""
    seq = tracks.sequences(positions.read(spark, SF))
    plan = seq.select("sequence")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("atan2") == 2


@pytest.mark.parametrize("name", ["anomaly_auc", "anomaly_incidents"])
def test_tracks_are_derived_once(spark, monkeypatch, name):
    """F2, F3: what is scored is a stored table."""
    read = []
    monkeypatch.setattr(anomaly, "train", lambda x, **more: anomaly.Model(anomaly.Autoencoder(), *more["scale"], 0.0))
    own = anomaly.scored
    monkeypatch.setattr(anomaly, "scored", lambda s, m: read.extend(s.inputFiles()) or own(s, m))
    QUERIES[name](spark, SF).collect()
    assert read and not any("events.parquet" in f for f in read)


def test_scoring_keeps_no_states():
    """only learning keeps what the gradient needs; slices give what the whole gives."""
    x = np.random.default_rng(0).normal(size=(2 * anomaly.SLICE + 3, 6, 5))
    model = anomaly.Model(anomaly.Autoencoder(), np.zeros(5), np.ones(5), 1.0)
    got = model.errors(x)
    assert model.net.enc.steps == [] and model.net.dec.steps == [] and model.net.states is None
    assert got == pytest.approx(((model.net(x) - x) ** 2).mean((1, 2)).tolist())


def test_rank_stability_derives_tracks_once(spark, monkeypatch):
    """F8: ranks, quantiles and bests are taken from a stored table."""
    read, own = [], baselines.stability
    monkeypatch.setattr(baselines, "stability", lambda scores: read.extend(f for s in scores for f in s.inputFiles()) or own(scores))
    QUERIES["rank_stability"](spark, SF).collect()
    assert read and not any("events.parquet" in f for f in read)


def test_busy_cells_are_not_sorted(spark):
    """5,000 aircraft in a cell and two in another: only the two go through the windows of the coarser levels."""
    rows = [(i, f"a{i:05d}", 0, 0.6 if i < 5_000 else 0.1, 103.6, None, 8, 9, "north") for i in range(5_002)]
    reports = spark.createDataFrame(rows, "id long, icao24 string, us long, lat double, lon double, alt_baro_ft double, nic int, nac_p int, region string")
    found = jamming.levels(reports)
    assert sorted((r.level, r.scoreable, len(r.aircraft)) for r in found.collect()) == [(0, False, 2), (0, True, 5_000)]
    whole = found._jdf.queryExecution().optimizedPlan().toString()
    depth = {word: [k for k, line in enumerate(whole.splitlines()) if word in line] for word in ("Window ", "Generate inline")}
    assert depth["Window "] and max(depth["Window "]) < min(depth["Generate inline"])
