"""What the fourth review found: Python functions of sequences that are derived in the same plan."""

from __future__ import annotations

import numpy as np
import pytest

from trackloom.operators import anomaly, baselines, tracks
from trackloom.plans.queries import QUERIES
from trackloom.sources import positions

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def derived(spark):
    """Not stored or cached: a column of a Python function meets the expressions that make the sequences."""
    return tracks.sequences(positions.read(spark, SF))


@pytest.fixture(scope="module")
def known(derived):
    return sorted(derived.select("track_id", "sequence", "features").collect())


def by_id(df, value):
    return {r["track_id"]: r[value] for r in df.select("track_id", value).collect()}


def test_isolation_scores(spark, derived, known):
    """of derived tracks by the operator, and all of them by the query."""
    grown = baselines.forest(derived)
    want = dict(zip([r.track_id for r in known], grown.scores(np.array([r.features for r in known])), strict=True))
    assert len(want) > 10
    assert by_id(baselines.isolated(derived, grown), "score") == pytest.approx(want)
    assert by_id(QUERIES["isolation_scores"](spark, SF), "score") == pytest.approx(want, abs=1e-9)


def test_recurrent_model_scores_derived_tracks(derived, known):
    """The same step with a model that is given: F2."""
    model = anomaly.Model(anomaly.Autoencoder(), np.zeros(5), np.ones(5), 1e-9)
    want = dict(zip([r.track_id for r in known], model.errors(np.array([r.sequence for r in known])), strict=True))
    assert by_id(anomaly.scored(derived, model), "error") == pytest.approx(want)
    assert {r.incident_id for r in anomaly.detect(derived, model).collect()} == {f"anomaly:{k}" for k, v in want.items() if v > 1e-9}


def test_pca_errors(spark, derived, known):
    """of derived tracks by the operator, and all of them by the query."""
    want = dict(zip([r.track_id for r in known], anomaly.pca_errors(np.array([r.features for r in known])), strict=True))
    assert by_id(baselines.rebuilt(derived, baselines.components(derived)), "error") == pytest.approx(want)
    assert by_id(QUERIES["pca_errors"](spark, SF), "error") == pytest.approx(want, abs=2e-9)


@pytest.mark.parametrize(("name", "step"), [("isolation_scores", "isolated"), ("pca_errors", "rebuilt")])
def test_baselines_derive_tracks_once(spark, monkeypatch, name, step):
    """F2, F3: what is fitted and scored is a stored table."""
    read, own = [], getattr(baselines, step)
    monkeypatch.setattr(baselines, step, lambda s, fitted: read.extend(s.inputFiles()) or own(s, fitted))
    QUERIES[name](spark, SF).collect()
    assert read and not any("events.parquet" in f for f in read)
