"""Models over all tracks in the cluster against plain versions on the driver."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackloom.operators import anomaly, baselines, evaluation


@pytest.fixture(scope="module")
def seq(spark):
    """150 made-up descriptors: 12 features of which some go together, one never varies, and three tracks are odd."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 12)) @ np.diag([5, 3, 2, 1.5, 1, 1, 0.5, 0.5, 0.2, 0.2, 0.1, 0])
    x[:, 5] = x[:, 0] * 2 + 100
    x[:, 11] = 7.0
    x[:3] += 30 * rng.normal(size=(3, 12)) * (np.arange(12) < 11)
    rows = [(f"t{k:03d}", [float(v) for v in r]) for k, r in enumerate(x)]
    return spark.createDataFrame(rows, "track_id string, features array<double>").repartition(5).cache()


def matrix(seq):
    f = seq.orderBy("track_id").toPandas()
    return f["track_id"].tolist(), np.stack(f["features"].to_list())


def by_id(df, value):
    return {r["track_id"]: r[value] for r in df.collect()}


def test_components_of_all_tracks(seq):
    ids, x = matrix(seq)
    got = by_id(baselines.rebuilt(seq, baselines.components(seq)), "error")
    assert [got[i] for i in ids] == pytest.approx(anomaly.pca_errors(x).tolist(), abs=1e-9)


def test_components_of_few_tracks(seq):
    assert baselines.components(seq.limit(0)) is None
    one = seq.where("track_id = 't001'")
    assert by_id(baselines.rebuilt(one, baselines.components(one)), "error") == {"t001": 0.0}
    two = seq.where("track_id < 't002'")
    assert list(by_id(baselines.rebuilt(two, baselines.components(two)), "error").values()) == pytest.approx([0, 0], abs=1e-12)


def plain_depth(tree, row):
    at = 0
    while tree.feature[at] >= 0:
        at = tree.left[at] if row[tree.feature[at]] < tree.cut[at] else tree.right[at]
    return tree.depth[at]


def test_forest_scores_all_tracks(seq):
    ids, x = matrix(seq)
    grown = baselines.forest(seq, trees=40, sample=32, seed=3)
    assert len(grown.trees) == 40 and grown.sample == 32
    got = by_id(baselines.isolated(seq, grown), "score")
    want = [2 ** (-np.mean([plain_depth(t, row) for t in grown.trees]) / baselines.usual_depth(32)) for row in x]
    assert [got[i] for i in ids] == pytest.approx(want)
    assert set(sorted(got, key=got.get)[-3:]) == {"t000", "t001", "t002"}
    again = baselines.forest(seq.repartition(3), trees=40, sample=32, seed=3)
    assert all((a.cut == b.cut).all() for a, b in zip(grown.trees, again.trees, strict=True))
    assert any(len(a.cut) != len(b.cut) or (a.cut != b.cut).any() for a, b in zip(grown.trees, baselines.forest(seq, 40, 32, 4).trees, strict=True))


def test_forest_trees_are_whole(seq):
    """Every sampled track ends in a leaf, and leaves hold as many as were sampled."""
    _, x = matrix(seq)
    t = baselines.Tree.grown(x, np.random.default_rng(1))
    leaves = np.flatnonzero(t.feature < 0)
    at, rows = np.zeros(len(x), int), np.arange(len(x))
    for _ in range(20):
        inner = t.feature[at] >= 0
        at = np.where(inner, np.where(x[rows, np.maximum(t.feature[at], 0)] < t.cut[at], t.left[at], t.right[at]), at)
    assert set(at) == set(leaves) and len(t.feature) == 2 * len(leaves) - 1
    assert len({*t.left[t.feature >= 0], *t.right[t.feature >= 0]}) == len(t.feature) - 1


def test_forest_of_few_and_equal_tracks(spark, seq):
    assert baselines.forest(seq.limit(0)) is None
    same = spark.createDataFrame([(f"s{k}", [1.0, 2.0]) for k in range(5)], "track_id string, features array<double>")
    assert len(set(by_id(baselines.isolated(same, baselines.forest(same, 5)), "score").values())) == 1


def test_stability_of_all_tracks(spark):
    """With ties; the plain version breaks ties of the highest by position, that is by id here."""
    rng = np.random.default_rng(9)
    ids = [f"t{k:04d}" for k in range(800)]
    base = rng.normal(size=800)
    runs = [np.round(np.exp(base + rng.normal(size=800) * s), 2) for s in (0.1, 0.5, 1.0)]
    frames = [spark.createDataFrame(list(zip(ids, map(float, r), strict=True)), "track_id string, score double").repartition(4) for r in runs]
    assert baselines.stability(frames) == pytest.approx(anomaly.stability(runs))
    assert baselines.stability(frames[:1])["spearman"] == 1.0


def test_exact_quantiles_and_ranks_in_bands(spark):
    values = [float(v) for v in np.random.default_rng(2).choice([0.0, 1.0, 1.5, -3.0, *np.arange(2, 300) / 7], 5_000)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k long, v double").withColumn("v", F.when(F.col("k") < 4_990, F.col("v")))
    assert evaluation.quantiles(df, "v", [0, 0.5, 0.99, 1]) == pytest.approx(np.quantile(values[:4990], [0, 0.5, 0.99, 1]).tolist())
    known = df.where("v is not null")
    assert by_key(baselines.with_ranks(known, "k", "v")) == pytest.approx(dict(enumerate(pd.Series(values[:4990]).rank())))
    assert evaluation.quantiles(df.limit(0), "v", [0.5]) == [None]


def by_key(df):
    return {r["k"]: r["rank"] for r in df.collect()}
