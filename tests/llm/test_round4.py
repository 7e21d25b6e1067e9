"""What the fourth review found: op7's candidates that no link needs, and shuffle files that stay."""

from __future__ import annotations

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from trackloom.llm import ngram_join
from trackloom.llm.common import shuffles_dropped


def links_of(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def test_texts_that_share_passages_are_no_candidates(spark, monkeypatch):
    """each passage is in two of 80 texts, and any two texts have a twelfth in common; all were one candidate component."""
    rng = random.Random(3)
    passage = {(i, step): " ".join(f"w{rng.randrange(10**6)}" for _ in range(25)) for i in range(80) for step in range(1, 7)}
    rows = [(i, " ".join([passage[i, step] for step in range(1, 7)] + [passage[(i - step) % 80, step] for step in range(1, 7)])) for i in range(80)]
    seen, own = [], ngram_join._seats
    monkeypatch.setattr(ngram_join, "_seats", lambda sets, members: seen.extend(members.collect()) or own(sets, members))
    out = ngram_join.linked(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85)
    assert links_of(out) == Counter(brute.links(rows, 4, 85))
    assert len(seen) < 8


@pytest.mark.parametrize(("rare", "percent"), [(2, 85), (8, 85), (32, 80), (2, 50)])
def test_links_by_frequent_shingles_of_texts_of_many_sizes(spark, monkeypatch, rare, percent):
    """copies near the bound, some longer or shorter, some of two texts; few of their shingles are rare."""
    rng = random.Random(rare + percent)
    bases = [[f"b{k}w{i}" for i in range(100)] for k in range(3)]
    rows = []
    for i in range(180):
        w = list(bases[rng.randrange(3)])
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(60)}"
        kind = rng.randrange(6)
        w = w[rng.randrange(25) :] if kind == 0 else w + [f"y{rng.randrange(9)}" for _ in range(rng.randrange(25))] if kind == 1 else w[:50] + bases[0][50:] if kind == 2 else w
        rows.append((i, " ".join(w)))
    rows += [(500 + i, " ".join(bases[0][:i])) for i in range(12)]
    monkeypatch.setattr(ngram_join, "RARE", rare)
    monkeypatch.setattr(ngram_join, "CELL_NODES", 16)
    out = ngram_join.linked(spark.createDataFrame(rows, "doc_id long, text string"), 4, percent)
    assert links_of(out) == Counter(brute.links(rows, 4, percent))


def test_join_leaves_no_shuffle_files(spark, monkeypatch, tmp_path):
    """what a run has shuffled goes when it ends; files stayed until the driver happened to collect its garbage."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was, during, own = spark.conf.get(setting), [], ngram_join.stored
    monkeypatch.setattr(ngram_join, "stored", lambda df: during.append(spark.conf.get(setting)) or own(df))
    ngram_join.linked(spark.createDataFrame([(i, "a b c d e f g h") for i in range(3)], "doc_id long, text string"))
    assert set(during) == {"true"} and spark.conf.get(setting) == was
    held = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    before, counts = held(), spark.range(10_000).groupBy((F.col("id") % 1000).alias("k")).count()
    with shuffles_dropped(spark):
        counts.write.parquet(str(tmp_path / "counts"))
    until = time.time() + 20
    while held() > before and time.time() < until:
        time.sleep(0.2)
    assert held() <= before
