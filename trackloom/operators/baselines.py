"""Baselines of the recurrent model over all tracks, in the cluster: principal components, an isolation forest, and how stably models rank tracks.

What is fitted is of a fixed size: sums of products of the features; trees grown by tasks from samples of
``sample`` tracks each. Errors and scores are computed where the tracks are. Ranks are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .evaluation import banded, quantiles, ranked

COMPONENTS = 4
TREES, SAMPLE = 200, 256
TOP = 10


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(sequences: DataFrame, width: int, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    """Of (1, x) with the standardised features x of all tracks: the sums of all products of two of them."""
    sent = sequences.sparkSession.sparkContext.broadcast((mean, std))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width + 1))
        shift, scale = sent.value
        for b in batches:
            if b.num_rows:
                x = np.column_stack([np.ones(b.num_rows), (_matrix(b["features"]) - shift) / scale])
                total += x.T @ x
        yield pa.RecordBatch.from_pydict({"row": pa.array(np.arange(width + 1)), "sums": pa.array(list(total), pa.list_(pa.float64()))})

    def add(t: pa.Table) -> pa.Table:
        return pa.table({"row": t["row"][:1], "sums": pa.array([_matrix(t["sums"].combine_chunks()).sum(0)], pa.list_(pa.float64()))})

    schema = "row long, sums array<double>"
    # As many rows as there are features.
    rows = sequences.select("features").mapInArrow(part, schema).groupBy("row").applyInArrow(add, schema).collect()
    out = np.zeros((width + 1, width + 1))
    for r in rows:
        out[r["row"]] = r["sums"]
    return out


@dataclass(frozen=True)
class Components:
    """The mean and spread of the features, and the directions kept."""

    mean: np.ndarray
    std: np.ndarray
    directions: np.ndarray
    tracks: int


def components(sequences: DataFrame, most: int = COMPONENTS) -> Components | None:
    """At most ``most`` principal components of the standardised features of all tracks; None without tracks."""
    one = sequences.select(F.size("features").alias("w")).limit(1).collect()
    if not one:
        return None
    width = one[0]["w"]
    first = _sums(sequences, width, np.zeros(width), np.ones(width))
    n = int(first[0, 0])
    mean = first[0, 1:] / n
    # Spreads from deviations: differences of large sums would lose digits.
    spread = np.sqrt(np.maximum(np.diag(_sums(sequences, width, mean, np.ones(width)))[1:] / n, 0))
    std = np.where(spread < 1e-8, 1.0, spread)
    keep = min(most, n - 1, width)
    _, vectors = np.linalg.eigh(_sums(sequences, width, mean, std)[1:, 1:])
    return Components(mean, std, vectors[:, ::-1][:, :keep], n)


def rebuilt(sequences: DataFrame, fitted: Components) -> DataFrame:
    """Sequences with ``error``: the mean squared error of the features rebuilt from the components. With fewer than two tracks it is 0."""
    sent = sequences.sparkSession.sparkContext.broadcast(fitted)

    @F.arrow_udf("double")
    def error(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = sent.value
        for s in parts:
            x = (_matrix(s) - own.mean) / own.std if len(s) else np.zeros((0, len(own.mean)))
            off = x - x @ own.directions @ own.directions.T
            yield pa.array((off**2).mean(1) if own.directions.shape[1] else np.zeros(len(x)))

    return sequences.withColumn("error", error("features"))


def usual_depth(n: int) -> float:
    """The mean depth at which a random search tree of n rows ends."""
    return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)


@dataclass(frozen=True)
class Tree:
    """Nodes as arrays: which feature is cut, where, and the nodes left and right; a leaf (feature -1) has its depth."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    depth: np.ndarray

    @staticmethod
    def grown(x: np.ndarray, rng: np.random.Generator) -> Tree:
        feature, cut, left, right, depth = [], [], [], [], []
        limit = int(np.ceil(np.log2(max(len(x), 2))))
        todo = [(x, 0)]
        while todo:
            own, level = todo.pop(0)
            low, high = own.min(0), own.max(0)
            open_ = np.flatnonzero(high > low)
            inner = len(own) > 1 and level < limit and len(open_)
            c = int(rng.choice(open_)) if inner else -1
            at = float(rng.uniform(low[c], high[c])) if inner else 0.0
            here = own[:, c] < at if inner else None
            if inner and (here.all() or not here.any()):
                inner, c = False, -1
            feature.append(c)
            cut.append(at)
            depth.append(0.0 if inner else level + usual_depth(len(own)))
            # Children are appended in the order in which they are taken up.
            place = len(feature) + len(todo)
            left.append(place if inner else 0)
            right.append(place + 1 if inner else 0)
            if inner:
                todo += [(own[here], level + 1), (own[~here], level + 1)]
        return Tree(*(np.array(v) for v in (feature, cut, left, right, depth)))

    def depths(self, x: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while (inner := self.feature[at] >= 0).any():
            here = x[rows, np.maximum(self.feature[at], 0)] < self.cut[at]
            at = np.where(inner, np.where(here, self.left[at], self.right[at]), at)
        return self.depth[at]


@dataclass(frozen=True)
class Forest:
    trees: tuple[Tree, ...]
    sample: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The sooner random cuts isolate a row, the nearer its score is to 1."""
        total = np.zeros(len(x))
        for t in self.trees:
            total += t.depths(x)
        return 2 ** (-total / len(self.trees) / max(usual_depth(self.sample), 1e-9))


def forest(sequences: DataFrame, trees: int = TREES, sample: int = SAMPLE, seed: int = 0) -> Forest | None:
    """``trees`` trees, each grown by a task from the ``sample`` tracks with the smallest hash of id, tree and seed; None without tracks."""
    n = sequences.count()
    if not n:
        return None
    size = min(sample, n)
    # Nearly always enough for each tree; else hashes up to a larger limit are taken.
    share = min(1.0, (size + 10 * size**0.5 + 10) / n)
    while True:
        limit = int(share * (1 << 31))
        hashed = lambda t: F.pmod(F.xxhash64("track_id", F.lit(seed), t), F.lit(1 << 31))
        drawn = sequences.select("track_id", "features", F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: hashed(t) < limit)).alias("tree"))
        placed = drawn.withColumn("nth", F.row_number().over(W.partitionBy("tree").orderBy(hashed(F.col("tree")), "track_id"))).where(F.col("nth") <= size)

        def grow(key: tuple[int], f: pd.DataFrame) -> pd.DataFrame:
            f = f.sort_values("track_id")
            t = Tree.grown(np.stack(f["features"].to_list()), np.random.default_rng((seed, key[0])))
            return pd.DataFrame([(key[0], len(f), t.feature, t.cut, t.left, t.right, t.depth)], columns=["tree", "rows", "feature", "cut", "left", "right", "depth"])

        made = placed.groupBy("tree").applyInPandas(grow, "tree int, rows int, feature array<int>, cut array<double>, left array<int>, right array<int>, depth array<double>")
        # At most two nodes a sampled track: trees * sample * 2.
        rows = sorted(made.collect(), key=lambda r: r["tree"])
        if share >= 1 or (len(rows) == trees and all(r["rows"] == size for r in rows)):
            break
        share = min(1.0, 2 * share)
    return Forest(tuple(Tree(*(np.array(r[c]) for c in ("feature", "cut", "left", "right", "depth"))) for r in rows), size)


def isolated(sequences: DataFrame, grown: Forest) -> DataFrame:
    """Sequences with ``score``."""
    sent = sequences.sparkSession.sparkContext.broadcast(grown)

    @F.arrow_udf("double")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for s in parts:
            yield pa.array(sent.value.scores(_matrix(s)) if len(s) else np.zeros(0))

    return sequences.withColumn("score", score("features"))


def with_ranks(scores: DataFrame, key: str, value: str) -> DataFrame:
    """key, rank: exact ranks from 1, equal values have their mean rank."""
    at = ranked(scores, value, banded(scores, value))
    return scores.join(at.select(value, (F.col("below") + (F.col("n") + 1) / 2).alias("rank")), value).select(key, "rank")


def stability(scores: list[DataFrame], key: str = "track_id", value: str = "score", top: int = TOP) -> dict[str, float]:
    """How alike several runs rank the same tracks: mean Spearman correlation, mean overlap of the ``top`` highest (ties by key), mean of the 90th percentile over the median."""
    wide = reduce(lambda a, b: a.join(b, key), [with_ranks(s, key, value).withColumnRenamed("rank", f"r{i}") for i, s in enumerate(scores)])
    pairs = list(combinations(range(len(scores)), 2))
    # F.corr of constant ranks is null: one track, or all scores equal.
    found = wide.agg(F.count(F.lit(1)).alias("n"), *[F.corr(f"r{i}", f"r{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
    best = [{r[key] for r in s.select(key, value).orderBy(F.desc(value), key).limit(top).collect()} for s in scores]
    spread = []
    for s in scores:
        high, middle = quantiles(s, value, [0.9, 0.5])
        spread.append(high / max(middle, 1e-12))
    return {
        "spearman": float(np.mean([found[f"c{i}_{j}"] if found[f"c{i}_{j}"] is not None else np.nan for i, j in pairs])) if pairs else 1.0,
        "top_overlap": float(np.mean([len(best[i] & best[j]) / len(best[i] | best[j]) for i, j in pairs])) if pairs else 1.0,
        "separation": float(np.mean(spread)),
    }
