"""Unusual trajectory shapes: a small recurrent autoencoder, its baselines, and stateless scoring.

Weights are fitted on the driver, on a bounded sample of tracks (``MOST_TRACKS``). The scale and the
threshold (99th percentile of the errors) come from all tracks, and tracks are scored, in the cluster.
"""

from __future__ import annotations

import hashlib
import io
import json
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..settings import DEFAULTS, Settings
from ..storage import kept
from . import baselines
from .evaluation import quantiles
from .incidents import incidents
from .tracks import descriptor, resampled

MOST_TRACKS = 5_000
LEAST_TRACKS = 5
#: Tracks that are scored at once: states of a slice, not of a whole batch, are in memory.
SLICE = 512


def scale_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and spread of each channel; a channel that never varies has spread 1, so it stays 0 and finite."""
    flat = x.reshape(-1, x.shape[-1])
    std = flat.std(0)
    return flat.mean(0), np.where(std < 1e-8, 1.0, std)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Gru:
    """One gated recurrent layer over a batch of sequences, with its gradient."""

    NAMES = ("w", "u", "b", "v", "c")  # gates r, z side by side in w, u, b; candidate from the last third; v, c: recurrent candidate

    def __init__(self, rng: np.random.Generator, n_in: int, n: int) -> None:
        k = 1 / np.sqrt(n)
        self.n = n
        self.p = {"w": rng.uniform(-k, k, (n_in, 3 * n)), "u": rng.uniform(-k, k, (n, 2 * n)), "b": np.zeros(3 * n), "v": rng.uniform(-k, k, (n, n)), "c": np.zeros(n)}

    def run(self, x: np.ndarray, h: np.ndarray, learning: bool = False) -> np.ndarray:
        """x: batch, time, channels. Returns all states; when learning, what the gradient needs is kept."""
        n, p = self.n, self.p
        self.steps, out = [], []
        for t in range(x.shape[1]):
            a = x[:, t] @ p["w"] + p["b"]
            g = _sigmoid(a[:, : 2 * n] + h @ p["u"])
            r, z = g[:, :n], g[:, n:]
            q = h @ p["v"] + p["c"]
            c = np.tanh(a[:, 2 * n :] + r * q)
            new = (1 - z) * c + z * h
            if learning:
                self.steps.append((x[:, t], h, r, z, q, c))
            h = new
            out.append(h)
        return np.stack(out, 1)

    def back(self, grad: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """Gradients of the parameters, the inputs and the first state, given those of all states."""
        n, p = self.n, self.p
        d = {k: np.zeros_like(v) for k, v in p.items()}
        dx, dh = [], np.zeros_like(grad[:, 0])
        for t in range(len(self.steps) - 1, -1, -1):
            x, h, r, z, q, c = self.steps[t]
            dh = dh + grad[:, t]
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (h - c) * z * (1 - z)
            dr = dc * q * r * (1 - r)
            dq = dc * r
            da = np.concatenate([dr, dz, dc], 1)
            d["w"] += x.T @ da
            d["b"] += da.sum(0)
            d["u"] += h.T @ da[:, : 2 * n]
            d["v"] += h.T @ dq
            d["c"] += dq.sum(0)
            dx.append(da @ p["w"].T)
            dh = dh * z + da[:, : 2 * n] @ p["u"].T + dq @ p["v"].T
        return d, np.stack(dx[::-1], 1), dh


class Autoencoder:
    """Encoder to one state; a decoder fed with that state at every step; a linear head."""

    def __init__(self, n_features: int = 5, hidden: int = 8, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.enc, self.dec = Gru(rng, n_features, hidden), Gru(rng, hidden, hidden)
        k = 1 / np.sqrt(hidden)
        self.head = {"o": rng.uniform(-k, k, (hidden, n_features)), "d": np.zeros(n_features)}

    def parts(self) -> list[dict[str, np.ndarray]]:
        return [self.enc.p, self.dec.p, self.head]

    def __call__(self, x: np.ndarray, learning: bool = False) -> np.ndarray:
        zero = np.zeros((len(x), self.enc.n))
        code = self.enc.run(x, zero, learning)[:, -1]
        states = self.dec.run(np.repeat(code[:, None], x.shape[1], 1), zero, learning)
        self.states = states if learning else None
        return states @ self.head["o"] + self.head["d"]

    def gradients(self, x: np.ndarray) -> tuple[float, list[dict[str, np.ndarray]]]:
        off = self(x, learning=True) - x
        g = 2 * off / off.size
        head = {"o": np.einsum("bth,btf->hf", self.states, g), "d": g.sum((0, 1))}
        dec, fed, _ = self.dec.back(g @ self.head["o"].T)
        last = np.zeros_like(self.states)
        last[:, -1] = fed.sum(1)
        enc, _, _ = self.enc.back(last)
        return float((off**2).mean()), [enc, dec, head]


@dataclass
class Model:
    net: Autoencoder
    mean: np.ndarray
    std: np.ndarray
    threshold: float

    def errors(self, sequences: np.ndarray) -> np.ndarray:
        out = np.zeros(len(sequences))
        for k in range(0, len(out), SLICE):
            x = (np.asarray(sequences[k : k + SLICE], float) - self.mean) / self.std
            out[k : k + SLICE] = ((self.net(x) - x) ** 2).mean((1, 2))
        return out

    def dumped(self) -> bytes:
        out = io.BytesIO()
        arrays = {f"{i}{k}": v for i, p in enumerate(self.net.parts()) for k, v in p.items()}
        np.savez(out, mean=self.mean, std=self.std, threshold=self.threshold, hidden=self.net.enc.n, **arrays)
        return out.getvalue()

    @staticmethod
    def loaded(data: bytes) -> Model:
        f = np.load(io.BytesIO(data))
        net = Autoencoder(len(f["mean"]), int(f["hidden"]))
        for i, p in enumerate(net.parts()):
            for k in p:
                p[k] = f[f"{i}{k}"]
        return Model(net, f["mean"], f["std"], float(f["threshold"]))

    def info(self) -> dict[str, object]:
        data = self.dumped()
        return {"hidden": self.net.enc.n, "threshold": self.threshold, "sha256": hashlib.sha256(data).hexdigest(), "channels": len(self.mean)}


def train(sequences: np.ndarray, hidden: int = 8, epochs: int = 60, seed: int = 7, held: float = 0.2, patience: int = 8, rate: float = 1e-2, scale: tuple[np.ndarray, np.ndarray] | None = None) -> Model:
    """Adam with early stopping; scale (unless given) and threshold (99th percentile of errors) come from the training part alone."""
    x = np.asarray(sequences, float)
    order = np.random.default_rng(seed).permutation(len(x))
    cut = max(1, int(len(x) * held)) if len(x) > 1 else 0
    own, other = x[order[cut:]], x[order[:cut]] if cut else x
    mean, std = scale or scale_of(own)
    net = Autoencoder(x.shape[-1], hidden, seed)
    a, b = (own - mean) / std, (other - mean) / std
    first = [{k: np.zeros_like(v) for k, v in p.items()} for p in net.parts()]
    second = [{k: np.zeros_like(v) for k, v in p.items()} for p in net.parts()]
    best, kept, waited = np.inf, None, 0
    for step in range(1, epochs + 1):
        _, grads = net.gradients(a)
        for p, g, m, v in zip(net.parts(), grads, first, second, strict=True):
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        loss = float(((net(b) - b) ** 2).mean())
        if loss < best - 1e-6:
            best, kept, waited = loss, [{k: v.copy() for k, v in p.items()} for p in net.parts()], 0
        else:
            waited += 1
            if waited >= patience:
                break
    for p, k in zip(net.parts(), kept or net.parts(), strict=True):
        p.update(k)
    out = Model(net, mean, std, 0.0)
    out.threshold = float(np.quantile(out.errors(own), 0.99))
    return out


def pca_errors(features: np.ndarray, components: int = 4) -> np.ndarray:
    """Mean squared error of standardised features rebuilt from at most four principal components."""
    x = np.asarray(features, float)
    mean, std = scale_of(x)
    x = (x - mean) / std
    k = min(components, len(x) - 1, x.shape[1])
    if k < 1:
        return np.zeros(len(x))
    _, _, v = np.linalg.svd(x, full_matrices=False)
    return ((x - x @ v[:k].T @ v[:k]) ** 2).mean(1)


def isolation_scores(features: np.ndarray, trees: int = 200, sample: int = 256, seed: int = 0) -> np.ndarray:
    """Isolation forest: the sooner random cuts isolate a row, the nearer its score is to 1."""
    x = np.asarray(features, float)
    rng = np.random.default_rng(seed)
    m = min(sample, len(x))
    usual = lambda n: 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)
    depth = np.zeros(len(x))

    def grow(train: np.ndarray, rows: np.ndarray, level: int) -> None:
        low, high = train.min(0), train.max(0)
        open_ = np.flatnonzero(high > low)
        if len(train) <= 1 or level >= np.ceil(np.log2(max(m, 2))) or not len(open_):
            depth[rows] += level + usual(len(train))
            return
        c = rng.choice(open_)
        at = rng.uniform(low[c], high[c])
        left = x[rows, c] < at
        for t, r in ((train[train[:, c] < at], rows[left]), (train[train[:, c] >= at], rows[~left])):
            if len(r) and len(t):
                grow(t, r, level + 1)
            elif len(r):
                depth[r] += level + 1

    for _ in range(trees):
        grow(x[rng.choice(len(x), m, replace=False)], np.arange(len(x)), 0)
    return 2 ** (-depth / trees / max(usual(m), 1e-9))


def sample_of(sequences: DataFrame, most: int = MOST_TRACKS) -> np.ndarray:
    """At most ``most`` tracks' sequences (smallest hash of the id), in the order of the id."""
    rows = sequences.select("track_id", "sequence").orderBy(F.xxhash64("track_id"), "track_id").limit(most).collect()
    return np.array([r["sequence"] for r in sorted(rows, key=lambda r: r["track_id"])])


def scored(sequences: DataFrame, model: Model) -> DataFrame:
    """Sequences with ``error``."""
    held = sequences.sparkSession.sparkContext.broadcast(model.dumped())

    @F.arrow_udf("double")
    def error(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Model.loaded(held.value)
        for s in parts:
            x = s.flatten().flatten().to_numpy(zero_copy_only=False).reshape(len(s), -1, len(own.mean)) if len(s) else np.zeros((0, 1, len(own.mean)))
            yield pa.array(own.errors(x))

    return sequences.withColumn("error", error("sequence"))


def scale_over(sequences: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """``scale_of`` all sequences, in the cluster."""
    rows = sequences.select(F.explode("sequence").alias("x")).select(F.posexplode("x").alias("channel", "x"))
    got = rows.groupBy("channel").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std")).orderBy("channel").collect()
    std = np.array([r["std"] for r in got])
    return np.array([r["mean"] for r in got]), np.where(std < 1e-8, 1.0, std)


def fitted(sequences: DataFrame, epochs: int = 60, most: int = MOST_TRACKS, least: int = LEAST_TRACKS) -> Model | None:
    """A model with weights from at most ``most`` tracks, and scale and threshold from all; None with fewer than ``least``."""
    return fitted_to(kept(sequences.select("track_id", "sequence")), epochs, most, least)


def fitted_to(stored: DataFrame, epochs: int = 60, most: int = MOST_TRACKS, least: int = LEAST_TRACKS) -> Model | None:
    """``fitted`` to a table that is stored: it is read three times. Tracks are scored once for the threshold."""
    x = sample_of(stored, most)
    if len(x) < least:
        return None
    model = train(x, epochs=epochs, scale=scale_over(stored))
    model.threshold = float(quantiles(kept(scored(stored, model).select("error")), "error", [0.99])[0])
    return model


def save(model: Model, path: str | Path) -> str:
    """Writes a model to a file; its digest, to be pinned."""
    Path(path).write_bytes(data := model.dumped())
    return hashlib.sha256(data).hexdigest()


def load(path: str | Path, expected_sha256: str | None = None) -> Model | None:
    """The model of a file, None if there is no file. A file with another digest than the one pinned is an error."""
    if not Path(path).exists():
        return None
    data = Path(path).read_bytes()
    if expected_sha256 and hashlib.sha256(data).hexdigest() != expected_sha256:
        raise ValueError("the model isn't the one that is pinned")
    return Model.loaded(data)


def freeze(sequences: DataFrame, path: str | Path, least: int = 20, epochs: int = 60) -> dict[str, object]:
    """Fits a model and writes it; what was written. Fewer than ``least`` tracks are an error."""
    model = fitted(sequences, epochs, least=least)
    if model is None:
        raise ValueError(f"a model to keep needs at least {least} tracks")
    return {**model.info(), "sha256": save(model, path)}


def benchmark(sequences: DataFrame, seeds: tuple[int, ...] = (1, 2, 3, 4, 5), epochs: int = 60, most: int = MOST_TRACKS) -> dict[str, dict[str, float]]:
    """How stably each model ranks all tracks over several seeds. The recurrent ones are fitted on at most ``most`` tracks; a model without randomness repeats itself."""
    sequences = kept(sequences.select("track_id", "sequence", "features"))
    x = sample_of(sequences, most)
    pca = baselines.components(sequences)
    if pca is None:
        return {}
    scale = scale_over(sequences)
    runs = {
        "recurrent": [scored(sequences, train(x, epochs=epochs, seed=k, scale=scale)).select("track_id", F.col("error").alias("score")) for k in seeds],
        "isolation": [baselines.isolated(sequences, baselines.forest(sequences, seed=k)).select("track_id", "score") for k in seeds],
        "pca": [baselines.rebuilt(sequences, pca).select("track_id", F.col("error").alias("score"))] * len(seeds),
    }
    return {name: baselines.stability([kept(r) for r in own]) for name, own in runs.items()}


def detect(sequences: DataFrame, model: Model | None = None, epochs: int = 60) -> DataFrame:
    """Tracks whose error is above the model's threshold; none with fewer than five tracks to learn from."""
    if model is None:
        sequences = kept(sequences)  # tracks are derived once, to learn from and to score
        model = fitted_to(sequences, epochs)
        if model is None:
            sequences = sequences.where(F.lit(False))
            model = Model(Autoencoder(), np.zeros(5), np.ones(5), 1.0)
    odd = scored(sequences, model).where(F.col("error") > model.threshold)
    evidence = [F.col("error").alias("reconstruction_error"), F.lit(model.threshold).alias("population_threshold"), F.col("point_count"), F.lit("unusual shape is not intent").alias("caveat")]
    return incidents(
        odd, "anomaly", "AT-TRAJ-ANOMALY", "trajectory anomaly", evidence,
        incident_id=F.concat_ws(":", F.lit("anomaly"), "track_id"), track_id=F.col("track_id"),
        score=F.least(F.lit(1.0), 0.5 + 0.5 * (F.col("error") / F.lit(model.threshold) - 1)),
        reliability=F.when(F.col("point_count") >= 30, "C").otherwise("D"),
        start_us=F.col("start_us"), end_us=F.col("end_us"), lat=F.col("end_lat"), lon=F.col("end_lon"),
    )


def stability(runs: list[np.ndarray], k: int = 10) -> dict[str, float]:
    """How alike several seeds rank the same tracks: mean Spearman, mean overlap of the top k, mean p90/median."""
    ranks = [pd.Series(r).rank().to_numpy() for r in runs]
    pairs_ = [(i, j) for i in range(len(runs)) for j in range(i)]
    top = [set(np.argsort(-r, kind="stable")[:k]) for r in runs]
    return {
        "spearman": float(np.mean([np.corrcoef(ranks[i], ranks[j])[0, 1] for i, j in pairs_])) if pairs_ else 1.0,
        "top_overlap": float(np.mean([len(top[i] & top[j]) / len(top[i] | top[j]) for i, j in pairs_])) if pairs_ else 1.0,
        "separation": float(np.mean([np.quantile(r, 0.9) / max(np.median(r), 1e-12) for r in runs])),
    }


def score_track(points: list[dict[str, float]], model: Model, expected_sha256: str | None = None, s: Settings = DEFAULTS) -> dict[str, object]:
    """Score one ad-hoc track of points (t seconds, lat, lon, alt_ft) without stored state."""
    if not 2 <= len(points) <= s.score_track_max_points:
        raise ValueError(f"a track has 2 to {s.score_track_max_points} points")
    if expected_sha256 and model.info()["sha256"] != expected_sha256:
        raise ValueError("the model isn't the expected one")
    order = sorted(points, key=lambda p: p["t"])
    t = np.array([p["t"] for p in order], float)
    lat, lon = np.array([p["lat"] for p in order], float), np.array([p["lon"] for p in order], float)
    alt = np.array([p.get("alt_ft") or 0.0 for p in order], float) / 1000.0
    if len(np.unique(t)) != len(t):
        raise ValueError("times must differ")
    if not np.isfinite([t, lat, lon, alt]).all() or (np.abs(lat) > 90).any() or (np.abs(lon) > 180).any():
        raise ValueError("values out of range")
    error = float(model.errors(descriptor(resampled(t - t[0], lat, lon, alt, s.track_resample_points))[None])[0])
    return json.loads(json.dumps({"error": error, "threshold": model.threshold, "anomalous": error > model.threshold}))
