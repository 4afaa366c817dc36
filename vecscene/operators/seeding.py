"""K-means|| seeding: a few passes, whatever the number of clusters.

Each pass moves the running minimum that is kept beside each row (squared distance to the nearest candidate, and which one)
by the candidates of the pass before, and draws about `oversample` x K further ones, each row with probability in proportion to its
minimum.  What is left is small: some K candidates for each pass, with the number of rows nearest to each.  They are reduced to K on
the driver by weighted K-Means++ and weighted Lloyd steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..tables import Vectors, discard, written
from .kmeans import matrix, nearest, pair_distances, squared_distances
from .sampling import BITS, draw

#: Passes that draw, candidates drawn in each as a multiple of K; seedings and Lloyd steps over the candidates.
ROUNDS, OVERSAMPLE, RESTARTS, POLISH = 4, 2.0, 3, 10
STATE = "key long, d2 double, label int"


def start(vectors: Vectors) -> DataFrame:
    """The state before the first candidate."""
    return vectors.rows.select("key", F.lit(float("inf")).alias("d2"), F.lit(-1).alias("label"))


def nearer(vectors: Vectors, state: DataFrame, seeds: np.ndarray, base: int = 0) -> DataFrame:
    """The state moved by new seeds, numbered from base; equal distances keep the earlier seed.  Distances to earlier seeds are not
    computed again."""
    shared = state.sparkSession.sparkContext.broadcast(np.asarray(seeds, np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            label, d = nearest(matrix(b.column("v"), shared.value.shape[1]), shared.value)
            was = b.column("d2").to_numpy()
            new = d < was
            yield pa.RecordBatch.from_pydict({"key": b.column("key"), "d2": np.where(new, d, was), "label": np.where(new, label + base, b.column("label").to_numpy()).astype(np.int32)})

    return vectors.with_state(state).select("key", "v", "d2", "label").mapInArrow(run, STATE)


def oversampled(vectors: Vectors, state: DataFrame, expected: float, number: Column) -> DataFrame:
    """row_id, v of the rows drawn: number (from 0 to 1) < expected x d2 / sum of d2."""
    total = state.agg(F.sum("d2")).first()[0] or 0.0
    drawn = state.where(F.col("d2") > 0).select("key", "d2")
    return vectors.with_state(drawn).where(number * total < F.col("d2") * expected).select("row_id", "v") if total > 0 else vectors.rows.select("row_id", "v").limit(0)


def _collected(rows: DataFrame) -> np.ndarray:
    """Vectors in order of row_id."""
    found = sorted(rows.collect(), key=lambda r: r["row_id"])
    return np.nan_to_num(np.array([r["v"] for r in found], np.float64), nan=0.0, posinf=0.0, neginf=0.0)


def weighted_plus_plus(x: np.ndarray, w: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Greedy K-Means++ over few rows with weights: each step draws some rows and takes the one that leaves least; fewer than k
    where there are fewer distinct rows."""
    at = [int(rng.choice(len(x), p=w / w.sum()))]
    d = squared_distances(x, x[at])[:, 0]
    tries = 2 + int(np.log(k))
    while len(at) < k and (d * w).sum() > 0:
        drawn = rng.choice(len(x), size=tries, p=d * w / (d * w).sum())
        left = np.minimum(d[:, None], np.maximum(pair_distances(x, x[drawn])[0], 0))
        at.append(int(drawn[(left * w[:, None]).sum(0).argmin()]))
        d = np.minimum(d, squared_distances(x, x[at[-1:]])[:, 0])
    return x[at]


def reduced(x: np.ndarray, w: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k centroids of weighted candidates: the best of RESTARTS weighted seedings with weighted Lloyd steps; an empty cluster stays
    where it is."""
    best = (np.inf, None)
    for restart in range(RESTARTS):
        c = weighted_plus_plus(x, w, k, np.random.default_rng([seed, restart]))
        for _ in range(POLISH):
            label, _ = nearest(x, c)
            n = np.bincount(label, w, minlength=len(c))
            sums = np.zeros_like(c)
            np.add.at(sums, label, x * w[:, None])
            new = np.where(n[:, None] > 0, sums / np.maximum(n, 1e-300)[:, None], c)
            if np.allclose(new, c):
                break
            c = new
        inertia = float((nearest(x, c)[1] * w).sum())
        if best[1] is None or inertia < best[0]:
            best = (inertia, c)
    return best[1]


def parallel(df: DataFrame, k: int, seed: int = 42, rounds: int = ROUNDS, oversample: float = OVERSAMPLE, vectors: Vectors | None = None) -> np.ndarray:
    """k seeds, or as many as there are distinct rows, in 2 rounds + 2 passes over the vectors."""
    own = vectors is None
    vectors = vectors or Vectors(df)
    try:
        number = (draw(seed, 0) + F.lit(0.5)) / F.lit(float(1 << BITS))
        first = vectors.rows.select(F.min_by(F.struct("row_id", "v"), F.struct(number, "row_id")).alias("x")).select("x.*")
        seeds = _collected(first)
        candidates, state = [seeds], start(vectors)
        base = 0
        for step in range(1, rounds + 1):
            new = written(nearer(vectors, state, seeds, base))
            discard(state)
            state, base = new, base + len(seeds)
            number = (draw(seed, step) + F.lit(0.5)) / F.lit(float(1 << BITS))
            seeds = _collected(oversampled(vectors, state, oversample * k, number))  # about oversample x k rows
            if not len(seeds):
                break
            candidates.append(seeds)
        if len(seeds):
            new = written(nearer(vectors, state, seeds, base))
            discard(state)
            state = new
        weight = np.zeros(sum(map(len, candidates)))
        for r in state.groupBy("label").count().collect():  # a row for each candidate
            weight[r["label"]] = r["count"]
        discard(state)
        x = np.concatenate(candidates)
        return reduced(x[weight > 0], weight[weight > 0], k, seed)
    finally:
        if own:
            vectors.release()
