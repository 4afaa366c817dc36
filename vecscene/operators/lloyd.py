"""Full Lloyd rounds that skip distances by bounds.

Beside each row stands its label, an upper bound of the distance to that centroid and a lower bound of the distance to every other.  When
centroids move, the upper bound grows by the shift of the row's own and the lower one shrinks by the largest shift.  A row
whose upper bound is below its lower bound, or below half the distance from its centroid to the nearest other, keeps its label
without a distance; else its own distance is measured, and only if that does not settle it all of them are.  Labels
are those of plain rounds, ties included, as bounds that touch settle nothing.

A round is one pass: rows meet their state, and each task gives the new state and its partial sums.  Only the state (four
numbers a row) is written, so lineage does not grow with the rounds, and vectors are never moved.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..tables import Vectors, discard, written
from .kmeans import matrix, measured, pair_distances, summed, update

#: Rows (kind 0) and partial sums of a task (kind 1); n_distances is what the task has measured.
PASS = "kind int, key long, label int, upper double, lower double, k int, n long, sums array<double>, n_distances long"
#: What rounding may add to a bound, as a share of it.
SLACK = 1e-9
_CELLS = 1 << 20


@dataclass
class Round:
    centroids: np.ndarray
    counts: np.ndarray
    shift: float
    n_distances: int


def start(vectors: Vectors) -> DataFrame:
    """The state before the first round: nothing is known."""
    return vectors.rows.select("key", F.lit(-1).alias("label"), F.lit(float("inf")).alias("upper"), F.lit(0.0).alias("lower"))


def moved(x: np.ndarray, label: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: np.ndarray, shifts: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Labels and bounds under new centroids, and how many distances that took."""
    known = label >= 0
    own = np.maximum(label, 0)
    upper = np.where(known, (upper + shifts[own]) * (1 + SLACK), np.inf)
    lower = np.maximum(lower - shifts.max(initial=0.0), 0) * (1 - SLACK)
    label = label.copy()
    open_ = np.flatnonzero(~known | (upper >= np.maximum(lower, half[own])))
    tight = open_[known[open_]]
    upper[tight] = np.sqrt(measured(x, c, tight, label[tight])) * (1 + SLACK)
    n_distances = len(tight)
    open_ = open_[~known[open_] | (upper[open_] >= np.maximum(lower[open_], half[own[open_]]))]
    step = max(1, _CELLS // max(1, len(c)))
    for a in range(0, len(open_), step):
        at = open_[a : a + step]
        about, error = pair_distances(x[at], c)
        # those inside the error of the smallest are measured in difference form; the first of equals wins
        near, where = np.nonzero(about - error <= (about + error).min(1)[:, None])
        exact = np.full(about.shape, np.inf)
        exact[near, where] = measured(x, c, at[near], where)
        best = exact.argmin(1)
        rows = np.arange(len(at))
        label[at], upper[at] = best, np.sqrt(exact[rows, best]) * (1 + SLACK)
        low = np.maximum(about - error, 0)
        low[rows, best] = np.inf
        lower[at] = np.sqrt(low.min(1, initial=np.inf)) * (1 - SLACK)
        n_distances += about.size
    return label, upper, lower, n_distances


def _halves(c: np.ndarray) -> np.ndarray:
    """Half the distance from each centroid to the nearest other, rounded down."""
    if len(c) < 2:
        return np.full(len(c), np.inf)
    about, error = pair_distances(c, c)
    np.fill_diagonal(about, np.inf)
    return np.sqrt(np.maximum((about - error).min(1), 0)) / 2 * (1 - SLACK)


def _passing(c: np.ndarray, shifts: np.ndarray, context):
    shared = context.broadcast((np.asarray(c, np.float64), shifts, _halves(c)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, shifts, half = shared.value
        k, dim = c.shape
        sums, counts, total = np.zeros((k, dim)), np.zeros(k, np.int64), 0
        none = lambda n, t: pa.nulls(n, t)
        names = [x.split(" ")[0] for x in PASS.split(", ")]
        lists = pa.list_(pa.float64())
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            x = matrix(b.column("v"), dim)
            label, upper, lower, m = moved(x, *(b.column(f).to_numpy() for f in ("label", "upper", "lower")), c, shifts, half)
            total += m
            order = np.argsort(label, kind="stable")
            first = np.flatnonzero(np.append(True, label[order][1:] != label[order][:-1]))
            sums[label[order][first]] += np.add.reduceat(x[order], first, axis=0)
            counts += np.bincount(label, minlength=k)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), b.column("key"), pa.array(label.astype(np.int32)), pa.array(upper), pa.array(lower), none(n, pa.int32()), none(n, pa.int64()), none(n, lists), none(n, pa.int64())], names)
        at = np.flatnonzero(counts)
        n = len(at)
        if n or total:
            own = np.zeros(n, np.int64)
            own[:1] = total
            told = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dim, pa.int32()), pa.array(sums[at].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), none(n, pa.int64()), none(n, pa.int32()), none(n, pa.float64()), none(n, pa.float64()), pa.array(at.astype(np.int32)), pa.array(counts[at]), told, pa.array(own)], names)

    return run


def step(vectors: Vectors, state: DataFrame, c: np.ndarray, shifts: np.ndarray) -> tuple[DataFrame, np.ndarray, np.ndarray, int]:
    """State under centroids c that have moved by `shifts`, sums and counts of its labels, and distances measured."""
    rows = vectors.with_state(state).select("key", "v", "label", "upper", "lower")
    table = written(rows.mapInArrow(_passing(c, shifts, state.sparkSession.sparkContext), PASS))
    new = table.where("kind = 0").select("key", "label", "upper", "lower")
    new.table_path = table.table_path
    parts = table.where("kind = 1")
    sums, counts = np.zeros_like(c, dtype=np.float64), np.zeros(len(c), np.int64)
    for r in summed(parts.select("k", "n", "sums"), "k").collect():  # K rows
        sums[r["k"]], counts[r["k"]] = r["sums"], r["n"]
    return new, sums, counts, parts.agg(F.sum("n_distances")).first()[0] or 0


def rounds(vectors: Vectors, c: np.ndarray, max_iter: int = 100, tol: float = 1e-4, spare=None) -> tuple[np.ndarray, DataFrame, list[Round]]:
    """Centroids after full rounds, the state whose labels gave them, and what each round did.

    A round ends the rest when its summed squared shift is below tol.  spare(i, n) gives up to n rows in the place of empty centroids in
    round i; without it they are zero, as the mean of nothing.  The caller discards the state.
    """
    state, shifts, done = start(vectors), np.zeros(len(c)), []
    for i in range(max_iter):
        new, sums, counts, n_distances = step(vectors, state, c, shifts)
        discard(state)
        state, means = new, update(sums, counts)
        empty = np.flatnonzero(counts == 0)
        if len(empty) and spare:
            rows = spare(i, len(empty))
            means[empty[: len(rows)]] = rows
        moves = ((means - c) ** 2).sum(1)
        c, shifts = means, np.sqrt(moves) * (1 + SLACK)
        done.append(Round(c, counts, float(moves.sum()), n_distances))
        if done[-1].shift < tol:
            break
    return c, state, done


def labels(vectors: Vectors, state: DataFrame) -> DataFrame:
    """row_id, label of a state."""
    return vectors.with_state(state).select("row_id", "label")
