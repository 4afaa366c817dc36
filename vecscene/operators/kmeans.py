"""K-Means over a frame of (row_id, v).  Centroids are K x D numbers (K is a parameter) and go out as one broadcast block;
rows never leave their partition: each task gives partial sums per centroid, and Spark adds those up."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .sampling import BITS, draw, sample

#: Cells of the distance matrix computed at once in a task.
_CELLS = 1 << 21
#: Rows of a partition that a fit keeps.
PART = 8192


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors of a list column; numbers that are not finite count as zero, so that they can neither win nor spread."""
    flat = column.flatten() if isinstance(column, (pa.ListArray, pa.LargeListArray)) else pa.array([])
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if not np.isfinite(x.sum()):  # else there is nothing to replace, and the column's own memory is read
        x = np.nan_to_num(x, nan=0.0, posinf=0.0, neginf=0.0)
    return x.reshape(-1, dim)


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Difference form, in blocks of rows."""
    out = np.empty((len(x), len(c)))
    step = max(1, _CELLS // max(1, c.size))
    for a in range(0, len(x), step):
        d = x[a : a + step, None, :] - c[None]
        out[a : a + step] = np.einsum("nkd,nkd->nk", d, d)
    return out


def pair_distances(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by one matrix product, and a bound of the error of each: one long vector makes no other pair vague."""
    a, b = np.einsum("nd,nd->n", x, x), np.einsum("nd,nd->n", c, c)
    whole = a[:, None] + b
    about = x @ c.T
    about *= -2
    about += whole
    whole *= 1e-15 * (x.shape[1] + 8)
    return about, whole


def measured(x: np.ndarray, c: np.ndarray, r: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Squared distances of pairs in difference form, in blocks of pairs."""
    out = np.empty(len(r))
    step = max(1, _CELLS // max(1, x.shape[1]))
    for a in range(0, len(r), step):
        d = x[r[a : a + step]] - c[k[a : a + step]]
        out[a : a + step] = np.einsum("nd,nd->n", d, d)
    return out


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest row of c (the lowest among equals) and its squared distance in difference form."""
    label = np.zeros(len(x), np.int64)
    step = max(1, _CELLS // max(1, len(c)))
    for a in range(0, len(x), step):
        part = x[a : a + step]
        about, error = pair_distances(part, c)
        close = about - error <= (about + error).min(1)[:, None]
        best = close.argmax(1)
        # where several are inside the error, just those are measured
        several = np.flatnonzero(close.sum(1) > 1)
        if len(several):
            r, k = np.nonzero(close[several])
            exact = np.full((len(several), len(c)), np.inf)
            exact[r, k] = measured(part, c, several[r], k)
            best[several] = exact.argmin(1)
        label[a : a + step] = best
    return label, measured(x, c, np.arange(len(x)), label)


def _broadcast(df: DataFrame, c: np.ndarray):
    return df.sparkSession.sparkContext.broadcast(np.asarray(c, np.float64))


def labelled(df: DataFrame, centroids: np.ndarray, *columns: str) -> DataFrame:
    """The columns, label (nearest centroid, the lowest among equals) and d2, in one pass."""
    shared = _broadcast(df, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for b in batches:
            k, d = nearest(matrix(b.column("v"), c.shape[1]), c)
            yield pa.RecordBatch.from_arrays([*[b.column(x) for x in columns], pa.array(k.astype(np.int32)), pa.array(d)], [*columns, "label", "d2"])

    rows = df.select(*dict.fromkeys([*columns, "v"]))
    schema = rows.select(*columns).schema.add("label", "integer").add("d2", "double")
    return rows.mapInArrow(run, schema)


def assign(df: DataFrame, centroids: np.ndarray) -> DataFrame:
    """row_id, label, d2."""
    return labelled(df, centroids, "row_id")


def distances(df: DataFrame, centroids: np.ndarray) -> DataFrame:
    """row_id, k, distance for every centroid."""
    shared = _broadcast(df, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for b in batches:
            d = np.sqrt(squared_distances(matrix(b.column("v"), c.shape[1]), c))
            ids = b.column("row_id").to_numpy()
            yield pa.RecordBatch.from_pydict({"row_id": np.repeat(ids, len(c)), "k": np.tile(np.arange(len(c), dtype=np.int32), len(ids)), "distance": d.ravel()})

    return df.select("row_id", "v").mapInArrow(run, "row_id long, k int, distance double")


def summed(parts: DataFrame, *keys: str) -> DataFrame:
    """The keys (int), n and sums of rows added up by key: a stream of sorted rows, so a key may have any number of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            key, n = np.stack([b.column(k).to_numpy() for k in keys], 1), b.column("n").to_numpy()
            x = b.column("sums").flatten().to_numpy(zero_copy_only=False).reshape(len(n), -1)
            first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1)))
            key, n, x = key[first], np.add.reduceat(n, first), np.add.reduceat(x, first, axis=0)
            if held is not None:
                if (key[0] == held[0][0]).all():
                    n[0] += held[1][0]
                    x[0] += held[2][0]
                else:
                    yield record(*held)
            if len(n) > 1:
                yield record(key[:-1], n[:-1], x[:-1])
            held = (key[-1:].copy(), n[-1:].copy(), x[-1:].copy())
        if held is not None:
            yield record(*held)

    def record(key: np.ndarray, n: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
        return pa.RecordBatch.from_arrays([*[pa.array(key[:, i].astype(np.int32)) for i in range(len(keys))], pa.array(n), lists], [*keys, "n", "sums"])

    sorted_ = parts.select(*keys, "n", "sums").repartition(*keys).sortWithinPartitions(*keys)
    return sorted_.mapInArrow(run, ", ".join(f"{k} int" for k in keys) + ", n long, sums array<double>")


def partial_sums(df: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Sums (K, D), counts (K) and inertia under the nearest centroids: a row per task and centroid is what Spark shuffles."""
    shared = _broadcast(df, centroids)
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        sums, counts, inertia = np.zeros((k, dim)), np.zeros(k, np.int64), np.zeros(k)
        for b in batches:
            x = matrix(b.column("v"), dim)
            if len(x):
                label, d = nearest(x, c)
                np.add.at(sums, label, x)
                counts += np.bincount(label, minlength=k)
                inertia += np.bincount(label, d, minlength=k)
        # inertia goes as one more number behind each sum
        yield pa.RecordBatch.from_pydict({"k": np.arange(k, dtype=np.int32), "n": counts, "sums": pa.array(list(np.column_stack([sums, inertia])), pa.list_(pa.float64()))})

    rows = summed(df.select("v").mapInArrow(run, "k int, n long, sums array<double>"), "k").collect()  # K rows
    sums, counts = np.zeros((k, dim + 1)), np.zeros(k, np.int64)
    for r in rows:
        sums[r["k"]], counts[r["k"]] = r["sums"], r["n"]
    return sums[:, :dim], counts, float(sums[:, dim].sum())


def update(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Means; an empty cluster's is zero."""
    return sums / np.maximum(counts, 1)[:, None]


def minibatch_update(centroids: np.ndarray, counts: np.ndarray, sums: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One round of per-sample steps with rate 1 / count has a closed form: a running mean, in any order."""
    return (counts[:, None] * centroids + sums) / (counts + n)[:, None], counts + n


def batch_mean_update(centroids: np.ndarray, counts: np.ndarray, sums: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One step of rate 1 / count towards the batch's mean; clusters without samples stay."""
    rate = np.where(n > 0, 1 / (counts + n), 0.0)[:, None]
    return (1 - rate) * centroids + rate * update(sums, n), counts + n


def _draw(seed: int, *salt: int):
    """A number in (0, 1) for each row_id, the same for any partitioning."""
    return (draw(seed, *salt) + F.lit(0.5)) / F.lit(float(1 << BITS))


def plus_plus(df: DataFrame, k: int, seed: int = 42) -> np.ndarray:
    """K-Means++ seeds: the first by chance, each next with probability in proportion to its squared distance.

    The weighted draw is an exponential race (smallest -ln(u) / d2), in one pass without a shuffle of vectors: each task
    gives its own winner.  Should all distances be zero, any row will do.
    """
    first = df.select(F.min_by("v", _draw(seed)).alias("v")).first()["v"]
    chosen = np.nan_to_num(np.array([first], np.float64), nan=0.0, posinf=0.0, neginf=0.0)
    for step in range(1, k):
        shared = _broadcast(df, chosen)

        def race(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best = None
            for b in batches:
                x, u = matrix(b.column("v"), shared.value.shape[1]), b.column("u").to_numpy()
                if len(x):
                    d = nearest(x, shared.value)[1]
                    with np.errstate(divide="ignore"):
                        time = np.where(d > 0, -np.log(u) / d, np.inf)
                    i = np.lexsort((u, time))[0]
                    best = min([(time[i], u[i], x[i])] + ([best] if best else []), key=lambda t: t[:2])
            if best:
                yield pa.RecordBatch.from_pydict({"race": [best[0]], "u": [best[1]], "v": [best[2].tolist()]})

        won = df.select("v", _draw(seed, step).alias("u")).mapInArrow(race, "race double, u double, v array<double>")
        chosen = np.vstack([chosen, won.select(F.min_by("v", F.struct("race", "u")).alias("v")).first()["v"]])
    return chosen


def weighted_pick(df: DataFrame, weight: str, r: float) -> DataFrame:
    """The row_id at which the running sum of weights, in order of row_id, first reaches the share r of the whole (else the last).

    Running sums are of ranges of ids first and then inside the one range where the share is reached, so no task sorts all rows.
    """
    rows = df.select("row_id", F.col(weight).cast("double").alias("w"), F.shiftright("row_id", 12).alias("range"))
    ranges = rows.groupBy("range").agg(F.sum("w").alias("w"))
    upto = F.sum("w").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0))
    ranges = ranges.withColumn("upto", upto).withColumn("target", F.lit(r) * F.max("upto").over(Window.partitionBy()))
    at = ranges.agg(F.coalesce(F.min(F.when(F.col("upto") >= F.col("target"), F.col("range"))), F.max("range")).alias("range"))
    inside = rows.join(F.broadcast(ranges.join(at, "range").select("range", (F.col("upto") - F.col("w")).alias("before"), "target")), "range")
    run = F.col("before") + F.sum("w").over(Window.partitionBy("range").orderBy("row_id").rowsBetween(Window.unboundedPreceding, 0))
    return inside.withColumn("run", run).agg(F.coalesce(F.min(F.when(F.col("run") >= F.col("target"), F.col("row_id"))), F.max("row_id")).alias("row_id"))


def scalars(df: DataFrame) -> DataFrame:
    """df with v as an array: numbers become vectors of one number."""
    kind = df.schema["v"].dataType.typeName()
    return df if kind == "array" else df.withColumn("v", F.array(F.col("v").cast("double")))


def _rows_of(df: DataFrame) -> np.ndarray:
    """The vectors of few rows."""
    return np.nan_to_num(np.array([r["v"] for r in df.select("v").collect()], np.float64), nan=0.0, posinf=0.0, neginf=0.0)


class KMeans:
    """fit, predict, fit_predict and transform; mini-batch (default) or full updates.

    init is "k-means||" (a few passes) or "k-means++" (a pass for each cluster).  Full rounds skip distances by bounds;
    n_distances_ is how many they have measured.
    """

    def __init__(self, n_clusters: int = 100, batch_size: int = 1000, max_iter: int = 100, random_state: int = 42, use_mini_batch: bool = True, tol: float = 1e-4, update: str = "per_sample", init: str = "k-means||"):
        if init not in ("k-means||", "k-means++"):
            raise ValueError("init is 'k-means||' or 'k-means++'")
        self.init, self.n_distances_ = init, 0
        self.n_clusters, self.batch_size, self.max_iter, self.random_state = n_clusters, batch_size, max_iter, random_state
        self.use_mini_batch, self.tol, self.update = use_mini_batch, tol, update
        self.centroids_: np.ndarray | None = None
        self.inertia_: float | None = None
        self.n_iter_ = 0

    def fit(self, df: DataFrame) -> KMeans:
        from . import lloyd, seeding
        from ..tables import Vectors, discard

        n = df.count()
        if not n:
            raise ValueError("no rows to fit")
        # by its rows, as each round passes over every partition several times
        vectors = Vectors(scalars(df).select("row_id", "v"), max(df.sparkSession.sparkContext.defaultParallelism, -(-n // PART)))
        df = vectors.rows.select("row_id", "v")
        try:
            k = min(self.n_clusters, n)
            c = plus_plus(df, k, self.random_state) if self.init == "k-means++" else seeding.parallel(df, k, self.random_state, vectors=vectors)
            if len(c) < k:  # fewer distinct rows than clusters
                c = np.concatenate([c, _rows_of(sample(df, k - len(c), self.random_state, 9))])
            if self.use_mini_batch:
                step, counts = (minibatch_update if self.update == "per_sample" else batch_mean_update), np.ones(k, np.int64)
                for i in range(self.max_iter):
                    batch = df if n <= self.batch_size else sample(df, self.batch_size, self.random_state, 1000 + i)
                    sums, m, _ = partial_sums(batch, c)
                    c, counts = step(c, counts, sums, m)
                    self.n_iter_ = i + 1
            else:
                spare = lambda i, m: _rows_of(sample(df, m, self.random_state, 5000 + i))
                c, state, done = lloyd.rounds(vectors, c, self.max_iter, self.tol, spare)
                discard(state)
                self.n_iter_, self.n_distances_ = len(done), sum(r.n_distances for r in done)
            self.centroids_ = c
            self.inertia_ = partial_sums(df, c)[2]
        finally:
            vectors.release()
        return self

    def _fitted(self) -> np.ndarray:
        if self.centroids_ is None:
            raise RuntimeError("Must call fit() first")
        return self.centroids_

    def predict(self, df: DataFrame) -> DataFrame:
        return assign(scalars(df), self._fitted()).select("row_id", "label")

    def fit_predict(self, df: DataFrame) -> DataFrame:
        return self.fit(df).predict(df)

    def transform(self, df: DataFrame) -> DataFrame:
        return distances(scalars(df), self._fitted())


#: Another name of the same class.
KMeansJIT = KMeans
