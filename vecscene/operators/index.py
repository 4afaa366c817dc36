"""The splat index: encode, cluster coarsely and finely, store by coarse cluster, and answer queries."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..functions.encoding import ColorModel, EmbeddingModel, PositionModel
from ..sources.splats import SPREAD
from ..tables import discard, written
from . import search
from .kmeans import KMeans, labelled, matrix, nearest, summed
from .ranks import places
from .sampling import sample

#: Rows of a coarse cluster that one task clusters finely.
SHARE = 4096
#: Bytes of fine centroids that go out at once.
FINE_BYTES = 32 << 20
#: Rounds of the K-Means inside a coarse cluster.
FINE_ROUNDS = 3
#: Rows that the coarse K-Means is fitted on, and rows for each fine centroid that a fine one is: samples by hash, of a size that
#: does not grow with the rows.  All rows are labelled and stored.
FIT_ROWS, FIT_FINE = 1 << 16, 64
#: Rows of the sample that a first search looks at.
FIRST_ROWS = 1 << 16
#: What an embedding is made of.
ENCODED = ("position", "color", "opacity", "scale", "rotation")


@dataclass
class IndexConfig:
    n_coarse: int = 100
    n_fine: int = 1000
    n_probe: int = 5
    batch_size: int = 10000
    random_state: int = 42
    mode: str = "ivf"
    max_iter: int = 10


@dataclass
class IndexStats:
    n_splats: int = 0
    n_coarse_clusters: int = 0
    n_fine_clusters: int = 0
    build_seconds: float = 0.0
    n_queries: int = 0
    mean_query_seconds: float = 0.0


def coarse_clamp(n_coarse: int, n: int) -> int:
    return max(1, min(n_coarse, n // 10))


def fine_clamp(n_fine: int, size: int) -> int:
    return max(1, min(n_fine, size // 5))


def fine_fit(index: DataFrame, n_fine: int, seed: int = 42, rounds: int = FINE_ROUNDS, made: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """K-Means inside each coarse cluster of rows (row_id, coarse, v): the centroids (coarse, fine, c), and the sizes (coarse,
    size, n_fine, salts).  The caller discards both.  made, if given, makes v of rows that lack it, once they are drawn and dealt out.

    A cluster of n rows gets fine_clamp(n_fine, n) centroids, first the rows of lowest hash, and is fitted on FIT_FINE times as many
    rows of lowest hash, or all.  In each round every group of rows gives sums for each centroid, which Spark adds up; a
    centroid without rows stays.  A cluster is dealt out in groups of SHARE rows, each with its own copy of the
    centroids, so that a large cluster is never one task; the rows are shuffled once for all rounds, and the centroids of a
    round are written, so lineage does not grow.
    """
    sizes = written(index.groupBy("coarse").agg(F.count("*").alias("size")).select("coarse", "size", F.greatest(F.lit(1), F.least(F.lit(n_fine), F.floor(F.col("size") / 5))).alias("n_fine"), F.ceil(F.col("size") / SHARE).alias("salts")))
    # ranks carry no vectors, and no task ranks a whole cluster
    keyed = index.select("coarse", F.struct(F.xxhash64("row_id", F.lit(seed)).alias("h"), "row_id").alias("h"))
    seats = places(keyed, "coarse", "h", "fine")
    drawn = seats.join(F.broadcast(sizes), "coarse").where(F.col("fine") < FIT_FINE * F.col("n_fine"))  # a row for each cluster
    drawn = written(drawn.select(F.col("h.row_id").alias("row_id"), "coarse", F.col("fine").cast("int").alias("fine"), (F.col("fine") < F.col("n_fine")).alias("first")))
    discard(seats)
    fitted = drawn.groupBy("coarse").agg(F.ceil(F.count("*") / SHARE).alias("salts"))
    rows = index.join(drawn, ["row_id", "coarse"]).join(F.broadcast(fitted), "coarse")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("row_id", F.lit(seed)), "salts")).repartition("coarse", "salt")
    rows = (made(rows) if made else rows).select("row_id", "coarse", "v", "fine", "first", "salt").persist()
    centroids = written(rows.where("first").select("coarse", "fine", F.col("v").alias("c")))

    def sums(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["coarse", "fine", "n", "sums"]
        if left.empty or right.empty:
            return pd.DataFrame({x: [] for x in names})
        right = right.sort_values("c_fine")
        x, c = np.nan_to_num(np.stack(left["v"])), np.stack(right["c"])
        label = nearest(x, c)[0]
        total = np.zeros(c.shape)
        np.add.at(total, label, x)
        n = np.bincount(label, minlength=len(c))
        return pd.DataFrame({"coarse": right["c_coarse"].to_numpy(), "fine": right["c_fine"].to_numpy(), "n": n, "sums": list(total)})

    for _ in range(rounds):
        parts = rows.select("coarse", "salt", "v").groupBy("coarse", "salt").cogroup(_copies(centroids, fitted).groupBy("c_coarse", "c_salt")).applyInPandas(sums, "coarse int, fine int, n long, sums array<double>")
        added = summed(parts, "coarse", "fine")
        new = written(centroids.join(added, ["coarse", "fine"], "left").select("coarse", "fine", F.when(F.col("n") > 0, F.transform("sums", lambda x: x / F.col("n"))).otherwise(F.col("c")).alias("c")))
        discard(centroids)
        centroids = new
    rows.unpersist()
    discard(drawn)
    return centroids, sizes


def _copies(centroids: DataFrame, sizes: DataFrame) -> DataFrame:
    """The centroids of a cluster once for each group of its rows."""
    return centroids.join(F.broadcast(sizes), "coarse").select("coarse", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), "fine", "c").toDF("c_coarse", "c_salt", "c_fine", "c")


def _fine_blocks(centroids: DataFrame, sizes: DataFrame) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray]]]:
    """The fine centroids and their numbers by coarse cluster, of as many clusters at once as FINE_BYTES hold."""
    found = sorted((r["coarse"], r["n_fine"]) for r in sizes.collect())  # a row for each cluster
    wide = 8 * len(centroids.first()["c"]) if found else 0
    while found:
        upto = np.cumsum([n * wide for _, n in found])
        block, found = (found[: (cut := max(1, int(np.searchsorted(upto, FINE_BYTES, side="right"))))], found[cut:])
        t = centroids.where(F.col("coarse").between(block[0][0], block[-1][0])).select("coarse", "fine", "c").toArrow().sort_by([("coarse", "ascending"), ("fine", "ascending")])
        coarse, fine, c = t.column("coarse").to_numpy(), t.column("fine").to_numpy(), matrix(t.column("c").combine_chunks(), wide // 8)
        edge = {k: np.searchsorted(coarse, [k, k + 1]) for k, _ in block}
        yield {k: (fine[a:b], c[a:b]) for k, (a, b) in edge.items()}


def fine_labels(index: DataFrame, n_fine: int, seed: int = 42, rounds: int = FINE_ROUNDS, made: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The columns of index and fine, the nearest fine centroid of each row's own coarse cluster, with norm_sq: a table stored by
    coarse cluster and sorted by norm_sq inside, of which nothing stays persisted.

    made, if given, makes v of rows that lack it; such rows are dealt out, shuffled and stored as they are, and v is only made to be
    looked at.  Centroids go out in blocks of clusters, and each block labels its own rows.
    """
    centroids, sizes = fine_fit(index, n_fine, seed, rounds, made)
    columns, spark = index.columns, index.sparkSession
    schema = index.schema.add("norm_sq", "double").add("fine", "integer")

    def label(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                coarse = b.column("coarse").to_numpy()
                x = matrix(b.column("v"), next(iter(block.value.values()))[1].shape[1])
                fine, order = np.zeros(len(x), np.int32), np.argsort(coarse, kind="stable")
                for rows in np.split(order, np.flatnonzero(np.diff(coarse[order])) + 1):
                    name, c = block.value[int(coarse[rows[0]])]
                    fine[rows] = name[nearest(x[rows], c)[0]]
                yield pa.RecordBatch.from_arrays([*[b.column(k) for k in columns], pa.array(np.einsum("nd,nd->n", x, x)), pa.array(fine)], [*columns, "norm_sq", "fine"])

        return run

    try:
        n = sizes.agg(F.sum("size")).first()[0] or 0
        parts = max(spark.sparkContext.defaultParallelism, -(-n // SPREAD))
        out = None
        for block in _fine_blocks(centroids, sizes):
            rows = index.where(F.col("coarse").between(min(block), max(block)))
            rows = made(rows.repartition(parts, "row_id")) if made else rows
            part = rows.mapInArrow(label(spark.sparkContext.broadcast(block)), schema)
            out = part if out is None else out.unionByName(part)
        out = spark.createDataFrame([], schema) if out is None else out
        out = out.join(F.broadcast(sizes.select("coarse", "salts")), "coarse").withColumn("salt", F.pmod(F.xxhash64("row_id", F.lit(seed)), "salts"))  # a row for each cluster
        out = out.repartition(parts, "coarse", "salt").select(*schema.names)
        return written(out.sortWithinPartitions("coarse", "norm_sq"), "coarse")
    finally:
        discard(centroids, sizes)


def members(index: DataFrame) -> DataFrame:
    """row_id, coarse, place: the place of each row among those of its cluster, in order of row_id from 0."""
    return places(index, "coarse", "row_id").select("row_id", "coarse", F.col("place").cast("int").alias("place"))


@dataclass
class SplatIndex:
    """add_splats, build, query, batch_query, query_with_details, get, members, save and load.

    The built table has row_id, id, v, norm_sq, fine and coarse.  What v is made of is written by coarse cluster in the shared
    folder, with the labels, and deleted by clear or the next build; v, some forty times as wide, is made where it is read, and
    written by save alone.  Queries are not run before their results are used: stats are of what has been run.
    """

    spark: SparkSession
    config: IndexConfig = field(default_factory=IndexConfig)
    built: IndexStats = field(default_factory=IndexStats)
    splats: DataFrame | None = None
    model: EmbeddingModel | None = None
    centroids: np.ndarray | None = None
    table: DataFrame | None = None
    basis: search.Basis | None = None
    asked: list = field(default_factory=list)

    def add_splats(self, splats: DataFrame) -> None:
        self.splats = splats if self.splats is None else self.splats.unionByName(splats, allowMissingColumns=True)
        self.release()

    def build(self) -> float:
        """Seconds; 0.0 and no index where there are no splats."""
        began = time.time()
        if self.splats is None:
            return 0.0
        self.release()
        splats = written(self.splats.select(F.col("id").alias("row_id"), "id", *ENCODED))
        n = splats.count()
        if not n:
            discard(splats)
            return 0.0
        self.model = EmbeddingModel.fit(splats)
        parts = max(self.spark.sparkContext.defaultParallelism, -(-n // SPREAD))
        drawn = written(sample(splats, FIT_ROWS, self.config.random_state))  # drawn and dealt out before they are made wide
        wide = self._made(drawn.repartition(self.spark.sparkContext.defaultParallelism, "row_id")).select("row_id", "v")
        fit = KMeans(coarse_clamp(self.config.n_coarse, n), self.config.batch_size, self.config.max_iter, self.config.random_state).fit(wide)
        self.centroids, self.basis = fit.centroids_, search.Basis.of(wide, self.config.random_state)
        rows = written(labelled(self._made(splats.repartition(parts, "row_id")), self.centroids, *splats.columns).withColumnRenamed("label", "coarse").drop("d2"))
        stored = fine_labels(rows, self.config.n_fine, self.config.random_state, made=self._made)
        discard(splats, drawn, rows)
        self.table = self._made(stored).select("row_id", "id", "v", "norm_sq", "fine", "coarse")
        self.table.table_path = stored.table_path
        fine = stored.groupBy("coarse").agg(F.count_distinct("fine").alias("fine")).agg(F.count("*").alias("coarse"), F.sum("fine").alias("fine")).first()
        self.built = IndexStats(n, fine["coarse"], fine["fine"], build_seconds=time.time() - began)
        return self.built.build_seconds

    def _made(self, rows: DataFrame) -> DataFrame:
        """rows with v, made of their other columns."""
        return self.model.transform(rows).withColumnRenamed("embedding", "v")

    @property
    def stats(self) -> IndexStats:
        """Figures of the build, and of the batches of queries whose results have been made: a batch counts once, by its
        first run; its time is that of the call and from its first search task to its last."""
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)  # what has been run is told by events
        took = [call + (told["seconds"] or 0.0) for call, told in ((call, _told(watch)) for call, watch in self.asked) if told is not None]
        return replace(self.built, n_queries=len(took), mean_query_seconds=sum(took) / len(took) if took else 0.0)

    def _ready(self) -> DataFrame:
        if self.table is None:
            raise RuntimeError("Index not built. Call build() first.")
        return self.table

    def encode(self, splats: DataFrame) -> DataFrame:
        """qid, v of splats under the bounds and colour range of this index."""
        self._ready()
        return self.model.transform(splats).select(F.col("id").alias("qid"), F.col("embedding").alias("v"))

    def _asked(self, queries) -> DataFrame:
        """queries (qid, v) as they are; one vector has qid 0."""
        if isinstance(queries, DataFrame):
            return queries
        return self.spark.createDataFrame([(0, [float(x) for x in np.ravel(queries)])], "qid long, v array<double>")

    def batch_query(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """queries (qid, v) to qid, rank, row_id, distance, by the mode of the settings: "exact", "ivf" (the n_probe nearest
        clusters), or "bounded" (exact, measuring only what norms and short vectors leave open within the distances that a first
        search finds: a pruned one, or one of a sample where that looks at fewer rows)."""
        began, watch = time.time(), Observation()
        table, mode = self._ready(), self.config.mode
        if mode == "exact":
            out = search.exact(table, queries, k, watch)
        elif mode == "bounded":
            self.basis = self.basis or search.Basis.of(table, self.config.random_state)
            asked = written(queries.select("qid", "v"))
            probed = self.built.n_splats * self.config.n_probe // len(self.centroids)  # rows that a query looks at
            first = search.pruned(table, self.centroids, asked, k, self.config.n_probe) if probed <= FIRST_ROWS else search.exact(sample(table, FIRST_ROWS, self.config.random_state), asked, k)
            out, _ = search.norm_bounded(table, asked, k, first, watch=watch, basis=self.basis)
            discard(asked)
        else:
            out = search.pruned(table, self.centroids, queries, k, self.config.n_probe, watch)
        self.asked.append((time.time() - began, watch))
        return out

    def query(self, vector, k: int = 10) -> DataFrame:
        return self.batch_query(self._asked(vector), k).drop("qid")

    def query_with_details(self, queries, k: int = 10) -> DataFrame:
        """qid (0 for one vector), rank, row_id, distance, coarse, fine; always pruned, and counted by no figure."""
        table = self._ready()
        found = search.pruned(table, self.centroids, self._asked(queries), k, self.config.n_probe)
        return table.select("row_id", "coarse", "fine").join(found, "row_id").select("qid", "rank", "row_id", "distance", "coarse", "fine")

    def with_splats(self, found: DataFrame) -> DataFrame:
        """The splats of found rows, joined after the k best are known."""
        splats = self.splats.withColumn("row_id", F.col("id"))
        return splats.join(found, "row_id").drop("row_id")

    def get(self, splat_id: int) -> DataFrame:
        """The splat of an id: one row, or none."""
        return self.splats.where(F.col("id") == splat_id)

    def members(self, coarse: int | None = None) -> DataFrame:
        """row_id, coarse, place of all rows, or of one cluster's."""
        table = self._ready()
        return members(table if coarse is None else table.where(F.col("coarse") == coarse))

    def save(self, path: str) -> None:
        """Rows by coarse cluster, so that a probe list prunes partitions; centroids, encoding model and settings beside them."""
        rows = self._ready().repartition("coarse", F.pmod(F.xxhash64("row_id"), F.lit(8))).sortWithinPartitions("coarse", "norm_sq")
        rows.write.mode("overwrite").partitionBy("coarse").parquet(f"{path}/rows")
        if self.splats is not None:
            self.splats.write.mode("overwrite").parquet(f"{path}/splats")
        about = {"config": asdict(self.config), "stats": asdict(self.built), "model": self.model and asdict(self.model)}
        cells = [(k, [float(x) for x in row]) for k, row in enumerate(self.centroids)]
        self.spark.createDataFrame(cells, "k int, c array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
        self.spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.mode("overwrite").json(f"{path}/about")

    def load(self, path: str) -> None:
        """What save wrote; queries and new splats can be encoded and asked at once."""
        self.release()
        self.table = self.spark.read.parquet(f"{path}/rows")
        self.centroids = np.array([r["c"] for r in self.spark.read.parquet(f"{path}/centroids").orderBy("k").collect()])  # K rows
        about = json.loads(self.spark.read.json(f"{path}/about").first()["about"])
        self.config, self.built = IndexConfig(**about["config"]), IndexStats(**about["stats"])
        if m := about["model"]:
            p = m["position"]
            self.model = EmbeddingModel(PositionModel(tuple(p["low"]), tuple(p["high"]), p["dim"]), ColorModel(**m["color"]))
            self.splats = self.spark.read.parquet(f"{path}/splats")

    def release(self) -> None:
        """Let go of the built table and of the figures of queries."""
        discard(self.table)
        self.table, self.basis, self.asked = None, None, []

    def clear(self) -> None:
        self.release()
        self.splats = self.centroids = self.model = None
        self.built = IndexStats()


def _told(watch: Observation) -> dict | None:
    """What a query has told, or None if nothing has run it yet."""
    return watch.get if watch._jo is not None and watch._jo.future().isCompleted() else None
