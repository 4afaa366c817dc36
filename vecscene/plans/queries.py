
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import encoding, geometry
from ..functions.vector import dot, doubles, l2_squared, norm, norm_squared
from ..operators import index, kmeans, lloyd, metrics, ranks, sampling, search, seeding, tiering
from ..sources import splats
from ..tables import Vectors, discard, shared_folder, written

K, PROBES, NEIGHBOURS, FINE = 16, 12, 5, 4
QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def r6(c):
    return F.round(c, 6) + F.lit(0.0)  # no negative zero


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("row_id"), doubles(F.col("embedding")).alias("v"))


def centroids(df: DataFrame, k: int = K) -> np.ndarray:
    """Fixed starting centroids: the first k rows."""
    return np.array([r["v"] for r in df.where(F.col("row_id") < k).orderBy("row_id").collect()])


def asked(df: DataFrame) -> DataFrame:
    """The stated query set: every row whose id is divisible by 20."""
    return df.where(F.col("row_id") % 20 == 0).select(F.col("row_id").alias("qid"), "v")


def _axes(column: str, names) -> list:
    return [r6(F.col(column)[i]).alias(n) for i, n in enumerate(names)]


@query
def splat_scan(spark, d):
    df = splats.from_events(spark, d)
    return df.select("id", *_axes("position", ["px", "py", "pz"]), *_axes("color", "rgb"), r6("opacity").alias("opacity"), *_axes("scale", ["sx", "sy", "sz"]), *_axes("rotation", ["qw", "qx", "qy", "qz"]))


@query
def splat_json_roundtrip(spark, d):
    df = splats.from_json(splats.to_json(splats.from_events(spark, d)))
    return df.select("id", *_axes("position", ["px", "py", "pz"]), *_axes("color", "rgb"), r6("opacity").alias("opacity"), *_axes("scale", ["sx", "sy", "sz"]), *_axes("rotation", ["qw", "qx", "qy", "qz"]), F.size(F.coalesce("sh_coeffs", F.array().cast("array<double>"))).cast("long").alias("n_sh"))


@query
def quat_normalize(spark, d):
    return splats.conform(splats.from_events(spark, d)).select("id", *_axes("rotation", ["qw", "qx", "qy", "qz"]))


@query
def rotation_matrix(spark, d):
    m = geometry.rotation_matrix(F.col("rotation"))
    return splats.conform(splats.from_events(spark, d)).select("id", *[r6(m[i][j]).alias(f"r{i}{j}") for i in range(3) for j in range(3)])


@query
def covariance_3d(spark, d):
    m = geometry.covariance(F.col("rotation"), F.col("scale"))
    return splats.conform(splats.from_events(spark, d)).select("id", *[r6(m[i][j]).alias(f"c{i}{j}") for i in range(3) for j in range(i, 3)])


@query
def cluster_bounds(spark, d):
    p = F.col("position")
    return splats.from_events(spark, d).groupBy("user_id").agg(F.count("*").alias("size"), *[r6(f(p[k])).alias(f"{n}{a}") for k, a in enumerate("xyz") for n, f in (("min_", F.min), ("max_", F.max))])


@query
def contains_point(spark, d):
    b = cluster_bounds(spark, d)
    box = lambda n: F.array(*[F.col(f"{n}_{a}") for a in "xyz"])
    return b.select("user_id", geometry.contains(box("min"), box("max"), F.array(F.lit(5.0), F.lit(0.0), F.lit(4.8))).alias("inside"))


@query
def position_bounds(spark, d):
    b = encoding.position_bounds(splats.from_events(spark, d))
    return b.select(*[r6(c).alias(c) for c in b.columns])


def _rounded(name: str):
    """As r6 of a column of doubles, without decimals where the seventh place leaves no doubt."""
    x = F.col(name)
    whole = F.floor(x * 1e6)
    plain = (F.abs(x) < 1e4) & (F.abs(x * 1e6 - whole - 0.5) > 1e-3)
    return F.when(plain, F.floor(x * 1e6 + 0.5) / F.lit(1e6)).otherwise(r6(x))


def _features(df: DataFrame, column, sparse: bool = False) -> DataFrame:
    """Features as rows; in sparse form those that are not zero, which are left out before they are rounded."""
    rows = df.select("id", F.posexplode(column).alias("pos", "x"))
    return (rows.where("x <> 0") if sparse else rows).select("id", "pos", _rounded("x").alias("x"))


def _histogram(df: DataFrame, model: encoding.ColorModel) -> DataFrame:
    """The colour histograms in sparse form: splats of one cell have the same, so they meet the cells' own, a table of bounded size."""
    cells = model.histograms(df.sparkSession).select("cell", "pos", r6("x").alias("x"))
    return df.select("id", model.cell(F.col("color")).alias("cell")).join(F.broadcast(cells), "cell").select("id", "pos", "x")


@query
def position_encode(spark, d):
    df = splats.from_events(spark, d)
    return encoding.PositionModel.fit(df).features(df).select("id", "pos", _rounded("x").alias("x"))


@query
def color_normalize(spark, d):
    df = splats.from_events(spark, d).withColumn("color", F.transform("color", lambda c: c * 255))
    return df.withColumn("color", encoding.ColorModel.fit(df).normalize(F.col("color"))).select("id", *_axes("color", "rgb"))


@query
def color_bins(spark, d):
    df = splats.from_events(spark, d)
    return df.withColumn("cell", encoding.ColorModel.fit(df).cells(F.col("color"))).select("id", *[F.col("cell")[i].cast("long").alias(n) for i, n in enumerate(("br", "bg", "bb"))])


@query
def color_histogram(spark, d):
    df = splats.from_events(spark, d)
    return _histogram(df, encoding.ColorModel.fit(df))


@query
def attr_encode(spark, d):
    return _features(splats.from_events(spark, d), encoding.attributes(F.col("opacity"), F.col("scale"), F.col("rotation")))


@query
def embedding_norms(spark, d):
    df = splats.from_events(spark, d)
    full = encoding.EmbeddingModel.fit(df).transform(df)
    return full.select("id", F.size("embedding").cast("long").alias("dim"), F.round(norm_squared(F.col("embedding")), 4).alias("norm_sq"))


@query
def full_embedding(spark, d):
    """The embedding in sparse form: what is not listed is zero."""
    df = splats.from_events(spark, d)
    model = encoding.EmbeddingModel.fit(df)
    first, cells = model.position.dim, model.color.bins**3
    attributes = encoding.attributes(F.col("opacity"), F.col("scale"), F.col("rotation"))
    ends = _features(df, F.concat(model.position.encode(F.col("position")), attributes), sparse=True)
    ends = ends.withColumn("pos", F.when(F.col("pos") < first, F.col("pos")).otherwise(F.col("pos") + cells))
    histogram = _histogram(df, model.color).withColumn("pos", F.col("pos") + first)
    return ends.unionByName(histogram).where("x <> 0")


@query
def point_lookup(spark, d):
    """Splats by id, one of them unknown."""
    ix = index.SplatIndex(spark, splats=splats.conform(splats.from_events(spark, d)))
    found = ix.get(7).unionByName(ix.get(42)).unionByName(ix.get(-1))
    return found.select("id", *_axes("position", ["px", "py", "pz"]), r6("opacity").alias("opacity"))


@query
def vector_dot_norm(spark, d):
    df = vectors(spark, d)
    first = F.array(*map(F.lit, centroids(df, 1)[0].tolist()))
    return df.select("row_id", r6(norm(F.col("v"))).alias("norm"), r6(dot(F.col("v"), first)).alias("dot0"), r6(F.sqrt(l2_squared(F.col("v"), first))).alias("distance0"))


@query
def gram_vs_direct(spark, d):
    """Squared distances to the first vector, in difference form and from norms and a dot product."""
    df = vectors(spark, d)
    first = F.array(*map(F.lit, centroids(df, 1)[0].tolist()))
    v = F.col("v")
    return df.select("row_id", r6(l2_squared(v, first)).alias("direct"), r6(norm_squared(v) + norm_squared(first) - 2 * dot(v, first)).alias("gram"))


@query
def kmeans_assign(spark, d):
    df = vectors(spark, d)
    return kmeans.assign(df, centroids(df)).select("row_id", "label", r6("d2").alias("d2"))


def _matrix(spark, c: np.ndarray, name: str = "x") -> DataFrame:
    return spark.createDataFrame([(k, i, round(float(x), 6)) for k, row in enumerate(c) for i, x in enumerate(row)], f"k int, pos int, {name} double")


@query
def kmeans_update(spark, d):
    df = vectors(spark, d)
    sums, n, _ = kmeans.partial_sums(df, centroids(df))
    return _matrix(spark, kmeans.update(sums, n))


@query
def kmeans_inertia(spark, d):
    df = vectors(spark, d)
    return kmeans.assign(df, centroids(df)).agg(r6(F.sum("d2")).alias("inertia"))


@query
def kmeans_shift(spark, d):
    df = vectors(spark, d)
    c = centroids(df)
    sums, n, _ = kmeans.partial_sums(df, c)
    return spark.createDataFrame([(round(float(((kmeans.update(sums, n) - c) ** 2).sum()), 6),)], "shift double")


@query
def kmeans_lloyd_3(spark, d):
    df = vectors(spark, d)
    c = centroids(df)
    for _ in range(3):
        sums, n, _ = kmeans.partial_sums(df, c)
        c = kmeans.update(sums, n)
    return _matrix(spark, c)


@query
def kmeans_minibatch_step(spark, d):
    df = vectors(spark, d)
    c = centroids(df)
    sums, n, _ = kmeans.partial_sums(df, c)
    return _matrix(spark, kmeans.minibatch_update(c, np.ones(len(c)), sums, n)[0])


@query
def kmeans_batchmean_step(spark, d):
    df = vectors(spark, d)
    c = centroids(df)
    sums, n, _ = kmeans.partial_sums(df, c)
    return _matrix(spark, kmeans.batch_mean_update(c, np.ones(len(c)), sums, n)[0])


@query
def kmeans_transform(spark, d):
    df = vectors(spark, d)
    return kmeans.distances(df, centroids(df)).select("row_id", "k", r6("distance").alias("distance"))


@query
def kpp_min_dist(spark, d):
    df = vectors(spark, d)
    return kmeans.assign(df, centroids(df, 3)).select("row_id", r6("d2").alias("min_d2"))


@query
def kpp_pick(spark, d):
    """The row drawn in proportion to its squared distance from three centroids, at five places of the cumulated weight."""
    df = vectors(spark, d)
    near = kmeans.assign(df, centroids(df, 3))
    out = None
    for k, r in enumerate((0.05, 0.25, 0.5, 0.75, 0.95)):
        one = kmeans.weighted_pick(near, "d2", r).select(F.lit(k).alias("draw"), "row_id")
        out = one if out is None else out.unionByName(one)
    return out


@query
def kpp_init(spark, d):
    return _matrix(spark, kmeans.plus_plus(vectors(spark, d), 8))


@query
def kmeans_fit_full(spark, d):
    m = kmeans.KMeans(8, use_mini_batch=False, max_iter=5).fit(vectors(spark, d))
    return _matrix(spark, m.centroids_)


@query
def kmeans_fit_minibatch(spark, d):
    m = kmeans.KMeans(8, batch_size=200, max_iter=5).fit(vectors(spark, d))
    return _matrix(spark, m.centroids_)


@query
def knn_exact_batch(spark, d):
    df = vectors(spark, d)
    return search.exact(df, asked(df), NEIGHBOURS).withColumn("distance", r6("distance"))


@query
def linear_search(spark, d):
    df = vectors(spark, d)
    q = F.array(*map(F.lit, centroids(df, 1)[0].tolist()))
    return df.select("row_id", F.sqrt(l2_squared(F.col("v"), q)).alias("distance")).orderBy("distance", "row_id").limit(10).select("row_id", r6("distance").alias("distance"))


def _indexed(spark, d):
    df = vectors(spark, d)
    c = centroids(df)
    return kmeans.labelled(df, c, "row_id", "v").select("row_id", "v", F.col("label").alias("coarse")), c


def _fine(df: DataFrame) -> DataFrame:
    """Fixed fine centroids: the FINE rows of smallest row_id in each coarse cluster; fine is the nearest, the lowest among equals."""
    seeds = index.members(df).where(F.col("place") < FINE).join(df.select("row_id", "v"), "row_id").groupBy("coarse").agg(F.sort_array(F.collect_list(F.struct(F.col("place").alias("fine"), F.col("v").alias("c")))).alias("seeds"))
    near = F.array_min(F.transform("seeds", lambda s: F.struct(l2_squared(F.col("v"), s["c"]).alias("d2"), s["fine"].alias("fine"))))
    return df.join(F.broadcast(seeds), "coarse").select("row_id", "v", "coarse", near["fine"].alias("fine"))  # K x FINE vectors


@query
def coarse_probe(spark, d):
    df = vectors(spark, d)
    return search.probes_of(asked(df), centroids(df), PROBES).select("qid", "coarse")


@query
def knn_exact(spark, d):
    df = vectors(spark, d)
    return search.exact(df, df.where("row_id = 0").select(F.col("row_id").alias("qid"), "v"), NEIGHBOURS).select("rank", "row_id", r6("distance").alias("distance"))


@query
def ivf_query(spark, d):
    df, c = _indexed(spark, d)
    return search.pruned(df, c, vectors(spark, d).where("row_id = 0").select(F.col("row_id").alias("qid"), "v"), NEIGHBOURS, PROBES).select("rank", "row_id", r6("distance").alias("distance"))


@query
def ivf_candidates(spark, d):
    df, c = _indexed(spark, d)
    return search.candidates(df, c, asked(vectors(spark, d)), PROBES)


@query
def ivf_join_query(spark, d):
    """As ivf_batch_query, by the join of queries and rows by cluster."""
    df, c = _indexed(spark, d)
    return search.pruned_join(df, c, asked(vectors(spark, d)), NEIGHBOURS, PROBES).withColumn("distance", r6("distance"))


@query
def cluster_members(spark, d):
    df, _ = _indexed(spark, d)
    return index.members(df)


@query
def ivf_batch_query(spark, d):
    df, c = _indexed(spark, d)
    return search.pruned(df, c, asked(vectors(spark, d)), NEIGHBOURS, PROBES).withColumn("distance", r6("distance"))


@query
def ivf_query_details(spark, d):
    df, c = _indexed(spark, d)
    ix = index.SplatIndex(spark, index.IndexConfig(n_probe=PROBES), table=_fine(df), centroids=c)
    return ix.query_with_details(asked(vectors(spark, d)), NEIGHBOURS).withColumn("distance", r6("distance"))


@query
def recall_at_k(spark, d):
    df, c = _indexed(spark, d)
    q = asked(vectors(spark, d))
    return search.recall(search.pruned(df, c, q, NEIGHBOURS, PROBES), search.exact(df, q, NEIGHBOURS), NEIGHBOURS).select("qid", r6("recall").alias("recall"))


@query
def cluster_sizes(spark, d):
    df = vectors(spark, d)
    return metrics.cluster_sizes(kmeans.assign(df, centroids(df)))


@query
def index_stats(spark, d):
    sizes = cluster_sizes(spark, d)
    return sizes.agg(F.sum("size").alias("n_splats"), F.count("*").alias("n_coarse"), F.sum(F.greatest(F.lit(1), F.least(F.lit(1000), F.floor(F.col("size") / 5)))).cast("long").alias("n_fine"))


@query
def fine_build(spark, d):
    df, _ = _indexed(spark, d)
    return index.fine_labels(df, 50).select("row_id", "coarse", "fine")


@query
def latency_percentiles(spark, d):
    out = metrics.latency_summary(spark.read.parquet(f"{d}/events.parquet"), "value")
    return out.select("n", *[r6(c).alias(c) for c in ("mean", "std", "p50", "p95", "max", "qps")])


def access_log(spark, d) -> DataFrame:
    """One cache, ids are users, in order of time, events of one moment by their ids."""
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.lit(0).cast("long").alias("cache"), "ts", F.col("event_id").alias("seq"), F.col("user_id").alias("splat_id"))


@query
def access_count(spark, d):
    return tiering.access_counts(access_log(spark, d)).select("seq", "splat_id", F.col("n").cast("long").alias("n"))


@query
def tier_access(spark, d):
    return tiering.outcomes_without_evictions(access_log(spark, d)).select("seq", "splat_id", "outcome", "promoted")


@query
def tier_counts(spark, d):
    return tiering.totals(tiering.outcomes_without_evictions(access_log(spark, d))).drop("cache")


@query
def tier_final(spark, d):
    return tiering.final_tiers(access_log(spark, d)).drop("cache")


@query
def tier_lru_evict(spark, d):
    """Replay with small limits; accesses dealt to 16 caches by id."""
    log = access_log(spark, d).withColumn("cache", F.pmod(F.xxhash64("splat_id"), F.lit(16)))
    return tiering.replay(log, 2, 4).drop("cache")


@query
def tier_stream(spark, d):
    """The same replay as a stream over the events table, run to its end."""
    from ..streaming.tier_stream import replay_stream

    schema = spark.read.parquet(f"{d}/events.parquet").schema
    log = spark.readStream.schema(schema).option("pathGlobFilter", "events*").parquet(d) if not d.endswith("events.parquet") else spark.readStream.schema(schema).parquet(d)
    log = log.select(F.pmod(F.xxhash64("user_id"), F.lit(16)).alias("cache"), F.col("event_id").alias("seq"), F.col("user_id").alias("splat_id"))
    name = f"{shared_folder(spark)}/tier_stream_{np.random.default_rng().integers(1 << 62)}"
    run = replay_stream(log, 2, 4).writeStream.format("parquet").option("path", f"{name}/out").option("checkpointLocation", f"{name}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(tiering.OUTCOME).parquet(f"{name}/out").drop("cache")


@query
def generate_splats(spark, d):
    """A generated splat for each event."""
    ids = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"))
    return splats.generate_for(ids).select("id", *_axes("position", ["px", "py", "pz"]), *_axes("color", "rgb"), r6("opacity").alias("opacity"), *_axes("scale", ["sx", "sy", "sz"]), *_axes("rotation", ["qw", "qx", "qy", "qz"]))


def _number(row_id: str = "row_id"):
    """A draw that SQL can make too: a whole number below 10007."""
    return (F.col(row_id) * 7919 + 17) % 10007


def _oversampled(spark, d):
    """Vectors, the state under the first three rows as candidates, and the rows drawn in one pass."""
    df = vectors(spark, d)
    kept = Vectors(df)
    state = written(seeding.nearer(kept, seeding.start(kept), centroids(df, 3)))
    return kept, state, seeding.oversampled(kept, state, 2.0 * K, (_number() + 0.5) / F.lit(10007.0))


@query
def kpar_oversample(spark, d):
    """One pass of k-means||: rows drawn in proportion to their squared distance from the candidates so far."""
    kept, state, drawn = _oversampled(spark, d)
    out = written(drawn.select("row_id"))
    kept.release()
    discard(state)
    return out


@query
def kpar_weights(spark, d):
    """The candidates after that pass, and how many rows are nearest to each: the running minimum has met only the new ones."""
    df = vectors(spark, d)
    kept, state, drawn = _oversampled(spark, d)
    new = sorted(drawn.collect(), key=lambda r: r["row_id"])  # about 2 K rows
    moved = seeding.nearer(kept, state, np.array([r["v"] for r in new]), 3) if new else state
    ids = spark.createDataFrame(list(enumerate([0, 1, 2, *[r["row_id"] for r in new]])), "label int, row_id long")
    out = written(ids.join(moved.groupBy("label").agg(F.count("*").alias("weight")), "label").select("row_id", "weight"))
    kept.release()
    discard(state)
    return out


@query
def kpar_init(spark, d):
    return _matrix(spark, seeding.parallel(vectors(spark, d), 8))


@query
def sample_rows(spark, d):
    """100 rows without replacement, by a threshold found from counts."""
    return sampling.sample(vectors(spark, d), 100, number=_number()).select("row_id")


@query
def kmeans_bounded_lloyd(spark, d):
    """Labels of three full rounds that skip distances by bounds."""
    df = vectors(spark, d)
    kept = Vectors(df)
    _, state, _ = lloyd.rounds(kept, centroids(df), 3, 0.0)
    out = written(lloyd.labels(kept, state))
    kept.release()
    discard(state)
    return out


@query
def knn_join_all(spark, d):
    """All vectors as queries against all vectors, by the tiled join."""
    df = vectors(spark, d)
    return search.exact_join(df, df.select(F.col("row_id").alias("qid"), "v"), NEIGHBOURS).withColumn("distance", r6("distance"))


@query
def knn_norm_bounded(spark, d):
    """Exact neighbours of vectors of many lengths (scaled by 1 to 17), reading only norms that can matter."""
    df = vectors(spark, d).withColumn("v", F.transform("v", lambda x: x * (1 + F.col("row_id") % 17)))
    found, _ = search.norm_bounded(search.by_norm(df), asked(df), NEIGHBOURS)
    return found.withColumn("distance", r6("distance"))


@query
def ivf_stored_join(spark, d):
    """As ivf_join_query, over an index stored by cluster, of which only the probed clusters are read."""
    df, c = _indexed(spark, d)
    return search.pruned_join(written(df, "coarse"), c, asked(vectors(spark, d)), NEIGHBOURS, PROBES).withColumn("distance", r6("distance"))


@query
def coarse_probe_join(spark, d):
    """As coarse_probe, with the centroids as a table that meets the queries in tiles."""
    df = vectors(spark, d)
    cells = df.where(F.col("row_id") < K).select(F.col("row_id").alias("coarse"), F.col("v").alias("c"))
    return search.probes_by_join(asked(df), cells, PROBES)


@query
def event_places(spark, d):
    """The place of each event in its group by id, where one group holds nine tenths of all."""
    e = spark.read.parquet(f"{d}/events.parquet")
    return ranks.places(e.select(F.when(F.col("user_id") % 10 > 0, 0).otherwise(F.col("user_id")).alias("part"), "event_id"), "part", "event_id")


@query
def index_query(spark, d):
    """An index built over the splats of all events and asked for every 500th of them, exactly: reading what norms leave open."""
    ix = index.SplatIndex(spark, index.IndexConfig(n_coarse=20, n_fine=50, n_probe=3, max_iter=3, mode="bounded"))
    ix.add_splats(splats.from_events(spark, d))
    ix.build()
    queries = ix.encode(ix.splats.where(F.col("id") % 500 == 0))
    return ix.batch_query(queries, NEIGHBOURS).withColumn("distance", r6("distance"))
