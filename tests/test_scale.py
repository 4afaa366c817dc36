"""Operators that hold at any number of rows, clusters and queries: each against its plain form, with what it saves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecscene.functions import encoding
from vecscene.operators import index, kmeans, lloyd, ranks, sampling, search, seeding, tiering
from vecscene.plans import queries
from vecscene.sources import splats
from vecscene.streaming.tier_stream import replay_stream
from vecscene.tables import Vectors, discard, written


def _vectors(spark, x, parts=3):
    return spark.createDataFrame([(i, [float(t) for t in row]) for i, row in enumerate(x)], "row_id long, v array<double>").repartition(parts)


def _blobs(rng, k, n, dim=4, apart=6.0):
    return np.concatenate([rng.normal(m, 1.0, (n, dim)) for m in rng.normal(0, apart, (k, dim))])


def _held(spark):
    return spark.sparkContext._jsc.getPersistentRDDs().size()


def _jobs(spark, run):
    """How many jobs a call takes."""
    group = f"count-{np.random.default_rng().integers(1 << 40)}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        run()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


# ---- k-means|| ----


def test_parallel_seeds_are_as_good_as_k_means_plus_plus(spark):
    rng = np.random.default_rng(5)
    df = _vectors(spark, _blobs(rng, 6, 50, apart=4.0), 1).persist()
    kept = Vectors(df)
    polished = lambda c: lloyd_inertia(df, c)

    def lloyd_inertia(df, c):
        for _ in range(2):
            sums, n, _ = kmeans.partial_sums(df, c)
            c = kmeans.update(sums, n)
        return kmeans.partial_sums(df, c)[2]

    own = [polished(seeding.parallel(df, 6, seed, rounds=2, vectors=kept)) for seed in range(10)]
    plus = [polished(kmeans.plus_plus(df, 6, seed)) for seed in range(10)]
    assert np.mean(own) <= 1.05 * np.mean(plus)
    kept.release()
    df.unpersist()


def test_passes_do_not_grow_with_clusters(spark):
    df = _vectors(spark, np.random.default_rng(1).normal(size=(400, 3))).persist()
    df.count()
    few, many = (_jobs(spark, lambda k=k: seeding.parallel(df, k)) for k in (3, 60))
    assert few == many
    df.unpersist()


def test_candidates_are_drawn_by_distance(spark):
    """Over the draws of many states, a row goes in with probability expected x d2 / total."""
    x = np.array([[0.0], [1.0], [2.0], [3.0], [5.0]])
    kept = Vectors(_vectors(spark, x, 1))
    state = written(seeding.nearer(kept, seeding.start(kept), x[:1]))
    hits = np.zeros(len(x))
    for seed in range(60):
        number = (sampling.draw(seed) + F.lit(0.5)) / F.lit(float(1 << sampling.BITS))
        for r in seeding.oversampled(kept, state, 1.0, number).collect():
            hits[r["row_id"]] += 1
    want = 60 * x[:, 0] ** 2 / (x**2).sum()
    assert hits[0] == 0 and (np.abs(hits - want) < 4 * np.sqrt(want * (1 - want / 60)) + 1).all()
    kept.release()


def test_fewer_distinct_rows_than_clusters(spark):
    df = _vectors(spark, np.array([[1.0, 2.0]] * 9 + [[3.0, 4.0]]))
    assert sorted(map(tuple, seeding.parallel(df, 5))) == [(1.0, 2.0), (3.0, 4.0)]
    assert kmeans.KMeans(5, max_iter=2).fit(df).centroids_.shape == (5, 2)


# ---- bounded Lloyd ----


@pytest.mark.parametrize("seed", [0, 1])
def test_bounded_rounds_are_plain_rounds(spark, seed):
    rng = np.random.default_rng(seed)
    x = _blobs(rng, 8, 60)
    x[100:140] = np.round(x[100:140])  # equal rows and equal distances
    x[7] = 1e9
    df = _vectors(spark, x).persist()
    kept = Vectors(df)
    c = np.concatenate([x[:9], x[:1], [[500.0] * 4]])  # two equal centroids, one without rows
    got, state, done = lloyd.rounds(kept, c, 7, 0.0)
    plain = c
    for r in done:
        sums, n, _ = kmeans.partial_sums(df, plain)
        before, plain = plain, kmeans.update(sums, n)
        assert np.allclose(r.centroids, plain) and (r.counts == n).all() and np.isclose(r.shift, ((plain - before) ** 2).sum())
    want = {r["row_id"]: r["label"] for r in kmeans.assign(df, before).collect()}
    assert {r["row_id"]: r["label"] for r in lloyd.labels(kept, state).collect()} == want
    assert done[0].n_distances == x.shape[0] * len(c) and done[-1].n_distances < done[0].n_distances / 2
    kept.release()
    discard(state)
    df.unpersist()


def test_bounds_hold_for_any_move():
    rng = np.random.default_rng(4)
    x, c = rng.normal(size=(300, 3)), rng.normal(size=(12, 3))
    label, upper, lower = np.full(300, -1), np.full(300, np.inf), np.zeros(300)
    shifts = np.zeros(12)
    for step in range(12):
        label, upper, lower, _ = lloyd.moved(x, label, upper, lower, c, shifts, lloyd._halves(c))
        d = np.sqrt(kmeans.squared_distances(x, c))
        assert (label == d.argmin(1)).all() and (upper >= d[np.arange(300), label]).all()
        d[np.arange(300), label] = np.inf
        assert (lower <= d.min(1)).all()
        new = c + rng.normal(size=c.shape) * (0.5 if step % 3 else 0.01)
        shifts, c = np.sqrt(((new - c) ** 2).sum(1)), new


def test_full_fit_counts_what_it_measures(spark):
    df = _vectors(spark, _blobs(np.random.default_rng(2), 5, 40))
    m = kmeans.KMeans(5, use_mini_batch=False, max_iter=8, init="k-means++").fit(df)
    assert 0 < m.n_distances_ <= 200 * 5 * m.n_iter_ + 200 * m.n_iter_
    assert _held(spark) == 0
    with pytest.raises(ValueError):
        kmeans.KMeans(init="random")


def test_vectors_of_one_number(spark):
    df = spark.createDataFrame([(i, float(i % 2) * 10) for i in range(20)], "row_id long, v double")
    m = kmeans.KMeans(2, use_mini_batch=False, max_iter=3)
    labels = {r["row_id"]: r["label"] for r in m.fit_predict(df).collect()}
    assert sorted(m.centroids_[:, 0]) == [0, 10] and all(labels[i] == labels[i % 2] for i in range(20))
    assert m.transform(df).count() == 40


# ---- samples ----


@pytest.mark.parametrize("few", [4096, 0])
def test_sample_is_exact_and_the_same_for_any_partitioning(spark, monkeypatch, few):
    monkeypatch.setattr(sampling, "FEW", few)
    df = spark.range(3000).select(F.col("id").alias("row_id"))
    for n in (0, 1, 17, 1500, 2999, 3000, 4000):
        want = [r[0] for r in df.orderBy(sampling.draw(3, 8), "row_id").limit(n).collect()]
        for parts in (1, 7):
            got = [r[0] for r in sampling.sample(df.repartition(parts), n, 3, 8).collect()]
            assert len(got) == min(n, 3000) and sorted(got) == sorted(want)
    spread = sampling.sample(df.repartition(8), 800, 1).groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) >= 8 and max(r["count"] for r in spread) < 200


def test_sample_with_equal_numbers(spark):
    df = spark.range(100).select(F.col("id").alias("row_id"))
    got = sorted(r[0] for r in sampling.sample(df, 37, number=(F.col("row_id") % 4).cast("long")).collect())
    assert got == sorted(sorted(range(100), key=lambda i: (i % 4, i))[:37])
    assert "Sort" not in sampling.sample(df, 37)._jdf.queryExecution().executedPlan().toString()


# ---- places and percentiles ----


def test_places_in_a_group_of_nine_tenths(spark):
    df = spark.range(4000).select(F.pmod(F.xxhash64("id"), F.lit(1 << 30)).alias("row_id"), F.when(F.col("id") % 10 > 0, 3).otherwise(F.col("id") % 7).cast("int").alias("coarse"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else few rows make one task
    got = {(r["coarse"], r["row_id"]): r["place"] for r in index.members(df).collect()}
    by = {}
    for coarse, row_id in got:
        by.setdefault(coarse, []).append(row_id)
    assert got == {(c, x): i for c, ids in by.items() for i, x in enumerate(sorted(ids))}
    seats = ranks.places(df, "coarse", "row_id")
    tasks = spark.read.parquet(seats.table_path).groupBy(F.shiftright("at", 33)).count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) >= 3 and max(r["count"] for r in tasks) < 2000  # of 4,000, with 3,600 in one group
    discard(seats)


def test_places_with_null_groups(spark):
    df = spark.createDataFrame([(None, 5), (None, 2), (1, 9)], "g int, o long")
    assert {(r["g"], r["o"]): r["place"] for r in ranks.places(df, "g", "o").collect()} == {(None, 2): 0, (None, 5): 1, (1, 9): 0}


@pytest.mark.parametrize("kind", ["normal", "heavy", "equal", "few"])
def test_percentiles(spark, monkeypatch, kind):
    monkeypatch.setattr(ranks, "FEW", 50)
    monkeypatch.setattr(ranks, "EDGES", 8)
    rng = np.random.default_rng(9)
    x = {"normal": rng.normal(size=4000), "heavy": np.exp(rng.normal(0, 100, 4000)), "equal": np.where(rng.random(4000) < 0.4, 7.0, rng.normal(7, 1, 4000)), "few": np.array([3.0, 1.0, 2.0])}[kind]
    df = spark.createDataFrame([(float(t),) for t in x] + [(None,)], "t double").repartition(3)
    shares = [0.0, 0.31, 0.5, 0.95, 1.0]
    assert np.allclose(ranks.percentiles(df, "t", shares), np.quantile(x, shares), rtol=1e-12)
    _, passes = ranks._nth(df.where("t is not null").select(F.col("t").alias("x")), [2000 if len(x) > 9 else 1])
    assert passes <= 5
    assert ranks.percentiles(df.limit(0), "t", [0.5]) == [None]


# ---- search ----


def _truth(x, q, k):
    d = np.sqrt(kmeans.squared_distances(q, x))
    return {(i, r + 1): int(j) for i in range(len(q)) for r, j in enumerate(sorted(range(len(x)), key=lambda j: (d[i, j], j))[:k])}


def _ids(df):
    return {(r["qid"], r["rank"]): r["row_id"] for r in df.collect()}


def _asked(df, n=1000):
    return df.where(F.col("row_id") < n).select(F.col("row_id").alias("qid"), "v")


def test_tiled_join_is_exact(spark, monkeypatch):
    x = np.random.default_rng(3).normal(size=(150, 5))
    x[40:60] = x[3]
    df = _vectors(spark, x)
    for rows, queries in ((32768, 8192), (40, 30), (7, 200)):
        monkeypatch.setattr(search, "TILE_ROWS", rows)
        monkeypatch.setattr(search, "TILE_QUERIES", queries)
        assert _ids(search.exact_join(df, _asked(df), 4)) == _truth(x, x, 4)
    assert search.exact_join(df.limit(0), _asked(df), 4).count() == 0 and search.exact_join(df, _asked(df, 0), 4).count() == 0


def test_long_vectors_make_no_other_pair_vague(monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 16))
    x[5], x[77] = 1e12, -1e12
    q = np.concatenate([x[10:20], x[5:6]])
    seen = []
    monkeypatch.setattr(search, "measured", lambda *a: seen.append(len(a[2])) or kmeans.measured(*a))
    r, ids, _ = search._near(q, x, np.arange(3000), 5)
    assert sum(seen) < 40 * len(q)
    for cells in (1 << 21, 900, 64):  # any block size
        monkeypatch.setattr(search, "CELLS", cells)
        r, ids, d = search._near(q, x, np.arange(3000), 5)
        truth = _truth(x, q, 5)
        assert [int(t) for t in ids] == [truth[(i, k)] for i in range(len(q)) for k in range(1, 6)]


def test_probe_lists_at_any_block_size(spark):
    rng = np.random.default_rng(7)
    q, c = rng.normal(size=(70, 4)), rng.normal(size=(90, 4))
    c[50] = c[3]
    d = kmeans.squared_distances(q, c)
    want = np.argsort(d, axis=1, kind="stable")[:, :6]
    for cells in (1, 13, 400, 1 << 21):
        assert (search.probe_lists(q, c, 6, cells) == want).all()
    assert search.probe_lists(q, c, 200).shape == (70, 90)
    df = _vectors(spark, q)
    table = spark.createDataFrame([(i, [float(t) for t in row]) for i, row in enumerate(c)], "coarse int, c array<double>")
    got = {(r["qid"], r["coarse"]) for r in search.probes_by_join(_asked(df), table, 6).collect()}
    assert got == {(i, int(k)) for i in range(70) for k in want[i]}


def _scanned(df):
    """Rows that the scans of an executed query have given."""
    plan, total = df._jdf.queryExecution().executedPlan(), 0
    todo = [plan]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        if name == "FileSourceScanExec":
            total += node.metrics().get("numOutputRows").get().value()
        for i in range(node.children().size()):
            todo.append(node.children().apply(i))
    return total


def test_join_over_a_stored_index_prunes_as_it_runs(spark):
    rng = np.random.default_rng(8)
    x = _blobs(rng, 10, 40)
    c = np.array([x[40 * i : 40 * i + 40].mean(0) for i in range(10)])
    df = kmeans.labelled(_vectors(spark, x), c, "row_id", "v").withColumnRenamed("label", "coarse")
    stored = written(df, "coarse")
    q = df.where("row_id < 20").select(F.col("row_id").alias("qid"), "v")  # of one blob
    out = search.pruned_join(stored, c, q, 5, 2)
    assert "dynamicpruning" in out._jdf.queryExecution().executedPlan().toString()
    assert _ids(out) == _ids(search.pruned(df, c, q, 5, 2))
    read = search.probed(stored, search.probes_of(q, c, 2))
    read.collect()
    assert 40 <= _scanned(read) <= 200  # of 400


def test_candidates_are_dealt_by_their_pairs(spark, monkeypatch):
    """Nearly all rows in one cluster that all queries probe: no task lists more than a few tiles of pairs."""
    monkeypatch.setattr(search, "PAIR_ROWS", 64, raising=False)
    monkeypatch.setattr(search, "PAIR_QUERIES", 16, raising=False)
    x = np.concatenate([np.random.default_rng(13).normal(size=(1000, 2)), [[50.0, 50.0], [50.0, 51.0]]])
    df, c = _vectors(spark, x), np.array([[0.0, 0.0], [50.0, 50.0], [-90.0, 0.0]])
    q = df.where("row_id % 5 = 0").select(F.col("row_id").alias("qid"), "v")
    rows = kmeans.labelled(df, c, "row_id", "v").withColumnRenamed("label", "coarse")
    out = search.candidates(rows, c, q, 1)
    found = out.withColumn("part", F.spark_partition_id()).collect()
    want = {(i, j, 0) for i in range(0, 1000, 5) for j in range(1000)} | {(1000, 1000, 1), (1000, 1001, 1)}
    assert len(found) == len(want) and {(r["qid"], r["row_id"], r["coarse"]) for r in found} == want
    assert np.bincount([r["part"] for r in found]).max() <= 10 * 64 * 16  # of 200,000
    assert search.candidates(rows, c, q.limit(0), 1).count() == 0


def test_norm_bounds(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(2000, 8)) * np.exp(rng.normal(0, 2, (2000, 1)))
    x[9, 2] = np.nan
    df = _vectors(spark, x)
    stored = search.by_norm(df, 1 << 12)
    few = np.argsort(np.nan_to_num(x**2).sum(1))[[20, 300, 301, 900]].tolist()
    q = df.where(F.col("row_id").isin(few)).select(F.col("row_id").alias("qid"), "v")
    found, read = search.norm_bounded(stored, q, 5)
    want = _ids(search.exact(df, q, 5))
    assert _ids(found) == want
    used = read.count()
    assert used < 1500
    tight, read = search.norm_bounded(stored, q, 5, search.exact(df, q, 5))  # bounds from the answer itself
    assert _ids(tight) == want and read.count() <= used
    assert search.norm_bounded(stored, q.limit(0), 5)[0].count() == 0
    assert _ids(search.norm_bounded(stored, q, 5, found.limit(0))[0]) == want  # no bound known
    assert search._merged(np.array([5.0, 0.0, 1.0]), np.array([6.0, 2.0, 3.0])) == [(0.0, 3.0), (5.0, 6.0)]


def test_norm_bounds_for_any_number_of_queries(spark, monkeypatch):
    """More queries than one block holds, many of them of one norm, with and without bounds of their own."""
    monkeypatch.setattr(search, "BLOCK", 40)
    rng = np.random.default_rng(12)
    x = np.round(rng.normal(size=(300, 3)), 1) * np.exp(rng.normal(0, 2, (300, 1)))
    x[100:200] = x[7]
    x[5, 1] = np.inf
    df = _vectors(spark, x)
    stored = search.by_norm(df, 1 << 12)
    q = df.select(F.col("row_id").alias("qid"), "v")
    want = _ids(search.exact(df, q, 4))
    assert len(want) == 1200
    assert _ids(search.norm_bounded(stored, q, 4)[0]) == want
    assert _ids(search.norm_bounded(stored, q, 4, search.exact(df, q, 4).where("qid % 3 > 0 or rank < 4"))[0]) == want
    far = search.norm_bounded(stored, q.where("qid = 0"), 4)[1].count()
    assert far <= search.norm_bounded(stored, q, 4)[1].count() <= 300


class _Sent:
    """What a task sees of a broadcast."""

    def __init__(self, value):
        self.value = value


@pytest.mark.parametrize("scale", [1.0, 1e-30, 1e25])
@pytest.mark.parametrize("known", [True, False])
def test_short_vectors_leave_few_pairs(monkeypatch, scale, known):
    """Neighbours are those of brute force, ties and repeated rows included, and few pairs are measured; numbers whose squares single
    precision cannot hold are compared all the same."""
    import pyarrow as pa

    rng = np.random.default_rng(16)
    x = _blobs(rng, 40, 50, dim=96, apart=4.0) + np.linspace(0, 9, 96)
    x[100:108], x[7, 3] = x[5], 0.0
    x *= scale
    ids, q = rng.permutation(len(x)), x[::10]
    d = ((q[:, None] - x) ** 2).sum(2)
    order = np.array([np.lexsort((ids, row))[:4] for row in d])
    want = {(i, int(ids[j])) for i, row in enumerate(order) for j in row}
    bound = np.sqrt(np.take_along_axis(d, order[:, 3:], 1)[:, 0])
    length = np.sqrt((q * q).sum(1))
    bound = search._loose(bound, length) if known else np.full(len(q), np.inf)
    counted = []
    monkeypatch.setattr(search, "measured", lambda a, b, r, k, run=search.measured: counted.append(len(r)) or run(a, b, r, k))
    block = _Sent((np.arange(len(q)), q, length, bound, search.Basis.fit(x[::3])))
    batches = [pa.RecordBatch.from_pydict({"row_id": ids[a : a + 500], "v": pa.array(list(x[a : a + 500])), "norm_sq": (x[a : a + 500] ** 2).sum(1)}) for a in range(0, len(x), 500)]
    found = pa.Table.from_batches(search._bounded(block, 4)([batches[0].slice(0, 0), *batches])).to_pandas().sort_values(["qid", "d2", "row_id"])
    got = found.groupby("qid").head(4)
    assert set(zip(got["qid"], got["row_id"])) == want
    assert sum(counted) < len(q) * len(x) / (50 if known else 10)
    assert list(search._bounded(block, 4)(iter([batches[0].slice(0, 0)]))) == []


def test_thousands_of_queries_read_the_rows_once(spark):
    rng = np.random.default_rng(17)
    x = rng.normal(size=(5000, 3))
    df = spark.createDataFrame([(i, row) for i, row in enumerate(x.tolist())], "row_id long, v array<double>").repartition(3)
    found, _ = search.norm_bounded(search.by_norm(df), df.select(F.col("row_id").alias("qid"), "v"), 1)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert found.where("qid = row_id and distance = 0").count() == 5000


def test_row_groups_are_skipped(spark):
    """Rows of distant norms are not even decoded."""
    x = np.repeat(np.arange(1.0, 41.0), 100)[:, None] * np.ones((1, 4))
    stored = search.by_norm(_vectors(spark, x, 4), 1 << 10)
    one = stored.where((F.col("norm_sq") > 3900) & (F.col("norm_sq") < 4000))
    one.collect()
    assert _scanned(one) < 4000


# ---- the tier replay ----


def test_replays_hold_few_rows(spark, monkeypatch, tmp_path):
    """Accesses are made into rows in chunks, with the outcomes of one pass over all, as a table and as a stream."""
    monkeypatch.setattr(tiering, "CHUNK", 7, raising=False)
    rng = np.random.default_rng(17)
    rows = [(int(c), int(s), int(k)) for c, s, k in zip(rng.integers(0, 3, 400), rng.permutation(400), rng.integers(0, 9, 400))]
    want = []
    for cache in range(3):
        state = tiering.TierState(2, 4)
        for key in range(9):
            state.add(key)
        want += [(c, s, k, *state.access(k)) for c, s, k in sorted(rows, key=lambda r: r[1]) if c == cache]
    log = spark.createDataFrame(rows, "cache long, seq long, splat_id long")
    assert sorted(map(tuple, tiering.replay(log, 2, 4).collect()), key=repr) == sorted(want, key=repr)
    sizes = [len(x) for x in tiering.outcomes(tiering.TierState(2, 4), 0, np.arange(20), np.arange(20) % 5)]
    assert sizes == [7, 7, 6]
    log.write.parquet(str(tmp_path / "in"))
    stream = replay_stream(spark.readStream.schema(log.schema).parquet(str(tmp_path / "in")), 2, 4)
    run = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(map(tuple, spark.read.schema(tiering.OUTCOME).parquet(str(tmp_path / "out")).collect()), key=repr) == sorted(want, key=repr)


# ---- splats and their features ----


def test_splats_are_dealt_out_whatever_the_row_groups(spark, tmp_path, monkeypatch):
    """One file of one row group, whose splits but one are empty."""
    monkeypatch.setattr(splats, "SPREAD", 500, raising=False)
    rows = spark.range(6000).select(F.col("id").alias("event_id"), (F.col("id") % 7).alias("user_id"), (F.col("id") / 3).alias("value"))
    rows.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        parts = splats.from_events(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert len(parts) == 12 and sum(r["count"] for r in parts) == 6000 and max(r["count"] for r in parts) < 800


def test_quick_rounding_is_spark_s(spark):
    rng = np.random.default_rng(14)
    ties = (np.arange(-3000, 3000) + 0.5) / 1e6
    x = np.concatenate([rng.normal(size=20000), ties, np.nextafter(ties, 9), np.nextafter(ties, -9), rng.normal(size=2000) * 10.0 ** rng.integers(-12, 20, 2000), [0.0, -0.0, -1e-9, np.nan, np.inf, -np.inf, 1e4, 123.4567895]])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    assert df.where(~queries._rounded("x").eqNullSafe(queries.r6("x"))).count() == 0
    assert spark.createDataFrame([(None,)], "x double").select(queries._rounded("x")).first()[0] is None


@pytest.mark.parametrize("dim", [64, 6, 13])
def test_position_features_are_the_encoding(spark, dim):
    rows = [(i, x.tolist()) for i, x in enumerate(np.random.default_rng(16).normal(size=(30, 3)) * 40)] + [(30, None)]
    df = spark.createDataFrame(rows, "id long, position array<double>")
    model = encoding.PositionModel.fit(df, dim)
    want = df.select("id", F.posexplode(model.encode(F.col("position"))).alias("pos", "x"))
    assert sorted(map(tuple, model.features(df).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


@pytest.mark.parametrize("top", [1.0, 255.0])
def test_cells_have_the_histograms_of_their_colors(spark, top):
    rng = np.random.default_rng(15)
    colors = [*(rng.random((40, 3)) * top).tolist(), [top, 0.0, top / 8], [-1.0, 2.0 * top, 0.4 * top], None]
    df = spark.createDataFrame([*enumerate(colors)], "id long, color array<double>")
    model = encoding.ColorModel.fit(df)
    assert model.bytes_range == (top > 1 or 2 * top > encoding.RANGE_LIMIT)
    sparse = queries._histogram(df, model).collect()
    full = df.select("id", F.posexplode(model.encode(F.col("color"))).alias("pos", "x")).where("x <> 0").select("id", "pos", queries.r6("x").alias("x")).collect()
    assert sorted(map(tuple, sparse)) == sorted(map(tuple, full)) and len(full) > 1000


# ---- the index ----


def test_queries_run_once_and_leave_nothing(spark):
    ix = index.SplatIndex(spark, index.IndexConfig(n_coarse=4, n_probe=4, max_iter=1))
    ix.add_splats(splats.generate(spark, 120))
    ix.build()
    q = ix.table.where("row_id < 6").select(F.col("row_id").alias("qid"), "v")
    held = _held(spark)
    out = ix.batch_query(q, 3)
    assert ix.stats.n_queries == 0  # nothing has run
    assert out.count() == 18 and ix.stats.n_queries == 1 and ix.stats.mean_query_seconds > 0
    seconds = ix.stats.mean_query_seconds
    out.count()
    assert (ix.stats.n_queries, ix.stats.mean_query_seconds) == (1, seconds)
    ivf = _ids(ix.batch_query(q, 3))
    for mode in ("exact", "bounded"):
        ix.config.mode = mode
        assert _ids(ix.batch_query(q, 3)) == ivf  # all clusters are probed
    assert ix.stats.n_queries == 4 and _held(spark) == held == 0
    details = ix.query_with_details(q, 3)
    assert {(r["qid"], r["rank"]): r["row_id"] for r in details.collect()} == ivf
    assert "Scan parquet" in ix.table._jdf.queryExecution().executedPlan().toString().replace("FileScan", "Scan")
    ix.clear()
    assert _held(spark) == 0 and ix.table is None and ix.stats == index.IndexStats()


def test_index_holds_no_more_rows_as_tables_grow(spark, monkeypatch):
    """Fitted on samples, all rows stored, and asked exactly by more queries than one block holds; the index keeps no vectors."""
    monkeypatch.setattr(index, "FIT_ROWS", 100, raising=False)
    monkeypatch.setattr(index, "FIT_FINE", 2, raising=False)
    fits = []
    monkeypatch.setattr(index.KMeans, "fit", lambda self, df, fit=kmeans.KMeans.fit: fits.append(df.count()) or fit(self, df))
    ix = index.SplatIndex(spark, index.IndexConfig(n_coarse=4, n_fine=5, n_probe=1, max_iter=1, mode="bounded"))
    ix.add_splats(splats.generate(spark, 400))
    ix.build()
    assert fits == [100] and ix.table.count() == 400 and ix.table.select("row_id").distinct().count() == 400
    monkeypatch.setattr(search, "BLOCK", 30)
    q = ix.encode(ix.splats.where("id % 5 = 0"))
    want = _ids(search.exact(ix.table, q, 4))
    assert len(want) == 320 and _ids(ix.batch_query(q, 4)) == want
    monkeypatch.setattr(search, "SHARE_BYTES", 640 * 8 * 20)
    assert _ids(search.pruned_join(ix.table, ix.centroids, q, 4, 4)) == want  # all clusters are probed, in groups of 20 vectors
    ix.clear()


def test_index_stores_what_vectors_are_made_of(spark, monkeypatch):
    """The stored rows are narrow, one for each splat, and the vectors read from them are the embeddings; fine labels are those of the
    nearest centroids in any number of blocks; a bounded search is exact, also where a sample bounds it."""
    monkeypatch.setattr(index, "FINE_BYTES", 1, raising=False)
    monkeypatch.setattr(index, "FIRST_ROWS", 50, raising=False)
    ix = index.SplatIndex(spark, index.IndexConfig(n_coarse=3, n_fine=4, n_probe=2, max_iter=1, mode="bounded"))
    made = splats.generate(spark, 150)
    ix.add_splats(made.unionByName(made.where("id < 2").withColumn("id", F.col("id") + 1000)))
    ix.build()
    stored = spark.read.parquet(ix.table.table_path)
    assert "v" not in stored.columns and stored.count() == 152 and stored.select("coarse", "fine").distinct().count() > 3
    rows = {r["row_id"]: r for r in ix.table.collect()}
    color = ix.model.color.encode(F.col("color"))
    plain = F.concat(ix.model.position.encode(F.col("position")), color, encoding.attributes(F.col("opacity"), F.col("scale"), F.col("rotation")))
    want = {r["id"]: r["v"] for r in ix.splats.select("id", plain.alias("v")).collect()}
    assert {k: r["v"] for k, r in rows.items()} == want
    assert all(abs(r["norm_sq"] - np.dot(r["v"], r["v"])) < 1e-9 * r["norm_sq"] for r in rows.values())
    q = ix.encode(ix.splats.where("id % 3 = 0"))
    assert _ids(ix.batch_query(q, 4)) == _ids(search.exact(ix.table, q, 4))
    empty = index.SplatIndex(spark)
    empty.add_splats(splats.generate(spark, 0))
    assert empty.build() == 0.0 and empty.table is None
    ix.clear()


def test_tables_of_a_build_are_deleted(spark, tmp_path):
    import os

    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    ix = index.SplatIndex(spark, index.IndexConfig(n_coarse=3, max_iter=1))
    ix.add_splats(splats.generate(spark, 60))
    ix.build()
    left = [f for f in set(os.listdir(folder)) - before if f.startswith("table-")]
    assert len(left) == 1
    ix.clear()
    assert not [f for f in set(os.listdir(folder)) - before if f.startswith("table-")]


def test_registered_fits_lower_the_inertia(spark, sf):
    """Queries whose draws SQL cannot make: seeds are rows, fits are better than their seeds, all of the asked number."""
    from vecscene.plans import queries

    df = queries.vectors(spark, sf).persist()
    rows = np.array([r["v"] for r in df.collect()])

    def matrix(name):
        found = queries.QUERIES[name](spark, sf).toPandas().sort_values(["k", "pos"])
        return found["x"].to_numpy().reshape(found["k"].nunique(), -1)

    inertia = lambda c: kmeans.partial_sums(df, c)[2]
    plus, full, batch, par = map(matrix, ("kpp_init", "kmeans_fit_full", "kmeans_fit_minibatch", "kpar_init"))
    assert plus.shape == full.shape == batch.shape == par.shape == (8, 64)
    assert all(np.abs(rows - c).max(1).min() < 1e-6 for c in plus) and len({tuple(c) for c in plus}) == 8
    assert inertia(full) < inertia(plus) and inertia(par) < inertia(plus) and inertia(batch) < inertia(plus)
    df.unpersist()
