import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecscene.functions.encoding import ColorModel, EmbeddingModel
from vecscene.operators import index, kmeans, metrics, search, tiering
from vecscene.plans import oracles, queries
from vecscene.sources import splats


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_against_sql(name, same_as_sql):
    same_as_sql(queries.QUERIES[name], oracles.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(oracles.SQL)))
def test_gives_rows(name, spark, sf):
    assert queries.QUERIES[name](spark, sf).count() > 0


def _vectors(spark, x):
    return spark.createDataFrame([(i, [float(t) for t in row]) for i, row in enumerate(x)], "row_id long, v array<double>")


def test_color_rule_is_for_the_whole_frame(spark):
    one = spark.createDataFrame([(0, [1.0, 0.0, 0.0])], "id long, color array<double>")
    full = spark.createDataFrame([(0, [255.0, 0.0, 0.0])], "id long, color array<double>")
    a, b = (np.array(d.select(ColorModel.fit(d).encode(F.col("color")).alias("e")).first()["e"]) for d in (one, full))
    assert np.allclose(a, b) and a.max() == 1.0


@pytest.mark.parametrize("bins", [3, 8, 16])
def test_color_kernel_is_the_product_of_its_axes(spark, bins):
    colors = np.random.default_rng(bins).random((20, 3)).tolist() + [[0.0, 1.0, 0.5]]
    df = spark.createDataFrame([*enumerate(colors), (len(colors), None)], "id long, color array<double>")
    found = {r["id"]: r["e"] for r in df.select("id", ColorModel(False, bins).encode(F.col("color")).alias("e")).collect()}
    assert found.pop(len(colors)) is None
    for k, color in enumerate(colors):
        axes = [[np.exp(-((i - min(bins - 1, int(c * bins))) ** 2) / 4) * (abs(i - min(bins - 1, int(c * bins))) <= 2) for i in range(bins)] for c in color]
        assert np.allclose(np.einsum("i,j,k->ijk", *axes).ravel(), found[k], rtol=1e-12, atol=0)


def test_single_splat_and_defaults(spark):
    df = splats.conform(spark.createDataFrame([(7,)], "id long"))
    row = EmbeddingModel.fit(df).transform(df).first()
    assert len(row["embedding"]) == 640 and row["rotation"] == [1.0, 0.0, 0.0, 0.0]


def test_generator_is_reproducible(spark):
    a, b = (splats.generate(spark, 50, 1).repartition(n).orderBy("id").collect() for n in (1, 5))
    assert a == b


def test_lloyd_lowers_inertia_and_finds_blobs(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(m, 0.5, (60, 4)) for m in (0, 10, -10)])
    df = _vectors(spark, x)
    c, last = x[:3].copy(), float("inf")
    for _ in range(4):
        sums, n, inertia = kmeans.partial_sums(df, c)
        assert inertia <= last + 1e-9
        c, last = kmeans.update(sums, n), inertia
    labels = [r["label"] for r in kmeans.KMeans(3, use_mini_batch=False, max_iter=10).fit_predict(df).orderBy("row_id").collect()]
    assert all(len(set(labels[i : i + 60])) == 1 for i in (0, 60, 120))


def test_identical_rows_and_unfitted(spark):
    df = _vectors(spark, np.ones((12, 3)))
    assert kmeans.plus_plus(df, 3).shape == (3, 3)
    with pytest.raises(RuntimeError):
        kmeans.KMeans(2).predict(df)


def test_minibatch_closed_form():
    rng = np.random.default_rng(1)
    x, c, n = rng.normal(size=(20, 3)), rng.normal(size=3), 4.0
    got, _ = kmeans.minibatch_update(c[None], np.array([n]), x.sum(0)[None], np.array([20]))
    for row in x:
        n += 1
        c = c + (row - c) / n
    assert np.allclose(got[0], c)


def test_pruned_with_all_probes_is_exact_and_ties_go_by_id(spark):
    x = np.repeat(np.eye(4), 5, axis=0)
    df = _vectors(spark, x)
    q = df.where("row_id % 7 = 0").select(F.col("row_id").alias("qid"), "v")
    truth = {(r["qid"], r["rank"]): r["row_id"] for r in search.exact(df, q, 6).collect()}
    for (qid, rank), got in truth.items():
        d = ((x - x[qid]) ** 2).sum(1)
        assert sorted(range(20), key=lambda i: (d[i], i))[rank - 1] == got
    c = np.eye(4)
    table = df.join(kmeans.assign(df, c).select("row_id", F.col("label").alias("coarse")), "row_id")
    assert {(r["qid"], r["rank"]): r["row_id"] for r in search.pruned(table, c, q, 6, 4).collect()} == truth
    assert {(r["qid"], r["rank"]): r["row_id"] for r in search.pruned_join(table, c, q, 6, 4).collect()} == truth
    assert search.pruned(table, c, q, 6, 1).groupBy("qid").count().agg(F.max("count")).first()[0] == 5  # fewer than k


def test_index(spark, tmp_path):
    ix = index.SplatIndex(spark, index.IndexConfig(n_coarse=5, n_probe=5, max_iter=2))
    with pytest.raises(RuntimeError):
        ix.query([0.0])
    assert ix.build() == 0.0
    ix.add_splats(splats.generate(spark, 200))
    ix.build()
    v = ix.table.where("row_id = 3").first()["v"]
    best = ix.query(v, 3).orderBy("rank").first()
    assert (best["row_id"], best["distance"]) == (3, 0.0) and ix.stats.n_splats == 200
    assert ix.query_with_details(v, 4).count() == 4
    details = ix.query_with_details(v, 4).orderBy("rank").collect()
    fine = {r["row_id"]: (r["coarse"], r["fine"]) for r in ix.table.collect()}
    assert all(fine[r["row_id"]] == (r["coarse"], r["fine"]) for r in details) and ix.stats.n_fine_clusters == len(set(fine.values()))
    assert ix.get(3).count() == 1 and ix.get(-1).count() == 0
    near = ix.with_splats(ix.query(v, 2)).orderBy("rank").first()
    assert near["id"] == 3 and near["distance"] == 0.0 and ix.stats.mean_query_seconds > 0
    ix.save(str(tmp_path / "ix"))
    other = index.SplatIndex(spark)
    other.load(str(tmp_path / "ix"))
    assert other.query(v, 1).first()["row_id"] == 3 and other.config == ix.config
    again = other.encode(splats.generate(spark, 200).where("id = 3")).first()["v"]
    assert np.allclose(again, v)
    ix.clear()
    other.clear()


def test_fine_clusters_are_k_means(spark):
    """Against Lloyd rounds in each coarse cluster from the same first rows."""
    rng = np.random.default_rng(3)
    x, coarse = rng.normal(size=(120, 3)), np.repeat([0, 1], [80, 40])
    df = spark.createDataFrame([(i, row.tolist(), int(c)) for i, (row, c) in enumerate(zip(x, coarse))], "row_id long, v array<double>, coarse int")
    order = [r["row_id"] for r in df.select("row_id", F.xxhash64("row_id", F.lit(42)).alias("h")).orderBy("h", "row_id").collect()]
    got = {r["row_id"]: r["fine"] for r in index.fine_labels(df, 6, 42, 2).collect()}
    for k in (0, 1):
        rows = np.flatnonzero(coarse == k)
        c = x[[i for i in order if coarse[i] == k][: index.fine_clamp(6, len(rows))]]
        for _ in range(2):
            label = kmeans.squared_distances(x[rows], c).argmin(1)
            c = np.array([x[rows][label == j].mean(0) if (label == j).any() else c[j] for j in range(len(c))])
        assert [got[i] for i in rows] == kmeans.squared_distances(x[rows], c).argmin(1).tolist()


def test_numbers_that_are_not_finite_do_no_harm(spark):
    x = np.concatenate([np.eye(3) * 5, np.eye(3) * 5 + 0.1])
    x[5, 1] = np.nan
    df = _vectors(spark, x)
    c = kmeans.plus_plus(df, 3)
    assert np.isfinite(c).all() and np.isfinite(kmeans.partial_sums(df, c)[0]).all()


def test_seeds_are_drawn_by_distance(spark):
    """Shares of second seeds over many random states against squared distances from the first."""
    x = np.array([[0.0], [1.0], [2.0], [3.0]])
    df = _vectors(spark, x).coalesce(1).persist()
    hits, want = np.zeros(4), np.zeros(4)
    for seed in range(30):
        a, b = kmeans.plus_plus(df, 2, seed)[:, 0]
        hits[int(b)] += 1
        d = (x[:, 0] - a) ** 2
        want += d / d.sum()
    df.unpersist()
    assert np.abs(hits - want).max() < 9  # about three deviations


def test_generator_distribution(spark):
    df = splats.generate(spark, 4000, 7)
    r = df.agg(F.avg(F.col("position")[0]), F.stddev(F.col("position")[0]), F.avg("opacity"), F.min("opacity"), F.max("opacity"), F.avg(F.ln(F.col("scale")[1])), F.stddev(F.ln(F.col("scale")[1]))).first()
    assert abs(r[0]) < 0.7 and abs(r[1] - 10) < 0.5 and abs(r[2] - 0.5) < 0.03 and 0 < r[3] < r[4] < 1 and abs(r[5]) < 0.15 and abs(r[6] - 2) < 0.1


def test_json_sink(spark, tmp_path):
    df = metrics.latency_summary(spark.createDataFrame([(0.5,), (1.5,)], "s double"), "s")
    metrics.write_json(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first()["mean"] == 1.0


def test_registered_recall(spark, sf):
    assert queries.recall_at_k(spark, sf).agg(F.avg("recall")).first()[0] >= 0.9


def test_tier_eviction_and_closed_form(spark):
    s = tiering.TierState(5, 100, 1.0, 10)
    for i in range(100):
        s.add(i, to_cold=False)
    for i in range(6):
        for _ in range(11):
            s.access(i)
    assert len(s.vram) == 5 and s.evictions == 1 and 0 in s.ram
    random.seed(0)
    log = spark.createDataFrame([(0, i, random.randint(0, 4)) for i in range(120)], "cache long, seq long, splat_id long")
    a = tiering.replay(log, 1000, 1000).select("seq", "outcome", "promoted").orderBy("seq").collect()
    assert a == tiering.outcomes_without_evictions(log).select("seq", "outcome", "promoted").orderBy("seq").collect()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
