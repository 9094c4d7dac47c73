import numpy as np
import pytest
from pyspark.sql import functions as F

from vecspark.operators import decoders, metrics, pairs, sampling, search
from vecspark.operators.linear import LinearCodec
from vecspark.plans import catalogue
from vecspark.plans.training import rank_correlation


@pytest.fixture(scope="module")
def data(spark):
    x = np.random.default_rng(3).normal(size=(120, 16))
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").persist()


def test_knn_and_recall(spark, data):
    x, df = data
    got = search.knn(df.where("vec_id % 50 = 0"), df, 5).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in (0, 50, 100):
        sims = unit @ unit[q]
        sims[q] = -2
        assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == np.argsort(-sims, kind="stable")[:5].tolist()
    truth = spark.createDataFrame([(0, v) for v in range(5)], "query_id long, vec_id long")
    ranking = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
    for n, want in ((5, 0.6), (10, 1.0)):
        found = spark.createDataFrame([(0, v) for v in ranking[:n]], "query_id long, vec_id long")
        assert metrics.recall(truth, found, 5).first()["recall"] == want


def test_ties_go_to_the_smaller_id(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(6)], "vec_id long, embedding array<double>")
    got = search.knn(df.where("vec_id = 3"), df, 3).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0, 1, 2]


def test_search_modes(data):
    _, df = data
    assert [search.candidates(m, 10) for m in ("fast", "balanced", "precision")] == [10, 100, 300]
    searcher = search.BoostSearcher(LinearCodec.golden(16, 2), LinearCodec.golden(16, 2))
    out = searcher.search(df.where("vec_id = 0"), searcher.build(df), 7).collect()
    assert len(out) == 7
    with pytest.raises(ValueError, match="exceed"):
        search.StageConfig.turbo_boost(16, 8, 4, 32, 10)


def test_queries_beyond_one_block(data, monkeypatch):
    _, df = data
    monkeypatch.setattr(search, "BLOCK_NUMBERS", 64 * 4)
    assert search.knn(df.where("vec_id < 11"), df, 2).count() == 22


@pytest.mark.parametrize(("x", "y", "want"), [([1, 2, 3, 4], [1, 2, 3, 4], 1), ([1, 2, 3, 4], [4, 3, 2, 1], -1), ([1], [1], 0), ([5, 5, 5], [1, 1, 2], 1)])
def test_spearman(spark, x, y, want):
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "p long, x double, y double")
    assert metrics.spearman(df, "x", "y", "p").first()["rho"] == pytest.approx(want)
    assert rank_correlation(np.array(x, float), np.array(y, float)) == pytest.approx(want)


def test_stats_and_ring(spark, data):
    df = spark.createDataFrame([(float(i),) for i in range(1, 6)], "v double")
    row = df.agg(*metrics.value_stats(df, "v")).first()
    assert (row.v_mean, row.v_min, row.v_max, round(row.v_std, 6)) == (3, 1, 5, 1.414214)
    ring = metrics.ring_pairs(data[1], "vec_id", ["embedding"]).orderBy("pair_id").collect()
    assert [(r.a_vec_id, r.b_vec_id) for r in ring] == [(i, (i + 1) % 120) for i in range(120)]


def test_all_pairs_in_blocks(data):
    x, df = data
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.triu(unit @ unit.T, 1)
    for block in (2048, 30, 2):  # of 60 blocks some have no rows
        got = {r.vec_id: r for r in pairs.similarity_profile(df, block=block).collect()}
        assert all(got[i].n_pairs == 119 - i and got[i].sum_cosine == pytest.approx(sims[i].sum()) and got[i].max_cosine == pytest.approx(sims[i, i + 1 :].max()) for i in range(119))
        assert got[119].n_pairs == 0 and got[119].max_cosine is None
    gaps = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))[np.triu_indices(120, 1)]
    for block in (2048, 30, 2):
        row = pairs.mean_distance(df, block=block).first()
        assert row.n_pairs == 7140 and row.mean_distance == pytest.approx(gaps.mean())
    assert tuple(pairs.mean_distance(df.limit(0)).first()) == (0, 0.0)
    assert pairs.capped_pairs(df).count() == 200


def test_sampling(spark, data):
    _, df = data
    a, b = sampling.random_sample(df, 30, 7), sampling.random_sample(df.repartition(7), 30, 7)
    assert {r.vec_id for r in a.collect()} == {r.vec_id for r in b.collect()}
    assert sampling.random_sample(df, 500, 7).count() == 120
    assert sampling.remaining(df, a).count() == 90
    assert (sampling.validation_size(100, 0.2), sampling.validation_size(1000, 0.2, 50), sampling.validation_size(2, 0.9)) == (20, 50, 1)
    assert {r.split: r["count"] for r in sampling.split(df.select("vec_id")).groupBy("split").count().collect()} == {"train": 96, "validation": 24}
    assert sampling.sizes("fixed", 3000, (1000, 2000, 5000, 10_000)) == [1000, 2000]
    assert sampling.sizes("fixed", 500, (1000,)) == []
    assert sampling.sizes("doubling", 20_000, start=500, top=10_000) == [500, 1000, 2000, 4000, 8000]
    assert sampling.sizes("percent", 10, percent=1.0) == [1]
    grid = spark.createDataFrame([(i, float(i % 10), float(i // 10)) for i in range(100)], "vec_id long, x double, y double")
    picked = sampling.grid_sample(grid, 25, 1, grid=10).join(grid, "vec_id").collect()
    assert len(picked) == 25
    assert len({r.x for r in picked}) >= 4
    assert len({r.y for r in picked}) >= 4
    with pytest.raises(ValueError, match="strategy"):
        sampling.sampler("other")


def test_kmeanspp_reaches_the_clusters(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.5, (25, 2)) + c for c in ((0, 0), (10, 0), (0, 10), (10, 10))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    ids = [r.vec_id for r in sampling.kmeanspp_sample(df, 4, 1).collect()]
    assert len({i // 25 for i in ids}) >= 3


def test_decoders_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i, [0.1 * i, 0.2]) for i in range(6)], "vec_id long, y array<double>")
    for method in ("hybrid", "hybrid_quick"):
        a = {r.vec_id: list(r.decoded) for r in decoders.decode(df, "y", 16, method, 1).collect()}
        b = {r.vec_id: list(r.decoded) for r in decoders.decode(df.repartition(3), "y", 16, method, 1).collect()}
        assert a == b
        for i, x in a.items():
            y = np.array([0.1 * i, 0.2])
            assert decoders.combined_energy(np.array([x]), y)[0] <= decoders.combined_energy(decoders.replicated(y, 16)[None], y)[0] + 1e-12
    warm = decoders.decode(df, "y", 16, "thermodynamic", 1, replicas=2, iterations=2).first()
    assert len(warm["decoded"]) == 16
    assert np.isfinite(warm["decoded"]).all()


@pytest.mark.parametrize(("dim", "size"), [(64, 8), (20, 3), (16, 20), (5, 2), (3, 1)])
def test_moves_by_their_own_terms_are_those_by_whole_energies(dim, size):
    ys = np.random.default_rng(1).normal(0, 0.3, (3, min(size, dim)))
    own, whole = (decoders.thermodynamic(ys, dim, [np.random.default_rng([1, i]) for i in range(3)], 3, 12, move=m) for m in (decoders.move, decoders.move_plainly))
    assert np.allclose(own, whole, atol=1e-9)


def test_thermo_query_runs_every_replica_and_iteration(spark, sf_dir):
    got = {r.vec_id: r.cosine for r in catalogue.thermo_decode(spark, sf_dir).collect()}
    assert len(got) == spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    for r in catalogue.coded(spark, sf_dir).where("vec_id < 3").collect():
        x = decoders.thermodynamic(np.array([r.y]), catalogue.DIM, [np.random.default_rng([catalogue.SEED, r.vec_id])], 8, 200)[0]
        assert got[r.vec_id] == pytest.approx(x @ r.v / np.linalg.norm(x) / np.linalg.norm(r.v), abs=2e-6)


def test_global_rank_is_gapless(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 13).alias("x"), F.col("id").alias("p"))
    rows = metrics.global_rank(df, [F.col("x"), F.col("p")], "r").orderBy("r").collect()
    assert [r.r for r in rows] == list(range(1000))
    assert [(r.x, r.p) for r in rows] == sorted((r.x, r.p) for r in rows)
