import numpy as np
import pytest

from vecspark.operators import sampling
from vecspark.operators.linear import LinearCodec
from vecspark.operators.pq import ProductQuantizer
from vecspark.plans import catalogue, evaluation, training
from vecspark.plans.cmaes import CMAES
from vecspark.plans.monitor import EarlyStopping, TrainingReport, early_stop_trace, overfit
from vecspark.streaming.transform import compress_stream, read_vectors, write_stream


@pytest.mark.parametrize("n", [10, 1600])
def test_cmaes_finds_the_sphere(n):
    search = CMAES(np.full(n, 0.5 if n == 10 else 0.05), 0.3 if n == 10 else 0.02, 0, 1)
    first = np.linalg.norm(search.mean)
    for _ in range(150 if n == 10 else 60):
        x = search.ask()
        search.tell(x, (x**2).sum(1))
    assert np.linalg.norm(search.mean) < (0.1 if n == 10 else first)


def test_early_stopping(spark):
    stop = EarlyStopping(3, 0.001)
    assert [stop.step(s, samples=k) for k, s in enumerate((0.90, 0.90, 0.89, 0.90))] == [False, False, False, True]
    assert stop.best_samples == 0
    assert "3 steps" in stop.stop_reason()
    low = EarlyStopping(1, 0.0, minimise=True)
    assert [low.step(1.0), low.step(0.5), low.step(0.6)] == [False, False, True]
    trace = early_stop_trace(spark.createDataFrame(list(enumerate((0.90, 0.90, 0.89, 0.90))), "step int, score double"), 3, 0.001).orderBy("step").collect()
    assert [r.stop for r in trace] == [False, False, False, True]


def test_overfit_and_report(spark):
    assert [overfit(*p) for p in ((0.90, 0.89), (0.93, 0.90), (0.95, 0.85))] == ["ok", "warning", "overfitting"]
    for train, validation, status in ((0.96, 0.95, "success"), (0.97, 0.90, "warning"), (0.98, 0.80, "failed")):
        r = TrainingReport(64, 8, 100)
        r.add_step(50, train, validation, 0.1)
        r.finalize(50, train, validation, "stagnated", 1.0)
        assert r.status == status
        assert r.recommendations
        assert r.summary().startswith(status.upper())
        assert r.frame(spark).count() == 1


def test_train_and_validate(spark):
    x = np.random.default_rng(0).normal(size=(80, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    pairs = training.as_pairs(df)
    done = training.train(pairs, training.TrainerConfig.instant().with_(compressed_dim=4, generations=3))
    assert done.codec.weights.shape == (4, 16)
    again = training.train(pairs, training.TrainerConfig.instant().with_(compressed_dim=4, generations=3))
    assert np.allclose(done.codec.weights, again.codec.weights)
    rows = {r["mode"]: r for r in evaluation.validate(pairs, LinearCodec(np.eye(16)), 16).collect()}
    assert rows["linear"].similarity_preservation == pytest.approx(1.0)
    assert sum(r.best for r in rows.values()) == 1


def test_presets_validate_on_a_fifth_up_to_the_bound_and_go_on_to_the_largest_sample(spark):
    config = training.TrainerConfig
    for made in (config(), config.instant(), config.quick(), config.thorough()):
        halves = sampling.split(spark.range(6000).withColumnRenamed("id", "pair_id"), made.validation_fraction, made.seed, made.max_validation, key="pair_id")
        assert halves.where("split = 'validation'").count() == 1200
        assert made.max_validation == 50_000
    largest = [sampling.sizes(available=60_000, **made.schedule)[-1] for made in (config(), config.thorough(), config.quick(), config.instant())]
    assert largest == [50_000, 50_000, 5000, 50]


def test_registered_codebooks_have_the_default_bits_iterations_and_restarts(spark, sf_dir, monkeypatch):
    made, train = [], ProductQuantizer.train.__func__

    def noted(cls, df, column, config, iterations=100, restarts=3, **more):
        made.append((config.bits, iterations, restarts))
        return train(cls, df, column, config, 1, 1, **more)

    monkeypatch.setattr(ProductQuantizer, "train", classmethod(noted))
    catalogue.pq_train_encode(spark, sf_dir)
    assert catalogue.benchmark_grid(spark, sf_dir).count() == 3
    assert made == [(8, 100, 3)] * 4


def test_stream(spark, tmp_path):
    from vecspark.operators.pipeline import CompressionPipeline

    df = spark.createDataFrame([(i, [float(i + j) for j in range(16)], 0) for i in range(20)], "vec_id long, embedding array<float>, label int")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    pipeline = CompressionPipeline(LinearCodec.golden(16, 2))
    q = write_stream(compress_stream(read_vectors(spark, str(tmp_path / "in")), pipeline), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert q.awaitTermination(120)
    got = {r.vec_id: list(r.compressed.projected) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.vec_id: list(r.compressed.projected) for r in pipeline.transform(df).collect()}
    assert got == want
