import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecspark.functions import energy as E
from vecspark.functions import vectors as V
from vecspark.functions.sql import register
from vecspark.operators.decoders import combined_energy
from vecspark.operators.linear import LinearCodec, default_dim, golden_matrix, golden_relation
from vecspark.operators.pipeline import CompressionPipeline, byte_size
from vecspark.operators.pq import Lcg, PQConfig, ProductQuantizer, kmeans
from vecspark.operators.rotation import Rotation, auto_scale


def one(spark, expr, **arrays):
    df = spark.range(1).select(*[F.lit([float(x) for x in v]).alias(k) if v else F.array().cast("array<double>").alias(k) for k, v in arrays.items()])
    return df.select(expr.alias("r")).first()["r"]


def test_small_values(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, V.normalize(a), a=[3, 4]) == pytest.approx([0.6, 0.8])
    assert one(spark, V.normalize(a), a=[0, 0]) == [0, 0]
    assert one(spark, V.cosine(a, b), a=[1, 0], b=[0, 0]) == 0
    assert one(spark, V.mse(a, b), a=[1, 2, 3, 4], b=[1.1, 2.1, 3.1, 4.1]) == pytest.approx(0.01)
    assert one(spark, V.mse(a, b), a=[], b=[]) == 0
    assert one(spark, V.mae(a, b), a=[1, 2], b=[2, 4]) == 1.5
    assert one(spark, V.euclidean(a, b), a=[0, 0], b=[3, 4]) == 5
    assert one(spark, V.snr_db(a, b), a=[1, 2, 3, 4], b=[1.1, 2.1, 3.1, 4.1]) == pytest.approx(28.750613, abs=1e-5)
    assert one(spark, V.snr_db(a, a), a=[1, 2]) == math.inf
    assert one(spark, V.replicate(a, 384, 8), a=[0.1 * i for i in range(1, 9)])[0] == pytest.approx(0.1)
    assert one(spark, V.subvector(a, 1, 3), a=[1, 2, 3, 4]) == [4, 0, 0]


@pytest.mark.parametrize(("values", "codes"), [([0, 0.5, 1], [0, 128, 255]), ([-1, -0.5, 0, 0.5, 1], [0, 64, 128, 191, 255]), ([0.5, 0.5, 0.5], [128] * 3), ([0.1, 0.5, -0.3, 0.8], [93, 185, 0, 255])])
def test_quantize8(spark, values, codes):
    got = one(spark, V.quantize8(F.col("a")), a=values)
    assert got["data"] == codes
    assert one(spark, V.roundtrip8(F.col("a")), a=values) == pytest.approx(values, abs=(max(values) - min(values)) / 500 + 1e-9)


def test_golden_weights(spark):
    w = golden_matrix(64, 8)
    assert w[0, :4] == pytest.approx([0.161574, 0.146781, 0.134696, 0.124825], abs=1e-6)
    assert golden_matrix(64, 4)[0, 8] == pytest.approx(0.084634, abs=1e-6)
    assert [(golden_matrix(64, k).sum(1) == 0).sum() for k in (13, 16)] == [5, 8]
    assert (golden_matrix(384, 8) @ (np.arange(384) / 384))[:2] == pytest.approx([0.061527, 0.186527], abs=1e-6)
    rel = {(r.out_idx, r.in_idx): r.weight for r in golden_relation(spark, 64, 13).collect()}
    assert max(abs(rel[o, i] - golden_matrix(64, 13)[o, i]) for o in range(13) for i in range(64)) < 1e-12
    assert (default_dim(384), default_dim(768)) == (64, 88)
    with pytest.raises(ValueError, match="cannot project"):
        LinearCodec.golden(4, 8)
    with pytest.raises(ValueError, match="do not make"):
        LinearCodec.from_flat([1.0] * 5, 3, 2)


def test_rotation(spark):
    r = Rotation(64, 1.75)
    v = [1, 2, 3, 4] * 16
    got = one(spark, r.forward(F.col("a")), a=v)
    assert got[:4] == pytest.approx([-3.957721, -3.599313, 0.211996, -1.156048], abs=1e-5)
    assert got[60:] == pytest.approx([3.426053, 0.840596, -3.288175, -2.596817], abs=1e-5)
    assert one(spark, r.inverse(r.forward(F.col("a"))), a=v) == pytest.approx(v)
    assert one(spark, Rotation(6, 1.0).forward(F.col("a")), a=[1, 2, 3, 4, 5, 6])[4:] == [0, 0]
    assert one(spark, Rotation(64, 1.0, False).forward(F.col("a")), a=v) == v
    assert [auto_scale(d) for d in (384, 768, 1024, 3072)] == [1.75, 2.0, 1.75, 1.5]


def test_energy_matches_numpy(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=64), rng.normal(size=8)
    got = one(spark, E.combined(F.col("x"), F.col("y"), 64, 8), x=x.tolist(), y=y.tolist())
    assert got == pytest.approx(combined_energy(x[None], y)[0])


def test_pq(spark):
    assert (PQConfig(35, 7).width, PQConfig(35, 7).code_bytes, PQConfig(26, 17).width, PQConfig(52, 10).width) == (5, 7, 2, 6)
    assert [round(Lcg(12345, True).draw(), 6)] == [0.015685]
    rng = np.random.default_rng(1)
    data = rng.normal(size=(60, 13))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, v array<double>")
    pq = ProductQuantizer.train(df, "v", PQConfig(13, 7, 3), iterations=10, restarts=1)
    rows = df.withColumn("c", pq.encode(F.col("v"))).withColumn("d", pq.decode(F.col("c"))).orderBy("vec_id").collect()
    bulk = {r.vec_id: list(r.codes) for r in pq.encode_bulk(df, "v").collect()}
    assert all(list(r.c) == bulk[r.vec_id] and len(r.d) == 13 for r in rows)
    again = ProductQuantizer.from_json(pq.to_json())
    assert np.allclose(again.centroids, pq.centroids)
    few, _ = kmeans(data[:3, :2], 8)
    assert np.isinf(few[3:]).all()
    assert (kmeans(data[:3, :2], 8, faithful=True)[0][3:] == 0).all()


def test_fully_padded_subspaces_add_nothing(spark):
    pq = ProductQuantizer(PQConfig(8, 5, 1), np.zeros((5, 2, 2)))
    t = one(spark, pq.tables(F.col("q")), q=[1.0] * 8)
    assert t[4] == [0.0, 0.0]
    assert t[0] == [2.0, 2.0]


def test_pipeline(spark):
    codec = LinearCodec.golden(64, 8)
    assert (byte_size("linear", 13), byte_size("full", 13, 7)) == (52, 17)
    with pytest.raises(ValueError, match="codebook"):
        CompressionPipeline(codec, "full")
    df = spark.createDataFrame([(0, [float(i) for i in range(64)])], "vec_id long, embedding array<float>")
    row = CompressionPipeline(codec, "8bit_linear").transform(df).first()["compressed"]
    assert (row["original_min"], row["original_max"], row["codes"], row["compression_ratio"]) == (0.0, 63.0, None, 6.4)
    back = df.select(CompressionPipeline(codec).decompress(CompressionPipeline(codec).compress(F.col("embedding"))).alias("x")).first()["x"]
    assert len(back) == 64


def test_sql_functions(spark):
    register(spark)
    row = spark.sql("select vec_cosine(array(3D, 4D), array(3D, 4D)) c, vec_quantize8(array(0D, 0.5D, 1D)) q, vec_norm(array(3D, 4D)) n, vec_project(array(array(1D, 2D)), array(1D, 1D)) p").first()
    assert (row.c, list(row.q), row.n, list(row.p)) == (1.0, [0, 128, 255], 5.0, [3.0])
