import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecspark.sources import aqed, csv_vectors, json_vectors, registry, synthetic
from vecspark.sources.detect import detect, detect_text, output_format
from vecspark.sources.files import write_bytes
from vecspark.sources.loader import check, load_embeddings
from vecspark.sources.weights import BinaryWeights, load_codebook, load_flat, load_weights, save_codebook, save_flat, save_weights


def frame(spark, n=5, d=3):
    return spark.createDataFrame([(i, [float(i + j) for j in range(d)], f"l{i % 2}") for i in range(n)], "vec_id long, embedding array<float>, label string")


def vectors(df):
    return [list(r.embedding) for r in df.orderBy("vec_id").collect()]


def test_detect():
    assert detect(b"AQED....", "x.bin") == "aqed"
    assert detect(b"\x89HDF\r\n\x1a\n", "x") == "hdf5"
    assert detect(b" [1]", "x.csv") == "json"
    assert detect(b"1,2", "x.tsv") == "csv"
    assert (detect_text("x", "{}"), detect_text("x.csv", "{}"), detect_text("x", "1,2"), detect_text("x", "", "json")) == ("json", "csv", "csv", "json")
    assert (output_format("y.csv", "json"), output_format(None, "json")) == ("csv", "json")
    with pytest.raises(ValueError, match="unknown"):
        detect(b"zz", "x")


@pytest.mark.parametrize("doc", [[[1, 2], [3, 4]], {"embeddings": [[1, 2], [3, 4]]}, {"vectors": [[1, 2], [3, 4]]}, [{"vector": [1, 2], "label": "a"}, {"vector": [3, 4]}], {"vectors": [{"id": "a", "embedding": [1, 2]}, {"id": "b", "embedding": [3, 4]}]}, {"embeddings1": [[1, 2]], "embeddings2": [[3, 4]]}])
def test_json_shapes(spark, tmp_path, doc):
    path = str(tmp_path / "x.json")
    (tmp_path / "x.json").write_text(json.dumps(doc))
    assert vectors(load_embeddings(spark, path)) == [[1, 2], [3, 4]]


def test_json_round_trip_and_errors(spark, tmp_path):
    df = frame(spark)
    for simple in (False, True):
        json_vectors.write_json(df, str(tmp_path / f"{simple}.json"), simple)
        assert vectors(json_vectors.read_json(spark, str(tmp_path / f"{simple}.json"))) == vectors(df)
    write_bytes(spark, str(tmp_path / "e.json"), b"[]")
    with pytest.raises(ValueError, match="no vectors"):
        json_vectors.read_json(spark, str(tmp_path / "e.json"))
    write_bytes(spark, str(tmp_path / "l.jsonl"), b'[1,2]\n{"id":"q","vector":[3,4]}\n\n')
    assert vectors(json_vectors.read_json_lines(spark, str(tmp_path / "l.jsonl"))) == [[1, 2], [3, 4]]


def test_pairs(spark, tmp_path):
    for k, doc in enumerate([{"embeddings1": [[1, 0]], "embeddings2": [[0, 1]], "scores": [0.5]}, {"pairs": [{"embedding1": [1, 0], "embedding2": [0, 1], "score": 0.5}]}]):
        (tmp_path / f"{k}.json").write_text(json.dumps(doc))
        row = json_vectors.read_pairs(spark, str(tmp_path / f"{k}.json")).first()
        assert (list(row.e1), list(row.e2), row.score) == ([1, 0], [0, 1], 0.5)
    (tmp_path / "r.json").write_text(json.dumps({"embeddings": [[1], [2], [3]]}))
    assert [list(r.e2) for r in json_vectors.read_pairs(spark, str(tmp_path / "r.json")).orderBy("pair_id").collect()] == [[2], [3], [1]]
    (tmp_path / "s.json").write_text(json.dumps([[1]]))
    with pytest.raises(ValueError, match="two vectors"):
        json_vectors.read_pairs(spark, str(tmp_path / "s.json"))


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,dim_0,dim_1\ndoc_1,0.1,0.2\n\ndoc_2, 0.3 ,0.4\n")
    rows = csv_vectors.read_csv(spark, str(tmp_path / "a.csv")).orderBy("vec_id").collect()
    assert [(r.vec_id, r.id) for r in rows] == [(0, "doc_1"), (1, "doc_2")]
    assert list(rows[1].embedding) == pytest.approx([0.3, 0.4])
    (tmp_path / "b.csv").write_text("0.1,0.2\n0.3\n")
    with pytest.raises(ValueError, match="line 2"):
        csv_vectors.read_csv(spark, str(tmp_path / "b.csv"))
    (tmp_path / "c.csv").write_text("1,2\nx,3\n")
    with pytest.raises(ValueError, match="line 2"):
        csv_vectors.read_csv(spark, str(tmp_path / "c.csv"))
    sniff = spark.createDataFrame([("doc_id,0.1,0.2",), ("id,dim_0,dim_1",), ("1,2,3",)], "value string").select(csv_vectors.looks_like_header(F.col("value"))).collect()
    assert [r[0] for r in sniff] == [False, True, False]
    one = spark.createDataFrame([(0, "doc_1", [0.1, 0.2, 0.3])], "vec_id long, id string, embedding array<float>")
    assert csv_vectors.csv_lines(one).first()["line"] == "doc_1,0.100000,0.200000,0.300000"
    csv_vectors.write_csv(one, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()[0] == "id,dim_0,dim_1,dim_2"


def test_aqed(spark, tmp_path):
    df, path = frame(spark, 7, 2), str(tmp_path / "x.aqed")
    aqed.write_aqed(df, path)
    assert (tmp_path / "x.aqed").stat().st_size == 60 + 7 * 8
    assert vectors(load_embeddings(spark, path)) == vectors(df)
    aqed.register(spark)
    cut = spark.read.format("aqed").option("rowsPerPartition", 3).load(path)
    assert cut.rdd.getNumPartitions() == 3
    assert vectors(cut) == vectors(df) == vectors(aqed.read_aqed_binary(spark, path))
    with pytest.raises(ValueError, match="not an AQED"):
        aqed.parse_header(b"AQEX" + bytes(60))
    with pytest.raises(ValueError, match="without vectors"):
        aqed.parse_header(aqed.header(0, 2))


def test_weights(spark, tmp_path):
    w = BinaryWeights(4, 2, "audio", 0.9, 2.0, np.arange(8.0).reshape(2, 4))
    path = str(tmp_path / "w.aqwt")
    save_weights(spark, path, w)
    got = load_weights(spark, path)
    assert (got.original_dim, got.compressed_dim, got.model_type, round(got.spearman, 3), got.rotation_scale, got.weights.tolist()) == (4, 2, "audio", 0.9, 2.0, w.weights.tolist())
    assert len(BinaryWeights(768, 26, "text", 0, 0, np.zeros((26, 768))).to_bytes()) == 18 + 79_872
    old = b"AQWT" + bytes([1]) + w.to_bytes()[5:14] + w.to_bytes()[18:]
    assert BinaryWeights.from_bytes(old).weights.tolist() == w.weights.tolist()
    for bad, what in ((b"AQ", "short"), (b"XXXX" + bytes(20), "magic"), (b"AQWT\x09" + bytes(20), "version"), (w.to_bytes()[:-1], "cut")):
        with pytest.raises(ValueError, match=what):
            BinaryWeights.from_bytes(bad)
    for name in ("f.json", "f.bin"):
        save_flat(spark, str(tmp_path / name), w.codec())
        assert load_flat(spark, str(tmp_path / name), 4, 2).flat() == w.codec().flat()
    assert got.info(spark).first()["ratio"] == 2.0


def test_codebook_file(spark, tmp_path):
    from vecspark.operators.pq import PQConfig, ProductQuantizer

    pq = ProductQuantizer(PQConfig(4, 2, 1), np.arange(8.0).reshape(2, 2, 2))
    save_codebook(spark, str(tmp_path / "c.json"), pq)
    assert load_codebook(spark, str(tmp_path / "c.json")).centroids.tolist() == pq.centroids.tolist()


def test_checks_and_models(spark):
    uneven = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<float>")
    with pytest.raises(ValueError, match="dimensions"):
        check(uneven)
    with pytest.raises(ValueError, match="finite"):
        check(spark.createDataFrame([(0, [float("nan")])], "vec_id long, embedding array<float>"))
    assert registry.by_dimension(spark, 768).first()["name"] == "text-mpnet"
    assert registry.by_name(spark, "e5-large").first()["output_dim"] == 35
    assert [r[0] for r in spark.createDataFrame([(0.96,), (0.91,), (0.5,)], "r double").select(registry.verdict(F.col("r"))).collect()] == ["excellent", "good", "poor"]


def test_synthetic(spark):
    rows = synthetic.clustered(spark, 64).orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows])
    sims, same = x @ x.T, np.equal.outer([r.cluster for r in rows], [r.cluster for r in rows])
    off = ~np.eye(50, dtype=bool)
    assert sims[same & off].mean() > sims[~same].mean()
    seeds = spark.createDataFrame([(s,) for s in (0, 1, 1000, 1001)], "s long")
    assert [r[0] for r in seeds.select(synthetic.noise(F.col("s"))).collect()] == pytest.approx([-0.999989, 0.027740, 0.728671, -0.243601], abs=1e-5)
