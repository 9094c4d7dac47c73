import io
import json

import numpy as np
import pytest

from vecspark import cli
from vecspark.operators import pairs, sampling, search
from vecspark.operators.pq import dense, kmeans, lloyd
from vecspark.session import shared_root
from vecspark.sources import registry
from vecspark.sources.files import write_bytes


class Input:
    def __init__(self, data):
        self.buffer = io.BytesIO(data)


def test_standard_input_and_output(spark, monkeypatch, capsys):
    monkeypatch.setattr(cli, "_session", lambda: spark)
    rows = [[float(i + j) for j in range(16)] for i in range(5)]
    for data in (json.dumps(rows).encode(), "\n".join(",".join(map(str, r)) for r in rows).encode()):
        monkeypatch.setattr("sys.stdin", Input(data))
        assert cli.main(["compress", "-", "-o", "-", "--dim", "2"]) == 0
        doc = json.loads(capsys.readouterr().out)
        assert doc["metadata"] == {"original_dim": 16, "num_vectors": 5, "compressed_dim": 2, "compression_ratio": 8.0}
        assert len(doc["compressed_vectors"]) == 5


def test_training_wants_a_hundred_vectors(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(cli, "_session", lambda: spark)
    monkeypatch.setattr("sys.stdin", Input(json.dumps([[1.0, 2.0]] * 99).encode()))
    with pytest.raises(ValueError, match="100"):
        cli.main(["train", "-", "-o", str(tmp_path / "w.aqwt")])


def test_codes_document(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(cli, "_session", lambda: spark)
    rows = np.random.default_rng(0).normal(size=(40, 16))
    source = tmp_path / "in.json"
    source.write_text(json.dumps(rows.tolist()))
    assert cli.main(["compress", str(source), "-o", str(tmp_path / "lin.json"), "--dim", "2"]) == 0
    lin = json.loads((tmp_path / "lin.json").read_text())["compressed_vectors"]
    (tmp_path / "codes.json").write_text(json.dumps(lin))
    assert cli.main(["pq-train", str(tmp_path / "codes.json"), "-o", str(tmp_path / "book.json"), "--subvectors", "2", "--bits", "4"]) == 0
    assert cli.main(["compress", str(source), "-o", str(tmp_path / "out.json"), "--dim", "2", "--mode", "full", "--codebook", str(tmp_path / "book.json")]) == 0
    doc = json.loads((tmp_path / "out.json").read_text())
    assert (doc["type"], len(doc["codes"]), doc["metadata"]["output_bytes"], doc["metadata"]["subvectors"], doc["metadata"]["compression_ratio"]) == ("pq", 40, 2, 2, 32.0)


def test_models_with_weights(spark, tmp_path):
    for name in ("text-minilm.aqwt", "w_768d_25d.json", "custom_mine_100d_10d.aqwt", "pq_codebooks/text-minilm_7.pqcb.json"):
        write_bytes(spark, f"{tmp_path}/{name}", b"x")
    rows = {r["name"]: r for r in registry.with_weights(spark, str(tmp_path)).collect()}
    assert [rows[n].has_weights for n in ("text-minilm", "text-mpnet", "protein-esm", "mine")] == [True, True, False, True]
    assert (rows["text-minilm"].n_codebooks, rows["mine"].input_dim, rows["mine"].output_dim) == (1, 100, 10)
    assert not any(r.has_weights for r in registry.with_weights(spark, f"{tmp_path}/none").collect())


def test_shared_folder_is_never_a_local_one_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                class S:
                    def getCheckpointDir(self):
                        return type("N", (), {"isDefined": lambda self: False})()

                return S()

    session = type("S", (), {"conf": type("C", (), {"get": staticmethod(lambda k, d=None: d)}), "sparkContext": Context()})()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_root(session)


def test_search_against_brute_force_with_ties_nulls_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(300, 6)), 1)
    x[100:200] = x[5]
    x[7] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    n = np.sqrt((x * x).sum(1))
    for cells, numbers in ((1 << 21, 1 << 21), (64, 12)):
        monkeypatch.setattr(search, "CELLS", cells)
        monkeypatch.setattr(search, "BLOCK_NUMBERS", numbers)
        got = search.knn(df.where("vec_id % 50 = 0 or vec_id = 7"), df, 12).collect()
        for q in (0, 7, 50, 100, 150, 200, 250):
            sims = np.divide(x @ x[q], n * n[q], out=np.zeros(300), where=n * n[q] > 0).round(12)
            order = [i for i in np.lexsort((np.arange(300), -sims)) if i != q][:12]
            assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == order
        assert {r.query_id for r in got} == {0, 7, 50, 100, 150, 200, 250}


def test_dense_and_starts(spark):
    import pyarrow as pa

    assert dense(pa.array([[1.0], None, [1.0, 2.0, 3.0]]), 2).tolist() == [[1, 0], [0, 0], [1, 2]]
    data = np.random.default_rng(0).normal(size=(200, 2))
    best, inertia = kmeans(data, 8, 20, 3)
    assert inertia == min(lloyd(data, 8, run, 20)[1] for run in range(3))


def test_spread_sample(spark):
    x = np.random.default_rng(2).normal(size=(400, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    ids = sampling.kmeanspp_sample(df, 40, 3)
    assert ids.distinct().count() == 40
    assert [r[0] for r in ids.collect()] == [r[0] for r in sampling.kmeanspp_sample(df.repartition(3), 40, 3).collect()]
    far = pairs.mean_distance(df.join(ids, "vec_id")).first()
    near = pairs.mean_distance(df.where("vec_id < 40")).first()
    assert far.n_pairs == 780 and far.mean_distance > 0.95 * near.mean_distance
