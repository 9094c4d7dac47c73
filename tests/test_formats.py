import json

import pytest
from pyspark.sql import functions as F

from vecspark import cli
from vecspark.sources import aqed, csv_vectors, registry
from vecspark.sources.config import Config, masked_key, well_formed_key
from vecspark.sources.files import write_bytes
from vecspark.sources.loader import load_embeddings


def test_settings(tmp_path, capsys):
    path = tmp_path / "own" / "config.toml"
    assert cli.main(["--config", str(path), "config", "path"]) == 0
    assert capsys.readouterr().out.strip() == str(path)
    cli.main(["--config", str(path), "config", "set", "default-model", 'text-"minilm'])
    cli.main(["--config", str(path), "config", "set", "standalone-training", "false"])
    assert Config.load(path).items() == {"default_model": 'text-"minilm', "benchmark_pretrained": True, "benchmark_with_train": True, "standalone_training": False}
    cli.main(["--config", str(path), "config", "get", "default-model"])
    assert json.loads(capsys.readouterr().out) == 'text-"minilm'
    with pytest.raises(ValueError, match="standalone_training"):
        cli.main(["--config", str(path), "train", "x.json", "-o", "y"])
    with pytest.raises(ValueError, match="no setting"):
        cli.main(["--config", str(path), "config", "set", "colour", "red"])
    with pytest.raises(ValueError, match="which setting"):
        cli.main(["--config", str(path), "config", "get"])
    path.write_text("colour = 1")
    with pytest.raises(ValueError, match="unknown settings"):
        Config.load(path)
    assert Config.load(tmp_path / "none.toml") == Config()


def test_default_model_sets_the_size(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(cli, "_session", lambda: spark)
    path = tmp_path / "config.toml"
    Config("protein-esm").save(path)
    (tmp_path / "in.json").write_text(json.dumps([[float(i + j) for j in range(320)] for i in range(3)]))
    assert cli.main(["--config", str(path), "compress", str(tmp_path / "in.json"), "-o", str(tmp_path / "out.json")]) == 0
    assert json.loads((tmp_path / "out.json").read_text())["metadata"]["compressed_dim"] == 11


def test_codebooks(spark, tmp_path, monkeypatch, capsys):
    doc = {"config": {"input_dim": 4, "n_subvectors": 2, "bits": 1, "subvec_dim": 2}, "centroids": [[[0, 0], [1, 1]]] * 2, "trained": True}
    write_bytes(spark, f"{tmp_path}/a.pqcb.json", json.dumps(doc).encode())
    write_bytes(spark, f"{tmp_path}/b.json", b"[]")
    assert [tuple(r) for r in registry.codebooks(spark, str(tmp_path)).collect()] == [("a.pqcb.json", 4, 2, 1, 2, True)]
    assert registry.codebooks(spark, f"{tmp_path}/none").count() == 0
    monkeypatch.setattr(cli, "_session", lambda: spark)
    assert cli.main(["pq-list", str(tmp_path)]) == 0
    assert "a.pqcb.json" in capsys.readouterr().out


def test_keys(spark):
    df = spark.createDataFrame([("k_" + "x" * 18,), ("k_short",), ("x" * 30,), (None,)], "k string")
    got = [tuple(r) for r in df.select(well_formed_key(F.col("k"), "k_"), masked_key(F.col("k"))).collect()]
    assert got == [(True, "k_xxxxxx...xxxx"), (False, "*******"), (False, "xxxxxxxx...xxxx"), (None, None)]


@pytest.mark.parametrize("header", [True, False])
def test_csv_of_many_parts(spark, tmp_path, header):
    df = spark.createDataFrame([(i, f"n{i}", [float(i), i / 2]) for i in range(12)], "vec_id long, id string, embedding array<float>")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        csv_vectors.write_csv(df, str(tmp_path / "v.csv"), header)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "v.csv").glob("part-*"))) > 1
    assert sorted((r.id, list(r.embedding)) for r in load_embeddings(spark, str(tmp_path / "v.csv")).collect()) == sorted((f"n{i}", [float(i), i / 2]) for i in range(12))


def test_aqed_paths(spark, tmp_path):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "vec_id long, embedding array<float>")
    aqed.write_aqed(df, f"file:{tmp_path}/v.aqed")
    for path in (f"{tmp_path}/v.aqed", f"file:{tmp_path}/v.aqed", f"file://{tmp_path}/v.aqed"):
        assert [list(r.embedding) for r in load_embeddings(spark, path).orderBy("vec_id").collect()] == [[1, 2], [3, 4]]
