"""Known models as a relation, and rules that look models up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import listing

#: Name, input and output dimension, published rank correlation, source, PQ options.
MODELS = (
    ("text-minilm", 384, 13, 0.971, "minilm", [7, 4]),
    ("text-mpnet", 768, 26, 0.983, "mpnet", [7, 4]),
    ("text-e5large", 1024, 35, 0.982, "e5-large", [7, 5]),
    ("mistral-embed", 1024, 35, 0.962, "mistral-embed", []),
    ("openai-small", 1536, 52, 0.950, "openai-small", [13, 10, 7]),
    ("openai-large", 3072, 105, 0.950, "openai-large", [10, 8, 6, 4]),
    ("audio-wav2vec2", 768, 26, 0.971, "audio-wav2vec2", [13, 10, 7, 4]),
    ("protein-esm", 320, 11, 0.950, "protein-esm", [6, 4]),
)
RATIOS = (10, 20, 29, 50, 100)


def models(spark: SparkSession) -> DataFrame:
    rows = [(k, *m) for k, m in enumerate(MODELS)]
    return spark.createDataFrame(rows, "position int, name string, input_dim int, output_dim int, spearman double, source string, pq_options array<int>")


def with_weights(spark: SparkSession, folder: str) -> DataFrame:
    """``models`` with has_weights and n_codebooks from the files of a weights folder, and the custom models found there.

    Weights of a model: a ``.aqwt`` file named after it, or ``*<D>d_<K>d.aqwt|json`` with K = max(4, D div 30);
    codebooks: ``pq_codebooks/*<name>*.pqcb.json``; custom models: ``custom_<name>_<D>d_<K>d.aqwt``.
    """
    files, books = listing(spark, folder), [f for f in listing(spark, f"{folder}/pq_codebooks") if f.endswith(".pqcb.json")]
    rows = []
    for k, (name, dim, out, rho, source, options) in enumerate(MODELS):
        sized = tuple(f"{dim}d_{max(4, dim // 30)}d.{kind}" for kind in ("aqwt", "json"))
        found = any(f.endswith(".aqwt") and name in f or f.endswith(sized) for f in files)
        rows.append((k, name, dim, out, rho, source, options, found, sum(name in b for b in books)))
    for f in sorted(f for f in files if f.startswith("custom_") and f.endswith(".aqwt")):
        parts = f.removesuffix(".aqwt").split("_")
        sizes = [int(p[:-1]) if p[:-1].isdigit() else 0 for p in (*parts[2:4], "", "")[:2]]
        if len(parts) >= 3 and parts[1] not in {r[1] for r in rows}:
            rows.append((len(rows), parts[1], sizes[0], sizes[1], None, "custom", [], True, sum(parts[1] in b for b in books)))
    return spark.createDataFrame(rows, "position int, name string, input_dim int, output_dim int, spearman double, source string, pq_options array<int>, has_weights boolean, n_codebooks int")


def codebooks(spark: SparkSession, folder: str) -> DataFrame:
    """(name, input_dim, subvectors, bits, code_bytes, trained) of the files ``*.pqcb.json`` in a folder."""
    from .weights import load_codebook

    rows = []
    for name in (f for f in listing(spark, folder) if f.endswith(".pqcb.json")):
        pq = load_codebook(spark, f"{folder}/{name}")
        rows.append((name, pq.config.input_dim, pq.config.n_subvectors, pq.config.bits, pq.config.code_bytes, pq.trained))
    return spark.createDataFrame(rows, "name string, input_dim int, subvectors int, bits int, code_bytes int, trained boolean")


def by_name(spark: SparkSession, name: str) -> DataFrame:
    return models(spark).where((F.col("name") == name) | (F.col("source") == name))


def by_dimension(spark: SparkSession, dim: int) -> DataFrame:
    """The first model of an input dimension."""
    return models(spark).where(F.col("input_dim") == dim).orderBy("position").limit(1)


def verdict(rho: Column) -> Column:
    return F.when(rho >= 0.95, "excellent").when(rho >= 0.90, "good").otherwise("poor")


def validation_verdict(rho: Column) -> Column:
    return F.when(rho >= 0.95, "excellent").when(rho >= 0.90, "good").when(rho >= 0.85, "acceptable").otherwise("poor")


def subvector_quality(m: Column) -> Column:
    return F.when(m >= 10, "excellent").when(m >= 7, "good").when(m >= 5, "fair").otherwise("low")
