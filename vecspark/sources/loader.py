"""One entry for every format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import aqed, csv_vectors, json_vectors
from .detect import detect_path


def load_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(vec_id, embedding, ...) of any supported file; rows with numbers that are not finite are an error."""
    kind = detect_path(spark, path)
    if kind == "hdf5":
        raise NotImplementedError("HDF5 is recognised but not read")
    mounted = "://" not in path or path.startswith("file:")
    read = {"aqed": aqed.read_aqed if mounted else aqed.read_aqed_binary, "json": json_vectors.read_json, "csv": csv_vectors.read_csv, "parquet": lambda s, p: s.read.parquet(p)}[kind]
    return check(read(spark, path))


def check(df: DataFrame, dimension: int | None = None) -> DataFrame:
    """``df`` after one pass that checks widths and finite numbers."""
    width = F.size("embedding")
    odd = F.exists("embedding", lambda x: F.isnan(x) | x.isNull() | (F.abs(x) == float("inf")))
    got = df.agg(F.count(F.lit(1)).alias("n"), F.min(width).alias("lo"), F.max(width).alias("hi"), F.max(odd.cast("int")).alias("odd")).first()
    if not got["n"]:
        raise ValueError("no vectors")
    if got["lo"] != got["hi"] or dimension not in (None, got["hi"]):
        raise ValueError(f"vectors of {got['lo']} to {got['hi']} dimensions" + (f", {dimension} expected" if dimension else ""))
    if got["odd"]:
        raise ValueError("vectors hold numbers that are not finite")
    return df
