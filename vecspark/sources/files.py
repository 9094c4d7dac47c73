"""Small files read and written through Spark's file system, so any store that Spark reads works."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, place


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """One whole file: weights, codebooks, JSON documents."""
    row = spark.read.format("binaryFile").load(path).select("content").first()
    if row is None:
        raise FileNotFoundError(path)
    return bytes(row["content"])


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(data)
    finally:
        out.close()


def listing(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, none where it does not exist."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in store.listStatus(where)) if store.exists(where) else []


def line_positions(df: DataFrame) -> DataFrame:
    """``df`` with ``vec_id``: 0, 1, ... in the order of the input's lines."""
    return place(materialise(df.withColumn("__at", F.monotonically_increasing_id()), "lines"), "vec_id")
