"""Synthetic clustered vectors in closed form."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V


def noise(seed: Column) -> Column:
    """Linear congruential number in [-1, 1) of a whole-number column."""
    return F.pmod(seed.cast("long") * 1103515245 + 12345, F.lit(1 << 31)) / float(1 << 30) - 1


def clustered(spark: SparkSession, dim: int, count: int = 50, clusters: int = 10) -> DataFrame:
    """(vec_id, cluster, embedding): unit vectors around sine and cosine centroids."""
    rows = spark.range(count).select(F.col("id").alias("vec_id"), (F.col("id") % clusters).alias("cluster"), F.expr(f"id div {clusters}").alias("variant"))
    at = F.sequence(F.lit(0), F.lit(dim - 1))
    freq, phase = 0.1 + F.col("cluster") * 0.03, F.col("cluster") * (math.pi / 5)
    raw = F.transform(at, lambda j: F.sin(j * freq + phase) * 0.5 + F.cos(j * freq * 2.3 + phase * 1.7) * 0.3)
    centre = rows.withColumn("c", V.normalize(raw))
    moved = F.transform(at, lambda j: F.get(F.col("c"), j) + noise(F.col("vec_id") * 1000 + j) * 0.3 + F.col("variant") * 0.1 * noise(F.col("variant") * 100 + j))
    return centre.select("vec_id", "cluster", V.normalize(moved).alias("embedding"))
