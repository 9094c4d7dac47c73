"""Linear projection codec: closed-form golden-ratio weights or trained ones."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions import vectors as V
from ..functions.constants import BLOCK, PHI, WEIGHT_ZERO
from ..session import ship
from .pq import dense, lists


def golden_matrix(original_dim: int, compressed_dim: int) -> np.ndarray:
    """K x D weights: output o owns a run of 8-blocks; weights fall within a block and with its distance from the run's middle. Rows sum to 1.

    Beyond K = ceil(D / 8) some outputs own no block and their rows are zero.
    """
    blocks = -(-original_dim // BLOCK)
    o = np.arange(compressed_dim)[:, None]
    first, last = o * blocks // compressed_dim, (o + 1) * blocks // compressed_dim
    i = np.arange(original_dim)[None, :]
    block = i // BLOCK
    length = np.minimum(BLOCK, original_dim - block * BLOCK)
    within = (1 + np.exp(-(i % BLOCK) / length * PHI)) / 2
    weight = np.where((block >= first) & (block < last), within / (1 + 0.1 * np.abs(block - (first + last) / 2)), 0.0)
    sums = weight.sum(axis=1, keepdims=True)
    return np.divide(weight, sums, out=weight, where=sums > 1e-10)


def golden_relation(spark: SparkSession, original_dim: int, compressed_dim: int) -> DataFrame:
    """(out_idx, in_idx, weight) by the same closed form, as a plan."""
    blocks = -(-original_dim // BLOCK)
    cells = spark.range(compressed_dim * original_dim).select((F.col("id") / original_dim).cast("int").alias("out_idx"), (F.col("id") % original_dim).cast("int").alias("in_idx"))
    first = F.expr(f"(out_idx * {blocks}) div {compressed_dim}")
    last = F.expr(f"((out_idx + 1) * {blocks}) div {compressed_dim}")
    block = F.expr(f"in_idx div {BLOCK}")
    length = F.least(F.lit(BLOCK), original_dim - block * BLOCK)
    within = (1 + F.exp(-(F.col("in_idx") % BLOCK) / length * PHI)) / 2
    raw = F.when((block >= first) & (block < last), within / (1 + 0.1 * F.abs(block - (first + last) / 2))).otherwise(F.lit(0.0))
    cells = cells.withColumn("raw", raw)
    sums = F.sum("raw").over(Window.partitionBy("out_idx"))
    return cells.select("out_idx", "in_idx", F.when(sums > 1e-10, F.col("raw") / sums).otherwise(F.col("raw")).alias("weight"))


def default_dim(original_dim: int) -> int:
    """Output size when none is asked for: 3 sqrt(D), up to a multiple of 8."""
    return -(-math.floor(3 * math.sqrt(original_dim)) // 8) * 8


@dataclass
class LinearCodec:
    """K x D weights with ways to and back."""

    weights: np.ndarray
    trained: bool = False

    @classmethod
    def golden(cls, original_dim: int = 384, compressed_dim: int = 8) -> LinearCodec:
        if compressed_dim > original_dim or compressed_dim < 1:
            raise ValueError(f"cannot project {original_dim} dimensions to {compressed_dim}")
        return cls(golden_matrix(original_dim, compressed_dim))

    @classmethod
    def from_flat(cls, flat, original_dim: int, compressed_dim: int) -> LinearCodec:
        flat = np.asarray(flat, float)
        if flat.size != original_dim * compressed_dim:
            raise ValueError(f"{flat.size} weights do not make a {compressed_dim} x {original_dim} matrix")
        return cls(flat.reshape(compressed_dim, original_dim), True)

    @property
    def original_dim(self) -> int:
        return self.weights.shape[1]

    @property
    def compressed_dim(self) -> int:
        return self.weights.shape[0]

    def flat(self) -> list[float]:
        return self.weights.ravel().tolist()

    def effective(self) -> np.ndarray:
        """The weights that count when compressing."""
        return np.where(np.abs(self.weights) > WEIGHT_ZERO, self.weights, 0.0)

    def compress(self, v: Column) -> Column:
        return V.project(V.as_double(v), self.effective().tolist())

    def decompress(self, y: Column) -> Column:
        """Transpose projection."""
        return V.project(y, self.weights.T.tolist())

    def replicate(self, y: Column) -> Column:
        return V.replicate(y, self.original_dim, self.compressed_dim)

    def project_bulk(self, df: DataFrame, column: str = "embedding", out: str = "code") -> DataFrame:
        """``df`` with ``out``: one matrix product per Arrow batch, for long vectors and large tables."""
        ship(df.sparkSession)
        shared = df.sparkSession.sparkContext.broadcast(self.weights.T.copy())
        schema = StructType([*df.schema.fields, StructField(out, ArrayType(DoubleType()))])
        at = df.columns.index(column)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w = shared.value
            for batch in batches:
                codes = lists(dense(batch.column(at), w.shape[0]) @ w, batch.column(at).is_null())
                yield pa.RecordBatch.from_arrays([*batch.columns, codes], names=[*batch.schema.names, out])

        return df.mapInArrow(run, schema)
