"""Weight files: AQWT (binary), raw floats, JSON, and PQ codebooks."""

from __future__ import annotations

import json
import struct
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..operators.linear import LinearCodec
from ..operators.pq import ProductQuantizer
from .files import read_bytes, write_bytes

MAGIC = b"AQWT"
#: Byte -> kind of model.
MODEL_TYPES = {0: "unknown", 1: "text", 2: "audio", 3: "openai", 4: "protein"}
HEADER = {1: 14, 2: 18}


@dataclass
class BinaryWeights:
    """Header 18 bytes in version 2, 14 (without rotation scale) in version 1; then K x D floats, row by row."""

    original_dim: int
    compressed_dim: int
    model_type: str
    spearman: float
    rotation_scale: float
    weights: np.ndarray

    def to_bytes(self) -> bytes:
        kind = next((k for k, v in MODEL_TYPES.items() if v == self.model_type), 0)
        head = MAGIC + struct.pack("<BHHBff", 2, self.original_dim, self.compressed_dim, kind, self.spearman, self.rotation_scale)
        return head + np.asarray(self.weights, "<f4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> BinaryWeights:
        if len(data) < HEADER[1]:
            raise ValueError("weights: too short")
        if data[:4] != MAGIC:
            raise ValueError("weights: wrong magic")
        version, original, compressed, kind, rho = struct.unpack_from("<BHHBf", data, 4)
        if version not in HEADER:
            raise ValueError(f"weights: version {version} is not supported")
        if len(data) < HEADER[version] + 4 * original * compressed:
            raise ValueError("weights: data cut short")
        scale = struct.unpack_from("<f", data, 14)[0] if version == 2 else 1.75
        flat = np.frombuffer(data, "<f4", original * compressed, HEADER[version])
        return cls(original, compressed, MODEL_TYPES.get(kind, "unknown"), rho, scale, flat.reshape(compressed, original).astype(float))

    def codec(self) -> LinearCodec:
        return LinearCodec(np.asarray(self.weights, float), True)

    def info(self, spark: SparkSession) -> DataFrame:
        """One row: sizes, ratio, score, rotation, kind, count."""
        row = (self.original_dim, self.compressed_dim, self.original_dim / self.compressed_dim, float(self.spearman), float(self.rotation_scale), self.model_type, int(np.size(self.weights)), len(self.to_bytes()))
        return spark.createDataFrame([row], "original_dim int, compressed_dim int, ratio double, spearman double, rotation_scale double, model_type string, n_weights long, size_bytes long")


def load_weights(spark: SparkSession, path: str) -> BinaryWeights:
    """AQWT, or the JSON document that older trainers left under the same name."""
    data = read_bytes(spark, path)
    if data[:4] == MAGIC:
        return BinaryWeights.from_bytes(data)
    doc = json.loads(data)
    d, k = doc["original_dim"], doc["compressed_dim"]
    return BinaryWeights(d, k, "text", doc.get("val_score") or 0.0, 0.0, np.array(doc["weights"], float).reshape(k, d))


def save_weights(spark: SparkSession, path: str, weights: BinaryWeights) -> None:
    write_bytes(spark, path, weights.to_bytes())


def load_flat(spark: SparkSession, path: str, original_dim: int, compressed_dim: int) -> LinearCodec:
    """A flat JSON array, or headerless floats."""
    data = read_bytes(spark, path)
    flat = json.loads(data) if path.endswith(".json") else np.frombuffer(data, "<f4")
    return LinearCodec.from_flat(flat, original_dim, compressed_dim)


def save_flat(spark: SparkSession, path: str, codec: LinearCodec) -> None:
    flat = codec.flat()
    write_bytes(spark, path, json.dumps(flat).encode() if path.endswith(".json") else np.asarray(flat, "<f4").tobytes())


def load_codebook(spark: SparkSession, path: str) -> ProductQuantizer:
    return ProductQuantizer.from_json(read_bytes(spark, path).decode())


def save_codebook(spark: SparkSession, path: str, pq: ProductQuantizer) -> None:
    write_bytes(spark, path, pq.to_json().encode())
