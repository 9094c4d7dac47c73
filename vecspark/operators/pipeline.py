"""Switchable codec: linear, 8-bit then linear, or 8-bit, linear and product quantisation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from .linear import LinearCodec
from .pq import ProductQuantizer
from .rotation import Rotation

#: Mode -> (uses 8 bit, uses PQ, expected quality, description).
MODES = {
    "linear": (False, False, 0.95, "projection only"),
    "8bit_linear": (True, False, 0.95, "8-bit round trip, then projection"),
    "full": (True, True, 0.93, "8-bit round trip, projection, product quantisation"),
}


def byte_size(mode: str, compressed_dim: int, code_bytes: int = 0) -> int:
    """Bytes of one stored vector."""
    return {"linear": 4 * compressed_dim, "8bit_linear": 4 * compressed_dim + 8, "full": code_bytes + 10}[mode]


@dataclass
class CompressionPipeline:
    codec: LinearCodec
    mode: str = "linear"
    quantizer: ProductQuantizer | None = None
    rotation: Rotation | None = None

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"no mode {self.mode}")
        if self.mode == "full" and self.quantizer is None:
            raise ValueError("mode full needs a trained codebook")

    def projected(self, v: Column) -> Column:
        """What the linear stage gives."""
        v = V.as_double(v)
        if self.rotation is not None:
            v = self.rotation.forward(v)
        return self.codec.compress(V.roundtrip8(v) if MODES[self.mode][0] else v)

    def compress(self, v: Column) -> Column:
        """Struct of everything that is stored, with size, ratio and expected quality."""
        uses8, uses_pq, quality, _ = MODES[self.mode]
        y = self.projected(v)
        size = byte_size(self.mode, self.codec.compressed_dim, self.quantizer.config.code_bytes if self.quantizer else 0)
        wide = V.as_double(v)
        none = F.lit(None)
        return F.struct(
            F.lit(self.mode).alias("mode"),
            (none.cast("array<double>") if uses_pq else y).alias("projected"),
            (self.quantizer.encode(y) if uses_pq else none.cast("array<smallint>")).alias("codes"),
            F.lit(self.codec.compressed_dim).alias("compressed_dim"),
            (F.array_min(wide) if uses8 else none.cast("double")).alias("original_min"),
            (F.array_max(wide) if uses8 else none.cast("double")).alias("original_max"),
            F.size(v).alias("original_dim"),
            (F.size(v) * 4 / F.lit(float(size))).alias("compression_ratio"),
            F.lit(quality).alias("estimated_quality"),
        )

    def output(self, stored: Column) -> Column:
        """The (approximate) linear code of a stored struct."""
        return self.quantizer.decode(stored["codes"]) if MODES[self.mode][1] else stored["projected"]

    def decompress(self, stored: Column) -> Column:
        """Back to the original space by transpose projection."""
        x = self.codec.decompress(self.output(stored))
        return self.rotation.inverse(x) if self.rotation is not None else x

    def transform(self, df: DataFrame, column: str = "embedding", out: str = "compressed") -> DataFrame:
        """Works on batch and streaming frames alike: every step is a projection."""
        return df.withColumn(out, self.compress(F.col(column)))

    def stats(self, original_dim: int) -> dict:
        uses8, uses_pq, _, text = MODES[self.mode]
        size = byte_size(self.mode, self.codec.compressed_dim, self.quantizer.config.code_bytes if self.quantizer else 0)
        return {"mode": self.mode, "description": text, "original_bytes": 4 * original_dim, "compressed_bytes": size, "compression_ratio": 4 * original_dim / size, "stage1_enabled": uses8, "stage3_enabled": uses_pq}
