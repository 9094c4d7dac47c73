"""Quaternion block rotation: an invertible step before quantising."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.constants import GOLDEN_ANGLE

#: Fixed values: (largest dimension, scale); above all of them 1.5.
AUTO_SCALES = ((400, 1.75), (800, 2.0), (1200, 1.75))
PRESETS = {"text_384": 1.75, "audio_768": 2.0, "text_1024": 1.75, "protein_320": 1.75}


def auto_scale(dim: int) -> float:
    return next((scale for top, scale in AUTO_SCALES if dim <= top), 1.5)


def axes(dim: int) -> list[tuple[float, float, float]]:
    """Unit axes on a golden spiral, one per block of four."""
    n = dim // 4
    out = []
    for i in range(n):
        theta, phi = i * GOLDEN_ANGLE, min(i / n * math.pi, math.pi - 0.01)
        out.append((math.sin(phi) * math.cos(theta), math.sin(phi) * math.sin(theta), math.cos(phi)))
    return out


@dataclass(frozen=True)
class Rotation:
    """Rotation of blocks of four; trailing dimensions become 0; a disabled one is the identity."""

    dim: int
    scale: float
    enabled: bool = True

    @classmethod
    def auto(cls, dim: int) -> Rotation:
        return cls(dim, auto_scale(dim))

    def quaternions(self) -> list[tuple[float, float, float, float]]:
        half = GOLDEN_ANGLE * self.scale / 2
        return [(math.cos(half), *(a * math.sin(half) for a in axis)) for axis in axes(self.dim)]

    def _apply(self, v: Column, sign: float) -> Column:
        v = v.cast("array<double>")
        if not self.enabled:
            return v
        q = F.lit([[w, sign * x, sign * y, sign * z] for w, x, y, z in self.quaternions()])

        def turn(r: Column, b: Column) -> Column:
            w, x, y, z = (r[k] for k in range(4))
            e = [F.get(v, 4 * b + k) for k in range(4)]
            return F.array(
                w * e[0] - x * e[1] - y * e[2] - z * e[3],
                w * e[1] + x * e[0] + y * e[3] - z * e[2],
                w * e[2] - x * e[3] + y * e[0] + z * e[1],
                w * e[3] + x * e[2] - y * e[1] + z * e[0],
            )

        tail = F.lit([0.0] * (self.dim % 4)) if self.dim % 4 else F.array().cast("array<double>")
        return F.concat(F.flatten(F.transform(q, turn)), tail)

    def forward(self, v: Column) -> Column:
        return self._apply(v, 1.0)

    def inverse(self, v: Column) -> Column:
        return self._apply(v, -1.0)
