"""Energies of a reconstruction against its compressed form, as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import BLOCK
from .vectors import total

RECONSTRUCTION, SMOOTHNESS, BLOCK_VARIANCE, LOCAL, GRADIENT = 0.5, 0.3, 0.1, 0.15, 0.05
NEIGHBOURS = 3
OCTONION_SHARE, LOCAL_SHARE = 0.7, 0.3


def _range(first: int, last: int) -> Column:
    return F.sequence(F.lit(first), F.lit(last)) if last >= first else F.array().cast("array<int>")


def reconstruction(x: Column, y: Column, dim: int, compressed: int) -> Column:
    """Squared gap between each compressed value and the mean of the blocks it stands for."""
    blocks = -(-dim // BLOCK)
    width = blocks // max(compressed, 1) * BLOCK

    def gap(o: Column) -> Column:
        own = F.slice(x, o * width + 1, width) if width else F.array().cast("array<double>")
        mean = F.when(F.size(own) > 0, total(own) / F.size(own)).otherwise(F.lit(0.0))
        d = mean - F.coalesce(F.get(y, o), F.lit(0.0))
        return d * d

    return RECONSTRUCTION * total(F.transform(_range(0, compressed - 1), gap))


def smoothness(x: Column, dim: int) -> Column:
    def step(i: Column) -> Column:
        d = F.get(x, i) - F.get(x, i - 1)
        return d * d

    return SMOOTHNESS / dim * total(F.transform(_range(1, dim - 1), step)) if dim >= 2 else F.lit(0.0)


def block_variance(x: Column, dim: int) -> Column:
    def spread(b: Column) -> Column:
        return F.transform(F.array(F.slice(x, b * BLOCK + 1, BLOCK)), lambda own: total(F.transform(own, lambda v: (v - total(own) / F.size(own)) * (v - total(own) / F.size(own)))))[0]

    return BLOCK_VARIANCE / dim * total(F.transform(_range(0, -(-dim // BLOCK) - 1), spread))


def local(x: Column, dim: int) -> Column:
    def gap(i: Column) -> Column:
        around = sum((F.get(x, (i + d) % dim) for d in range(1, NEIGHBOURS + 1)), F.lit(0.0))
        return F.abs(F.get(x, i) - around / NEIGHBOURS)

    return LOCAL / dim * total(F.transform(_range(0, dim - 1), gap))


def gradient(x: Column, dim: int) -> Column:
    bend = lambda i: F.abs(F.get(x, i - 1) - 2 * F.get(x, i) + F.get(x, i + 1))
    return GRADIENT / dim * total(F.transform(_range(1, dim - 2), bend)) if dim >= 3 else F.lit(0.0)


def octonion(x: Column, y: Column, dim: int, compressed: int) -> Column:
    return reconstruction(x, y, dim, compressed) + smoothness(x, dim) + block_variance(x, dim)


def local_consistency(x: Column, dim: int) -> Column:
    return local(x, dim) + gradient(x, dim)


def combined(x: Column, y: Column, dim: int, compressed: int) -> Column:
    return OCTONION_SHARE * octonion(x, y, dim, compressed) + LOCAL_SHARE * local_consistency(x, dim)


def param_count(dim: int, compressed: int) -> int:
    return (compressed + 2) + (dim + 2)


def default_weights(dim: int, compressed: int) -> list[float]:
    return [0.1] * param_count(dim, compressed)
