"""Column builders for vectors: everything stays a JVM expression.

Vectors are ``array<float>`` or ``array<double>``; arithmetic is in double.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import let
from .constants import COSINE_ZERO, NOISE_ZERO, NORM_ZERO, RANGE_ZERO


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def normalize(v: Column) -> Column:
    """Unit length; vectors below 1e-10 stay as they are."""
    return let(v, lambda v: let(norm(v), lambda n: F.when(n > NORM_ZERO, F.transform(v, lambda x: x / n)).otherwise(v)))


def cosine(a: Column, b: Column, na: Column | None = None, nb: Column | None = None) -> Column:
    """Clamped to [-1, 1]; 0 when a norm is below 1e-9. Norms that are known as columns make it one dot product."""


    def scored(s: Column) -> Column:
        na, nb = s["na"], s["nb"]
        return F.when((na < COSINE_ZERO) | (nb < COSINE_ZERO), F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s["d"] / (na * nb))))

    def bound(s: Column) -> Column:
        x, y = s["a"], s["b"]
        return F.struct(dot(x, y).alias("d"), (norm(x) if na is None else na).alias("na"), (norm(y) if nb is None else nb).alias("nb"))

    return let(let(F.struct(a.alias("a"), b.alias("b")), bound), scored)


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def _mean(value: Column, v: Column) -> Column:
    return F.when(F.size(v) == 0, F.lit(0.0)).otherwise(value / F.size(v))


def mse(a: Column, b: Column) -> Column:
    return _mean(squared_distance(a, b), a)


def mae(a: Column, b: Column) -> Column:
    return _mean(total(F.zip_with(a, b, lambda x, y: F.abs(x - y))), a)


def snr_db(signal: Column, other: Column) -> Column:
    """10 log10 of signal over noise; infinite when the noise is below 1e-12."""

    def ratio(s: Column) -> Column:
        return F.when(s["noise"] < NOISE_ZERO, F.lit(float("inf"))).otherwise(10 * F.log10(s["power"] / s["noise"]))

    bound = let(F.struct(signal.alias("a"), other.alias("b")), lambda s: F.struct(dot(s["a"], s["a"]).alias("power"), squared_distance(s["a"], s["b"]).alias("noise")))
    return let(bound, ratio)


def distance_to_cosine(squared: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - squared / 2))


def project(v: Column, weights: list[list[float]]) -> Column:
    """W v for a small literal matrix; dimensions missing in ``v`` count as 0. Bulk data: ``LinearCodec.project_bulk``."""
    rows = F.lit([[float(x) for x in row] for row in weights])
    return let(v, lambda v: F.transform(rows, lambda r: F.aggregate(F.zip_with(r, v, lambda w, x: w * F.coalesce(x, F.lit(0.0))), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))))


def replicate(y: Column, original_dim: int, compressed_dim: int) -> Column:
    """Each output repeats the value of its block: y[min(i div (D div K), K - 1)]."""
    if compressed_dim > original_dim or compressed_dim < 1:
        raise ValueError(f"cannot replicate {compressed_dim} values over {original_dim} dimensions")
    per = original_dim // compressed_dim
    return let(y, lambda y: F.transform(F.sequence(F.lit(0), F.lit(original_dim - 1)), lambda i: F.get(y, F.least((i / per).cast("int"), F.lit(compressed_dim - 1)))))


def subvector(v: Column, index, width: int) -> Column:
    """Sub-vector number ``index`` of ``width`` values, zero beyond the end."""
    start = (F.lit(index) if isinstance(index, int) else index) * width
    return let(v, lambda v: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.coalesce(F.get(v, start + j), F.lit(0.0))))


def quantize8(v: Column) -> Column:
    """Struct (data array<smallint>, min, max): min/max 8-bit codes, halves away from zero; constant vectors give 128."""

    def codes(s: Column) -> Column:
        return F.when(s["hi"] - s["lo"] < RANGE_ZERO, F.transform(s["v"], lambda x: F.lit(128).cast("smallint"))).otherwise(
            F.transform(s["v"], lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.round((x - s["lo"]) * (255.0 / (s["hi"] - s["lo"]))))).cast("smallint"))
        )

    bound = let(v, lambda v: F.struct(v.alias("v"), F.array_min(v).alias("lo"), F.array_max(v).alias("hi")))
    return let(bound, lambda s: F.struct(codes(s).alias("data"), s["lo"].alias("min"), s["hi"].alias("max")))


def dequantize8(q: Column) -> Column:
    def values(q: Column) -> Column:
        span = q["max"] - q["min"]
        return F.transform(q["data"], lambda c: F.when(span < RANGE_ZERO, q["min"]).otherwise(q["min"] + c * (span / 255.0)))

    return let(q, values)


def roundtrip8(v: Column) -> Column:
    return dequantize8(quantize8(v))
