"""Vector functions for SQL text: ``vec_cosine(a, b)`` and the like."""

from __future__ import annotations

from pyspark.sql import SparkSession

_SUM = "aggregate({}, 0D, (s, x) -> s + x)"
_DOT = _SUM.format("zip_with(a, b, (x, y) -> x * y)")
_NORM = "sqrt(" + _SUM.format("transform({0}, x -> x * x)") + ")"

#: name -> (parameters, type, body)
FUNCTIONS = {
    "vec_dot": ("a array<double>, b array<double>", "double", _DOT),
    "vec_norm": ("a array<double>", "double", _NORM.format("a")),
    "vec_cosine": ("a array<double>, b array<double>", "double", f"case when {_NORM.format('a')} < 1e-9 or {_NORM.format('b')} < 1e-9 then 0D else greatest(-1D, least(1D, {_DOT} / ({_NORM.format('a')} * {_NORM.format('b')}))) end"),
    "vec_squared_distance": ("a array<double>, b array<double>", "double", _SUM.format("zip_with(a, b, (x, y) -> (x - y) * (x - y))")),
    "vec_project": ("w array<array<double>>, v array<double>", "array<double>", "transform(w, r -> aggregate(zip_with(r, v, (x, y) -> x * y), 0D, (s, x) -> s + x))"),
    "vec_quantize8": ("v array<double>", "array<smallint>", "case when array_max(v) - array_min(v) < 1.1920929e-07 then transform(v, x -> cast(128 as smallint)) else transform(v, x -> cast(greatest(0D, least(255D, round((x - array_min(v)) * (255D / (array_max(v) - array_min(v)))))) as smallint)) end"),
    "pq_decode": ("book array<array<array<double>>>, codes array<smallint>", "array<double>", "flatten(zip_with(book, codes, (b, c) -> get(b, cast(c as int))))"),
    "pq_encode": ("book array<array<array<double>>>, subs array<array<double>>", "array<smallint>", "zip_with(book, subs, (b, s) -> cast(array_min(transform(b, (c, k) -> struct(aggregate(zip_with(s, c, (x, y) -> (x - y) * (x - y)), 0D, (t, x) -> t + x) as d, k as k))).k as smallint))"),
}


def register(spark: SparkSession) -> None:
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}({parameters}) returns {kind} return {body}")
