"""Vectors in CSV: sniffing, scan and sink. Plain commas, no quoting."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..session import ship
from .files import line_positions


def _fields(line: Column) -> Column:
    return F.split(F.trim(line), ",", -1)


def _number(field: Column, kind: str) -> Column:
    """Null if it is none. C writes the sign of a NaN, which Spark's cast does not read."""
    text = F.trim(field)
    return F.coalesce(text.try_cast(kind), F.when(F.lower(text) == "-nan", F.lit(math.nan).cast(kind)))


def looks_like_header(line: Column) -> Column:
    """More than half (whole division) of the first five fields are no numbers."""
    first = F.slice(_fields(line), 1, 5)
    words = F.size(F.filter(first, lambda x: _number(x, "double").isNull()))
    return words > F.floor(F.size(first) / 2)


def has_id(line: Column) -> Column:
    """The first field of a data row is no number."""
    return _number(F.get(_fields(line), 0), "double").isNull()


def read_csv(spark: SparkSession, path: str, header: bool | None = None, id_column: bool | None = None) -> DataFrame:
    """(vec_id, id, embedding). Blank lines and repeats of the header are skipped; a bad number or an uneven row is an error that names its line."""
    raw = line_positions(spark.read.text(path)).select(F.col("vec_id").alias("line"), "value").where(F.length(F.trim("value")) > 0)
    first = raw.orderBy("line").limit(2).select("line", "value", looks_like_header(F.col("value")).alias("h"), has_id(F.col("value")).alias("i")).collect()
    if not first:
        raise ValueError(f"no rows in {path}")
    header = first[0]["h"] if header is None else header
    if header and len(first) < 2:
        raise ValueError(f"no rows in {path}")
    with_id = first[1 if header else 0]["i"] if id_column is None else id_column
    data = raw.where(F.col("value") != first[0]["value"]) if header else raw  # each part of a folder has the header
    fields = _fields(F.col("value"))
    numbers = F.slice(fields, 2, F.size(fields) - 1) if with_id else fields
    parsed = data.select("line", F.trim(fields[0]).alias("id") if with_id else F.lit(None).cast("string").alias("id"), F.transform(numbers, lambda x: _number(x, "float")).alias("embedding"))
    width = parsed.orderBy("line").select(F.size("embedding").alias("n")).first()["n"]
    bad = parsed.where(F.exists("embedding", lambda x: x.isNull()) | (F.size("embedding") != width)).orderBy("line").first()
    if bad is not None:
        raise ValueError(f"line {bad['line'] + 1}: not {width} numbers")
    return line_positions(parsed.orderBy("line").select("id", "embedding")).select("vec_id", "id", "embedding")


def _text(x: float | None) -> str:
    """Six decimals of the exact value, ties to even, as C writes them (Java rounds ties up and fills large numbers with zeros)."""
    if x is None:
        return "null"
    return "-nan" if math.isnan(x) and math.copysign(1, x) < 0 else "%.6f" % x


def csv_lines(df: DataFrame) -> DataFrame:
    """(vec_id, line): six decimals, the id first when the frame has one."""
    ship(df.sparkSession)
    ids = ["id"] if "id" in df.columns else []
    rows = df.select("vec_id", *[F.col(c).cast("string").alias(c) for c in ids], F.col("embedding").cast("array<double>").alias("embedding"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = (v.values for v in batch["embedding"])
            lines = [None if v is None else ",".join(map(_text, v.to_pylist() if v.null_count else v.to_numpy().tolist())) for v in found]
            yield pa.record_batch([*batch.columns[:-1], pa.array(lines, pa.string())], names=[*batch.schema.names[:-1], "numbers"])

    made = rows.mapInArrow(run, StructType([*rows.schema.fields[:-1], StructField("numbers", StringType())]))
    line = F.concat_ws(",", F.coalesce("id", F.lit("")), "numbers") if ids else F.col("numbers")
    return made.select("vec_id", line.alias("line"))


def csv_header(dimension: int, with_id: bool) -> str:
    return ",".join((["id"] if with_id else []) + [f"dim_{k}" for k in range(dimension)])


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    """A folder of CSV parts in order of vec_id, each with the header."""
    dimension = df.select(F.size("embedding")).first()
    lines = csv_lines(df).orderBy("vec_id").select(F.col("line").alias("value"))
    if header and dimension is not None:
        names = csv_header(dimension[0], "id" in df.columns).split(",")
        lines = lines.select(F.from_csv("value", F.lit(", ".join(f"`{n}` string" for n in names))).alias("r")).select("r.*")
        lines.write.mode("overwrite").option("header", True).csv(path)
    else:
        lines.write.mode("overwrite").text(path)
