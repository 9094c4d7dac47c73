"""Hilbert-curve sharding: quantise metadata, sort by curve index, cut runs.

Every row goes to one of ``shards`` runs of the Hilbert order of (source, language,
size class). Neighbouring cells of the curve differ in one step of one dimension, so
each run covers a compact box of metadata and its min/max statistics let a reader
skip it. The law is ``rows``: counts of two shards differ by one at most.

Plan: texts are read once, for size and checksum; two distinct-value tables give
order-preserving equi-depth quantisers by running sums over range partitions, at any
number of values; cells are split by a hash of id, checksum and size so that a hot cell (a
source with a third of all rows) is many groups; only counts of (cell, split) are summed
globally (at most 4,096 x SPLITS rows), so no task sees all rows.

Defined results: null text has no bytes (size 1); null source or language is a value
of its own, first in order; null doc_id is ordered first; rows that repeat exactly
are interchangeable; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import look_up, materialise, running, table

BITS = 4
DIMENSIONS = 3
SPLITS = 256


def hilbert_index(axes: list[Column], bits: int) -> Column:
    """Index on the Hilbert curve of integer ``axes`` below ``2**bits`` (Skilling's transpose form, 2004).

    The steps run in one ``aggregate`` over an array, so the expression stays small.
    """
    n = len(axes)
    steps = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def turn(x: Column, s: Column) -> Column:
        q, i = s["q"], s["i"]
        hit = F.get(x, i).bitwiseAND(q) != 0
        swap = F.get(x, F.lit(0)).bitwiseXOR(F.get(x, i)).bitwiseAND(q - 1)
        first = F.when(hit, q - 1).otherwise(swap)
        other = F.when(hit, F.lit(0)).otherwise(swap)
        return F.transform(x, lambda v, j: v.bitwiseXOR(F.when(j == 0, first).when(j == i, other).otherwise(F.lit(0))))

    x = F.aggregate(steps, F.array(*[a.cast("int") for a in axes]), turn) if bits > 1 else F.array(*[a.cast("int") for a in axes])
    gray = F.aggregate(x, F.array().cast("array<int>"), lambda out, v: F.concat(out, F.array(v.bitwiseXOR(F.coalesce(F.get(out, F.size(out) - 1), F.lit(0))))))
    masks = F.array(*[F.lit(1 << b) for b in range(bits - 1, -1, -1)])

    def undo(g: Column) -> Column:
        last = F.get(g, F.lit(n - 1))
        t = F.aggregate(masks, F.lit(0), lambda acc, m: acc.bitwiseXOR(F.when(last.bitwiseAND(m) != 0, m - 1).otherwise(F.lit(0))))
        return F.transform(g, lambda v: v.bitwiseXOR(t))

    bound = F.transform(F.array(gray), undo)[0]
    return F.aggregate(masks, F.lit(0), lambda acc, m: F.aggregate(bound, acc, lambda a, v: a * 2 + F.when(v.bitwiseAND(m) != 0, 1).otherwise(0)))


def quantiser(df: DataFrame, name: str, bits: int) -> DataFrame:
    """(key, found.code): values in order, cut so that each code holds about as many rows; running sums by range partitions."""
    counts = df.groupBy(F.col(name).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    run = running(counts, [F.col("key").asc_nulls_first()], ["n"], f"values-{name}")
    total = run.agg(F.sum("n")).first()[0] or 1  # one number
    return run.select("key", F.struct(F.floor(F.col("before_n") * (1 << bits) / total).cast("int").alias("code")).alias("found"))


def coded(df: DataFrame, name: str, bits: int) -> DataFrame:
    """``df`` with ``name_q``."""
    return look_up(df, F.col(name), quantiser(df, name, bits)).withColumn(f"{name}_q", F.col("found.code")).drop("found")


def shard(documents: DataFrame, shards: int = 16, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, cell."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select("doc_id", F.col("source"), F.col("lang"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = materialise(rows, "rows")  # texts are read once
    meta = coded(coded(rows, "source", bits), "lang", bits)
    high = (1 << bits) - 1
    size_class = F.greatest(F.lit(0), F.least(F.lit(high), F.length(F.bin("size")) - 4))
    split = F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(SPLITS)).cast("int")
    placed = materialise(meta.withColumn("cell", hilbert_index([F.col("source_q"), F.col("lang_q"), size_class], bits)).withColumn("part", split).drop("source", "lang"), "cells")

    counts = placed.groupBy("cell", "part").agg(F.count(F.lit(1)).alias("n"))
    cells = counts.groupBy("cell").agg(F.sum("n").alias("cell_n"))
    cells = cells.select("cell", (F.sum("cell_n").over(Window.orderBy("cell")) - F.col("cell_n")).alias("cell_base"), F.sum("cell_n").over(Window.partitionBy()).alias("total"))
    parts = counts.withColumn("part_base", F.sum("n").over(Window.partitionBy("cell").orderBy("part")) - F.col("n"))
    bases = parts.join(cells, "cell").select("cell", "part", (F.col("cell_base") + F.col("part_base")).alias("base"), "total")

    within = Window.partitionBy("cell", "part").orderBy("doc_id", "text_crc32", "size")
    ranked = placed.join(bases, ["cell", "part"]).withColumn("rank", F.col("base") + F.row_number().over(within) - 1)
    number = F.floor(F.expr(f"(rank * {shards}) div total"))
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return (
        ranked.withColumn("shard", number.cast("int"))
        .withColumn("slot", (F.col("rank") - first).cast("long"))
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "cell", "source_q", "lang_q")
    )


def manifest(sharded: DataFrame) -> DataFrame:
    """Per shard: rows and the box of quantised metadata it covers, which a reader holds against its filter."""
    boxes = [f(c).alias(f"{name}_{c}") for c in ("source_q", "lang_q", "size", "doc_id") for name, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), *boxes)


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
