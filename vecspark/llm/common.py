"""Shared pieces: the word rule, lookups and running sums without hot tasks, and the session helpers under one name.

Nulls: ``n_words`` counts a null text as none, ``look_up`` treats null as a value of its own,
``running`` wants an order that breaks ties. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import files_for, let, materialise, positions, remove, scratch, shared_root, ship, tidy

__all__ = ["BLANKS", "BLANK_RUN", "WORD", "files_for", "let", "look_up", "map_arrow", "materialise", "n_words", "own_columns", "positions", "remove", "running", "scratch", "shared_root", "table", "tidy"]

#: A word is a run of anything but these six ASCII blanks; everything else, other Unicode blanks included, belongs to words.
BLANKS = r"\x20\x09-\x0D"
WORD = f"[^{BLANKS}]+"
BLANK_RUN = f"[{BLANKS}]+"
#: Up to so many rows a table of values is broadcast; a longer one is dealt to SALTS copies, so that a hot key is many groups.
MAX_BROADCAST_ROWS = 10_000
SALTS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Words of a text; null counts as no text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """``df.mapInArrow`` in workers that can import this package."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def own_columns(df: DataFrame) -> DataFrame:
    """``df`` as one struct column ``row``, so that no column of its own can clash with those an operator adds."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def look_up(rows: DataFrame, key: Column, values: DataFrame) -> DataFrame:
    """``rows`` with ``found``: the struct that ``values`` (key, found; one row a key) has for ``key``, null without one; a null key is a value."""
    own, listed = rows.withColumn("__key", F.struct(key.alias("k"))), values.select(F.struct(F.col("key").alias("k")).alias("__name"), "found")
    same = F.col("__key") == F.col("__name")
    if values.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS:
        joined = own.join(F.broadcast(listed), same, "left")
    else:
        dealt = listed.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        own = own.withColumn("__own", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        joined = own.join(dealt, same & (F.col("__own") == F.col("__salt")), "left").drop("__own", "__salt")
    return joined.drop("__key", "__name")


def running(df: DataFrame, order: list, sums: list[str], name: str) -> DataFrame:
    """``df`` with ``before_<c>`` for each column of ``sums``: its sum over the rows before, in the order of ``order``.

    Range partitions are summed on their own and shifted by the partitions before them.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = materialise(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), name)
    marked = marked.withColumn("__part", F.shiftright("__at", 33))
    totals = marked.groupBy("__part").agg(*[F.sum(c).alias(f"__{c}") for c in sums])
    bases = totals.select("__part", *[(F.sum(f"__{c}").over(Window.orderBy("__part")) - F.col(f"__{c}")).alias(f"__{c}") for c in sums])
    within = Window.partitionBy("__part").orderBy("__at")
    placed = marked.select("*", *[(F.sum(c).over(within) - F.col(c)).alias(f"before_{c}") for c in sums]).join(F.broadcast(bases), "__part")
    return placed.select(*df.columns, *[(F.col(f"before_{c}") + F.col(f"__{c}")).alias(f"before_{c}") for c in sums])
