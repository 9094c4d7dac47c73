"""Connected components of an edge table by alternating large-star and small-star steps.

The two steps (Kiveris, Lattanzi, Mirrokni, Rastogi and Vassilvitskii, 2014) are joins and
minima over the edges; a star of any size is a partial aggregate and a skew-splittable
join, never one group in a task. Each round is written to the shared folder, gathered into
``files`` files where given: its rows are two numbers each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, remove, scratch


def components(edges: DataFrame, files: int | None = None) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b) but the smallest of each component; loops and nulls are ignored."""
    now = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("a is not null and b is not null and hi > lo").distinct()
    spark, path, mark = edges.sparkSession, None, None
    while True:
        held = scratch(spark, "edges")
        now = materialise(now.repartition(files) if files else now, "edges", held)
        if path:
            remove(spark, path)
        path = held
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").bitwiseAND(F.lit((1 << 40) - 1)))).first()
        if seen == mark or not seen[0]:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        mark = seen
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        small = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(small, "hi").where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        now = moved.unionByName(small.select("hi", F.col("m").alias("lo"))).distinct()
