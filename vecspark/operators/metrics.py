"""Quality metrics over frames of pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.constants import RANK_ZERO
from ..session import positions


def global_rank(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """``df`` with ``out``: position from 0 in the order; ties must be broken by ``order`` itself.

    Range partitions are sorted on their own and shifted by the rows before them, so no task
    sees more than its share.
    """
    return positions(df, order, "ranked", out)


def spearman(df: DataFrame, x: str, y: str, position: str) -> DataFrame:
    """(n, rho): correlation of ordinal ranks, ties in order of ``position``; 0 below two rows."""
    ranked = global_rank(global_rank(df.select(x, y, position), [F.col(x), F.col(position)], "rx"), [F.col(y), F.col(position)], "ry")
    d = (F.col("rx") - F.col("ry")).cast("decimal(20,0)")
    sums = ranked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(d * d), F.lit(0)).cast("double").alias("s"))
    n = F.col("n").cast("double")
    return sums.select("n", F.when((n < 2) | (n * (n * n - 1) / 12 < RANK_ZERO), F.lit(0.0)).otherwise(1 - 6 * F.col("s") / (n * (n * n - 1))).alias("rho"))


def value_stats(df: DataFrame, column: str) -> list[Column]:
    """mean, min, max and population deviation of a column, as aggregates named after it."""
    return [f(column).alias(f"{column}_{name}") for name, f in (("mean", F.avg), ("min", F.min), ("max", F.max), ("std", F.stddev_pop))]


def batch_stats(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Cosine and squared-error statistics of a frame of pairs."""
    scored = pairs.select(V.cosine(F.col(a), F.col(b)).alias("cosine"), V.mse(F.col(a), F.col(b)).alias("mse"))
    return scored.agg(*value_stats(scored, "cosine"), *value_stats(scored, "mse"))


def validation_metrics(a: Column, b: Column, checksum: Column | bool = True) -> Column:
    """Struct of cosine, mse, SNR (null when infinite) and a checksum flag."""
    snr = V.snr_db(a, b)
    return F.struct(F.lit(checksum).alias("checksum_valid"), V.cosine(a, b).alias("cosine"), V.mse(a, b).alias("mse"), F.when(snr == float("inf"), F.lit(None)).otherwise(snr).alias("snr_db"))


def placeholder_metrics() -> Column:
    return F.struct(F.lit(True).alias("checksum_valid"), F.lit(1.0).alias("cosine"), F.lit(0.0).alias("mse"), F.lit(None).cast("double").alias("snr_db"))


def ring_pairs(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    """(pair_id, a_*, b_*): each row with the next in order of ``key``, the last with the first."""
    placed = global_rank(df.select(key, *values), [F.col(key)], "pair_id")
    n = placed.count()
    left = placed.select("pair_id", *[F.col(c).alias(f"a_{c}") for c in (key, *values)])
    right = placed.select(F.pmod(F.col("pair_id") - 1, F.lit(max(n, 1))).alias("pair_id"), *[F.col(c).alias(f"b_{c}") for c in (key, *values)])
    return left.join(right, "pair_id") if n >= 2 else left.join(right, "pair_id").limit(0)


def recall(truth: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(query_id, recall): share of the k true neighbours that were found; both (query_id, vec_id)."""
    hits = truth.join(found.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    queries = truth.groupBy("query_id").agg(F.count(F.lit(1)).alias("k"))
    return queries.join(hits, "query_id", "left").select("query_id", (F.coalesce("hits", F.lit(0)) / F.least(F.lit(k), F.col("k"))).alias("recall"))
