"""All unordered pairs of a table, block against block, for reports that need every pair."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import COSINE_ZERO
from ..session import ship
from .search import matrix

BLOCK = 2048
#: Rows of a block whose cosines are held at once.
STRIP = 128


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; those without length, whose cosines are 0, as zeros."""
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n >= COSINE_ZERO)


def with_larger(a: np.ndarray, a_ids: np.ndarray, b: np.ndarray, b_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number, sum and maximum of the cosines of each row of ``a`` with the rows of ``b`` of larger id; both are units in order of id.

    A row's partners are the end of ``b`` after a place, so sums come from the sums of these ends, and
    only what lies behind the first place of a strip is multiplied.
    """
    place = np.searchsorted(b_ids, a_ids, "right")
    ends = np.concatenate([b[::-1].cumsum(0)[::-1], np.zeros((1, b.shape[1]))])
    most = np.full(len(a), -1.0)
    for r in range(0, len(a), STRIP):
        at = place[r : r + STRIP]
        if at[0] == len(b):
            break
        cosines = a[r : r + STRIP] @ b[at[0] :].T
        cosines[:, : at[-1] - at[0]][np.arange(at[0], at[-1]) < at[:, None]] = -1.0
        most[r : r + STRIP] = cosines.max(1)
    return len(b) - place, (a * ends[place]).sum(1), np.clip(most, -1, 1)


def dealt(df: DataFrame, column: str, block: int) -> DataFrame:
    """(vec_id, v, b, i, j): each row, of block b, once for every pair (i, j) of blocks that its own is in; blocks are hashes of the id."""
    blocks = max(1, -(-df.count() // block))
    rows = df.select("vec_id", F.col(column).alias("v"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("b"))
    other = F.sequence(F.lit(0), F.lit(blocks - 1))
    return rows.select("vec_id", "v", "b", F.explode(other).alias("o")).select("vec_id", "v", "b", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))


def similarity_profile(df: DataFrame, column: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(vec_id, n_pairs, sum_cosine, max_cosine) over the pairs of each row with all rows of larger vec_id.

    Rows are dealt to blocks by hash; each pair of blocks is matrix products of its strips, and only
    one row per vector and task leaves it. Vectors are shuffled in the type they have.
    """
    ship(df.sparkSession)

    def score(t: pa.Table) -> pa.Table:
        t = t.sort_by("vec_id")
        ids, side, unit = t.column("vec_id").to_numpy(), t.column("b").to_numpy(), units(matrix(t.column("v")))
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        sides = [(side == i, side == j)] if i == j else [(side == i, side == j), (side == j, side == i)]
        found = [(ids[x], *with_larger(unit[x], ids[x], unit[y], ids[y])) for x, y in sides]
        return pa.table(dict(zip(("vec_id", "n", "s", "m"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    part = dealt(df, column, block).groupBy("i", "j").applyInArrow(score, "vec_id long, n long, s double, m double")
    sums = part.groupBy("vec_id").agg(F.sum("n").alias("n_pairs"), F.sum("s").alias("sum_cosine"), F.max("m").alias("m"))
    return sums.select("vec_id", "n_pairs", "sum_cosine", F.when(F.col("n_pairs") > 0, F.col("m")).alias("max_cosine"))


def mean_distance(df: DataFrame, column: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(n_pairs, mean_distance): the mean Euclidean distance over all unordered pairs of rows of different id, 0 without a pair."""
    ship(df.sparkSession)

    def score(t: pa.Table) -> pa.Table:
        ids, side, x = t.column("vec_id").to_numpy(), t.column("b").to_numpy(), matrix(t.column("v"))
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        one, two, n, total = np.flatnonzero(side == i), side == j, 0, 0.0
        for r in one:
            others = two & (ids > ids[r] if i == j else ids != ids[r])
            n, total = n + int(others.sum()), total + float(np.sqrt(((x[others] - x[r]) ** 2).sum(1)).sum())
        return pa.table({"n": [n], "s": [total]})

    sums = dealt(df, column, block).groupBy("i", "j").applyInArrow(score, "n long, s double").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"), F.sum("s").alias("s"))
    return sums.select("n_pairs", F.when(F.col("n_pairs") > 0, F.col("s") / F.col("n_pairs")).otherwise(F.lit(0.0)).alias("mean_distance"))


def capped_pairs(df: DataFrame, rows: int = 50, pairs: int = 200) -> DataFrame:
    """(i, j): the first ``pairs`` pairs in lexical order of the first ``rows`` ids; the caps are the operator's."""
    first = df.select("vec_id").orderBy("vec_id").limit(rows)
    both = first.select(F.col("vec_id").alias("i")).join(first.select(F.col("vec_id").alias("j")), F.expr("i < j"))
    return both.orderBy("i", "j").limit(pairs)
