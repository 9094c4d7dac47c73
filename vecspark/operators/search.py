"""Nearest-neighbour search: a stated set of queries against every row.

Queries and index rows are encoded once a row by JVM expressions. A block of queries of a
bounded size is broadcast; each task scans its part of the index batch by batch with one
matrix product, keeps the best N of its rows per query, and gives back one row per query.
A second pass merges these rows per query, so what is shuffled is N entries per query and
task, whatever the index holds.

The matrix product only picks rows; their scores are then added up in the order of the
dimensions, so equal vectors score alike wherever they stand, and ties go to the smaller
vec_id.

Defined results: rows and queries without a vector (null) are neither found nor asked;
vectors of norm 0 have similarity 0; query ids are taken to be distinct.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.constants import COSINE_ZERO
from ..session import materialise, scratch, ship
from .linear import LinearCodec
from .pq import ProductQuantizer, dense

#: Mode -> (candidates, rerank level).
SEARCH_MODES = {"fast": (10, "none"), "balanced": (100, "medium"), "precision": (300, "full")}
#: Numbers in a broadcast block of queries, and kept entries of a block; more queries go in several blocks, one job each.
BLOCK_NUMBERS, BLOCK_ENTRIES = 1 << 21, 1 << 21
#: Scores of a batch held at once.
CELLS = 1 << 21
#: Wider than the error of a matrix product of unit vectors.
SLACK = 1e-9


def candidates(mode: str, k: int, custom: int | None = None) -> int:
    return max(custom if custom is not None else SEARCH_MODES[mode][0], k)


def matrix(column: pa.ChunkedArray | pa.Array, width: int = 0) -> np.ndarray:
    """(rows, width) of a list column, as wide as its longest list where no width is given."""
    return dense(column, width or pc.max(pc.list_value_length(column)).as_py() or 0)


def added(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row-wise dot products, added in the order of the dimensions."""
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out += x[:, d] * y[:, d]
    return out


class Cosine:
    """Similarity of queries and rows as ``functions.vectors.cosine`` defines it."""

    def __init__(self, queries: np.ndarray):
        self.queries, self.norms = queries, np.sqrt(added(queries, queries))
        self.unit = np.divide(queries, self.norms[:, None], out=np.zeros_like(queries), where=self.norms[:, None] >= COSINE_ZERO)

    def rows(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        x = matrix(column, self.queries.shape[1])
        return x, np.sqrt(added(x, x))

    def roughly(self, rows: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        x, norms = rows
        return self.unit @ np.divide(x, norms[:, None], out=np.zeros_like(x), where=norms[:, None] >= COSINE_ZERO).T

    def exactly(self, q: np.ndarray, rows: tuple[np.ndarray, np.ndarray], r: np.ndarray) -> np.ndarray:
        x, norms = rows
        a, b = self.norms[q], norms[r]
        live = (a >= COSINE_ZERO) & (b >= COSINE_ZERO)
        found = np.divide(added(self.queries[q], x[r]), a * b, out=np.zeros(len(q)), where=live)
        return np.clip(found, -1.0, 1.0)


class Lookup:
    """Negative asymmetric distance: the sum of one table entry per sub-vector."""

    def __init__(self, tables: np.ndarray):
        self.tables = tables  # (queries, sub-vectors, codes)

    def rows(self, column: pa.Array) -> np.ndarray:
        return matrix(column, self.tables.shape[1]).astype(np.int64)

    def roughly(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.tables), len(rows)))
        for m in range(rows.shape[1]):
            out -= self.tables[:, m, rows[:, m]]
        return out

    def exactly(self, q: np.ndarray, rows: np.ndarray, r: np.ndarray) -> np.ndarray:
        out = np.zeros(len(q))
        for m in range(rows.shape[1]):
            out += self.tables[q, m, rows[r, m]]
        return -out


class Best:
    """The best ``n`` entries (id, score, second score) of each of ``size`` queries so far."""

    def __init__(self, size: int, n: int):
        self.n, self.least = n, np.full(size, -np.inf)
        self.held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]
        self.new: list[tuple[np.ndarray, ...]] = []
        self.pending = 0

    def add(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray, second: np.ndarray) -> None:
        if len(q):
            self.new.append((q, ids, score, second))
            self.pending += len(q)
            if self.pending > max(len(self.least) * self.n, CELLS // 8):
                self.settle()

    def settle(self) -> None:
        q, ids, score, second = (np.concatenate(c) for c in zip(self.held, *self.new, strict=True))
        order = np.lexsort((ids, -score, q))
        q = q[order]
        first = np.searchsorted(q, np.arange(len(self.least)))
        rank = np.arange(len(q)) - first[q]
        keep = rank < self.n
        order, rank, q = order[keep], rank[keep], q[keep]
        self.held, self.new, self.pending = [q, ids[order], score[order], second[order]], [], 0
        last = rank == self.n - 1
        self.least[q[last]] = self.held[2][last]

    def table(self, names: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
        """One row per query with entries, best first."""
        self.settle()
        q, ids, score, second = self.held
        counts = np.bincount(q, minlength=len(self.least))
        own = np.flatnonzero(counts)
        offsets = np.concatenate([[0], np.cumsum(counts[own])]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(offsets, pa.array(c)) for c in (ids, score, second)]
        return pa.record_batch([pa.array(names[own]), *lists], schema=schema)


PART = pa.schema([("query_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64())), ("seconds", pa.list_(pa.float64()))])
PART_SQL = "query_id long, ids array<long>, scores array<double>, seconds array<double>"


def kind_of(queries: pa.Table, kind: str):
    if kind == "lookup":
        tables = queries.column("q").combine_chunks()
        inner = matrix(tables.flatten())
        return Lookup(inner.reshape(len(tables), -1, inner.shape[1]))
    return Cosine(matrix(queries.column("q")))


def part_of(queries: pa.Table, index: DataFrame, n: int, kind: str, exclude_self: bool) -> DataFrame:
    """One row per query and task: the best ``n`` index rows of the task, for one block of queries."""
    second = "w" in index.columns
    names = queries.column("query_id").to_numpy()
    shared = index.sparkSession.sparkContext.broadcast((names, kind_of(queries, kind), Cosine(matrix(queries.column("r"))) if second else None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, first, again = shared.value
        best, step = Best(len(names), n), max(1, CELLS // max(len(names), 1))
        for whole in batches:
            for low in range(0, whole.num_rows, step):
                batch = whole.slice(low, step)
                ids, rows = batch.column(0).to_numpy(), first.rows(batch.column(1))
                rough = first.roughly(rows)
                hit = rough >= (best.least - SLACK)[:, None]
                if hit.sum() > 2 * best.n * len(names) and len(ids) > n + 1:
                    # One more than asked for, as one of them may be the query itself.
                    hit &= rough >= np.partition(rough, len(ids) - n - 1, axis=1)[:, len(ids) - n - 1, None] - SLACK
                q, r = np.nonzero(hit)
                if exclude_self:
                    other = names[q] != ids[r]
                    q, r = q[other], r[other]
                score = first.exactly(q, rows, r)
                keep = score >= best.least[q]
                q, r, score = q[keep], r[keep], score[keep]
                best.add(q, ids[r], score, again.exactly(q, again.rows(batch.column(2)), r) if again else score)
        yield best.table(names, PART)

    ship(index.sparkSession)
    return index.select("vec_id", "v", *(["w"] if second else [])).mapInArrow(run, PART_SQL)


def merged(parts: DataFrame, n: int) -> DataFrame:
    """(query_id, vec_id, original_rank, scan, second): the best ``n`` entries of each query over all tasks."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("original_rank", pa.int64()), ("scan", pa.float64()), ("second", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(query: int, lists: list) -> pa.RecordBatch:
            ids, score, second = (np.concatenate(c) for c in zip(*lists, strict=True))
            order = np.lexsort((ids, -score))[:n]
            return pa.record_batch([pa.array(np.full(len(order), query)), pa.array(ids[order]), pa.array(np.arange(len(order))), pa.array(score[order]), pa.array(second[order])], schema=schema)

        query, lists = None, []
        for batch in batches:
            names, columns = batch.column(0).to_pylist(), [batch.column(c) for c in (1, 2, 3)]
            for k, name in enumerate(names):
                if name != query and lists:
                    yield done(query, lists)
                    lists = []
                query = name
                lists.append(tuple(c[k].values.to_numpy() for c in columns))
                if len(lists) == 64:  # a long run of tasks is merged as it comes
                    cut = done(query, lists)
                    lists = [tuple(cut.column(c).to_numpy() for c in (1, 3, 4))]
        if lists:
            yield done(query, lists)

    return parts.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(run, "query_id long, vec_id long, original_rank long, scan double, second double")


def scan(queries: DataFrame, index: DataFrame, n: int, kind: str = "cosine", exclude_self: bool = False) -> DataFrame:
    """(query_id, vec_id, original_rank, scan, second): the best ``n`` rows of ``index`` for each query.

    queries: (query_id, q[, r]), index: (vec_id, v[, w]). ``scan`` is the cosine of q and v
    ("lookup": the negative distance of codes v by the tables q), ``second`` that of r and w.
    """
    spark = index.sparkSession
    queries = queries.where("query_id is not null and q is not null").withColumn("query_id", F.col("query_id").cast("long"))
    index = index.where("vec_id is not null and v is not null").withColumn("vec_id", F.col("vec_id").cast("long"))
    size = F.size(F.flatten("q")) if kind == "lookup" else F.size("q")
    shape = queries.agg(F.count(F.lit(1)).alias("n"), F.max(size).alias("width")).first()
    if not shape["n"]:
        return merged(spark.createDataFrame([], PART_SQL), n)
    block = max(1, min(BLOCK_NUMBERS // max(shape["width"], 1), BLOCK_ENTRIES // n))
    blocks = -(-shape["n"] // block)
    if blocks == 1:
        return merged(part_of(queries.toArrow(), index, n, kind, exclude_self), n)
    # One job a block, each written and its broadcast dropped, so the driver holds one block at a time.
    numbered, path, found = materialise(queries.withColumn("__block", F.pmod(F.xxhash64("query_id"), F.lit(2 * blocks)).cast("int")), "queries"), scratch(spark, "found"), []
    for b in range(2 * blocks):
        own = numbered.where(F.col("__block") == b).drop("__block").toArrow()
        if own.num_rows:
            found.append(materialise(merged(part_of(own, index, n, kind, exclude_self), n), "found", f"{path}/{b}"))
    return spark.read.schema(found[0].schema).parquet(*[f"{path}/{b}" for b in range(2 * blocks) if _there(spark, f"{path}/{b}")])


def _there(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def reranked(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, similarity, original_rank): the best ``k`` by the second score, then by the first rank."""
    w = Window.partitionBy("query_id").orderBy(F.col("second").desc(), "original_rank")
    return found.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k).select("query_id", "rank", "vec_id", F.col("second").alias("similarity"), "original_rank")


def knn(queries: DataFrame, index: DataFrame, k: int, column: str = "embedding", exclude_self: bool = True) -> DataFrame:
    """(query_id, rank, vec_id, similarity): exact search by cosine."""
    v = V.as_double(F.col(column))
    found = scan(queries.select(F.col("vec_id").alias("query_id"), v.alias("q")), index.select("vec_id", v.alias("v")), k, exclude_self=exclude_self)
    return found.select("query_id", F.col("original_rank").alias("rank"), "vec_id", F.col("scan").alias("similarity"))


@dataclass
class BoostSearcher:
    """Scan on normalised linear codes, then rerank the candidates in another linear space."""

    fast: LinearCodec
    rerank: LinearCodec

    def build(self, df: DataFrame, column: str = "embedding") -> DataFrame:
        return df.select("vec_id", V.normalize(self.fast.compress(F.col(column))).alias("code"))

    def search(self, queries: DataFrame, index: DataFrame, k: int, mode: str = "balanced", custom: int | None = None, column: str = "embedding") -> DataFrame:
        """(query_id, rank, vec_id, similarity, original_rank)."""
        n, own = candidates(mode, k, custom), F.col(column)
        q = queries.select(F.col("vec_id").alias("query_id"), V.normalize(self.fast.compress(own)).alias("q"), V.normalize(self.rerank.compress(own)).alias("r"))
        if SEARCH_MODES.get(mode, (0, ""))[1] == "none":
            return reranked(scan(q.drop("r"), index.select("vec_id", F.col("code").alias("v")), n), k)
        # The code is lifted and projected again by one matrix of the two sizes.
        fold = (self.rerank.effective() @ self.fast.weights.T).tolist()
        rows = index.select("vec_id", F.col("code").alias("v"), V.normalize(V.project(F.col("code"), fold)).alias("w"))
        return reranked(scan(q, rows, n), k)


@dataclass(frozen=True)
class StageConfig:
    """Limits of the two-stage search: no stage may be wider than the original."""

    original_dim: int
    linear_dim: int
    subvectors: int
    rerank_dim: int
    n_candidates: int
    second_stage: bool = False

    def __post_init__(self):
        if max(self.rerank_dim, self.linear_dim) > self.original_dim:
            raise ValueError("a rerank dimension cannot exceed the original one")

    @classmethod
    def pq_boost(cls, original_dim: int, linear_dim: int, subvectors: int, n_candidates: int) -> StageConfig:
        return cls(original_dim, linear_dim, subvectors, linear_dim, n_candidates)

    @classmethod
    def turbo_boost(cls, original_dim: int, linear_dim: int, subvectors: int, rerank_dim: int, n_candidates: int) -> StageConfig:
        return cls(original_dim, linear_dim, subvectors, rerank_dim, n_candidates, True)


@dataclass
class ModularSearcher:
    """Index of PQ codes; scan on the decoded codes, optional rerank after transpose projection."""

    config: StageConfig
    codec: LinearCodec
    pq: ProductQuantizer

    def build(self, df: DataFrame, column: str = "embedding") -> DataFrame:
        return df.select("vec_id", self.pq.encode(V.normalize(self.codec.compress(F.col(column)))).alias("codes"))

    def search(self, queries: DataFrame, index: DataFrame, k: int, column: str = "embedding") -> DataFrame:
        q = queries.select(F.col("vec_id").alias("query_id"), V.normalize(self.codec.compress(F.col(column))).alias("q"))
        rows = index.select("vec_id", V.normalize(self.pq.decode(F.col("codes"))).alias("v"))
        if self.config.second_stage:
            # Decoded and lifted once a row, before any pair is scored.
            lift = lambda y: V.normalize(self.codec.decompress(F.col(y)))
            q, rows = q.withColumn("r", lift("q")), rows.withColumn("w", lift("v"))
        return reranked(scan(q, rows, self.config.n_candidates), k)


def adc_search(queries: DataFrame, index: DataFrame, pq: ProductQuantizer, k: int, column: str) -> DataFrame:
    """(query_id, rank, vec_id, distance): one table of distances per query, lookups per row. ``column`` holds vectors of the codebook's space; index (vec_id, codes)."""
    q = queries.select(F.col("vec_id").alias("query_id"), pq.tables(V.as_double(F.col(column))).alias("q"))
    found = scan(q, index.select("vec_id", F.col("codes").alias("v")), k, "lookup")
    return found.select("query_id", F.col("original_rank").alias("rank"), "vec_id", (-F.col("scan")).alias("distance"))
