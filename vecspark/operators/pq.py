"""Product quantisation: codebooks, encoding, decoding and table-based distances.

A codebook is a small relation or a literal array [sub][code][value]; it is at most
M x 2^bits x width numbers, so it always fits a literal or a broadcast.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ShortType, StructField, StructType

from ..functions import vectors as V
from ..session import let, ship

#: Rows whose distances to all centroids are held at once.
NEAR_ROWS = 256
PRESETS = {"disabled": 0, "pq7": 7, "pq13": 13, "pq17": 17}


@dataclass(frozen=True)
class PQConfig:
    input_dim: int
    n_subvectors: int
    bits: int = 8

    @property
    def width(self) -> int:
        return -(-self.input_dim // self.n_subvectors)

    @property
    def code_bytes(self) -> int:
        return self.n_subvectors * (2 if self.bits > 8 else 1)

    @property
    def n_centroids(self) -> int:
        return 1 << self.bits


def dense(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """(rows, width) of a list column: shorter lists end in zeros, longer ones are cut, null ones are zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten()).astype(float, copy=False)
    size = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width))
    row, col = np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    keep = col < width
    out[row[keep], col[keep]] = flat[keep]
    return out


def lists(values: np.ndarray, null: pa.Array) -> pa.Array:
    """List column of the rows of a matrix; null where ``null`` is true."""
    offsets = pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1])
    return pa.ListArray.from_arrays(offsets, pa.array(values.ravel()), mask=null)


class Lcg:
    """Linear congruential draws. ``faithful`` keeps the narrow range [0, 0.5) of 31 bits over 2^32 - 1."""

    def __init__(self, seed: int, faithful: bool = False):
        self.state, self.faithful = seed, faithful

    def draw(self) -> float:
        self.state = (self.state * 6364136223846793005 + 1) & ((1 << 64) - 1)
        return (self.state >> 33) / (0xFFFFFFFF if self.faithful else float(1 << 31))


def plusplus(data: np.ndarray, k: int, seed: int, faithful: bool = False) -> np.ndarray:
    """k-means++ seeds: each next one drawn by squared distance from those before."""
    lcg = Lcg(seed, faithful)
    picked = [min(int(lcg.draw() * len(data)), len(data) - 1)]
    gap = ((data - data[picked[0]]) ** 2).sum(1)
    while len(picked) < k:
        mass = gap.sum()
        at = min(int(np.searchsorted(np.cumsum(gap), lcg.draw() * mass)), len(data) - 1) if mass > 0 else min(int(lcg.draw() * len(data)), len(data) - 1)
        picked.append(at)
        gap = np.minimum(gap, ((data - data[at]) ** 2).sum(1))
    return data[picked].copy()


def nearest(data: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first nearest centroid, squared distance) of each row."""
    code, least = np.empty(len(data), np.int64), np.empty(len(data))
    for r in range(0, len(data), NEAR_ROWS):
        rows = data[r : r + NEAR_ROWS]
        gaps = sum((x[:, None] - c[None, :]) ** 2 for x, c in zip(rows.T, centroids.T, strict=True))
        code[r : r + NEAR_ROWS] = own = gaps.argmin(1)
        least[r : r + NEAR_ROWS] = gaps[np.arange(len(rows)), own]
    return code, least


def kmeans(data: np.ndarray, k: int, iterations: int = 100, restarts: int = 3, tolerance: float = 1e-6, faithful: bool = False) -> tuple[np.ndarray, float]:
    """Lloyd's algorithm, best of ``restarts`` (first wins ties). Fewer points than k: the points, then rows of infinity (``faithful``: zeros)."""
    if len(data) < k:
        pad = np.zeros if faithful else lambda s: np.full(s, np.inf)
        return np.concatenate([data, pad((k - len(data), data.shape[1]))]), 0.0
    return min((lloyd(data, k, run, iterations, tolerance, faithful) for run in range(restarts)), key=lambda found: found[1])


def lloyd(data: np.ndarray, k: int, run: int, iterations: int = 100, tolerance: float = 1e-6, faithful: bool = False) -> tuple[np.ndarray, float]:
    """(centroids, inertia) of one start."""
    centroids, last = plusplus(data, k, run * 12345, faithful), np.inf
    for _ in range(iterations):
        code, gap = nearest(data, centroids)
        counts = np.bincount(code, minlength=k)
        sums = np.stack([np.bincount(code, data[:, d], k) for d in range(data.shape[1])], 1)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
        now = float(gap.sum())
        if abs(last - now) < tolerance:
            break
        last = now
    return centroids, float(nearest(data, centroids)[1].sum())


@dataclass
class ProductQuantizer:
    config: PQConfig
    centroids: np.ndarray = field(repr=False)  # (sub, code, width); infinite rows are unused codes
    trained: bool = True

    @classmethod
    def train(cls, df: DataFrame, column: str, config: PQConfig, iterations: int = 100, restarts: int = 3, limit: int = 65_536, faithful: bool = False) -> ProductQuantizer:
        """One k-means per sub-space and start, each in a task of its own; at most ``limit`` rows by hash of their id train it."""
        ship(df.sparkSession)
        keys = [c for c in df.columns if c != column] or [column]
        rows = df.orderBy(F.md5(F.to_json(F.struct(*keys)).cast("binary"))).limit(limit).select(F.col(column).alias("v"))
        subs = rows.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(config.n_subvectors - 1)), lambda m: F.struct(m.alias("sub"), V.subvector(V.as_double(F.col("v")), m, config.width).alias("x")))).alias("s")).select("s.sub", "s.x")
        each = subs.select("sub", "x", F.explode(F.sequence(F.lit(0), F.lit(restarts - 1))).alias("run"))
        tasks = each.repartition(config.n_subvectors * restarts, F.col("sub") * restarts + F.col("run"))

        def fit(table: pa.Table) -> pa.Table:
            data, run = dense(table.column("x"), config.width), table.column("run")[0].as_py()
            found, inertia = kmeans(data, config.n_centroids, iterations, faithful=faithful) if len(data) < config.n_centroids else lloyd(data, config.n_centroids, run, iterations, faithful=faithful)
            return pa.table({"sub": table.column("sub").slice(0, 1), "run": table.column("run").slice(0, 1), "inertia": pa.array([inertia]), "c": pa.array([found.ravel().tolist()])})

        # One codebook a start reaches the driver; the first of the least inertia is taken.
        got = sorted(tasks.groupBy("sub", "run").applyInArrow(fit, "sub int, run int, inertia double, c array<double>").collect(), key=lambda r: (r["sub"], r["inertia"], r["run"]))
        best = {r["sub"]: np.array(r["c"]) for r in reversed(got)}
        return cls(config, np.stack([best[m].reshape(config.n_centroids, config.width) for m in range(config.n_subvectors)]))

    def to_json(self) -> str:
        c = self.config
        used = np.where(np.isfinite(self.centroids), self.centroids, 0.0)
        return json.dumps({"config": {"input_dim": c.input_dim, "n_subvectors": c.n_subvectors, "bits": c.bits, "subvec_dim": c.width}, "centroids": used.tolist(), "trained": self.trained})

    @classmethod
    def from_json(cls, text: str) -> ProductQuantizer:
        d = json.loads(text)
        return cls(PQConfig(d["config"]["input_dim"], d["config"]["n_subvectors"], d["config"]["bits"]), np.array(d["centroids"], float), d.get("trained", True))

    def relation(self, spark) -> DataFrame:
        """(sub_idx, code, centroid)."""
        rows = [(m, c, self.centroids[m, c].tolist()) for m in range(self.config.n_subvectors) for c in range(len(self.centroids[m])) if np.isfinite(self.centroids[m, c]).all()]
        return spark.createDataFrame(rows, "sub_idx int, code int, centroid array<double>")

    def _book(self) -> Column:
        return F.lit(np.where(np.isfinite(self.centroids), self.centroids, 1e150).tolist())

    def encode(self, v: Column) -> Column:
        """Code of each sub-vector: the first nearest centroid."""
        width = self.config.width

        def code(v: Column, book: Column, m: Column) -> Column:
            nearest_ = lambda s: F.array_min(F.transform(book, lambda c, k: F.struct(V.squared_distance(s, c).alias("d"), k.alias("k"))))["k"]
            return let(V.subvector(v, m, width), nearest_).cast("smallint")

        return let(v, lambda v: F.transform(self._book(), lambda book, m: code(v, book, m)))

    def decode(self, codes: Column) -> Column:
        return F.slice(F.flatten(F.zip_with(self._book(), codes, lambda book, c: F.get(book, c.cast("int")))), 1, self.config.input_dim)

    def tables(self, q: Column) -> Column:
        """Squared distance of each sub-vector of a query to each centroid; sub-spaces beyond the end give 0."""
        width, dim = self.config.width, self.config.input_dim
        live = lambda m: m * width < F.lit(dim)
        table = lambda q, book, m: let(V.subvector(q, m, width), lambda s: F.transform(book, lambda c: F.when(live(m), V.squared_distance(s, c)).otherwise(F.lit(0.0))))
        return let(q, lambda q: F.transform(self._book(), lambda book, m: table(q, book, m)))

    @staticmethod
    def adc(tables: Column, codes: Column) -> Column:
        """Asymmetric squared distance: one lookup per sub-vector."""
        return V.total(F.zip_with(tables, codes, lambda t, c: F.get(t, c.cast("int"))))

    def encode_bulk(self, df: DataFrame, column: str, out: str = "codes") -> DataFrame:
        """``df`` with ``out``: codes by matrix operations on Arrow batches."""
        ship(df.sparkSession)
        shared, at = df.sparkSession.sparkContext.broadcast((self.config, self.centroids)), df.columns.index(column)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            config, books = shared.value
            for batch in batches:
                subs = dense(batch.column(at), config.width * config.n_subvectors).reshape(-1, config.n_subvectors, config.width)
                codes = np.stack([nearest(subs[:, m], books[m])[0] for m in range(config.n_subvectors)], 1).astype(np.int16)
                yield pa.RecordBatch.from_arrays([*batch.columns, lists(codes, batch.column(at).is_null())], names=[*batch.schema.names, out])

        return df.mapInArrow(run, StructType([*df.schema.fields, StructField(out, ArrayType(ShortType()))]))


def lloyd_step(codes: DataFrame, book: DataFrame) -> DataFrame:
    """(sub_idx, code, dim, value): centroids moved to the mean of their members; codes without members keep theirs.

    codes: (sub_idx, code, dim, value) of every assigned sub-vector; book: the centroids in the same shape.
    """
    means = codes.groupBy("sub_idx", "code", "dim").agg(F.avg("value").alias("mean"))
    return book.join(means, ["sub_idx", "code", "dim"], "left").select("sub_idx", "code", "dim", F.coalesce("mean", "value").alias("value"))
