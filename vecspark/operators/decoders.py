"""Stochastic reconstructions, seeded per row so that partitioning never changes a result."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions import energy as E
from ..functions.constants import BLOCK, KB_EV
from ..session import ship

COLDEST, HOTTEST, STEP, REPLICAS, ITERATIONS, MOVES, EXCHANGE_EVERY = 280.0, 400.0, 0.1, 8, 200, 10, 10
#: Rows decoded at once.
ROWS = 256


def combined_energy(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The combined energy of each row of ``x`` (n, D) against ``y`` (K,) or (n, K), as ``functions.energy`` defines it."""
    n, dim = x.shape
    k, blocks = y.shape[-1], -(-dim // BLOCK)
    width = blocks // max(k, 1) * BLOCK
    own = [x[:, o * width : (o + 1) * width] for o in range(k)]
    means = np.stack([b.mean(1) if b.shape[1] else np.zeros(n) for b in own], 1)
    out = E.OCTONION_SHARE * E.RECONSTRUCTION * ((means - y) ** 2).sum(1)
    out += E.OCTONION_SHARE * E.SMOOTHNESS * (np.diff(x, axis=1) ** 2).sum(1) / dim
    spread = sum(((b := x[:, i : i + BLOCK]) - b.mean(1, keepdims=True)).__pow__(2).sum(1) for i in range(0, dim, BLOCK))
    out += E.OCTONION_SHARE * E.BLOCK_VARIANCE * spread / dim
    around = sum(np.roll(x, -d, 1) for d in range(1, E.NEIGHBOURS + 1)) / E.NEIGHBOURS
    out += E.LOCAL_SHARE * E.LOCAL * np.abs(x - around).sum(1) / dim
    if dim >= 3:
        out += E.LOCAL_SHARE * E.GRADIENT * np.abs(x[:, :-2] - 2 * x[:, 1:-1] + x[:, 2:]).sum(1) / dim
    return out


def replicated(y: np.ndarray, dim: int) -> np.ndarray:
    return y[np.minimum(np.arange(dim) // (dim // len(y)), len(y) - 1)]


def move_plainly(x: np.ndarray, y: np.ndarray, places: np.ndarray, sizes: np.ndarray, limits: np.ndarray) -> None:
    """Moves of single coordinates of ``x`` (lanes, D), a row of ``places`` after the other: a move stays when the energy rises by its limit at most."""
    lane = np.arange(len(x))
    for i, d, limit in zip(places, sizes, limits, strict=True):
        moved = x.copy()
        moved[lane, i] += d
        stays = combined_energy(moved, y) - combined_energy(x, y) <= limit
        x[stays] = moved[stays]


def move(x: np.ndarray, y: np.ndarray, places: np.ndarray, sizes: np.ndarray, limits: np.ndarray) -> None:
    """``move_plainly`` by those terms of the energy only that a coordinate is in."""
    (lanes, dim), k, lane = x.shape, y.shape[1], np.arange(len(x))
    if dim <= E.NEIGHBOURS:  # a coordinate is its own neighbour
        return move_plainly(x, y, places, sizes, limits)
    at, width = np.arange(dim), -(-dim // BLOCK) // max(k, 1) * BLOCK
    own, block = np.minimum(at // max(width, 1), k - 1), at // BLOCK
    # shares of a coordinate in the mean that stands for a compressed value and in its block's; weights of its terms
    share = np.where(at < width * k, 1 / np.maximum(np.minimum((own + 1) * width, dim) - own * width, 1), 0.0)
    part = 1 / np.minimum(BLOCK, dim - block * BLOCK)
    fit, step, spread = E.OCTONION_SHARE * E.RECONSTRUCTION, E.OCTONION_SHARE * E.SMOOTHNESS / dim, E.OCTONION_SHARE * E.BLOCK_VARIANCE / dim
    left, right = step * (at > 0), step * (at < dim - 1)
    bends = E.LOCAL_SHARE * E.GRADIENT / dim * np.stack([(at + d > 0) & (at + d < dim - 1) for d in (-1, 0, 1)], 1)
    square = fit * share**2 + left + right + spread * (1 - part)
    far, turn = np.array([[-1 / E.NEIGHBOURS]] * E.NEIGHBOURS + [[1.0]]), np.array([[1.0], [-2.0], [1.0]])
    # flat copies with the lanes side by side
    flat = x.T.ravel()
    means = np.stack([x[:, b : b + BLOCK].mean(1) for b in range(0, dim, BLOCK)]).ravel()
    gaps = np.stack([x[:, o * width : (o + 1) * width].mean(1) - y[:, o] if o * width < min((o + 1) * width, dim) else -y[:, o] for o in range(k)]).ravel()
    around = (at[:, None] + np.arange(-E.NEIGHBOURS, E.NEIGHBOURS + 1)) % dim * lanes
    for i, d, limit in zip(places, sizes, limits, strict=True):
        near = around[i].T + lane
        w, in_block, in_own = flat.take(near), block[i] * lanes + lane, own[i] * lanes + lane
        mean, gap = means.take(in_block), gaps.take(in_own)
        here, share_i = w[3], share[i]
        slope = fit * share_i * gap + left[i] * (here - w[2]) + right[i] * (here - w[4]) + spread * (here - mean)
        apart, bend = w[:4] - (w[1:5] + w[2:6] + w[3:7]) / E.NEIGHBOURS, w[1:4] - 2 * w[2:5] + w[3:6]
        rise = d * (2 * slope + d * square[i])
        rise += E.LOCAL_SHARE * E.LOCAL / dim * (np.abs(apart + far * d) - np.abs(apart)).sum(0)
        rise += (bends[i].T * (np.abs(bend + turn * d) - np.abs(bend))).sum(0)
        d = np.where(rise <= limit, d, 0.0)
        flat[near[3]], means[in_block], gaps[in_own] = here + d, mean + part[i] * d, gap + share_i * d
    x[:] = flat.reshape(dim, lanes).T


def thermodynamic(ys: np.ndarray, dim: int, rngs: list[np.random.Generator], replicas: int = REPLICAS, iterations: int = ITERATIONS, move=move) -> np.ndarray:
    """Metropolis moves of single coordinates at a ladder of temperatures with exchanges; the coldest replica of each row of ``ys``.

    All replicas of all rows move at once. A rise is taken up to kT times an exponential draw, which
    is as probable as exp(-rise / kT) above a uniform one.
    """
    n = len(ys)
    x = np.concatenate([replicated(y, dim) + rng.normal(0, 0.1, (replicas, dim)) for y, rng in zip(ys, rngs, strict=True)])
    y, heat = np.repeat(ys, replicas, 0), COLDEST * (HOTTEST / COLDEST) ** (np.arange(replicas) / max(replicas - 1, 1))
    edges = [0, *range(1, iterations, EXCHANGE_EVERY), iterations]
    for begin, end in zip(edges, edges[1:], strict=False):
        shape = ((end - begin) * MOVES, replicas)
        drawn = [(rng.integers(0, dim, shape), rng.normal(0, STEP, shape), rng.standard_exponential(shape) * KB_EV * heat) for rng in rngs]
        move(x, y, *(np.concatenate(part, 1) for part in zip(*drawn, strict=True)))
        if (end - 1) % EXCHANGE_EVERY == 0 and end > begin:
            now, rows = combined_energy(x, y).reshape(n, replicas), x.reshape(n, replicas, dim)
            limits = np.stack([rng.standard_exponential(replicas - 1) for rng in rngs])
            for i in range(replicas - 1):
                swap = (1 / heat[i] - 1 / heat[i + 1]) / KB_EV * (now[:, i + 1] - now[:, i]) <= limits[:, i]
                for held in (rows, now):
                    held[swap, i], held[swap, i + 1] = held[swap, i + 1], held[swap, i]
    return x.reshape(n, replicas, dim)[:, 0]


def hybrid(ys: np.ndarray, dim: int, rngs: list[np.random.Generator], iterations: int = 50, move=move) -> np.ndarray:
    """Replication, then single-coordinate noise kept where the energy does not rise; all rows of ``ys`` move at once."""
    x = np.stack([replicated(y, dim) for y in ys]).astype(float)
    drawn = [(rng.integers(0, dim, (iterations, 1)), rng.normal(0, 0.05, (iterations, 1))) for rng in rngs]
    places, sizes = (np.concatenate(part, 1) for part in zip(*drawn, strict=True))
    move(x, ys, places, sizes, np.zeros(sizes.shape))
    return x


METHODS = {"thermodynamic": thermodynamic, "hybrid": hybrid, "hybrid_quick": partial(hybrid, iterations=10)}


def decode(df: DataFrame, code: str, dim: int, method: str, seed: int = 0, key: str = "vec_id", out: str = "decoded", **options) -> DataFrame:
    """``df`` with ``out``: the reconstruction of ``code``; random numbers depend on (seed, key) only."""
    ship(df.sparkSession)
    at, id_at, run_all = df.columns.index(code), df.columns.index(key), METHODS[method]

    def reconstructed(keys: list, codes: list) -> list:
        done = [None] * len(codes)
        for size in {len(y) for y in codes}:
            rows = [r for r, y in enumerate(codes) if len(y) == size]
            found = run_all(np.array([codes[r] for r in rows], float), dim, [np.random.default_rng([seed, keys[r]]) for r in rows], **options)
            for r, x in zip(rows, found.tolist(), strict=True):
                done[r] = x
        return done

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, codes = batch.column(id_at).to_pylist(), batch.column(at).to_pylist()
            done = [x for r in range(0, len(codes), ROWS) for x in reconstructed(keys[r : r + ROWS], codes[r : r + ROWS])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(done, pa.list_(pa.float64()))], names=[*batch.schema.names, out])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(out, ArrayType(DoubleType()))]))
