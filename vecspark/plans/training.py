"""Codec training: split, sample by a schedule, adapt, evaluate, stop.

Pairs stay a frame; the driver holds the optimiser's state and the sampled vectors of one
step, whose number the schedule bounds. Evaluation is a Spark plan over whole splits.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import metrics, sampling
from ..operators.linear import LinearCodec, default_dim
from .cmaes import CMAES
from .monitor import EarlyStopping, TrainingReport, overfit

#: Most rows and pairs that one fitness looks at.
FIT_ROWS, FIT_PAIRS = 50, 200


@dataclass(frozen=True)
class TrainerConfig:
    compressed_dim: int | None = None
    generations: int = 100
    population: int = 50
    sigma: float = 0.1
    patience: int = 3
    min_improvement: float = 0.001
    validation_fraction: float = 0.2
    max_validation: int | None = 50_000
    seed: int = 42
    strategy: str = "random"
    schedule: dict = field(default_factory=lambda: {"kind": "fixed", "values": (100, 200, 500, 1000, 2000, 5000, 10_000, 20_000, 50_000)})

    @classmethod
    def instant(cls) -> TrainerConfig:
        return cls(generations=5, population=10, patience=1, schedule={"kind": "single", "n": 50})

    @classmethod
    def quick(cls) -> TrainerConfig:
        return cls(generations=50, population=30, schedule={"kind": "fixed", "values": (100, 200, 500, 1000, 2000, 5000)})

    @classmethod
    def thorough(cls) -> TrainerConfig:
        return cls(generations=200, population=100, patience=5)

    def with_(self, **changes) -> TrainerConfig:
        return replace(self, **changes)


def rank_correlation(x: np.ndarray, y: np.ndarray) -> float:
    """Spearman with ordinal ranks, ties by position."""
    n = len(x)
    if n < 2 or n != len(y):
        return 0.0
    rx, ry = np.empty(n), np.empty(n)
    rx[np.argsort(x, kind="stable")] = np.arange(n)
    ry[np.argsort(y, kind="stable")] = np.arange(n)
    return float(1 - 6 * ((rx - ry) ** 2).sum() / (n * (n * n - 1)))


def fit_pairs(n: int) -> tuple[np.ndarray, np.ndarray]:
    i, j = np.triu_indices(min(n, FIT_ROWS), 1)
    return i[:FIT_PAIRS], j[:FIT_PAIRS]


def cosines(x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=-1, keepdims=True)
    unit = np.divide(x, n, out=np.zeros_like(x), where=n > 1e-9)
    return (unit[..., i, :] * unit[..., j, :]).sum(-1)


def adapt(vectors: np.ndarray, start: np.ndarray, config: TrainerConfig) -> np.ndarray:
    """Weights whose projection keeps the order of cosines best."""
    k, d = start.shape
    i, j = fit_pairs(len(vectors))
    goal = cosines(vectors, i, j)
    search = CMAES(start.ravel(), config.sigma, config.population, config.seed)
    for _ in range(config.generations):
        tried = search.ask()
        codes = np.einsum("nd,pkd->pnk", vectors[: FIT_ROWS], tried.reshape(-1, k, d))
        got = cosines(codes, i, j)
        search.tell(tried, np.array([-rank_correlation(g, goal) for g in got]))
    return search.best.reshape(k, d)


def evaluate(pairs: DataFrame, codec: LinearCodec) -> float:
    """Rank correlation of cosines before and after the projection, over all pairs (pair_id, e1, e2)."""
    scored = pairs.select("pair_id", V.cosine(V.as_double(F.col("e1")), V.as_double(F.col("e2"))).alias("x"), V.cosine(codec.compress(F.col("e1")), codec.compress(F.col("e2"))).alias("y"))
    return float(metrics.spearman(scored, "x", "y", "pair_id").first()["rho"])


@dataclass
class Trained:
    codec: LinearCodec
    report: TrainingReport


def as_pairs(df: DataFrame) -> DataFrame:
    """(pair_id, e1, e2): ring pairs of a set of vectors."""
    ring = metrics.ring_pairs(df, "vec_id", ["embedding"])
    return ring.select("pair_id", F.col("a_embedding").alias("e1"), F.col("b_embedding").alias("e2"))


def train(pairs: DataFrame, config: TrainerConfig | None = None) -> Trained:
    """Fit a linear codec on pairs (pair_id, e1, e2)."""
    config, begun = config or TrainerConfig(), time.time()
    halves = sampling.split(pairs, config.validation_fraction, config.seed, config.max_validation, key="pair_id").persist()
    learn, check = halves.where("split = 'train'"), halves.where("split = 'validation'")
    n, d = learn.count(), len(pairs.select("e1").first()[0])
    k = config.compressed_dim or default_dim(d)
    if n < 2:
        raise ValueError("two training pairs are needed at least")
    codec = LinearCodec.golden(d, k)
    report = TrainingReport(d, k, n)
    stop, reason = EarlyStopping(config.patience, config.min_improvement), "max_samples"
    pick = sampling.sampler(config.strategy)
    for step, size in enumerate(sampling.sizes(available=n, **config.schedule) or [n]):
        now = time.time()
        ids = pick(learn.select(F.col("pair_id").alias("vec_id"), F.col("e1").alias("embedding")), size, config.seed + step)
        sampled = learn.join(ids.select(F.col("vec_id").alias("pair_id")), "pair_id").orderBy("pair_id").limit(FIT_ROWS).select("e1").collect()
        tried = LinearCodec(adapt(np.array([r[0] for r in sampled], float), codec.weights, config), True)
        on_train, on_check = evaluate(learn, tried), evaluate(check, tried)
        report.add_step(size, on_train, on_check, time.time() - now)
        if overfit(on_train, on_check) == "overfitting":
            reason = "overfitting"
            break
        ended = stop.step(on_check, tried, size)
        codec = stop.best_weights
        if ended:
            reason = "stagnated"
            break
    report.finalize(stop.best_samples, evaluate(learn, codec), evaluate(check, codec), reason, time.time() - begun)
    halves.unpersist()
    return Trained(codec, report)
