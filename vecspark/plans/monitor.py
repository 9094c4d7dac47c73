"""Early stopping, overfitting checks and the training report."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OVERFIT_GAP, WARNING_GAP = 0.05, 0.02
FAILED_GAP, REPORT_WARNING_GAP = 0.10, 0.05


@dataclass
class EarlyStopping:
    patience: int = 3
    min_improvement: float = 0.001
    minimise: bool = False
    best_score: float | None = None
    best_weights: object = None
    best_samples: int = 0
    waited: int = 0

    def step(self, score: float, weights=None, samples: int = 0) -> bool:
        """True when training should stop."""
        better = self.best_score is None or (score < self.best_score - self.min_improvement if self.minimise else score > self.best_score + self.min_improvement)
        if better:
            self.best_score, self.best_weights, self.best_samples, self.waited = score, weights, samples, 0
        else:
            self.waited += 1
        return self.should_stop()

    def should_stop(self) -> bool:
        return self.waited >= self.patience

    def stop_reason(self) -> str | None:
        return f"no improvement for {self.patience} steps" if self.should_stop() else None

    def remaining_patience(self) -> int:
        return max(0, self.patience - self.waited)

    def reset(self) -> None:
        self.best_score, self.best_weights, self.best_samples, self.waited = None, None, 0, 0


def early_stop_trace(scores: DataFrame, patience: int, min_improvement: float) -> DataFrame:
    """(step, score, best, waited, stop) of a short trace (step, score), by a fold over its steps."""
    trace = scores.agg(F.array_sort(F.collect_list(F.struct("step", "score"))).alias("t"))
    kind = "array<struct<step:int,score:double,best:double,waited:int>>"

    def fold(done, x):
        last = F.get(done, F.size(done) - 1)
        better = (F.size(done) == 0) | (x["score"] > last["best"] + min_improvement)
        row = F.struct(x["step"].cast("int").alias("step"), x["score"].alias("score"), F.when(better, x["score"]).otherwise(last["best"]).alias("best"), F.when(better, 0).otherwise(last["waited"] + 1).alias("waited"))
        return F.concat(done, F.array(row))

    out = trace.select(F.explode(F.aggregate("t", F.array().cast(kind), fold)).alias("r")).select("r.*")
    return out.withColumn("stop", F.col("waited") >= patience)


def overfit_status(gap):
    return F.when(gap > OVERFIT_GAP, "overfitting").when(gap > WARNING_GAP, "warning").otherwise("ok")


def overfit(train: float, validation: float) -> str:
    gap = train - validation
    return "overfitting" if gap > OVERFIT_GAP else "warning" if gap > WARNING_GAP else "ok"


@dataclass
class TrainingReport:
    original_dim: int
    compressed_dim: int
    total_samples: int
    progression: list[dict] = field(default_factory=list)
    recommendations: list[dict] = field(default_factory=list)
    status: str = "running"
    optimal_samples: int = 0
    final_train_score: float = 0.0
    final_val_score: float = 0.0
    final_gap: float = 0.0
    stopped_reason: str = "completed"
    total_time_secs: float = 0.0

    def add_step(self, samples: int, train: float, validation: float, seconds: float) -> None:
        self.progression.append({"samples": samples, "train_score": train, "val_score": validation, "gap": train - validation, "overfit_status": overfit(train, validation), "time_secs": seconds})

    def finalize(self, samples: int, train: float, validation: float, reason: str, seconds: float) -> None:
        self.optimal_samples, self.final_train_score, self.final_val_score, self.stopped_reason, self.total_time_secs = samples, train, validation, reason, seconds
        self.final_gap = train - validation
        self.status = "failed" if self.final_gap > FAILED_GAP else "warning" if self.final_gap > REPORT_WARNING_GAP else "success"
        self.recommendations = [{"level": level, "message": text} for level, text in self._advice()]

    def _advice(self):
        gap, score = self.final_gap, self.final_val_score
        if gap < 0.02:
            yield "info", "The gap between training and validation is small"
        else:
            yield ("warning", f"The gap of {gap:.1%} is moderate; fewer samples may do") if gap < 0.05 else ("error", f"The gap of {gap:.1%} is high: overfitting")
        if score > 0.95:
            yield "info", f"The validation score of {score:.1%} is excellent"
        elif score > 0.90:
            yield "info", f"The validation score of {score:.1%} is good"
        else:
            yield ("warning", f"The validation score of {score:.1%} may gain from more data or other parameters") if score > 0.80 else ("error", f"The validation score of {score:.1%} is low: check the data")
        yield {
            "overfitting": ("warning", f"Stopped by overfitting at {self.optimal_samples} samples"),
            "stagnated": ("info", f"{self.optimal_samples} samples are the best size"),
            "max_samples": ("info", "The largest sample size brought no overfitting"),
        }.get(self.stopped_reason, ("info", "Training is complete"))
        if self.stopped_reason != "overfitting" and self.progression and self.progression[-1]["samples"] < self.total_samples // 2:
            yield "info", "Stopped early: this sample size suits the data"

    def summary(self) -> str:
        return f"{self.status.upper()}: {self.optimal_samples} samples, val={self.final_val_score:.1%}, gap={self.final_gap:.1%}"

    def to_json(self, indent: int | None = 2) -> str:
        return json.dumps(asdict(self), indent=indent)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(p.values()) for p in self.progression], "samples long, train_score double, val_score double, gap double, overfit_status string, time_secs double")


def running_best(scores: DataFrame) -> DataFrame:
    """(step, score, best): best score up to each step."""
    w = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return scores.select("step", "score", F.max("score").over(w).alias("best"))
