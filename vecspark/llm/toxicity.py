"""Toxicity by maximum-scoring segments over token log-odds.

Fit: documents of the labelled training rows (TRAIN_LIMIT at most, chosen by hash of the
id) give, for each word and each word stem, the number of toxic and of clean documents
with it. Each counted word has its log-odds with a Dirichlet prior at the base rate, for or
against, where they differ from 0 by more than their error; a word that is too rare to tell
stands at the small negative weight that the share of telling words in toxic and clean text
implies. Score: a linear scan (Ruzzo and Tompa, 1999) lists every maximal-scoring segment.
By the extreme-value law of such segments
(Karlin and Altschul, 1990) a segment of score S among n tokens is worth L S - ln(K n): L
solves sum p(s) exp(L s) = 1 over the token scores s of clean training text, and K is the
least one for which the law's number of segments, K n exp(-L S), is at no score below what
the clean training text has. The significant segments add up to the document's evidence,
which a ridge logistic curve on the training rows turns into a probability.

Texts are scored whole, row by row, without a shuffle; the model is a few thousand numbers.

Defined results: null and empty texts have no evidence and the score of no evidence;
repeated rows score alike; null doc_id counts as the empty id for the fold; labels that are
null, or of ids without a document, are not used; without any toxic or clean training row
the score is the base rate everywhere; very long texts are scanned whole; an empty table
gives no rows; extra columns, whatever their names, are ignored (``reject`` keeps them).
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, materialise, own_columns, table, tidy

#: Bound of the training sample: labelled rows used to fit, the first by hash of their id.
TRAIN_LIMIT = 20_000
STEMS = (4, 5, 6)
PRIOR = 2.0
#: Errors by which the log-odds of a word must differ from 0 among 300 training rows; MORE_Z more with each tenfold number of rows, as more words are tried.
MIN_Z = 3.0
MORE_Z = 0.75
#: A stem needs MIN_STEM_Z more and so many times as many toxic documents as clean ones.
MIN_STEM_Z = 1.0
STEM_RATIO = 20
#: Near copies count once: of training rows with one of these smallest shingle hashes in common only one is used.
SIGNATURES = 3
THRESHOLD = 0.7
MEMO = 1_000_000

_SPACE = bytes(32 if (c < 48 or 57 < c < 65 or 90 < c < 97 or 122 < c < 128) else c for c in range(256))


def tokens(text: str | None) -> list[bytes]:
    """Lower-case words without ASCII punctuation, as UTF-8."""
    return (text or "").lower().encode("utf-8", "replace").translate(_SPACE).split()


def stems(word: bytes) -> list[bytes]:
    """Keys of a word's longer beginnings, longest first; a stem is in characters."""
    w = word.decode("utf-8", "replace")
    return [w[:n].encode() + b"*" for n in reversed(STEMS) if len(w) > n]


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


@dataclass
class Model:
    weights: dict[bytes, float] = field(default_factory=dict)
    background: float = -0.01
    scale: float = 1.0
    rarity: float = 0.01
    bias: float = 0.0
    slope: float = 0.0

    def weight(self, word: bytes) -> float:
        """Weight of a lexicon word or of its longest lexicon stem, else 0."""
        found = self.weights.get(word)
        if found is None:
            found = next((self.weights[s] for s in stems(word) if s in self.weights), 0.0)
        return found


class Memo(dict):
    """Weights of words seen by a worker."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: bytes) -> float:
        if len(self) > MEMO:
            self.clear()
        self[word] = found = self.model.weight(word)
        return found


def segments(hits: list[tuple[int, float]], background: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (begin, end, score) of a text whose tokens score ``background`` but for ``hits`` (place, weight).

    One pass; each candidate is held with the sums before and after it.
    """
    held: list[list] = []  # begin, end, sum before, sum after, place in held of the nearest earlier candidate with a smaller sum before
    total, last = 0.0, 0
    for at, weight in hits:
        total += background * (at - last)
        if weight <= 0:
            total, last = total + weight, at + 1
            continue
        own = [at, at + 1, total, total + weight]
        total, last = total + weight, at + 1
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= own[2]:
                j = held[j][4]
            if j < 0 or held[j][3] >= own[3]:
                held.append([*own, j])
                break
            own = [held[j][0], own[1], held[j][2], own[3]]
            del held[j:]
    return [(b, e, after - before) for b, e, before, after, _ in held]


def evidence(text: str | None, memo: Memo) -> tuple[float, list[tuple[int, int, float]]]:
    """(sum of normalised scores of significant segments, the segments as token ranges with normalised scores)."""
    model = memo.model
    scores = [memo[w] for w in tokens(text)]
    hits = [(i, s) for i, s in enumerate(scores) if s]
    if not hits:
        return 0.0, []
    cost = math.log(max(model.rarity * len(scores), 1.0))
    found = [(b, e, model.scale * s - cost) for b, e, s in segments(hits, model.background)]
    found = [f for f in found if f[2] > 0]
    return sum(f[2] for f in found), found


def found_in(text: str | None, memo: Memo) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments of a text with their scores."""
    return segments([(i, s) for i, s in enumerate(map(memo.__getitem__, tokens(text))) if s], memo.model.background)


def rarity_of(clean: dict[float, float], weights: list[float], n_clean: int, scale: float) -> float:
    """Least K with K n exp(-L S) at no score S below the number of clean segments of that score or more; at least half a segment of the least weight."""
    count, best = 0.0, 0.5 * math.exp(min(scale * min(weights, default=0.0), 700.0))
    for s in sorted(clean, reverse=True):
        count += clean[s]
        best = max(best, count * math.exp(min(scale * s, 700.0)))
    return min(max(best / (n_clean + 1), 1e-6), 1.0)


def training_rows(documents: DataFrame, labels: DataFrame, limit: int = TRAIN_LIMIT) -> DataFrame:
    """(text, toxic) of at most ``limit`` labelled rows outside the held-out fold; equal texts once."""
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = own.select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    # The texts are read once; what is kept of them is bounded.
    rows = materialise(documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "labelled")
    names = [f"s{k}" for k in range(SIGNATURES)]
    schema = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), *[(c, pa.int64()) for c in names]])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            smallest = np.array([signature(t.as_py()) for t in batch.column(1)], np.int64).reshape(-1, SIGNATURES)
            yield pa.record_batch([batch.column(0).cast(pa.int64()), batch.column(2), *[pa.array(smallest[:, k]) for k in range(SIGNATURES)]], schema=schema)

    # Only ids and signatures are shuffled; of equal signatures the smallest id stays, whatever the partitions.
    kept = map_arrow(rows.select("doc_id", "text", "toxic"), sign, "doc_id long, toxic int, " + ", ".join(f"{c} long" for c in names))
    for c in names:
        kept = kept.groupBy(c, "toxic").agg(F.min(F.struct("doc_id", *names)).alias("r")).select("r.doc_id", "toxic", *[f"r.{x}" for x in names])
    return rows.join(F.broadcast(kept.select("doc_id").distinct()), "doc_id").select("text", "toxic")


def signature(text: str | None) -> list[int]:
    """SIGNATURES min-hashes of the three-word shingles of a text."""
    words = tokens(text)
    grams = np.fromiter((zlib.crc32(b" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))), np.uint64)
    return [int((((grams * np.uint64(0x9E3779B97F4A7C15 + 2 * k)) ^ grams) >> np.uint64(11)).min()) for k in range(SIGNATURES)]


def count_words(rows: DataFrame) -> DataFrame:
    """(key, toxic, clean): training documents with a word or stem; key ``#`` counts documents, ``#tokens`` tokens."""
    schema = pa.schema([("key", pa.binary()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                words = tokens(text.as_py())
                own = set(words)
                keys = own.union(*map(stems, own)) if own else set()
                counts[0 if toxic else 1].update(keys)
                counts[0 if toxic else 1].update({b"#": 1, b"#tokens": len(words)})
        keys = list(counts[0] | counts[1])
        for low in range(0, len(keys), 50_000):
            part = keys[low : low + 50_000]
            yield pa.record_batch([pa.array(part, pa.binary()), pa.array([counts[0][k] for k in part], pa.int64()), pa.array([counts[1][k] for k in part], pa.int64())], schema=schema)

    return map_arrow(rows, run, "key binary, toxic long, clean long").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit(documents: DataFrame, labels: DataFrame, limit: int = TRAIN_LIMIT) -> Model:
    with tidy(documents.sparkSession):
        return _fit(training_rows(documents, labels, limit).persist())


def _fit(rows: DataFrame) -> Model:
    try:
        counts = count_words(rows).persist()
        totals = {bytes(r["key"]): (r["toxic"], r["clean"]) for r in counts.where(F.col("key").isin(bytearray(b"#"), bytearray(b"#tokens"))).collect()}
        n_toxic, n_clean = totals.get(b"#", (0, 0))
        if not n_toxic or not n_clean:
            counts.unpersist()
            rate = min(max((n_toxic + 0.5) / (n_toxic + n_clean + 1), 0.01), 0.99)
            return Model(bias=math.log(rate / (1 - rate)))
        base = n_toxic / (n_toxic + n_clean)
        a, b = F.col("toxic") + PRIOR * base, F.col("clean") + PRIOR * (1 - base)
        odds = F.log(a / b) - F.lit(math.log(base / (1 - base)))
        scored = counts.where(~F.col("key").isin(bytearray(b"#"), bytearray(b"#tokens"))).withColumn("odds", odds).withColumn("z", odds / F.sqrt(1 / a + 1 / b))
        least = MIN_Z + MORE_Z * math.log10(max(1.0, (n_toxic + n_clean) / 300))
        telling = scored.where(F.abs("z") >= least).collect()  # words of the bounded training rows that many of them have
        weights = {bytes(r["key"]): r["odds"] for r in telling if not bytes(r["key"]).endswith(b"*") or r["z"] >= least + MIN_STEM_Z and r["toxic"] > STEM_RATIO * r["clean"]}
        counts.unpersist()
        model = Model(weights=weights)
        return calibrate(model, rows, totals[b"#tokens"])
    finally:
        rows.unpersist()


def calibrate(model: Model, rows: DataFrame, n_tokens: tuple[int, int]) -> Model:
    """Background weight, extreme-value scale and size, and the logistic curve from the training rows."""
    schema = pa.schema([("toxic", pa.int32()), ("value", pa.float64()), ("mass", pa.float64())])

    def measure(shared, each) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            memo = Memo(shared.value)
            for batch in batches:
                out = [(toxic, *pair) for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True) for pair in each(text.as_py(), memo)]
                if out:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

        return map_arrow(rows, run, "toxic int, value double, mass double")

    def scores(text: str | None, memo: Memo):
        return [(round(s, 2), float(n)) for s, n in Counter(map(memo.__getitem__, tokens(text))).items() if s]

    context = rows.sparkSession.sparkContext
    shared = context.broadcast(model)
    found = measure(shared, scores).groupBy((F.col("toxic") > 0).alias("toxic"), "value").agg(F.sum("mass").alias("n")).collect()  # a histogram of rounded scores
    shared.unpersist()
    hits = {kind: sum(r["n"] for r in found if r["toxic"] == kind and r["value"] > 0) for kind in (True, False)}
    q_toxic, q_clean = (hits[True] + 0.5) / (n_tokens[0] + 1), (hits[False] + 0.5) / (n_tokens[1] + 1)
    model.background = min(math.log1p(-min(q_toxic, 0.9)) - math.log1p(-min(q_clean, 0.9)), -1e-3)
    model.scale = scale_of({r["value"]: r["n"] for r in found if not r["toxic"]}, [w for w in model.weights.values() if w > 0], n_tokens[1], model)
    shared = context.broadcast(model)
    found = measure(shared, lambda text, memo: [(round(s, 2), 1.0) for _, _, s in found_in(text, memo)]).where("toxic <= 0").groupBy("value").agg(F.sum("mass").alias("n")).collect()
    model.rarity = rarity_of({r["value"]: r["n"] for r in found}, [w for w in model.weights.values() if w > 0], n_tokens[1], model.scale)
    shared.unpersist()
    shared = context.broadcast(model)
    got = measure(shared, lambda text, memo: [(evidence(text, memo)[0], 0.0)]).select("toxic", "value").toArrow()  # as many numbers as training rows, TRAIN_LIMIT at most
    y, x = got.column("toxic").to_numpy() > 0, np.log1p(got.column("value").to_numpy())
    model.bias, model.slope = logistic(x, y.astype(float))
    shared.unpersist()
    return model


def scale_of(clean: dict[float, float], weights: list[float], n_clean: int, model: Model) -> float:
    """L > 0 with sum p(s) exp(L s) = 1 over the scores of clean tokens; the background is lowered where their mean would not be negative.

    A word for toxicity that no clean row has counts as half a hit, spread over the scores.
    """
    if not weights:
        return 1.0
    counts = Counter(clean)
    for w in weights:
        counts[round(w, 2)] += 0.5 / len(weights)
    share = {s: n / (n_clean + 1) for s, n in counts.items()}
    rest, mean = max(1 - sum(share.values()), 1e-9), sum(s * p for s, p in share.items())
    model.background = min(model.background, -2 * max(mean, 0.0) / rest)
    low, high = 0.0, 1.0
    value = lambda scale: sum(p * math.exp(min(scale * s, 700.0)) for s, p in share.items()) + rest * math.exp(scale * model.background)
    while value(high) < 1 and high < 1e6:
        low, high = high, 2 * high
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if value(middle) < 1 else (low, middle)
    return max(high, 0.1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float]:
    """Bias and slope of a ridge logistic curve, by Newton steps."""
    design, w = np.stack([np.ones_like(x), x], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ w))
        grad = design.T @ (p - y) + ridge * w
        hess = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(max(w[1], 0.0))


def scorer(spark: SparkSession, model: Model):
    """Pandas UDF text -> score."""
    from ..session import ship

    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        held = shared.value
        memo = held.__dict__.setdefault("_memo", Memo(held))
        return pd.Series([1 / (1 + math.exp(-(held.bias + held.slope * math.log1p(evidence(t, memo)[0])))) for t in texts], dtype="float64")

    return score


def passages(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, begin, end, score): every significant toxic passage, in tokens."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(shared.value)
        for batch in batches:
            found = [{"doc_id": i.as_py(), "begin": b, "end": e, "score": s} for i, t in zip(batch.column(0), batch.column(1), strict=True) for b, e, s in evidence(t.as_py(), memo)[1]]
            yield pa.RecordBatch.from_pylist(found, schema=schema)

    return map_arrow(documents.select("doc_id", "text"), run, "doc_id long, begin int, end int, score double")


def judge(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of ``documents``."""
    score = scorer(documents.sparkSession, fit(documents, labels))
    out = documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def reject(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``documents`` that are not predicted toxic, with its columns."""
    score = scorer(documents.sparkSession, fit(documents, labels))
    return own_columns(documents).withColumn("score", score("row.text")).where(F.col("score") < THRESHOLD).select("row.*")


def op5_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
