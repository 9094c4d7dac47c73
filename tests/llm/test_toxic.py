import math
import random

import pytest
from pyspark.sql import functions as F

from vecspark.llm import toxicity as X

from .helpers import ROWS, clashing, documents, empty

LABELS = "doc_id long, quality int, toxic int"


def brute(scores):
    """Maximal-scoring segments by their recursive definition."""
    out = []

    def split(low, high):
        best = None
        for i in range(low, high):
            total = 0.0
            for j in range(i, high):
                total += scores[j]
                if total > 1e-12 and (best is None or total > best[0] + 1e-12 or abs(total - best[0]) < 1e-12 and j - i < best[2] - best[1]):
                    best = (total, i, j)
        if best:
            split(low, best[1])
            out.append((best[1], best[2] + 1, round(best[0], 6)))
            split(best[2] + 1, high)

    split(0, len(scores))
    return out


def test_segments_are_the_maximal_ones():
    rng = random.Random(3)
    for _ in range(400):
        n = rng.randint(1, 25)
        hits = {i: rng.uniform(0.1, 3) for i in rng.sample(range(n), rng.randint(1, min(n, 8)))}
        cost = -rng.uniform(0.05, 1)
        against = {i: -rng.uniform(1, 2) for i in rng.sample(range(n), n // 5) if i not in hits}
        got = [(b, e, round(s, 6)) for b, e, s in X.segments(sorted({**hits, **against}.items()), cost)]
        assert got == brute([{**hits, **against}.get(i, cost) for i in range(n)])


def test_scale_and_size_of_the_extreme_value_law():
    model = X.Model(background=-0.05)
    clean = {3.0: 4.0, 1.0: 20.0, -2.0: 10.0}
    scale = X.scale_of(clean, [3.0, 1.0], 10_000, model)
    share = {s: (n + (0.25 if s > 0 else 0)) / 10_001 for s, n in clean.items()}
    assert sum(p * math.exp(scale * s) for s, p in share.items()) + (1 - sum(share.values())) * math.exp(scale * model.background) == pytest.approx(1)
    rarity = X.rarity_of({3.0: 4.0, 1.0: 20.0}, [1.0], 10_000, scale)
    for s, n in ((3.0, 4), (1.0, 24)):
        assert rarity * 10_001 * math.exp(-scale * s) >= n - 1e-9
    assert X.rarity_of({}, [], 0, 1.0) <= 1


@pytest.mark.parametrize(("sf", "area", "found", "wrong"), [("sf0.01", 0.88, 14, 0)])
def test_held_out_rows_of_the_given_tables(spark, sf, area, found, wrong):
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = X.judge(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out and toxic is not null").collect()
    bad, good = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    assert sum((b > g) + (b == g) / 2 for b in bad for g in good) / len(bad) / len(good) >= area
    assert sum(s >= X.THRESHOLD for s in bad) >= found
    assert sum(s >= X.THRESHOLD for s in good) <= wrong


def corpus(spark, n=400, seed=0):
    rng = random.Random(seed)
    words = [f"wort{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        own, bad = rng.choices(words, k=rng.randint(10, 200)), i % 5 == 0
        for _ in range(rng.randint(1, 4) * bad):
            own.insert(rng.randrange(len(own)), rng.choice(["Vile,", "nasty", "rotten!"]))
        rows.append((i, " ".join(own), "en", "s", 1))
        labels.append((i, 1, int(bad)))
    return documents(spark, rows), spark.createDataFrame(labels, LABELS)


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    rows = X.judge(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 100
    assert all(r.predicted == r.toxic for r in rows)
    assert {r.held_out for r in X.judge(docs, labels).collect()} == {True, False}
    same = {r.doc_id: r.score for r in X.judge(docs.repartition(9), labels).collect()}
    assert all(same[r.doc_id] == pytest.approx(r.score, abs=1e-9) for r in rows)


def test_labels_of_the_held_out_fold_are_never_used(spark):
    docs, labels = corpus(spark)
    turned = labels.withColumn("toxic", F.when(X.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = {r.doc_id: r.score for r in X.judge(docs, labels).collect()}
    b = {r.doc_id: r.score for r in X.judge(docs, turned).collect()}
    assert a == b


def test_passages(spark):
    docs, labels = corpus(spark)
    model = X.fit(docs, labels)
    one = documents(spark, [(1, "wort1 " * 30 + "vile nasty rotten " + "wort2 " * 30, "en", "s", 1), (2, "wort1 " * 30, "en", "s", 1)])
    got = X.passages(one, model).collect()
    assert [(r.doc_id, r.begin, r.end) for r in got] == [(1, 30, 33)]


def test_odd_rows(spark):
    docs, labels = corpus(spark)
    both = docs.unionByName(documents(spark).withColumn("doc_id", F.col("doc_id") + 10_000))
    out = X.judge(clashing(both), labels).collect()
    assert len(out) == 400 + len(ROWS)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    assert not any(r.predicted for r in out if r.doc_id is None or r.doc_id >= 10_000)
    assert X.judge(empty(spark), labels).count() == 0
    assert {r.predicted for r in X.judge(docs, labels.limit(0)).collect()} == {0}
    nulls = spark.createDataFrame([(None, 1, 1), (1, None, None), (77_777, 1, 1)], LABELS)
    assert X.judge(docs, nulls).count() == 400
    kept = X.reject(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == 320
