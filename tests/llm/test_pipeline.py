import math
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from vecspark.llm import mixing, registry, toxicity
from vecspark.llm.common import materialise

from .helpers import clashing, documents
from .test_rows import WORDS, measured
from .test_similar import brute
from .test_toxic import brute as brute_segments


def test_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES)
    assert numbers == list(range(1, 11))
    assert set(registry.ORACLE) <= set(registry.QUERIES)
    assert "pipeline" in entry.queries()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "toxicity", "n-gram Jaccard join", "mixing sources to target weights", "packing"]


def plain_score(model, text):
    """The score by all pairs of places instead of one scan."""
    words = toxicity.tokens(text)
    scores = [model.weight(w) or model.background for w in words]
    cost = math.log(max(model.rarity * len(words), 1.0))
    value = sum(max(0.0, model.scale * s - cost) for _, _, s in brute_segments(scores)) if any(s > 0 for s in scores) else 0.0
    return 1 / (1 + math.exp(-(model.bias + model.slope * math.log1p(value))))


def water_filled(sizes):
    names, left = sorted(sizes, key=lambda s: (s is None, s)), set(sizes)
    weight, target, total = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, {}, sum(sizes.values())
    while True:
        level = (total - sum(target.values())) / sum(weight[s] for s in left)
        over = {s for s in left if 3 * sizes[s] <= weight[s] * level}
        if not over:
            return target | {s: weight[s] * level for s in left}
        target |= {s: 3.0 * sizes[s] for s in over}
        left -= over


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    first = materialise(stages["quality rules"](spark, docs, sf_dir), "t")
    good = {r.doc_id for r in docs.collect() if (m := measured(r.text))[0] >= 50 and 2 * m[4] <= m[0]}
    assert {r.doc_id for r in first.collect()} == good
    second = materialise(stages["toxicity"](spark, first, sf_dir), "t")
    model = toxicity.fit(first, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    short = {r.doc_id: r.text for r in first.collect() if len(r.text) < 2500}
    assert {r.doc_id for r in second.collect()} & set(short) == {i for i, t in short.items() if plain_score(model, t) < toxicity.THRESHOLD}
    third = materialise(stages["n-gram Jaccard join"](spark, second, sf_dir), "t")
    assert {r.doc_id for r in third.collect()} == {c for _, _, c, _ in brute([tuple(r) for r in second.collect()], 5, 80, 100)}
    fourth = materialise(stages["mixing sources to target weights"](spark, third, sf_dir), "t")
    rows, sizes = third.withColumn("u", mixing.draw(F.col("doc_id"), mixing.SEED)).collect(), {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + len(WORDS.findall(r.text))
    target = water_filled(sizes)
    rate = {s: target[s] / sizes[s] for s in sizes}
    times = {r.doc_id: int(rate[r.source]) + (r.u < rate[r.source] % 1) for r in rows}
    got = {r.doc_id: r["count"] for r in fourth.groupBy("doc_id").count().collect()}
    assert got == {i: n for i, n in times.items() if n}
    assert first.columns == second.columns == third.columns == fourth.columns == docs.columns
    last = materialise(stages["packing"](spark, fourth, sf_dir), "t").collect()
    tokenizer = Tokenizer.from_file(P.path(corpus_pipeline.TOKENIZER))
    tokenizer.encode_special_tokens = True
    ids = {r.doc_id: [*tokenizer.encode(r.text, add_special_tokens=False).ids, corpus_pipeline.END_ID] for r in rows}
    assert sum(r.length for r in last) == sum(n * len(ids[i]) for i, n in got.items())
    assert all(r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) for r in last)
    spans = {}
    for r in last:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for k, own in spans.items():
        ends = np.cumsum([n for _, n in sorted(own)])
        assert [o for o, _ in sorted(own)] == [0, *ends[:-1].tolist()]
        assert ends[-1] == 2048 or k == len(spans) - 1
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.doc_tokens) for r in last if r.start == 0) == sorted((r.doc_id, r.doc_tokens) for r in whole if r.start == 0)


NAMES = ("row", "found", "mix", "copy", "key", "t", "id", "drop_id", "drop_t", "__m", "__score", "__size", "__mix", "__copy", "__source", "__k", "__at", "ratio", "level", "shut", "hash")


@pytest.mark.parametrize("rows", [None, []])
def test_odd_and_empty_tables_with_clashing_names(spark, sf_dir, rows):
    docs = clashing(documents(spark, rows)).select("*", *[F.lit("y").alias(c) for c in NAMES])
    for name, stage in corpus_pipeline.STAGES:
        out = materialise(stage(spark, docs, sf_dir), "t")
        if name != "packing":
            assert out.columns == docs.columns
            assert not out.where(" or ".join(f"`{c}` <> 'y'" for c in NAMES)).count()
            docs = out
    assert out.count() == 0 or rows is None
