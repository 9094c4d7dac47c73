"""Sharding, quality, mixing and URL rules: odd rows, brute force and SQL."""

import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from vecspark.llm import bloom, common, mixing, quality, sharding, urls

from .helpers import ROWS, as_set, clashing, documents, empty

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def test_hilbert_steps(spark):
    cells = spark.range(16**3).select((F.col("id") % 16).alias("x"), (F.col("id") / 16 % 16).cast("int").alias("y"), (F.col("id") / 256).cast("int").alias("z"))
    rows = cells.withColumn("h", sharding.hilbert_index([F.col(c) for c in "xyz"], 4)).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(16**3))
    assert all(abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) == 1 for a, b in zip(rows, rows[1:], strict=False))


def test_shards(spark):
    df = documents(spark)
    out = sharding.shard(clashing(df), 4).collect()
    assert len(out) == len(ROWS)
    per = {s: sorted(r.slot for r in out if r.shard == s) for s in range(4)}
    assert all(v == list(range(len(v))) for v in per.values())
    assert max(map(len, per.values())) - min(map(len, per.values())) <= 1
    assert {(r.doc_id, r.size, r.text_crc32) for r in out} == {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in ROWS}
    ordered = sorted(out, key=lambda r: (r.shard, r.slot))
    assert [r.cell for r in ordered] == sorted(r.cell for r in out)
    assert as_set(sharding.shard(df.repartition(5), 4).collect()) == as_set(sharding.shard(df, 4).collect())
    assert sharding.shard(empty(spark), 4).count() == 0
    assert sharding.manifest(sharding.shard(df, 4)).count() == 4


def test_long_tables_of_values_give_the_same_shards(spark, monkeypatch):
    df = documents(spark)
    want = as_set(sharding.shard(df, 4).collect())
    monkeypatch.setattr(common, "MAX_BROADCAST_ROWS", 1)
    assert as_set(sharding.shard(df, 4).collect()) == want


def test_a_filter_on_metadata_skips_shards(spark, sf_dir):
    """A reader that holds a filter against the boxes opens few shards and misses no row."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = sharding.shard(docs, 16)
    boxes, rows = sharding.manifest(out).collect(), out.select("shard", "source_q", "lang_q").collect()
    opened = []
    for q in {(r.source_q, r.lang_q) for r in rows}:
        own = {b.shard for b in boxes if b.min_source_q <= q[0] <= b.max_source_q and b.min_lang_q <= q[1] <= b.max_lang_q}
        assert {r.shard for r in rows if (r.source_q, r.lang_q) == q} <= own
        opened.append(len(own))
    assert sum(opened) / len(opened) < 8


def test_rows_without_id_are_no_hot_group(spark):
    rows = [(None, f"text {i}", "en", "s", 1) for i in range(2000)]
    out = sharding.shard(documents(spark, rows), 16)
    assert {r["count"] for r in out.groupBy("shard").count().collect()} == {125}
    assert sorted(r.slot for r in out.where("shard = 3").collect()) == list(range(125))


def measured(text):
    text = text or ""
    w = WORDS.findall(text)
    grams = {}
    for i in range(len(w) - 2):
        grams.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + o for at in grams.values() if len(at) > 1 for i in at for o in range(3)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality(spark):
    df = documents(spark, [*ROWS, (90, "a b c a b c x", "en", "q", 1), (91, "a a a a a", "en", "q", 1), (92, "l one\nl one\n \n\n", "en", "q", 1)])
    for r in quality.judge(clashing(df)).collect():
        if r.doc_id is not None:
            texts = [t for i, t, *_ in df.collect() if i == r.doc_id]
            assert tuple(r.m) == measured(texts[0]), r.doc_id
    assert quality.judge(empty(spark)).count() == 0
    assert quality.reject(empty(spark)).count() == 0
    kept = quality.reject(df)
    assert kept.columns == df.columns
    good = {r.doc_id for r in quality.judge(df).collect() if r.kept}
    assert {r.doc_id for r in kept.collect()} == good


def test_bad_hosts_go(spark):
    words = " ".join(f"w{i}" for i in range(80))
    rows = [(i, words if i % 20 == 0 else "x", "en", "bad", 1) for i in range(200)] + [(1000 + i, words, "en", f"h{i % 9}", 1) for i in range(400)]
    out = {r.doc_id: r for r in quality.judge(documents(spark, rows)).collect()}
    assert not out[0].base_failed
    assert not out[0].kept
    assert all(out[1000 + i].kept for i in range(400))
    small = [(1, "x", "en", "tiny", 1), (2, words, "en", "tiny", 1)] + rows[200:]
    assert {r.doc_id: r.kept for r in quality.judge(documents(spark, small)).collect()}[2]


def test_mix(spark):
    df = documents(spark)
    out = mixing.copies(clashing(df)).select("row.doc_id", "row.source", "mix.*").collect()
    sizes = {}
    for i, t, _, s, _ in ROWS:
        sizes[s] = sizes.get(s, 0) + len(WORDS.findall(t or ""))
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, left, total = {}, set(names), sum(sizes.values())
    while True:
        level = (total - sum(target.values())) / sum(weight[s] for s in left)
        over = {s for s in left if 3 * sizes[s] <= weight[s] * level}
        if not over:
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        left -= over
    target |= {s: weight[s] * level for s in left}
    for r in out:
        assert r.target == pytest.approx(target[r.source])
        rate = target[r.source] / sizes[r.source] if sizes[r.source] else 0
        assert int(rate) <= r.copies <= min(3, int(rate) + 1)
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    assert mixed.count() == sum(r.copies for r in out)
    assert mixing.mix(empty(spark)).count() == 0
    assert as_set(mixing.copies(df.repartition(7)).collect()) == as_set(mixing.copies(df).collect())


def test_mix_comes_near_its_targets(spark):
    rows = [(i, "w " * (i % 40 + 1), "en", f"s{i % 4}", 1) for i in range(4000)]
    got = mixing.copies(documents(spark, rows)).groupBy("row.source").agg(F.sum(F.col("mix.size") * F.col("mix.copies")).alias("t"), F.first("mix.target").alias("g")).collect()
    assert all(abs(r.t - r.g) < 0.1 * r.g for r in got)


URLS = ["https://A.example.NET/en/x", "http://example.net/en", "http://x.example.com/de/1#f", "http://w.org/fr/", "http://w.org/", None, "no scheme", "http://h.net", "http://net/?q", "https://notexample.net/en/", "http://adult-x.example.com/en/1?p#q", "http://m.adult-x.example.com/en/1/", "://x.org/fr/a", "http://www.spam-farm.example.org/es/10.html", "http://spam-farm.example.org/es/8", "http://spam-farm.example.org/es/010", "http://blog.spam-farm.example.org/es/10", "http://spam-farm.example.org/es/99999"]


def test_urls(spark):
    df = spark.createDataFrame([(i, u, "") for i, u in enumerate(URLS)], "page_id long, url string, html string")
    out = {r.page_id: r for r in urls.judge(df.selectExpr("*", "1 as host", "2 as rule", "3 as h", "4 as found"), urls.listed_urls(spark)).collect()}
    assert [(r.host, r.path, r.rule, r.verdict) for _, r in sorted(out.items())] == [
        ("a.example.net", "/en/x", "example.net/en/", "allow"), ("example.net", "/en", "net/", "block"), ("x.example.com", "/de/1", "example.com/de/", "block"), ("w.org", "/fr/", "org/fr/", "allow"), ("w.org", "/", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("h.net", "", None, "allow"), ("net", "/", "net/", "block"), ("notexample.net", "/en/", "net/", "block"), ("adult-x.example.com", "/en/1", None, "block"), ("m.adult-x.example.com", "/en/1/", None, "block"), ("x.org", "/fr/a", "org/fr/", "allow"),
        ("www.spam-farm.example.org", "/es/10.html", None, "block"), ("spam-farm.example.org", "/es/8", None, "allow"), ("spam-farm.example.org", "/es/010", None, "allow"), ("blog.spam-farm.example.org", "/es/10", None, "allow"), ("spam-farm.example.org", "/es/99999", None, "allow"),
    ]
    assert urls.judge(df.limit(0), urls.listed_urls(spark)).count() == 0
    assert urls.judge(df, urls.listed_urls(spark).limit(0)).where("listed").count() == 0


def test_the_join_removes_what_a_poor_filter_lets_pass(spark, monkeypatch):
    pages = spark.range(4000).selectExpr("id as page_id", "concat('http://spam-farm.example.org/es/', id) as url", "'' as html")
    want = {r.page_id: (r.verdict, r.possible) for r in urls.judge(pages, urls.listed_urls(spark)).collect()}
    assert {i for i, (v, _) in want.items() if v == "block"} == {i for i in range(4000) if i % 4}
    assert sum(p for _, p in want.values()) < 3000 + 20
    monkeypatch.setattr(bloom, "MAX_FILTER_BYTES", 64)
    monkeypatch.setattr(common, "MAX_BROADCAST_ROWS", 1)
    poor = {r.page_id: (r.verdict, r.possible) for r in urls.judge(pages, urls.listed_urls(spark)).collect()}
    assert {i: v for i, (v, _) in poor.items()} == {i: v for i, (v, _) in want.items()}
    assert all(p for _, p in poor.values())


def test_bloom_lets_every_key_pass_and_few_others(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("h"))
    bits = bloom.build(keys)
    assert bloom.possible(keys, bits).count() == 5000
    assert bloom.possible(spark.range(5000, 25_000).select(F.xxhash64("id").alias("h")), bits).count() < 400


@pytest.mark.parametrize(("name", "module"), [("OP4_SQL", quality), ("OP9_SQL", mixing), ("OP10_SQL", urls)])
def test_against_sql(spark, sf_dir, name, module):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    query = {"OP4_SQL": quality.op4_host_rules, "OP9_SQL": mixing.op9_mix_sources, "OP10_SQL": urls.op10_url_rules}[name]
    df, rel = query(spark, sf_dir), con.sql(getattr(module, name))
    assert as_set(df.select(*rel.columns).collect()) == as_set(rel.fetchall())


def test_long_lists_of_bad_hosts_are_salted(spark, monkeypatch):
    words = " ".join(f"w{i}" for i in range(80))
    rows = [(i, words if i % 20 == 0 else "x", "en", f"bad{i % 3}" if i % 7 else None, 1) for i in range(600)] + [(1000 + i, words, "en", f"h{i % 9}", 1) for i in range(200)]
    df = documents(spark, rows)
    want = as_set(quality.judge(df).collect())
    mixed = as_set(mixing.copies(df).collect())
    monkeypatch.setattr(common, "MAX_BROADCAST_ROWS", 1)
    assert as_set(mixing.copies(df).collect()) == mixed
    assert as_set(quality.judge(df).collect()) == want
    assert {r.doc_id for r in quality.reject(df).collect()} == set(range(1000, 1200))
