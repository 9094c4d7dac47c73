import random
import re
from collections import defaultdict

import pytest

from vecspark.llm import jaccard as J
from vecspark.llm.components import components

from .helpers import as_set, clashing, documents, empty

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset() if not w else frozenset([tuple(w)]) if len(w) < k else frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute(rows, k, num, den):
    """(doc_id, size, component, links) by comparing all pairs of texts."""
    sets = [(r[0], shingles(r[1], k)) for r in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = defaultdict(int)
    for a, (i, s) in enumerate(sets):
        for b, (j, t) in enumerate(sets):
            if a != b and i is not None and j is not None and s and t:
                n = len(s & t)
                if den * n >= num * (len(s) + len(t) - n):
                    links[a] += 1
                    x, y = root(i), root(j)
                    parent[max(x, y)] = min(x, y)
    return [(i, len(s), None if i is None else root(i) if s else i, links[a]) for a, (i, s) in enumerate(sets)]


@pytest.mark.parametrize(("k", "num"), [(4, 85), (5, 80)])
def test_odd_rows(spark, k, num):
    df = documents(spark)
    want = as_set(brute([tuple(r) for r in df.collect()], k, num, 100))
    assert as_set(J.similar(df, k, num, 100).collect()) == want
    assert as_set(J.similar(clashing(df), k, num, 100).collect()) == want
    assert J.similar(empty(spark), k, num, 100).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_random_sets_of_all_sizes(spark, seed, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 16)
    rng = random.Random(seed)
    rows = []
    for base in range(14):
        words = [f"{base}_{i}" for i in range(rng.choice([3, 5, 7, 8, 9, 12, 15, 18, 24, 40, 90]))]
        for _ in range(rng.choice([1, 2, 5, 25])):
            w = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                at = rng.randrange(len(w))
                w[at : at + rng.choice([0, 1])] = [f"n{rng.randrange(5)}"]
            rows.append((len(rows), " ".join(w + ["shared line of words in every text"] * (base % 3)), "en", "s", 1))
    df = documents(spark, rows)
    for k, num in ((4, 85), (3, 60)):
        assert as_set(J.similar(df, k, num, 100).collect()) == as_set(brute(rows, k, num, 100))


def test_boundary_is_chosen_by_cost():
    sizes = dict.fromkeys(range(1, 21), 100)
    assert J.boundary(sizes, 0.0, 85, 100) <= J.boundary(sizes, 50.0, 85, 100)
    assert J.boundary(sizes, 50.0, 85, 100) > 5
    assert J.boundary({}, 0.0, 85, 100) == 0
    for s in range(1, 40):
        for t in range(s, 48):
            c = J.need(s, t, 85, 100)
            assert 100 * c >= 85 * (s + t - c)
            assert 100 * (c - 1) < 85 * (s + t - c + 1)


def test_keep_one(spark):
    df = documents(spark)
    kept = J.keep_one(clashing(df)).collect()
    groups = {i: c for i, _, c, _ in brute([tuple(r) for r in df.collect()], 5, 80, 100) if i is not None}
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(set(groups.values()))
    assert sum(r.doc_id is None for r in kept) == 1
    assert J.keep_one(df).columns == df.columns


def test_keep_one_keeps_other_texts_of_an_id(spark, monkeypatch):
    a, b, c = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    rows = [(5, a, "en", "s", 1), (5, a, "en", "s", 1), (5, b, "en", "s", 1), (3, b, "en", "s", 1), (7, c, "en", "s", 1), (7, "", "en", "s", 1), (8, None, "en", "s", 1), *[(100 + i, c, "en", "s", 1) for i in range(50)]]
    df = documents(spark, rows)
    want = sorted([(5, a), (3, b), (7, c), (7, ""), (8, None)], key=repr)
    for large in (J.LARGE_CLASS, 2.0):
        monkeypatch.setattr(J, "LARGE_CLASS", large)
        assert sorted([(r.doc_id, r.text) for r in J.keep_one(df).collect()], key=repr) == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 61), 0), **dict.fromkeys(range(101, 140), 100), 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_narrow_tables_leave_few_files(spark, tmp_path, monkeypatch):
    documents(spark).coalesce(1).write.parquet(str(tmp_path / "documents"))
    df, made, write = spark.read.parquet(str(tmp_path / "documents")), [], J.materialise
    want = as_set(J.similar(df).collect())

    def counted(table, name, path=None):
        out = write(table, name, path)
        made.append((name, len(out.inputFiles())))
        return out

    for module in ("common", "components", "jaccard"):
        monkeypatch.setattr(f"vecspark.llm.{module}.materialise", counted)
    monkeypatch.setattr("vecspark.session.materialise", counted)
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        assert as_set(J.similar(df).collect()) == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    narrow = [m for m in made if m[0] in ("edges", "clusters", "members", "links", "large")]
    assert {n for n, _ in narrow} == {"edges", "clusters", "members", "links", "large"}
    assert max(n for _, n in narrow) <= spark.sparkContext.defaultParallelism, narrow
