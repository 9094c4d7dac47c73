"""Similarity join on word shingles: size-aware, small sets by subsets, large sets by inverted lists.

Two sets of sizes s <= t are linked when ``den * overlap >= num * union``, that is when
they share c(s, t) = ceil(num (s + t) / (num + den)) shingles (after Deng, Tao and Li, 2018).

1. Each text becomes its set of 63-bit shingle hashes; equal sets are one class.
2. Small sets (size up to a boundary) list, for each partner size t, every subset of c(s, t)
   members as one hash; sets with a subset in common are linked.
3. Large sets use inverted lists. A set that may leave out s - ceil(num s / den) members
   must show one of its first s - ceil(num s / den) + 1 in any fixed order, so only these
   are listed. The order is: members of a fixed random slice of all shingles by rising
   document frequency, then the others; so only the slice is counted, and what many
   documents share comes last. A set whose listed members are its own alone has no partner.
4. The boundary minimises the summed cost of both ways over the sizes that occur.
5. Neighbours by size in a list are candidates (every linked pair of a list is joined by
   them); candidates fall into clusters, and each cluster, cut in blocks of BLOCK sets by
   size, is scanned exactly: the lists of a block count every overlap, and a block gives
   back one row per set: its number of links and the smallest set it is joined to.
6. Components of these rows are the answer.

No pair list leaves a task, lists and clusters are cut by position in one global order, so
none is held in one place, and a block is the largest thing in memory besides one text.

Defined results: null, empty and blank texts have no shingle, component_id = doc_id and no
links; texts below ``words`` words have one shingle, the whole sequence; doc_id names a
document: repeated rows of an id are the same node; rows of null doc_id are in no class and
have null component_id; an empty table gives no rows; extra columns are ignored. ``keep_one``
keeps the columns of its input; of rows that repeat id and text one stays, and another text of
an id is judged on its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from .common import files_for, map_arrow, materialise, own_columns, positions, remove, scratch, table
from .components import components

#: Sets above this size always go to the inverted lists; below, the cost decides. Subsets of a set grow beyond all lists
#: (85 percent: 137 at size 15, 1,562 at 20, 36,487 at 30, 5.4 million at 40, against 3, 4, 5 and 7 listed members).
SMALL_MAX = 20
#: Sets in one block of a cluster.
BLOCK = 512
#: Share of all shingles whose frequency is counted, in units of the listed share of a set.
SLICE = 1.5
#: Cost of one exact comparison in units of one posting.
CHECK = 4.0
WINDOW = 2 << 20

_RADIX, _STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_INVERSE = pow(_RADIX, -1, 1 << 64)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def need(s: int, t: int, num: int, den: int) -> int:
    """Least overlap that links sets of sizes s and t."""
    return -(-num * (s + t) // (num + den))


def listed(n: int, num: int, den: int) -> int:
    """Members of a set of size n that must be listed."""
    return n - -(-num * n // den) + 1


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Shingler:
    """Sets of shingle hashes of Arrow strings; vectorised over about WINDOW bytes."""

    def __init__(self, words: int):
        self.words = words
        self.up = self.down = np.zeros(0, np.uint64)

    def sets(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Sorted distinct 63-bit hashes (uint64) of each text; null counts as empty."""
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        low = 0
        while low < len(texts):
            high = max(low + 1, int(np.searchsorted(sizes, (sizes[low - 1] if low else 0) + WINDOW, "right")))
            yield from self._slice(texts.slice(low, high - low))
            low = high

    def _slice(self, texts: pa.Array) -> Iterator[np.ndarray]:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        _, offsets, values = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(values, np.uint8)[offsets[0] : offsets[-1]] if values else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        solid = ~_BLANK[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        begin, end = solid.copy(), solid.copy()
        begin[1:] &= ~solid[:-1] | edge[1:-1]
        end[:-1] &= ~solid[1:] | edge[1:-1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        hashes = self._words(data, starts, ends)
        bounds = np.searchsorted(starts, offsets)
        k = self.words
        grams = hashes[: max(0, len(hashes) - k + 1)].copy()
        for j in range(1, k):
            grams = grams * np.uint64(_STEP) + hashes[j : j + len(grams)]
        grams = mix(grams) >> np.uint64(1)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= k:
                yield np.unique(grams[a : b - k + 1])
            elif b > a:
                whole = np.uint64(b - a)
                with np.errstate(over="ignore"):
                    for w in hashes[a:b]:
                        whole = whole * np.uint64(_STEP) + w
                yield mix(np.array([whole ^ np.uint64(_RADIX)])) >> np.uint64(1)
            else:
                yield np.zeros(0, np.uint64)

    def _words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of each word, in windows of whole words."""
        out, at = np.zeros(len(starts), np.uint64), 0
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + WINDOW, "right")))
            low, high = int(starts[at]), int(ends[to - 1])
            n = high - low
            if n >= len(self.up):
                self.up, self.down = _powers(_RADIX, n + 1), _powers(_INVERSE, n + 1)
            run = np.zeros(n + 1, np.uint64)
            np.add(_LOWER[data[low:high]], 1, out=run[1:], dtype=np.uint64, casting="unsafe")
            run[1:] *= self.up[:n]
            np.cumsum(run, out=run)
            a = starts[at:to] - low
            out[at:to] = mix((run[ends[at:to] - low] - run[a]) * self.down[a])
            at = to
        return out


def key_of(found: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    with np.errstate(over="ignore"):
        a = np.add.reduce(mix(found)) if len(found) else np.uint64(0)
        b = np.add.reduce(mix(found ^ np.uint64(_STEP))) if len(found) else np.uint64(0)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def slice_limit(num: int, den: int) -> int:
    """Hashes below this are in the counted slice."""
    return int(min(1.0, SLICE * (1 - num / den)) * (1 << 63))


SETS = "doc_id long, t long, n int, h1 long, h2 long, nu int, e array<long>, whole array<long>"
#: Classes with more than this share of all rows, and so fewer than its inverse, are joined back by broadcast.
LARGE_CLASS = 1 / 2000


def shingle_sets(documents: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """One row a document: hash of its text, size, key, number of members in the slice, the members that may be listed, all members of small sets."""
    schema = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("n", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("nu", pa.int32()), ("e", pa.list_(pa.int64())), ("whole", pa.list_(pa.int64()))])
    limit = np.uint64(slice_limit(num, den))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            found = shingler.sets(batch.column(1))
            for low in range(0, batch.num_rows, 512):
                ids = batch.column(0).slice(low, 512)
                n, keys, nu, first, whole = [], [], [], [], []
                for _ in range(len(ids)):
                    own = next(found)
                    n.append(len(own))
                    keys.append(key_of(own))
                    inside = int(np.searchsorted(own, limit))
                    nu.append(inside)
                    first.append(own[: max(inside, listed(len(own), num, den))].astype(np.int64) if len(own) else own.astype(np.int64))
                    whole.append(own.astype(np.int64) if 0 < len(own) <= SMALL_MAX else None)
                yield pa.record_batch(
                    [ids.cast(pa.int64()), batch.column(2).slice(low, 512), pa.array(n, pa.int32()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(nu, pa.int32()), pa.array(first, pa.list_(pa.int64())), pa.array(whole, pa.list_(pa.int64()))],
                    schema=schema,
                )

    return map_arrow(documents.select("doc_id", "text", text_hash(F.col("text")).alias("t")), run, SETS)


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def subsets(s: int, top: int, num: int, den: int) -> int:
    """Subset hashes that a set of size s lists among sets up to size ``top``."""
    partners = [(min(s, t), max(s, t)) for t in range(1, top + 1) if den * min(s, t) >= num * max(s, t)]
    return sum(math.comb(s, s - need(a, b, num, den)) for a, b in partners)


def boundary(sizes: dict[int, int], mean_list: float, num: int, den: int) -> int:
    """The size up to which subsets are cheaper: least total cost over the sizes that occur (0: lists for all)."""

    def cost(top: int) -> float:
        small = sum(c * subsets(s, top, num, den) for s, c in sizes.items() if s <= top)
        return small + sum(c * listed(s, num, den) * (1 + CHECK * mean_list) for s, c in sizes.items() if s > top)

    return min(range(SMALL_MAX + 1), key=lambda top: (cost(top), top))


def small_edges(classes: DataFrame, top: int, num: int, den: int) -> DataFrame:
    """(a, b): each small set with the smallest set that has a subset in common."""
    schema = pa.schema([("key", pa.int64()), ("side", pa.int32()), ("rep", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sides, reps = [], [], []
            for rep, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = len(members)
                one = mix(np.array(members, np.uint64))
                with np.errstate(over="ignore"):
                    total = np.add.reduce(one)
                    for t in range(1, top + 1):
                        a, b = min(s, t), max(s, t)
                        if den * a < num * b:
                            continue
                        left_out = s - need(a, b, num, den)
                        out = np.array(list(combinations(range(s), left_out)), np.int64).reshape(math.comb(s, left_out), left_out)
                        left = total - one[out].sum(axis=1, dtype=np.uint64)
                        keys.append(mix(left + np.uint64(a * 1000 + b) * np.uint64(_STEP)).astype(np.int64))
                        sides += [0 if s == t else 1 if s == a else 2] * len(left)
                        reps += [rep] * len(left)
            if keys:
                yield pa.record_batch([pa.array(np.concatenate(keys)), pa.array(sides, pa.int32()), pa.array(reps, pa.int64())], schema=schema)

    keyed = map_arrow(classes.where(F.col("n") <= top).select("rep", "whole"), run, "key long, side int, rep long")
    groups = keyed.groupBy("key").agg(F.min("rep").alias("b"), F.count(F.lit(1)).alias("c"), F.min("side").alias("low"), F.max("side").alias("high"))
    joined = groups.where("c > 1 and (high = 0 or low <> high)").select("key", "b")
    return keyed.select("key", F.col("rep").alias("a")).join(joined, "key").where("a <> b").select("a", "b").distinct()


def large_edges(classes: DataFrame, top: int, num: int, den: int) -> DataFrame:
    """(a, b): neighbours by size in the inverted lists of sets that a set above ``top`` may be linked to."""
    low = -(-num * (top + 1) // den)
    sets = classes.where(F.col("n") >= low)
    postings = sets.select("rep", F.explode("e").alias("e"))
    counts = postings.groupBy("e").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = materialise(postings.join(counts, "e"), "shared")
    inside = F.col("e") < F.lit(slice_limit(num, den))
    own = shared.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct((~inside).alias("out"), F.when(inside, F.col("df")).otherwise(0).alias("df"), F.col("e").alias("e")))).alias("s"), F.sum(inside.cast("int")).alias("in_slice"))
    must = F.col("n") - F.expr(f"({num}L * n + {den - 1}) div {den}") + 1
    first = own.join(classes.select("rep", "n", "nu"), "rep").withColumn("take", (must - F.col("nu") + F.col("in_slice")).cast("int")).where("take > 0")
    lists = first.select("rep", "n", F.explode(F.slice("s", F.lit(1), F.col("take"))).alias("s")).select("rep", "n", "s.e")
    # Neighbours are rows one place apart, so that a long list is no single group.
    placed = positions(lists, ["e", "n", "rep"], "lists")
    near = placed.select(F.col("rep").alias("a"), "n", "e", "pos").join(placed.select(F.col("rep").alias("b"), F.col("n").alias("m"), F.col("e").alias("f"), (F.col("pos") + 1).alias("pos")), "pos")
    return near.where(f"e = f and {den}L * m >= {num}L * n and a <> b").select("a", "b").distinct()


def scan(rows: list[tuple], num: int, den: int) -> Iterator[tuple[int, int, int]]:
    """(set, smallest set joined to it here, links) of one block task; rows: (side, rep, copies, set).

    With one side every pair counts, with two the pairs across. Lists of the rows' shingles
    are scanned set by set; overlaps are whole numbers, so the test is exact.
    """
    rows.sort(key=lambda r: (r[0], r[1]))
    sizes = np.array([len(r[3]) for r in rows], np.int64)
    doc = np.repeat(np.arange(len(rows)), sizes)
    members = np.concatenate([r[3] for r in rows])
    order = np.argsort(members, kind="stable")
    new = np.ones(len(members), bool)
    new[1:] = members[order][1:] != members[order][:-1]
    name = np.zeros(len(members), np.int64)
    name[order] = np.cumsum(new) - 1
    starts = np.append(np.flatnonzero(new), len(members))
    lists = doc[order]
    side, copies, rep = np.array([r[0] for r in rows]), np.array([r[2] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
    two = side[0] != side[-1]
    parent, links = list(range(len(rows))), np.zeros(len(rows), np.int64)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    at = 0
    for d in range(len(rows)):
        own = name[at : at + sizes[d]]
        at += int(sizes[d])
        if two and side[d]:
            break
        length = starts[own + 1] - starts[own]
        own, length = own[length > 1], length[length > 1]
        if not len(own):
            continue
        where = np.repeat(starts[own] - (np.cumsum(length) - length), length)
        where += np.arange(len(where))
        overlap = np.bincount(lists[where], minlength=len(rows))
        hit = den * overlap >= num * (sizes[d] + sizes - overlap)
        hit[: d + 1] = False
        if two:
            hit &= side == 1
        for x in np.flatnonzero(hit).tolist():
            links[d] += copies[x]
            links[x] += copies[d]
            a, b = root(d), root(x)
            if a != b:
                if (rep[a], a) > (rep[b], b):
                    a, b = b, a
                parent[b] = a
    for d in np.flatnonzero(links).tolist():
        yield int(rep[d]), int(rep[root(d)]), int(links[d])


def verify(documents: DataFrame, members: DataFrame, words: int, num: int, den: int, files: int) -> DataFrame:
    """(a, b, links) of every block task; members: (rep, h1, h2, copies, n, cluster)."""
    ordered = positions(members, ["cluster", "n", "rep", "h1"], "clusters", files=files)
    starts = ordered.groupBy("cluster").agg(F.min("pos").alias("start"))
    placed = materialise(ordered.join(starts, "cluster").withColumn("block", F.expr(f"cast((pos - start) div {BLOCK} as int)")).drop("pos", "start").repartition(files), "members")
    blocks = placed.groupBy("cluster", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    left, right = blocks.select("cluster", F.col("block").alias("i"), "hi"), blocks.select("cluster", F.col("block").alias("j"), "lo")
    # Blocks are in order of size, so a later block is too large altogether when its smallest set is.
    tasks = left.join(right, "cluster").where(f"i <= j and {den}L * hi >= {num}L * lo").select("cluster", "i", "j")
    sides = tasks.select("cluster", "i", "j", F.explode(F.when(F.col("i") == F.col("j"), F.array(F.struct(F.lit(0).alias("side"), F.col("i").alias("block")))).otherwise(F.array(F.struct(F.lit(0).alias("side"), F.col("i").alias("block")), F.struct(F.lit(1).alias("side"), F.col("j").alias("block"))))).alias("s")).select("cluster", "i", "j", "s.side", "s.block")
    # Few texts are in a cluster: a bounded filter keeps the others out of the shuffle, the join is exact.
    bits = bloom.build(placed.select(F.xxhash64("rep").alias("h")))
    near = bloom.possible(documents.select(F.xxhash64(F.col("doc_id").cast("long")).alias("h"), F.col("doc_id").cast("long").alias("rep"), "text"), bits)
    texts = near.drop("h").join(placed, "rep")
    work = texts.join(sides, ["cluster", "block"]).select("cluster", "i", "j", "side", "rep", "h1", "h2", "copies", "text")
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    work = work.repartition(parts, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        task, rows, seen, out = None, [], set(), []
        for batch in batches:
            cluster, i, j, side, rep, h1, h2, copies = (batch.column(c).to_pylist() for c in range(8))
            for k, own in enumerate(shingler.sets(batch.column(8))):
                if task != (cluster[k], i[k], j[k]):
                    if len(rows) > 1:
                        out += scan(rows, num, den)
                    task, rows, seen = (cluster[k], i[k], j[k]), [], set()
                name = (side[k], rep[k], h1[k], h2[k])
                if name not in seen and key_of(own) == name[2:]:  # else a repeated row, or another text of the id
                    seen.add(name)
                    rows.append((side[k], rep[k], copies[k], own))
            if out:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)
                out = []
        if len(rows) > 1:
            out = list(scan(rows, num, den))
        if out:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)

    return map_arrow(work, run, "a long, b long, links long")


def grouped(documents: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """doc_id, t (hash of the text), n_shingles, component_id, n_links: one row for each row of ``documents``."""
    spark, path = documents.sparkSession, scratch(documents.sparkSession, "sets")
    files = files_for(documents)  # tables of a few numbers a document are gathered, whatever the number of tasks that make them
    wide = materialise(shingle_sets(documents, words, num, den), "sets", path)
    sets = materialise(wide.select("doc_id", "t", "n", "h1", "h2"), "keys")
    first = [F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("nu", "e", "whole")]]
    classes = materialise(wide.where("n > 0 and doc_id is not null").groupBy("n", "h1", "h2").agg(*first), "classes")
    remove(spark, path)  # members are held once a class from here on

    tiny = classes.where(F.col("n") <= SMALL_MAX)
    sizes = {r["n"]: r["c"] for r in tiny.groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}  # SMALL_MAX rows at most
    lists = tiny.select(F.explode("e").alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("c")).agg(F.sum(F.col("c") * F.col("c")).alias("q"), F.sum("c").alias("s")).first()
    top = boundary(sizes, (lists["q"] / lists["s"] - 1) if lists["s"] else 0.0, num, den)

    edges = large_edges(classes, top, num, den)
    if top:
        edges = edges.unionByName(small_edges(classes, top, num, den))
    clusters = components(edges, files)
    roots = clusters.select(F.col("component").alias("node")).distinct().withColumn("component", F.col("node"))
    clusters = clusters.unionByName(roots).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    keys = classes.select("n", "h1", "h2", "rep", "copies")
    found = materialise(verify(documents, keys.join(clusters, "rep"), words, num, den, files).repartition(files), "links")

    joined = components(found.select("a", "b"), files).select(F.col("node").alias("rep"), "component")
    links = found.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "rep")
    verdicts = keys.join(joined, "rep", "left").join(links, "rep", "left").select("n", "h1", "h2", "copies", F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    # Rows without a set need no join; the few classes that hold a large share of the rows are broadcast, so no key is hot.
    key, alone = ["n", "h1", "h2"], (F.col("n") == 0) | F.col("doc_id").isNull()
    large = F.broadcast(materialise(verdicts.where(F.col("copies") > LARGE_CLASS * sets.count()).repartition(1), "large"))
    named = sets.where(~alone)
    hot = named.join(large, key)
    others = named.join(large.select(*key), key, "left_anti").join(verdicts, key, "left")
    lone = sets.where(alone).select("*", F.col("doc_id").alias("component"), F.lit(0).alias("links"))
    out = [d.select("doc_id", "t", F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"), F.col("links").cast("long").alias("n_links")) for d in (hot, others, lone)]
    return out[0].unionByName(out[1]).unionByName(out[2])


def similar(documents: DataFrame, words: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links: one row for each row of ``documents``."""
    return grouped(documents, words, num, den).drop("t")


def keep_one(documents: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``documents`` with one row of each group: that of the smallest doc_id; texts without words and rows without id all stay."""
    groups = grouped(documents, words, num, den)
    dropped = groups.where("component_id <> doc_id").select(F.col("doc_id").alias("drop_id"), F.col("t").alias("drop_t")).distinct()
    rows = own_columns(documents).select("row", F.col("row.doc_id").cast("long").alias("id"), text_hash(F.col("row.text")).alias("t"))
    named = rows.where("id is not null").join(dropped, (F.col("id") == F.col("drop_id")) & (F.col("t") == F.col("drop_t")), "left_anti").dropDuplicates(["id", "t"])
    return named.select("row.*").unionByName(documents.where("doc_id is null"))


def op2_similar_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents"), 4, 85, 100).select("doc_id", "n_shingles", "component_id", "n_links")
