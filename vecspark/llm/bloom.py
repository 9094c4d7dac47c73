"""Blocked Bloom filters: built per partition, OR-ed, and held by every task.

One 512-bit block a key, BITS_SET bits in it. The size is bounded by MAX_FILTER_BYTES: a
filter of more keys than that serves lets more pass, so callers always join exactly after.

Null keys are in no filter, repeated keys set the same bits, and a filter without keys lets
nothing pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .common import map_arrow

BLOCK_WORDS = 8
BITS_SET = 8
BITS_PER_KEY = 16
MAX_FILTER_BYTES = 64 << 20


def positions(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each hash, and the mask of its words: (n,), (n, BLOCK_WORDS)."""
    h = hashes.view(np.uint64)
    block = ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    low = h & np.uint64(0xFFFFFFFF)
    step = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40) | np.uint64(1)
    masks = np.zeros((len(h), BLOCK_WORDS), np.uint64)
    rows = np.arange(len(h))
    for k in range(BITS_SET):
        bit = (low + np.uint64(k) * step) % np.uint64(64 * BLOCK_WORDS)
        masks[rows, (bit >> np.uint64(6)).astype(np.int64)] |= np.uint64(1) << (bit & np.uint64(63))
    return block.astype(np.int64), masks


def build(keys: DataFrame) -> np.ndarray:
    """Filter of column ``h`` (64-bit hashes): (blocks, BLOCK_WORDS) of bits, MAX_FILTER_BYTES at most."""
    wanted = max(1, -(-keys.count() * BITS_PER_KEY // (64 * BLOCK_WORDS)))
    blocks = min(wanted, MAX_FILTER_BYTES // (8 * BLOCK_WORDS))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros((blocks, BLOCK_WORDS), np.uint64)
        for batch in batches:
            block, masks = positions(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), blocks)
            np.bitwise_or.at(bits, block, masks)
        used = np.flatnonzero(bits.any(axis=1))
        if len(used):
            yield pa.record_batch([pa.array(used), *[pa.array(bits[used, w].view(np.int64)) for w in range(BLOCK_WORDS)]], names=["block", *[f"w{w}" for w in range(BLOCK_WORDS)]])

    schema = "block long, " + ", ".join(f"w{w} long" for w in range(BLOCK_WORDS))
    hashed = map_arrow(keys.select("h"), fill, schema)
    merged = hashed.groupBy("block").agg(*[F.bit_or(f"w{w}").alias(f"w{w}") for w in range(BLOCK_WORDS)])
    got = merged.toArrow()  # at most MAX_FILTER_BYTES, whatever the number of keys
    bits = np.zeros((blocks, BLOCK_WORDS), np.uint64)
    if got.num_rows:
        at = got.column("block").to_numpy()
        for w in range(BLOCK_WORDS):
            bits[at, w] = got.column(f"w{w}").to_numpy().view(np.uint64)
    return bits


def marked(rows: DataFrame, bits: np.ndarray, out: str) -> DataFrame:
    """``rows`` (h long, ...) with ``out``: whether the key may be in the filter; false for a null key."""
    held = rows.sparkSession.sparkContext.broadcast(bits)
    at = rows.columns.index("h")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = held.value
        for batch in batches:
            keys = batch.column(at)
            block, masks = positions(pc.fill_null(keys, 0).to_numpy(zero_copy_only=False).astype(np.int64), len(table_))
            hit = ((table_[block] & masks) == masks).all(axis=1) & np.asarray(keys.is_valid())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hit)], names=[*batch.schema.names, out])

    return map_arrow(rows, probe, StructType([*rows.schema.fields, StructField(out, BooleanType())]))


def possible(rows: DataFrame, bits: np.ndarray) -> DataFrame:
    """``rows`` (h long, ...) whose key may be in the filter."""
    return marked(rows, bits, "__hit").where("__hit").drop("__hit")
