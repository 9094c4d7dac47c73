"""Packing by concatenation: prefix sums give global offsets, fixed windows cut the line.

Pass one encodes each partition and writes ids with their place in the partition; pass two
adds the partition's base (prefix sums over one total a partition) and cuts the ids at
multiples of the window. Every sequence but the last is full, so padding is below one
window for the whole corpus. Nothing but totals is shuffled, and a long document is cut
into as many pieces as it has windows.

A row of the token table is named by (part, place), which no two rows share, so repeated
and null ids are rows of their own in pieces and sequences.

Defined results: null text has the end id only; null doc_id and repeated rows are packed
like others; very long texts span many sequences; an empty table gives no pieces; extra
columns are ignored. The order of documents is that of the input's partitions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialise, table
from .tokens import encoder

LENGTH = 2048
BATCH_DOCS = 1024
TOKENS = "part int, doc_id long, place long, n_tokens long, ids binary"
COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
PIECES = ", ".join(f"{c} long" for c in (*COLUMNS, "part", "place"))


def tokenise(documents: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(part, doc_id, place, n_tokens, ids): ids with the end id, as little-endian unsigned 32 bits; place: ids before it in the partition."""
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("place", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, own, at = TaskContext.get().partitionId(), encoder(tokenizer), 0
        for batch in batches:
            got = own.encode(batch.column(1))
            for low in range(0, batch.num_rows, BATCH_DOCS):
                doc = batch.column(0).slice(low, BATCH_DOCS)
                ids = [np.append(next(got), np.uint32(end_id)).astype("<u4") for _ in range(len(doc))]
                n = np.fromiter(map(len, ids), np.int64, len(ids))
                ends = at + np.cumsum(n)
                yield pa.record_batch([pa.array([part] * len(doc), pa.int32()), doc.cast(pa.int64()), pa.array(ends - n), pa.array(n), pa.array([i.tobytes() for i in ids], pa.binary())], schema=schema)
                at = int(ends[-1])

    return map_arrow(documents.select("doc_id", "text"), run, TOKENS)


def cut(tokens: DataFrame, length: int = LENGTH) -> DataFrame:
    """Pieces of tokenised documents (as ``tokenise`` wrote them): the boundary records of sequences of ``length`` ids, with (part, place) of their token row."""
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    bases = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    # One row a partition of the input: small however large the corpus.
    placed = tokens.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("place")).alias("at"), "n_tokens", "ids", F.col("part").cast("long").alias("part"), "place")
    schema = pa.schema([(c, pa.int64()) for c in (*COLUMNS, "part", "place")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            first = at // length
            pieces = (at + n - 1) // length - first + 1
            row = np.repeat(np.arange(len(at)), pieces)
            sequence = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            begin = np.maximum(sequence * length, at[row])
            end = np.minimum((sequence + 1) * length, at[row] + n[row])
            start = begin - at[row]
            ids, crcs = [memoryview(x.as_buffer()) for x in batch.column(3)], []
            for r, a, b in zip(row.tolist(), (4 * start).tolist(), (4 * (end - at[row])).tolist(), strict=True):
                crcs.append(zlib.crc32(ids[r][a:b]))
            own = pa.array(row)
            yield pa.record_batch([batch.column(0).take(own), pa.array(start), pa.array(end - begin), pa.array(crcs, pa.int64()), pa.array(n[row]), pa.array(sequence), pa.array(begin - sequence * length), batch.column(4).take(own), batch.column(5).take(own)], schema=schema)

    return map_arrow(placed, run, PIECES)


def pack(documents: DataFrame, tokenizer: str, end_id: int = 1, length: int = LENGTH) -> DataFrame:
    return cut(materialise(tokenise(documents, tokenizer, end_id), "tokens"), length).select(*COLUMNS)


def sequences(tokens: DataFrame, pieces: DataFrame, pad_id: int, length: int = LENGTH) -> DataFrame:
    """(sequence_id, n, ids): the packed sequences of ``cut``, each padded to ``length`` unless its own length is a power of two."""
    own = tokens.select(F.col("part").cast("long").alias("part"), "place", F.hex("ids").alias("h"))
    parts = pieces.join(own, ["part", "place"])
    parts = parts.select("sequence_id", "offset", "length", F.expr("substring(h, cast(8 * start as int) + 1, cast(8 * length as int))").alias("h"))
    whole = parts.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "h"))), lambda x: x["h"]), "").alias("h"))
    power = F.col("n").bitwiseAND(F.col("n") - 1) == 0
    one = int(pad_id).to_bytes(4, "little").hex().upper()
    padded = F.when(power, F.col("h")).otherwise(F.concat("h", F.expr(f"repeat('{one}', cast({length} - n as int))")))
    return whole.select("sequence_id", "n", F.unhex(padded).alias("ids"))


def op8_concat_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1)
