"""Flat token files: unsigned ids, 64-bit document offsets, partition bases by prefix sums.

Documents are range-partitioned and sorted by doc_id. Each partition writes three files:
``ids`` (little-endian unsigned, 16 bits where the vocabulary allows it, else 32), ``offsets``
(n + 1 signed 64-bit positions in the partition) and ``docs`` (64-bit doc_ids). A partition
hands back one manifest row; the bases of all partitions are prefix sums over these rows,
so no pass over the ids is needed. Files carry the attempt in their names and only those
that the manifest names count, so a task that is run again leaves no trace in the result.

Readers map the files; a document is one slice.

Defined results: null text has no ids but the end id; null doc_id sorts first and is kept
as the lowest 64-bit number in ``docs``; repeated rows come one after another; an empty
table gives an empty manifest; extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store
from .common import map_arrow, materialise, scratch, table
from .tokens import encoder

NO_ID = np.iinfo(np.int64).min
MANIFEST = "part int, ids string, offsets string, docs string, width int, n_docs long, n_tokens long"
READ_DOCS = 4096


def id_width(vocabulary: int) -> int:
    return 2 if vocabulary <= 1 << 16 else 4


def write(documents: DataFrame, path: str, tokenizer: str, end_id: int, width: int) -> DataFrame:
    """Write the files under ``path``; the manifest, with ``base``: ids of all earlier partitions."""
    spark = documents.sparkSession
    store.make_dir(path)
    schema = pa.schema([("part", pa.int32()), ("ids", pa.string()), ("offsets", pa.string()), ("docs", pa.string()), ("width", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        stem = f"{path}/part-{part:06d}-{uuid.uuid4().hex}"
        kind = f"<u{width}"
        own, n_docs, at = encoder(tokenizer), 0, 0
        with store.open_write(f"{stem}.ids") as ids, store.open_write(f"{stem}.offsets") as offsets, store.open_write(f"{stem}.docs") as docs:
            offsets.write(np.zeros(1, "<i8").tobytes())
            for batch in batches:
                ends = []
                for got in own.encode(batch.column(1)):
                    ids.write(np.append(got, np.uint32(end_id)).astype(kind).tobytes())
                    at += len(got) + 1
                    ends.append(at)
                offsets.write(np.array(ends, "<i8").tobytes())
                docs.write(batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                n_docs += len(ends)
        if n_docs:
            yield pa.RecordBatch.from_pylist([{"part": part, "ids": f"{stem}.ids", "offsets": f"{stem}.offsets", "docs": f"{stem}.docs", "width": width, "n_docs": n_docs, "n_tokens": at}], schema=schema)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64("text")
    ordered = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)
    manifest = materialise(map_arrow(ordered, run, MANIFEST), "manifest")
    # One row a partition: the prefix sum runs over a few thousand rows, however large the corpus.
    return manifest.withColumn("base", F.sum("n_tokens").over(Window.orderBy("part")) - F.col("n_tokens"))


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files that the manifest names; crc over ids as unsigned 32 bits."""
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n, width = row["n_docs"], row["width"]
                with store.mapped(row["ids"]) as ids, store.mapped(row["offsets"]) as offsets, store.mapped(row["docs"]) as docs:
                    for low in range(0, n, READ_DOCS):
                        high = min(n, low + READ_DOCS)
                        offsets.seek(8 * low)
                        at = np.frombuffer(offsets.read(8 * (high - low + 1)), "<i8")
                        docs.seek(8 * low)
                        doc = np.frombuffer(docs.read(8 * (high - low)), "<i8")
                        crcs = []
                        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                            ids.seek(width * a)
                            crcs.append(zlib.crc32(np.frombuffer(ids.read(width * (b - a)), f"<u{width}").astype("<u4").tobytes()))
                        yield pa.record_batch([pa.array(doc, mask=doc == NO_ID), pa.array(row["base"] + at[:-1]), pa.array(np.diff(at)), pa.array(crcs, pa.int64())], schema=schema)

    spread = manifest.select("ids", "offsets", "docs", "width", "n_docs", "base", "part").repartition(parts, "part")
    return map_arrow(spread, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_flat_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = write(table(spark, sf_dir, "documents"), scratch(spark, "flat"), public_tokenizers.path("byte_bpe_50k.json"), 0, id_width(50_257))
    return read(manifest)
