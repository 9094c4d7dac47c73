"""AQED vector files: 60-byte header, then rows of 32-bit little-endian floats.

A Python data source: rows are of a fixed width, so a file is cut into ranges that are read
by themselves (on mounted folders). Stores that only Spark opens: ``read_aqed_binary``.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

MAGIC, VERSION, HEADER, ORIGINAL = b"AQED", 1, 60, 1
SCHEMA = "vec_id long, embedding array<float>"


def parse_header(head: bytes) -> tuple[int, int]:
    """(rows, width) of the section that is there: the original vectors, else the compressed ones."""
    if len(head) < HEADER or head[:4] != MAGIC:
        raise ValueError("not an AQED file")
    version, n, original, compressed, flags = struct.unpack_from("<5I", head, 4)
    if version != VERSION:
        raise ValueError(f"AQED version {version} is not supported")
    if n == 0:
        raise ValueError("an AQED file without vectors")
    return n, original if flags & ORIGINAL else compressed


def header(n: int, width: int) -> bytes:
    return (MAGIC + struct.pack("<5I", VERSION, n, width, 0, ORIGINAL)).ljust(HEADER, b"\0")


class _Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class AqedReader(DataSourceReader):
    def __init__(self, path: str, rows: int):
        self.path, self.rows = re.sub("^file:(//)?", "", path), rows

    def partitions(self) -> list[InputPartition]:
        with open(self.path, "rb") as f:
            n, _ = parse_header(f.read(HEADER))
        return [_Range(a, min(n, a + self.rows)) for a in range(0, n, self.rows)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        with open(self.path, "rb") as f:
            _, width = parse_header(f.read(HEADER))
            f.seek(HEADER + 4 * width * partition.first)
            for k in range(partition.first, partition.last):
                raw = f.read(4 * width)
                if len(raw) < 4 * width:
                    raise ValueError("the AQED file is cut short")
                yield k, np.frombuffer(raw, "<f4").tolist()


class AqedSource(DataSource):
    """``spark.read.format("aqed").load(path)``; option rowsPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "aqed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return AqedReader(self.options["path"], int(self.options.get("rowsPerPartition", 65_536)))


def register(spark: SparkSession) -> None:
    from ..session import ship

    ship(spark)
    spark.dataSource.register(AqedSource)


def read_aqed(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("aqed").load(path)


def read_aqed_binary(spark: SparkSession, path: str) -> DataFrame:
    """Like ``read_aqed`` through Spark's own file reader, a file a task."""
    from ..session import ship

    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for content in batch.column(0).to_pylist():
                n, width = parse_header(content[:HEADER])
                data = np.frombuffer(content, "<f4", n * width, HEADER).reshape(n, width)
                for low in range(0, n, 8192):
                    part = data[low : low + 8192]
                    yield pa.record_batch([pa.array(np.arange(low, low + len(part))), pa.array(part.tolist(), pa.list_(pa.float32()))], names=["vec_id", "embedding"])

    return files.mapInArrow(run, SCHEMA)


def write_aqed(df: DataFrame, path: str) -> None:
    """One file in order of vec_id, streamed a partition at a time through the driver (the format has one header)."""
    n = df.count()
    if not n:
        raise ValueError("no vectors to write")
    width = df.select(F.size("embedding")).first()[0]
    jvm, spark = df.sparkSession.sparkContext._jvm, df.sparkSession
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(header(n, width))
        for row in df.orderBy("vec_id").select("embedding").toLocalIterator():
            if len(row[0]) != width:
                raise ValueError("vectors of different width")
            out.write(np.array(row[0], "<f4").tobytes())
    finally:
        out.close()
