"""Session helpers: workers that can import this package, the shared folder, tables written there, and global positions."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parent.parent)
#: Bytes of an input whose small rows share a file, at least; they take a few per cent of that.
FILE_INPUT = 1 << 30
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package: its folder joins their PYTHONPATH (a wheel or ``--py-files`` does the same on a cluster)."""
    held = spark.sparkContext.environment
    paths = [p for p in held.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        held["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; only a local master may go without and gets one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError(f"spark.checkpoint.dir is not set, and the executors of {context.master} share no folder of the driver's")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="vecspark-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, deleted when the driver ends."""
    path = f"{shared_root(spark)}/vecspark-{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path; a session that has already ended leaves it to the cluster."""
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the gateway is gone at interpreter exit
        return


@contextmanager
def tidy(spark: SparkSession):
    """What runs in here leaves no shuffle files: its results are tables, caches or rows, which need none."""
    held = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, held)


def materialise(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = path or scratch(spark, name)
    with tidy(spark):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def files_for(df: DataFrame) -> int:
    """Files for a table of one small row for each of ``df``: one a core or for each FILE_INPUT bytes of ``df``, whichever is more; as many as any shuffle has where its size is not known."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(spark.sparkContext.defaultParallelism, -(-size // FILE_INPUT)))


def place(marked: DataFrame, out: str) -> DataFrame:
    """``marked`` (a written table with ``__at``: monotonically increasing ids) with ``out``: 0, 1, ... in their order.

    Only one count per partition is summed in one place.
    """
    part = F.shiftright("__at", 33)
    counts = marked.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    bases = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__base"))
    placed = marked.withColumn("__part", part).join(F.broadcast(bases), "__part")
    return placed.withColumn(out, F.col("__base") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at", "__part", "__base")


def positions(df: DataFrame, order: list, name: str = "ordered", out: str = "pos", files: int | None = None) -> DataFrame:
    """``df`` with ``out``: 0, 1, ... in the order of ``order`` (names or columns); ties must be broken by it.

    Rows are range-partitioned, so a group with a third of all rows is spread over tasks. The ordered
    rows, whose places are in ``__at`` by then, are written to ``files`` files where it is given.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    marked = ordered.withColumn("__at", F.monotonically_increasing_id())
    return place(materialise(marked.repartition(files) if files else marked, name), out)


def let(value: Column, use) -> Column:
    """Bind ``value`` once and use it in ``use``: a lambda variable is evaluated one time per row, an inlined column is not."""
    return F.transform(F.array(value), use)[0]
