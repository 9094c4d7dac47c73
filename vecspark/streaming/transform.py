"""The stateless codec on streams: the same columns on readStream, files in, files out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.pipeline import CompressionPipeline

SCHEMA = "vec_id long, embedding array<float>, label int"


def read_vectors(spark: SparkSession, folder: str, files_per_trigger: int = 16, schema: str = SCHEMA) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def compress_stream(vectors: DataFrame, pipeline: CompressionPipeline) -> DataFrame:
    """No state, so no watermark: each micro-batch is a projection."""
    return pipeline.transform(vectors.where(F.col("embedding").isNotNull()))


def write_stream(compressed: DataFrame, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Parquet sink, exactly once by its checkpoint."""
    writer = compressed.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
