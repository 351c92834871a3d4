"""Resumable featurization: files as a stream, and batches without what is done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def featurize_stream(spark: SparkSession, folder: str, schema: StructType, featurize: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Featurizes files of a folder as they come and appends to Parquet; each file once, over restarts too. Runs what is there, then ends."""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return featurize(source).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def not_done(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The inputs without those whose key is among the outputs."""
    return inputs.join(done.select(key).distinct(), key, "left_anti")
