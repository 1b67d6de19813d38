"""Scoring on a stream of claim files. Scoring one record depends on that record only, so
the stream keeps no state and needs no watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def score_stream(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    score: Callable[[DataFrame], DataFrame],
    sink: str,
    checkpoint: str,
    files_per_batch: int = 1000,
    follow: bool = False,
):
    """Read new Parquet files below ``source``, apply ``score``, append to ``sink``.

    The checkpoint folder and the file sink give exactly-once results over restarts. With
    ``follow`` the query keeps running; else it takes what is there in batches and ends.
    """
    incoming = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    )
    writer = (
        score(incoming)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
    )
    writer = writer if follow else writer.trigger(availableNow=True)
    return writer.start(sink)
