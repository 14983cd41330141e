"""Structured Streaming over the per-row and additive operators.

Stages that look at one row at a time run on a stream as they are.  Additive state (counts, sums, value counts) is kept by
event time with a watermark, so late rows are taken until the watermark passes and state does not grow for ever.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def parquet_stream(spark: SparkSession, path: str, like: DataFrame, files_per_batch: int = 16) -> DataFrame:
    """New Parquet files below a path, with the schema of ``like``."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_summary(stream: DataFrame, time: str, value: str, keys: list[str], width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window_start, keys..., n, sum, sum_sq, min, max) by event time: sums that later windows or loads can add."""
    v = F.col(value)
    ok = stream.where(v.isNotNull() & ~F.isnan(v)).withWatermark(time, late)
    g = ok.groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("sum"), F.sum(v * v).alias("sum_sq"), F.min(v).alias("min"), F.max(v).alias("max"))
    return g.select(F.col("window.start").alias("window_start"), *keys, "n", "sum", "sum_sq", "min", "max")


def deduplicated(stream: DataFrame, time: str, keys: list[str], late: str = "2 days") -> DataFrame:
    """Re-delivered rows left out while their first delivery is within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def run_stage(stream: DataFrame, stage: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Apply a batch operator to every micro-batch and store its result by batch number.

    A batch that is run again after a failure overwrites its own folder, so nothing is stored twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        stage(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
