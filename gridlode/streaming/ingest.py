"""A streaming shell around the same stage functions: documents that are dropped into a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def watch(spark: SparkSession, folder: str, schema: StructType, key: str, seen: str, delay: str = "1 day", files_at_once: int = 64) -> DataFrame:
    """A stream of Parquet files; rows that repeat a key within ``delay`` of event time ``seen`` come once, so state stays bounded."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)
    return rows.withWatermark(seen, delay).dropDuplicatesWithinWatermark([key])


def run_stages(stream: DataFrame, stages: list[Callable[[DataFrame], DataFrame]], out: str, checkpoint: str, once: bool = False):
    """Applies the batch stages to each micro-batch and appends Parquet by batch; a batch that is replayed overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        for stage in stages:
            batch = stage(batch)
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def event_counts(events: DataFrame, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) for windows of event time; works on a stream and on a table alike."""
    rows = events.withWatermark("ts", delay) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
