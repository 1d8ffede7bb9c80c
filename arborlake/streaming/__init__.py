"""Extensions beyond batch: metric snapshots and source files as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_metrics(events: DataFrame, width: str = "1 day", late: str = "2 days", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """events: ts, value and keys; batch or stream. Count, sum and mean by tumbling window; on a stream, rows later than the watermark are dropped."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if events.isStreaming else e
    return e.groupBy(F.window("ts", width), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), *keys, "n", "total", "mean")


def watch_files(spark: SparkSession, folder: str, index: Callable[[DataFrame, int], None], checkpoint: str):
    """Each new or replaced file below a folder goes to index(files, epoch) once; the checkpoint remembers which have been."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder)
    return files.writeStream.foreachBatch(index).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_snapshots(stream: DataFrame, path: str, checkpoint: str):
    """A stream of snapshots to a parquet table, each row exactly once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
