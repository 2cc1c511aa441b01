"""Structured Streaming operators: deduplicated deliveries and tumbling counts, both bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedup(stream: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def tumbling(stream: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts and sums by window and keys, emitted when the watermark passes."""
    w = F.window(time, width)
    return stream.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def drain(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Runs all that is available into a Parquet sink and stops; the checkpoint makes restarts exactly-once."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
