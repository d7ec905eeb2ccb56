"""Change feeds: a table's new files refresh an aggregate in micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def refresh_on_change(spark: SparkSession, path: str, schema, refresh: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, once: bool = False, interval: str = "2 seconds", pattern: str | None = None) -> StreamingQuery:
    """Reads new Parquet files at a path; each batch overwrites target with refresh(whole table).

    Batches no closer than the interval take the place of debouncing. A batch that is run again
    writes the same result, so nothing is lost or doubled after a failure.
    """
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)

    def run(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            whole = batch.sparkSession.read.schema(schema)
            whole = (whole.option("pathGlobFilter", pattern) if pattern else whole).parquet(path)
            refresh(whole).write.mode("overwrite").parquet(target)

    writer = reader.parquet(path).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def running_counts(events: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling window and key with a watermark, for batch or streaming input."""
    from pyspark.sql import functions as F

    frame = events.withWatermark(time, late) if events.isStreaming else events
    return frame.groupBy(F.window(time, window).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")
