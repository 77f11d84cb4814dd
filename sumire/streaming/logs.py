"""Event logs as streams: exactly-once appends and running totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.writers import append_batch


def event_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    """New Parquet files of a folder, some at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def log_to(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch under its number; a batch that is run again after a failure replaces itself."""
    return events.writeStream.foreachBatch(lambda df, batch: append_batch(df, path, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_totals(events: DataFrame, time: str, kind: str, value: str, width: str = "1 day", late: str = "7 days") -> DataFrame:
    """(window start, kind, n, total): closed windows once the watermark has passed them."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), kind, "n", "total")


def running_counters(spark: SparkSession, path: str, last: int, key: str) -> DataFrame:
    """(batch, key, n, so_far): records of each committed batch of a log per key, and how many there were up to it. The sum
    runs over batches, which are few, not over records."""
    from pyspark.sql import Window

    from ..sources.writers import committed

    each = committed(spark, path, last).groupBy("batch", key).agg(F.count(F.lit(1)).alias("n"))
    return each.withColumn("so_far", F.sum("n").over(Window.partitionBy(key).orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)))
