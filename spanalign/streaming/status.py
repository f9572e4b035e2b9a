"""Structured Streaming: latest status of an append-only log, event segments, resumable batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, path: str, schema, per_trigger: int = 100) -> DataFrame:
    """A folder of Parquet files as a stream of its files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def latest(events: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """key and the columns of its last event; the same over a table and over a stream (update mode)."""
    last = F.max_by(F.struct(*columns), F.struct(*order))
    return events.groupBy(key).agg(last.alias("last"), F.count("*").alias("n")).select(key, *(F.col(f"last.{c}").alias(c) for c in columns), "n")


def windowed(events: DataFrame, time: str, width: str, late: str, by: str) -> DataFrame:
    """Counts and sums by window; events later than the watermark are left out of closed windows."""
    grouped = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width), by)
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")


def pending(selection: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed batch still has to do."""
    return selection.join(done.select(key).distinct(), key, "left_anti")


def run_once(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Drains what there is into a table in memory and gives it."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def append_batches(df: DataFrame, path: str, checkpoint: str, key: str):
    """Appends each micro-batch to a table once: a batch that is run again replaces its own part."""
    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates([key]).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
