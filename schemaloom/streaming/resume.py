"""Resumable work: a worklist as a file stream, each id done once over any number of runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pending(worklist: DataFrame, done: DataFrame, key: str = "custom_id") -> DataFrame:
    """What isn't done yet, each id once."""
    return worklist.dropDuplicates([key]).join(done.select(key).distinct(), key, "left_anti")


def run_available(spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, key: str = "custom_id", files_per_batch: int = 4) -> None:
    """Process all files that are there and not yet processed, then stop; call again to go on.

    Ids are deduplicated in streaming state, which the checkpoint keeps over runs; the file sink commits a batch once,
    so after a crash a batch is repeated but never written twice.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = work(stream.dropDuplicates([key])).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def progress(done: DataFrame, total: int) -> DataFrame:
    """One row: how many are done, of how many, how many failed."""
    return done.agg(F.count("*").alias("done"), F.lit(total).cast("long").alias("total"), F.count_if(F.col("status") == "api_error").alias("failed")).withColumn("left", F.col("total") - F.col("done"))
