"""Incoming volumes as a stream: each micro-batch goes through a batch operator once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def incoming(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """A stream of Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def process(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], output: str, checkpoint: str) -> StreamingQuery:
    """operator on each micro-batch, written under its number: a batch that is run again
    replaces its own rows, so each is kept once."""

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_density(stream: DataFrame, time: str = "ts", every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event-time window and type, closed by a watermark."""
    return (
        stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, every), "event_type")
        .agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("v"))
        .select(F.col("window.start").alias("start"), "event_type", "n", "v")
    )
