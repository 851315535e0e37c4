"""Shared storage, sizes and names for operators that need more than one job."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; where
    it is unset (as in tests), one under the session's warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext.getCheckpointDir()
        found = context or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: cuts the lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the scanned input, for choosing counts of buckets and
    partitions; 0 where it has none (an input that is no file scan), so the session's setting holds."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 59 else 0


def partitions_for(df: DataFrame, bytes_each: int) -> int:
    """Partitions of about bytes_each of the scanned input, at least the session's shuffle setting."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(1_000_000, -(-input_bytes(df) // bytes_each)))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not use."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name += "_"
    return name


def columns(df: DataFrame) -> list[Column]:
    """The columns of df by their names, whatever these hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def least_hashed(df: DataFrame, columns: list[str], seed: int, limit: int) -> DataFrame:
    """The `limit` rows of df with the least keyed hash of the columns (df should be stored: it is read twice).
    Rows whose hash lies clearly beyond are left out by a filter first, so what the sort's one task
    reads is bounded by the limit and not by the table."""
    n = df.count()
    drawn = F.xxhash64(*columns, F.lit(seed))
    if n > limit:
        share = min(1.0, (limit + 8 * limit**0.5 + 100) / n)
        df = df.filter(drawn <= int(-(2**63) + share * (2**64 - 1)))
    return df.orderBy(drawn, *columns).limit(limit)
