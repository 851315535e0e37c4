"""Volumes, labels, features and file lists read off the driver's tables.

event_id is dense, so each thousand events is a full 10 x 10 x 10 lattice.  All
columns are projections of a Parquet scan; nothing is computed eagerly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Side of the lattices that `voxels` yields.
SIDE = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vid, img, z, y, x, v): one row a voxel; v is the value in hundredths."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        e.alias("vid"),
        F.floor(e / 1000).cast("bigint").alias("img"),
        F.floor((e % 1000) / 100).cast("int").alias("z"),
        F.floor((e % 100) / 10).cast("int").alias("y"),
        (e % 10).cast("int").alias("x"),
        F.round(F.col("value") * 100).cast("bigint").alias("v"),
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same voxels as volumes of five planes: (vid, img, z, y, x, v), sides 5, 10, 10."""
    e = F.col("vid")
    return voxels(spark, sf_dir).withColumns({"img": F.floor(e / 500).cast("bigint"), "z": F.floor(e % 500 / 100).cast("int")})


def _octant(axis: str) -> Column:
    return F.floor(F.col(axis) / 5).cast("int")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """voxels with dense and sparse octant labels and a region channel."""
    name = 1 + 4 * _octant("z") + 2 * _octant("y") + _octant("x")
    return voxels(spark, sf_dir).select(
        "*",
        F.when(F.col("v") > 3500, name).otherwise(0).cast("int").alias("label"),
        F.when(F.col("v") > 9000, name).otherwise(0).cast("int").alias("label_sparse"),
        F.when(F.col("y") < 5, 0).when(F.col("x") < 5, 100).otherwise(200).alias("region"),
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(condition, volume, dapi_sum): a feature table from line items."""
    flag = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").select(
        F.when(flag == "N", "Control").when(flag == "A", "Adjacent").otherwise("Tumor").alias("condition"),
        F.col("l_quantity").alias("volume"),
        F.col("l_extendedprice").alias("dapi_sum"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, path): page addresses as a file tree."""
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("file_id"), F.col("url").alias("path"))


BOXES_SQL = """boxes AS (SELECT event_id AS vid, CAST(floor(event_id / 500) AS BIGINT) AS img, CAST(floor(event_id % 500 / 100) AS INT) AS z,
  CAST(floor(event_id % 100 / 10) AS INT) AS y, CAST(event_id % 10 AS INT) AS x, CAST(round(value * 100) AS BIGINT) AS v FROM events)"""

#: The same views for SQL engines, to put before a query.
SQL = """
voxels AS (
  SELECT event_id AS vid, CAST(floor(event_id / 1000) AS BIGINT) AS img, CAST(floor((event_id % 1000) / 100) AS INT) AS z,
    CAST(floor((event_id % 100) / 10) AS INT) AS y, CAST(event_id % 10 AS INT) AS x, CAST(round(value * 100) AS BIGINT) AS v FROM events),
vl AS (
  SELECT *, CASE WHEN v > 3500 THEN 1 + 4 * CAST(floor(z / 5) AS INT) + 2 * CAST(floor(y / 5) AS INT) + CAST(floor(x / 5) AS INT) ELSE 0 END AS label,
    CASE WHEN v > 9000 THEN 1 + 4 * CAST(floor(z / 5) AS INT) + 2 * CAST(floor(y / 5) AS INT) + CAST(floor(x / 5) AS INT) ELSE 0 END AS label_sparse,
    CASE WHEN y < 5 THEN 0 WHEN x < 5 THEN 100 ELSE 200 END AS region FROM voxels),
features AS (
  SELECT CASE WHEN l_returnflag = 'N' THEN 'Control' WHEN l_returnflag = 'A' THEN 'Adjacent' ELSE 'Tumor' END AS condition,
    l_quantity AS volume, l_extendedprice AS dapi_sum FROM lineitem)"""
