"""Patch sets as partitioned Parquet: image and label of a patch are one row, so they cannot drift apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PATCH = T.StructType([
    T.StructField("split", T.StringType()), T.StructField("dataset", T.StringType()), T.StructField("image_id", T.LongType()),
    T.StructField("patch_id", T.LongType()), T.StructField("image", T.ArrayType(T.FloatType(), False)), T.StructField("labels", T.ArrayType(T.IntegerType(), False)),
])


def gathered(voxels: DataFrame, size: int) -> DataFrame:
    """(img, gz, gy, gx, image, labels): patch voxels (oz, oy, ox, v, label) in row-major arrays."""
    place = (F.col("oz") * size + F.col("oy")) * size + F.col("ox")
    cells = F.array_sort(F.collect_list(F.struct(place.alias("i"), F.col("v").cast("float").alias("v"), F.col("label").cast("int").alias("label"))))
    out = voxels.groupBy("img", "gz", "gy", "gx").agg(cells.alias("cells"))
    return out.select("img", "gz", "gy", "gx", F.transform("cells", lambda c: c["v"]).alias("image"), F.transform("cells", lambda c: c["label"]).alias("labels"))


def write(patches: DataFrame, path: str, voxels: int, append: bool = True) -> None:
    """Adds patches to a set (or replaces it), by split and dataset; every array must hold `voxels` values."""
    wrong = patches.filter((F.size("image") != voxels) | (F.size("labels") != voxels)).limit(1).count()
    if wrong:
        raise ValueError(f"patches must hold {voxels} voxels")
    patches.select(*PATCH.fieldNames()).write.mode("append" if append else "overwrite").partitionBy("split", "dataset").parquet(path)


def replace_dataset(patches: DataFrame, path: str) -> None:
    """Replaces the partitions that patches hold and leaves the others."""
    patches.select(*PATCH.fieldNames()).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("split", "dataset").parquet(path)


def read(spark: SparkSession, path: str, split: str | None = None, dataset: str | None = None) -> DataFrame:
    """The patches of a set; split and dataset prune partitions."""
    out = spark.read.schema(PATCH).parquet(path)
    for name, value in (("split", split), ("dataset", dataset)):
        if value is not None:
            out = out.filter(F.col(name) == value)
    return out


def lookup(patches: DataFrame, patch_id: int, shape: tuple[int, int, int] | None = None) -> DataFrame:
    """A patch; with its shape, labels are split into connected parts, numbered in order of their first voxel."""
    found = patches.filter(F.col("patch_id") == patch_id)
    if shape is None:
        return found
    from ..operators import neighbors

    plane, row = shape[1] * shape[2], shape[2]
    cells = found.select("dataset", "patch_id", F.posexplode("labels").alias("i", "kind")).filter("kind > 0")
    at = cells.select(F.xxhash64("dataset", "patch_id").alias("img"), F.col("i").cast("long").alias("vid"), "kind", F.floor(F.col("i") / plane).cast("int").alias("z"), F.floor(F.col("i") % plane / row).cast("int").alias("y"), (F.col("i") % row).cast("int").alias("x"))
    parts = neighbors.dense_labels(neighbors.connected_components(at, 26, "kind"))
    named = parts.groupBy("img").agg(F.map_from_entries(F.collect_list(F.struct(F.col("vid").cast("int"), F.col("component_id").cast("int")))).alias("part_"))
    joined = found.withColumn("img", F.xxhash64("dataset", "patch_id")).join(named, "img", "left")
    again = F.transform("labels", lambda v, i: F.when(v > 0, F.coalesce(F.try_element_at("part_", i), F.lit(0))).otherwise(0))
    return joined.withColumn("labels", again).select(patches.columns)


def described(spark: SparkSession, path: str) -> DataFrame:
    """(column, type, partition): the structure of a stored set."""
    stored = spark.read.parquet(path)
    keys = {k for k in ("split", "dataset") if k in stored.columns}
    return spark.createDataFrame([(f.name, f.dataType.simpleString(), f.name in keys) for f in stored.schema], "column string, type string, partition boolean")


def shuffled(patches: DataFrame, seed: int, epoch: int = 0, take: int | None = None) -> DataFrame:
    """A repeatable order of an epoch's patches, cut to `take`."""
    out = patches.orderBy(F.xxhash64("patch_id", "dataset", F.lit(seed), F.lit(epoch)), "patch_id")
    return out.limit(take) if take is not None else out


def write_predictions(objects: DataFrame, path: str) -> None:
    """objects(model, parent, stem, ...) under model, parent folder and stem."""
    objects.write.mode("append").partitionBy("model", "parent", "stem").parquet(path)


def write_history(history: DataFrame, path: str, seconds: float | None = None) -> None:
    """The history as CSV with a header; the run's seconds as one line of text beside it."""
    history.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    if seconds is not None:
        history.sparkSession.range(1).select(F.lit(f"{seconds:.2f}")).coalesce(1).write.mode("overwrite").text(path.rstrip("/") + "_time")
