"""Dataset preparation: classify files, hold out a test part by class, carry the truth along, check names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import patch, prep


def prepare(files: DataFrame, percent: int = 10, seed: int = 42, mark: str = "synthetic", truth: str = "gt") -> DataFrame:
    """files(path) with is_synthetic, is_truth, split and target name.

    Real images are split by class (the folder above) into test and train, at least one a
    class; a truth file is test where its path mentions a test image's stem; synthetic
    files are train, under their two upper folders' names."""
    found = prep.classify(files, mark, truth)
    real = found.filter("NOT is_synthetic AND NOT is_truth")
    split = patch.exact_split(real.withColumn("class_", F.coalesce(prep.parent_of(F.col("path")), F.lit(""))).withColumn("item_", F.col("path")), "item_", percent, seed, ("class_",), floor=True)
    images = split.select("path", "is_synthetic", "is_truth", F.when(F.col("held"), "test").otherwise("train").alias("split"))
    stems = images.filter("split = 'test'").select(prep.stem_of(F.col("path")).alias("stem")).distinct()
    truths = found.filter("NOT is_synthetic AND is_truth")
    test = prep.stem_join(truths, stems).withColumn("split", F.lit("test"))
    train = prep.stem_join(truths, stems, anti=True).withColumn("split", F.lit("train"))
    made = found.filter("is_synthetic").withColumn("split", F.lit("train"))
    columns = ["path", "is_synthetic", "is_truth", "split"]
    out = images.select(columns).unionByName(test.select(columns)).unionByName(train.select(columns)).unionByName(made.select(columns))
    name = F.when(F.col("is_synthetic"), prep.synthetic_name(F.col("path"))).otherwise(prep.name_of(F.col("path")))
    return out.withColumn("name", F.when(F.col("is_truth") & ~name.contains("_gt."), F.regexp_replace(name, r"\.tif", "_gt.tif")).otherwise(name))


def unmatched(prepared: DataFrame) -> DataFrame:
    """(name, side): stems of images without truth (a) and of truths without image (b)."""
    stem = F.regexp_replace(prep.stem_of(F.col("name")), "_gt$", "")
    return prep.name_differences(prepared.filter("NOT is_truth").select(stem.alias("name")), prepared.filter("is_truth").select(stem.alias("name")))


def decode_centres(df: DataFrame, vectors: tuple[str, str, str], bins: int, n: int, threshold: int) -> DataFrame:
    """(img, z, y, x, n): binned places with more than `threshold` votes that no neighbour exceeds."""
    from ..operators import field, neighbors

    counted = field.votes(df, vectors, bins, n).withColumnRenamed("n", "v")
    return neighbors.local_maxima(counted, 1, threshold).withColumnRenamed("v", "n")
