"""Projections and filters over voxel relations (img, z, y, x, v)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clip, round_half_even, truncated  # noqa: F401  part of this module's surface


def per_image(df: DataFrame, **aggregates: Column) -> DataFrame:
    """df with aggregates of its image on each row.

    An aggregate with map-side combine joined back, so that a volume of any number of
    voxels never meets in one task, as a window over it would; the stats side is a row
    an image, which AQE broadcasts or splits by its size.
    """
    stats = df.groupBy("img").agg(*[c.alias(n) for n, c in aggregates.items()])
    return df.join(stats, "img")


def minmax(df: DataFrame, value: str = "v") -> DataFrame:
    """norm = (v - min) / (max - min) of the image; null on a constant image."""
    out = per_image(df, lo_=F.min(value), hi_=F.max(value))
    return out.withColumn("norm", (F.col(value) - F.col("lo_")) / F.nullif(F.col("hi_") - F.col("lo_"), F.lit(0))).drop("lo_", "hi_")


def minmax_bytes(df: DataFrame, value: str = "v") -> DataFrame:
    """byte: (v - min) / (max - min + 1e-9) of the image on 0..255, toward zero."""
    out = per_image(df, lo_=F.min(value), hi_=F.max(value))
    scaled = (F.col(value) - F.col("lo_")) / (F.col("hi_") - F.col("lo_") + F.lit(1e-9)) * 255
    return out.withColumn("byte", scaled.cast("int")).drop("lo_", "hi_")


def class_of_scores(df: DataFrame, scores: list[str]) -> DataFrame:
    """class_id: the first of the largest scores; probability: its share of their sum, within 0..1, null without a sum."""
    values = F.array(*[F.col(c).cast("double") for c in scores])
    share = F.array_max(values) / F.nullif(sum(F.col(c).cast("double") for c in scores), F.lit(0.0))
    return df.withColumns({"class_id": (F.array_position(values, F.array_max(values)) - 1).cast("int"), "probability": F.when(share.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))})


def percentile_rescale(df: DataFrame, low: float = 2.0, high: float = 99.8, value: str = "v") -> DataFrame:
    """rescaled: v clipped to its image's exact percentiles and mapped to [0, 1]."""
    marks = F.percentile(value, F.array(F.lit(low / 100), F.lit(high / 100)))
    out = per_image(df, marks_=marks)
    lo, hi = F.col("marks_")[0], F.col("marks_")[1]
    scaled = (F.col(value) - lo) / F.nullif(hi - lo, F.lit(0.0))
    return out.withColumn("rescaled", F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled))).drop("marks_")


def invert_where(df: DataFrame, condition: Column, value: str = "v") -> DataFrame:
    """v becomes (max of the image) - v on rows of images that meet a condition."""
    out = per_image(df, hi_=F.max(value))
    return out.withColumn(value, F.when(condition, F.col("hi_") - F.col(value)).otherwise(F.col(value))).drop("hi_")


def path_mentions(path: Column, word: str) -> Column:
    return F.contains(path, F.lit(word))


def in_bounds(df: DataFrame, shape: tuple[int, int, int], axes: tuple[str, str, str] = ("z", "y", "x")) -> DataFrame:
    """Rows whose position lies inside a volume; start and end share the row, so they stay aligned."""
    keep = F.lit(True)
    for axis, n in zip(axes, shape, strict=True):
        keep = keep & F.col(axis).between(0, n - 1)
    return df.filter(keep)


def drop_small(df: DataFrame, label: str = "label", least: int = 20) -> DataFrame:
    """Rows of labels with at least `least` voxels in their image; background goes."""
    sizes = df.filter(F.col(label) > 0).groupBy("img", label).count().filter(F.col("count") >= least)
    return df.join(sizes.select("img", label), ["img", label], "left_semi")


def argmax_class(p0: Column, p1: Column) -> Column:
    """1 where p1 is larger; ties are background."""
    return F.when(p1 > p0, 1).otherwise(0)


def density_threshold(df: DataFrame, n_std: float = 5.0, voxels: int | None = None, value: str = "v") -> DataFrame:
    """Rows above mean + n_std * population deviation; with `voxels`, df is sparse and
    absent voxels count as zero."""
    n = F.lit(voxels) if voxels else F.count("*")
    out = per_image(df, n_=F.max(n) if voxels else n, s_=F.sum(value), q_=F.sum(F.col(value) * F.col(value)))
    excess = F.col("n_") * F.col(value) - F.col("s_")
    spread = F.sqrt((F.col("n_") * F.col("q_") - F.col("s_") * F.col("s_")).cast("double"))
    return out.filter(excess.cast("double") > F.lit(float(n_std)) * spread).drop("n_", "s_", "q_")


def one_hot(df: DataFrame, label: str = "label") -> DataFrame:
    return df.withColumns({"background": F.when(F.col(label) > 0, 0).otherwise(1), "foreground": F.when(F.col(label) > 0, 1).otherwise(0)})


def unit_vectors(df: DataFrame, names: tuple[str, str, str] = ("dz", "dy", "dx")) -> DataFrame:
    """Vectors scaled to length one where they are not null vectors."""
    norm = F.sqrt(sum(F.col(n).cast("double") * F.col(n) for n in names))
    return df.withColumns({f"u{n}": F.when(norm > 0, F.col(n) / norm).otherwise(0.0) for n in names})



def preprocessed(df: DataFrame, n: int, side: int = 8, sigma: float = 5.0, width: float = 1.0, balance: float = 0.1, low: float = 2.0, high: float = 99.8) -> DataFrame:
    """(img, z, y, x, v): illumination corrected, planes deconvolved, values rescaled by percentiles, in this order."""
    from .neighbors import wiener

    sharp = wiener(illumination_corrected(df, n, side, sigma), n, width, balance)
    return percentile_rescale(sharp, low, high).withColumn("v", F.col("rescaled")).drop("rescaled")


def illumination_corrected(df: DataFrame, n: int, side: int = 8, sigma: float = 5.0, value: str = "v") -> DataFrame:
    """v * mean / background: the background is the block mean over cubes of a side (edges as
    padded), smoothed, scaled up linearly and held at a hundredth at least."""
    from .field import resample_linear
    from .neighbors import AXES, gaussian_weights, smooth
    from .regions import block_means

    m = -(-n // side)
    coarse = block_means(df, side, value).select("img", *AXES, (F.col("sum_v") / side**3).alias("v"))
    weights = gaussian_weights(sigma, truncate=min(4.0, (m - 0.5) / sigma))
    background = resample_linear(smooth(coarse, m, weights, integer=False), n, m, m).withColumnRenamed("v", "back_")
    out = per_image(df, mean_=F.avg(value)).join(background, ["img", *AXES])
    return out.withColumn(value, F.col(value) * F.col("mean_") / F.greatest(F.col("back_"), F.lit(0.01))).drop("mean_", "back_")
