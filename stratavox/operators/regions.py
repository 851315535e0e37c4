"""Objects of a label volume: properties, codes, lookups and training targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .neighbors import AXES
from .project import clip, round_half_even


def properties(df: DataFrame, label: str = "label", value: str = "v") -> DataFrame:
    """(img, label, area, sum_v, sum_z, sum_y, sum_x, min_*, max_*) by one aggregate; centroids are sums over area."""
    sums = [F.sum(F.col(a).cast("long")).alias(f"sum_{a}") for a in AXES]
    ends = [f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("min", F.min), ("max", F.max))]
    return df.filter(F.col(label) > 0).groupBy("img", F.col(label).alias("label")).agg(F.count("*").alias("area"), F.sum(value).alias("sum_v"), *sums, *ends)


def equivalent_radius(area: Column, dims: int = 3) -> Column:
    """Radius of the ball (or disc) of an area."""
    if dims == 3:
        return F.cbrt(3 * area / (4 * F.pi()))
    if dims == 2:
        return F.sqrt(area / F.pi())
    raise ValueError("volumes have two or three dimensions")


def mean_radius(df: DataFrame, label: str = "label", dims: int = 3) -> DataFrame:
    """(img, radius): mean equivalent radius of the objects; images without objects have no row."""
    sizes = df.filter(F.col(label) > 0).groupBy("img", label).agg(F.count("*").alias("area"))
    return sizes.groupBy("img").agg(F.avg(equivalent_radius(F.col("area"), dims)).alias("radius"))


def object_codes(df: DataFrame, label: str = "label", least: int = 20) -> DataFrame:
    """(img, label, cz, cy, cx, area, min_*, max_*): boxes and their midpoints (halves to even) of
    objects of at least `least` voxels."""
    found = properties(df, label).filter(F.col("area") >= least)
    mid = {f"c{a}": round_half_even((F.col(f"max_{a}") - F.col(f"min_{a}")) / 2 + F.col(f"min_{a}")).cast("int") for a in AXES}
    return found.withColumns(mid).select("img", "label", *mid, "area", *[f"{e}_{a}" for a in AXES for e in ("min", "max")])


def region_of_centroid(objects: DataFrame, regions: DataFrame, n: int) -> DataFrame:
    """objects (of `properties`) with the region at their centroid, rounded half to even and clipped; 0 without one."""
    at = {a: clip(F.rint(F.col(f"sum_{a}") / F.col("area")).cast("int"), F.lit(0), F.lit(n - 1)) for a in AXES}
    placed = objects.withColumns(at)
    joined = placed.join(regions.select("img", *AXES, "region"), ["img", *AXES], "left")
    return joined.withColumn("region", F.coalesce("region", F.lit(0)))


def target_vectors(df: DataFrame, label: str = "label", least: int = 20, reach: int | None = None) -> DataFrame:
    """df with (dz, dy, dx): displacement to the object's box midpoint inside objects of at least `least`
    voxels (clipped to +-reach), zero elsewhere.  The small object table joins on its label."""
    codes = object_codes(df, label, least).select("img", F.col("label").alias(label), *[f"c{a}" for a in AXES])
    out = df.join(codes, ["img", label], "left")
    step = {f"d{a}": F.coalesce(F.col(f"c{a}") - F.col(a), F.lit(0)) for a in AXES}
    if reach is not None:
        step = {k: F.greatest(F.lit(-reach), F.least(F.lit(reach), c)) for k, c in step.items()}
    return out.withColumns(step).drop(*[f"c{a}" for a in AXES])


def normalised_targets(df: DataFrame, label: str = "label", least: int = 20) -> DataFrame:
    """df with (dz, dy, dx) as shares of the farther half of the object's box, per axis."""
    codes = object_codes(df, label, least).select("img", F.col("label").alias(label), *[f"{e}{a}" if e == "c" else f"{e}_{a}" for a in AXES for e in ("c", "min", "max")])
    out = df.join(codes, ["img", label], "left")
    step = {}
    for a in AXES:
        half = F.greatest(F.col(f"c{a}") - F.col(f"min_{a}"), F.col(f"max_{a}") - F.col(f"c{a}"))
        step[f"d{a}"] = F.coalesce((F.col(f"c{a}") - F.col(a)) / (half + F.lit(1e-10)), F.lit(0.0))
    return out.withColumns(step).drop(*[c for a in AXES for c in (f"c{a}", f"min_{a}", f"max_{a}")])


def encoded_targets(df: DataFrame, least: int = 20, dust: int = 100, label: str = "label") -> DataFrame:
    """normalised_targets() of the objects that are left when equal labels are split into their connected parts and
    parts under `dust` voxels go; df has vid.  Voxels of no such part have null vectors."""
    from .neighbors import connected_components, dense_labels

    found = dense_labels(connected_components(df.filter(F.col(label) > 0), 26, label)).select("img", "vid", "component_id")
    big = found.groupBy("img", "component_id").count().filter(F.col("count") >= dust).drop("count")
    kept = found.join(big, ["img", "component_id"], "left_semi")
    out = df.join(kept, ["img", "vid"], "left").withColumn(label, F.coalesce("component_id", F.lit(0))).drop("component_id")
    return normalised_targets(out, label, least)


def block_means(df: DataFrame, side: int, value: str = "v") -> DataFrame:
    """(img, z, y, x, sum_v, n): sums over cubes of a side; a mean divides by side**3 where edges count as padded."""
    at = [F.floor(F.col(a) / side).cast("int").alias(a) for a in AXES]
    return df.groupBy("img", *at).agg(F.sum(value).alias("sum_v"), F.count("*").alias("n"))
