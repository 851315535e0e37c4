"""Padding, patch grids, stitching, sampling and budgets.

Voxel-to-patch coverage is arithmetic: the grid steps that cover a coordinate are a
short sequence, exploded per axis, so the range join is a projection with a fixed
fan-out and later joins are equi-joins.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AXES = ("z", "y", "x")

#: A number for all three axes, or one for each of z, y, x.
Sizes = int | tuple[int, int, int]


def by_axis(sizes) -> dict:
    """The value of each axis: the parts of a triple, or one value for all."""
    return dict(zip(AXES, sizes if isinstance(sizes, tuple) else (sizes,) * 3, strict=True))


@dataclass(frozen=True)
class Grid:
    """Patch and stride lengths of an axis, equal on all axes."""

    patch: int
    step: int

    @staticmethod
    def overlapping(patch: int, overlap: float, n: int) -> int:
        """Padded length of n cells under patches that overlap by a share of their side (steps need not be whole)."""
        step = patch * (1 - overlap)
        return int(patch + math.ceil((n - patch) / step) * step)

    def padded(self, n: int) -> int:
        """Length that whole steps cover."""
        return self.patch + max(0, -(-(n - self.patch) // self.step)) * self.step

    def count(self, length: int) -> int:
        return (length - self.patch) // self.step + 1 if length >= self.patch else 0


def pad_index(i: Column, n: int, mode: str) -> Column:
    """Source coordinate of padded coordinate i: reflect has no repeated edge, wrap repeats the volume."""
    if mode == "wrap":
        return (i % n).cast("int")
    if n == 1:
        return F.lit(0)
    j = i % (2 * (n - 1))
    return F.when(j < n, j).otherwise(2 * (n - 1) - j).cast("int")


def padded_places(j: Column, n: int, length: int, mode: str, left: int = 0) -> Column:
    """Array of the padded coordinates that source coordinate j is copied to."""

    def steps(first: Column, period: int) -> Column:
        first = F.pmod(first, F.lit(period)).cast("int")
        return F.when(first < length, F.sequence(first, F.lit(length - 1), F.lit(period))).otherwise(F.array().cast("array<int>"))

    if mode == "constant":
        at = (j + left).cast("int")
        return F.when((at >= 0) & (at < length), F.array(at)).otherwise(F.array().cast("array<int>"))
    if mode == "wrap":
        return steps(j + left, n)
    if n == 1:
        return F.sequence(F.lit(0), F.lit(length - 1))
    period = 2 * (n - 1)
    return F.array_distinct(F.concat(steps(j + left, period), steps(left - j, period)))


def pad(df: DataFrame, n: Sizes, length: Sizes, mode: str = "reflect", left: Sizes = 0, value: str = "v", axes: tuple[str, ...] = AXES) -> DataFrame:
    """The volume of sides n padded to `length` on each of the axes, `left` of it before the origin.

    mode constant gives 0 outside.  Each source voxel is copied to its padded places, which
    follow by arithmetic, by an explode an axis, without a join."""
    out, n, length, left = df, by_axis(n), by_axis(length), by_axis(left)
    for axis in axes:
        out = out.withColumn(axis, F.explode(padded_places(F.col(axis), n[axis], length[axis], mode, left[axis])))
    if mode != "constant":
        return out
    lattice = df.select("img", *[a for a in AXES if a not in axes]).distinct()
    for axis in axes:
        lattice = lattice.withColumn(axis, F.explode(F.sequence(F.lit(0), F.lit(length[axis] - 1))))
    filled = lattice.join(out.select("img", *AXES, value), ["img", *AXES], "left")
    return filled.withColumn(value, F.coalesce(value, F.lit(0)))


def view_padding(n: int, window: int, subdivisions: int) -> tuple[int, int]:
    """(cells before, padded length) of an axis for windows moved by window / subdivisions: a unit on
    both sides, and the remainder shared, the larger half behind."""
    if window % subdivisions:
        raise ValueError("the window must be a whole number of subdivisions")
    unit = window // subdivisions
    rest = (n + 2 * unit) % unit
    return unit + rest // 2, n + 2 * unit + rest


def covering(coordinate: Column, grid: Grid, count: int) -> Column:
    """Array of grid steps whose patch holds a coordinate."""
    low = F.greatest(F.lit(0), F.ceil((coordinate - grid.patch + 1) / grid.step).cast("int"))
    high = F.least(F.lit(count - 1), F.floor(coordinate / grid.step).cast("int"))
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))


def patchify(df: DataFrame, grid: Grid, length: Sizes) -> DataFrame:
    """df with a row for each patch (gz, gy, gx) that holds the voxel, and its place (oz, oy, ox) there."""
    length, out = by_axis(length), df
    for axis in AXES:
        out = out.withColumn(f"g{axis}", F.explode(covering(F.col(axis), grid, grid.count(length[axis]))))
    return out.withColumns({f"o{axis}": F.col(axis) - F.col(f"g{axis}") * grid.step for axis in AXES})


def signal_filter(counts: DataFrame, percent: int = 5, within: tuple[str, ...] = ()) -> DataFrame:
    """Patches whose n_signal is more than a percentage of the largest one's (strictly)."""
    if within:
        top = counts.groupBy(*within).agg(F.max("n_signal").alias("top_"))
        joined = counts.join(top, list(within))
    else:
        joined = counts.crossJoin(F.broadcast(counts.agg(F.max("n_signal").alias("top_"))))  # one row
    return joined.filter(F.col("n_signal") * 100 > F.col("top_") * percent).drop("top_")


def ramp(o: Column, g: Column, last: int, grid: Grid) -> Column:
    """Numerator of an axis weight over max(overlap - 1, 1): falling in the tail of inner patches
    (tested first), rising in the head, full elsewhere."""
    overlap = grid.patch - grid.step
    full = max(overlap - 1, 1)
    if overlap < 1:
        return F.lit(full)
    return (
        F.when((g < last) & (o >= grid.patch - overlap), grid.patch - 1 - o)
        .when((g > 0) & (o < overlap), o)
        .otherwise(full)
    )


def stitch(patches: DataFrame, grid: Grid, length: int, value: str = "v") -> DataFrame:
    """(img, z, y, x, num, den): weighted overlap sums; the blended value is num / nullif(den, 0).

    One aggregate keyed by voxel with map-side combine; integer weights keep sums exact."""
    last = grid.count(length) - 1
    w = F.lit(1)
    for axis in AXES:
        w = w * ramp(F.col(f"o{axis}"), F.col(f"g{axis}"), last, grid)
    at = [(F.col(f"g{a}") * grid.step + F.col(f"o{a}")).alias(a) for a in AXES]
    return patches.select("img", *at, w.cast("long").alias("w"), value).groupBy("img", *AXES).agg(F.sum(F.col("w") * F.col(value)).alias("num"), F.sum("w").alias("den"))


def stitch_profile(patches: DataFrame, grid: Grid, length: int, profile: list[float], value: str = "v") -> DataFrame:
    """(img, z, y, x, v): overlaps blended by a rising profile (of the overlap's length) and its mirror,
    full elsewhere; null where all weights are zero."""
    last, overlap, rise = grid.count(length) - 1, grid.patch - grid.step, F.array(*map(F.lit, profile))
    w = F.lit(1.0)
    for a in AXES:
        o, g = F.col(f"o{a}"), F.col(f"g{a}")
        w = w * F.when((g < last) & (o >= grid.patch - overlap), rise[grid.patch - 1 - o]).when((g > 0) & (o < overlap), rise[o]).otherwise(1.0)
    at = [(F.col(f"g{a}") * grid.step + F.col(f"o{a}")).alias(a) for a in AXES]
    sums = patches.select("img", *at, w.alias("w"), value).groupBy("img", *AXES).agg(F.sum(F.col("w") * F.col(value)).alias("num"), F.sum("w").alias("den"))
    return sums.select("img", *AXES, (F.col("num") / F.nullif(F.col("den"), F.lit(0.0))).alias(value))


def sigmoid_profile(overlap: int) -> list[float]:
    """A sigmoid over 0..1 whose slope is the overlap."""
    return [1 / (1 + math.exp(-overlap * ((i / (overlap - 1) if overlap > 1 else 0.0) - 0.5))) for i in range(overlap)]


def unpad(df: DataFrame, n: Sizes, left: Sizes = 0) -> DataFrame:
    """The crop of sides n that starts at `left`, shifted to the origin."""
    keep, n, left = F.lit(True), by_axis(n), by_axis(left)
    for a in AXES:
        keep = keep & F.col(a).between(left[a], left[a] + n[a] - 1)
    return df.filter(keep).withColumns({a: F.col(a) - left[a] for a in AXES})


BINS = 4096


def first_ranked(df: DataFrame, bin_: Column, order: list[Column], k: DataFrame, group: tuple[str, ...], name: str) -> DataFrame:
    """df with `name`: whether a row is among the first k of its group (k: a row a group, column k_).

    bin_ (0 to BINS - 1) must not fall where the order rises.  Rows are counted by bin, and only the
    bin that holds the k-th row is ranked, so no task sorts a group."""
    binned = df.withColumn("b_", bin_.cast("int"))
    counts = binned.groupBy(*group, "b_").count()
    w = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy("b_").rowsBetween(Window.unboundedPreceding, -1)
    marked = counts.withColumn("before_", F.coalesce(F.sum("count").over(w), F.lit(0)))
    marked = marked.join(k, list(group)) if group else marked.crossJoin(F.broadcast(k))
    joined = binned.join(marked.select(*group, "b_", "before_", "count", "k_"), [*group, "b_"])
    whole = joined.filter((F.col("before_") >= F.col("k_")) | (F.col("before_") + F.col("count") <= F.col("k_"))).withColumn(name, F.col("before_") < F.col("k_"))
    rank = F.col("before_") + F.row_number().over(Window.partitionBy(*group, "b_").orderBy(*order))
    cut = joined.filter((F.col("before_") < F.col("k_")) & (F.col("before_") + F.col("count") > F.col("k_"))).withColumn(name, rank <= F.col("k_"))
    return whole.unionByName(cut).drop("b_", "before_", "count", "k_")


def largest_remainder(weights: DataFrame, total: int, group: tuple[str, ...] = (), item: str = "item", weight: str = "weight") -> DataFrame:
    """share: `total` units of each group dealt by weight, floors first, the rest to the
    largest remainders (ties by item); with zero weight, evenly with the first ones ahead."""
    sums = weights.groupBy(*group).agg(F.sum(weight).alias("s_"), F.count("*").alias("n_"))
    out = weights.join(sums, list(group)) if group else weights.crossJoin(F.broadcast(sums))
    scaled, s = F.lit(total).cast("long") * F.col(weight), F.nullif(F.col("s_"), F.lit(0))
    floor = F.when(F.col("s_") > 0, F.floor(scaled / s)).otherwise(F.floor(F.lit(total) / F.col("n_")))
    rest = F.when(F.col("s_") > 0, scaled - F.floor(scaled / s) * F.col("s_")).otherwise(0)
    out = out.withColumns({"f_": floor.cast("long"), "r_": rest})
    left = out.groupBy(*group).agg((F.lit(total) - F.sum("f_")).alias("k_"))
    bin_ = F.when(F.col("s_") > 0, F.floor((F.col("s_") - 1 - F.col("r_")) * BINS / s)).otherwise(0)
    ranked = first_ranked(out, F.greatest(F.lit(0), F.least(bin_, F.lit(BINS - 1))), [F.col("r_").desc(), F.col(item)], left, group, "more_")
    return ranked.withColumn("share", F.col("f_") + F.when(F.col("more_"), 1).otherwise(0)).drop("s_", "n_", "f_", "r_", "more_")


def mixed(*parts: Column, salt: int = 0) -> Column:
    """A 32-bit hash of the parts under a salt: the head of an MD5, which any SQL engine repeats."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts], F.lit(str(salt)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def patch_starts(images: DataFrame, per_image: int, dim: int, patch: int, seed: int = 0) -> DataFrame:
    """(img, k, z, y, x): per_image uniform starts in [0, dim - patch], by hash."""
    out = images.select("img").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(per_image - 1))))
    return out.withColumns({a: (mixed(F.col("img"), F.col("k"), F.lit(a), salt=seed) % (dim - patch + 1)).cast("int") for a in AXES})


def cut_patches(df: DataFrame, starts: DataFrame, size: int) -> DataFrame:
    """starts(img, k, z, y, x) with the voxels of the cube of a side that begins there: places (oz, oy, ox) and
    df's other columns, by an equi-join on the voxel."""
    cells = starts.select("img", "k", *[F.col(a).alias(f"s{a}") for a in AXES])
    for a in AXES:
        cells = cells.withColumn(f"o{a}", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn(a, F.col(f"s{a}") + F.col(f"o{a}"))
    return cells.drop(*[f"s{a}" for a in AXES]).join(df, ["img", *AXES]).drop(*AXES)


def exact_split(df: DataFrame, item: str, fraction_percent: int, seed: int = 0, group: tuple[str, ...] = (), floor: bool = False) -> DataFrame:
    """held: marks exactly ceil (or max(1, floor)) of fraction of the rows (of each group), those of the smallest hash."""
    hashed = df.withColumn("h_", mixed(F.col(item), salt=seed))
    n = hashed.groupBy(*group).agg(F.count("*").alias("n_"))
    k = F.greatest(F.lit(1), F.floor(F.col("n_") * fraction_percent / 100)) if floor else F.ceil(F.col("n_") * fraction_percent / 100)
    wanted = n.select(*group, k.cast("long").alias("k_"))
    return first_ranked(hashed, F.floor(F.col("h_") * BINS / 2**32), [F.col("h_"), F.col(item)], wanted, group, "held").drop("h_")


def sample_without_replacement(df: DataFrame, item: str, k: int, seed: int = 0) -> DataFrame:
    """k rows of the smallest hash (a top-k, merged from tasks)."""
    return df.withColumn("h_", mixed(F.col(item), salt=seed)).orderBy("h_", item).limit(k).drop("h_")


def export_pages(df: DataFrame, depth: int, as_bytes: bool = False) -> DataFrame:
    """Patches (patch_id, z, y, x, v) as pages of one stack: page = patch_id * depth + z; `as_bytes` scales v from
    0..1 to whole numbers of 0..255 (toward zero, modulo 256)."""
    if as_bytes:
        df = df.withColumn("v", F.pmod((F.col("v") * 255).cast("long"), F.lit(256)))
    return df.withColumn("page", F.col("patch_id") * depth + F.col("z")).drop("patch_id", "z")
