"""Augmentations as coordinate and value projections; decisions are hashes of sample and operation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .field import resample_linear, resample_nearest
from .neighbors import AXES, gaussian_weights, smooth
from .patch import Sizes, by_axis, mixed

def chosen(sample: Column, operation: str, seed: int = 0, percent: int = 50) -> Column:
    """Whether a sample takes an operation."""
    return mixed(sample, F.lit(operation), salt=seed) % 100 < percent


def flip(df: DataFrame, axis: str, n: int) -> DataFrame:
    return df.withColumn(axis, F.lit(n - 1) - F.col(axis))


def transpose_yx(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"y": "y_", "x": "y"}).withColumnRenamed("y_", "x")


def rotate90(df: DataFrame, axis: str, turns: int, n: int) -> DataFrame:
    """Quarter turns in the plane across an axis; turns add up modulo 4 and invert by -turns."""
    a, b = (x for x in AXES if x != axis)
    for _ in range(turns % 4):
        df = df.withColumns({a: F.col(b), b: F.lit(n - 1) - F.col(a)})
    return df


def downsample(df: DataFrame, factors: tuple[int, int, int], value: str = "v") -> DataFrame:
    """Each voxel takes the value at its block's first corner; labels stay: an equi-join on the corner."""
    corner = df.select("img", *[F.col(a).alias(f"c{a}") for a in AXES], F.col(value).alias("corner_"))
    keyed = df.withColumns({f"c{a}": F.col(a) - F.col(a) % f for a, f in zip(AXES, factors, strict=True)})
    return keyed.join(corner, ["img", *[f"c{a}" for a in AXES]]).withColumn(value, F.col("corner_")).drop("corner_", *[f"c{a}" for a in AXES])


def brightness(v: Column, gain: float, gamma: float) -> Column:
    """sign(v) * gain * |v| ** gamma, clipped to [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.signum(v) * gain * F.pow(F.abs(v), F.lit(gamma))))


def blur(df: DataFrame, n: int, sigma: float) -> DataFrame:
    return smooth(df, n, gaussian_weights(sigma), integer=False) if sigma > 0 else df


def zoom(df: DataFrame, n: Sizes, percent: int | tuple[int, int, int], seed: int | None = None, value: str = "label", order: int = 0) -> DataFrame:
    """Rescale by percent of the sides (by axis), nearest or (order 1) linear; then each axis is padded with
    zeros to its side again, evenly, or cropped, at the middle or, with a seed, at a place drawn by image."""
    from .patch import pad

    sides, percents, out = by_axis(n), by_axis(percent), df
    sizes = {a: max(1, (sides[a] * percents[a] + 50) // 100) for a in AXES}
    for a, m in sizes.items():
        out = resample_linear(out, m, None, n, value, (a,)) if order else resample_nearest(out, n, m, (a,))
    for a, m in sizes.items():
        k = sides[a]
        if m < k:
            out = pad(out, m, k, "constant", (k - m) // 2, value, (a,))
        elif m > k:
            start = F.lit((m - k) // 2) if seed is None else (mixed(F.col("img"), F.lit(a), salt=seed) % (m - k + 1)).cast("int")
            out = out.withColumn(a, F.col(a) - start).filter(F.col(a).between(0, k - 1))
    return out


def rotate(df: DataFrame, n: int, degrees: float, value: str = "v") -> DataFrame:
    """Rotation about the z axis, nearest sample, same shape: the inverse map joined on its source."""
    c, s, mid = math.cos(math.radians(degrees)), math.sin(math.radians(degrees)), (n - 1) / 2
    target = df.select("img", *AXES)
    y, x = F.col("y") - mid, F.col("x") - mid
    keyed = target.withColumns({"sy": F.rint(c * y + s * x + mid).cast("int"), "sx": F.rint(-s * y + c * x + mid).cast("int")})
    source = df.select("img", "z", F.col("y").alias("sy"), F.col("x").alias("sx"), value)
    return keyed.join(source, ["img", "z", "sy", "sx"], "left").select("img", *AXES, F.coalesce(value, F.lit(0)).alias(value))


def rotate_linear(df: DataFrame, n: int, degrees: float, value: str = "v") -> DataFrame:
    """Rotation about the z axis, linear samples, zero outside, same shape: four corners of the source by an equi-join."""
    c, s, mid = math.cos(math.radians(degrees)), math.sin(math.radians(degrees)), (n - 1) / 2
    y, x = F.col("y") - mid, F.col("x") - mid
    at = df.select("img", *AXES).withColumns({"py": F.round(c * y + s * x + mid, 9), "px": F.round(-s * y + c * x + mid, 9)})
    corners = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    out = at.withColumn("corner_", F.explode(corners))
    for a, k in (("y", "i"), ("x", "j")):
        low = F.floor(f"p{a}")
        part = F.col(f"p{a}") - low
        out = out.withColumns({f"s{a}": (low + F.col(f"corner_.{k}")).cast("int"), f"w{a}": F.when(F.col(f"corner_.{k}") == 1, part).otherwise(1 - part)})
    source = df.select("img", "z", F.col("y").alias("sy"), F.col("x").alias("sx"), F.col(value).alias("sample_"))
    hit = out.join(source, ["img", "z", "sy", "sx"], "left")
    return hit.groupBy("img", *AXES).agg(F.coalesce(F.sum(F.col("wy") * F.col("wx") * F.col("sample_")), F.lit(0.0)).alias(value))


def augmented(blocks: DataFrame, augmenter, schema: str) -> DataFrame:
    """blocks through a caller's augmenter: DataFrame -> DataFrame in Arrow batches."""
    from .field import scored

    return scored(blocks, augmenter, schema)


def _turned(rows: list[list[int]], sides: list[int], plane: str, turns: int) -> tuple[list[list[int]], list[int]]:
    """rows (axis coefficients, offset) and sides after quarter turns in the plane across an axis."""
    a, b = (i for i, x in enumerate(AXES) if x != plane)
    for _ in range(turns % 4):
        rows, sides = list(rows), list(sides)
        rows[a], rows[b] = rows[b], [-v for v in rows[a]]
        rows[b][3] += sides[a] - 1
        sides[a], sides[b] = sides[b], sides[a]
    return rows, sides


def _flipped(rows: list[list[int]], sides: list[int], axis: str | None) -> list[list[int]]:
    if axis is None:
        return rows
    k, rows = AXES.index(axis), list(rows)
    rows[k] = [-v for v in rows[k]]
    rows[k][3] += sides[k] - 1
    return rows


def _view_maps(n: Sizes) -> list[tuple[tuple, tuple, tuple[int, int, int]]]:
    """(forward, backward, sides) of the 27 views: integer maps as rows of (axis coefficients, offset) for z, y, x, and
    the sides of the view."""
    same, sides = [[int(i == j) for j in range(4)] for i in range(3)], list(by_axis(n).values())
    out = []
    for axis in (None, "y", "x"):
        for plane in AXES:
            for turns in (0, 1, 2):
                forward, seen = _turned(_flipped(same, sides, axis), sides, plane, turns)
                backward, _ = _turned(same, seen, plane, -turns)
                out.append((forward, _flipped(backward, sides, axis), tuple(seen)))
    return out


def view_sides(n: Sizes) -> list[tuple[int, int, int]]:
    """The sides of each view of a volume of sides n."""
    return [seen for _, _, seen in _view_maps(n)]


def _mapped(df: DataFrame, table: Column) -> DataFrame:
    """df with its coordinates through the map in `table`."""
    out = df.withColumn("map_", table)
    place = lambda i: sum(F.col("map_")[i][j] * F.col(a) for j, a in enumerate(AXES)) + F.col("map_")[i][3]
    return out.withColumns({a: place(i) for i, a in enumerate(AXES)}).drop("map_")


def _literal(rows: list[list[int]]) -> Column:
    return F.array(*[F.array(*map(F.lit, r)) for r in rows])


def views(df: DataFrame, n: Sizes) -> DataFrame:
    """Every view of a volume: flips none, y, x by quarter turns 0, 1, 2 about each axis, numbered;
    one explode over the table of their maps."""
    table = F.array(*[_literal(forward) for forward, _, _ in _view_maps(n)])
    out = df.withColumn("view", F.explode(F.sequence(F.lit(0), F.lit(26))))
    return _mapped(out, table[F.col("view")])


def unview(df: DataFrame, n: Sizes) -> DataFrame:
    """Views put back: turns undone, then the flip, by the inverse maps."""
    return _mapped(df, F.array(*[_literal(backward) for _, backward, _ in _view_maps(n)])[F.col("view")])


def view_average(df: DataFrame, value: str = "v") -> DataFrame:
    """(img, z, y, x, sum_v, n_views): sums over views at each voxel."""
    return df.groupBy("img", *AXES).agg(F.sum(value).alias("sum_v"), F.count("*").alias("n_views"))


def spline_window(side: int, power: int = 2) -> list[float]:
    """Profile of overlapping windows: rises and falls as a squared triangle, of mean one over half overlaps."""
    half = [(2 * (i + 0.5) / side) for i in range(side)]
    tri = [h if h <= 1 else 2 - h for h in half]
    raw = [(2 * t) ** power / 2 if t < 0.5 else 1 - (2 * (1 - t)) ** power / 2 for t in tri]
    mean = sum(raw) / side
    return [r / mean for r in raw]


def gauss_window(side: int, k: float = 2.608) -> list[float]:
    """A bell over the window, of width x0 / sqrt(8 k)."""
    a = 2 / (1 - math.exp(-k))
    return [a * math.exp(-((i - side / 2) ** 2) / (2 * side**2 / (8 * k))) + 2 - a for i in range(side)]


def window_3d(side: int, mode: str = "spline", power: int = 2) -> list[float]:
    """The product of a profile along three axes over its largest value, row-major."""
    if mode not in ("spline", "gaus"):
        raise ValueError(f"unknown window {mode!r}")
    w = spline_window(side, power) if mode == "spline" else gauss_window(side)
    top = max(w) ** 3
    return [a * b * c / top for a in w for b in w for c in w]


def raised_cosine(n: int) -> list[float]:
    return [0.5 - 0.5 * math.cos(math.pi * i / max(n - 1, 1)) for i in range(n)]


def poisson_noise(df: DataFrame, seed: int = 0, value: str = "v") -> DataFrame:
    """v drawn from a Poisson law of mean v, by a generator seeded with the image and its voxels' order.

    A kernel an image: draws depend on nothing but seed, image and voxel."""

    def run(pdf):
        import numpy as np

        pdf = pdf.sort_values(AXES)
        rng = np.random.default_rng([seed, int(pdf["img"].iloc[0]) & (2**63 - 1)])
        return pdf.assign(**{value: rng.poisson(pdf[value].clip(lower=0)).astype(pdf[value].dtype)})

    return df.groupBy("img").applyInPandas(run, df.schema)


def elastic(df: DataFrame, n: int, strength: float = 1.0, points: int = 3, seed: int = 0, value: str = "v") -> DataFrame:
    """(img, z, y, x, v): the volume sampled at places displaced by a random coarse grid of vectors,
    interpolated linearly between its points; a kernel an image."""
    from .field import _sample

    def run(pdf):
        import numpy as np
        import pandas as pd

        img = int(pdf["img"].iloc[0])
        rng = np.random.default_rng([seed, img & (2**63 - 1)])
        coarse = rng.normal(0, strength, (3, points, points, points))
        at = np.indices((n, n, n)).reshape(3, -1).astype(float)
        shift = _sample(coarse, at * (points - 1) / max(n - 1, 1))
        grid = np.zeros((3, n, n, n))
        z, y, x = (pdf[a].to_numpy() for a in AXES)
        grid[:, z, y, x] = pdf[value].to_numpy(float)
        sampled = _sample(grid, np.clip(at + shift, 0, n - 1))[0]
        z, y, x = at.astype(int)
        return pd.DataFrame({"img": img, "z": z, "y": y, "x": x, value: sampled})

    return df.select("img", *AXES, value).groupBy("img").applyInPandas(run, f"img long, z int, y int, x int, {value} double")
