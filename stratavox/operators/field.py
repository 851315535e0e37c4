"""Vector fields: sampling, momentum integration, nearest seeds."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .groups import by_groups, starts
from .neighbors import AXES
from .patch import Sizes, by_axis


def endpoint_density(points: DataFrame) -> DataFrame:
    """(img, z, y, x, n): points that end at each voxel."""
    return points.groupBy("img", *AXES).agg(F.count("*").alias("n"))


def trilinear(points: DataFrame, field: DataFrame, scale: int, values: tuple[str, ...] = ("v",)) -> DataFrame:
    """Sums over the eight corners around fixed-point positions (in 1/scale voxels) of weight * value,
    in units of 1/scale**3; corners outside the field add nothing.

    points: (img, pid, pz, py, px) integers; an equi-join of eight rows a point with the field."""
    corners = list(itertools.product((0, 1), repeat=3))
    table = F.array(*[F.struct(*[F.lit(v).alias(a) for v, a in zip(c, AXES, strict=True)]) for c in corners])
    out = points.withColumn("corner_", F.explode(table))
    for a in AXES:
        low = F.floor(F.col(f"p{a}") / scale).cast("int")
        part = F.col(f"p{a}") - low * scale
        out = out.withColumn(a, low + F.col(f"corner_.{a}")).withColumn(f"w{a}_", F.when(F.col(f"corner_.{a}") == 1, part).otherwise(scale - part))
    w = F.col("wz_") * F.col("wy_") * F.col("wx_")
    out = out.withColumn("w_", w).filter("w_ > 0").select("img", "pid", *AXES, "w_")
    hit = out.join(field.select("img", *AXES, *values), ["img", *AXES])
    sums = hit.groupBy("img", "pid").agg(*[F.sum(F.col("w_") * F.col(v)).alias(f"{v}_sum") for v in values])
    every = points.select("img", "pid").join(sums, ["img", "pid"], "left")
    return every.select("img", "pid", *[F.coalesce(f"{v}_sum", F.lit(0)).alias(f"{v}_sum") for v in values])


def momentum_steps(points: DataFrame, field: DataFrame, steps: int) -> DataFrame:
    """Steps of d = (field + 4 d) / 5 truncated, pos += d, on integers with the nearest voxel's field.

    The relational form of the integrator for few steps: a join a step.  points: (img, pid, z, y, x, dz, dy, dx)."""
    out, fields = points, field.select("img", *AXES, *[F.col(f"f{a}") for a in AXES])
    for _ in range(steps):
        out = out.join(fields, ["img", *AXES], "left")
        for a in AXES:
            out = out.withColumn(f"d{a}", ((F.coalesce(f"f{a}", F.lit(0)) + 4 * F.col(f"d{a}")) / 5).cast("int"))
        out = out.select("img", "pid", *[(F.col(a) + F.col(f"d{a}")).alias(a) for a in AXES], *[f"d{a}" for a in AXES])
    return out


def _sample(grid: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Trilinear samples of grid (3, Z, Y, X) at pos (3, n); null outside."""
    shape = np.array(grid.shape[1:])[:, None]
    low = np.floor(pos).astype(np.int64)
    part = pos - low
    out = np.zeros_like(pos)
    for c in itertools.product((0, 1), repeat=3):
        at = low + np.array(c)[:, None]
        w = np.prod(np.where(np.array(c)[:, None] == 1, part, 1 - part), axis=0)
        ok = ((at >= 0) & (at < shape)).all(0)
        at = np.clip(at, 0, shape - 1)
        out += np.where(ok, w, 0.0) * grid[:, at[0], at[1], at[2]]
    return out


class Grids:
    """Vector fields of many boxes in one flat array, zero outside each box.

    low, shape: (3, n), the boxes' lowest cells and sides.  A row starts with two empty cells, a plane with two empty rows, a box with two
    empty planes and ends with three; what follows a row's end is the next one's start, so samples next to a box read zeros on every side."""

    def __init__(self, low: np.ndarray, shape: np.ndarray):
        self.low, self.shape = low, shape
        self.width = shape + np.array([[5], [2], [2]])
        size = self.width.prod(0)
        self.first = np.cumsum(size) - size
        self.vectors = np.zeros((3, int(size.sum())))

    def fill(self, owner: np.ndarray, cells: np.ndarray, vectors: np.ndarray) -> None:
        """The vectors (3, n) at cells (3, n), each in its owner's box."""
        if not np.isfinite(vectors).all():
            raise ValueError("vectors are finite numbers")
        z, y, x = cells - self.low[:, owner] + 2
        self.vectors[:, self.first[owner] + (z * self.width[1, owner] + y) * self.width[2, owner] + x] = vectors

    def advance(self, owner: np.ndarray, pos: np.ndarray, step: np.ndarray, done: np.ndarray, iterations: int, rate: float, momentum: float, within: tuple[np.ndarray, np.ndarray] | None = None, part: int = 8192) -> None:
        """Moves pos and step (3, n) by momentum steps of trilinear samples until `iterations` are done or a position leaves its box's bounds
        (low, high) of `within`, in place; `part` points at a time: enough that a call costs little a
        point, few enough that what a step touches stays in a cache."""
        for k in range(0, len(owner), part):
            at = np.s_[k : k + part]
            self._advance(owner[at], pos[:, at], step[:, at], done[at], iterations, rate, momentum, within)

    def _advance(self, owner, pos, step, done, iterations, rate, momentum, within) -> None:
        going = np.flatnonzero(done < iterations)
        while len(going):
            own = owner[going]
            p, s, n = pos[:, going], step[:, going], done[going]
            lowest, highest = self.low[:, own] - 2.0, (self.low + self.shape)[:, own].astype(float)
            row = self.width[2, own]
            plane = self.width[1, own] * row
            # flat places are whole numbers far below 2^53, so they are exact as floats
            first = (self.first[own] + 2 * (plane + row + 1) - self.low[0, own] * plane - self.low[1, own] * row - self.low[2, own]).astype(float)
            corners = (None, row, plane, plane + row)
            row, plane = row.astype(float), plane.astype(float)
            bounds = None if within is None else (within[0][:, own], within[1][:, own])
            part, rest, seen, v, inside, above = (np.empty(p.shape, k) for k in (float, float, float, float, bool, bool))
            at, w, wx = (np.empty(len(going)) for _ in range(3))
            base, index = np.empty(len(going), np.int64), np.empty(len(going), np.int64)
            alive = np.ones(len(going), bool)
            # those that are gone move on unread, until an eighth is gone
            while 8 * np.count_nonzero(alive) > 7 * len(going):
                np.floor(p, out=rest)
                np.subtract(p, rest, out=part)
                np.maximum(rest, lowest, out=rest)
                np.minimum(rest, highest, out=rest)
                np.multiply(rest[0], plane, out=at)
                np.multiply(rest[1], row, out=w)
                at += w
                at += rest[2]
                at += first
                np.copyto(base, at, casting="unsafe")
                np.subtract(1, part, out=rest)
                seen.fill(0)
                for corner, wz, wy in zip(corners, (rest[0], rest[0], part[0], part[0]), (rest[1], part[1], rest[1], part[1]), strict=True):
                    np.multiply(wz, wy, out=w)
                    places = base if corner is None else np.add(base, corner, out=index)
                    for dx, x in ((0, rest[2]), (1, part[2])):
                        if dx:
                            places = np.add(places, 1, out=index)
                        np.multiply(w, x, out=wx)
                        self.vectors.take(places, axis=1, out=v, mode="clip")
                        v *= wx
                        seen += v
                seen *= rate
                s *= momentum
                s += seen
                p += s
                n += 1
                stay = n < iterations
                if bounds is not None:
                    np.greater_equal(p, bounds[0], out=inside)
                    np.less(p, bounds[1], out=above)
                    inside &= above
                    for axis in range(3):
                        stay &= inside[axis]
                stay &= alive
                left = alive ^ stay
                if left.any():
                    gone = going[left]
                    pos[:, gone], step[:, gone], done[gone] = p[:, left], s[:, left], n[left]
                    alive = stay
            kept = going[alive]
            pos[:, kept], step[:, kept], done[kept] = p[:, alive], s[:, alive], n[alive]
            going = kept


def parts_of(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Runs of consecutive groups of at most `most` in all, or of one group."""
    begin, total = 0, 0
    for k, size in enumerate(sizes.tolist()):
        if k > begin and total + size > most:
            yield slice(begin, k)
            begin, total = k, 0
        total += size
    if len(sizes):
        yield slice(begin, len(sizes))


#: Cells of the boxes that a kernel holds at a time; a larger box is alone.
CELLS = 2_000_000


def integrate(field: DataFrame, iterations: int = 200, rate: float = 0.2, momentum: float = 0.8) -> DataFrame:
    """(img, vid, z, y, x, ez, ey, ex): where each foreground voxel of field(img, vid, z, y, x, uz, uy, ux)
    ends after a fixed number of momentum steps, truncated toward zero.

    An image's field fits a worker, so its steps run there on arrays, without a shuffle a step; small images go through together."""

    def run(table: pa.Table) -> pa.Table:
        first = starts(table, ["img"])
        counts = np.diff(first, append=len(table))
        at = np.stack([table[a].to_numpy() for a in AXES]).astype(np.int64)
        u = np.stack([table[f"u{a}"].to_numpy() for a in AXES]).astype(float)
        shape = np.maximum.reduceat(at, first, axis=1) + 1
        end = np.empty(at.shape, np.int32)
        for k in parts_of((shape + 2).prod(0), CELLS):
            rows = slice(first[k.start], first[k.stop - 1] + counts[k.stop - 1])
            owner = np.repeat(np.arange(k.stop - k.start), counts[k])
            grids = Grids(np.zeros_like(shape[:, k]), shape[:, k])
            grids.fill(owner, at[:, rows], u[:, rows])
            pos = at[:, rows].astype(float)
            grids.advance(owner, pos, np.zeros_like(pos), np.zeros(len(owner), np.int64), iterations, rate, momentum)
            end[:, rows] = np.trunc(pos)
        return table.select(["img", "vid", *AXES]).append_column("ez", pa.array(end[0])).append_column("ey", pa.array(end[1])).append_column("ex", pa.array(end[2]))

    columns = ["img", "vid", *AXES, *[f"u{a}" for a in AXES]]
    typed = field.select(*columns).withColumns({a: F.col(a).cast("int") for a in AXES} | {c: F.col(c).cast("long") for c in ("img", "vid")})
    return by_groups(typed, ["img"], run, "img long, vid long, z int, y int, x int, ez int, ey int, ex int")


def nearest_seed(points: DataFrame, seeds: DataFrame, radius: int = 5) -> DataFrame:
    """points(img, pid, z, y, x) with the label of the nearest seed(img, z, y, x, label) strictly within
    a radius; the lowest label of equals; 0 without one.

    A range join as an equi-join on cells of the radius's size: seeds are copied to the 27
    cells around their own, so each point looks in one."""
    cells = list(itertools.product((-1, 0, 1), repeat=3))
    cell = [F.floor(F.col(a) / radius).cast("int").alias(f"c{a}") for a in AXES]
    table = F.array(*[F.struct(*[F.lit(v).alias(a) for v, a in zip(c, AXES, strict=True)]) for c in cells])
    near = seeds.select("img", *[F.col(a).alias(f"s{a}") for a in AXES], "label", *cell).withColumn("o_", F.explode(table))
    near = near.select("img", *[(F.col(f"c{a}") + F.col(f"o_.{a}")).alias(f"c{a}") for a in AXES], *[f"s{a}" for a in AXES], "label")
    keyed = points.select("img", "pid", *AXES, *cell)
    d2 = sum((F.col(a) - F.col(f"s{a}")) * (F.col(a) - F.col(f"s{a}")) for a in AXES)
    found = keyed.join(near, ["img", *[f"c{a}" for a in AXES]]).withColumn("d2", d2).filter(F.col("d2") < radius * radius)
    best = found.groupBy("img", "pid").agg(F.min(F.struct("d2", "label")).alias("m"))
    out = points.select("img", "pid").join(best, ["img", "pid"], "left")
    return out.select("img", "pid", F.coalesce(F.col("m.label"), F.lit(0)).alias("label"), F.col("m.d2").alias("d2"))


def votes(df: DataFrame, vectors: tuple[str, str, str], bins: int, n: int) -> DataFrame:
    """(img, z, y, x, n): votes of voxels for the binned place that their vector points to (truncated);
    votes outside the binned volume are clipped to its faces."""
    top = (n - 1) // bins
    at = [F.least(F.greatest(((F.col(a) + F.col(d)) / bins).cast("int"), F.lit(0)), F.lit(top)).alias(a) for a, d in zip(AXES, vectors, strict=True)]
    return df.select("img", *at).groupBy("img", *AXES).agg(F.count("*").alias("n"))


def resample_linear(df: DataFrame, factor_num, factor_den: int | None, n: Sizes, value: str = "v", axes: tuple[str, ...] = tuple(AXES)) -> DataFrame:
    """The volume at n_out = n * num // den per axis by linear interpolation between the samples around
    (i + 0.5) * n / n_out - 0.5, edges held.  Without den, num is n_out itself, a number or a column (a size by image), or one
    for each axis.

    A sample adds to a short run of outputs, whose bounds follow by arithmetic."""
    n, num = by_axis(n), by_axis(factor_num)
    sizes = {a: num[a] if factor_den is None else n[a] * num[a] // factor_den for a in axes}
    held = {a: f"n_out_{a}_" for a in axes if isinstance(sizes[a], Column)}
    out = df.select("img", *AXES, F.col(value).cast("double").alias(value), *[sizes[a].cast("int").alias(c) for a, c in held.items()])
    for axis in axes:
        s, k, m = F.col(axis), n[axis], F.col(held[axis]) if axis in held else F.lit(sizes[axis])
        first = F.when(s == 0, 0).otherwise(F.floor((2 * m * (s - 1) + m - k) / (2.0 * k)))
        last = F.when(s == k - 1, m - 1).otherwise(F.ceil((2 * m * (s + 1) + m - k) / (2.0 * k)))
        first, last = F.greatest(first, F.lit(0)).cast("int"), F.least(last, m - 1).cast("int")
        spread = out.withColumn("t_", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))))
        p = F.least(F.greatest(((2 * F.col("t_") + 1) * k - m) / (2.0 * m), F.lit(0.0)), F.lit(k - 1.0))
        spread = spread.withColumn("w_", 1 - F.abs(p - s)).filter("w_ > 0")
        others = [a for a in AXES if a != axis]
        out = spread.groupBy("img", *others, *held.values(), F.col("t_").alias(axis)).agg(F.sum(F.col("w_") * F.col(value)).alias(value))
    return out.select("img", *AXES, value)


def resample_nearest(df: DataFrame, n: Sizes, n_out, axes: tuple[str, ...] = tuple(AXES)) -> DataFrame:
    """Each output voxel takes the sample at floor((i + 0.5) * n / n_out); n_out may be a column (a size by image), or one for each axis."""
    n, wanted = by_axis(n), by_axis(n_out)
    for axis in axes:
        k, m = n[axis], wanted[axis] if isinstance(wanted[axis], Column) else F.lit(wanted[axis])
        begin = lambda s, m=m, k=k: F.greatest(F.ceil((2 * m * s - k) / (2.0 * k)), F.lit(0)).cast("int")
        first, last = begin(F.col(axis)), F.least(begin(F.col(axis) + 1) - 1, m - 1).cast("int")
        df = df.withColumn(axis, F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))))
    return df


def shrunk_linear(df: DataFrame, n: Sizes, n_out: Sizes, value: str = "v") -> DataFrame:
    """resample_linear() behind a smoothing of (n / n_out - 1) / 2 deviations along the axes that shrink."""
    from .neighbors import gaussian_weights, smooth

    sides, wanted = by_axis(n), by_axis(n_out)
    for a in AXES:
        sigma = max(0.0, (sides[a] / wanted[a] - 1) / 2)
        if sigma > 0.125:
            df = smooth(df, n, gaussian_weights(sigma), integer=False, value=value, axes=(a,))
    return resample_linear(df, n_out, None, n, value)


def rescale_by_radius(df: DataFrame, n: Sizes, target: float, label: str = "label", value: str | None = None) -> DataFrame:
    """Labels (nearest) or, with value, intensities (linear) of each image at int(n * target / its mean object
    radius) cells along each axis; images without objects keep their size."""
    from .regions import mean_radius

    ratio = mean_radius(df, label).select("img", "radius")
    sized, wanted = df.join(ratio, "img", "left"), {}
    for a, k in by_axis(n).items():
        wanted[a] = f"n_out_{a}"
        sized = sized.withColumn(wanted[a], F.greatest(F.coalesce((F.lit(k) * F.lit(target) / F.col("radius")).cast("int"), F.lit(k)), F.lit(1)))
    sizes = tuple(F.col(wanted[a]) for a in AXES)
    if value:
        return resample_linear(sized, sizes, None, n, value)
    return resample_nearest(sized, n, sizes).drop("radius", *wanted.values())


def _spline_coefficients(grid: np.ndarray) -> np.ndarray:
    """Cubic B-spline coefficients of samples along the last three axes, mirrored at the ends."""
    pole = np.sqrt(3.0) - 2.0
    out = grid.astype(float)
    for axis in range(out.ndim - 3, out.ndim):
        x = np.moveaxis(out, axis, 0).copy()
        n = len(x)
        if n == 1:
            continue
        x *= (1 - pole) * (1 - 1 / pole)
        powers = pole ** np.arange(2 * n - 2)
        mirror = np.concatenate([x, x[-2:0:-1]])
        x[0] = np.tensordot(powers, mirror, 1) / (1 - pole ** (2 * n - 2))
        for i in range(1, n):
            x[i] += pole * x[i - 1]
        x[-1] = pole / (pole * pole - 1) * (x[-1] + pole * x[-2])
        for i in range(n - 2, -1, -1):
            x[i] = pole * (x[i + 1] - x[i])
        out = np.moveaxis(x, 0, axis)
    return out


def _sample_cubic(coefficients: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Cubic spline samples at pos (3, n); zero outside the volume."""
    shape = np.array(coefficients.shape[1:])[:, None]
    low = np.floor(pos).astype(np.int64)
    t = pos - low
    weights = np.stack([(1 - t) ** 3 / 6, (3 * t**3 - 6 * t**2 + 4) / 6, (-3 * t**3 + 3 * t**2 + 3 * t + 1) / 6, t**3 / 6])
    out = np.zeros((len(coefficients), pos.shape[1]))
    for c in itertools.product(range(4), repeat=3):
        at = low + np.array(c)[:, None] - 1
        at = np.abs(at)  # mirrored at the first and last sample
        at = np.where(at >= shape, 2 * (shape - 1) - at, at)
        at = np.clip(at, 0, shape - 1)
        out += weights[c[0], 0] * weights[c[1], 1] * weights[c[2], 2] * coefficients[:, at[0], at[1], at[2]]
    return np.where(((pos >= 0) & (pos <= shape - 1)).all(0), out, 0.0)


def cubic(points: DataFrame, volume: DataFrame, n: int, value: str = "v") -> DataFrame:
    """points(img, pid, pz, py, px) with the cubic spline through an n-sided volume there (0 outside); a kernel an image."""

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((1, n, n, n))
        grid[0, right["z"], right["y"], right["x"]] = right[value].to_numpy(float)
        pos = left[["pz", "py", "px"]].to_numpy(float).T
        return left[["img", "pid"]].assign(**{value: _sample_cubic(_spline_coefficients(grid), pos)[0]})

    own = points.select("img", "pid", "pz", "py", "px")
    return own.groupBy("img").cogroup(volume.select("img", *AXES, value).groupBy("img")).applyInPandas(run, f"img long, pid long, {value} double")


def descend(field: DataFrame, n: int, iterations: int = 200, rate: float = 0.1, tolerance: float = 1e-6, start: str | None = None) -> DataFrame:
    """(img, vid, step, z, y, x): positions after each step of plain descent through the cubic spline of
    field(img, vid, z, y, x, uz, uy, ux); a point leaves when its step is tolerance or less.  start: a
    boolean column that marks the starting voxels (all).  A kernel an image; points are independent,
    so images may be cut into parts that share the field."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf[AXES].to_numpy(np.int64).T
        grid = np.zeros((3, n, n, n))
        grid[:, at[0], at[1], at[2]] = pdf[[f"u{a}" for a in AXES]].to_numpy(float).T
        spline = _spline_coefficients(grid)
        mine = pdf[start].to_numpy(bool) if start else np.ones(len(pdf), bool)
        vid, pos, rows = pdf["vid"].to_numpy()[mine], at[:, mine].astype(float), []
        for step in range(1, iterations + 1):
            move = rate * _sample_cubic(spline, pos)
            going = np.sqrt((move**2).sum(0)) > tolerance
            vid, pos = vid[going], (pos + move)[:, going]
            rows.append(pd.DataFrame({"vid": vid, "step": step, "z": pos[0], "y": pos[1], "x": pos[2]}))
            if not len(vid):
                break
        out = pd.concat(rows) if rows else pd.DataFrame({"vid": [], "step": [], "z": [], "y": [], "x": []})
        return out.assign(img=pdf["img"].iloc[0])[["img", "vid", "step", *AXES]]

    columns = ["img", "vid", *AXES, *[f"u{a}" for a in AXES], *([start] if start else [])]
    return field.select(*columns).groupBy("img").applyInPandas(run, "img long, vid long, step int, z double, y double, x double")


def scored(blocks: DataFrame, predict, schema: str) -> DataFrame:
    """blocks through an opaque batch scorer: predict(DataFrame) -> DataFrame, in Arrow batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield predict(pdf)

    return blocks.mapInPandas(run, schema)


def scored_or_failed(blocks: DataFrame, predict, schema: str) -> DataFrame:
    """scored() row by row with a column `error`: a row that predict fails on has its message and nulls."""
    names = [f.name for f in blocks.sparkSession.createDataFrame([], schema).schema]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for i in range(len(pdf)):
                one = pdf.iloc[i : i + 1]
                try:
                    yield predict(one).assign(error=None)
                except Exception as e:  # noqa: BLE001  the message is the row's result
                    yield pd.DataFrame({c: [one[c].iloc[0] if c in one else None] for c in names}).assign(error=f"{type(e).__name__}: {e}")

    return blocks.mapInPandas(run, schema + ", error string")
