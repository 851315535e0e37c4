"""Restoration of planes: deconvolution without given noise levels, and alignment of interlaced rows.

A plane is in one task, so the planes of a volume spread over tasks; small planes are aligned many at a time; what a plane draws is keyed by its image
and number, so results do not depend on where it runs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .groups import by_groups, starts
from .neighbors import AXES


def point_spread(shape: tuple[int, int], width: float) -> np.ndarray:
    """The transfer function of a Gaussian of a width in cells over a plane that wraps around."""
    far = [np.minimum(np.arange(n), n - np.arange(n)) for n in shape]
    spread = np.exp(-0.5 * (far[0][:, None] ** 2 + far[1][None, :] ** 2) / width**2)
    return np.fft.fft2(spread / spread.sum())


def gibbs_wiener(plane: np.ndarray, transfer: np.ndarray, seed: list[int], steps: int = 200, burn: int = 30, tolerance: float = 1e-4) -> tuple[np.ndarray, float, float, int]:
    """(restored plane, noise precision, signal precision, steps taken).

    The model: the plane is a signal, blurred, plus white noise of unknown precision; the signal's second differences are white
    of unknown precision too.  All three are drawn in turn from their conditionals: the signal, whose
    frequencies are independent Gaussians, then each precision from a Gamma law.  After `burn` steps the signals' mean is
    the estimate; drawing ends when a step moves the mean by less than `tolerance` of it."""
    rng = np.random.default_rng(seed)
    n = plane.size
    seen = np.fft.fft2(plane, norm="ortho")
    bend = np.zeros(plane.shape)
    for (y, x), w in {(0, 0): 4, (0, 1): -1, (0, -1): -1, (1, 0): -1, (-1, 0): -1}.items():
        bend[y % plane.shape[0], x % plane.shape[1]] += w  # a plane of one row or column bends along the other only
    rough, gain = np.abs(np.fft.fft2(bend)) ** 2, np.abs(transfer) ** 2
    noise, signal, mean, last = 1.0, 1.0, np.zeros(plane.shape, complex), None
    precisions = []
    for step in range(1, steps + 1):
        precision = noise * gain + signal * rough + 1e-12
        # real white noise keeps the spectrum that of a real plane
        drawn = np.fft.fft2(rng.standard_normal(plane.shape), norm="ortho") / np.sqrt(precision)
        sample = noise * np.conj(transfer) * seen / precision + drawn
        noise = rng.gamma(n / 2, 2 / max((np.abs(seen - transfer * sample) ** 2).sum(), 1e-30))
        signal = rng.gamma((n - 1) / 2, 2 / max((rough * np.abs(sample) ** 2).sum(), 1e-30))
        if step <= burn:
            continue
        precisions.append((noise, signal))
        k = step - burn
        last, mean = mean, mean + (sample - mean) / k
        size = np.abs(mean).sum()
        if k > 1 and np.abs(mean - last).sum() <= tolerance * size:
            break
    noise, signal = np.mean(precisions, axis=0)
    return np.fft.ifft2(mean, norm="ortho").real, float(noise), float(signal), step


def _dense(pdf: pd.DataFrame, shape: tuple[int, int], value: str) -> np.ndarray:
    plane = np.zeros(shape)
    plane[pdf["y"].to_numpy(), pdf["x"].to_numpy()] = pdf[value].to_numpy(float)
    return plane


def _sparse(plane: np.ndarray, img: int, z: int, value: str) -> pd.DataFrame:
    y, x = (c.ravel() for c in np.indices(plane.shape))
    return pd.DataFrame({"img": img, "z": z, "y": y, "x": x, value: plane.ravel()})


def unsupervised_wiener(df: DataFrame, shape: tuple[int, int], width: float = 1.0, steps: int = 200, burn: int = 30, tolerance: float = 1e-4, seed: int = 0, value: str = "v") -> DataFrame:
    """(img, z, y, x, v, noise): each plane (rows, columns of `shape`) deconvolved with a Gaussian of a width, the levels
    of noise and signal drawn with it; noise: the plane's noise precision."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        img, z = int(pdf["img"].iloc[0]), int(pdf["z"].iloc[0])
        key = [seed, img & (2**63 - 1), z & (2**63 - 1)]
        out, noise, _, _ = gibbs_wiener(_dense(pdf, shape, value), point_spread(shape, width), key, steps, burn, tolerance)
        return _sparse(out, img, z, value).assign(noise=noise)

    return df.select("img", *AXES, value).groupBy("img", "z").applyInPandas(run, f"img long, z int, y int, x int, {value} double, noise double")


# ---- rows ------------------------------------------------------------------------------


def _between(plane: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Bilinear samples, edges held; planes (..., rows, columns) are sampled each at its places."""
    rows, columns = plane.shape[-2:]
    y, x = np.clip(y, 0, rows - 1), np.clip(x, 0, columns - 1)
    a, b = np.floor(y).astype(int), np.floor(x).astype(int)
    c, d = np.minimum(a + 1, rows - 1), np.minimum(b + 1, columns - 1)
    p, q = y - a, x - b
    if plane.ndim == 2:
        of = lambda i, j: plane[i, j]
    else:
        flat = plane.reshape(-1)
        first = (np.arange(flat.size // (rows * columns)) * (rows * columns)).reshape(*plane.shape[:-2], 1, 1)
        of = lambda i, j: flat[first + i * columns + j]
    return (1 - p) * ((1 - q) * of(a, b) + q * of(a, d)) + p * ((1 - q) * of(c, b) + q * of(c, d))


def _halved(plane: np.ndarray) -> np.ndarray:
    y, x = (n // 2 * 2 for n in plane.shape[-2:])
    return plane[..., :y, :x].reshape(*plane.shape[:-2], y // 2, 2, x // 2, 2).mean((-3, -1))


def _mean4(v: np.ndarray) -> np.ndarray:
    """The mean of a cell's four neighbours, edges held (the last two axes)."""
    up, down, left, right = (np.empty_like(v) for _ in range(4))
    up[..., 1:, :], up[..., :1, :] = v[..., :-1, :], v[..., :1, :]
    down[..., :-1, :], down[..., -1:, :] = v[..., 1:, :], v[..., -1:, :]
    left[..., 1:], left[..., :1] = v[..., :-1], v[..., :1]
    right[..., :-1], right[..., -1:] = v[..., 1:], v[..., -1:]
    return (up + down + left + right) / 4


def flow(first: np.ndarray, second: np.ndarray, smoothness: float = 0.02, warps: int = 6, rounds: int = 60) -> np.ndarray:
    """(2, ..., rows, columns): how far each cell of `first` has moved in `second`, down and right: second(cell + flow) is near first(cell).
    Planes (..., rows, columns) are solved together, each as if alone.

    From coarse to fine: a field is solved for on halved planes, doubled, and refined by linear steps about the
    warped plane, in which brightness stays and neighbours move alike (weight `smoothness` of a plane's squared range)."""
    inside = (-2, -1)
    low = np.minimum(*[p.min(inside, keepdims=True) for p in (first, second)])
    high = np.maximum(*[p.max(inside, keepdims=True) for p in (first, second)])
    flat = high <= low
    size = np.where(flat, 1.0, high - low)
    levels = [((first - low) / size, (second - low) / size)]
    while min(levels[-1][0].shape[-2:]) >= 16:
        levels.append(tuple(map(_halved, levels[-1])))
    moved = np.zeros((2, *levels[-1][0].shape))
    for a, b in reversed(levels):
        y, x = np.indices(a.shape[-2:])
        if moved.shape[-2:] != a.shape[-2:]:
            moved = np.stack([2 * _between(m, (y - 0.5) / 2, (x - 0.5) / 2) for m in moved])
        for _ in range(warps):
            start = moved
            warped = _between(b, y + start[0], x + start[1])
            slope = [(s + t) / 2 for s, t in zip(np.gradient(warped, axis=inside), np.gradient(a, axis=inside), strict=True)] if min(a.shape[-2:]) > 1 else [np.zeros(a.shape)] * 2
            rest, weight = warped - a, smoothness + slope[0] ** 2 + slope[1] ** 2
            for _ in range(rounds):
                mean = _mean4(moved)
                off = (slope[0] * (mean[0] - start[0]) + slope[1] * (mean[1] - start[1]) + rest) / weight
                moved = np.stack([mean[0] - slope[0] * off, mean[1] - slope[1] * off])
    return np.where(flat, 0.0, moved)


def _stretched(plane: np.ndarray) -> list[np.ndarray]:
    """The even and the odd rows, either at all rows."""
    y, x = np.indices(plane.shape[-2:])
    return [_between(plane[..., k::2, :], (y + 0.5) / 2 - 0.5, x) for k in (0, 1)]


def aligned(plane: np.ndarray) -> np.ndarray:
    """Planes (..., rows, columns) whose even and odd rows were taken on different ways, brought together: either half is stretched to all
    rows, both are moved half of the way to each other, and rows are taken from them in turn.  A last odd row out goes."""
    plane = plane[..., : plane.shape[-2] // 2 * 2, :]
    if not plane.size:
        return plane
    y, x = np.indices(plane.shape[-2:])
    halves = _stretched(plane)
    moved = flow(*halves)
    back, forth = _between(halves[0], y - moved[0] / 2, x - moved[1] / 2), _between(halves[1], y + moved[0] / 2, x + moved[1] / 2)
    return np.where(y % 2 == 0, back, forth)


#: Cells of the planes that are solved together: what a round touches stays in a cache.
TOGETHER = 8_192


def _by_planes(df: DataFrame, shape: tuple[int, int], value: str, run: Callable[[np.ndarray], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """run(planes (n, rows, columns)) -> columns, each of n equal parts, over df's planes; rows begin with img and z."""

    def kernel(table: pa.Table) -> pa.Table:
        first = starts(table, ["img", "z"])
        counts = np.diff(first, append=len(table))
        keys = table.select(["img", "z"]).take(pa.array(first))
        y, x, v = (table[c].to_numpy() for c in ("y", "x", value))
        found, n = [], max(1, TOGETHER // max(1, shape[0] * shape[1]))
        for k in range(0, len(first), n):
            mine = counts[k : k + n]
            rows = slice(first[k], first[k] + mine.sum())
            planes = np.zeros((len(mine), *shape))
            planes[np.repeat(np.arange(len(mine)), mine), y[rows], x[rows]] = v[rows]
            out = run(planes)
            each = len(next(iter(out.values()))) // len(mine)
            of = keys.take(pa.array(np.repeat(np.arange(k, k + len(mine)), each)))
            found.append(pa.table({"img": of["img"], "z": of["z"], **{c: pa.array(a) for c, a in out.items()}}))
        return pa.concat_tables(found)

    typed = df.select(F.col("img").cast("long").alias("img"), *[F.col(a).cast("int").alias(a) for a in AXES], F.col(value).cast("double").alias(value))
    return by_groups(typed, ["img", "z"], kernel, f"img long, z int, {schema}")


def align_rows(df: DataFrame, shape: tuple[int, int], value: str = "v") -> DataFrame:
    """(img, z, y, x, v): aligned() planes (rows, columns of `shape`) of each volume."""

    def run(planes: np.ndarray) -> dict[str, np.ndarray]:
        out = aligned(planes)
        y, x = (np.tile(c.ravel(), len(out)).astype(np.int32) for c in np.indices(out.shape[1:]))
        return {"y": y, "x": x, value: out.ravel()}

    return _by_planes(df, shape, value, run, f"y int, x int, {value} double")


def interlaced_shift(df: DataFrame, shape: tuple[int, int], value: str = "v") -> DataFrame:
    """(img, z, down, right): the mean flow between the even and the odd rows of each plane."""

    def run(planes: np.ndarray) -> dict[str, np.ndarray]:
        moved = flow(*_stretched(planes[:, : shape[0] // 2 * 2]))
        return {"down": moved[0].mean((1, 2)), "right": moved[1].mean((1, 2))}

    return _by_planes(df, shape, value, run, "down double, right double")
