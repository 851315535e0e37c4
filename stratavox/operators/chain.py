"""The augmentation chain with its parameters as columns.

A sample is a row: a dense image and its labels.  `parameters` draws every decision, angle, gain, factor and
place of a sample from hashes of its key as columns, which SQL can repeat, read and filter; a key of sample and epoch
gives other draws each epoch.  `augmented` then applies the chain of the live pipeline to rows, in its order
and without a shuffle: each sample is a few array operations in the task that has it.

Geometry moves image and labels alike (images linear, labels to the nearest cell, zero outside);
values change in the image only, which stays within 0 and 1 where the step says so.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .augment import chosen
from .neighbors import AXES, gaussian_weights
from .patch import mixed

#: The operations in their order.
CHAIN = ("downsample", "flip", "transpose", "brightness", "rotate", "zoom", "elastic", "noise", "blur")


@dataclass(frozen=True)
class ChainRules:
    """percent: of samples that are changed at all; coin: percent of these that take an operation; brightness: range of gain and
    of gamma; zoom: range of factors; degrees: rotation below; points, sigma: control points along an axis
    of the elastic grid, and their deviation in cells; only: operations in use."""

    percent: int = 75
    coin: int = 50
    brightness: tuple[float, float] = (0.8, 1.2)
    zoom: tuple[float, float] = (0.7, 1.2)
    degrees: float = 45.0
    points: int = 4
    sigma: float = 2.0
    seed: int = 0
    only: tuple[str, ...] = CHAIN


def parameters(key: Column, rules: ChainRules = ChainRules()) -> dict[str, Column]:
    """Columns by name: changed, do_<operation>, and what the operations draw."""
    drawn = lambda name: mixed(key, F.lit(name), salt=rules.seed)
    share = lambda name: drawn(name) / F.lit(4294967296.0)
    between = lambda name, low, high: low + share(name) * (high - low)
    changed = chosen(key, "changed", rules.seed, rules.percent)
    out = {"changed": changed} | {f"do_{k}": changed & chosen(key, k, rules.seed, rules.coin) if k in rules.only else F.lit(False) for k in CHAIN}
    out |= {f"step_{a}": (1 + drawn(f"step {a}") % 2).cast("int") for a in AXES}
    out |= {"flip_axis": (drawn("axis") % 3).cast("int"), "swap": drawn("swap") % 2 == 1}
    out |= {k: between(k, *rules.brightness) for k in ("gain", "gamma")} | {"degrees": between("degrees", 0.0, rules.degrees)}
    out |= {f"zoom_{a}": between(f"zoom {a}", *rules.zoom) for a in AXES} | {f"crop_{a}": share(f"crop {a}") for a in AXES}
    return out | {"elastic_seed": drawn("elastic seed"), "noise_seed": drawn("noise seed"), "sigma": share("sigma")}


def sampled(volume: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """Values at places at (3, ...): linear (order 1) or nearest (0); zero outside the cells' centres."""
    top = np.array(volume.shape).reshape(3, *([1] * (at.ndim - 1))) - 1
    ok = ((at >= 0) & (at <= top)).all(0)
    if order == 0:
        near = np.floor(at + 0.5).astype(np.int64)
        ok = ((near >= 0) & (near <= top)).all(0)
        return np.where(ok, volume[tuple(np.clip(near, 0, top))], 0)
    at = np.clip(at, 0, top)
    low = np.minimum(np.floor(at), np.maximum(top - 1, 0)).astype(np.int64)
    part, out = at - low, np.zeros(at.shape[1:])
    for corner in itertools.product((0, 1), repeat=3):
        w = np.prod([p if c else 1 - p for c, p in zip(corner, part, strict=True)], axis=0)
        place = tuple(np.minimum(x + c, t) for x, c, t in zip(low, corner, top, strict=True))
        out += w * volume[place]
    return np.where(ok, out, 0.0)


def affine(volume: np.ndarray, matrix: np.ndarray, order: int, centre: np.ndarray | None = None) -> np.ndarray:
    """The volume under an inverse map: each cell takes the value at matrix @ (cell - centre) + centre.
    matrix: 3 by 3, rotations about any axes and a scale an axis among it."""
    centre = (np.array(volume.shape) - 1) / 2 if centre is None else centre
    at = np.indices(volume.shape).reshape(3, -1) - centre[:, None]
    return sampled(volume, (matrix @ at + centre[:, None]), order).reshape(volume.shape)


def euler(z: float, y: float, x: float, scale: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> np.ndarray:
    """The map of rotations by degrees about z, then y, then x, and of a scale an axis."""
    out = np.diag(np.array(scale, float))
    for axis, degrees in ((0, z), (1, y), (2, x)):
        a, b = (i for i in range(3) if i != axis)
        turn, (c, s) = np.eye(3), (math.cos(math.radians(degrees)), math.sin(math.radians(degrees)))
        turn[a, a] = turn[b, b] = c
        turn[a, b], turn[b, a] = s, -s
        out = turn @ out
    return out


Pair = tuple[np.ndarray, np.ndarray]


def _downsample(image: np.ndarray, labels: np.ndarray, p: dict) -> Pair:
    at = [np.arange(n) - np.arange(n) % p[f"step_{a}"] for n, a in zip(image.shape, AXES, strict=True)]
    return image[np.ix_(*at)], labels


def _flip(image: np.ndarray, labels: np.ndarray, p: dict) -> Pair:
    return np.flip(image, p["flip_axis"]), np.flip(labels, p["flip_axis"])


def _transpose(image: np.ndarray, labels: np.ndarray, p: dict) -> Pair:
    """Rows for columns, where they are as many."""
    if not p["swap"] or image.shape[1] != image.shape[2]:
        return image, labels
    return image.swapaxes(1, 2), labels.swapaxes(1, 2)


def _brightness(image: np.ndarray, labels: np.ndarray, p: dict) -> Pair:
    return np.clip(np.sign(image) * p["gain"] * np.abs(image) ** p["gamma"], 0, 1), labels


def _rotate(image: np.ndarray, labels: np.ndarray, p: dict) -> Pair:
    m = euler(p["degrees"], 0, 0)
    return affine(image, m, 1), affine(labels, m, 0)


def _zoom(image: np.ndarray, labels: np.ndarray, p: dict) -> Pair:
    """Resized by axis, then padded evenly with zeros or cropped at a drawn place, image and labels alike."""
    for k, a in enumerate(AXES):
        n = image.shape[k]
        m = max(1, round(p[f"zoom_{a}"] * n))
        centre = (np.arange(m) + 0.5) * n / m
        at = np.clip(centre - 0.5, 0, n - 1)
        low = np.floor(at).astype(np.int64)
        part = (at - low).reshape([-1 if i == k else 1 for i in range(3)])
        image = np.take(image, low, k) * (1 - part) + np.take(image, np.minimum(low + 1, n - 1), k) * part
        labels = np.take(labels, np.minimum(np.floor(centre).astype(np.int64), n - 1), k)
        if m < n:
            width = [((n - m) // 2, n - m - (n - m) // 2) if i == k else (0, 0) for i in range(3)]
            image, labels = np.pad(image, width), np.pad(labels, width)
        elif m > n:
            start = int(p[f"crop_{a}"] * (m - n + 1))
            image, labels = (np.take(v, range(start, start + n), k) for v in (image, labels))
    return image, labels


def _elastic(image: np.ndarray, labels: np.ndarray, p: dict) -> Pair:
    """Cells take the values at places moved by a random grid of vectors, linear between its points."""
    grid = np.random.default_rng(int(p["elastic_seed"])).normal(0, p["elastic_sigma"], (3, *[p["elastic_points"]] * 3))
    at = np.indices(image.shape).astype(float)
    scale = np.array([(p["elastic_points"] - 1) / max(n - 1, 1) for n in image.shape]).reshape(3, 1, 1, 1)
    at = at + np.stack([sampled(g, at * scale, 1) for g in grid])
    return sampled(image, at, 1), sampled(labels, at, 0)


def _noise(image: np.ndarray, labels: np.ndarray, p: dict) -> Pair:
    """Poisson counts at as many levels as the image has values, up to a power of two."""
    levels = 2 ** math.ceil(math.log2(max(len(np.unique(image)), 1)))
    counts = np.random.default_rng(int(p["noise_seed"])).poisson(np.maximum(image, 0) * levels)
    return np.clip(counts / levels, 0, 1), labels


def _blur(image: np.ndarray, labels: np.ndarray, p: dict) -> Pair:
    weights = gaussian_weights(p["sigma"]) if p["sigma"] > 0 else [1.0]
    radius = len(weights) // 2
    for k in range(3):
        n = image.shape[k]
        wide = np.take(image, np.clip(np.arange(-radius, n + radius), 0, n - 1), k)
        image = sum(w * np.take(wide, range(i, i + n), k) for i, w in enumerate(weights))
    return image, labels


STEPS: dict[str, Callable[[np.ndarray, np.ndarray, dict], Pair]] = dict(zip(CHAIN, (_downsample, _flip, _transpose, _brightness, _rotate, _zoom, _elastic, _noise, _blur), strict=True))


def applied(image: np.ndarray, labels: np.ndarray, drawn: dict, rules: ChainRules = ChainRules()) -> Pair:
    """The steps that the drawn decisions name, on one sample."""
    drawn = drawn | {"elastic_sigma": rules.sigma, "elastic_points": rules.points}
    for name in CHAIN:
        if drawn[f"do_{name}"]:
            image, labels = STEPS[name](image, labels, drawn)
    return image, labels


def augmented(samples: DataFrame, shape: tuple[int, int, int], key: Column, rules: ChainRules = ChainRules(), image: str = "image", labels: str = "labels") -> DataFrame:
    """samples (arrays of the shape's cells, row-major) after the chain; other columns stay.  key: what names a sample's draws."""
    kept = samples.columns
    drawn = parameters(key, rules)
    # one packed column keeps the draws apart from the samples' own names
    packed = samples.withColumn("draws_", F.struct(*[c.alias(k) for k, c in drawn.items()]))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            draws = pdf["draws_"].tolist()
            done = []
            for v, w, p in zip(pdf[image], pdf[labels], draws, strict=True):
                if v is None or w is None or not p["changed"]:
                    done.append((v, w))
                    continue
                a, b = applied(np.asarray(v, float).reshape(shape), np.asarray(w).reshape(shape), p if isinstance(p, dict) else p.asDict(), rules)
                done.append((a.ravel().astype(np.float32), b.ravel()))
            yield pdf[kept].assign(**{image: pd.Series([a for a, _ in done], pdf.index, object), labels: pd.Series([b for _, b in done], pdf.index, object)})

    return packed.mapInPandas(run, samples.schema)


def dense_samples(voxels: DataFrame, value: Column, label: Column, by: tuple[str, ...] = ("img",)) -> DataFrame:
    """(by, image, labels): all voxels of a group in row-major arrays."""
    cells = F.array_sort(F.collect_list(F.struct(*AXES, value.cast("float").alias("v"), label.cast("int").alias("l"))))
    out = voxels.groupBy(*by).agg(cells.alias("cells"))
    return out.select(*by, F.transform("cells", lambda c: c["v"]).alias("image"), F.transform("cells", lambda c: c["l"]).alias("labels"))
