"""The augmentation chain against a cell-by-cell version, and its draws."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratavox.operators import chain
from stratavox.operators.neighbors import AXES


def at(volume, place, order):
    """Value of a volume at a real place; zero outside."""
    shape = volume.shape
    if order == 0:
        near = [math.floor(p + 0.5) for p in place]
        return volume[tuple(near)] if all(0 <= p < n for p, n in zip(near, shape, strict=True)) else 0
    if not all(0 <= p <= n - 1 for p, n in zip(place, shape, strict=True)):
        return 0.0
    low, total = [math.floor(p) for p in place], 0.0
    for c in itertools.product((0, 1), repeat=3):
        w = math.prod((p - q) if k else 1 - (p - q) for k, p, q in zip(c, place, low, strict=True))
        if w:
            total += w * volume[tuple(q + k for q, k in zip(low, c, strict=True))]
    return total


def plain_step(name, v, w, p):
    shape = v.shape
    each = lambda f, like: np.array([f(i) for i in np.ndindex(shape)], like.dtype).reshape(shape)
    if name == "downsample":
        return each(lambda i: v[tuple(c - c % p[f"step_{a}"] for c, a in zip(i, AXES, strict=True))], v), w
    if name == "flip":
        k = p["flip_axis"]
        turn = lambda i: tuple(shape[j] - 1 - c if j == k else c for j, c in enumerate(i))
        return each(lambda i: v[turn(i)], v), each(lambda i: w[turn(i)], w)
    if name == "transpose":
        if not p["swap"] or shape[1] != shape[2]:
            return v, w
        return each(lambda i: v[i[0], i[2], i[1]], v), each(lambda i: w[i[0], i[2], i[1]], w)
    if name == "brightness":
        return each(lambda i: min(1.0, max(0.0, math.copysign(1, v[i]) * p["gain"] * abs(v[i]) ** p["gamma"] if v[i] else 0.0)), v), w
    if name == "rotate":
        c, s, my, mx = math.cos(math.radians(p["degrees"])), math.sin(math.radians(p["degrees"])), (shape[1] - 1) / 2, (shape[2] - 1) / 2
        place = lambda i: (i[0], c * (i[1] - my) + s * (i[2] - mx) + my, -s * (i[1] - my) + c * (i[2] - mx) + mx)
        return each(lambda i: at(v, place(i), 1), v), each(lambda i: at(w, place(i), 0), w)
    if name == "zoom":
        sizes = [max(1, round(p[f"zoom_{a}"] * n)) for a, n in zip(AXES, shape, strict=True)]
        starts = [int(p[f"crop_{a}"] * (m - n + 1)) if m > n else -((n - m) // 2) for a, m, n in zip(AXES, sizes, shape, strict=True)]
        value = lambda i, order: _zoomed(v if order else w, [c + s for c, s in zip(i, starts, strict=True)], sizes, order)
        return each(lambda i: value(i, 1), v), each(lambda i: value(i, 0), w)
    if name == "elastic":
        grid = np.random.default_rng(int(p["elastic_seed"])).normal(0, 2.0, (3, 4, 4, 4))
        moved = lambda i: [c + at(g, [min(x * 3 / max(n - 1, 1), 3.0) for x, n in zip(i, shape, strict=True)], 1) for c, g in zip(i, grid, strict=True)]
        return each(lambda i: at(v, moved(i), 1), v), each(lambda i: at(w, moved(i), 0), w)
    if name == "noise":
        levels = 2 ** math.ceil(math.log2(len(set(v.ravel().tolist()))))
        counts = np.random.default_rng(int(p["noise_seed"])).poisson([max(x, 0) * levels for x in v.ravel().tolist()])
        return np.minimum(counts.reshape(shape) / levels, 1.0), w
    radius = int(4 * p["sigma"] + 0.5)
    taps = [math.exp(-0.5 * (k / p["sigma"]) ** 2) for k in range(-radius, radius + 1)]
    for k in range(3):
        edge = lambda i, d, k=k: tuple(min(max(c + d, 0), shape[j] - 1) if j == k else c for j, c in enumerate(i))
        v = each(lambda i, v=v, edge=edge: sum(t / sum(taps) * v[edge(i, d)] for d, t in zip(range(-radius, radius + 1), taps, strict=True)), v)
    return v, w


def _zoomed(volume, cell, sizes, order):
    if not all(0 <= c < m for c, m in zip(cell, sizes, strict=True)):
        return 0
    centre = [(c + 0.5) * n / m for c, m, n in zip(cell, sizes, volume.shape, strict=True)]
    if order == 0:
        return volume[tuple(min(math.floor(c), n - 1) for c, n in zip(centre, volume.shape, strict=True))]
    return at(volume, [min(max(c - 0.5, 0), n - 1) for c, n in zip(centre, volume.shape, strict=True)], 1)


@pytest.fixture(scope="module")
def drawn(spark):
    return [r.asDict() for r in spark.range(1000).select("id", *[c.alias(k) for k, c in chain.parameters(F.col("id")).items()]).collect()]


def test_a_quarter_stays_and_coins_are_even(drawn):
    changed = [p for p in drawn if p["changed"]]
    assert 0.70 < len(changed) / len(drawn) < 0.80
    assert not any(p[f"do_{k}"] for p in drawn if not p["changed"] for k in chain.CHAIN)
    for k in chain.CHAIN:
        assert 0.43 < sum(p[f"do_{k}"] for p in changed) / len(changed) < 0.57
    assert all(0.8 <= p["gain"] <= 1.2 and 0.7 <= p["zoom_y"] <= 1.2 and 0 <= p["degrees"] < 45 and 0 <= p["sigma"] < 1 for p in drawn)
    assert {p["flip_axis"] for p in drawn} == {0, 1, 2} and {p["step_x"] for p in drawn} == {1, 2}


def test_order_is_that_of_training():
    assert chain.CHAIN == ("downsample", "flip", "transpose", "brightness", "rotate", "zoom", "elastic", "noise", "blur")
    assert tuple(chain.STEPS) == chain.CHAIN


@pytest.mark.parametrize("shape", [(4, 6, 6), (3, 5, 7), (1, 4, 4)])
@pytest.mark.parametrize("name", chain.CHAIN)
def test_each_step_equals_a_plain_version(drawn, name, shape):
    rng = np.random.default_rng(1)
    for p in drawn[:4]:
        v, w = rng.random(shape), rng.integers(0, 5, shape)
        p = p | {"elastic_sigma": 2.0, "elastic_points": 4}
        found, wanted = chain.STEPS[name](v, w, p), plain_step(name, v, w, p)
        assert np.allclose(found[0], wanted[0], atol=1e-9) and (found[1] == wanted[1]).all() and found[0].shape == shape


def test_rows_go_through_the_chain_by_their_own_draws(spark, drawn):
    shape, rng = (3, 4, 4), np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.float32(rng.random(48))], [int(x) for x in rng.integers(0, 3, 48)], "kept") for i in range(40)] + [(40, None, None, None)]
    df = spark.createDataFrame(rows, "id long, image array<float>, labels array<int>, do_flip string").repartition(3)
    out = {r.id: r for r in chain.augmented(df, shape, F.col("id")).collect()}
    assert len(out) == 41 and out[40].image is None
    for i, v, w, _ in rows[:-1]:
        a, b = np.array(v).reshape(shape), np.array(w).reshape(shape)
        for name in chain.CHAIN:
            if drawn[i][f"do_{name}"]:
                a, b = plain_step(name, a, b, drawn[i])
        assert np.allclose(out[i].image, a.ravel(), atol=1e-5) and out[i].labels == b.ravel().tolist() and out[i].do_flip == "kept"
        if not drawn[i]["changed"]:
            assert out[i].image == v


def test_another_epoch_draws_anew(spark):
    key = lambda epoch: F.concat_ws("/", F.col("id"), F.lit(epoch))
    rows = spark.range(200).select(*[chain.parameters(key(e))["do_flip"].alias(f"e{e}") for e in (0, 1)]).collect()
    assert 40 < sum(r.e0 != r.e1 for r in rows) < 130


def test_affine_maps_with_a_scale_an_axis():
    """Whole turns are exact, scales stretch about the middle, and turns about the axes combine."""
    v = np.arange(5 * 5 * 5, dtype=float).reshape(5, 5, 5)
    assert np.allclose(chain.affine(v, chain.euler(90, 0, 0), 1), np.rot90(v, -1, (1, 2))) or np.allclose(chain.affine(v, chain.euler(90, 0, 0), 1), np.rot90(v, 1, (1, 2)))
    assert (chain.affine(v, chain.euler(0, 0, 0), 0) == v).all()
    half = chain.affine(v, chain.euler(0, 0, 0, (0.5, 1, 1)), 1)
    assert np.allclose(half[:, 2, 2], [at(v, (2 + 0.5 * (z - 2), 2, 2), 1) for z in range(5)])
    m = chain.euler(20, 30, 40, (1.1, 0.9, 0.8))
    found = chain.affine(v, m, 1)
    assert np.allclose(found.ravel(), [at(v, m @ (np.array(i) - 2) + 2, 1) for i in np.ndindex(5, 5, 5)])
