"""Deconvolution, row alignment, the training input and substring joins."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratavox.operators import chain, prep, restore
from stratavox.streaming import training


def bumps(shape, seed=0, n=14, width=3.0):
    rng = np.random.default_rng(seed)
    y, x = np.indices(shape)
    return sum(rng.uniform(0.5, 1) * np.exp(-((y - rng.uniform(0, shape[0])) ** 2 + (x - rng.uniform(0, shape[1])) ** 2) / (2 * width**2)) for _ in range(n))


@pytest.mark.parametrize("sigma", [0.02, 0.1])
def test_wiener_finds_a_planted_noise_level(sigma):
    clean = bumps((64, 48))
    transfer = restore.point_spread(clean.shape, 1.5)
    seen = np.fft.ifft2(np.fft.fft2(clean) * transfer).real + np.random.default_rng(1).normal(0, sigma, clean.shape)
    out, noise, signal, steps = restore.gibbs_wiener(seen, transfer, [3])
    assert abs(noise**-0.5 / sigma - 1) < 0.1 and signal > 0 and steps <= 200
    assert ((out - clean) ** 2).mean() < 0.5 * ((seen - clean) ** 2).mean()


def test_wiener_by_plane(spark):
    planes = {(i, z): np.fft.ifft2(np.fft.fft2(bumps((16, 24), z)) * restore.point_spread((16, 24), 1.0)).real + np.random.default_rng([i, z]).normal(0, 0.05, (16, 24)) for i in (0, 1) for z in (0, 1, 2)}
    data = [(i, z, int(y), int(x), float(v[y, x])) for (i, z), v in planes.items() for y, x in np.ndindex(v.shape)]
    df = spark.createDataFrame(data, "img long, z int, y int, x int, v double")
    first = {tuple(r[:4]): (r.v, r.noise) for r in restore.unsupervised_wiener(df, (16, 24)).collect()}
    again = {tuple(r[:4]): (r.v, r.noise) for r in restore.unsupervised_wiener(df.repartition(5), (16, 24)).collect()}
    assert first == again and len(first) == len(data)
    for (i, z), v in planes.items():
        out, noise, _, _ = restore.gibbs_wiener(v, restore.point_spread((16, 24), 1.0), [0, i, z])
        assert first[i, z, 3, 5] == (pytest.approx(out[3, 5]), pytest.approx(noise))


@pytest.mark.parametrize("shift", [(0, 3), (2, -4), (0, 0), (-1.5, 2.5)])
def test_flow_gives_planted_shifts_back(shift):
    wide = bumps((80, 96), n=60, width=4.0)
    y, x = np.indices((64, 64))
    first = restore._between(wide, y + 8.0, x + 16.0)
    second = restore._between(wide, y + 8.0 - shift[0], x + 16.0 - shift[1])
    moved = restore.flow(first, second)
    inner = (slice(8, -8), slice(8, -8))
    assert np.abs(moved[0][inner] - shift[0]).mean() < 0.5 and np.abs(moved[1][inner] - shift[1]).mean() < 0.5


def test_interlaced_rows_come_together(spark):
    clean = bumps((64, 64), n=40, width=5.0)
    y, x = np.indices(clean.shape)
    torn = np.where(y % 2 == 0, restore._between(clean, y, x - 2.0), restore._between(clean, y, x + 2.0))
    data = [(5, 1, int(a), int(b), float(torn[a, b])) for a, b in np.ndindex(torn.shape)]
    df = spark.createDataFrame(data, "img long, z int, y int, x int, v double")
    out = np.zeros(torn.shape)
    for r in restore.align_rows(df, torn.shape).collect():
        out[r.y, r.x] = r.v
    inner = (slice(8, -8), slice(8, -8))
    assert ((out - clean)[inner] ** 2).mean() < 0.25 * ((torn - clean)[inner] ** 2).mean()
    assert restore.interlaced_shift(df, torn.shape).first().right == pytest.approx(-4, abs=1)
    assert (restore.aligned(np.ones((5, 4))) == 1).all() and restore.aligned(np.ones((5, 4))).shape == (4, 4)


@pytest.mark.parametrize("shape", [(10, 10), (33, 40), (2, 5)])
def test_planes_solved_together_equal_each_alone(spark, shape):
    """Many planes go through a call of the solver, one of them without contrast; each comes out as alone."""
    rng = np.random.default_rng(2)
    planes = rng.normal(size=(9, *shape))
    planes[3] = 2.0
    alone = np.stack([restore.aligned(p) for p in planes])
    assert np.array_equal(restore.aligned(planes), alone)
    data = [(i // 3, i % 3, int(a), int(b), float(planes[i, a, b])) for i, a, b in np.ndindex(planes.shape)]
    df = spark.createDataFrame(data, "img long, z int, y int, x int, v double")
    aligned = restore.align_rows(df, shape)
    found = {tuple(r[:4]): r.v for r in aligned.collect()}
    assert found == {(i // 3, i % 3, a, b): alone[i, a, b] for i, a, b in np.ndindex(alone.shape)}
    assert "FlatMap" not in aligned._jdf.queryExecution().executedPlan().toString()


# ---- training input --------------------------------------------------------------------


SHAPE = (2, 4, 4)


@pytest.fixture(scope="module")
def patches(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.float32(rng.random(32))], [int(x) for x in np.repeat([0, 1 + i % 3], [8, 24])]) for i in range(230)]
    return spark.createDataFrame(rows, "patch_id long, image array<float>, labels array<int>").repartition(6).cache()


def test_order_is_mixed_whole_and_repeatable(spark, patches, monkeypatch):
    ordered = training.mixed_order(patches, 7, buffer=10).collect()
    assert sorted(r.patch_id for r in ordered) == list(range(230))
    assert [(r.turn, r.place, r.patch_id) for r in ordered] == [(r.turn, r.place, r.patch_id) for r in training.mixed_order(patches, 7, buffer=10).collect()]
    names = lambda rows: [r.patch_id for r in sorted(rows, key=lambda r: (r.turn, r.place))]
    other = training.mixed_order(patches, 8, buffer=10).collect()
    assert names(ordered) != names(other) and len({(r.turn, r.place) for r in ordered}) == 230
    plan = training.mixed_order(patches, 7)._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan.split("InMemory")[0] and "Exchange" not in plan.split("InMemory")[0]


def test_frozen_cut_and_epochs(spark, patches, tmp_path):
    path = f"file://{tmp_path}/set"
    kept = training.frozen(patches, path, 7, take=100, buffer=16)
    order = [r.patch_id for r in sorted(kept.collect(), key=lambda r: (r.turn, r.place))]
    full = sorted(training.mixed_order(patches, 7, 16).collect(), key=lambda r: (r.turn, r.place))
    assert order == [r.patch_id for r in full[:100]]
    plain = training.dataset(spark, path, 0, SHAPE, 8, rules=None).collect()
    own = {r.patch_id: r for r in patches.collect()}
    assert len(plain) == 100 and all(r.image == own[r.patch_id].image and r.batch == r.place // 8 for r in plain)
    for r in plain[:5]:
        front, vectors = training.targets(np.array(r.labels), SHAPE)
        assert r.foreground == front.tolist() and np.allclose([r.vz, r.vy, r.vx], vectors)
    rounds = [{r.patch_id: tuple(r.image) for r in training.dataset(spark, path, k, SHAPE, 8).collect()} for k in (0, 1, 0)]
    assert rounds[0] == rounds[2] and 0.3 < np.mean([rounds[0][i] != rounds[1][i] for i in rounds[0]]) < 1
    assert training.first_rows(kept, 1_000).count() == 100


def test_targets_equal_the_voxel_form(spark):
    from stratavox.plans import pipelines

    rng = np.random.default_rng(5)
    labels = rng.integers(0, 3, (3, 4, 5))
    cells = [(0, int(z), int(y), int(x), int(labels[z, y, x]), 1) for z, y, x in np.ndindex(labels.shape)]
    df = spark.createDataFrame(cells, "img long, z int, y int, x int, label int, v int")
    front, vectors = training.targets(labels, labels.shape, 10)
    for r in pipelines.encode_targets(df, 10).collect():
        i = int(np.ravel_multi_index((r.z, r.y, r.x), labels.shape))
        assert (r.uz, r.uy, r.ux) == tuple(pytest.approx(v) for v in vectors[:, i]) and r.foreground == front[i]


def test_epoch_of_nothing(spark, patches):
    none = training.mixed_order(patches.limit(0), 1)
    assert training.epoch(none, 0, SHAPE, 4, rules=chain.ChainRules()).count() == 0


# ---- substring joins -------------------------------------------------------------------


def test_automaton_and_cuts_agree(spark):
    files = spark.createDataFrame([("a/img_1.tif",), ("a/img_10.tif",), ("x/é_7.tif",), ("",), (None,), ("img",), ("a/other.tif",)], "path string")
    for stems in (["img_1", "zz"], ["é_"], [""], [], [None, "o"], ["img_10", "img_1", "g_1"]):
        known = spark.createDataFrame([(s,) for s in stems], "stem string")
        for anti in (False, True):
            wanted = sorted((r.path for r in files.collect() if any(s and s in (r.path or "") for s in stems) != anti), key=str)
            for found in (prep.stem_join(files, known, anti), prep.stem_join(files, known, anti, automaton_bytes=0), prep.cut_join(files, known, anti)):
                assert sorted((r.path for r in found.collect()), key=str) == wanted
    assert "Exchange" not in prep.stem_join(files, known)._jdf.queryExecution().executedPlan().toString()
