"""Blocks with halos against the voxel forms and plain versions, over block sizes and shapes."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratavox.operators import blocks, field, neighbors
from stratavox.operators.neighbors import AXES

SHAPE = (6, 7, 9)
SIZES = [(64, 64, 64), (3, 4, 5), (2, 2, 2)]


@pytest.fixture(scope="module")
def boxes(spark):
    """Two sparse volumes of SHAPE that number their voxels alike."""
    rng = random.Random(0)
    rows = []
    for img in (0, 1):
        for i in range(6 * 7 * 9):
            if rng.random() < 0.8:
                z, y, x = (int(c) for c in np.unravel_index(i, SHAPE))
                rows.append((img, i, z, y, x, rng.randrange(1000), rng.randrange(1, 3) if z < 4 else 1, *(rng.uniform(-0.9, 0.9) for _ in range(3))))
    return spark.createDataFrame(rows, "img long, vid long, z int, y int, x int, v long, label int, uz double, uy double, ux double").cache()


def cube(boxes, n=6):
    return boxes.filter(" AND ".join(f"{a} < {n}" for a in AXES))


def rows(df, *columns):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("size", SIZES)
def test_smooth_maxima_sobel_borders_equal_the_voxel_forms(boxes, size):
    six, lattice = cube(boxes), blocks.Lattice((6, 6, 6), size)
    weights = neighbors.gaussian_weights(1.0)
    for integer in (True, False):
        assert rows(blocks.smooth(six, lattice, weights, integer), "img", *AXES, "v") == rows(neighbors.smooth(six, 6, weights, integer), "img", *AXES, "v")
    lattice = blocks.Lattice(SHAPE, size)
    assert rows(blocks.local_maxima(boxes, lattice, 1, 500), "img", *AXES, "v") == rows(neighbors.local_maxima(boxes, 1, 500), "img", *AXES, "v")
    dense = boxes.filter("z < 3 OR y < 4").withColumn("label", F.lit(1))
    g = [f"g{a}" for a in AXES]
    assert rows(blocks.sobel(boxes, lattice), "img", *AXES, *g) == rows(neighbors.sobel(boxes), "img", *AXES, *g)
    full = dense.sparkSession.range(2).selectExpr("id AS img").join(dense.sparkSession.range(6 * 7 * 9).selectExpr("id AS vid", "CAST(id DIV 63 AS INT) AS z", "CAST(id % 63 DIV 9 AS INT) AS y", "CAST(id % 9 AS INT) AS x", "CAST(1 + (id % 9 DIV 5) AS INT) AS label"))
    voxel_form = neighbors.border_labels(full, 9).filter("z < 6 AND y < 7")
    assert rows(blocks.border_labels(full, lattice), "img", *AXES, "mark") == rows(voxel_form, "img", *AXES, "mark")


def test_smooth_of_a_thin_volume(spark):
    """A mirror of a volume thinner than the filter, against a plain sum."""
    rng = np.random.default_rng(1)
    v = rng.integers(0, 50, (1, 2, 5)).astype(float)
    df = spark.createDataFrame([(7, *map(int, p), float(v[p])) for p in np.ndindex(v.shape)], "img long, z int, y int, x int, v double")
    weights, out = neighbors.gaussian_weights(1.0), v
    for axis, n in enumerate(v.shape):
        at = np.arange(-4, n + 4) % (2 * n)
        wide = np.take(out, np.where(at < n, at, 2 * n - 1 - at), axis)
        out = sum(w * np.take(wide, range(k, k + n), axis) for k, w in enumerate(weights))
    for size in ((64, 64, 64), (1, 1, 2)):
        found = {(r.z, r.y, r.x): r.v for r in blocks.smooth(df, blocks.Lattice((1, 2, 5), size), weights, False).collect()}
        assert len(found) == v.size and all(abs(found[p] - out[p]) < 1e-9 for p in np.ndindex(v.shape))


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize(("connectivity", "cut"), [(26, 700), (6, 400)])
def test_components_over_block_sizes(boxes, size, connectivity, cut):
    """Both images number their voxels alike, so only (img, vid) names one."""
    some = boxes.filter(F.col("v") > cut)
    wanted = rows(neighbors.connected_components(some, connectivity), "img", "vid", "component")
    assert rows(blocks.connected_components(some, blocks.Lattice(SHAPE, size), connectivity), "img", "vid", "component") == wanted
    if size == SIZES[0]:
        assert rows(neighbors.connected_components_relational(some, connectivity), "img", "vid", "component") == wanted


def test_components_by_label_over_blocks(boxes):
    wanted = rows(neighbors.connected_components(boxes, 26, "label"), "img", "vid", "component")
    assert rows(blocks.connected_components(boxes, blocks.Lattice(SHAPE, (2, 3, 2)), 26, "label"), "img", "vid", "component") == wanted


def test_components_of_a_snake_and_of_large_ids(spark):
    """A winding line crosses blocks many times; ids near 2^62 overflow no sum."""
    at, cells = [0, 0, 0], []
    for y in range(0, 12, 2):
        xs = range(12) if y % 4 == 0 else range(11, -1, -1)
        cells += [(0, y, x) for x in xs] + [(0, y + 1, xs[-1])]
    big = 2**62
    df = spark.createDataFrame([(img, big - i, *c) for img in (0, 1) for i, c in enumerate(cells)], "img long, vid long, z int, y int, x int")
    assert at == [0, 0, 0]
    for found in (blocks.connected_components(df, blocks.Lattice((1, 12, 12), (1, 3, 3))), neighbors.connected_components_relational(df), neighbors.connected_components(df)):
        got = rows(found, "img", "vid", "component")
        assert len(got) == 2 * len(cells) and {r[2] for r in got} == {big - len(cells) + 1}


def test_images_that_share_ids_stay_apart(spark):
    df = spark.createDataFrame([(0, 0, 0, 0, 0), (0, 1, 0, 0, 1), (1, 1, 0, 0, 0), (1, 2, 0, 0, 1)], "img long, vid long, z int, y int, x int")
    wanted = [(0, 0, 0), (0, 1, 0), (1, 1, 1), (1, 2, 1)]
    assert rows(neighbors.connected_components_relational(df), "img", "vid", "component") == wanted
    assert rows(blocks.connected_components(df, blocks.Lattice((1, 1, 2), (1, 1, 1))), "img", "vid", "component") == wanted


@pytest.mark.parametrize(("size", "halo"), [((64, 64, 64), 8), ((3, 3, 3), 2), ((2, 4, 3), 1)])
def test_integration_hands_points_on(boxes, size, halo):
    """Equal to the one-task kernel, also for points that leave the volume or cross many blocks."""
    wanted = rows(field.integrate(boxes, 40), "img", "vid", *AXES, "ez", "ey", "ex")
    found = blocks.integrate(boxes, blocks.Lattice(SHAPE, size), 40, halo=halo)
    assert rows(found, "img", "vid", *AXES, "ez", "ey", "ex") == wanted


@pytest.mark.parametrize(("size", "halo", "most"), [((2, 3, 2), 2, 1), ((2, 2, 2), 1, 600), ((3, 2, 4), 3, 5000), ((2, 2, 2), 1, 2_000_000)])
def test_integration_by_regions_of_one_some_and_all_blocks(boxes, size, halo, most):
    """Points that cross blocks inside a region, and regions, end as those of the one-task kernel."""
    wanted = rows(field.integrate(boxes, 40), "img", "vid", *AXES, "ez", "ey", "ex")
    found = blocks.integrate(boxes, blocks.Lattice(SHAPE, size), 40, halo=halo, most=most)
    assert rows(found, "img", "vid", *AXES, "ez", "ey", "ex") == wanted


def test_a_voxel_of_small_blocks_crosses_one_shuffle_once(boxes, monkeypatch):
    """Copies for blocks, and points handed on between blocks of a region, stay in the task: no row more than voxels, no second round."""
    given, by_groups = [], blocks.by_groups
    monkeypatch.setattr(blocks, "by_groups", lambda df, *args: given.append(df.count()) or by_groups(df, *args))
    found = blocks.integrate(boxes, blocks.Lattice(SHAPE, (2, 3, 2)), 40, halo=2)
    assert given == [boxes.count()] and found.count() == boxes.count()


def test_copies_on_arrays_equal_spread(boxes):
    """Also of cells outside the volume, which the blocks next to them take."""
    lattice, radius = blocks.Lattice(SHAPE, (2, 3, 4)), 2
    cells = np.stack([a.ravel() for a in np.indices((9, 10, 12))]) - 1
    every = np.zeros_like(cells), np.tile(np.array(lattice.counts())[:, None] - 1, cells.shape[1])
    index, block = blocks._copies(lattice, radius, cells, *every)
    df = boxes.sparkSession.createDataFrame(cells.T.tolist(), "z int, y int, x int")
    assert sorted(map(tuple, np.vstack([cells[:, index], block]).T.tolist())) == rows(blocks.spread(df, lattice, radius), *AXES, *blocks.BLOCK)


def test_blocks_of_nothing(boxes):
    none, lattice = boxes.limit(0), blocks.Lattice(SHAPE, (2, 2, 2))
    assert blocks.connected_components(none, lattice).count() == 0
    assert blocks.integrate(none, lattice, 5).count() == 0
    assert blocks.smooth(none, lattice, [0.25, 0.5, 0.25]).count() == 0


def test_segmentation_by_blocks_equals_the_whole_image_form(spark):
    from stratavox.plans import pipelines
    from stratavox.sources import views

    vectors = pipelines.encode_targets(views.labelled(spark, "/root/testdata/sf0.001")).filter("label > 0").checkpoint()
    wanted = rows(pipelines.segment(vectors, 10, 30, n_std=2.0), "img", "vid", *AXES, "label")
    assert wanted and rows(pipelines.segment_blocks(vectors, blocks.Lattice((10, 10, 10), (4, 5, 6)), 30, n_std=2.0, halo=3), "img", "vid", *AXES, "label") == wanted


def forest(cells):
    """Kruskal's forest rooted at the markers: cells {place: (value, marker)} -> {place: marker}."""
    parent, mark = {p: p for p in cells}, {p: m for p, (_, m) in cells.items()}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    edges = []
    for p in cells:
        for k in range(3):
            q = tuple(c + (j == k) for j, c in enumerate(p))
            if q in cells:
                edges.append((-min(cells[p][0], cells[q][0]), -max(cells[p][0], cells[q][0]), p, q))
    for *_, p, q in sorted(edges):
        a, b = find(p), find(q)
        if a != b and not (mark[a] and mark[b]):
            parent[a] = b
            mark[b] = mark[a] or mark[b]
    return {p: mark[find(p)] for p in cells}


def test_watershed_is_the_forest_of_highest_edges(spark):
    rng = random.Random(6)
    images = []
    for img, levels in ((0, 1000), (1, 4), (2, 1)):  # distinct values, many ties, all equal
        cells = {p: (rng.randrange(levels), rng.randrange(1, 6) if rng.random() < 0.04 else 0) for p in itertools.product(range(4), range(5), range(6)) if rng.random() < 0.85}
        images.append(cells)
    images.append({(0, 0, x): (5 - x, 0) for x in range(5)})  # no marker at all
    data = [(img, *p, v, m) for img, cells in enumerate(images) for p, (v, m) in cells.items()]
    df = spark.createDataFrame(data, "img long, z int, y int, x int, v long, marker int")
    found = {(r.img, r.z, r.y, r.x): r.label for r in neighbors.watershed(df).collect()}
    assert found == {(img, *p): m for img, cells in enumerate(images) for p, m in forest(cells).items()}


@pytest.mark.parametrize("block", [3, 64])
def test_watershed_grows_inside_cubes_first(spark, block):
    """The same forest whether images lie in a cube or in many; in one, no round of joins is left (each had its checkpoints)."""
    rng = random.Random(8)
    images = []
    for levels in (1000, 3):
        images.append({p: (rng.randrange(levels), rng.randrange(1, 6) if rng.random() < 0.03 else 0) for p in itertools.product(range(-1, 4), range(5), range(7)) if rng.random() < 0.9})
    data = [(img, *p, v, m) for img, cells in enumerate(images) for p, (v, m) in cells.items()]
    df = spark.createDataFrame(data, "img long, z int, y int, x int, v long, marker int").filter("z >= 0")
    images = [{p: c for p, c in cells.items() if p[0] >= 0} for cells in images]
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(f"watershed {block}", "")
    out = neighbors.watershed(df, block=block)
    jobs = len(tracker.getJobIdsForGroup(f"watershed {block}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    found = {(r.img, r.z, r.y, r.x): r.label for r in out.collect()}
    assert found == {(img, *p): m for img, cells in enumerate(images) for p, m in forest(cells).items()}
    assert jobs <= 6 if block == 64 else jobs > 6


def test_views_and_windows_of_boxes(spark):
    """A constant scorer gives its constant, a scorer that changes nothing the volume, over boxes as over cubes."""
    from stratavox.operators import augment, patch
    from stratavox.plans import pipelines

    shape = (3, 6, 8)
    df = spark.createDataFrame([(4, *map(int, p), float(i)) for i, p in enumerate(np.ndindex(shape))], "img long, z int, y int, x int, v double")
    seen = augment.views(df, shape)
    for k, sides in enumerate(augment.view_sides(shape)):
        view = seen.filter(F.col("view") == k)
        assert view.select(*AXES).distinct().count() == 144 if k % 7 == 0 else True
        assert tuple(view.agg(*[F.max(a) + 1 for a in AXES]).first()) == sides and view.agg(F.min(F.least(*AXES))).first()[0] == 0
    assert rows(augment.unview(seen, shape).select("img", *AXES, "v").distinct(), "img", *AXES, "v") == rows(df, "img", *AXES, "v")
    same = lambda pdf: pdf
    one = {tuple(r[1:4]): r.v for r in pipelines.smooth_predict(df, shape, 4, same).collect()}
    many = {tuple(r[1:4]): r.v for r in pipelines.smooth_predict_views(df, shape, 4, same).collect()}
    assert set(one) == set(many) == set(np.ndindex(shape))
    assert patch.unpad(patch.pad(df, shape, (5, 6, 9), "reflect", (1, 0, 1)), shape, (1, 0, 1)).exceptAll(df).count() == 0
