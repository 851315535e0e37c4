"""Kernels over many small groups at once: no call a group, and the same results."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratavox.operators import blocks, field, groups, neighbors


@pytest.mark.parametrize("rows", [1, 7, 100, 10_000])
def test_chunks_cut_no_group(rows):
    """Groups longer than a chunk or a batch, and null keys, stay whole."""
    rng = np.random.default_rng(0)
    keys = [k for k in [None, *range(40)] for _ in range(int(rng.integers(1, 9)) if k != 20 else 300)]
    table = pa.table({"k": pa.array(keys, pa.int64()), "i": np.arange(len(keys))})
    chunks = list(groups.whole_groups(iter(table.to_batches(max_chunksize=11)), ["k"], rows))
    assert pa.concat_tables(chunks).equals(table)
    seen = [k for c in chunks for k in dict.fromkeys(c["k"].to_pylist())]
    assert len(seen) == len(set(seen)) == 41
    assert len(chunks) <= 2 + 2 * len(keys) / rows


def test_a_kernel_call_takes_many_images(spark):
    """Each call writes how many images it had: one call an image and block would write ones."""
    df = spark.range(400).selectExpr("id DIV 8 AS img", "CAST(id % 8 DIV 4 AS INT) AS z", "CAST(id % 4 DIV 2 AS INT) AS y", "CAST(id % 2 AS INT) AS x", "id AS v").coalesce(1)

    def kernel(box, present, padded):
        return present[box.inner()], {"n": np.full(present[box.inner()].shape, len(present), np.int64)}

    found = blocks.by_block(df, blocks.Lattice((2, 2, 2), (1, 2, 2)), 0, kernel, ["v"], "n long")
    assert found.count() == 400 and found.agg(F.min("n")).first()[0] > 1


def test_no_step_of_a_segmentation_has_a_call_a_group(spark):
    df = spark.createDataFrame([(0, 0, 0, 0, 0, 1.0, 0.0, 0.0, 1)], "img long, vid long, z int, y int, x int, uz double, uy double, ux double, v long")
    lattice = blocks.Lattice((4, 4, 4), (2, 2, 2))
    for found in (field.integrate(df, 3), blocks.smooth(df, lattice, [0.25, 0.5, 0.25]), blocks.local_maxima(df, lattice), neighbors.connected_components(df)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "FlatMap" not in plan


def test_paths_of_many_boxes_equal_those_of_each(spark):
    """Boxes of all sides end to end in one array: bit for bit the samples of each alone, also far outside."""
    rng = np.random.default_rng(1)
    shape, low = rng.integers(1, 9, (3, 30)), rng.integers(-3, 4, (3, 30))
    cells = [np.stack(np.nonzero(rng.random(shape[:, g]) < 0.7)) for g in range(30)]
    owner = np.repeat(np.arange(30), [c.shape[1] for c in cells])
    vectors = rng.normal(size=(3, len(owner)))
    grids = field.Grids(low, shape)
    grids.fill(owner, np.concatenate(cells, 1) + low[:, owner], vectors)
    begin = np.concatenate(cells, 1) + low[:, owner] + rng.normal(scale=3, size=vectors.shape)
    pos, step, done = begin.copy(), np.zeros_like(begin), np.zeros(len(owner), np.int64)
    grids.advance(owner, pos, step, done, 40, 0.2, 0.8, part=64)
    assert (done == 40).all()
    for g in range(30):
        mine = owner == g
        grid = np.zeros((3, *shape[:, g]))
        grid[(slice(None), *cells[g])] = vectors[:, mine]
        p, s = begin[:, mine], 0.0
        for _ in range(40):
            s = 0.2 * field._sample(grid, p - low[:, [g]]) + 0.8 * s
            p = p + s
        assert np.allclose(p, pos[:, mine], atol=1e-9)


@pytest.mark.parametrize("bad", [np.nan, np.inf])
def test_a_field_without_a_number_is_an_error(bad):
    grids = field.Grids(np.zeros((3, 1), int), np.full((3, 1), 2))
    with pytest.raises(ValueError, match="finite"):
        grids.fill(np.zeros(1, int), np.zeros((3, 1), int), np.array([[0.5], [bad], [0.5]]))


def test_a_segmentation_runs_its_kernels_once(spark):
    """Paths, smoothed density and components are read by several steps, but kept: no kernel is left in the result's plan."""
    from stratavox.plans import pipelines
    from stratavox.sources import views

    vectors = pipelines.encode_targets(views.labelled(spark, "/root/testdata/sf0.001")).filter("label > 0")
    for found in (pipelines.segment(vectors, 10, 30, n_std=2.0), pipelines.segment_blocks(vectors, blocks.Lattice((10, 10, 10), (5, 10, 10)), 30, n_std=2.0, halo=4)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "InArrow" not in plan and "InPandas" not in plan and found.count()


def test_hand_off_reads_each_block_in_one_call_of_many(spark):
    """A round has no call a block, and paths over blocks end as those of the whole image, for many images."""
    rng = np.random.default_rng(3)
    data = [(img, i, *map(int, np.unravel_index(i, (3, 4, 5))), *rng.uniform(-0.9, 0.9, 3).tolist()) for img in range(20) for i in range(60)]
    df = spark.createDataFrame(data, "img long, vid long, z int, y int, x int, uz double, uy double, ux double")
    tell = lambda f: sorted(tuple(r) for r in f.select("img", "vid", "ez", "ey", "ex").collect())
    found = blocks.integrate(df, blocks.Lattice((3, 4, 5), (2, 2, 3)), 30, halo=1)
    assert tell(found) == tell(field.integrate(df, 30))
