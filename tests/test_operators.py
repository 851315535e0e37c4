"""Hand-computed cases and properties of the operators."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratavox.functions import scalars
from stratavox.operators import augment, field, metrics, neighbors, patch, prep, project, regions, score
from stratavox.plans import datasets, pipelines
from stratavox.sources import patches, tiff
from stratavox.streaming import volumes


def cube(spark, n=6, img=0, f=lambda z, y, x: z * 36 + y * 6 + x):
    return spark.createDataFrame([(img, (z * n + y) * n + x, z, y, x, f(z, y, x)) for z in range(n) for y in range(n) for x in range(n)], "img long, vid long, z int, y int, x int, v long")


def as_dict(df, *keys, value="v"):
    return {tuple(r[k] for k in keys): r[value] for r in df.collect()}


@pytest.mark.parametrize(("n", "length"), [(10, 10), (11, 13), (3, 4)])
def test_grid_length(n, length):
    assert patch.Grid(4, 3).padded(n) == length


@pytest.mark.parametrize(("mode", "wanted"), [("reflect", [0, 1, 2, 3, 2, 1, 0]), ("wrap", [0, 1, 2, 3, 0, 1, 2])])
def test_pad_index(spark, mode, wanted):
    rows = spark.range(7).select(patch.pad_index(F.col("id"), 4, mode).alias("i")).collect()
    assert [r.i for r in rows] == wanted
    line = spark.createDataFrame([(0, i, i, i, i) for i in range(4)], "img long, z int, y int, x int, v long")
    padded = patch.pad(line, 4, 7, mode)
    assert sorted({(r.z, r.v) for r in padded.filter("z = y AND y = x").collect()}) == sorted(enumerate(wanted))


def test_pad_constant_and_unpad(spark):
    df = cube(spark, 3, f=lambda z, y, x: 1 + z)
    out = patch.pad(df, 3, 6, "constant", left=1)
    assert out.count() == 216 and out.agg(F.sum("v")).first()[0] == df.agg(F.sum("v")).first()[0]
    assert as_dict(patch.unpad(out, 3, 1), "z", "y", "x") == as_dict(df, "z", "y", "x")


def test_stitch_weights(spark):
    rows = spark.createDataFrame([(g, o) for g in range(3) for o in range(4)], "g int, o int")
    got = rows.withColumn("w", patch.ramp(F.col("o"), F.col("g"), 2, patch.Grid(4, 2))).orderBy("g", "o").collect()
    assert [[r.w for r in got if r.g == g] for g in range(3)] == [[1, 1, 1, 0], [0, 1, 1, 0], [0, 1, 1, 1]]


def test_stitch_undoes_patchify(spark):
    grid, df = patch.Grid(4, 2), cube(spark)
    out = patch.stitch(patch.patchify(df, grid, 6), grid, 6)
    blended = out.withColumn("v", (F.col("num") / F.nullif(F.col("den"), F.lit(0))).cast("long"))
    assert as_dict(blended, "z", "y", "x") == as_dict(df, "z", "y", "x")


def test_apportion(spark):
    df = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "item int, weight long")
    assert as_dict(patch.largest_remainder(df, 7), "item", value="share") == {(1,): 1, (2,): 2, (3,): 4}
    none = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "item int, weight long")
    assert as_dict(patch.largest_remainder(none, 4), "item", value="share") == {(1,): 2, (2,): 1, (3,): 1}


@pytest.mark.parametrize("percent", [0, 1, 10, 37, 100])
def test_exact_split(spark, percent):
    out = patch.exact_split(spark.range(1003), "id", percent, 3)
    assert out.count() == 1003 and out.filter("held").count() == math.ceil(1003 * percent / 100)


def test_percentiles(spark):
    df = spark.createDataFrame([(0, i) for i in range(100)], "img long, v long")
    out = as_dict(project.percentile_rescale(df), "v", value="rescaled")
    assert out[(0,)] == 0 and out[(99,)] == 1
    assert out[(50,)] == pytest.approx((50 - 1.98) / (98.802 - 1.98))


def test_constant_volume_is_null(spark):
    df = spark.createDataFrame([(0, 5), (0, 5)], "img long, v long")
    assert {r.norm for r in project.minmax(df).collect()} == {None}


def test_object_codes_round_half_even(spark):
    cells = [(0, z, 0, 0, 1, 1) for z in range(6)] + [(0, z, 0, 0, 2, 1) for z in range(1, 7)]
    df = spark.createDataFrame(cells, "img long, z int, y int, x int, label int, v long")
    assert as_dict(regions.object_codes(df, least=1), "label", value="cz") == {(1,): 2, (2,): 4}


def test_radius_and_small_objects(spark):
    r = spark.range(1).select(regions.equivalent_radius(F.lit(113)).alias("r")).first().r
    assert round(r, 4) == 2.9991
    rows = [(0, i, 1) for i in range(19)] + [(0, i, 2) for i in range(20)]
    df = spark.createDataFrame(rows, "img long, i int, label int")
    assert {x.label for x in project.drop_small(df).collect()} == {2}
    with pytest.raises(ValueError):
        regions.equivalent_radius(F.lit(1), 4)


def test_signal_filter_is_strict(spark):
    df = spark.createDataFrame([(1, 100), (2, 5), (3, 6)], "k int, n_signal long")
    assert {r.k for r in patch.signal_filter(df, 5).collect()} == {1, 3}


def test_nearest_seed_radius(spark):
    points = spark.createDataFrame([(0, 1, 0, 0, 0)], "img long, pid long, z int, y int, x int")
    far = spark.createDataFrame([(0, 3, 4, 0, 7)], "img long, z int, y int, x int, label int")
    near = spark.createDataFrame([(0, 3, 3, 0, 7), (0, 3, 0, 3, 5)], "img long, z int, y int, x int, label int")
    assert field.nearest_seed(points, far).first().label == 0
    assert field.nearest_seed(points, near).first().label == 5
    assert field.nearest_seed(points, near.limit(0)).first().label == 0


def test_momentum_path():
    pos = step = 0.0
    seen = []
    for _ in range(3):
        step = 0.2 * 1 + 0.8 * step
        pos += step
        seen.append(round(pos, 3))
    assert seen == [0.2, 0.56, 1.048]
    grid = np.ones((3, 4, 4, 4))
    assert field._sample(grid, np.array([[1.5], [0.25], [2.0]])).ravel().tolist() == [1, 1, 1]


def test_metrics(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0), (0, 1.0, 0.0), (0, 0.0, 0.0)], "img int, t double, p double")
    got = df.agg(metrics.dice(F.col("t"), F.col("p")).alias("d"), metrics.tversky_loss(F.col("t"), F.col("p")).alias("t")).first()
    assert got.d == 0.75 and round(got.t, 6) == 0.259259
    two = spark.createDataFrame([(1.0, 0.5), (0.0, 0.0)], "t double, p double")
    assert two.agg(metrics.squared_error_x10(F.col("t"), F.col("p"))).first()[0] == 1.25
    assert set(metrics.all_metrics(df).columns) >= {"dice", "tversky", "focal", "bce"}


def test_score_classes(spark):
    rows = spark.createDataFrame([(0.999,), (1.0,), (2.0,), (3.0,)], "v double").select(score.score_class(F.col("v")).alias("c")).collect()
    assert [r.c for r in rows] == ["Normal", "Mild", "Abnormal", "Strongly abnormal"]


def test_argmax_tie(spark):
    assert spark.range(1).select(project.argmax_class(F.lit(1), F.lit(1))).first()[0] == 0


@pytest.mark.parametrize("connectivity", [6, 26])
def test_components_agree(spark, connectivity):
    rng = np.random.default_rng(3)
    on = rng.random((8, 8, 8)) < 0.3
    df = spark.createDataFrame([(i, int((z * 8 + y) * 8 + x), int(z), int(y), int(x)) for i in range(2) for z, y, x in np.argwhere(on)], "img long, vid long, z int, y int, x int")
    df = df.withColumn("vid", F.col("vid") + F.col("img") * 1000)
    a = as_dict(neighbors.connected_components(df, connectivity), "vid", value="component")
    b = as_dict(neighbors.connected_components_relational(df, connectivity), "vid", value="component")
    assert a == b
    dense = neighbors.dense_labels(neighbors.connected_components(df, connectivity))
    assert dense.agg(F.min("component_id")).first()[0] == 1


def test_flips_turns_and_views(spark):
    df = cube(spark)
    same = as_dict(df, "z", "y", "x")
    assert as_dict(augment.flip(augment.flip(df, "z", 6), "z", 6), "z", "y", "x") == same
    assert as_dict(augment.rotate90(augment.rotate90(df, "y", 3, 6), "y", 1, 6), "z", "y", "x") == same
    back = augment.view_average(augment.unview(augment.views(df.select("img", "z", "y", "x", "v"), 6), 6))
    assert {k: 27 * v for k, v in same.items()} == as_dict(back, "z", "y", "x", value="sum_v")


def test_rescale_keeps_constant(spark):
    df = cube(spark, f=lambda z, y, x: 8)
    out = field.resample_linear(df, 3, 2, 6)
    assert out.count() == 729 and {round(r.v, 9) for r in out.collect()} == {8.0}
    assert field.resample_nearest(df, 6, 9).count() == 729


def test_gaussian_conserves_mass(spark):
    df = cube(spark, f=lambda z, y, x: 100 if (z, y, x) == (0, 0, 0) else 0).filter("v > 0")
    out = neighbors.smooth(df, 6, neighbors.gaussian_weights(1.0), integer=False)
    assert out.agg(F.sum("v")).first()[0] == pytest.approx(100)


def test_noise_and_illumination(spark):
    df = cube(spark, f=lambda z, y, x: 50 + z)
    noisy = augment.poisson_noise(df, seed=4)
    assert as_dict(noisy, "z", "y", "x") == as_dict(augment.poisson_noise(df, seed=4), "z", "y", "x")
    assert abs(noisy.agg(F.avg("v")).first()[0] - df.agg(F.avg("v")).first()[0]) < 3
    flat = project.illumination_corrected(cube(spark, f=lambda z, y, x: 7), 6, 2)
    assert {round(r.v, 6) for r in flat.collect()} == {7.0}
    moved = augment.elastic(df, 6, strength=0.0, seed=1)
    assert as_dict(moved, "z", "y", "x") == {k: float(v) for k, v in as_dict(df, "z", "y", "x").items()}


def test_watershed_splits_two_basins(spark):
    cells = [(0, 0, 0, x, v, m) for x, (v, m) in enumerate([(9, 1), (8, 0), (3, 0), (8, 0), (9, 2)])]
    df = spark.createDataFrame(cells, "img long, z int, y int, x int, v long, marker int")
    out = as_dict(neighbors.watershed(df), "x", value="label")
    assert out[(1,)] == 1 and out[(3,)] == 2 and out[(2,)] in (1, 2)


def test_stems_and_names(spark):
    files = spark.createDataFrame([("a/img_1.tif",), ("a/img_10.tif",), ("a/other.tif",)], "path string")
    stems = spark.createDataFrame([("img_1",), ("zz",)], "stem string")
    assert {r.path for r in prep.stem_join(files, stems).collect()} == {"a/img_1.tif", "a/img_10.tif"}
    assert {r.path for r in prep.stem_join(files, stems, anti=True).collect()} == {"a/other.tif"}
    assert prep.stem_join(files, stems.limit(0)).count() == 0
    got = files.select(prep.stem_of(F.col("path")).alias("s"), prep.parent_of(F.col("path"), 4).alias("p")).first()
    assert (got.s, got.p) == ("img_1", None)


@pytest.mark.parametrize("dtype", ["uint8", "uint16", "int16", "float32"])
def test_tiff_round_trip(spark, tmp_path, dtype):
    volume = (np.arange(2 * 3 * 5).reshape(2, 3, 5) % 100).astype(dtype)
    assert (tiff.decode(tiff.encode(volume)) == volume).all()
    (tmp_path / "one.TIF").write_bytes(tiff.encode(volume))
    tiff.register(spark)
    for df in (tiff.decode_column(spark, str(tmp_path)), spark.read.format("tiff_volume").load(str(tmp_path))):
        row = df.first()
        assert (row.nz, row.ny, row.nx) == (2, 3, 5) and list(row.data) == volume.astype(float).ravel().tolist()
    cells = as_dict(tiff.to_voxels(df), "z", "y", "x")
    assert cells == {(z, y, x): float(volume[z, y, x]) for z, y, x in np.argwhere(volume > 0)}


def test_tiff_errors(spark, tmp_path):
    with pytest.raises(ValueError):
        tiff.decode(b"no tiff here")
    with pytest.raises(FileNotFoundError):
        tiff.scan(spark, str(tmp_path))
    assert tiff.channels_first([64, 3, 128, 3]) == 1


def test_patch_set(spark, tmp_path):
    cells = patch.patchify(cube(spark).withColumn("label", F.lit(1)), patch.Grid(3, 3), 6)
    rows = patches.gathered(cells, 3)
    assert rows.count() == 8 and rows.filter(F.size("image") != 27).count() == 0
    full = rows.select(F.lit("train").alias("split"), F.lit("d").alias("dataset"), F.col("img").alias("image_id"), F.monotonically_increasing_id().alias("patch_id"), "image", "labels")
    path = str(tmp_path / "set")
    patches.write(full, path, 27, append=False)
    patches.write(full.withColumn("dataset", F.lit("e")), path, 27)
    assert patches.read(spark, path).count() == 16 and patches.read(spark, path, dataset="e").count() == 8
    patches.replace_dataset(full.limit(1), path)
    assert patches.read(spark, path, dataset="d").count() == 1 and patches.read(spark, path, dataset="e").count() == 8
    with pytest.raises(ValueError):
        patches.write(full, path, 26)
    once = [r.patch_id for r in patches.shuffled(full, 1).collect()]
    assert once == [r.patch_id for r in patches.shuffled(full, 1).collect()] and sorted(once) != once or len(once) == 1
    assert patches.shuffled(full, 1, take=3).count() == 3


def test_stream(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    cube(spark).write.parquet(source)
    stream = volumes.incoming(spark, source, cube(spark).schema)
    volumes.process(stream, project.minmax, out, str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(out).count() == 216


def test_windowed_density(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "ev"))
    agg = volumes.windowed_density(spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev")), every="1 day", late="1 day")
    q = agg.writeStream.format("memory").queryName("dens").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM dens").first()[0] == 1000


def test_scalars(spark):
    got = spark.range(1).select(scalars.round_half_even(F.lit(2.5)).alias("a"), scalars.truncated(F.lit(-0.7)).alias("b"), scalars.clip(F.lit(9), F.lit(0), F.lit(5)).alias("c")).first()
    assert (got.a, got.b, got.c) == (2.0, 0, 5)


def test_segmentation_recovers_balls(spark):
    """Targets of four separate balls, integrated and seeded, give the balls back."""
    balls = [(10, 10, 10), (10, 26, 12), (28, 20, 26), (30, 32, 10)]
    rows = []
    for k, c in enumerate(balls, 1):
        for z in range(40):
            for y in range(40):
                for x in range(40):
                    if (z - c[0]) ** 2 + (y - c[1]) ** 2 + (x - c[2]) ** 2 <= 49:
                        rows.append((0, (z * 40 + y) * 40 + x, z, y, x, k, 1))
    assert len(rows) == 5676
    df = spark.createDataFrame(rows, "img long, vid long, z int, y int, x int, label int, v long")
    out = pipelines.segment(pipelines.encode_targets(df), 40).withColumnRenamed("label", "found")
    pairs = out.join(df, ["img", "vid"]).groupBy("label", "found").count().collect()
    assert len(pairs) == 4 and sum(r["count"] for r in pairs) == len(rows)


def test_wiener_and_thresholds(spark):
    df = cube(spark, f=lambda z, y, x: 10)
    out = neighbors.wiener(df, 6, balance=0.0)
    assert out.count() == 216 and {round(r.v, 6) for r in out.collect()} == {10.0}
    levels = spark.createDataFrame([(0, v) for v in [0] * 9 + [40] * 9 + [100] * 9], "img long, v long")
    low, high = neighbors.class_thresholds(levels).first().thresholds
    assert 0 < low <= 40 < high <= 100


def test_dataset_preparation(spark):
    paths = [f"r/liver/img_{i}.tif" for i in range(12)] + [f"r/liver_gt/img_{i}.tif" for i in range(12)] + ["r/synthetic/a/b/images/s.tif", "r/synthetic/a/b/gt/s.tif"]
    out = datasets.prepare(spark.createDataFrame([(p,) for p in paths], "path string")).collect()
    assert len(out) == len(paths)
    test = [r for r in out if r.split == "test" and not r.is_truth]
    assert len(test) == 1 and all(r.split == "train" for r in out if r.is_synthetic)
    stem = test[0].name.removesuffix(".tif")
    assert {r.split for r in out if r.is_truth and stem in r.path} == {"test"}
    assert {r.name for r in out if r.is_synthetic} == {"a_b_s.tif", "a_b_s_gt.tif"}


# ---- hashes, splits, quantiles ---------------------------------------------------------


def test_hash_is_uniform(spark):
    images = spark.range(300).withColumnRenamed("id", "img")
    starts = patch.patch_starts(images, 8, 10, 4)
    assert starts.select("z", "y", "x").distinct().count() > 330  # of 343 places, 2,400 draws
    seen = [r["count"] for r in starts.groupBy((F.col("y") - F.col("z")).alias("d")).count().collect()]
    assert len(seen) == 13
    held = sorted(r.k for r in patch.exact_split(spark.range(5000).withColumnRenamed("id", "k"), "k", 10).filter("held").collect())
    gaps = {b - a for a, b in zip(held, held[1:], strict=False)}
    assert len(held) == 500 and len(gaps) > 20


def test_split_of_groups_is_exact(spark):
    df = spark.range(3000).select(F.col("id").alias("k"), F.when(F.col("id") % 3 > 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("g"))
    out = patch.exact_split(df, "k", 10, 3, ("g",), floor=True)
    got = {r.g: (r.n, r.h) for r in out.groupBy("g").agg(F.count("*").alias("n"), F.count_if("held").alias("h")).collect()}
    assert all(h == max(1, n // 10) for n, h in got.values()) and sum(n for n, _ in got.values()) == 3000
    ranked = df.withColumn("h", patch.mixed(F.col("k"), salt=3)).filter("g = 'hot'").orderBy("h", "k").limit(200)
    assert {r.k for r in ranked.collect()} == {r.k for r in out.filter("held AND g = 'hot'").collect()}


@pytest.mark.parametrize("weights", [[5, 3, 0, 0, 7, 11], [0, 0, 0, 0, 0], [1] * 9])
def test_largest_remainder_without_groups(spark, weights):
    df = spark.createDataFrame(list(enumerate(weights)), "item long, weight long")
    got = [r.share for r in patch.largest_remainder(df, 7).orderBy("item").collect()]
    total = sum(weights)
    raw = [7 * w / total if total else 7 / len(weights) for w in weights]
    wanted = [int(r) for r in raw]
    order = sorted(range(len(raw)), key=lambda i: (-(7 * weights[i] % total) if total else 0, i))
    for i in order[: 7 - sum(wanted)]:
        wanted[i] += 1
    assert got == wanted


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(2)
    values = {"a": rng.normal(size=700), "b": np.round(rng.exponential(size=401), 1), "c": np.array([4.0]), "d": np.full(9, 2.0)}
    df = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs] + [("a", None)], "condition string, v double")
    shares = (0.0, 0.1, 0.25, 0.5, 0.998, 1.0)
    got = {(r.condition, r.share): r.quantile for r in score.exact_quantiles(df, "v", shares, bins=16).collect()}
    assert got == pytest.approx({(k, s): np.quantile(v, s) for k, v in values.items() for s in shares})


def test_stems_of_like_names(spark):
    paths = [f"/d/gt/image_{i:03}_gt.tif" for i in range(30)] + ["/d/gt/im.tif", ""]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    stems = spark.createDataFrame([("image_001",), ("image_02",), ("",), ("absent",), ("_gt.tif_long_beyond_any_path_that_is_in_the_list",)], "stem string")
    wanted = {p for p in paths if "image_001" in p or "image_02" in p}
    assert {r.path for r in prep.stem_join(files, stems).collect()} == wanted
    assert {r.path for r in prep.stem_join(files, stems, anti=True).collect()} == set(paths) - wanted


# ---- resampling and fields -------------------------------------------------------------


@pytest.mark.parametrize(("n", "m"), [(6, 6), (6, 4), (6, 9), (5, 1), (1, 4)])
def test_resampling_by_arithmetic(spark, n, m):
    df = cube(spark, n, f=lambda z, y, x: z * z + 3 * y + x)
    near = as_dict(field.resample_nearest(df, n, m), "z", "y", "x")
    own = as_dict(df, "z", "y", "x")
    at = [((2 * i + 1) * n) // (2 * m) for i in range(m)]
    assert near == {(a, b, c): own[at[a], at[b], at[c]] for a in range(m) for b in range(m) for c in range(m)}
    line = as_dict(field.resample_linear(df, m, None, n).filter("y = 0 AND x = 0"), "z")
    p = [min(max((i + 0.5) * n / m - 0.5, 0), n - 1) for i in range(m)]
    flat = field.resample_linear(df, m, None, n).filter("y = 0 AND x = 0")
    edge = (3 + 1) * min(max(0.5 * n / m - 0.5, 0), n - 1)
    assert line == pytest.approx({(i,): np.interp(v, range(n), np.arange(n) ** 2) + edge for i, v in enumerate(p)})
    assert flat.count() == m


def test_shrinking_smooths_first(spark):
    df = cube(spark, 9, f=lambda z, y, x: 1000 * int(z == y == x == 4))
    rough = field.resample_linear(df, 3, None, 9).filter("v > 0").count()
    soft = field.shrunk_linear(df, 9, 3).filter("v > 0").count()
    assert rough == 1 < soft == 27


def test_cubic_spline(spark):
    poly = lambda z, y, x: 0.5 * z**3 - z * y + x * x + 2
    df = cube(spark, 12, f=lambda z, y, x: 0).withColumn("v", poly(F.col("z").cast("double"), F.col("y"), F.col("x")))
    points = spark.createDataFrame([(0, 0, 5.0, 6.0, 5.0), (0, 1, 5.5, 5.25, 6.0), (0, 2, -1.0, 0.0, 0.0), (0, 3, 0.0, 11.0, 3.0)], "img long, pid long, pz double, py double, px double")
    got = as_dict(field.cubic(points, df, 12), "pid")
    assert got[(0,)] == pytest.approx(poly(5, 6, 5)) and got[(3,)] == pytest.approx(poly(0, 11, 3))
    assert got[(1,)] == pytest.approx(poly(5.5, 5.25, 6.0), abs=0.1) and got[(2,)] == 0


def test_descent_drops_still_points(spark):
    df = cube(spark, 8).withColumns({"uz": F.when(F.col("z") < 4, 1.0).otherwise(0.0), "uy": F.lit(0.0), "ux": F.lit(0.0), "start_": (F.col("y") == 4) & (F.col("x") == 4) & F.col("z").isin(0, 7)})
    steps = field.descend(df, 8, iterations=30, rate=0.5, tolerance=0.05, start="start_").collect()
    ends = {}
    for r in sorted(steps, key=lambda r: r.step):
        ends.setdefault(r.vid, []).append(r.z)
    assert list(ends) == [4 * 6 + 4] or len(ends) == 1  # the point in the still half leaves at once
    path = next(iter(ends.values()))
    assert path == sorted(path) and 3 < path[-1] < 7 and len(path) < 30


def test_radius_rescale_by_image(spark):
    balls = lambda r: lambda z, y, x: int((z - 5) ** 2 + (y - 5) ** 2 + (x - 5) ** 2 <= r * r)
    df = cube(spark, 11, 0, balls(4)).unionByName(cube(spark, 11, 1, balls(2))).unionByName(cube(spark, 11, 2, lambda z, y, x: 0)).withColumnRenamed("v", "label").withColumn("v", F.col("label") * 10)
    radius = {r.img: r.radius for r in regions.mean_radius(df).collect()}
    size = {r.img: r.n for r in field.rescale_by_radius(df, 11, 3.0).groupBy("img").agg(F.max("z").alias("n")).collect()}
    assert size == {0: int(11 * 3 / radius[0]) - 1, 1: int(11 * 3 / radius[1]) - 1, 2: 10}
    values = field.rescale_by_radius(df, 11, 3.0, value="v").groupBy("img").agg(F.count("*").alias("n")).collect()
    assert {r.img: r.n for r in values} == {i: (k + 1) ** 3 for i, k in size.items()}


def test_encoded_targets_drop_dust(spark):
    block = lambda z, y, x: int(z < 5 and y < 5 and x < 5) or int(z == 7 and y == 7)
    df = cube(spark, 8, f=block).withColumnRenamed("v", "label").withColumn("v", F.lit(1))
    out = regions.encoded_targets(df, least=20, dust=100)
    assert out.filter("label > 0").count() == 125 and out.count() == 512
    row = out.filter("z = 0 AND y = 2 AND x = 4").first()
    assert (row.dz, row.dy, row.dx) == pytest.approx((1.0, 0.0, -1.0))


# ---- models, windows, chains -----------------------------------------------------------


def test_windows():
    w = augment.window_3d(8)
    assert max(w) == 1 and len(w) == 512 and w[0] == min(w) and w == pytest.approx(w[::-1])
    assert len(augment.window_3d(4, "gaus")) == 64
    with pytest.raises(ValueError, match="unknown"):
        augment.window_3d(4, "flat")
    assert patch.view_padding(10, 4, 2) == (2, 14) and patch.view_padding(11, 4, 2) == (2, 16) and patch.view_padding(10, 6, 2) == (3, 17)


def test_predictions_over_views(spark):
    df = cube(spark, 6).select("img", "z", "y", "x", F.col("v").cast("double").alias("v"))
    out = pipelines.smooth_predict_views(df, 6, 4, lambda pdf: pdf.assign(image=[x * 0 + 3 for x in pdf["image"]]))
    plain = pipelines.smooth_predict(df, 6, 4, lambda pdf: pdf.assign(image=[x * 0 + 3 for x in pdf["image"]]))
    assert out.count() == plain.count() == 216
    assert out.agg(F.avg("v")).first()[0] == pytest.approx(plain.agg(F.avg("v")).first()[0], rel=0.05)


def test_failed_rows_are_told(spark):
    def predict(pdf):
        if pdf["k"].iloc[0] == 2:
            raise ValueError("bad file")
        return pdf.assign(y=pdf["k"] * 10)

    got = {r.k: (r.y, r.error) for r in field.scored_or_failed(spark.range(4).select(F.col("id").alias("k")), predict, "k long, y long").collect()}
    assert got == {0: (0, None), 1: (10, None), 2: (None, "ValueError: bad file"), 3: (30, None)}
    assert augment.augmented(spark.range(3), lambda pdf: pdf.assign(id=pdf["id"] + 1), "id long").agg(F.sum("id")).first()[0] == 6


def test_learning_rate_halves_on_a_plateau(spark):
    values = [5.0, 4.0, 4.0, 4.0, 4.0, 3.0, 3.0, 3.0, 3.0]
    history = spark.createDataFrame([("loss", i, v) for i, v in enumerate(values)], "metric string, epoch long, value double")
    got = [r.rate for r in prep.learning_rates(history, 1.0, patience=3).orderBy("epoch").collect()]
    assert got == [1.0] * 5 + [0.5] * 4


def test_huber_resists_outliers(spark):
    rows = [("Control", float(v), float(2 * v + 1 + (50 if v % 17 == 0 else (v * 7 % 5 - 2) / 50))) for v in range(1, 100)]
    alpha, beta, scale = score.fit_controls_huber(spark.createDataFrame(rows, "condition string, log_volume double, log_dapi double"))
    assert beta == pytest.approx(2, abs=0.01) and alpha == pytest.approx(1, abs=0.5) and scale > 0


def test_preprocessing_chain(spark):
    df = cube(spark, 8, f=lambda z, y, x: 10 + z + (y * x) % 5)
    out = project.preprocessed(df, 8, side=4, sigma=1.0)
    assert out.count() == 512
    low, high = out.agg(F.min("v"), F.max("v")).first()
    assert (low, high) == (0.0, 1.0)


def test_memory_and_weights():
    assert metrics.memory_gigabytes([(None, 64, 128, 128, 8), (None, 10)], 1000, 2) == round(4 * (2 * (64 * 128 * 128 * 8 + 10) + 1000) / 1024**3, 3)


# ---- sources ---------------------------------------------------------------------------


def test_pairs_of_folders(spark, tmp_path):
    rng = np.random.default_rng(5)
    stored = {}
    for tag in ("images", "masks"):
        (tmp_path / "Mouse" / tag).mkdir(parents=True)
        for k in (1, 0):
            volume = rng.integers(1, 200, (4, 5, 6)).astype(np.uint16) if tag == "images" else np.zeros((4, 5, 6), np.uint16)
            if tag == "masks":
                volume[0, 0, 0], volume[3, 4, 5], volume[3, 4, 4] = 9, 9, 9
            stored[tag, k] = volume
            (tmp_path / "Mouse" / tag / f"v{k}.tif").write_bytes(tiff.encode(volume))
    out = tiff.load_pairs(spark, f"file://{tmp_path}/Mouse")
    got = {(r.img, r.z, r.y, r.x): (r.v, r.label) for r in out.collect()}
    assert len(got) == 2 * 120
    for k in (0, 1):
        v = stored["images", k].astype(float)
        v = v.max() - v
        v = (v - v.min()) / (v.max() - v.min())
        assert got[k + 1, 2, 3, 1][0] == pytest.approx(v[2, 3, 1])
        assert (got[k + 1, 0, 0, 0][1], got[k + 1, 3, 4, 5][1], got[k + 1, 3, 4, 4][1], got[k + 1, 1, 1, 1][1]) == (1, 2, 2, 0)
    old = tiff.load_pairs(spark, f"file://{tmp_path}/Mouse", normalise_first=True)
    assert old.agg(F.max("v"), F.min("v")).first() == (1.0, 0.0)
    names = [r.path for r in tiff.listing(spark, f"file://{tmp_path}/Mouse/images").collect()]
    assert names == sorted(names)


def test_channels_of_a_stack(spark):
    shape = [4, 3, 2, 5]  # the smallest axis is the third
    data = np.arange(120, dtype=np.float32).reshape(shape)
    df = spark.createDataFrame([("f", data.ravel().tolist())], "path string, data array<float>")
    got = {(r.z, r.y, r.x): (r.a, r.b) for r in tiff.stack_channels(df, shape, ("a", "b")).collect()}
    assert got == {(z, y, x): (data[z, y, 0, x], data[z, y, 1, x]) for z in range(4) for y in range(3) for x in range(5)}
    with pytest.raises(ValueError, match="names"):
        tiff.stack_channels(df, shape)


def test_prediction_files(spark, tmp_path):
    objects = spark.createDataFrame([("m", "p", s, z, z, 1, k + 1) for k, s in enumerate(("a", "b")) for z in range(3)], "model string, parent string, stem string, z int, y int, x int, label int")
    done = tiff.write_predictions(objects, f"file://{tmp_path}/results", (3, 4, 2)).collect()
    assert len(done) == 4
    labels = tiff.decode((tmp_path / "results/m/p/b/b_labels.tif").read_bytes())
    binary = tiff.decode((tmp_path / "results/m/p/b/b_binary.tif").read_bytes())
    assert labels.dtype == np.uint16 and labels[1, 1, 1] == 2 and labels.sum() == 6 and binary.sum() == 3 and binary.dtype == np.uint8
    assert not [p for p in tmp_path.rglob("*") if p.is_file() and p.suffix != ".tif"]


def test_lookup_splits_labels(spark, tmp_path):
    labels = [0] * 27
    labels[0] = labels[26] = labels[25] = 4
    row = spark.createDataFrame([("train", "d", 1, 7, [1.0] * 27, labels), ("train", "d", 1, 8, [1.0] * 27, [0] * 27)], patches.PATCH)
    patches.write(row, str(tmp_path / "set"), 27)
    stored = patches.read(spark, str(tmp_path / "set"))
    assert patches.lookup(stored, 7).first().labels == labels
    again = patches.lookup(stored, 7, (3, 3, 3)).first().labels
    assert (again[0], again[25], again[26], sum(again)) == (1, 2, 2, 5)
    assert patches.lookup(stored, 8, (3, 3, 3)).first().labels == [0] * 27
    found = {r.column: (r.type, r.partition) for r in patches.described(spark, str(tmp_path / "set")).collect()}
    assert found["split"] == ("string", True) and found["labels"] == ("array<int>", False)


def test_pages_as_bytes(spark):
    df = spark.createDataFrame([(2, 1, 0, 0, 0.5), (2, 1, 0, 1, 1.0)], "patch_id long, z int, y int, x int, v double")
    assert [(r.page, r.v) for r in patch.export_pages(df, 4, as_bytes=True).orderBy("x").collect()] == [(9, 127), (9, 255)]


def test_zoom_draws_its_crop(spark):
    df = cube(spark, 6).withColumn("label", F.lit(1))
    out = augment.zoom(df.drop("v", "vid"), 6, (150, 50, 100), seed=4)
    assert out.count() == 216 and out.filter("label = 1").count() == 6 * 3 * 6
    linear = augment.zoom(df, 6, (150, 100, 100), value="v", order=1)
    assert linear.count() == 216
