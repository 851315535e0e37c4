"""Whole analyses as compositions of operators: segmentation, patch sets, score tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import blocks, field, neighbors, patch, project, regions, score
from ..operators.neighbors import AXES


def seeds(ends: DataFrame, n: int, n_std: float = 5.0, weights: list[float] | None = None, integer: bool = True) -> DataFrame:
    """(img, z, y, x, label): components of the smoothed endpoint density above mean + n_std deviations
    of the whole n-sided volume, absent voxels counting as zero."""
    density = field.endpoint_density(ends).withColumn("v", F.col("n"))
    smooth = neighbors.smooth(density, n, weights or neighbors.gaussian_weights(1.0), integer).checkpoint()  # read for its deviation and for its cells
    high = project.density_threshold(smooth, n_std, voxels=n**3)
    vid = (F.col("z") * n + F.col("y")) * n + F.col("x")
    high = high.withColumn("vid", vid.cast("long")).checkpoint()
    numbered = neighbors.dense_labels(neighbors.connected_components(high, 26).checkpoint())
    return high.join(numbered.select("img", "vid", F.col("component_id").alias("label")), ["img", "vid"]).select("img", *AXES, "label")


def segment(vectors: DataFrame, n: int, iterations: int = 200, n_std: float = 5.0, radius: int = 5, least: int = 20) -> DataFrame:
    """(img, vid, z, y, x, label): instances from foreground voxels with unit vectors (uz, uy, ux).

    Each voxel's path is integrated, path ends make seeds, a voxel takes the nearest seed's
    label at its start, and small objects go."""
    paths = field.integrate(vectors, iterations).checkpoint()  # read by four steps
    ends = paths.select("img", F.col("vid").alias("pid"), *[F.col(f"e{a}").alias(a) for a in AXES])
    ends = project.in_bounds(ends, (n, n, n))
    found = field.nearest_seed(ends, seeds(ends, n, n_std), radius)
    own = paths.select("img", F.col("vid").alias("pid"), *AXES).join(found, ["img", "pid"]).withColumnRenamed("pid", "vid")
    return project.drop_small(own.filter("label > 0"), "label", least).select("img", "vid", *AXES, "label")


def segment_blocks(vectors: DataFrame, lattice: blocks.Lattice, iterations: int = 200, n_std: float = 5.0, radius: int = 5, least: int = 20, halo: int = 8) -> DataFrame:
    """segment() of volumes of any shape, all steps by blocks: no step needs a whole image in one task."""
    n = lattice.shape[0] * lattice.shape[1] * lattice.shape[2]
    paths = blocks.integrate(vectors, lattice, iterations, halo=halo)
    ends = paths.select("img", F.col("vid").alias("pid"), *[F.col(f"e{a}").alias(a) for a in AXES])
    ends = project.in_bounds(ends, lattice.shape)
    density = field.endpoint_density(ends).withColumn("v", F.col("n"))
    smooth = blocks.smooth(density, lattice, neighbors.gaussian_weights(1.0)).checkpoint()  # read for its deviation and for its cells
    high = project.density_threshold(smooth, n_std, voxels=n)
    vid = (F.col("z") * lattice.shape[1] + F.col("y")) * lattice.shape[2] + F.col("x")
    high = high.withColumn("vid", vid.cast("long")).checkpoint()
    numbered = neighbors.dense_labels(blocks.connected_components(high, lattice)).select("img", "vid", F.col("component_id").alias("label"))
    found = field.nearest_seed(ends, high.join(numbered, ["img", "vid"]).select("img", *AXES, "label"), radius)
    own = paths.select("img", F.col("vid").alias("pid"), *AXES).join(found, ["img", "pid"]).withColumnRenamed("pid", "vid")
    return project.drop_small(own.filter("label > 0"), "label", least).select("img", "vid", *AXES, "label")


def encode_targets(labelled: DataFrame, least: int = 20) -> DataFrame:
    """labelled with unit displacement vectors and one-hot channels."""
    out = project.one_hot(regions.target_vectors(labelled, "label", least))
    return project.unit_vectors(out).withColumnsRenamed({f"ud{a}": f"u{a}" for a in AXES})


def training_patches(labelled: DataFrame, n: int, grid: patch.Grid, percent: int = 5) -> DataFrame:
    """Patch voxels (img, g*, o*, v, label) of percentile-rescaled, padded volumes that carry enough signal."""
    scaled = project.percentile_rescale(labelled).withColumn("v", F.col("rescaled"))
    voxels = patch.patchify(scaled, grid, grid.padded(n))
    keep = patch.signal_filter(voxels.groupBy("img", "gz", "gy", "gx").agg(F.count_if(F.col("label") > 0).alias("n_signal")), percent)
    return voxels.join(keep.select("img", "gz", "gy", "gx"), ["img", "gz", "gy", "gx"], "left_semi")


def sampled_patches(labelled: DataFrame, n: int, size: int, budget: int, percent: int = 5, seed: int = 0, tries: int = 5) -> DataFrame:
    """(img, k, z, y, x, n_signal): `budget` random patch starts with enough signal.

    Budgets follow the images' sizes; an attempt oversamples, each next one doubles it.
    Only counts come to the driver."""
    volumes = labelled.groupBy("img").agg(F.count("*").alias("weight"))
    factor, out = 2, None
    for attempt in range(tries):
        shares = patch.largest_remainder(volumes.withColumnRenamed("img", "item"), budget * factor).select(F.col("item").alias("img"), "share")
        starts = shares.filter("share > 0").withColumn("k", F.explode(F.sequence(F.lit(0), (F.col("share") - 1).cast("int"))))
        starts = starts.withColumns({f"s{a}": (patch.mixed(F.col("img"), F.col("k"), F.lit(a), salt=seed + attempt) % (n - size + 1)).cast("int") for a in AXES})
        # each patch covers whole cells of its own size's grid: join on the cells it can touch
        cells = F.array(*[F.struct(*[F.lit(v).alias(a) for v, a in zip(c, AXES, strict=True)]) for c in ((i, j, k) for i in (0, 1) for j in (0, 1) for k in (0, 1))])
        touched = starts.withColumn("c_", F.explode(cells)).select("img", "k", *[f"s{a}" for a in AXES], *[(F.floor(F.col(f"s{a}") / size) + F.col(f"c_.{a}")).alias(f"c{a}") for a in AXES])
        signal = labelled.filter("label > 0").select("img", *AXES, *[F.floor(F.col(a) / size).alias(f"c{a}") for a in AXES])
        inside = F.lit(True)
        for a in AXES:
            inside = inside & F.col(a).between(F.col(f"s{a}"), F.col(f"s{a}") + size - 1)
        counts = touched.join(signal, ["img", *[f"c{a}" for a in AXES]]).filter(inside).groupBy("img", "k", *[f"s{a}" for a in AXES]).agg(F.count("*").alias("n_signal"))
        kept = patch.signal_filter(counts, percent)
        out = kept.orderBy(patch.mixed(F.col("img"), F.col("k"), salt=seed), "img", "k").limit(budget)
        if out.count() >= budget:
            break
        factor *= 2
    return out.select("img", "k", *[F.col(f"s{a}").alias(a) for a in AXES], "n_signal")


def score_table(labelled: DataFrame, n: int, dataset: str) -> DataFrame:
    """Features of a dataset's objects with condition and tissue: properties, centroid region, class."""
    objects = regions.region_of_centroid(regions.properties(labelled), labelled, n)
    out = score.tissue(objects, dataset)
    return out.withColumns({"volume": F.col("area"), "dapi_sum": F.col("sum_v"), "dapi_mean": F.col("sum_v") / F.col("area")})


def smooth_predict(df: DataFrame, n: patch.Sizes, window: int, predict, subdivisions: int = 2, mode: str = "spline") -> DataFrame:
    """(img, z, y, x, v): an opaque scorer over sliding windows, weighted by a 3D window, summed and divided by
    subdivisions cubed; predict(DataFrame with image arrays of window**3 values) -> the same with predictions.

    The volume (sides n) is padded by reflection; windows are rows, sums one aggregate keyed by voxel."""
    from ..operators import augment
    from ..sources.patches import gathered

    sides = tuple(patch.by_axis(n).values())
    left, length = (tuple(x) for x in zip(*[patch.view_padding(k, window, subdivisions) for k in sides], strict=True))
    grid = patch.Grid(window, window // subdivisions)
    padded = patch.pad(df.select("img", *AXES, "v"), sides, length, "reflect", left).withColumn("label", F.lit(0))
    blocks = gathered(patch.patchify(padded, grid, length), window).drop("labels")
    done = field.scored(blocks, predict, "img long, gz int, gy int, gx int, image array<float>")
    weights = F.array(*map(F.lit, augment.window_3d(window, mode)))
    cells = done.select("img", "gz", "gy", "gx", F.posexplode(F.zip_with("image", weights, lambda v, w: v * w)).alias("i", "v"))
    place = {"z": F.floor(F.col("i") / window**2), "y": F.floor(F.col("i") / window) % window, "x": F.col("i") % window}
    at = [(F.col(f"g{a}") * grid.step + place[a]).cast("int").alias(a) for a in AXES]
    sums = cells.select("img", *at, "v").groupBy("img", *AXES).agg((F.sum("v") / subdivisions**3).alias("v"))
    return patch.unpad(sums, sides, left)


def smooth_predict_views(df: DataFrame, n: patch.Sizes, window: int, predict, subdivisions: int = 2, mode: str = "spline") -> DataFrame:
    """(img, z, y, x, v): smooth_predict() over every view of the volume, put back and averaged.  Views that turn a box
    have other sides; those of equal sides go through together."""
    from ..operators import augment

    views = augment.views(df.select("img", *AXES, "v"), n).withColumn("img", F.col("img") * 27 + F.col("view"))
    sides, done = augment.view_sides(n), None
    for shape in sorted(set(sides)):
        mine = views.filter(F.col("view").isin([k for k, s in enumerate(sides) if s == shape]))
        part = smooth_predict(mine, shape, window, predict, subdivisions, mode)
        done = part if done is None else done.unionByName(part)
    back = augment.unview(done.withColumns({"view": F.pmod(F.col("img"), F.lit(27)).cast("int"), "img": F.floor(F.col("img") / 27).cast("long")}), n)
    return back.groupBy("img", *AXES).agg(F.avg("v").alias("v"))
