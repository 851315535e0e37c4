"""Queries of the block operators and of the augmentation chain, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import augment, blocks, chain, field, neighbors, patch, restore
from ..operators.neighbors import AXES
from ..sources import views
from ..sources.views import SIDE
from ..streaming import training
from . import pipelines
from .catalog import _MIX, ORACLE_SQL, _ends, _plus_seven, fixed, query

#: Volumes of ten cells a side, in blocks that do not divide them.
_TEN = blocks.Lattice((SIDE, SIDE, SIDE), (4, 5, 6))
#: The same events as volumes of five planes.
_FIVE = blocks.Lattice((5, SIDE, SIDE), (3, 4, 7))
_BOXES = views.BOXES_SQL
_boxes = views.boxes
_SIDES = (5, SIDE, SIDE)


def _density(spark, sf_dir):
    return field.endpoint_density(_ends(spark, sf_dir)).withColumn("v", F.col("n") * 1000)


@query(ORACLE_SQL["gaussian_density"])
def gaussian_density_blocks(spark, sf_dir):
    return blocks.smooth(_density(spark, sf_dir), _TEN, neighbors.gaussian_weights(1.0)).filter("v > 0").withColumn("v", F.col("v").cast("bigint"))


@query(ORACLE_SQL["gaussian_blur"])
def gaussian_blur_blocks(spark, sf_dir):
    return blocks.smooth(_density(spark, sf_dir), _TEN, neighbors.gaussian_weights(1.0), integer=False).withColumn("v", fixed(F.col("v"), 2))


@query(f"WITH {_BOXES}, o AS (SELECT unnest([-1, 0, 1]) AS d)" + """
SELECT img, z, y, x, v FROM (SELECT a.img, a.z, a.y, a.x, a.v, max(b.v) AS m FROM boxes a JOIN o p ON true JOIN o q ON true JOIN o r ON true
JOIN boxes b ON b.img = a.img AND b.z = a.z + p.d AND b.y = a.y + q.d AND b.x = a.x + r.d WHERE a.v > 9000 GROUP BY ALL) WHERE v = m""")
def local_maxima_boxes(spark, sf_dir):
    """Maxima of volumes of 5 by 10 by 10 cells."""
    return blocks.local_maxima(_boxes(spark, sf_dir), _FIVE, 1, 9000)


@query(f"WITH {_BOXES}, o AS (SELECT * FROM (VALUES (-1, 1), (0, 2), (1, 1)) q(d, s))" + """
SELECT a.img, a.z, a.y, a.x, CAST(sum(p.d * q.s * r.s * b.v) AS BIGINT) AS gz, CAST(sum(p.s * q.d * r.s * b.v) AS BIGINT) AS gy, CAST(sum(p.s * q.s * r.d * b.v) AS BIGINT) AS gx
FROM boxes a JOIN o p ON true JOIN o q ON true JOIN o r ON true JOIN boxes b ON b.img = a.img AND b.z = a.z + p.d AND b.y = a.y + q.d AND b.x = a.x + r.d GROUP BY ALL HAVING count(*) = 27""")
def sobel_boxes(spark, sf_dir):
    return blocks.sobel(_boxes(spark, sf_dir), _FIVE)


def _border_labels():
    v = F.col("v")
    return F.when(v > 200, 1 + 4 * F.floor(F.col("z") / 5) + 2 * F.floor(F.col("y") / 5) + F.floor(F.col("x") / 5)).otherwise(0).cast("int")


@query(f"WITH {_BOXES}, o AS (SELECT unnest([-1, 0, 1]) AS d), big AS (SELECT *, CASE WHEN v > 200 THEN 1 + 4 * floor(z / 5) + 2 * floor(y / 5) + floor(x / 5) ELSE 0 END AS label FROM boxes)," + """
core AS (SELECT a.img, a.z, a.y, a.x FROM big a JOIN o p ON true JOIN o q ON true JOIN o r ON true JOIN big b ON b.img = a.img AND b.z = a.z + p.d AND b.y = a.y + q.d AND b.x = a.x + r.d AND b.label = a.label
  WHERE a.label > 0 GROUP BY ALL HAVING count(*) = 27),
wide AS (SELECT DISTINCT img, CAST(z + p.d AS INT) AS z, CAST(y + q.d AS INT) AS y, CAST(x + r.d AS INT) AS x FROM core JOIN o p ON true JOIN o q ON true JOIN o r ON true)
SELECT w.img, w.z, w.y, w.x, CASE WHEN c.img IS NULL THEN 127 ELSE 255 END AS mark FROM wide w LEFT JOIN core c USING (img, z, y, x)
WHERE w.z BETWEEN 0 AND 4 AND w.y BETWEEN 0 AND 9 AND w.x BETWEEN 0 AND 9""")
def border_labels_boxes(spark, sf_dir):
    return blocks.border_labels(_boxes(spark, sf_dir).withColumn("label", _border_labels()), _FIVE)


@query(ORACLE_SQL["connected_components_26"])
def components_26_blocks(spark, sf_dir):
    return blocks.connected_components(views.voxels(spark, sf_dir).filter("v > 14700"), _TEN, 26)


@query(ORACLE_SQL["connected_components_6"])
def components_6_blocks(spark, sf_dir):
    return blocks.connected_components(views.voxels(spark, sf_dir).filter("v > 10000"), _TEN, 6)


@query()
def integrate_blocks(spark, sf_dir):
    """Ends of all paths, points handed on between blocks (rows-only: 200 steps in floating point; equal to the one-task kernel by test)."""
    vectors = pipelines.encode_targets(views.labelled(spark, sf_dir)).filter("label > 0")
    return blocks.integrate(vectors, _TEN, halo=3).select("img", "vid", "ez", "ey", "ex")


@query()
def segment_instances_blocks(spark, sf_dir):
    """Instances of volumes of 5 by 10 by 10 cells, every step by blocks (rows-only: equal to the whole-image form by test)."""
    labelled = _boxes(spark, sf_dir).withColumn("label", _border_labels())
    return pipelines.segment_blocks(pipelines.encode_targets(labelled).filter("label > 0"), _FIVE, n_std=2.0, halo=3)


@query()
def watershed_forest(spark, sf_dir):
    """Voxels by the marker that floods them (rows-only: Boruvka rounds; Kruskal's forest in the tests)."""
    df = views.voxels(spark, sf_dir).withColumn("marker", F.when(F.col("v") > 17_500, 1 + F.col("vid") % 1000).otherwise(0))
    return neighbors.watershed(df)


# ---- boxes -----------------------------------------------------------------------------


def _linear(side: int, size: int) -> str:
    """SQL: (p, s, w), the weights of samples s in outputs p."""
    rows = []
    for p in range(size):
        at = min(max((2 * p + 1) * side / (2 * size) - 0.5, 0), side - 1)
        rows += [(p, s, 1 - abs(at - s)) for s in range(side) if abs(at - s) < 1]
    return "(VALUES " + ", ".join(f"({p}, {s}, CAST({w!r} AS DOUBLE))" for p, s, w in rows) + ") "


@query(f"WITH {_BOXES}, a AS (SELECT * FROM {_linear(5, 9)} q(p, s, w)), b AS (SELECT * FROM {_linear(10, 7)} q(p, s, w)), c AS (SELECT * FROM {_linear(10, 13)} q(p, s, w))" + """
SELECT img, a.p AS z, b.p AS y, c.p AS x, CAST(floor(sum(a.w * b.w * c.w * v) * 100 + 0.49) AS BIGINT) AS v FROM boxes JOIN a ON z = a.s JOIN b ON y = b.s JOIN c ON x = c.s GROUP BY ALL""")
def rescale_linear_boxes(spark, sf_dir):
    """Volumes of 5 by 10 by 10 cells at 9 by 7 by 13."""
    # weights are 6552nds, whose hundreds fall on halves: 0.49 keeps them off the edge of rounding
    return field.resample_linear(_boxes(spark, sf_dir), (9, 7, 13), None, _SIDES).withColumn("v", F.floor(F.col("v") * 100 + 0.49).cast("bigint"))


@query(f"WITH {_BOXES}, l AS (SELECT *, CASE WHEN v > 3500 THEN 1 + 4 * floor(z / 3) + 2 * floor(y / 5) + floor(x / 5) ELSE 0 END AS label FROM boxes)," + """
s AS (SELECT img, label, count(*) AS n FROM l WHERE label > 0 GROUP BY ALL), r AS (SELECT img, avg(cbrt(3 * n / (4 * pi()))) AS r FROM s GROUP BY img), i AS (SELECT CAST(unnest(range(60)) AS INT) AS p),
m AS (SELECT img, CAST(trunc(5 * 3.0 / r) AS INT) AS mz, CAST(trunc(10 * 3.0 / r) AS INT) AS my FROM r),
tz AS (SELECT img, p, CAST(floor((2 * p + 1) * 5 / (2 * mz)) AS INT) AS s FROM m, i WHERE p < mz), ty AS (SELECT img, p, CAST(floor((2 * p + 1) * 10 / (2 * my)) AS INT) AS s FROM m, i WHERE p < my)
SELECT l.img, a.p AS z, b.p AS y, c.p AS x, CAST(label AS INT) AS label FROM l JOIN tz a ON a.img = l.img AND a.s = l.z JOIN ty b ON b.img = l.img AND b.s = l.y JOIN ty c ON c.img = l.img AND c.s = l.x""")
def rescale_by_radius_boxes(spark, sf_dir):
    label = F.when(F.col("v") > 3500, 1 + 4 * F.floor(F.col("z") / 3) + 2 * F.floor(F.col("y") / 5) + F.floor(F.col("x") / 5)).otherwise(0).cast("int")
    return field.rescale_by_radius(_boxes(spark, sf_dir).withColumn("label", label), _SIDES, 3.0).select("img", *AXES, "label")


@query(f"WITH {_BOXES} SELECT img, z, y, x, CAST(27 * v AS BIGINT) AS sum_v, CAST(27 AS BIGINT) AS n_views FROM boxes")
def view_average_boxes(spark, sf_dir):
    """Views of a box have other sides; each cell gets its own value back from every one."""
    df = _boxes(spark, sf_dir).select("img", *AXES, "v")
    return augment.view_average(augment.unview(augment.views(df, _SIDES), _SIDES))


def _mirror(name: str, side: int, length: int, left: int) -> str:
    period = 2 * (side - 1)
    at = f"(p + {period - left}) % {period}"
    return f"{name} AS (SELECT p, CASE WHEN {at} < {side} THEN {at} ELSE {period} - {at} END AS s FROM (SELECT unnest(range({length})) AS p))"


def _windows_boxes_sql() -> str:
    (lz, nz), (ly, ny) = (patch.view_padding(k, 4, 2) for k in (5, SIDE))
    cells = ", ".join(f"({i // 16}, {i // 4 % 4}, {i % 4}, CAST({w!r} AS DOUBLE))" for i, w in enumerate(augment.window_3d(4)))
    return f"""WITH {_BOXES}, {_mirror("mz", 5, nz, lz)}, {_mirror("my", SIDE, ny, ly)},
pd AS (SELECT img, a.p AS z, b.p AS y, c.p AS x, v FROM boxes JOIN mz a ON z = a.s JOIN my b ON y = b.s JOIN my c ON x = c.s),
gz AS (SELECT unnest(range({(nz - 4) // 2 + 1})) * 2 AS k), gy AS (SELECT unnest(range({(ny - 4) // 2 + 1})) * 2 AS k), w AS (SELECT * FROM (VALUES {cells}) q(oz, oy, ox, w))
SELECT img, CAST(z - {lz} AS INT) AS z, CAST(y - {ly} AS INT) AS y, CAST(x - {ly} AS INT) AS x, CAST(floor(sum(w * (v + 7)) / 8 * 100 + 0.5) AS BIGINT) AS v
FROM pd JOIN gz a ON z BETWEEN a.k AND a.k + 3 JOIN gy b ON y BETWEEN b.k AND b.k + 3 JOIN gy c ON x BETWEEN c.k AND c.k + 3 JOIN w ON oz = z - a.k AND oy = y - b.k AND ox = x - c.k
WHERE z BETWEEN {lz} AND {lz + 4} AND y BETWEEN {ly} AND {ly + 9} AND x BETWEEN {ly} AND {ly + 9} GROUP BY ALL"""


@query(_windows_boxes_sql())
def sliding_windows_boxes(spark, sf_dir):
    """A scorer that adds seven, over weighted windows of volumes of 5 by 10 by 10 cells."""
    return pipelines.smooth_predict(_boxes(spark, sf_dir), _SIDES, 4, _plus_seven).withColumn("v", fixed(F.col("v"), 2))


# ---- restoration and training input ----------------------------------------------------


@query()
def wiener_gibbs(spark, sf_dir):
    """Planes deconvolved with their noise level drawn (rows-only: planted noise comes back in the tests)."""
    return restore.unsupervised_wiener(views.voxels(spark, sf_dir), (SIDE, SIDE), steps=60, burn=20)


@query()
def rows_aligned(spark, sf_dir):
    """Even and odd rows brought together by flow (rows-only: planted shifts come back in the tests)."""
    return restore.align_rows(views.voxels(spark, sf_dir), (SIDE, SIDE))


@query(ORACLE_SQL["unit_vectors"])
def training_targets(spark, sf_dir):
    """A set in mixed order through an epoch's input as it is: every voxel with the vectors of its target."""
    stored = training.mixed_order(_samples(spark, sf_dir), 3)
    rows = training.epoch(stored, 0, (SIDE, SIDE, SIDE), 4, "img", None)
    cells = rows.select("img", F.posexplode(F.arrays_zip(*[F.col(f"v{a}").cast("array<double>").alias(f"v{a}") for a in AXES])).alias("i", "c"))
    # vectors pass as floats: a ten thousandth is kept off the edge of rounding
    return cells.select((F.col("img") * 1000 + F.col("i")).alias("vid"), *[fixed(F.col(f"c.v{a}") + F.signum(f"c.v{a}") * 1e-8).alias(f"u{a}") for a in AXES])


# ---- the augmentation chain ------------------------------------------------------------


def _drawn(name: str) -> str:
    return _MIX.format(f"img, '{name}', 0")


def _share(name: str, low: float, high: float) -> str:
    return f"{low!r}::DOUBLE + {_drawn(name)} / 4294967296.0::DOUBLE * ({high - low!r})::DOUBLE"


def _parameters_sql(rules: chain.ChainRules) -> str:
    """SQL of chain.parameters(), by sample, without its seeds."""
    coin = lambda k: f"{_drawn('changed')} % 100 < {rules.percent} AND {_drawn(k)} % 100 < {rules.coin}" if k in rules.only else "false"
    columns = [f"{_drawn('changed')} % 100 < {rules.percent} AS changed", *[f"{coin(k)} AS do_{k}" for k in chain.CHAIN]]
    columns += [f"CAST(1 + {_drawn(f'step {a}')} % 2 AS INT) AS step_{a}" for a in AXES]
    columns += [f"CAST({_drawn('axis')} % 3 AS INT) AS flip_axis", f"{_drawn('swap')} % 2 = 1 AS swap"]
    columns += [f"{_share(k, *rules.brightness)} AS {k}" for k in ("gain", "gamma")] + [f"{_share('degrees', 0.0, rules.degrees)} AS degrees"]
    columns += [f"{_share(f'zoom {a}', *rules.zoom)} AS zoom_{a}" for a in AXES]
    return "SELECT img, " + ", ".join(columns) + " FROM (SELECT DISTINCT img FROM voxels)"


_REAL = ["gain", "gamma", "degrees", *[f"zoom_{a}" for a in AXES]]


@query("{views}, p AS (" + _parameters_sql(chain.ChainRules()) + ") SELECT * REPLACE (" + ", ".join(f"CAST(floor({c} * 1e6 + 0.5) AS BIGINT) AS {c}" for c in _REAL) + ") FROM p")
def augment_parameters(spark, sf_dir):
    """What each sample draws for the chain."""
    drawn = chain.parameters(F.col("img"))
    samples = views.voxels(spark, sf_dir).select("img").distinct().withColumns({k: c for k, c in drawn.items() if not k.endswith("_seed") and not k.startswith("crop") and k != "sigma"})
    return samples.withColumns({c: fixed(F.col(c), 6) for c in _REAL})


def _samples(spark, sf_dir):
    return chain.dense_samples(views.labelled(spark, sf_dir), F.col("v") / 20_000, F.col("label"))


def _cells(samples):
    """A row for each cell, the image in millionths."""
    i = F.col("i")
    at = {"z": F.floor(i / 100), "y": F.floor(i % 100 / 10), "x": i % 10}
    rows = samples.select("img", F.posexplode(F.arrays_zip("image", "labels")).alias("i", "c"))
    return rows.select("img", *[c.cast("int").alias(a) for a, c in at.items()], fixed(F.col("c.image"), 6).alias("v"), F.col("c.labels").alias("label"))


_EXACT = chain.ChainRules(only=("downsample", "flip", "transpose"))


@query("{views}, p AS (" + _parameters_sql(_EXACT) + """),
t AS (SELECT p.*, z, CASE WHEN do_transpose AND swap THEN x ELSE y END AS y1, CASE WHEN do_transpose AND swap THEN y ELSE x END AS x1, z AS oz, y AS oy, x AS ox FROM p JOIN (SELECT img, z, y, x FROM voxels) USING (img)),
f AS (SELECT *, CASE WHEN do_flip AND flip_axis = 0 THEN 9 - z ELSE z END AS sz, CASE WHEN do_flip AND flip_axis = 1 THEN 9 - y1 ELSE y1 END AS sy, CASE WHEN do_flip AND flip_axis = 2 THEN 9 - x1 ELSE x1 END AS sx FROM t)
SELECT f.img, oz AS z, oy AS y, ox AS x, CAST(floor(CAST(CAST(s.v / 20000.0::DOUBLE AS FLOAT) AS DOUBLE) * 1e6 + 0.5) AS BIGINT) AS v, l.label FROM f
JOIN vl l ON l.img = f.img AND l.z = sz AND l.y = sy AND l.x = sx
JOIN voxels s ON s.img = f.img AND s.z = sz - CASE WHEN do_downsample THEN sz % step_z ELSE 0 END AND s.y = sy - CASE WHEN do_downsample THEN sy % step_y ELSE 0 END AND s.x = sx - CASE WHEN do_downsample THEN sx % step_x ELSE 0 END""")
def augment_moves(spark, sf_dir):
    """The chain with those steps that move whole cells, each sample by its own draws."""
    return _cells(chain.augmented(_samples(spark, sf_dir), (SIDE, SIDE, SIDE), F.col("img"), _EXACT))


@query()
def augment_chain(spark, sf_dir):
    """The whole chain (rows-only: noise and elastic grids come from a generator; a plain version is in the tests)."""
    return _cells(chain.augmented(_samples(spark, sf_dir), (SIDE, SIDE, SIDE), F.col("img")))
