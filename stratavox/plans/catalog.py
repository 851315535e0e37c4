"""One query per operator over the driver's tables, and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import augment, field, metrics, neighbors, patch, prep, project, regions, score
from ..sources import views
from ..sources.views import SIDE
from . import datasets, pipelines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
AXES = neighbors.AXES


def query(sql: str | None = None):
    """Registers a query under its function's name; {views} in sql stands for the shared views."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql.replace("{views}", "WITH RECURSIVE " + views.SQL)
        return f

    return add


def fixed(c, digits: int = 4):
    """A double as an integer of so many decimals."""
    return F.floor(c * 10**digits + 0.5).cast("bigint")


# ---- projections -----------------------------------------------------------------------


@query("""{views} SELECT vid, (v - min(v) OVER w) / nullif(CAST(max(v) OVER w - min(v) OVER w AS DOUBLE), 0) AS norm FROM voxels WINDOW w AS (PARTITION BY img)""")
def minmax_normalize(spark, sf_dir):
    return project.minmax(views.voxels(spark, sf_dir)).select("vid", "norm")


@query("""{views}, p AS (SELECT img, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.998) AS hi FROM voxels GROUP BY img)
SELECT vid, CAST(floor(greatest(0.0, least(1.0, (v - lo) / nullif(hi - lo, 0))) * 10000 + 0.5) AS BIGINT) AS rescaled FROM voxels JOIN p USING (img)""")
def percentile_rescale(spark, sf_dir):
    return project.percentile_rescale(views.voxels(spark, sf_dir)).select("vid", fixed(F.col("rescaled")).alias("rescaled"))


@query("""{views} SELECT vid, CASE WHEN img % 2 = 0 THEN max(v) OVER (PARTITION BY img) - v ELSE v END AS v FROM voxels""")
def invert_by_path(spark, sf_dir):
    df = views.voxels(spark, sf_dir).withColumn("path", F.concat(F.lit("/data/"), F.when(F.col("img") % 2 == 0, "Mouse").otherwise("Liver"), F.lit("/"), F.col("img").cast("string")))
    return project.invert_where(df, project.path_mentions(F.col("path"), "Mouse")).select("vid", "v")


_GRID = patch.Grid(4, 3)
_COVER = """g AS (SELECT unnest(range(3)) AS k),
cover AS (SELECT img, gz.k AS gz, gy.k AS gy, gx.k AS gx, z - gz.k * 3 AS oz, y - gy.k * 3 AS oy, x - gx.k * 3 AS ox, v, label
  FROM vl JOIN g gz ON z BETWEEN gz.k * 3 AND gz.k * 3 + 3 JOIN g gy ON y BETWEEN gy.k * 3 AND gy.k * 3 + 3 JOIN g gx ON x BETWEEN gx.k * 3 AND gx.k * 3 + 3)"""
_PLACE = [*[f"g{a}" for a in AXES], *[f"o{a}" for a in AXES]]


def _patches(spark, sf_dir):
    return patch.patchify(views.labelled(spark, sf_dir), _GRID, _GRID.padded(SIDE))


@query("{views}, " + _COVER + " SELECT img, gz, gy, gx, oz, oy, ox, v FROM cover")
def patch_grid(spark, sf_dir):
    return _patches(spark, sf_dir).select("img", *_PLACE, "v")


@query("""{views} SELECT img, CAST(floor(z / 4) AS INT) AS gz, CAST(floor(y / 4) AS INT) AS gy, CAST(floor(x / 4) AS INT) AS gx, z % 4 AS oz, y % 4 AS oy, x % 4 AS ox, v
FROM voxels WHERE z < 8 AND y < 8 AND x < 8""")
def patch_grid_val(spark, sf_dir):
    """Validation patches: padded for the training step, cut without overlap, the rest dropped."""
    return patch.patchify(views.voxels(spark, sf_dir), patch.Grid(4, 4), _GRID.padded(SIDE)).select("img", *_PLACE, "v")


@query("{views}, " + _COVER + """, c AS (SELECT img, gz, gy, gx, count(*) FILTER (label > 0) AS n_signal FROM cover GROUP BY ALL)
SELECT * FROM c WHERE n_signal * 100 > (SELECT max(n_signal) FROM c) * 70""")
def signal_filter(spark, sf_dir):
    counts = _patches(spark, sf_dir).groupBy("img", "gz", "gy", "gx").agg(F.count_if(F.col("label") > 0).alias("n_signal"))
    return patch.signal_filter(counts, 70)


@query("{views}, " + _COVER + """, c AS (SELECT img, gz, gy, gx, count(*) FILTER (label > 0) AS n_signal FROM cover GROUP BY ALL)
SELECT img, gz, gy, gx, n_signal FROM (SELECT *, max(n_signal) OVER (PARTITION BY img) AS top FROM c) WHERE n_signal * 100 > top * 80""")
def signal_filter_by_attempt(spark, sf_dir):
    counts = _patches(spark, sf_dir).groupBy("img", "gz", "gy", "gx").agg(F.count_if(F.col("label") > 0).alias("n_signal"))
    return patch.signal_filter(counts, 80, within=("img",)).select("img", "gz", "gy", "gx", "n_signal")


@query("""{views} SELECT * FROM (SELECT vid, CAST(trunc(z + (v % 700 - 350) / 100.0) AS INT) AS z, CAST(trunc(y + (v % 500 - 250) / 100.0) AS INT) AS y, CAST(trunc(x + (v % 300 - 150) / 100.0) AS INT) AS x FROM voxels)
WHERE z BETWEEN 0 AND 9 AND y BETWEEN 0 AND 9 AND x BETWEEN 0 AND 9""")
def bounds_filter(spark, sf_dir):
    moved = views.voxels(spark, sf_dir).select("vid", *[project.truncated(F.col(a) + (F.col("v") % m - m // 2) / F.lit(100.0)).alias(a) for a, m in (("z", 700), ("y", 500), ("x", 300))])
    return project.in_bounds(moved, (SIDE, SIDE, SIDE))


@query("""{views} SELECT vid, label_sparse FROM (SELECT *, count(*) OVER (PARTITION BY img, label_sparse) AS n FROM vl WHERE label_sparse > 0) WHERE n >= 20""")
def small_object_filter(spark, sf_dir):
    return project.drop_small(views.labelled(spark, sf_dir), "label_sparse", 20).select("vid", "label_sparse")


@query("""{views} SELECT vid, CASE WHEN v * 7 % 100 > v % 100 THEN 1 ELSE 0 END AS fg FROM voxels""")
def argmax_class(spark, sf_dir):
    return views.voxels(spark, sf_dir).select("vid", project.argmax_class(F.col("v") % 100, F.col("v") * 7 % 100).alias("fg"))


@query("""{views}, s AS (SELECT img, count(*) AS n, sum(v) AS s, sum(v * v) AS q FROM voxels GROUP BY img)
SELECT vid, v FROM voxels JOIN s USING (img) WHERE CAST(n * v - s AS DOUBLE) > 2.0 * sqrt(CAST(n * q - s * s AS DOUBLE))""")
def density_threshold(spark, sf_dir):
    return project.density_threshold(views.voxels(spark, sf_dir), 2.0).select("vid", "v")


@query("""{views} SELECT vid, CASE WHEN label > 0 THEN 0 ELSE 1 END AS background, CASE WHEN label > 0 THEN 1 ELSE 0 END AS foreground FROM vl""")
def one_hot_mask(spark, sf_dir):
    return project.one_hot(views.labelled(spark, sf_dir)).select("vid", "background", "foreground")


# ---- padding, stitching, budgets -------------------------------------------------------


def _pad_sql(rule: str) -> str:
    return "{views}, i AS (SELECT unnest(range(13)) AS p), m AS (SELECT p, " + rule + """ AS s FROM i)
SELECT img, CAST(a.p AS INT) AS z, CAST(b.p AS INT) AS y, CAST(c.p AS INT) AS x, v FROM voxels JOIN m a ON z = a.s JOIN m b ON y = b.s JOIN m c ON x = c.s"""


@query(_pad_sql("CASE WHEN p % 18 < 10 THEN p % 18 ELSE 18 - p % 18 END"))
def pad_reflect(spark, sf_dir):
    return patch.pad(views.voxels(spark, sf_dir), SIDE, patch.Grid(4, 3).padded(SIDE + 1), "reflect").select("img", *AXES, "v")


@query(_pad_sql("p % 10"))
def pad_wrap(spark, sf_dir):
    return patch.pad(views.voxels(spark, sf_dir), SIDE, 13, "wrap").select("img", *AXES, "v")


@query("""{views}, i AS (SELECT unnest(range(13)) AS p), l AS (SELECT img, CAST(a.p AS INT) AS z, CAST(b.p AS INT) AS y, CAST(c.p AS INT) AS x FROM (SELECT DISTINCT img FROM voxels), i a, i b, i c)
SELECT l.img, l.z, l.y, l.x, coalesce(v, 0) AS v FROM l LEFT JOIN voxels o ON o.img = l.img AND o.z = l.z - 1 AND o.y = l.y - 1 AND o.x = l.x - 1""")
def pad_minimum(spark, sf_dir):
    """Centred pad to 1.25 patches a side: one cell before, two after."""
    need = -(-125 * 10 // 100)
    return patch.pad(views.voxels(spark, sf_dir), SIDE, need, "constant", left=(need - SIDE) // 2)


@query("""{views} SELECT img, z - 2 AS z, y - 2 AS y, x - 2 AS x, v FROM voxels WHERE z BETWEEN 2 AND 7 AND y BETWEEN 2 AND 7 AND x BETWEEN 2 AND 7""")
def crop_center(spark, sf_dir):
    return patch.unpad(views.voxels(spark, sf_dir), 6, 2).select("img", *AXES, "v")


@query("{views}, " + _COVER.replace("gz.k * 3", "gz.k * 2").replace("gy.k * 3", "gy.k * 2").replace("gx.k * 3", "gx.k * 2").replace("* 2 + 3", "* 2 + 3").replace("range(3)", "range(4)") + """,
w AS (SELECT *, CASE WHEN gz < 3 AND oz >= 2 THEN 3 - oz WHEN gz > 0 AND oz < 2 THEN oz ELSE 1 END * CASE WHEN gy < 3 AND oy >= 2 THEN 3 - oy WHEN gy > 0 AND oy < 2 THEN oy ELSE 1 END
  * CASE WHEN gx < 3 AND ox >= 2 THEN 3 - ox WHEN gx > 0 AND ox < 2 THEN ox ELSE 1 END AS w FROM cover)
SELECT img, CAST(gz * 2 + oz AS INT) AS z, CAST(gy * 2 + oy AS INT) AS y, CAST(gx * 2 + ox AS INT) AS x, CAST(sum(w * v) AS BIGINT) AS num, CAST(sum(w) AS BIGINT) AS den FROM w GROUP BY ALL""")
def stitch_blend(spark, sf_dir):
    grid = patch.Grid(4, 2)
    return patch.stitch(patch.patchify(views.voxels(spark, sf_dir), grid, SIDE), grid, SIDE)


@query("""WITH t AS (SELECT o_orderpriority AS grp, o_custkey AS item, count(*) AS weight FROM orders GROUP BY ALL),
f AS (SELECT *, sum(weight) OVER (PARTITION BY grp) AS s FROM t),
r AS (SELECT *, CAST(floor(1000 * weight / s) AS BIGINT) AS fl, 1000 * weight - floor(1000 * weight / s) * s AS rest FROM f),
k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY rest DESC, item) AS o, 1000 - sum(fl) OVER (PARTITION BY grp) AS lft FROM r)
SELECT grp, item, weight, CAST(fl + CASE WHEN o <= lft THEN 1 ELSE 0 END AS BIGINT) AS share FROM k""")
def apportion_budget(spark, sf_dir):
    weights = views.table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("grp"), F.col("o_custkey").alias("item")).agg(F.count("*").alias("weight"))
    return patch.largest_remainder(weights, 1000, ("grp",))


_MIX = "CAST('0x' || substr(md5(concat_ws(':', {0})), 1, 8) AS BIGINT)"


@query(f"""WITH h AS (SELECT part.p_partkey, {_MIX.format("p_partkey, 42")} AS h FROM part)
SELECT p_partkey, row_number() OVER (ORDER BY h, p_partkey) <= ceil((SELECT count(*) FROM part) * 10 / 100) AS held FROM h""")
def exact_split(spark, sf_dir):
    return patch.exact_split(views.table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 10, 42)


@query(f"""WITH h AS (SELECT doc_id, source, {_MIX.format("doc_id, 42")} AS h FROM documents)
SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) <= greatest(1, floor(count(*) OVER (PARTITION BY source) * 10 / 100)) AS held FROM h""")
def stratified_split(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "source")
    return patch.exact_split(docs, "doc_id", 10, 42, ("source",), floor=True)


@query(f"""SELECT p_partkey FROM part ORDER BY {_MIX.format("p_partkey, 7")}, p_partkey LIMIT 100""")
def sample_without_replacement(spark, sf_dir):
    return patch.sample_without_replacement(views.table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 100, 7)


_STARTS = "starts AS (SELECT img, CAST(k AS INT) AS k, " + ", ".join(f"CAST({_MIX.format(f'img, k, {a!r}, 0')} % 7 AS INT) AS {a}" for a in AXES) + """
  FROM (SELECT DISTINCT img FROM voxels), (SELECT unnest(range(8)) AS k))"""


@query("{views}, " + _STARTS + " SELECT * FROM starts")
def random_patch_starts(spark, sf_dir):
    return patch.patch_starts(views.voxels(spark, sf_dir).select("img").distinct(), 8, SIDE, 4)


@query("""WITH p AS (SELECT p_partkey AS patch_id FROM part) SELECT patch_id * 4 + z.r AS page, CAST(y.r AS INT) AS y, CAST((patch_id * 7 + z.r * 3 + y.r) % 256 AS BIGINT) AS v FROM p, (SELECT unnest(range(4)) AS r) z, (SELECT unnest(range(4)) AS r) y""")
def export_pages(spark, sf_dir):
    p = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("patch_id"))
    cells = p.withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return patch.export_pages(cells.withColumn("v", ((F.col("patch_id") * 7 + F.col("z") * 3 + F.col("y")) % 256).cast("bigint")), 4).select("page", "y", "v")


@query("{views}, " + _STARTS + """ SELECT s.img, s.k, count(*) AS n, CAST(sum(v.v) AS BIGINT) AS sum_v, CAST(sum((v.z - s.z) * 16 + (v.y - s.y) * 4 + (v.x - s.x)) AS BIGINT) AS places
FROM starts s JOIN voxels v ON v.img = s.img AND v.z BETWEEN s.z AND s.z + 3 AND v.y BETWEEN s.y AND s.y + 3 AND v.x BETWEEN s.x AND s.x + 3 GROUP BY ALL""")
def cut_patches(spark, sf_dir):
    df = views.voxels(spark, sf_dir)
    cells = patch.cut_patches(df, patch.patch_starts(df.select("img").distinct(), 8, SIDE, 4), 4)
    return cells.groupBy("img", "k").agg(F.count("*").alias("n"), F.sum("v").alias("sum_v"), F.sum(F.col("oz") * 16 + F.col("oy") * 4 + F.col("ox")).alias("places"))


@query("""{views}, i AS (SELECT CAST(unnest(range(11)) AS INT) AS p), l AS (SELECT img, a.p AS z, b.p AS y, c.p AS x FROM (SELECT DISTINCT img FROM voxels), i a, i b, i c)
SELECT l.img, l.z, l.y, l.x, coalesce(v, 0) AS v FROM l LEFT JOIN voxels o ON o.img = l.img AND o.z = l.z AND o.y = l.y AND o.x = l.x""")
def pad_by_overlap(spark, sf_dir):
    """Padded length for patches of four that overlap by two fifths: steps of 2.4."""
    return patch.pad(views.voxels(spark, sf_dir), SIDE, patch.Grid.overlapping(4, 0.4, SIDE), "constant").select("img", *AXES, "v")


@query("""{views}, i AS (SELECT CAST(unnest(range(10)) AS INT) AS p)
SELECT l.img, l.p AS z, l.y, l.x, coalesce(o.v, 0) AS v FROM (SELECT DISTINCT img, y, x, p FROM voxels, i) l LEFT JOIN voxels o ON o.img = l.img AND o.z = l.p - 2 AND o.y = l.y AND o.x = l.x""".replace("FROM voxels", "FROM boxes").replace("JOIN voxels", "JOIN boxes").replace("{views}, ", "WITH " + views.BOXES_SQL + ", "))
def pad_depth_to_square(spark, sf_dir):
    """Volumes of five planes, padded evenly to as many planes as rows."""
    return patch.pad(views.boxes(spark, sf_dir), 5, SIDE, "constant", (SIDE - 5) // 2, axes=("z",)).select("img", *AXES, "v")


@query("""{views}, i AS (SELECT unnest(range(14)) AS p), m AS (SELECT p, CASE WHEN (p + 16) % 18 < 10 THEN (p + 16) % 18 ELSE 18 - (p + 16) % 18 END AS s FROM i)
SELECT img, CAST(a.p AS INT) AS z, CAST(b.p AS INT) AS y, CAST(c.p AS INT) AS x, v FROM voxels JOIN m a ON z = a.s JOIN m b ON y = b.s JOIN m c ON x = c.s""")
def pad_for_views(spark, sf_dir):
    left, length = patch.view_padding(SIDE, 4, 2)
    return patch.pad(views.voxels(spark, sf_dir), SIDE, length, "reflect", left).select("img", *AXES, "v")


def _profile_sql() -> str:
    low, high = (repr(x) for x in patch.sigmoid_profile(2))
    axis = lambda a: f"CASE WHEN g{a} < 3 AND o{a} = 3 THEN {low} WHEN g{a} < 3 AND o{a} = 2 THEN {high} WHEN g{a} > 0 AND o{a} = 0 THEN {low} WHEN g{a} > 0 AND o{a} = 1 THEN {high} ELSE 1.0 END"
    cover = _COVER.replace("* 3", "* 2").replace("range(3)", "range(4)")
    return "{views}, " + cover + f""", w AS (SELECT *, CAST({axis("z")} AS DOUBLE) * CAST({axis("y")} AS DOUBLE) * CAST({axis("x")} AS DOUBLE) AS w FROM cover)
SELECT img, CAST(gz * 2 + oz AS INT) AS z, CAST(gy * 2 + oy AS INT) AS y, CAST(gx * 2 + ox AS INT) AS x, CAST(floor(sum(w * (v + gx)) / sum(w) * 1000 + 0.5) AS BIGINT) AS v FROM w GROUP BY ALL"""


@query(_profile_sql())
def stitch_sigmoid(spark, sf_dir):
    """Overlaps blended by a sigmoid; the patch's column is added so that overlapping patches differ."""
    grid = patch.Grid(4, 2)
    cells = patch.patchify(views.voxels(spark, sf_dir), grid, SIDE).withColumn("v", F.col("v") + F.col("gx"))
    return patch.stitch_profile(cells, grid, SIDE, patch.sigmoid_profile(2)).withColumn("v", fixed(F.col("v"), 3))


@query("""{views} SELECT vid, CAST(trunc((v - min(v) OVER w) / CAST(max(v) OVER w - min(v) OVER w + 1e-9 AS DOUBLE) * 255) AS INT) AS byte FROM voxels WINDOW w AS (PARTITION BY img)""")
def minmax_bytes(spark, sf_dir):
    return project.minmax_bytes(views.voxels(spark, sf_dir)).select("vid", "byte")


@query("""{views}, s AS (SELECT vid, v % 5 AS a, v % 7 AS b, v % 3 AS c FROM voxels)
SELECT vid, CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS class_id, CAST(floor(greatest(a, b, c) / nullif(CAST(a + b + c AS DOUBLE), 0) * 10000 + 0.5) AS BIGINT) AS probability FROM s""")
def class_probability(spark, sf_dir):
    df = views.voxels(spark, sf_dir).withColumns({"a": F.col("v") % 5, "b": F.col("v") % 7, "c": F.col("v") % 3})
    return project.class_of_scores(df, ["a", "b", "c"]).select("vid", "class_id", fixed(F.col("probability")).alias("probability"))


@query("""{views}, s AS (SELECT vid, CAST(k AS INT) AS step, CAST(z + k * (v % 5 - 2) AS INT) AS z, CAST(y + k * (v % 7 - 3) AS INT) AS y, x FROM voxels, (SELECT unnest(range(1, 4)) AS k))
SELECT * FROM s WHERE z BETWEEN 0 AND 9 AND y BETWEEN 0 AND 9 AND x BETWEEN 0 AND 9""")
def bounds_by_step(spark, sf_dir):
    """Points of a history kept at the steps where they are inside."""
    df = views.voxels(spark, sf_dir).withColumn("step", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
    moved = df.select("vid", "step", (F.col("z") + F.col("step") * (F.col("v") % 5 - 2)).cast("int").alias("z"), (F.col("y") + F.col("step") * (F.col("v") % 7 - 3)).cast("int").alias("y"), "x")
    return project.in_bounds(moved, (SIDE, SIDE, SIDE))


# ---- objects ---------------------------------------------------------------------------

_PROPS = """props AS (SELECT img, label, count(*) AS area, CAST(sum(v) AS BIGINT) AS sum_v, CAST(sum(z) AS BIGINT) AS sum_z, CAST(sum(y) AS BIGINT) AS sum_y, CAST(sum(x) AS BIGINT) AS sum_x,
  min(z) AS min_z, max(z) AS max_z, min(y) AS min_y, max(y) AS max_y, min(x) AS min_x, max(x) AS max_x FROM vl WHERE label > 0 GROUP BY img, label)"""


@query("{views}, " + _PROPS + " SELECT * FROM props")
def region_props(spark, sf_dir):
    return regions.properties(views.labelled(spark, sf_dir))


@query("""{views}, s AS (SELECT img, label, count(*) AS n FROM vl WHERE label > 0 GROUP BY img, label)
SELECT img, CAST(floor(avg(cbrt(3 * n / (4 * pi()))) * 10000 + 0.5) AS BIGINT) AS radius FROM s GROUP BY img""")
def mean_radius(spark, sf_dir):
    return regions.mean_radius(views.labelled(spark, sf_dir)).select("img", fixed(F.col("radius")).alias("radius"))


_CODES = """codes AS (SELECT img, label, CAST(round_even((max_z - min_z) / 2 + min_z, 0) AS INT) AS cz, CAST(round_even((max_y - min_y) / 2 + min_y, 0) AS INT) AS cy, CAST(round_even((max_x - min_x) / 2 + min_x, 0) AS INT) AS cx,
  area, min_z, max_z, min_y, max_y, min_x, max_x FROM props WHERE area >= 20)"""


@query("{views}, " + _PROPS + ", " + _CODES + " SELECT * FROM codes")
def object_code(spark, sf_dir):
    return regions.object_codes(views.labelled(spark, sf_dir))


@query("{views}, " + _PROPS + """, c AS (SELECT img, label, area, CAST(greatest(0, least(9, round_even(sum_z / area, 0))) AS INT) AS z, CAST(greatest(0, least(9, round_even(sum_y / area, 0))) AS INT) AS y, CAST(greatest(0, least(9, round_even(sum_x / area, 0))) AS INT) AS x FROM props)
SELECT c.img, c.label, c.area, c.z, c.y, c.x, coalesce(region, 0) AS region FROM c LEFT JOIN vl ON vl.img = c.img AND vl.z = c.z AND vl.y = c.y AND vl.x = c.x""")
def region_lookup(spark, sf_dir):
    df = views.labelled(spark, sf_dir)
    return regions.region_of_centroid(regions.properties(df), df, SIDE).select("img", "label", "area", *AXES, "region")


@query("{views}, " + _PROPS + ", " + _CODES + """
SELECT vid, coalesce(cz - z, 0) AS dz, coalesce(cy - y, 0) AS dy, coalesce(cx - x, 0) AS dx FROM vl LEFT JOIN codes USING (img, label)""")
def target_vectors(spark, sf_dir):
    return regions.target_vectors(views.labelled(spark, sf_dir)).select("vid", "dz", "dy", "dx")


@query("{views}, " + _PROPS + ", " + _CODES + """, d AS (SELECT vid, coalesce(cz - z, 0) AS dz, coalesce(cy - y, 0) AS dy, coalesce(cx - x, 0) AS dx FROM vl LEFT JOIN codes USING (img, label)),
n AS (SELECT *, sqrt(CAST(dz * dz + dy * dy + dx * dx AS DOUBLE)) AS n FROM d)
SELECT vid, CAST(floor(CASE WHEN n > 0 THEN dz / n ELSE 0 END * 10000 + 0.5) AS BIGINT) AS uz, CAST(floor(CASE WHEN n > 0 THEN dy / n ELSE 0 END * 10000 + 0.5) AS BIGINT) AS uy, CAST(floor(CASE WHEN n > 0 THEN dx / n ELSE 0 END * 10000 + 0.5) AS BIGINT) AS ux FROM n""")
def unit_vectors(spark, sf_dir):
    df = project.unit_vectors(regions.target_vectors(views.labelled(spark, sf_dir)))
    return df.select("vid", *[fixed(F.col(f"ud{a}")).alias(f"u{a}") for a in AXES])


@query("""{views} SELECT img, CAST(floor(z / 4) AS INT) AS z, CAST(floor(y / 4) AS INT) AS y, CAST(floor(x / 4) AS INT) AS x, CAST(sum(v) AS BIGINT) AS sum_v, count(*) AS n FROM voxels GROUP BY ALL""")
def block_mean(spark, sf_dir):
    return regions.block_means(views.voxels(spark, sf_dir), 4)


@query("""{views} SELECT DISTINCT img, label FROM vl WHERE label > 0""")
def distinct_labels(spark, sf_dir):
    return regions.properties(views.labelled(spark, sf_dir)).select("img", "label")


@query("{views}, " + _PROPS + ", " + _CODES + """, h AS (SELECT *, greatest(cz - min_z, max_z - cz) AS hz, greatest(cy - min_y, max_y - cy) AS hy, greatest(cx - min_x, max_x - cx) AS hx FROM codes)
SELECT vid, CAST(floor(coalesce((cz - z) / (hz + 1e-10), 0) * 10000 + 0.5) AS BIGINT) AS dz, CAST(floor(coalesce((cy - y) / (hy + 1e-10), 0) * 10000 + 0.5) AS BIGINT) AS dy, CAST(floor(coalesce((cx - x) / (hx + 1e-10), 0) * 10000 + 0.5) AS BIGINT) AS dx
FROM vl LEFT JOIN h USING (img, label)""")
def normalised_vectors(spark, sf_dir):
    df = regions.normalised_targets(views.labelled(spark, sf_dir))
    return df.select("vid", *[fixed(F.col(f"d{a}")).alias(f"d{a}") for a in AXES])


@query("""{views}, s AS (SELECT img, label, count(*) AS n FROM vl WHERE label > 0 GROUP BY img, label), r AS (SELECT img, CAST(trunc(10 * 3.5 / avg(cbrt(3 * n / (4 * pi())))) AS INT) AS m FROM s GROUP BY img),
i AS (SELECT CAST(unnest(range(60)) AS INT) AS p), t AS (SELECT img, p, CAST(floor((2 * p + 1) * 10 / (2 * m)) AS INT) AS s FROM r, i WHERE p < m)
SELECT vl.img, a.p AS z, b.p AS y, c.p AS x, label FROM vl JOIN t a ON a.img = vl.img AND a.s = vl.z JOIN t b ON b.img = vl.img AND b.s = vl.y JOIN t c ON c.img = vl.img AND c.s = vl.x""")
def rescale_by_radius(spark, sf_dir):
    """Every volume at the size where its objects' mean radius is 3.5."""
    return field.rescale_by_radius(views.labelled(spark, sf_dir), SIDE, 3.5).select("img", *AXES, "label")


# ---- neighbourhoods --------------------------------------------------------------------


def _components_sql(offsets: str, cut: int) -> str:
    return "{views}, f AS (SELECT vid, img, z, y, x FROM voxels WHERE v > " + str(cut) + """),
e AS (SELECT a.vid AS a, b.vid AS b FROM f a JOIN f b ON a.img = b.img AND a.vid <> b.vid AND """ + offsets + """),
r AS (SELECT vid AS s, vid AS t FROM f UNION SELECT r.s, e.b FROM r JOIN e ON r.t = e.a)
SELECT img, vid, m AS component FROM f JOIN (SELECT s, min(t) AS m FROM r GROUP BY s) ON s = vid"""


@query(_components_sql("abs(a.z - b.z) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1", 14700))
def connected_components_26(spark, sf_dir):
    return neighbors.connected_components(views.voxels(spark, sf_dir).filter("v > 14700"), 26)


@query(_components_sql("abs(a.z - b.z) + abs(a.y - b.y) + abs(a.x - b.x) <= 1", 10000))
def connected_components_6(spark, sf_dir):
    return neighbors.connected_components(views.voxels(spark, sf_dir).filter("v > 10000"), 6)


@query(_components_sql("abs(a.z - b.z) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1", 14700))
def connected_components_joined(spark, sf_dir):
    """The components by joins alone, for volumes that fit no worker."""
    return neighbors.connected_components_relational(views.voxels(spark, sf_dir).filter("v > 14700"), 26)


@query(_components_sql("abs(a.z - b.z) + abs(a.y - b.y) + abs(a.x - b.x) <= 1", 10000).replace("SELECT img, vid, m AS component FROM", "SELECT img, vid, dense_rank() OVER (PARTITION BY img ORDER BY m) AS component_id FROM"))
def dense_component_labels(spark, sf_dir):
    found = neighbors.dense_labels(neighbors.connected_components(views.voxels(spark, sf_dir).filter("v > 10000"), 6))
    return found.select("img", "vid", F.col("component_id").cast("bigint").alias("component_id"))


@query("""{views}, f AS (SELECT * FROM voxels WHERE v > 12000)
SELECT a.img, least(a.vid, b.vid) AS a, greatest(a.vid, b.vid) AS b FROM f a JOIN f b ON a.img = b.img AND a.vid < b.vid AND abs(a.z - b.z) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1""")
def adjacent_voxels(spark, sf_dir):
    pairs = neighbors.adjacency(views.voxels(spark, sf_dir).filter("v > 12000"))
    return pairs.select("img", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


_ENDS = """ends AS (SELECT img, vid AS pid, CAST(trunc(z + (v % 700 - 350) / 100.0) AS INT) AS z, CAST(trunc(y + (v % 500 - 250) / 100.0) AS INT) AS y, CAST(trunc(x + (v % 300 - 150) / 100.0) AS INT) AS x FROM voxels),
dens AS (SELECT img, z, y, x, count(*) AS n FROM ends WHERE z BETWEEN 0 AND 9 AND y BETWEEN 0 AND 9 AND x BETWEEN 0 AND 9 GROUP BY ALL)"""


def _ends(spark, sf_dir):
    moved = views.voxels(spark, sf_dir).select("img", F.col("vid").alias("pid"), *[project.truncated(F.col(a) + (F.col("v") % m - m // 2) / F.lit(100.0)).alias(a) for a, m in (("z", 700), ("y", 500), ("x", 300))])
    return project.in_bounds(moved, (SIDE, SIDE, SIDE))


@query("{views}, " + _ENDS + " SELECT * FROM dens")
def endpoint_density(spark, sf_dir):
    return field.endpoint_density(_ends(spark, sf_dir))


def _smooth_sql() -> str:
    w = neighbors.gaussian_weights(1.0)
    taps = ", ".join(f"({i - 4}, CAST({x!r} AS DOUBLE))" for i, x in enumerate(w))
    parts, last = [], "src"
    for axis in AXES:
        cols = ", ".join("t.p AS " + a if a == axis else "s." + a for a in AXES)
        parts.append(f"""p{axis} AS (SELECT s.img, {cols}, trunc(sum(w * s.v) + 1e-6) AS v FROM {last} s, i t, tap
  WHERE s.{axis} = CASE WHEN (t.p + d + 20) % 20 < 10 THEN (t.p + d + 20) % 20 ELSE 19 - (t.p + d + 20) % 20 END GROUP BY ALL)""")
        last = f"p{axis}"
    return "{views}, " + _ENDS + f""", i AS (SELECT CAST(unnest(range(10)) AS INT) AS p), tap AS (SELECT * FROM (VALUES {taps}) q(d, w)),
src AS (SELECT img, z, y, x, CAST(n * 1000 AS DOUBLE) AS v FROM dens), """ + ", ".join(parts) + " SELECT img, z, y, x, CAST(v AS BIGINT) AS v FROM px WHERE v > 0"


@query(_smooth_sql())
def gaussian_density(spark, sf_dir):
    df = field.endpoint_density(_ends(spark, sf_dir)).withColumn("v", F.col("n") * 1000)
    return neighbors.smooth(df, SIDE, neighbors.gaussian_weights(1.0)).filter("v > 0").withColumn("v", F.col("v").cast("bigint"))


def _blur_sql() -> str:
    sql = _smooth_sql().replace("trunc(sum(w * s.v) + 1e-6)", "sum(w * s.v)").replace(repr(neighbors.gaussian_weights(1.0)[0]), repr(neighbors.gaussian_weights(1.0)[0]))
    return sql.replace("CAST(v AS BIGINT) AS v FROM px WHERE v > 0", "CAST(floor(v * 100 + 0.5) AS BIGINT) AS v FROM px")


@query(_blur_sql())
def gaussian_blur(spark, sf_dir):
    df = field.endpoint_density(_ends(spark, sf_dir)).withColumn("v", F.col("n") * 1000)
    return augment.blur(df, SIDE, 1.0).withColumn("v", fixed(F.col("v"), 2))


@query("""{views}, s AS (SELECT img, z, y, x, vid AS label FROM voxels WHERE v > 17500),
j AS (SELECT p.img, p.vid AS pid, s.label, (p.z - s.z) * (p.z - s.z) + (p.y - s.y) * (p.y - s.y) + (p.x - s.x) * (p.x - s.x) AS d2 FROM voxels p JOIN s ON p.img = s.img),
k AS (SELECT *, row_number() OVER (PARTITION BY img, pid ORDER BY d2, label) AS r FROM j WHERE d2 < 25)
SELECT p.img, p.vid AS pid, coalesce(label, 0) AS label, d2 FROM voxels p LEFT JOIN (SELECT * FROM k WHERE r = 1) k ON k.img = p.img AND k.pid = p.vid""")
def nearest_seed(spark, sf_dir):
    df = views.voxels(spark, sf_dir)
    seeds = df.filter("v > 17500").select("img", *AXES, F.col("vid").alias("label"))
    return field.nearest_seed(df.select("img", F.col("vid").alias("pid"), *AXES), seeds, 5)


@query("""{views}, p AS (SELECT img, vid AS pid, z * 4 + v % 4 AS pz, y * 4 + v % 3 AS py, x * 4 + v % 2 AS px FROM voxels),
c AS (SELECT unnest([0, 1]) AS b),
q AS (SELECT img, pid, CAST(floor(pz / 4) AS INT) + a.b AS z, CAST(floor(py / 4) AS INT) + b.b AS y, CAST(floor(px / 4) AS INT) + c.b AS x,
  CASE WHEN a.b = 1 THEN pz % 4 ELSE 4 - pz % 4 END * CASE WHEN b.b = 1 THEN py % 4 ELSE 4 - py % 4 END * CASE WHEN c.b = 1 THEN px % 4 ELSE 4 - px % 4 END AS w FROM p, c a, c b, c c)
SELECT q.img, pid, CAST(coalesce(sum(w * v), 0) AS BIGINT) AS v_sum FROM q LEFT JOIN voxels o ON o.img = q.img AND o.z = q.z AND o.y = q.y AND o.x = q.x GROUP BY ALL""")
def trilinear_gather(spark, sf_dir):
    df = views.voxels(spark, sf_dir)
    points = df.select("img", F.col("vid").alias("pid"), (F.col("z") * 4 + F.col("v") % 4).alias("pz"), (F.col("y") * 4 + F.col("v") % 3).alias("py"), (F.col("x") * 4 + F.col("v") % 2).alias("px"))
    return field.trilinear(points, df, 4)


def _momentum_sql() -> str:
    parts, last = [], "m0"
    for k in range(1, 4):
        d = {a: f"CAST(trunc((coalesce(f{a}, 0) + 4 * m.d{a}) / 5.0) AS INT)" for a in AXES}
        parts.append(f"m{k} AS (SELECT m.img, pid, " + ", ".join(f"m.{a} + {d[a]} AS {a}, {d[a]} AS d{a}" for a in AXES) + f" FROM {last} m LEFT JOIN fld f ON f.img = m.img AND f.z = m.z AND f.y = m.y AND f.x = m.x)")
        last = f"m{k}"
    return """{views}, fld AS (SELECT img, z, y, x, CAST(v % 21 - 10 AS INT) AS fz, CAST(v % 17 - 8 AS INT) AS fy, CAST(v % 13 - 6 AS INT) AS fx FROM voxels),
m0 AS (SELECT img, vid AS pid, z, y, x, 0 AS dz, 0 AS dy, 0 AS dx FROM voxels), """ + ", ".join(parts) + " SELECT img, pid, z, y, x FROM m3"


@query(_momentum_sql())
def momentum_step(spark, sf_dir):
    df = views.voxels(spark, sf_dir)
    vectors = df.select("img", *AXES, *[(F.col("v") % m - m // 2).cast("int").alias(f"f{a}") for a, m in zip(AXES, (21, 17, 13), strict=True)])
    points = df.select("img", F.col("vid").alias("pid"), *AXES, *[F.lit(0).alias(f"d{a}") for a in AXES])
    return field.momentum_steps(points, vectors, 3).select("img", "pid", *AXES)


@query("""{views} SELECT img, z, y, x, count(*) AS n FROM (SELECT img, CAST(greatest(0, least(4, trunc((z + v % 9 - 4) / 2.0))) AS INT) AS z, CAST(greatest(0, least(4, trunc((y + v % 7 - 3) / 2.0))) AS INT) AS y, CAST(greatest(0, least(4, trunc((x + v % 5 - 2) / 2.0))) AS INT) AS x FROM voxels) GROUP BY ALL""")
def vote_image(spark, sf_dir):
    df = views.voxels(spark, sf_dir).withColumns({f"d{a}": F.col("v") % m - m // 2 for a, m in zip(AXES, (9, 7, 5), strict=True)})
    return field.votes(df, ("dz", "dy", "dx"), 2, SIDE)


@query("""{views}, o AS (SELECT unnest([-1, 0, 1]) AS d), big AS (SELECT img, z, y, x, CASE WHEN v > 200 THEN label + 1 ELSE 0 END AS label FROM (SELECT *, 4 * CAST(floor(z / 5) AS INT) + 2 * CAST(floor(y / 5) AS INT) + CAST(floor(x / 5) AS INT) AS label FROM voxels) ),
core AS (SELECT a.img, a.z, a.y, a.x FROM big a JOIN o p ON true JOIN o q ON true JOIN o r ON true JOIN big b ON b.img = a.img AND b.z = a.z + p.d AND b.y = a.y + q.d AND b.x = a.x + r.d AND b.label = a.label WHERE a.label > 0 GROUP BY ALL HAVING count(*) = 27),
wide AS (SELECT DISTINCT img, z + p.d AS z, y + q.d AS y, x + r.d AS x FROM core, o p, o q, o r)
SELECT w.img, w.z, w.y, w.x, CASE WHEN c.img IS NULL THEN 127 ELSE 255 END AS mark FROM wide w LEFT JOIN core c USING (img, z, y, x) WHERE w.z BETWEEN 0 AND 9 AND w.y BETWEEN 0 AND 9 AND w.x BETWEEN 0 AND 9""".replace("SELECT *, 4 *", "SELECT img, z, y, x, v, 4 *"))
def border_labels(spark, sf_dir):
    name = 4 * F.floor(F.col("z") / 5) + 2 * F.floor(F.col("y") / 5) + F.floor(F.col("x") / 5)
    df = views.voxels(spark, sf_dir).withColumn("label", F.when(F.col("v") > 200, name.cast("int") + 1).otherwise(0))
    return neighbors.border_labels(df, SIDE)


@query("""{views}, o AS (SELECT unnest([-1, 0, 1]) AS d)
SELECT a.img, a.z, a.y, a.x, CAST(sum(p.d * (2 - abs(q.d)) * (2 - abs(r.d)) * b.v) AS BIGINT) AS gz, CAST(sum(q.d * (2 - abs(p.d)) * (2 - abs(r.d)) * b.v) AS BIGINT) AS gy, CAST(sum(r.d * (2 - abs(p.d)) * (2 - abs(q.d)) * b.v) AS BIGINT) AS gx
FROM voxels a JOIN o p ON true JOIN o q ON true JOIN o r ON true JOIN voxels b ON b.img = a.img AND b.z = a.z + p.d AND b.y = a.y + q.d AND b.x = a.x + r.d
WHERE a.z BETWEEN 1 AND 8 AND a.y BETWEEN 1 AND 8 AND a.x BETWEEN 1 AND 8 GROUP BY ALL""")
def sobel_magnitude(spark, sf_dir):
    return neighbors.sobel(views.voxels(spark, sf_dir))


@query("""{views}, o AS (SELECT unnest([-1, 0, 1]) AS d)
SELECT vid, v FROM (SELECT a.vid, a.v, max(b.v) AS m FROM voxels a JOIN o p ON true JOIN o q ON true JOIN o r ON true JOIN voxels b ON b.img = a.img AND b.z = a.z + p.d AND b.y = a.y + q.d AND b.x = a.x + r.d WHERE a.v > 9000 GROUP BY ALL) WHERE v = m""")
def local_maxima(spark, sf_dir):
    return neighbors.local_maxima(views.voxels(spark, sf_dir), 1, 9000).select("vid", "v")


@query("""{views}, h AS (SELECT img, CAST(floor(v / 500) AS BIGINT) AS level, count(*) AS c FROM voxels GROUP BY ALL),
w AS (SELECT img, level, sum(c) OVER u AS w0, sum(c * level) OVER u AS s0, sum(c) OVER t AS n, sum(c * level) OVER t AS s FROM h WINDOW t AS (PARTITION BY img), u AS (PARTITION BY img ORDER BY level ROWS UNBOUNDED PRECEDING)),
g AS (SELECT img, level, CAST(s * w0 - n * s0 AS DOUBLE) * CAST(s * w0 - n * s0 AS DOUBLE) / CAST(w0 * (n - w0) AS DOUBLE) AS g FROM w WHERE w0 < n)
SELECT img, level AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY g DESC, level) AS r FROM g) WHERE r = 1""")
def otsu_threshold(spark, sf_dir):
    df = views.voxels(spark, sf_dir).withColumn("v", F.floor(F.col("v") / 500).cast("bigint"))
    return neighbors.otsu(df)


# ---- scores ----------------------------------------------------------------------------

_SCORES = """lf AS (SELECT condition, volume, log2(volume) AS lv, log2(dapi_sum) AS ld FROM features WHERE volume > 0 AND dapi_sum > 0),
ln AS (SELECT regr_intercept(ld, lv) AS alpha, regr_slope(ld, lv) AS beta FROM lf WHERE condition = 'Control'),
rs AS (SELECT condition, volume, ld - (alpha + beta * lv) AS residual FROM lf, ln),
sg AS (SELECT stddev_samp(residual) AS sigma FROM rs WHERE condition = 'Control'),
sc AS (SELECT condition, volume, residual, abs(residual) / sigma AS nds, residual / sigma AS snds FROM rs, sg)"""


def _scored(spark, sf_dir):
    return score.scores(score.log_features(views.features(spark, sf_dir)))


@query("{views}, " + _SCORES + """ SELECT condition, volume, count(*) AS n, CAST(floor(sum(nds) * 100 + 0.5) AS BIGINT) AS nds, CAST(floor(sum(snds) * 100 + 0.5) AS BIGINT) AS snds FROM sc GROUP BY condition, volume""")
def nds_features(spark, sf_dir):
    """Scores summed by condition and size."""
    return _scored(spark, sf_dir).groupBy("condition", "volume").agg(F.count("*").alias("n"), fixed(F.sum("nds"), 2).alias("nds"), fixed(F.sum("snds"), 2).alias("snds"))


@query("{views}, " + _SCORES + """ SELECT condition, count(*) AS n, CAST(floor(avg(residual) * 10000 + 0.5) AS BIGINT) AS mean_residual, CAST(floor(stddev_samp(residual) * 10000 + 0.5) AS BIGINT) AS std_residual,
CAST(floor(avg(snds) * 10000 + 0.5) AS BIGINT) AS mean_snds, CAST(floor(avg(CASE WHEN nds > 2 THEN 1 ELSE 0 END) * 10000 + 0.5) AS BIGINT) AS above_2, CAST(floor(avg(CASE WHEN nds > 3 THEN 1 ELSE 0 END) * 10000 + 0.5) AS BIGINT) AS above_3 FROM sc GROUP BY condition""")
def nds_qc_by_condition(spark, sf_dir):
    out = score.quality_table(_scored(spark, sf_dir))
    return out.select("condition", "n", *[fixed(F.col(c)).alias(c) for c in ("mean_residual", "std_residual", "mean_snds", "above_2", "above_3")])


@query("{views}, " + _SCORES + """ SELECT condition, CASE WHEN nds < 1 THEN 'Normal' WHEN nds < 2 THEN 'Mild' WHEN nds < 3 THEN 'Abnormal' ELSE 'Strongly abnormal' END AS class, count(*) AS n FROM sc GROUP BY ALL""")
def nds_classes(spark, sf_dir):
    return _scored(spark, sf_dir).groupBy("condition", score.score_class(F.col("nds")).alias("class")).agg(F.count("*").alias("n"))


@query("""{views}, c AS (SELECT condition, volume, count(*) AS n FROM features GROUP BY ALL)
SELECT condition, volume, n, CAST(sum(n) OVER u AS BIGINT) AS below, sum(n) OVER u / sum(n) OVER (PARTITION BY condition) AS ecdf FROM c WINDOW u AS (PARTITION BY condition ORDER BY volume)""")
def ecdf_by_condition(spark, sf_dir):
    return score.ecdf(views.features(spark, sf_dir), "volume")


@query("""{views} SELECT condition, CAST(floor(quantile_cont(dapi_sum, 0.25) * 100 + 0.375) AS BIGINT) AS q1, CAST(floor(quantile_cont(dapi_sum, 0.5) * 100 + 0.375) AS BIGINT) AS median, CAST(floor(quantile_cont(dapi_sum, 0.75) * 100 + 0.375) AS BIGINT) AS q3 FROM features GROUP BY condition""")
def box_summary(spark, sf_dir):
    # quartiles of cents fall on quarters of a cent; 0.375 keeps them off the edge of rounding
    out = score.box_summary(views.features(spark, sf_dir), "dapi_sum")
    return out.select("condition", *[F.floor(F.col(c) * 100 + 0.375).cast("bigint").alias(c) for c in ("q1", "median", "q3")])


@query()
def huber_fit(spark, sf_dir):
    """Robust line through the controls (rows-only: an iterative fit)."""
    alpha, beta, scale = score.fit_controls_huber(score.log_features(views.features(spark, sf_dir)))
    return spark.range(1).select(F.lit(float(alpha)).alias("alpha"), F.lit(float(beta)).alias("beta"), F.lit(float(scale)).alias("scale"))


# ---- metrics ---------------------------------------------------------------------------

_TP = "tp AS (SELECT img, CASE WHEN v > 9000 THEN 1.0 ELSE 0.0 END AS t, CAST(v % 101 AS DOUBLE) / 100 AS p FROM voxels)"


def _truth(spark, sf_dir):
    return views.voxels(spark, sf_dir).select("img", F.when(F.col("v") > 9000, 1.0).otherwise(0.0).alias("t"), ((F.col("v") % 101).cast("double") / 100).alias("p"))


def _metric(name: str, column, sql: str) -> None:
    def run(spark, sf_dir):
        return _truth(spark, sf_dir).groupBy("img").agg(fixed(column(F.col("t"), F.col("p")), 5).alias(name))

    run.__name__ = name
    query("{views}, " + _TP + ", q AS (SELECT img, CAST(t AS DOUBLE) AS t, p, greatest(1e-7, least(1 - 1e-7, p)) AS c FROM tp) SELECT img, CAST(floor((" + sql + f") * 100000 + 0.5) AS BIGINT) AS {name} FROM q GROUP BY img")(run)


_BCE = "avg(-(t * ln(c) + (1 - t) * ln(1 - c)))"
_DICE = "(2 * sum(t * p) + 1) / (sum(t) + sum(p) + 1)"
_TVERSKY = "1 - (sum(t * p) + 1) / (sum(t * p) + 0.3 * sum((1 - t) * p) + 0.7 * sum(t * (1 - p)) + 1)"
_FOCAL = f"0.8 * pow(1 - exp(-({_BCE})), 2) * ({_BCE})"
_metric("dice_coef", metrics.dice, _DICE)
_metric("tversky_loss", metrics.tversky_loss, _TVERSKY)
_metric("focal_loss", metrics.focal_loss, _FOCAL)
_metric("focal_tversky_loss", metrics.focal_tversky_loss, f"10 * ({_FOCAL}) + {_TVERSKY}")
_metric("mse_x10", metrics.squared_error_x10, "10 * avg((t - p) * (t - p))")
_metric("bce_loss", metrics.cross_entropy, _BCE)
_metric("dice_bce_loss", metrics.dice_bce_loss, f"1 - {_DICE} + 10 * {_BCE}")


@query("{views}, q AS (SELECT img, v % 3 AS t, 1.0 + v % 5 AS a, 1.0 + v % 7 AS b, 1.0 + v % 11 AS c FROM voxels)" + f"""
SELECT img, CAST(floor({sum(metrics.CLASS_WEIGHTS)!r} * avg(-ln(greatest(1e-7, least(1 - 1e-7, CAST(CASE t WHEN 0 THEN a WHEN 1 THEN b ELSE c END AS DOUBLE) / CAST(a + b + c AS DOUBLE))))) * 100000 + 0.5) AS BIGINT) AS weighted_cce FROM q GROUP BY img""")
def weighted_cce(spark, sf_dir):
    v = F.col("v")
    classes = [(F.when(v % 3 == k, 1.0).otherwise(0.0), 1.0 + v % m) for k, m in enumerate((5, 7, 11))]
    return views.voxels(spark, sf_dir).groupBy("img").agg(fixed(metrics.weighted_cross_entropy(classes), 5).alias("weighted_cce"))


# ---- files -----------------------------------------------------------------------------


@query("""WITH i AS (SELECT source, doc_id AS image, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents WHERE doc_id % 3 <> 0),
m AS (SELECT source, doc_id AS mask, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents WHERE doc_id % 3 = 0) SELECT source, rn, image, mask FROM i JOIN m USING (source, rn)""")
def positional_pair(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("name"))
    return prep.pair_by_position(docs.filter("name % 3 <> 0"), docs.filter("name % 3 = 0"), ("source",)).withColumn("rn", F.col("rn").cast("bigint"))


_STEMS = "s AS (SELECT DISTINCT split_part(regexp_extract(url, '[^/]+$'), '?', 1) AS stem FROM pages WHERE NOT contains(url, 'th')), g AS (SELECT page_id AS file_id, url AS path FROM pages WHERE contains(url, 'th'))"


def _stems(spark, sf_dir):
    """(truth files, stems of the other files), as a held-out truth is found."""
    files = prep.classify(views.files(spark, sf_dir), "en", "th")
    name = F.element_at(F.split(prep.name_of(F.col("path")), r"\?"), 1)
    return files.filter("is_truth").select("file_id", "path"), files.filter("NOT is_truth").select(name.alias("stem")).distinct()


@query("WITH " + _STEMS + " SELECT * FROM g WHERE EXISTS (SELECT 1 FROM s WHERE stem <> '' AND contains(path, stem))")
def stem_semi_join(spark, sf_dir):
    return prep.stem_join(*_stems(spark, sf_dir))


@query("WITH " + _STEMS + " SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM s WHERE stem <> '' AND contains(path, stem))")
def stem_anti_join(spark, sf_dir):
    return prep.stem_join(*_stems(spark, sf_dir), anti=True)


@query("""SELECT page_id AS file_id, list_contains(string_split(url, '/'), 'en') AS is_synthetic, contains(url, 'th') AS is_truth, split_part(list_extract(string_split(url, '/'), -1), '.', 1) AS stem,
list_extract(string_split(url, '/'), -2) AS parent, CASE WHEN len(string_split(url, '/')) >= 4 THEN array_to_string(string_split(url, '/')[len(string_split(url, '/')) - 3:len(string_split(url, '/')) - 2], '_') || '_' || list_extract(string_split(url, '/'), -1) ELSE list_extract(string_split(url, '/'), -1) END AS new_name FROM pages""")
def path_classify(spark, sf_dir):
    df = prep.classify(views.files(spark, sf_dir), "en", "th")
    return df.select("file_id", "is_synthetic", "is_truth", prep.stem_of(F.col("path")).alias("stem"), prep.parent_of(F.col("path")).alias("parent"), prep.synthetic_name(F.col("path")).alias("new_name"))


@query("""WITH a AS (SELECT DISTINCT doc_id AS name FROM documents), b AS (SELECT DISTINCT doc_id * 2 AS name FROM labels)
SELECT name, 'a' AS side FROM a WHERE name NOT IN (SELECT name FROM b) UNION ALL SELECT name, 'b' FROM b WHERE name NOT IN (SELECT name FROM a)""")
def name_set_diff(spark, sf_dir):
    a = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"))
    b = views.table(spark, sf_dir, "labels").select((F.col("doc_id") * 2).alias("name"))
    return prep.name_differences(a, b)


@query("""SELECT p_partkey AS item, 'part' AS dataset FROM part UNION ALL SELECT s_suppkey, 'supplier' FROM supplier UNION ALL SELECT c_custkey, 'customer' FROM customer""")
def union_datasets(spark, sf_dir):
    names = {"part": "p_partkey", "supplier": "s_suppkey", "customer": "c_custkey"}
    return prep.grouped({t: views.table(spark, sf_dir, t).select(F.col(c).alias("item")) for t, c in names.items()})


_HISTORY = "h AS (SELECT event_type AS metric, CAST(floor(event_id / 100) AS BIGINT) AS epoch, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS value FROM events GROUP BY ALL)"


@query("WITH " + _HISTORY + ", b AS (SELECT *, min(value) OVER (PARTITION BY metric ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS best FROM h), f AS (SELECT *, lag(best) OVER (PARTITION BY metric ORDER BY epoch) AS prev FROM b)" + """
SELECT metric, epoch, value, best, CAST(epoch - max(CASE WHEN prev IS NULL OR best < prev THEN epoch END) OVER (PARTITION BY metric ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS BIGINT) AS waited FROM f""")
def history_callbacks(spark, sf_dir):
    """Best value so far and epochs waited, as checkpoints and early stops see a training history."""
    h = views.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("metric"), F.floor(F.col("event_id") / 100).cast("bigint").alias("epoch")).agg(F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("value"))
    return prep.epochs_since_best(h).select("metric", "epoch", "value", "best", "waited")


# ---- resampling and augmentation -------------------------------------------------------


@query("""{views}, i AS (SELECT unnest(range(15)) AS p), m AS (SELECT CAST(p AS INT) AS p, CAST(floor((2 * p + 1) * 10 / 30) AS INT) AS s FROM i)
SELECT img, a.p AS z, b.p AS y, c.p AS x, label FROM vl JOIN m a ON z = a.s JOIN m b ON y = b.s JOIN m c ON x = c.s""")
def rescale_nearest(spark, sf_dir):
    return field.resample_nearest(views.labelled(spark, sf_dir), SIDE, 15).select("img", *AXES, "label")


@query("""{views}, t AS (SELECT * FROM (VALUES (0, 0, 2), (0, 1, 2), (1, 2, 2), (1, 3, 2), (2, 4, 2), (2, 5, 2), (3, 6, 2), (3, 7, 2), (4, 8, 2), (4, 9, 2)) q(p, s, w))
SELECT img, a.p AS z, b.p AS y, c.p AS x, CAST(sum(a.w * b.w * c.w * v) AS BIGINT) AS v FROM voxels JOIN t a ON z = a.s JOIN t b ON y = b.s JOIN t c ON x = c.s GROUP BY ALL""")
def rescale_linear(spark, sf_dir):
    """Half size by linear interpolation: each sample is the mean of eight, given in sixty-fourths."""
    return field.resample_linear(views.voxels(spark, sf_dir), 1, 2, SIDE).withColumn("v", F.round(F.col("v") * 64).cast("bigint"))


@query("{views} SELECT vid, z, 9 - y AS y, x, v FROM voxels")
def flip_axis(spark, sf_dir):
    return augment.flip(views.voxels(spark, sf_dir), "y", SIDE).select("vid", *AXES, "v")


@query("{views} SELECT vid, z, x AS y, y AS x, v FROM voxels")
def transpose_yx(spark, sf_dir):
    return augment.transpose_yx(views.voxels(spark, sf_dir)).select("vid", *AXES, "v")


@query("{views} SELECT vid, z, x AS y, 9 - y AS x, v FROM voxels")
def rotate_quarter(spark, sf_dir):
    return augment.rotate90(views.voxels(spark, sf_dir), "z", 1, SIDE).select("vid", *AXES, "v")


@query("""{views} SELECT vid, CAST(floor(greatest(0.0, least(1.0, sign(q) * 1.1 * pow(abs(q), 0.9))) * 10000 + 0.5) AS BIGINT) AS bright FROM (SELECT vid, CAST(v % 121 AS DOUBLE) / 100 - 0.1 AS q FROM voxels)""")
def brightness_gamma(spark, sf_dir):
    q = (F.col("v") % 121).cast("double") / 100 - 0.1
    return views.voxels(spark, sf_dir).select("vid", fixed(augment.brightness(q, 1.1, 0.9)).alias("bright"))


@query("""{views} SELECT a.vid, b.v FROM voxels a JOIN voxels b ON a.img = b.img AND b.z = a.z AND b.y = a.y - a.y % 2 AND b.x = a.x - a.x % 2""")
def downsample_nearest(spark, sf_dir):
    return augment.downsample(views.voxels(spark, sf_dir), (1, 2, 2)).select("vid", "v")


@query("{views} SELECT img, z, y, x, CAST(27 * v AS BIGINT) AS sum_v, CAST(27 AS BIGINT) AS n_views FROM voxels")
def view_average(spark, sf_dir):
    """Every view of a volume, put back and summed: each voxel gets its own value from every view."""
    df = views.voxels(spark, sf_dir).select("img", *AXES, "v")
    return augment.view_average(augment.unview(augment.views(df, SIDE), SIDE))


@query("""{views}, r AS (SELECT unnest(range(10)) AS i)
SELECT t.img, t.z, t.y, t.x, coalesce(s.v, 0) AS v FROM voxels t LEFT JOIN voxels s ON s.img = t.img AND s.z = t.z
AND s.y = CAST(round_even(0.8660254037844387 * (t.y - 4.5) + 0.49999999999999994 * (t.x - 4.5) + 4.5, 0) AS INT) AND s.x = CAST(round_even(-0.49999999999999994 * (t.y - 4.5) + 0.8660254037844387 * (t.x - 4.5) + 4.5, 0) AS INT)""")
def rotate_about_z(spark, sf_dir):
    return augment.rotate(views.voxels(spark, sf_dir), SIDE, 30.0)


@query("""{views} SELECT img, z, y, x, label FROM (SELECT img, a.p - 1 AS z, b.p - 1 AS y, c.p - 1 AS x, label FROM vl JOIN m a ON z = a.s JOIN m b ON y = b.s JOIN m c ON x = c.s) WHERE z BETWEEN 0 AND 9 AND y BETWEEN 0 AND 9 AND x BETWEEN 0 AND 9""".replace("{views}", "{views}, m AS (SELECT CAST(p AS INT) AS p, CAST(floor((2 * p + 1) * 10 / 24) AS INT) AS s FROM (SELECT unnest(range(12)) AS p))"))
def zoom_nearest(spark, sf_dir):
    return augment.zoom(views.labelled(spark, sf_dir), SIDE, 120).select("img", *AXES, "label")


@query("""{views}, t AS (SELECT img, z, y, x, 0.8 * (y - 4.5) + 0.6 * (x - 4.5) + 4.5 AS py, -0.6 * (y - 4.5) + 0.8 * (x - 4.5) + 4.5 AS px FROM voxels), c AS (SELECT unnest([0, 1]) AS b),
q AS (SELECT img, z, y, x, CAST(floor(py) AS INT) + i.b AS sy, CAST(floor(px) AS INT) + j.b AS sx, CASE WHEN i.b = 1 THEN py - floor(py) ELSE 1 - py + floor(py) END * CASE WHEN j.b = 1 THEN px - floor(px) ELSE 1 - px + floor(px) END AS w FROM t, c i, c j)
SELECT q.img, q.z, q.y, q.x, CAST(floor(coalesce(sum(CAST(w AS DOUBLE) * s.v), 0) * 100 + 0.5) AS BIGINT) AS v FROM q LEFT JOIN voxels s ON s.img = q.img AND s.z = q.z AND s.y = q.sy AND s.x = q.sx GROUP BY ALL""")
def rotate_linear(spark, sf_dir):
    import math

    return augment.rotate_linear(views.voxels(spark, sf_dir), SIDE, math.degrees(math.asin(0.6))).withColumn("v", fixed(F.col("v"), 2))


@query("""{views}, i AS (SELECT CAST(unnest(range(12)) AS INT) AS p), mz AS (SELECT p, CAST(floor((2 * p + 1) * 10 / 16) AS INT) AS s FROM i WHERE p < 8), my AS (SELECT p, CAST(floor((2 * p + 1) * 10 / 24) AS INT) AS s FROM i),
o AS (SELECT img, a.p + 1 AS z, b.p - 1 AS y, x, label FROM vl JOIN mz a ON z = a.s JOIN my b ON y = b.s WHERE b.p BETWEEN 1 AND 10),
l AS (SELECT img, a.p AS z, b.p AS y, c.p AS x FROM (SELECT DISTINCT img FROM voxels), i a, i b, i c WHERE a.p < 10 AND b.p < 10 AND c.p < 10)
SELECT l.img, l.z, l.y, l.x, coalesce(label, 0) AS label FROM l LEFT JOIN o USING (img, z, y, x)""")
def zoom_by_axis(spark, sf_dir):
    """Planes shrunk and padded with zeros, rows stretched and cropped at the middle, columns kept."""
    return augment.zoom(views.labelled(spark, sf_dir), SIDE, (80, 120, 100)).select("img", *AXES, "label")


def _windows_sql() -> str:
    cells = ", ".join(f"({i // 16}, {i // 4 % 4}, {i % 4}, CAST({w!r} AS DOUBLE))" for i, w in enumerate(augment.window_3d(4)))
    return """{views}, i AS (SELECT unnest(range(14)) AS p), m AS (SELECT p, CASE WHEN (p + 16) % 18 < 10 THEN (p + 16) % 18 ELSE 18 - (p + 16) % 18 END AS s FROM i),
pd AS (SELECT img, a.p AS z, b.p AS y, c.p AS x, v FROM voxels JOIN m a ON z = a.s JOIN m b ON y = b.s JOIN m c ON x = c.s),
g AS (SELECT unnest(range(6)) * 2 AS k), w AS (SELECT * FROM (VALUES """ + cells + """) q(oz, oy, ox, w))
SELECT img, CAST(z - 2 AS INT) AS z, CAST(y - 2 AS INT) AS y, CAST(x - 2 AS INT) AS x, CAST(floor(sum(w * (v + 7)) / 8 * 100 + 0.5) AS BIGINT) AS v FROM pd JOIN g a ON z BETWEEN a.k AND a.k + 3 JOIN g b ON y BETWEEN b.k AND b.k + 3 JOIN g c ON x BETWEEN c.k AND c.k + 3
JOIN w ON oz = z - a.k AND oy = y - b.k AND ox = x - c.k WHERE z BETWEEN 2 AND 11 AND y BETWEEN 2 AND 11 AND x BETWEEN 2 AND 11 GROUP BY ALL"""


def _plus_seven(pdf):
    return pdf.assign(image=[x + 7 for x in pdf["image"]])


@query(_windows_sql())
def sliding_windows(spark, sf_dir):
    """A scorer that adds seven, over half-overlapping weighted windows of a padded volume."""
    return pipelines.smooth_predict(views.voxels(spark, sf_dir), SIDE, 4, _plus_seven).withColumn("v", fixed(F.col("v"), 2))


# ---- whole analyses --------------------------------------------------------------------


@query()
def segment_instances(spark, sf_dir):
    """Targets of the octant objects integrated, seeded and assembled into instances (rows-only: an iterative kernel)."""
    df = pipelines.encode_targets(views.labelled(spark, sf_dir)).filter("label > 0")
    return pipelines.segment(df, SIDE, n_std=2.0)


@query("{views}, " + _PROPS + """, c AS (SELECT img, label, area, sum_v, CAST(greatest(0, least(9, round_even(sum_z / area, 0))) AS INT) AS z, CAST(greatest(0, least(9, round_even(sum_y / area, 0))) AS INT) AS y, CAST(greatest(0, least(9, round_even(sum_x / area, 0))) AS INT) AS x FROM props)
SELECT c.img, c.label, c.area AS volume, c.sum_v AS dapi_sum, CASE WHEN coalesce(region, 0) > 0 THEN 'Tumor' ELSE 'Adjacent' END AS condition
FROM c LEFT JOIN vl ON vl.img = c.img AND vl.z = c.z AND vl.y = c.y AND vl.x = c.x""")
def score_table(spark, sf_dir):
    return pipelines.score_table(views.labelled(spark, sf_dir), SIDE, "HCC").select("img", "label", "volume", "dapi_sum", "condition")


@query("{views}, " + _COVER + """, k AS (SELECT img, gz, gy, gx FROM (SELECT *, max(n) OVER () AS top FROM (SELECT img, gz, gy, gx, count(*) FILTER (label > 0) AS n FROM cover GROUP BY ALL)) WHERE n * 100 > top * 60)
SELECT img, gz, gy, gx, count(*) AS n_voxels, CAST(sum(label) AS BIGINT) AS sum_label FROM cover JOIN k USING (img, gz, gy, gx) GROUP BY ALL""")
def training_patches(spark, sf_dir):
    out = pipelines.training_patches(views.labelled(spark, sf_dir), SIDE, _GRID, 60)
    return out.groupBy("img", "gz", "gy", "gx").agg(F.count("*").alias("n_voxels"), F.sum("label").alias("sum_label"))


@query()
def sampled_patches(spark, sf_dir):
    """Random patches with enough signal, by budget and retry (rows-only: it retries on counts)."""
    return pipelines.sampled_patches(views.labelled(spark, sf_dir), SIDE, 4, 50, 60)


@query("""{views}, o AS (SELECT unnest([-1, 0, 1]) AS d),
vt AS (SELECT img, z, y, x, count(*) AS n FROM (SELECT img, CAST(greatest(0, least(4, trunc((z + v % 9 - 4) / 2.0))) AS INT) AS z, CAST(greatest(0, least(4, trunc((y + v % 7 - 3) / 2.0))) AS INT) AS y, CAST(greatest(0, least(4, trunc((x + v % 5 - 2) / 2.0))) AS INT) AS x FROM voxels) GROUP BY ALL)
SELECT img, z, y, x, n FROM (SELECT a.img, a.z, a.y, a.x, a.n, max(b.n) AS m FROM vt a JOIN o p ON true JOIN o q ON true JOIN o r ON true JOIN vt b ON b.img = a.img AND b.z = a.z + p.d AND b.y = a.y + q.d AND b.x = a.x + r.d WHERE a.n > 8 GROUP BY ALL) WHERE n = m""")
def decode_centres(spark, sf_dir):
    df = views.voxels(spark, sf_dir).withColumns({f"d{a}": F.col("v") % m - m // 2 for a, m in zip(AXES, (9, 7, 5), strict=True)})
    return datasets.decode_centres(df, ("dz", "dy", "dx"), 2, SIDE, 8)


@query()
def dataset_preparation(spark, sf_dir):
    """Files classified, split and named (rows-only: its parts have SQL of their own)."""
    return datasets.prepare(views.files(spark, sf_dir).select("path"), mark="en", truth="th")


@query()
def class_thresholds(spark, sf_dir):
    """Two thresholds of three classes over Sobel magnitudes (rows-only: an exhaustive kernel)."""
    edges = neighbors.sobel(views.voxels(spark, sf_dir))
    top = edges.withColumn("v", F.greatest(*[F.abs(f"g{a}") for a in AXES]))
    return neighbors.class_thresholds(top)
