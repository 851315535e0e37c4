"""Volumes of any shape in array blocks with halos.

A lattice cuts volumes of one shape into blocks.  One shuffle brings each block its voxels and those
of the halo around it (only voxels near a face go to more than one block), and a vectorised kernel
works on the padded array.  A block is a task's group, so an image of any size spreads
over tasks, and memory follows the block and not the image.  Results are those of the voxel forms in
`neighbors` and `field` for every block size.

Absent voxels (sparse volumes) count as zero where values are summed and as absent where voxels are
compared; blocks without voxels in reach do not arise.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .field import CELLS, Grids, parts_of
from .groups import by_groups, starts
from .neighbors import AXES, label_voxels, rooted

BLOCK = [f"b{a}" for a in AXES]


@dataclass(frozen=True)
class Lattice:
    """shape: cells of a volume along z, y, x; block: cells of a block."""

    shape: tuple[int, int, int]
    block: tuple[int, int, int] = (64, 64, 64)

    def counts(self) -> list[int]:
        return [-(-n // b) for n, b in zip(self.shape, self.block, strict=True)]

    def of(self, cell: Column, axis: int) -> Column:
        """The block of a cell; cells outside belong to the nearest block."""
        return F.greatest(F.lit(0), F.least(F.floor(cell / self.block[axis]), F.lit(self.counts()[axis] - 1))).cast("int")


def spread(voxels: DataFrame, lattice: Lattice, radius: int) -> DataFrame:
    """voxels with a row for each block (bz, by, bx) whose cells or halo of `radius` cells hold them."""
    for k, a in enumerate(AXES):
        first, last = lattice.of(F.col(a) - radius, k), lattice.of(F.col(a) + radius, k)
        voxels = voxels.withColumn(BLOCK[k], F.explode(F.sequence(first, last)))
    return voxels


class Box:
    """A block's place: start and stop of its cells, and its padded array's start and shape."""

    def __init__(self, lattice: Lattice, block: tuple[int, int, int], radius: int):
        self.lattice, self.radius = lattice, radius
        self.start = np.array(block) * lattice.block
        self.stop = np.minimum(self.start + lattice.block, lattice.shape)
        self.low = self.start - radius
        self.shape = tuple(int(x) for x in self.stop - self.start + 2 * radius)

    def place(self, cells: np.ndarray) -> np.ndarray:
        """Flat places of cells (3, n) in the padded array."""
        return np.ravel_multi_index(tuple(cells - self.low[:, None]), self.shape)

    def inner(self) -> tuple[slice, ...]:
        return (slice(None), *(slice(self.radius, n - self.radius) for n in self.shape))

    def own(self, cells: np.ndarray) -> np.ndarray:
        return ((cells >= self.start[:, None]) & (cells < self.stop[:, None])).all(0)

    def reflected(self, axis: int) -> np.ndarray:
        """Places along an axis of the padded array, those outside the volume mirrored at its faces."""
        n, at = self.lattice.shape[axis], np.arange(self.low[axis], self.low[axis] + self.shape[axis])
        at = at % (2 * n)
        return np.where(at < n, at, 2 * n - 1 - at) - self.low[axis]


Kernel = Callable[[Box, np.ndarray, dict[str, np.ndarray]], "tuple[np.ndarray, dict[str, np.ndarray]]"]


def by_block(voxels: DataFrame, lattice: Lattice, radius: int, kernel: Kernel, values: list[str], schema: str) -> DataFrame:
    """(img, z, y, x, ...): kernel(box, present, padded arrays of `values`) gives a mask over the block's own cells
    and arrays over them; a row for each cell of the mask.  schema: of the columns after the place.

    Arrays have the axes (image, z, y, x): a call takes the blocks of one place of many images, as far as CELLS goes."""
    names = [n.strip().split()[0] for n in schema.split(",")]

    def alike(table: pa.Table) -> pa.Table:
        block = tuple(table[b][0].as_py() for b in BLOCK)
        box = Box(lattice, block, radius)
        first = starts(table, ["img"])
        images = table["img"].take(pa.array(first)).to_numpy()
        counts = np.diff(first, append=len(table))
        at = box.place(np.stack([table[a].to_numpy() for a in AXES]).astype(np.int64))
        found = []
        for k in parts_of(np.full(len(first), np.prod(box.shape)), CELLS):
            rows = slice(first[k.start], first[k.stop - 1] + counts[k.stop - 1])
            n = k.stop - k.start
            places = (np.repeat(np.arange(n), counts[k]), at[rows])
            present = np.zeros((n, int(np.prod(box.shape))), bool)
            present[places] = True
            padded = {}
            for v in values:
                column = table[v].to_numpy()[rows]
                padded[v] = np.zeros(present.shape, column.dtype)
                padded[v][places] = column
            mask, out = kernel(box, present.reshape(n, *box.shape), {v: x.reshape(n, *box.shape) for v, x in padded.items()})
            image, *cells = np.nonzero(mask)
            place = {a: pa.array((c + s).astype(np.int32)) for a, c, s in zip(AXES, cells, box.start, strict=True)}
            found.append(pa.table({"img": pa.array(images[k][image].astype(np.int64)), **place, **{c: pa.array(out[c][(image, *cells)]) for c in names}}))
        return pa.concat_tables(found)

    def run(table: pa.Table) -> pa.Table:
        first = starts(table, BLOCK)
        return pa.concat_tables([alike(table.slice(i, n)) for i, n in zip(first.tolist(), np.diff(first, append=len(table)).tolist(), strict=True)])

    rows = spread(voxels.select("img", *AXES, *values), lattice, radius)
    return by_groups(rows.withColumn("img", F.col("img").cast("long")), [*BLOCK, "img"], run, f"img long, z int, y int, x int, {schema}")


def _windowed(array: np.ndarray, radius: int, join: Callable) -> np.ndarray:
    """join over the cube of a radius around each cell that has its whole cube in the array (the last three axes)."""
    for axis in (-3, -2, -1):
        n = array.shape[axis] - 2 * radius
        parts = [np.take(array, range(k, k + n), axis) for k in range(2 * radius + 1)]
        out = parts[0]
        for p in parts[1:]:
            out = join(out, p)
        array = out
    return array


def smooth(voxels: DataFrame, lattice: Lattice, weights: list[float], integer: bool = True, value: str = "v") -> DataFrame:
    """neighbors.smooth() of volumes of any shape by blocks."""
    radius = len(weights) // 2

    def kernel(box: Box, present: np.ndarray, padded: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        at = [box.reflected(k) for k in range(3)]
        # a small volume is mirrored more than once, a small last block never past its halo
        every = np.ix_(range(len(present)), *at)
        v, reached = padded[value].astype(float)[every], present[every]
        for axis in (1, 2, 3):
            n = v.shape[axis] - 2 * radius
            shifted = [np.take(v, range(k, k + n), axis) for k in range(2 * radius + 1)]
            reached = np.logical_or.reduce([np.take(reached, range(k, k + n), axis) for k in range(2 * radius + 1)])
            v = sum(w * s for w, s in zip(weights, shifted, strict=True))
            if integer:
                v = np.trunc(v + np.sign(v) * 1e-6)
        return reached, {value: v}

    return by_block(voxels, lattice, radius, kernel, [value], f"{value} double")


def local_maxima(voxels: DataFrame, lattice: Lattice, radius: int = 1, threshold: int = 0, value: str = "v") -> DataFrame:
    """(img, z, y, x, v): voxels above a threshold that no voxel of their window exceeds."""

    def kernel(box: Box, present: np.ndarray, padded: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        v = padded[value]
        least = -np.inf if v.dtype.kind == "f" else np.iinfo(v.dtype).min
        top, own = _windowed(np.where(present, v, least), radius, np.maximum), v[box.inner()]
        return present[box.inner()] & (own > threshold) & (own == top), {value: own}

    return by_block(voxels, lattice, radius, kernel, [value], f"{value} {dict(voxels.dtypes)[value]}")


def sobel(voxels: DataFrame, lattice: Lattice, value: str = "v") -> DataFrame:
    """(img, z, y, x, gz, gy, gx): neighbors.sobel() by blocks."""
    kind = "long" if dict(voxels.dtypes)[value] in ("tinyint", "smallint", "int", "bigint") else "double"

    def along(array: np.ndarray, axis: int, taps: tuple[int, int, int]) -> np.ndarray:
        n = array.shape[axis] - 2
        return sum(w * np.take(array, range(k, k + n), axis) for k, w in enumerate(taps) if w)

    def kernel(box: Box, present: np.ndarray, padded: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        v, out = padded[value].astype(np.int64 if kind == "long" else float), {}
        for k, a in enumerate(AXES):
            g = v
            for axis in range(3):
                g = along(g, axis + 1, (-1, 0, 1) if axis == k else (1, 2, 1))
            out[f"g{a}"] = g
        return _windowed(present, 1, np.logical_and), out

    return by_block(voxels, lattice, 1, kernel, [value], ", ".join(f"g{a} {kind}" for a in AXES))


def border_labels(voxels: DataFrame, lattice: Lattice, border: int = 1, label: str = "label") -> DataFrame:
    """(img, z, y, x, mark): neighbors.border_labels() by blocks."""
    radius = border + 1

    def kernel(box: Box, present: np.ndarray, padded: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        v = np.where(present, padded[label], 0)
        inner = (slice(None), *(slice(1, n - 1) for n in v.shape[1:]))
        low, high = _windowed(v, 1, np.minimum), _windowed(v, 1, np.maximum)
        core = (v[inner] > 0) & (low == high)
        wide = _windowed(core, border, np.logical_or)
        own = core[(slice(None), *(slice(border, n - border) for n in core.shape[1:]))]
        return wide, {"mark": np.where(own, 255, 127).astype(np.int32)}

    return by_block(voxels.filter(F.col(label) > 0), lattice, radius, kernel, [label], "mark int")


def connected_components(voxels: DataFrame, lattice: Lattice, connectivity: int = 26, label: str | None = None) -> DataFrame:
    """(img, vid, component): component is its smallest voxel id; vids are unique within an image.

    Union-find runs inside each block and its halo of one cell.  A voxel that several blocks see ties
    their local labels together; these pairs, few beside the voxels, are contracted by joins."""
    columns = ["img", "vid", *AXES, *([label] if label else [])]

    def run(table: pa.Table) -> pa.Table:
        cells = np.stack([table[a].to_numpy() for a in AXES]).astype(np.int64)
        vid = table["vid"].to_numpy()
        kind = table[label].to_numpy() if label else np.zeros(len(vid))
        root = label_voxels(cells, vid, kind, connectivity, starts(table, ["img", *BLOCK]))
        start = np.stack([table[b].to_numpy() for b in BLOCK]).astype(np.int64) * np.array(lattice.block)[:, None]
        stop = np.minimum(start + np.array(lattice.block)[:, None], np.array(lattice.shape)[:, None])
        own = ((cells >= start) & (cells < stop)).all(0)
        inside = ((cells > start) & (cells < stop - 1)).all(0)
        return pa.table({"img": table["img"], "vid": table["vid"], "local": root, "own": own, "shared": ~inside})

    spread_ = spread(voxels.select(*columns).withColumns({c: F.col(c).cast("long") for c in ("img", "vid")}), lattice, 1)
    found = by_groups(spread_, ["img", *BLOCK], run, "img long, vid long, local long, own boolean, shared boolean").checkpoint()
    ties = found.filter("shared").groupBy("img", "vid").agg(F.min("local").alias("b"), F.collect_set("local").alias("locals"))
    edges = ties.select("img", F.explode("locals").alias("a"), "b").filter("a <> b").distinct()
    roots = rooted(edges).withColumnRenamed("id", "local")
    named = found.filter("own").join(roots, ["img", "local"], "left")
    return named.select("img", "vid", F.coalesce("root", "local").alias("component"))


def _regions(lattice: Lattice, halo: int, most: int) -> Lattice:
    """The lattice of regions of whole blocks, as many along each axis as have `most` cells with their halos in all, or of one."""
    padded = float(np.prod([b + 2 * halo for b in lattice.block]))
    along = max(1, int((most / padded) ** (1 / 3)))
    return Lattice(lattice.shape, tuple(b * along for b in lattice.block))


def _places(lattice: Lattice, cells: np.ndarray) -> np.ndarray:
    """Lattice.of() of cells (3, n)."""
    return np.clip(np.floor(cells / np.array(lattice.block)[:, None]), 0, np.array(lattice.counts())[:, None] - 1).astype(np.int64)


def _copies(lattice: Lattice, radius: int, cells: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """spread() on arrays: (index of the cell, block) of each of cells' copies for the blocks from low to high, bounds for each cell."""
    first, last = np.maximum(_places(lattice, cells - radius), low), np.minimum(_places(lattice, cells + radius), high)
    index, block = np.arange(cells.shape[1]), np.empty((0, cells.shape[1]), np.int64)
    for k in range(3):
        n = last[k, index] - first[k, index] + 1
        again = np.repeat(np.arange(len(index)), n)
        index, block = index[again], np.vstack([block[:, again], first[k, index[again]] + np.arange(len(again)) - np.repeat(np.cumsum(n) - n, n)])
    return index, block


def integrate(voxels: DataFrame, lattice: Lattice, iterations: int = 200, rate: float = 0.2, momentum: float = 0.8, halo: int = 8, most: int = CELLS) -> DataFrame:
    """(img, vid, z, y, x, ez, ey, ex): field.integrate() of voxels(img, vid, z, y, x, uz, uy, ux) by blocks.

    A task's group is a region of neighbouring blocks, as many as have `most` cells with their halos.  A voxel crosses the shuffle once,
    and once more for each region that has it in its halo; its copies for blocks inside a region are made in the task.
    A block moves its points until their steps are done or the samples around them leave its halo; those are handed, with position and
    momentum, to the block that they are in: inside a region on arrays, between regions by a round.  Points that swing about a face stay
    where they are, as the halo is wider than their swing.  Each later round reads only the regions that got points, and is checkpointed."""
    moved = ["img", "vid", *AXES, *[f"p{a}" for a in AXES], *[f"s{a}" for a in AXES], "step"]
    schema = "img long, vid long, z int, y int, x int, pz double, py double, px double, sz double, sy double, sx double, step int"
    voxels = voxels.select(*[F.col(c).cast("long").alias(c) for c in ("img", "vid")], *[F.col(a).cast("int").alias(a) for a in AXES], *[F.col(f"u{a}").cast("double").alias(f"u{a}") for a in AXES]).checkpoint()
    regions = _regions(lattice, halo, most)
    # a row is a cell of a region's field (step null, p its vector), which starts a point in the first round, or a point
    none = [F.lit(None).cast("double").alias(f"s{a}") for a in AXES]
    field = spread(voxels, regions, halo).select(*BLOCK, "img", "vid", *AXES, *[F.col(f"u{a}").alias(f"p{a}") for a in AXES], *none, F.lit(None).cast("int").alias("step"))
    sides, shape, counts = (np.array(v)[:, None] for v in (lattice.block, lattice.shape, lattice.counts()))
    along = np.array(regions.block)[:, None] // sides

    def advance(owners: np.ndarray, low: np.ndarray, high: np.ndarray, of_cell: np.ndarray, cells: np.ndarray, vectors: np.ndarray, p: np.ndarray, s: np.ndarray, n: np.ndarray) -> None:
        """Moves points in place until they are done or leave their region.  low, high: the first and last blocks of regions; owners, of_cell: of points and cells."""
        wide = high - low + 1
        before = np.cumsum(wide.prod(0)) - wide.prod(0)
        number = lambda region, block: before[region] + ((block[0] - low[0, region]) * wide[1, region] + block[1] - low[1, region]) * wide[2, region] + block[2] - low[2, region]
        total = int(wide.prod(0).sum())
        region = np.repeat(np.arange(wide.shape[1]), wide.prod(0))
        rest = np.arange(total) - before[region]
        start = (np.stack([rest // (wide[1] * wide[2])[region], rest // wide[2, region] % wide[1, region], rest % wide[2, region]]) + low[:, region]) * sides
        stop = np.minimum(start + sides, shape)
        # the samples around a position within these bounds are the block's or outside the volume
        bounds = np.where(start == 0, -np.inf, start - halo), np.where(stop == shape, np.inf, stop + halo - 1)
        index, block = _copies(lattice, halo, cells, low[:, of_cell], high[:, of_cell])
        holder, copies = number(of_cell[index], block), cells[:, index]
        # a grid is as large as the cells of the block and its halo that are there
        least, last = np.full((3, total), np.iinfo(np.int64).max), np.full((3, total), np.iinfo(np.int64).min)
        for k in range(3):
            np.minimum.at(least[k], holder, copies[k])
            np.maximum.at(last[k], holder, copies[k])
        bare = last[:1] < least[:1]
        least = np.where(bare, start, least)
        grids = Grids(least, np.where(bare, 0, last - least + 1))
        grids.fill(holder, copies, vectors[:, index])
        going = np.flatnonzero(n < iterations)
        while len(going):
            block = _places(lattice, p[:, going])
            at = owners[going]
            inside = ((block >= low[:, at]) & (block <= high[:, at])).all(0)
            going, block, at = going[inside], block[:, inside], at[inside]
            moving = p[:, going], s[:, going], n[going]
            grids.advance(number(at, block), *moving, iterations, rate, momentum, bounds)
            p[:, going], s[:, going], n[going] = moving
            going = going[n[going] < iterations]

    def run(table: pa.Table, begins: bool) -> pa.Table:
        first = starts(table, ["img", *BLOCK])
        rows = np.diff(first, append=len(table))
        region = np.stack([table[b].to_numpy()[first] for b in BLOCK]).astype(np.int64)
        low = region * along
        high = np.minimum(low + along, counts) - 1
        of = np.repeat(np.arange(len(first)), rows)
        point = table["step"].is_valid().to_numpy()
        at = np.stack([table[a].to_numpy() for a in AXES]).astype(np.int64)
        values = np.stack([table[f"p{a}"].to_numpy() for a in AXES])
        if begins:
            movers = np.flatnonzero((_places(regions, at) == region[:, of]).all(0))
            p, s, n = at[:, movers].astype(float), np.zeros((3, len(movers))), np.zeros(len(movers), np.int64)
        else:
            movers = np.flatnonzero(point)
            p, s, n = values[:, movers], np.stack([table[f"s{a}"].to_numpy()[movers] for a in AXES]), table["step"].fill_null(0).to_numpy()[movers].astype(np.int64)
        cells = np.flatnonzero(~point)
        for k in parts_of(((high - low + 1) * (sides + 2 * halo)).prod(0), CELLS):
            span = first[k.start], first[k.stop - 1] + rows[k.stop - 1]
            m, c = slice(*np.searchsorted(movers, span)), cells[slice(*np.searchsorted(cells, span))]
            if m.stop > m.start:
                advance(of[movers[m]] - k.start, low[:, k], high[:, k], of[c] - k.start, at[:, c], values[:, c], p[:, m], s[:, m], n[m])
        out = table.select(["img", "vid", *AXES]).take(pa.array(movers))
        ends = {f"{c}{a}": pa.array(v[k]) for c, v in (("p", p), ("s", s)) for k, a in enumerate(AXES)}
        return pa.table({**{c: out[c] for c in out.column_names}, **ends, "step": pa.array(n.astype(np.int32))})

    finished, points = None, None
    while True:
        if points is None:
            rows = field
        else:
            at = points.select(*[regions.of(F.col(f"p{a}"), k).alias(b) for k, (a, b) in enumerate(zip(AXES, BLOCK, strict=True))], *moved)
            rows = field.join(at.select("img", *BLOCK).distinct(), ["img", *BLOCK], "left_semi").select(field.columns).unionByName(at)
        out = by_groups(rows, ["img", *BLOCK], partial(run, begins=points is None), schema).checkpoint()
        ended = out.filter(F.col("step") >= iterations)
        finished = ended if finished is None else finished.unionByName(ended)
        points = out.filter(F.col("step") < iterations)
        if points.isEmpty():
            return finished.select("img", "vid", *AXES, *[F.col(f"p{a}").cast("int").alias(f"e{a}") for a in AXES])
