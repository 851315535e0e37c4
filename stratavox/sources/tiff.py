"""Multipage TIFF files as volumes: a NumPy codec and a Spark data source.

`spark.read.format("tiff_volume").load(folder)` yields one row a file, `tiff_pages` one row a page, read in
partitions of page ranges, so a large file spreads over tasks.  The codec reads grey stacks (integers of 8 to 64 bits,
floats of 16 to 64) of either byte order in strips or tiles, uncompressed or by LZW, Deflate or PackBits, with
horizontal differences or without; it writes uncompressed stacks.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import codecs, files

#: Fixed values of the TIFF 6.0 format: tags, and bytes of field types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, STRIP_BYTES, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 339
PREDICTOR, TILE_WIDTH, TILE_ROWS, TILES, TILE_BYTES = 317, 322, 323, 324, 325
_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 8: 2, 9: 4, 11: 4, 12: 8, 16: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}

NAME_PATTERN = "*.[tT][iI][fF]*"
VOLUME = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("nz", T.IntegerType()), T.StructField("ny", T.IntegerType()),
    T.StructField("nx", T.IntegerType()), T.StructField("data", T.ArrayType(T.FloatType(), False)),
])


class Directory:
    """The tags of a page, and its samples as they lie in the file."""

    def __init__(self, tags: dict[int, tuple], order: str):
        self.tags, self.order = tags, order
        if self._one(SAMPLES, 1) != 1:
            raise ValueError("only grey pages are read")
        kind = {1: "u", 2: "i", 3: "f"}[self._one(FORMAT, 1)]
        bits = self._one(BITS, 8)
        if bits % 8:
            raise ValueError(f"samples of {bits} bits are not read")
        self.dtype = np.dtype(f"{order}{kind}{bits // 8}")
        self.shape = (tags[HEIGHT][0], tags[WIDTH][0])

    def _one(self, tag: int, default: int) -> int:
        return self.tags.get(tag, (default,))[0]

    def decode(self, read) -> np.ndarray:
        """The page's (rows, columns); read(offset, size) gives the file's bytes there."""
        scheme, predictor = self._one(COMPRESSION, 1), self._one(PREDICTOR, 1)
        out = np.zeros(self.shape, self.dtype.newbyteorder("="))
        if TILES in self.tags:
            height, width, offsets, sizes = self._one(TILE_ROWS, 0), self._one(TILE_WIDTH, 0), self.tags[TILES], self.tags[TILE_BYTES]
        else:
            height, width, offsets, sizes = min(self._one(ROWS, self.shape[0]), self.shape[0]), self.shape[1], self.tags[STRIPS], self.tags[STRIP_BYTES]
        across = -(-self.shape[1] // width)
        for k, (offset, size) in enumerate(zip(offsets, sizes, strict=True)):
            y, x = k // across * height, k % across * width
            lines = height if TILES in self.tags else min(height, self.shape[0] - y)  # a last strip is short, a tile never
            raw = codecs.unpacked(read(offset, size), scheme)
            part = np.frombuffer(raw, self.dtype, lines * width).reshape(lines, width).astype(out.dtype)
            part = codecs.unpredicted(part, predictor)[: self.shape[0] - y, : self.shape[1] - x]
            out[y : y + part.shape[0], x : x + part.shape[1]] = part
        return out


def directories(read) -> Iterator[Directory]:
    """The pages of a file, in order, without their samples; read(offset, size) gives the file's bytes there."""
    head = read(0, 8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or len(head) < 8 or struct.unpack_from(order + "H", head, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack_from(order + "I", head, 4)[0], set()
    while at:
        if at in seen:
            raise ValueError("pages that lead to themselves")
        seen.add(at)
        count = struct.unpack(order + "H", read(at, 2))[0]
        entries, tags = read(at + 2, 12 * count + 4), {}
        for i in range(count):
            tag, kind, n = struct.unpack_from(order + "HHI", entries, 12 * i)
            size = _BYTES.get(kind, 0) * n
            if kind in _CODES:
                raw = entries[12 * i + 8 : 12 * i + 8 + size] if size <= 4 else read(struct.unpack_from(order + "I", entries, 12 * i + 8)[0], size)
                tags[tag] = struct.unpack(f"{order}{n}{_CODES[kind]}", raw)
        yield Directory(tags, order)
        at = struct.unpack_from(order + "I", entries, 12 * count)[0]


def decode(data: bytes) -> np.ndarray:
    """The (pages, rows, columns) array of a file."""
    read = lambda offset, size: data[offset : offset + size]
    return np.stack([page.decode(read) for page in directories(read)])


def encode(volume: np.ndarray) -> bytes:
    """A little-endian file of a (pages, rows, columns) array, one strip a page."""
    volume = np.asarray(volume)
    depth, height, width = volume.shape
    kind = {"u": 1, "i": 2, "f": 3}[volume.dtype.kind]
    page_bytes = height * width * volume.dtype.itemsize
    fields = 10
    out = bytearray(struct.pack("<2sHI", b"II", 42, 8))
    directory = 2 + 12 * fields + 4
    for z in range(depth):
        at = len(out) + directory
        entries = [
            (WIDTH, 4, width), (HEIGHT, 4, height), (BITS, 3, 8 * volume.dtype.itemsize), (COMPRESSION, 3, 1), (PHOTOMETRIC, 3, 1),
            (STRIPS, 4, at), (SAMPLES, 3, 1), (ROWS, 4, height), (STRIP_BYTES, 4, page_bytes), (FORMAT, 3, kind),
        ]
        out += struct.pack("<H", fields)
        for tag, field, value in entries:
            out += struct.pack("<HHII", tag, field, 1, value)
        out += struct.pack("<I", at + page_bytes if z + 1 < depth else 0)
        out += volume[z].astype(volume.dtype.newbyteorder("<")).tobytes()
    return bytes(out)


def _kept(kind: str) -> T.ArrayType:
    return T.ArrayType({"float": T.FloatType(), "double": T.DoubleType(), "long": T.LongType()}[kind], False)


def decode_files(found: DataFrame, values: str = "float") -> DataFrame:
    """found(path, content, ...) with nz, ny, nx and data in place of content, decoded once in Arrow batches.  values: float,
    double or long, the type of data's elements (long keeps labels of any size)."""
    kept = [c for c in found.columns if c != "content"]
    schema = T.StructType([found.schema[c] for c in kept] + [T.StructField(c, T.IntegerType()) for c in ("nz", "ny", "nx")] + [T.StructField("data", _kept(values), False)])
    dtype = {"float": np.float32, "double": np.float64, "long": np.int64}[values]

    def run(frames):
        for pdf in frames:
            volumes = [decode(bytes(c)) for c in pdf["content"]]
            sizes = {c: [v.shape[k] for v in volumes] for k, c in enumerate(("nz", "ny", "nx"))}
            yield pdf[kept].assign(**sizes, data=[v.astype(dtype).ravel() for v in volumes])

    return found.mapInPandas(run, schema)


def decode_column(spark: SparkSession, folder: str, values: str = "float") -> DataFrame:
    """(VOLUME) of the TIFF files of a folder that Spark can read."""
    return decode_files(scan(spark, folder).select("path", "content"), values)


def scan(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """Binary rows of the TIFF files of a folder; an empty folder is an error.  Where only names are asked for, contents are not read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", NAME_PATTERN)
    found = reader.option("recursiveFileLookup", str(recursive).lower()).load(folder)
    if found.select("path").limit(1).count() == 0:
        raise FileNotFoundError(f"no TIFF files in {folder}")
    return found


def listing(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """(path, name) of the TIFF files of a folder in order of name; only names are sorted."""
    from ..operators import prep

    return scan(spark, folder, recursive).select("path", prep.name_of(F.col("path")).alias("name")).orderBy("name", "path")


def paired(spark: SparkSession, images: str, masks: str) -> tuple[DataFrame, DataFrame]:
    """((path, img), (path, img)): the k-th image and the k-th mask by name share img = k, from 1; the longer list's rest goes.
    Names alone are read and numbered."""
    from pyspark.sql import Window

    w = Window.partitionBy("all_").orderBy("name", "path")
    left, right = (listing(spark, f).withColumn("all_", F.lit(0)).select("path", F.row_number().over(w).cast("long").alias("img")) for f in (images, masks))
    return left.join(right.select("img"), "img", "left_semi"), right.join(left.select("img"), "img", "left_semi")


def load_pairs(spark: SparkSession, folder: str, images: str = "images", masks: str = "masks", invert: str | None = "Mouse", radius: float | None = None, normalise_first: bool = False) -> DataFrame:
    """(img, path, z, y, x, v, label): volumes of two folders paired by sorted name, with labels.

    Files are paired by name before any is read, and each is decoded once.  Images whose path mentions `invert` are turned
    over, volumes are scaled to 0..1 (before that, with normalise_first), masks become connected parts numbered in each volume; with
    radius, both are rescaled to that mean object radius (volumes must be cubes then)."""
    from ..operators import field, neighbors, project

    left, right = paired(spark, f"{folder}/{images}", f"{folder}/{masks}")
    found = {"image": scan(spark, f"{folder}/{images}").select("path", "content").join(left, "path"), "mask": scan(spark, f"{folder}/{masks}").select("path", "content").join(right, "path")}
    every = F.col("v").isNotNull()
    values = to_voxels(decode_files(found["image"], "double"), every, "img", "path").select("img", "path", "z", "y", "x", "v")
    steps = [lambda d: project.minmax(d).withColumn("v", F.col("norm")).drop("norm"), lambda d: project.invert_where(d, project.path_mentions(F.col("path"), invert)) if invert else d]
    scale = [] if normalise_first else steps[:1]
    for step in steps if normalise_first else steps[1:]:
        values = step(values)
    vid = (F.col("z").cast("long") * (1 << 40)) + F.col("y") * (1 << 20) + F.col("x")
    marks = to_voxels(decode_files(found["mask"], "long"), None, "img").withColumnRenamed("v", "kind").withColumn("vid", vid)
    parts = neighbors.dense_labels(neighbors.connected_components(marks, 26, "kind"))
    labels = marks.join(parts.select("img", "vid", F.col("component_id").cast("int").alias("label")), ["img", "vid"]).select("img", "z", "y", "x", "label")
    both = values.join(labels, ["img", "z", "y", "x"], "left").withColumn("label", F.coalesce("label", F.lit(0)))
    if radius is not None:
        n = both.agg(F.max("z")).first()[0] + 1
        sized = field.rescale_by_radius(both, n, radius, value="v")
        marked = field.rescale_by_radius(both, n, radius).select("img", "z", "y", "x", "label")
        both = sized.join(marked, ["img", "z", "y", "x"]).join(both.select("img", "path").distinct(), "img")
    for step in scale:
        both = step(both)
    return both.select("img", "path", "z", "y", "x", "v", "label")


def stack_channels(volumes: DataFrame, shape: list[int], names: tuple[str, ...] = ("label", "dapi", "region")) -> DataFrame:
    """(img, z, y, x, names...): files whose pages hold a 4-D stack of the shape, its smallest axis (the
    first of equals) taken as the channels."""
    if len(shape) != 4:
        raise ValueError("a stack has four dimensions")
    c = channels_first(shape)
    if len(names) != shape[c]:
        raise ValueError(f"{shape[c]} channels, {len(names)} names")
    cells = volumes.select(F.col("path").alias("img"), F.posexplode("data").alias("i", "v"))
    place, size = [], 1
    for n in reversed(shape):
        place.insert(0, (F.floor(F.col("i") / size) % n).cast("int"))
        size *= n
    rest = [k for k in range(4) if k != c]
    out = cells.select("img", place[c].alias("c_"), *[place[k].alias(a) for k, a in zip(rest, ("z", "y", "x"), strict=True)], "v")
    return out.groupBy("img", "z", "y", "x").agg(*[F.max(F.when(F.col("c_") == k, F.col("v"))).alias(n) for k, n in enumerate(names)])


def encoded(voxels: DataFrame, shape: tuple[int, int, int], name: str, value: str, dtype: str = "uint16") -> DataFrame:
    """(name, content): one TIFF file for each `name`, of the sparse voxels' values (others 0)."""

    def run(pdf):
        import pandas as pd

        volume = np.zeros(shape, dtype)
        volume[pdf["z"], pdf["y"], pdf["x"]] = pdf[value].to_numpy().astype(dtype)
        return pd.DataFrame({"name": [pdf[name].iloc[0]], "content": [encode(volume)]})

    return voxels.select(name, "z", "y", "x", value).groupBy(name).applyInPandas(run, files.FILES)


def stack_pages(pages: DataFrame, stack: str, shape: tuple[int, int], dtype: str = "uint8") -> DataFrame:
    """(name, content): pages(stack, page, y, x, v) of each stack as one multipage file, in order of page; pages
    between the first and the last that have no cell are zero."""

    def run(pdf):
        import pandas as pd

        first = int(pdf["page"].min())
        volume = np.zeros((int(pdf["page"].max()) - first + 1, *shape), dtype)
        volume[pdf["page"] - first, pdf["y"], pdf["x"]] = pdf["v"].to_numpy().astype(dtype)
        return pd.DataFrame({"name": [pdf[stack].iloc[0]], "content": [encode(volume)]})

    return pages.select(stack, "page", "y", "x", "v").groupBy(stack).applyInPandas(run, files.FILES)


def write_volumes(voxels: DataFrame, folder: str, shape: tuple[int, int, int], name: str, value: str, dtype: str = "uint16") -> DataFrame:
    """(path, bytes): encoded() volumes under folder, which driver and executors share, all or none."""
    done = encoded(voxels, shape, name, value, dtype).checkpoint()
    files.write(done, folder)
    return done.select(F.concat(F.lit(folder.rstrip("/") + "/"), "name").alias("path"), F.length("content").cast("long").alias("bytes"))


def write_predictions(objects: DataFrame, folder: str, shape: tuple[int, int, int]) -> DataFrame:
    """objects(model, parent, stem, z, y, x, label) as <model>/<parent>/<stem>/<stem>_labels.tif and _binary.tif."""
    base = F.concat_ws("/", "model", "parent", "stem")
    marked = objects.withColumns({"labels_": F.concat(base, F.lit("/"), F.col("stem"), F.lit("_labels.tif")), "binary_": F.concat(base, F.lit("/"), F.col("stem"), F.lit("_binary.tif")), "mask_": (F.col("label") > 0).cast("int")})
    return write_volumes(marked, folder, shape, "labels_", "label").unionByName(write_volumes(marked, folder, shape, "binary_", "mask_", "uint8"))


def to_voxels(volumes: DataFrame, keep: Column | None = None, img: str = "path", *more: str) -> DataFrame:
    """volumes as sparse rows (img, more, z, y, x, v): img is that column's value (the path); keep filters on v."""
    out = volumes.select(F.col(img).alias("img"), *more, "ny", "nx", F.posexplode("data").alias("i", "v"))
    out = out.filter(F.col("v") > 0 if keep is None else keep)
    plane = F.col("ny") * F.col("nx")
    return out.select("img", *more, F.floor(F.col("i") / plane).cast("int").alias("z"), F.floor(F.col("i") % plane / F.col("nx")).cast("int").alias("y"), (F.col("i") % F.col("nx")).cast("int").alias("x"), "v")


def channels_first(shape: list[int]) -> int:
    """The axis of a 4-D stack that holds the channels: the smallest, the first of equals."""
    return shape.index(min(shape))


class _Pages(InputPartition):
    """Pages first to stop of a file (all of them, without stop)."""

    def __init__(self, path: str, first: int = 0, stop: int | None = None):
        self.path, self.first, self.stop = path, first, stop


def _named(folder: str) -> tuple:
    """(file system, paths): the TIFF files of a folder in order."""
    import pyarrow.fs as pafs

    fs, root = files.file_system(folder)
    return fs, sorted(f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.is_file and re.search(r"\.tif", f.path, re.I))


def _reading(handle):
    """read(offset, size) of an open file."""

    def read(offset: int, size: int) -> bytes:
        handle.seek(offset)
        return handle.read(size)

    return read


def _batch(schema: T.StructType, paths: list[str], sizes: list[list[int]], arrays: list[np.ndarray], kind: str):
    import pyarrow as pa

    element = {"float": pa.float32(), "double": pa.float64(), "long": pa.int64()}[kind]
    flat = pa.array(np.concatenate([a.ravel() for a in arrays]).astype(element.to_pandas_dtype()))
    offsets = np.concatenate([[0], np.cumsum([a.size for a in arrays])]).astype(np.int32)
    cells = pa.ListArray.from_arrays(pa.array(offsets), flat)
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.field("element", element, False))]
    columns = [pa.array(paths), *[pa.array(list(c), pa.int32()) for c in zip(*sizes, strict=True)], cells.cast(kinds[4])]
    return pa.RecordBatch.from_arrays(columns, schema=pa.schema([pa.field(n, k) for n, k in zip(schema.fieldNames(), kinds, strict=True)]))


class _VolumeReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        return [_Pages(p) for p in _named(self.folder)[1]]

    def read(self, partition: _Pages) -> Iterator:
        fs = files.file_system(self.folder)[0]
        with fs.open_input_file(partition.path) as f:
            volume = decode(f.read())
        yield _batch(VOLUME, [partition.path], [list(volume.shape)], [volume], "float")


class TiffVolumes(DataSource):
    """Files of a folder as volumes, a partition a file."""

    @classmethod
    def name(cls) -> str:
        return "tiff_volume"

    def schema(self) -> T.StructType:
        return VOLUME

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _VolumeReader(self.options["path"])


class _PageReader(DataSourceReader):
    def __init__(self, folder: str, pages: int, values: str, schema: T.StructType):
        self.folder, self.pages, self.values, self.schema = folder, pages, values, schema

    def partitions(self) -> list[InputPartition]:
        """Ranges of pages: a file's directories are read, its samples are not."""
        fs, paths = _named(self.folder)
        out = []
        for path in paths:
            with fs.open_input_file(path) as f:
                n = sum(1 for _ in directories(_reading(f)))
            out += [_Pages(path, k, min(k + self.pages, n)) for k in range(0, n, self.pages)]
        return out

    def read(self, partition: _Pages) -> Iterator:
        fs = files.file_system(self.folder)[0]
        with fs.open_input_file(partition.path) as f:
            read = _reading(f)
            for k, page in enumerate(directories(read)):
                if k >= partition.stop:
                    break
                if k >= partition.first:
                    cells = page.decode(read)
                    yield _batch(self.schema, [partition.path], [[k, *cells.shape]], [cells], self.values)


class TiffPages(DataSource):
    """(path, page, ny, nx, data): pages of a folder's files.  Options: pages, of a partition (64); values: float, double or long."""

    @classmethod
    def name(cls) -> str:
        return "tiff_pages"

    def schema(self) -> T.StructType:
        names = [T.StructField(c, T.IntegerType()) for c in ("page", "ny", "nx")]
        return T.StructType([T.StructField("path", T.StringType()), *names, T.StructField("data", _kept(self.options.get("values", "double")))])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _PageReader(self.options["path"], int(self.options.get("pages", "64")), self.options.get("values", "double"), self.schema())


def register(spark: SparkSession) -> None:
    for source in (TiffVolumes, TiffPages, files.NamedFiles):
        spark.dataSource.register(source)
