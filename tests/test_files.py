"""TIFF compressions, page ranges and the transactional file sink."""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratavox.sources import codecs, files, tiff


def packed_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = 1
        while n < 128 and at + n < len(data) and data[at + n] == data[at]:
            n += 1
        if n > 2:
            out += bytes([257 - n, data[at]])
        else:
            n = min(2, len(data) - at)
            out += bytes([n - 1]) + data[at : at + n]
        at += n
    return bytes(out)


def lzw_codes(data: bytes) -> bytes:
    """A plain encoder: the width grows when the next code would not fit, one early."""
    table, width, bits = {bytes([i]): i for i in range(256)}, 9, []
    put = lambda code: bits.append(format(code, f"0{width}b"))
    put(256)
    free, now = 258, b""
    for k in data:
        wider = now + bytes([k])
        if wider in table:
            now = wider
            continue
        put(table[now])
        table[wider], free, now = free, free + 1, bytes([k])
        if free == 4094:
            put(256)
            table, width, free = {bytes([i]): i for i in range(256)}, 9, 258
        elif free + 1 > 1 << width:
            width += 1
    if now:
        put(table[now])
        free += 1
        if free + 1 > 1 << width and width < 12:
            width += 1
    put(257)
    text = "".join(bits)
    text += "0" * (-len(text) % 8)
    return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8))


PACK = {codecs.NONE: bytes, codecs.LZW: lzw_codes, codecs.DEFLATE: zlib.compress, codecs.OLD_DEFLATE: zlib.compress, codecs.PACKBITS: packed_bits}


def tiff_bytes(volume, scheme, predictor=1, tile=None, order="<", rows=2):
    """A file of the volume in strips of `rows` lines or in tiles."""
    out = bytearray({"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in volume:
        h, w = page.shape
        th, tw = tile or (rows, w)
        offsets, sizes = [], []
        for y in range(0, h, th):
            for x in range(0, w, tw):
                part = page[y : y + th, x : x + tw]
                if tile:
                    part = np.pad(part, ((0, th - part.shape[0]), (0, tw - part.shape[1])))
                if predictor == 2:
                    part = np.diff(part, axis=1, prepend=part.dtype.type(0))
                data = PACK[scheme](part.astype(part.dtype.newbyteorder(order)).tobytes())
                offsets.append(len(out))
                sizes.append(len(data))
                out += data
        kind = {"u": 1, "i": 2, "f": 3}[volume.dtype.kind]
        entries = [(256, [w]), (257, [h]), (258, [8 * volume.dtype.itemsize]), (259, [scheme]), (262, [1]), (277, [1]), (317, [predictor]), (339, [kind])]
        entries += [(322, [tw]), (323, [th]), (324, offsets), (325, sizes)] if tile else [(273, offsets), (278, [th]), (279, sizes)]
        body = []
        for tag, values in sorted(entries):
            if len(values) > 1:
                at = len(out)
                out += struct.pack(f"{order}{len(values)}I", *values)
            else:
                at = values[0]
            body.append(struct.pack(order + "HHII", tag, 4, len(values), at))
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(body)) + b"".join(body)
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


def stack(dtype, shape=(3, 7, 20)):
    rng = np.random.default_rng(3)
    v = rng.integers(0, 6, shape) * 40 + (np.arange(shape[2]) // 5)
    return (v / 7 if np.dtype(dtype).kind == "f" else v).astype(dtype)


@pytest.mark.parametrize("scheme", sorted(PACK))
@pytest.mark.parametrize("tile", [None, (4, 16)])
@pytest.mark.parametrize("order", ["<", ">"])
def test_compressions_tiles_and_byte_orders(scheme, tile, order):
    for dtype in ("uint8", "uint16", "int32", "float32", "float16"):
        volume = stack(dtype)
        for predictor in (1, 2) if volume.dtype.kind in "ui" else (1,):
            found = tiff.decode(tiff_bytes(volume, scheme, predictor, tile, order))
            assert found.dtype == volume.dtype and (found == volume).all()


def test_lzw_of_long_and_odd_data():
    rng = np.random.default_rng(0)
    for data in (b"", b"a", b"a" * 70_000, rng.bytes(30_000), bytes(range(256)) * 40):
        assert codecs.lzw(lzw_codes(data)) == data
        assert codecs.packbits(packed_bits(data)) == data
    for bad in (bytes([0]) * 4, b"\x80\x7f\xff\xff"):
        with pytest.raises(ValueError):
            codecs.lzw(bad)


def test_unread_kinds_say_so():
    with pytest.raises(ValueError, match="compression"):
        codecs.unpacked(b"", 7)
    with pytest.raises(ValueError, match="predictor"):
        codecs.unpredicted(np.zeros((1, 1)), 3)


def test_pages_are_read_by_ranges(spark, tmp_path):
    """Integers stay whole, also beyond what a float holds; a partition has its pages only."""
    volume = np.arange(5 * 3 * 4).reshape(5, 3, 4).astype("uint32") + 16_777_217
    (tmp_path / "a.tif").write_bytes(tiff_bytes(volume, codecs.LZW))
    (tmp_path / "b.tiff").write_bytes(tiff_bytes(volume[:1] + 5, codecs.DEFLATE, tile=(16, 16)))
    tiff.register(spark)
    df = spark.read.format("tiff_pages").option("pages", 2).option("values", "long").load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 4
    found = {(os.path.basename(r.path), r.page): r.data for r in df.collect()}
    assert found == {("a.tif", k): volume[k].ravel().tolist() for k in range(5)} | {("b.tiff", 0): (volume[0] + 5).ravel().tolist()}
    assert {tuple(r.data) for r in tiff.decode_column(spark, f"file://{tmp_path}", "long").collect()} == {tuple(volume.ravel().tolist()), tuple((volume[0] + 5).ravel().tolist())}


def tree(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names if not f.endswith(".crc"))


def test_files_appear_all_or_none(spark, tmp_path):
    rows = [(f"d{i % 3}/f{i}.bin", bytes([i]) * i) for i in range(20)]
    df = spark.createDataFrame(rows, files.FILES).repartition(4)
    files.write(df, f"file://{tmp_path}/out")
    assert tree(tmp_path / "out") == sorted(n for n, _ in rows)
    assert (tmp_path / "out/d2/f5.bin").read_bytes() == bytes([5]) * 5
    bad = df.withColumn("content", F.when(F.col("name") != "d1/f7.bin", F.lit(b"new"))).withColumn("name", F.concat(F.lit("again/"), "name"))
    with pytest.raises(Exception, match="no file name or no content"):
        files.write(bad, f"file://{tmp_path}/out")
    assert tree(tmp_path / "out") == sorted(n for n, _ in rows)
    with pytest.raises(Exception, match="no file name"):
        files.write(spark.createDataFrame([("../x", b"1")], files.FILES), f"file://{tmp_path}/out")
    assert not (tmp_path / "x").exists()


def test_copies_and_stacks(spark, tmp_path):
    src = tmp_path / "src"
    for k in range(4):
        (src / f"d{k % 2}").mkdir(parents=True, exist_ok=True)
        (src / f"d{k % 2}" / f"{k}.tif").write_bytes(bytes([k]) * 9)
    names = spark.createDataFrame([(f"file://{src}/d{k % 2}/{k}.tif", f"train/images/{k}_new.tif") for k in range(3)], "source string, name string")
    files.copied(spark, names, f"file://{tmp_path}/set")
    assert tree(tmp_path / "set") == [f"train/images/{k}_new.tif" for k in range(3)]
    assert (tmp_path / "set/train/images/2_new.tif").read_bytes() == bytes([2]) * 9
    pages = spark.createDataFrame([("s.tif", p, y, x, 10 * p + y + x) for p in (4, 5, 7) for y in range(2) for x in range(3)], "stack string, page int, y int, x int, v int")
    files.write(tiff.stack_pages(pages, "stack", (2, 3)), f"file://{tmp_path}/set")
    volume = tiff.decode((tmp_path / "set/s.tif").read_bytes())
    assert volume.shape == (4, 2, 3) and volume[3, 1, 2] == 73 and volume[2].sum() == 0


def test_pairs_of_equal_names_in_two_folders(spark, tmp_path):
    for d in ("images", "masks"):
        (tmp_path / d).mkdir()
        for k in range(3 if d == "images" else 2):
            (tmp_path / d / f"v{k}.tif").write_bytes(tiff.encode(np.full((2, 2, 2), k + 1, "uint8")))
    left, right = tiff.paired(spark, f"file://{tmp_path}/images", f"file://{tmp_path}/masks")
    assert sorted((os.path.basename(r.path), r.img) for r in left.collect()) == [("v0.tif", 1), ("v1.tif", 2)]
    assert sorted(r.img for r in right.collect()) == [1, 2]
