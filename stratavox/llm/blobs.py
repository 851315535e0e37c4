"""Packed arrays in binary rows, and their exchange by bucket.

Operators that move something for every word move it as a few packed rows for each
task and bucket, not as a row each.  `by_bucket` deals the rows (bucket, payload) to
tasks and hands them over in order of bucket, so a task holds one bucket at a time.
Where buckets are many, senders pack by part (`parts_for` keeps these few enough for payloads of
some size, whatever the input), and `by_sub_bucket` cuts each part into its buckets in the receiving
task, by Spark's own sort, which spills.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKED = "bucket int, payload binary"


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays as one compressed value; level: of zstd."""
    head = ";".join(f"{a.dtype.str}:{a.size}" for a in arrays).encode()
    raw = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return struct.pack("<IQ", len(head), len(raw)) + head + pa.Codec("zstd", compression_level=level).compress(raw, asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    n, size = struct.unpack_from("<IQ", data)
    raw = pa.decompress(data[12 + n :], decompressed_size=size, codec="zstd", asbytes=True)
    out, at = [], 0
    for x in data[12 : 12 + n].decode().split(";"):
        kind, count = x.split(":")
        dtype = np.dtype(kind)
        out.append(np.frombuffer(raw, dtype, int(count), at))
        at += dtype.itemsize * int(count)
    return out


def planes(x: np.ndarray) -> np.ndarray:
    """The bytes of x, all first bytes, then all second ones and so on: like bytes compress well."""
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T).ravel()


def from_planes(flat: np.ndarray, dtype: type) -> np.ndarray:
    return np.ascontiguousarray(flat.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def ascending(x: np.ndarray) -> np.ndarray:
    """Planes of the steps of sorted 64-bit values, whose high bytes are zero where the values are many."""
    return planes(np.diff(x, prepend=np.uint64(0)))


def from_ascending(flat: np.ndarray) -> np.ndarray:
    return np.cumsum(from_planes(flat, np.uint64), dtype=np.uint64)


def rows(found: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int32()), pa.array([p for _, p in found], pa.binary())], ["bucket", "payload"])


def spread(df: DataFrame, partitions: int) -> DataFrame:
    """Rows dealt by the number of their bucket itself: hashing the few numbers would put several into one
    task and none into others."""
    return df.repartitionById(partitions, F.pmod(F.col("bucket"), F.lit(partitions)).cast("int"))


def by_bucket(packed: DataFrame, partitions: int) -> DataFrame:
    return spread(packed, partitions).sortWithinPartitions("bucket")


def parts_for(size: int, least: int, bytes_each: int, most: int = 16_384) -> int:
    """Parts that senders pack by: about bytes_each of input, not fewer than least, nor more than most,
    beyond which parts grow and their buckets become more."""
    return int(max(least, min(most, -(-size // bytes_each))))


def by_sub_bucket(packed: DataFrame, partitions: int, split: Callable[[list[np.ndarray]], Iterator[tuple[int, list[np.ndarray]]]], limit: int = 24 << 20) -> DataFrame:
    """packed (PACKED, by part) cut into buckets: split gives (sub-bucket, arrays) of an unpacked payload.
    Rows (bucket, sub, payload) come in order of both; rows of a bucket below 0 pass as they are, with sub 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[list[np.ndarray]]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            found, n = [], 0
            for (b, s), parts in held.items():
                payload = pack(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                found.append((b, s, payload))
                n += len(payload)
                if n > 4 << 20:
                    yield _sub_rows(found)
                    found, n = [], 0
            if found:
                yield _sub_rows(found)
            held.clear()

        for bucket, payload in stream(batches):
            if bucket < 0:
                yield _sub_rows([(bucket, 0, payload)])
                continue
            for sub, arrays in split(unpack(payload)):
                held.setdefault((bucket, sub), []).append(arrays)
                size += sum(x.nbytes for x in arrays)
            if size > limit:
                yield from out()
                size = 0
        yield from out()

    return spread(packed, partitions).mapInArrow(run, "bucket int, sub int, payload binary").sortWithinPartitions("bucket", "sub")


def _sub_rows(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], ["bucket", "sub", "payload"])


def sub_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], bytes]]:
    """The rows of by_sub_bucket(), one by one."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield (batch.column(0)[i].as_py(), batch.column(1)[i].as_py()), batch.column(2)[i].as_py()


def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    """The rows of by_bucket(), one by one."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column(0)[i].as_py(), batch.column(1)[i].as_py()


def gather(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (count of them) for each start."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(int(counts.sum()))


class Bins:
    """Arrays gathered by bucket, given out as packed rows when they reach `limit` bytes."""

    def __init__(self, limit: int = 24 << 20, level: int = 1):
        self.limit, self.level, self.size, self.held = limit, level, 0, {}

    def add(self, bucket: np.ndarray, *columns: tuple[np.ndarray, np.ndarray | None]) -> None:
        """bucket: of each item, ascending; columns: (values, counts), a value for each item
        or, with counts, so many values for each."""
        if not len(bucket):
            return
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        stops = np.append(cut[1:], len(bucket))
        bounds = [(v, cut, stops) if c is None else (v, (e := np.concatenate([[0], np.cumsum(c)]))[cut], e[stops]) for v, c in columns]
        for i, b in enumerate(bucket[cut].tolist()):
            part = [v[lo[i] : hi[i]] for v, lo, hi in bounds]
            self.held.setdefault(b, []).append(part)
            self.size += sum(x.nbytes for x in part)

    def full(self) -> bool:
        return self.size >= self.limit

    def out(self) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for b, parts in sorted(self.held.items()):
            payload = pack(*(np.concatenate(x) for x in zip(*parts, strict=True)), level=self.level)
            found.append((b, payload))
            size += len(payload)
            if size > 4 << 20:
                yield rows(found)
                found, size = [], 0
        if found:
            yield rows(found)
        self.held, self.size = {}, 0
