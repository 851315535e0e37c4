"""Kernels over many groups at once: a call's cost is shared by all groups of a chunk, and a task holds a chunk."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Rows of a chunk; a larger group is a chunk of its own.
CHUNK = 65_536


def starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """The first row of each run of equal keys (nulls are equal)."""
    new = np.ones(len(table), bool)
    if len(table) > 1:
        new[1:] = False
        for k in keys:
            c = table[k].combine_chunks()
            a, b = c[:-1], c[1:]
            differs = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
            new[1:] |= differs.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = CHUNK) -> Iterator[pa.Table]:
    """Tables of about `rows` rows out of batches that are sorted by keys; none cuts a group."""
    held, n, enough = [], 0, rows
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n < enough:
            continue
        table = pa.Table.from_batches(held)
        cut = int(starts(table, keys)[-1])
        if cut:
            yield table[:cut]
        held, n = table[cut:].to_batches(), len(table) - cut
        enough = max(rows, 2 * n)  # a group that is not at its end is looked at again when twice as long
    if n:
        yield pa.Table.from_batches(held)


def by_groups(df: DataFrame, keys: list[str], run: Callable[[pa.Table], pa.Table], schema: str, then: tuple[str, ...] = ()) -> DataFrame:
    """run(table of whole groups, sorted by keys and `then`) over df."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys):
            yield from run(table.combine_chunks()).to_batches(max_chunksize=CHUNK)

    return df.repartition(*keys).sortWithinPartitions(*keys, *then).mapInArrow(kernel, schema)
