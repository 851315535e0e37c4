"""The training input: patches in a drawn order, frozen once, then augmented and encoded in batches each epoch.

No epoch sorts images: partitions take turns in the order of a hash, and a bounded buffer inside a
partition mixes its rows.  `frozen` stores that order (a cut of it, if wanted), so it holds for all epochs, as a cache
before the augmentation does; `epoch` reads it, augments each sample by draws of its own and of the epoch, and adds targets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import chain


def mixed_order(patches: DataFrame, seed: int, buffer: int = 1_000) -> DataFrame:
    """patches with (turn, place): the turn of their partition, and their place in it after a buffer of so many rows.

    A row leaves the buffer when another needs its place, so a task holds `buffer` rows and a batch, whatever
    the size of the partition."""
    n = patches.rdd.getNumPartitions()
    ranks = np.argsort(np.random.default_rng(seed).random(n)).argsort()
    schema = T.StructType([*patches.schema.fields, T.StructField("turn", T.IntegerType()), T.StructField("place", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        rng, held, place = np.random.default_rng([seed, part]), None, 0

        def out(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal place
            for x in rows.combine_chunks().to_batches():
                turn, at = pa.array(np.full(len(x), ranks[part], np.int32)), pa.array(np.arange(place, place + len(x)))
                place += len(x)
                yield pa.RecordBatch.from_arrays([*x.columns, turn, at], [*x.schema.names, "turn", "place"])

        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            if len(held) > buffer:
                order = rng.permutation(len(held))
                yield from out(held.take(order[buffer:]))
                held = held.take(np.sort(order[:buffer]))
        if held is not None:
            yield from out(held.take(rng.permutation(len(held))))

    return patches.mapInArrow(run, schema)


def first_rows(ordered: DataFrame, count: int) -> DataFrame:
    """The first `count` rows by (turn, place): whole turns and a part of one, found from the turns' sizes."""
    sizes = sorted((r.turn, r.n) for r in ordered.groupBy("turn").agg(F.count("*").alias("n")).collect())  # as many as partitions
    left = count
    for turn, n in sizes:
        if n >= left:
            return ordered.filter((F.col("turn") < turn) | ((F.col("turn") == turn) & (F.col("place") < left)))
        left -= n
    return ordered


def frozen(patches: DataFrame, path: str, seed: int, take: int | None = None, buffer: int = 1_000) -> DataFrame:
    """The order of mixed_order(), cut to `take` rows, stored at path and read back."""
    ordered = mixed_order(patches, seed, buffer)
    if take is not None:
        ordered.write.mode("overwrite").parquet(path + "_all")  # turns are counted on what is cut
        ordered = first_rows(patches.sparkSession.read.parquet(path + "_all"), take)
    ordered.write.mode("overwrite").parquet(path)
    return patches.sparkSession.read.parquet(path)


def targets(labels: np.ndarray, shape: tuple[int, int, int], least: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """(foreground, unit vectors (3, cells)): from each cell of an object of at least `least` cells to the midpoint of its box."""
    flat = np.asarray(labels).reshape(-1)
    at = np.stack(np.unravel_index(np.arange(flat.size), shape))
    names, inverse, sizes = np.unique(flat, return_inverse=True, return_counts=True)
    low, high = np.full((3, len(names)), np.iinfo(np.int64).max), np.full((3, len(names)), -1)
    for k in range(3):
        np.minimum.at(low[k], inverse, at[k])
        np.maximum.at(high[k], inverse, at[k])
    middle = np.rint((low + high) / 2).astype(np.int64)
    step = np.where(((names > 0) & (sizes >= least))[inverse], middle[:, inverse] - at, 0).astype(float)
    norm = np.sqrt((step**2).sum(0))
    return (flat > 0).astype(np.int8), np.divide(step, norm, out=np.zeros_like(step), where=norm > 0)


def epoch(stored: DataFrame, number: int, shape: tuple[int, int, int], batch: int, key: str = "patch_id", rules: chain.ChainRules | None = chain.ChainRules(), least: int = 20) -> DataFrame:
    """(turn, batch, place, key, image, labels, foreground, vz, vy, vx): a frozen set's samples in batches, augmented by
    the epoch's draws (rules None: as they are, for validation), with the targets of what the labels have become."""
    out = stored.select("turn", F.floor(F.col("place") / batch).alias("batch"), "place", F.col(key).alias(key), "image", "labels")
    if rules is not None:
        out = chain.augmented(out, shape, F.concat_ws("/", F.col(key), F.lit(number)), rules)
    vectors = ", ".join(f"v{a} array<float>" for a in "zyx")
    schema = f"turn int, batch long, place long, {key} {dict(out.dtypes)[key]}, image array<float>, labels array<int>, foreground array<tinyint>, {vectors}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            made = [targets(w, shape, least) for w in pdf["labels"]]
            columns = {"foreground": [f for f, _ in made]} | {f"v{a}": [v[k].astype(np.float32) for _, v in made] for k, a in enumerate("zyx")}
            yield pdf.assign(**{k: pd.Series(c, pdf.index, object) for k, c in columns.items()})

    return out.mapInPandas(run, schema)


def dataset(spark: SparkSession, path: str, number: int, shape: tuple[int, int, int], batch: int, **options) -> DataFrame:
    """epoch() of the set frozen at path."""
    return epoch(spark.read.parquet(path), number, shape, batch, **options)
