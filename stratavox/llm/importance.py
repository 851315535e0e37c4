"""Quality selection by importance resampling of documents.

Two generative models over hashed n-grams (word unigrams and bigrams in `buckets`
classes, additively smoothed) are estimated: one of the target, one of all raw
documents.  A document's log weight is the sum over its n-grams of log p_target -
log p_raw.  Adding Gumbel noise keyed by the document's id and taking the k largest
samples k documents without replacement in proportion to their weights.

The raw model counts every document.  The target model is fitted on at most
`max_target` documents that `labels` marks as good (those of the smallest keyed
hash), a documented bound that keeps the broadcast set of ids small.  k is a
share of all documents, so it grows with them; its cut is found exactly by
refining a histogram of the keys (at most `bins` rows come to the driver a step).

Edge cases: null and empty texts have no n-grams and weight 0; a null doc_id counts
as -1 for its noise; repeated rows have equal keys and stand or fall together, as do
ties; without target documents all weights are 0; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .storage import least_hashed, stored


@dataclass(frozen=True)
class ResampleRules:
    """share: of all documents to select; smoothing: pseudo-count of a class."""

    buckets: int = 1 << 16
    share: float = 0.8
    smoothing: float = 1.0
    max_target: int = 50_000
    seed: int = 17
    bins: int = 4096


def _features(block: tb.Block, hasher: tb.Hasher, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of every unigram and bigram of a block."""
    words = hasher.spans(block.data, block.starts, block.ends)
    pairs, at = block.ngrams(words, 2)
    doc = block.doc_of_word()
    bucket = (np.concatenate([words, pairs]) % np.uint64(buckets)).astype(np.int64)
    return bucket, np.concatenate([doc, doc[at]])


def target_ids(labels: DataFrame, rules: ResampleRules) -> np.ndarray:
    """Sorted ids of at most max_target documents of quality 1 (smallest keyed hash first)."""
    rows = labels.filter("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long")).distinct()
    rows = least_hashed(stored(rows, "targets"), ["doc_id"], rules.seed, rules.max_target)
    return np.sort(np.array([r[0] for r in rows.collect()], np.int64))


def fit(docs: DataFrame, labels: DataFrame, rules: ResampleRules = ResampleRules()) -> np.ndarray:
    """log p_target - log p_raw of each bucket."""
    shared = docs.sparkSession.sparkContext.broadcast(target_ids(labels, rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, table, good = tb.Hasher(lower=False), tb.whitespace_words(), shared.value
        counts = np.zeros((2, rules.buckets), np.int64)
        for batch in batches:
            target = np.isin(batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False), good)
            for block in tb.blocks(batch.column(1), table):
                bucket, doc = _features(block, hasher, rules.buckets)
                counts[0] += np.bincount(bucket, minlength=rules.buckets)
                counts[1] += np.bincount(bucket[target[block.row0 + doc]], minlength=rules.buckets)
        at = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[0][at]), pa.array(counts[1][at])], ["bucket", "raw", "target"])

    total = np.zeros((2, rules.buckets))
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "bucket bigint, raw bigint, target bigint")
    for r in rows.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toLocalIterator():
        total[:, r.bucket] = r.raw, r.target
    if not total[1].sum():
        return np.zeros(rules.buckets)
    p = total + rules.smoothing
    p /= p.sum(axis=1, keepdims=True)
    return np.log(p[1]) - np.log(p[0])


def weigh(docs: DataFrame, ratios: np.ndarray, rules: ResampleRules = ResampleRules()) -> DataFrame:
    """(doc_id, n_ngrams, log_weight, sample_key) for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, table, ratios = tb.Hasher(lower=False), tb.whitespace_words(), shared.value
        for batch in batches:
            for block in tb.blocks(batch.column(1), table):
                bucket, doc = _features(block, hasher, rules.buckets)
                weight = np.bincount(doc, ratios[bucket], block.n_docs)
                ids = batch.column(0).slice(block.row0, block.n_docs)
                drawn = tb.keyed64(ids.fill_null(-1).to_numpy(zero_copy_only=False), rules.seed)
                uniform = ((drawn >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53
                noise = -np.log(-np.log(uniform))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.bincount(doc, minlength=block.n_docs).astype(np.int64)), pa.array(weight), pa.array(weight + noise)], ["doc_id", "n_ngrams", "log_weight", "sample_key"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, n_ngrams bigint, log_weight double, sample_key double")


def largest_cut(keys: DataFrame, column: str, k: int, bins: int = 4096) -> float | None:
    """The k-th largest value of a column, exactly; None if k < 1 or there are fewer rows."""
    low, high, rows = keys.agg(F.min(column), F.max(column), F.count(column)).first()
    if k < 1 or rows < k:
        return None
    above = 0  # rows known to be larger than high
    while True:
        inside = keys.filter(F.col(column).between(low, high))
        width = (high - low) / bins
        if width <= 0 or low + width == low:
            return high
        at = F.least(F.floor((F.col(column) - low) / F.lit(width)), F.lit(bins - 1)).alias("bin")
        counted = {r["bin"]: r for r in inside.groupBy(at).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()}
        for b in sorted(counted, reverse=True):
            if above + counted[b]["n"] >= k:
                break
            above += counted[b]["n"]
        low, high = counted[b]["lo"], counted[b]["hi"]
        if counted[b]["n"] <= bins:
            values = sorted((r[0] for r in inside.filter(F.col(column).between(low, high)).select(column).collect()), reverse=True)
            return values[k - above - 1]


def resample(docs: DataFrame, labels: DataFrame, rules: ResampleRules = ResampleRules()) -> DataFrame:
    """(doc_id, n_ngrams, log_weight, sample_key, kept): kept marks the sampled share."""
    keys = stored(weigh(docs, fit(docs, labels, rules), rules), "weights")
    cut = largest_cut(keys, "sample_key", int(rules.share * keys.count()), rules.bins)
    kept = F.lit(False) if cut is None else F.col("sample_key") >= F.lit(cut)
    return keys.withColumn("kept", kept)
