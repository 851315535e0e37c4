"""Documents drawn toward the benchmark's distribution, by suffix arrays of word ids.

A text's features are its runs of one to `longest` words; a feature's bucket is the CRC-32 of
its bytes, modulo the buckets.  A block of texts becomes a sequence of word ids, and its suffixes are
sorted (to the depth of the longest feature).  Neighbours in that order share their longest common
prefix, so all occurrences of a feature stand in one run of prefixes as long as it: each run
is hashed once, and its bucket goes back to its occurrences by the suffix array.  A run's hash comes
from those of its words (the CRC of joined texts follows from the parts' CRCs and lengths), so
no text is put together.

Two passes read the texts: one counts buckets (a row for each task and bucket it saw), the
other adds up the buckets' gains by document.  Gumbel noise keyed by doc_id turns weights into scores, and the
documents of the highest are drawn: the cut is found by refining a histogram, and ranks follow
from a range partitioning of what lies above it, so nothing is sorted in one task.

Edge cases: null and empty texts have no features and weight 0; texts of any length are taken in
pieces that overlap by the words of a feature; documents below `min_words` are scored, not drawn; equal scores go to
the smaller doc_id (null last; its noise is that of the empty name), rows that repeat a doc_id
and a text stand next to each other; without documents or target texts all gains follow from zero
counts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .importance import largest_cut
from .storage import stored

#: Words sorted at once; their ids and an end mark fit 21 bits.
PIECE = 1 << 20
_BITS = 21
_DIRECT = 64


@dataclass(frozen=True)
class TargetRules:
    """longest: words of a feature (3 at most); share_percent: of the documents with min_words words, to draw."""

    longest: int = 3
    buckets: int = 10_000
    min_words: int = 20
    share_percent: int = 5
    seed: int = 42


class Crc:
    """CRC-32 of joined byte strings from those of the parts."""

    def __init__(self):
        c = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
        # a register's change over n zero bytes is linear: tables of it for each of the register's bytes
        same = np.arange(256, dtype=np.uint32)[None, :] << (np.uint32(8) * np.arange(4, dtype=np.uint32)[:, None])
        direct = [same]
        for _ in range(_DIRECT):
            last = direct[-1]
            direct.append((last >> np.uint32(8)) ^ c[last & np.uint32(255)])
        self.direct = np.stack(direct)
        self.doubled = [direct[_DIRECT]]

    @staticmethod
    def _move(table: np.ndarray, x: np.ndarray) -> np.ndarray:
        return table[0][x & np.uint32(255)] ^ table[1][(x >> np.uint32(8)) & np.uint32(255)] ^ table[2][(x >> np.uint32(16)) & np.uint32(255)] ^ table[3][x >> np.uint32(24)]

    def joined(self, left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
        """CRC of left's text followed by right's, which is `length` bytes long."""
        flat, low = self.direct.reshape(-1), (length % _DIRECT) * 1024
        x = flat[low + (left & np.uint32(255))]
        for k in range(1, 4):
            x = x ^ flat[low + 256 * k + ((left >> np.uint32(8 * k)) & np.uint32(255))]
        rest, k = length // _DIRECT, 0
        while rest.any():
            if k == len(self.doubled):
                self.doubled.append(self._move(self.doubled[-1], self.doubled[-1]))
            odd = rest % 2 == 1
            x[odd] = self._move(self.doubled[k], x[odd])
            rest, k = rest // 2, k + 1
        return x ^ right


def suffix_runs(ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): ids (a word's number from 1, 0 past a text's end; a row for each of the next `depth` words of
    a place) sorted, and how many leading words each shares with the one before it in that order."""
    key = np.zeros(ids.shape[1], np.uint64)
    for row in ids:
        key = key << np.uint64(_BITS) | row.astype(np.uint64)
    order = np.argsort(key)
    key = key[order]
    common = np.zeros(len(key), np.int8)
    for n in range(1, depth + 1):
        prefix = key >> np.uint64(_BITS * (depth - n))
        common[1:] += prefix[1:] == prefix[:-1]
    return order, common


class Features:
    """Buckets of the runs of words of blocks of texts."""

    def __init__(self, rules: TargetRules):
        self.rules, self.crc = rules, Crc()
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[0x41:0x5B] = self.lower[0x61:0x7B]

    def runs(self, block: tb.Block) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(first word, words, order, starts, buckets) for each piece of a block and each length of features: runs of equal
        features begin at `starts` of the suffixes in `order`; their bucket, or -1 where the text ends before."""
        doc = block.doc_of_word()
        depth = self.rules.longest
        for low in range(0, block.n_words, PIECE):
            stop = min(low + PIECE, block.n_words)
            wide = min(stop + depth - 1, block.n_words)
            begin, length = block.starts[low:wide], block.ends[low:wide] - block.starts[low:wide]
            to = np.concatenate([[0], np.cumsum(length)])
            at = np.arange(to[-1]) + np.repeat(begin - to[:-1], length)
            data = self.lower[block.data[at]]
            column = pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(to.astype(np.int64)), pa.py_buffer(data)])
            coded = column.dictionary_encode()
            words = coded.dictionary.to_pylist()
            alone = np.array([0, *map(zlib.crc32, words)], np.uint32)
            spaced = np.array([0, *(zlib.crc32(b" " + w) for w in words)], np.uint32)
            size = np.array([0, *(len(w) + 1 for w in words)], np.int64)
            number = coded.indices.to_numpy().astype(np.int64) + 1
            ids = np.zeros((depth, stop - low), np.int64)
            for j in range(depth):
                n = max(min(stop, block.n_words - j) - low, 0)
                ids[j, :n] = np.where(doc[low + j : low + j + n] == doc[low : low + n], number[j : j + n], 0)
            order, common = suffix_runs(ids, depth)
            crc = None
            for n in range(1, depth + 1):
                starts = np.flatnonzero(common < n)
                word = ids[n - 1, order[starts]]
                if crc is None:
                    crc = alone[word]
                else:
                    shorter = crc[np.searchsorted(before, starts, "right") - 1]
                    crc = self.crc.joined(shorter, spaced[word], size[word])
                before = starts
                yield low, stop - low, order, starts, np.where(word > 0, crc.astype(np.int64) % self.rules.buckets, -1)

    def count(self, block: tb.Block, counts: np.ndarray) -> None:
        for _, words, _, starts, bucket in self.runs(block):
            times = np.diff(np.append(starts, words))
            real = bucket >= 0
            np.add.at(counts, bucket[real], times[real])

    def weights(self, block: tb.Block, gains: np.ndarray) -> np.ndarray:
        """Sum of the gains of all features of each text."""
        held = np.zeros(block.n_words, np.int64)
        padded = np.append(gains, 0)  # at -1: no feature
        for low, words, order, starts, bucket in self.runs(block):
            held[low + order] += np.repeat(padded[bucket], np.diff(np.append(starts, words)))
        return tb.per_doc_sum(held, block.first)


def bucket_counts(texts: DataFrame, rules: TargetRules = TargetRules()) -> np.ndarray:
    """Occurrences of features in each bucket over all texts; as many numbers as buckets come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, counts = Features(rules), np.zeros(rules.buckets, np.int64)
        for batch in batches:
            for block in tb.blocks(batch.column(0), tb.alnum_words()):
                features.count(block, counts)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at])], ["bucket", "n"])

    out = np.zeros(rules.buckets, np.int64)
    for r in texts.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log ratio of the smoothed shares of each bucket, floored."""
    n = len(raw)
    up = (target + 1.0) * (float(raw.sum()) + n)
    down = (raw + 1.0) * (float(target.sum()) + n)
    return np.floor(1000 * np.log(up / down)).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, rules: TargetRules = TargetRules()) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(rules)
        for batch in batches:
            for block in tb.blocks(batch.column(1), tb.alnum_words()):
                words = np.diff(block.first).astype(np.int64)
                found = sum(np.maximum(words - n, 0) for n in range(rules.longest))
                weight = features.weights(block, shared.value)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.row0, block.n_docs), pa.array(words), pa.array(found), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")
    name = F.concat(F.lit(f"{rules.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    drawn = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((drawn + 0.5) / 4294967296.0)))
    return out.withColumn("score", F.col("weight") + noise)


def ranked(rows: DataFrame, k: int, by: str, tie: str, name: str) -> DataFrame:
    """The k rows of largest `by` (smaller `tie` first among equals) with their place from 1 in column `name`.

    Rows are dealt by ranges of the order and numbered in their range; a range's first number is the sum of the sizes
    of those before it, of which there are as many as partitions."""
    order = [F.desc(by), F.asc_nulls_last(tie)]
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id())
    kept = stored(sorted_, "ranked")  # ranges are drawn by sampling, so they are fixed before they are counted
    part = F.shiftright(name, 33)
    sizes = kept.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    first, at = [], 0
    for p, n in sorted((r.part, r.n) for r in sizes.collect()):
        first.append((p, at))
        at += n
    base = rows.sparkSession.createDataFrame(first, "part long, base long")
    place = F.col("base") + F.col(name).bitwiseAND((1 << 33) - 1) + 1
    out = kept.join(F.broadcast(base), part == F.col("part")).withColumn(name, place)
    return out.drop("part", "base").filter(F.col(name) <= k)


def resample(docs: DataFrame, target: DataFrame, rules: TargetRules = TargetRules()) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank): every row of docs; rank of the drawn ones, else null."""
    gain = gains(bucket_counts(docs, rules), bucket_counts(target, rules))
    rows = stored(weigh(docs, gain, rules), "scores")
    fit = rows.filter(F.col("n_words") >= rules.min_words)
    k = fit.count() * rules.share_percent // 100
    cut = largest_cut(fit, "score", k)
    if cut is None:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    above = (F.col("n_words") >= rules.min_words) & (F.col("score") >= F.lit(int(cut)))
    top = ranked(rows.filter(above), 1 << 62, "score", "doc_id", "rank")
    top = top.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    return rows.filter(~above).withColumn("rank", F.lit(None).cast("long")).unionByName(top)
