"""Repeated passages: exact k-word windows counted by super-k-mer partitioning.

A window's minimiser is the least of its m-word hashes.  Consecutive windows that
share it travel as one packed string to the minimiser's bucket; equal windows have equal
minimisers, so a bucket sees every occurrence of its windows.  Senders pack by part, and the receiving task cuts
its part into buckets, so that payloads do not shrink as buckets become more.  In a bucket the windows are
sorted by hash, document and start; equal hashes are confirmed word by word; each
occurrence after the first is a repeat.

Skew: a block of documents sends each distinct window once (its later occurrences are
repeats already), so copies and passages shrink before the shuffle.  m-word sequences
that hold more than one in `hot_share` of all words (fewer than hot_share by count, so
their list is bounded) rank after all others; windows that merely overlap a common
passage thus go to buckets of their own surroundings.  A bucket that outgrows
`bucket_bytes` is folded as it streams: repeats are given out, distinct windows stay.

Edge cases: null and empty texts have no words (their kept text is empty); texts of
fewer than k words lose nothing; rows of equal doc_id are one document's and do not repeat each other at
equal starts; a null doc_id counts as the smallest; an empty table stays empty; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blobs
from . import textblocks as tb
from .storage import input_bytes, partitions_for

_U = np.uint64
_TOP = _U(1) << _U(63)
NULL_ID = -(2**63)


@dataclass(frozen=True)
class RepeatRules:
    k: int = 20
    m: int = 5
    hot_share: int = 100_000
    bucket_bytes: int = 6 << 20
    part_bytes: int = 32 << 20


def hot_minimisers(docs: DataFrame, rules: RepeatRules) -> np.ndarray:
    """Sorted hashes of the m-word sequences with more than 1 / hot_share of all words, counted over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, table = tb.Hasher(), tb.whitespace_words()
        for batch in batches:
            for block in tb.blocks(batch.column(0), table):
                grams, _ = block.ngrams(hasher.spans(block.data, block.starts, block.ends), rules.m)
                grams.sort()
                cut = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
                n = np.diff(np.append(cut, len(grams)))
                often = n > 2
                h = np.append(grams[cut[often]].view(np.int64), 0)  # 0: all words
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.append(n[often], block.n_words))], ["h", "n"])

    counts = docs.select("text").mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    total = counts.filter("h = 0").agg(F.sum("n")).first()[0] or 0
    least = max(1000, total // rules.hot_share)
    found = [r.h for r in counts.filter((F.col("n") > least) & (F.col("h") != 0)).select("h").collect()] if total > 1000 else []
    return np.sort(np.array(found, np.int64).view(np.uint64))


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """min(x[i : i + n]) for each i that has n items."""
    width = 1
    while width * 2 <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (n - width)], x[n - width :]) if n > width else x


def _repeats(words: np.ndarray, at: np.ndarray, grams: np.ndarray, doc: np.ndarray, start: np.ndarray, k: int) -> np.ndarray:
    """Mask of the windows (at, with hash, document and start) that also start earlier."""
    out = np.zeros(len(at), bool)
    if len(at) < 2:
        return out
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    order = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
    if not len(order):
        return out
    order = order[np.lexsort((start[order], doc[order], grams[order]))]
    key = grams[order].copy()
    rows = at[order][:, None] + np.arange(k)
    content = words[rows]
    begins = np.concatenate([[True], key[1:] != key[:-1]])
    if (content[1:] != content[:-1]).any(1)[~begins[1:]].any():  # unequal windows of one hash: tell them apart by content
        _, key = np.unique(content, axis=0, return_inverse=True)
        again = np.lexsort((start[order], doc[order], key))
        order, key = order[again], key[again]
        begins = np.concatenate([[True], key[1:] != key[:-1]])
    head = np.flatnonzero(begins)[np.cumsum(begins) - 1]
    out[order] = (doc[order] != doc[order[head]]) | (start[order] != start[order[head]])
    return out


def _spans(doc: np.ndarray, start: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, end) of runs of consecutive windows."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)])) if len(doc) else np.zeros(0, np.int64)
    last = np.append(cut[1:], len(doc)) - 1
    return doc[cut], start[cut].astype(np.int32), (start[last[: len(cut)]] + k).astype(np.int32)


def _runs(block: tb.Block, at: np.ndarray, group: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, first byte, byte count) of maximal runs of adjacent windows of a group."""
    cut = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (group[1:] != group[:-1])]))
    last = np.append(cut[1:], len(at)) - 1
    begin = block.starts[at[cut]]
    return cut, begin, block.ends[at[last] + k - 1] - begin


def _send(docs: DataFrame, n_parts: int, hot: np.ndarray, rules: RepeatRules) -> DataFrame:
    """Super-k-mers by part, with 16 more bits of the minimiser's hash; in part -1 - b, spans that a block already knows."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, table, hot, k = tb.Hasher(), tb.whitespace_words(), shared.value, rules.k
        bins = blobs.Bins(48 << 20, level=6)
        for batch in batches:
            ids = batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            for block in tb.blocks(batch.column(1), table):
                words = hasher.spans(block.data, block.starts, block.ends)
                grams, at = block.ngrams(words, k)
                if not len(at):
                    continue
                place = block.doc_of_word()[at]
                doc, start = ids[block.row0 + place], at - block.first[place]
                small = tb.ngram_hash(words, np.arange(block.n_words - rules.m + 1), rules.m)
                if len(hot):
                    near = np.minimum(np.searchsorted(hot, small), len(hot) - 1)
                    small = np.where(hot[near] == small, small | _TOP, small & ~_TOP)
                least = _sliding_min(small, k - rules.m + 1)[at]
                again = _repeats(words, at, grams, doc, start, k)
                if again.any():
                    d, a, b = _spans(doc[again], start[again], k)
                    yield blobs.rows([(-1 - int(d[0] % n_parts), blobs.pack(d, a, b))])
                first = np.flatnonzero(~again)
                if not len(first):
                    continue
                cut, begin, size = _runs(block, at[first], least[first] ^ place[first].astype(np.uint64), k)
                drawn = tb.mix64(least[first[cut]])
                bucket, more = (drawn % _U(n_parts)).astype(np.int32), (drawn >> _U(48)).astype(np.uint16)
                order = np.lexsort((more, bucket))
                chosen, size = first[cut][order], size[order]
                bins.add(bucket[order], (block.data[blobs.gather(begin[order], size)], size), (size.astype(np.int32), None), (doc[chosen], None), (start[chosen].astype(np.int32), None), (more[order], None))
                if bins.full():
                    yield from bins.out()
        yield from bins.out()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, blobs.PACKED)


class _Bucket:
    """The super-k-mers of a bucket that have come so far."""

    def __init__(self, rules: RepeatRules):
        self.rules, self.hasher, self.table = rules, tb.Hasher(), tb.whitespace_words()
        self.parts, self.size = [], 0

    def add(self, part: list[np.ndarray]) -> None:
        self.parts.append(part)
        self.size += part[0].nbytes

    def fold(self, keep: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Spans of the repeats; with keep, the distinct windows stay for what is to come."""
        data, size, doc, start = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        block, k = tb.Block(data, np.concatenate([[0], np.cumsum(size, dtype=np.int64)]), 0, self.table), self.rules.k
        words = self.hasher.spans(block.data, block.starts, block.ends)
        grams, at = block.ngrams(words, k)
        owner = block.doc_of_word()[at]
        doc, start = doc[owner], start[owner] + (at - block.first[owner])
        again = _repeats(words, at, grams, doc, start, k)
        self.parts, self.size = [], 0
        first = np.flatnonzero(~again)
        if keep and len(first):
            cut, begin, length = _runs(block, at[first], owner[first], k)
            self.add([data[blobs.gather(begin, length)], length.astype(np.int32), doc[first[cut]], start[first[cut]].astype(np.int32)])
        return _spans(doc[again], start[again], k)


def repeated_spans(docs: DataFrame, rules: RepeatRules = RepeatRules()) -> DataFrame:
    """(doc_id, first, stop): word ranges of docs(doc_id, text) covered by windows that also start
    earlier; ranges of one document may touch or overlap."""
    hot = hot_minimisers(docs, rules)
    partitions = blobs.parts_for(input_bytes(docs), partitions_for(docs, 1 << 60), rules.part_bytes)
    sent = _send(docs, partitions, hot, rules)
    n_subs = int(min(1 << 16, max(8, 5 * input_bytes(docs) // partitions // rules.bucket_bytes)))

    def split(arrays: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
        data, size, doc, start, more = arrays
        sub = more.astype(np.int64) * n_subs >> 16
        order = np.argsort(sub, kind="stable")
        begin = np.cumsum(size, dtype=np.int64) - size
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(sub[order]) > 0]))
        for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
            at = order[a:b]
            yield int(sub[at[0]]), [data[blobs.gather(begin[at], size[at].astype(np.int64))], size[at], doc[at], start[at]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given(d, a, b):
            return pa.RecordBatch.from_arrays([pa.array(d), pa.array(a), pa.array(b)], ["doc_id", "first", "stop"])

        held, now = _Bucket(rules), None
        for bucket, payload in blobs.sub_stream(batches):
            part = blobs.unpack(payload)
            if bucket[0] < 0:
                yield given(*part)
                continue
            if bucket != now and held.parts:
                yield given(*held.fold(False))
            now = bucket
            held.add(part)
            if held.size > 2 * rules.bucket_bytes:
                yield given(*held.fold(True))
        if held.parts:
            yield given(*held.fold(False))

    return blobs.by_sub_bucket(sent, partitions, split).mapInArrow(run, "doc_id bigint, first int, stop int")


REMOVED = "doc_id bigint, n_words bigint, n_removed bigint, kept string"


def _with_spans(docs: DataFrame, rules: RepeatRules) -> DataFrame:
    spans = repeated_spans(docs, rules).groupBy("doc_id").agg(F.collect_list("first").alias("first"), F.collect_list("stop").alias("stop"))
    left = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("key", F.coalesce("doc_id", F.lit(NULL_ID)))
    return left.join(spans.withColumnRenamed("doc_id", "key"), "key", "left").select("doc_id", "text", "first", "stop")


def remove_repeats(docs: DataFrame, rules: RepeatRules = RepeatRules(), digest: bool = False) -> DataFrame:
    """(REMOVED) for each row of docs: kept is the text of the kept words joined by one
    space or, with digest, the lowercase hex SHA-256 of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = tb.whitespace_words()
        for batch in batches:
            for block in tb.blocks(batch.column(1), table):
                lists = [batch.column(i).slice(block.row0, block.n_docs) for i in (2, 3)]
                counts = lists[0].value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                first, stop = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in lists)
                shift = np.repeat(block.first[:-1], counts)
                gone = tb.covered(first + shift, stop - first, block.n_words)
                stay = np.flatnonzero(~gone)
                size = (block.ends - block.starts)[stay]
                text = np.full(int(size.sum()) + len(stay), 0x20, np.uint8)
                text[blobs.gather(np.cumsum(size + 1) - size - 1, size)] = block.data[blobs.gather(block.starts[stay], size)]
                n_removed = tb.per_doc_sum(gone, block.first)
                ends = np.concatenate([[0], np.cumsum(size + 1)])[np.searchsorted(stay, block.first)]
                kept = [text[a : max(a, b - 1)].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                kept = [hashlib.sha256(x).hexdigest() for x in kept] if digest else [x.decode() for x in kept]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.row0, block.n_docs), pa.array(np.diff(block.first)), pa.array(n_removed), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return _with_spans(docs, rules).mapInArrow(run, REMOVED)
