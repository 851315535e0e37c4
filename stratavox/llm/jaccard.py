"""Exact n-gram Jaccard join of documents as a metric-space join.

Documents are sets of word shingles; two link when 100 |x & y| >= similarity |x | y|.
Equal sets form one class first, so copies are one row from there on.  The symmetric
difference |x - y| + |y - x| is a metric, a link bounds it by rho(x) + rho(y) with
rho(x) = |x| (100 - similarity) / (100 + similarity), and the Hamming distance of parity
sketches of the sets never exceeds it, so pivots work on the small sketches:

1. Neighbourhoods.  A link implies a shared shingle among the first |x| - o(x) + 1 of
   each set in one global order (o(x): the least overlap a partner can have).  The order
   puts frequent shingles last (a bounded list, counted over all documents) and those of frequent
   words later, so unlike documents seldom meet.  The classes of a shingle form neighbourhoods under
   their first class; set sizes (the distance to the empty set) split them by the
   triangle inequality where no link can cross.  In a neighbourhood, sketches of one
   length make a region; those of the next length that can link to them join it, folded, so
   that all distances of a region are taken in one metric.
2. Voronoi regions.  A region beyond what a task holds takes new pivots (far apart, from a
   sample); each class goes to the cell of its nearest pivot and is replicated to each
   pivot q with h(q, x) <= rho(x) + max over the cell's y of h(q, y) + rho(y): by the
   triangle inequality no link of a cell member leaves the cell's region.  Regions split
   again, every level a distributed pass, until they fit a task, which cuts them in the
   same way down to single pivots; those regions of pivots that share classes go on as one, so
   that a set is sent once for each region, however alike its classes are.
3. Crowds.  Where windows do not shrink a region (its classes are all alike, or all equally
   far), those that a sketch puts within reach of the classes nearest to the centre are held
   against these in chunks, which connects most of a group of near copies; what is not connected
   by them becomes pivots against the whole crowd, sketches first, block by block.
4. Regions join exactly on the sets.  Classes linked to the pivot are connected by it;
   the others become pivots in turn, against those of other components that their
   distances to the first pivot leave possible, until none is left; a link is kept if it
   joins two components.  None that does is lost, and no list of all pairs is made.  Where several
   pivots ask, sets are rows of bits over the shingles that two of them or more hold.

Components follow from the links by alternating star contractions in stored rounds.

Shingles are compared by 64-bit hashes.  A class is named by 64 bits of its set; where a second
64-bit hash shows that sets share a name, all but one kind of them take another, so 128 bits tell classes
apart.  Edge cases: null and empty texts, and texts
without words, have empty sets and link with nothing; fewer words than a shingle make
one shingle of the whole sequence; repeated rows (of one doc_id too) link as equal sets;
a null doc_id takes part and counts as smallest for component_id; ties resolve by hash; an empty
table gives an empty result; other columns are ignored (`drop_near_duplicates` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blobs
from . import textblocks as tb
from .storage import columns, free_name, partitions_for, scratch, stored

_U = np.uint64
LEAST = 256  # bits of a parity sketch
NULL_ID = -(2**63)
PIECE = 1 << 19  # shingles compared at once
SLOTS = 1 << 20  # words are counted by so many values of their hash
HEAVIEST = 1023  # most that the words of a shingle weigh
SMALL = 64  # classes up to which every one of a region is a pivot
BIT_BYTES = 64 << 20  # of a region's sets as rows of bits


@dataclass(frozen=True)
class JaccardRules:
    """words: of a shingle; similarity: in percent; hot_list: bound of the list of frequent
    shingles; hot_least: documents from which one can count as frequent; broadcast_bytes:
    size up to which a table is broadcast; region, region_bytes: classes and
    bytes of their sets that a task cuts at once; fan: pivots of a larger region; hood_rows: prefix
    shingles of a bucket held at once; name_bits: of a class's first name."""

    words: int = 5
    similarity: int = 80
    hot_list: int = 1_000_000
    hot_least: int = 50
    broadcast_bytes: int = 16 << 20
    region: int = 1024
    region_bytes: int = 64 << 20
    fan: int = 16
    hood_rows: int = 1_500_000
    name_bits: int = 64

    def rho(self, n: np.ndarray) -> np.ndarray:
        return n * ((100 - self.similarity) / (100 + self.similarity)) + 1e-9

    def prefix(self, n: np.ndarray) -> np.ndarray:
        return n - -(-self.similarity * n // 100) + 1


def _order(doc: np.ndarray, grams: np.ndarray, n_docs: int) -> np.ndarray:
    """The order by document, then shingle: one sort of both in 64 bits, unless shingles of a document agree in the bits kept."""
    bits = max(1, n_docs.bit_length())
    order = np.argsort((doc.astype(np.uint64) << _U(64 - bits)) | (grams >> _U(bits)))
    d, g = doc[order], grams[order]
    if ((d[1:] == d[:-1]) & (g[1:] < g[:-1])).any():
        order = np.lexsort((grams, doc))
    return order


def weighed_sets(block: tb.Block, words: np.ndarray, k: int, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, document, weight of its words), sorted by document, then shingle, each once; weight: of each word."""
    grams, at = block.ngrams(words, k)
    doc = block.doc_of_word()[at]
    n = np.diff(block.first)
    total = np.concatenate([[0], np.cumsum(weight, dtype=np.int64)])
    heavy = total[at + k] - total[at]
    for size in range(1, k):
        short = np.flatnonzero(n == size)
        grams = np.concatenate([grams, tb.ngram_hash(words, block.first[short], size) ^ _U(size)])
        doc = np.concatenate([doc, short])
        heavy = np.concatenate([heavy, np.zeros(len(short), np.int64)])
    order = _order(doc, grams, block.n_docs)
    grams, doc, heavy = grams[order], doc[order], heavy[order]
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    return grams[fresh], doc[fresh], heavy[fresh]


def shingle_sets(block: tb.Block, words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, document), sorted by document, then shingle, each once."""
    return weighed_sets(block, words, k, np.zeros(block.n_words, np.uint8))[:2]


def _bounds(doc: np.ndarray, n_docs: int) -> np.ndarray:
    return np.searchsorted(doc, np.arange(n_docs + 1))


def class_of(grams: np.ndarray, bounds: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit names of each set (the first cut to `bits`); equal sets have equal names."""
    out = []
    for seed in (0x51ED270B, 0x2545F491):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tb.keyed64(grams, seed))])
        out.append(tb.mix64(total[bounds[1:]] - total[bounds[:-1]] + _U(seed) * (np.diff(bounds) + 1).astype(np.uint64)))
    return out[0] >> _U(64 - bits), out[1]


@dataclass(frozen=True)
class Names:
    """First names that several sets share, and the second name of those that keep it."""

    shared: np.ndarray
    keeper: np.ndarray

    def of(self, grams: np.ndarray, bounds: np.ndarray, rules: JaccardRules) -> np.ndarray:
        first, second = class_of(grams, bounds, rules.name_bits)
        if not len(self.shared):
            return first
        at = np.minimum(np.searchsorted(self.shared, first), len(self.shared) - 1)
        return np.where((self.shared[at] == first) & (self.keeper[at] != second), second, first)


def sketches(grams: np.ndarray, doc: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Parity sketches: bit b is the parity of the shingles that hash to b.

    A set of n has the power of two at or above n bits (LEAST at least), so unlike sets
    of any size stay apart; a sketch folds to half its bits by exclusive or."""
    bits = np.maximum(LEAST, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(bits)])
    at = begin[doc] + (tb.keyed64(grams, 77) & (bits[doc] - 1).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(at, minlength=begin[-1]) & 1).astype(np.uint8)
    packed = np.packbits(odd, bitorder="little").tobytes()
    return [packed[a // 8 : b // 8] for a, b in zip(begin[:-1], begin[1:], strict=True)]


# ---- passes over the texts -----------------------------------------------------------

CLASSES = "kind int, doc_id bigint, digest string, class bigint, second bigint, n bigint, sketch binary"


def _slot(words: np.ndarray) -> np.ndarray:
    return (words >> _U(65 - SLOTS.bit_length())).astype(np.int64)


def _classes(docs: DataFrame, rules: JaccardRules) -> DataFrame:
    """Kind 0: a row for each document; kind 1: documents (n) of shingles found often in a
    block (class), and the number of all shingles (class 0); kind 2: words (n) of the slots (class) that
    hold many of a task's, and the number of all words (class -1)."""
    names = [x.split()[0] for x in CLASSES.split(", ")]

    def counted(kind: int, what: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        k = len(what)
        return pa.RecordBatch.from_arrays([pa.array(np.full(k, kind, np.int32)), pa.nulls(k, pa.int64()), pa.nulls(k, pa.string()), pa.array(what), pa.nulls(k, pa.int64()), pa.array(n), pa.nulls(k, pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, table = tb.Hasher(lower=True), tb.whitespace_words()
        slots, held, size = np.zeros(SLOTS, np.int64), [], 0
        for batch in batches:
            for block in tb.blocks(batch.column(2), table, tb.BLOCK_BYTES // 2):
                words = hasher.spans(block.data, block.starts, block.ends)
                held.append(_slot(words))
                size += len(words)
                if size > 2 * SLOTS:
                    slots += np.bincount(np.concatenate(held), minlength=SLOTS)
                    held, size = [], 0
                grams, doc = shingle_sets(block, words, rules.words)
                bounds = _bounds(doc, block.n_docs)
                cls, second = (x.view(np.int64) for x in class_of(grams, bounds, rules.name_bits))
                n = np.diff(bounds)
                packed = sketches(grams, doc, n)
                own = [batch.column(i).slice(block.row0, block.n_docs) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(block.n_docs, np.int32)), *own, pa.array(cls), pa.array(second), pa.array(n), pa.array(packed, pa.binary())], names)
                # copies within the block count once
                _, one = np.unique(second, return_index=True)
                once = np.zeros(block.n_docs, bool)
                once[one] = True
                kinds = np.sort(grams[once[doc]])
                cut = np.flatnonzero(np.concatenate([[True], kinds[1:] != kinds[:-1]])) if len(kinds) else np.zeros(0, np.int64)
                count = np.diff(np.append(cut, len(kinds)))
                often = count > 2
                yield counted(1, np.append(kinds[cut[often]].view(np.int64), 0), np.append(count[often], len(kinds)))
        slots += np.bincount(np.concatenate([np.zeros(0, np.int64), *held]), minlength=SLOTS)
        often = np.flatnonzero(slots > max(3, int(slots.sum()) // (SLOTS // 2)))
        yield counted(2, np.append(often, -1), np.append(slots[often], slots.sum()))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("digest"), "text").mapInArrow(tb.released(run), CLASSES)


def _names(rows: DataFrame) -> Names:
    """The shared first names: about (documents)^2 / 2^65 of them, so the list is small at any size."""
    found = rows.groupBy("class").agg(F.min("second").alias("keeper"), F.max("second").alias("other")).filter("keeper <> other").select("class", "keeper").toArrow()
    shared, keeper = (found.column(i).to_numpy().astype(np.int64).view(np.uint64) for i in (0, 1))
    order = np.argsort(shared)
    return Names(shared[order], keeper[order])


def _named(rows: DataFrame, names: Names) -> DataFrame:
    """rows with class as told apart by names."""
    if not len(names.shared):
        return rows
    known = rows.sparkSession.createDataFrame(list(zip(names.shared.view(np.int64).tolist(), names.keeper.view(np.int64).tolist(), strict=True)), "class long, keeper long")
    out = rows.join(F.broadcast(known), "class", "left")
    return out.withColumn("class", F.when(F.col("keeper") != F.col("second"), F.col("second")).otherwise(F.col("class"))).drop("keeper")


def _frequent(counts: DataFrame, rules: JaccardRules) -> np.ndarray:
    """Sorted shingles in more than 1 / hot_list of all (document, shingle)s: fewer than hot_list."""
    counts = counts.groupBy("class").agg(F.sum("n").alias("n"))
    total = counts.filter("class = 0").agg(F.sum("n")).first()[0] or 0
    found = counts.filter((F.col("class") != 0) & (F.col("n") > max(rules.hot_least, total // rules.hot_list))).select("class").toArrow()
    return np.sort(found.column(0).to_numpy().astype(np.int64).view(np.uint64))


def _weights(counts: DataFrame) -> np.ndarray:
    """The weight of each slot's words: it grows with the logarithm of their number, and is 0 where no task found many."""
    found = counts.groupBy("class").agg(F.sum("n").alias("n")).toArrow()  # SLOTS of them at most
    slot, n = (found.column(i).to_numpy().astype(np.int64) for i in (0, 1))
    out, total = np.zeros(SLOTS, np.uint8), int(n[slot < 0].sum())
    if total:
        out[slot[slot >= 0]] = np.rint(8 * np.log2(1 + n[slot >= 0] * (SLOTS / total)))
    return out


def _keys(docs: DataFrame, hot: np.ndarray, weights: np.ndarray, names: Names, n_buckets: int, rules: JaccardRules) -> DataFrame:
    """Each class under the shingles of its prefix, packed by bucket of the shingle.  The order of shingles, the same
    for all: frequent ones (hot) last, those of heavy words later, then by hash."""
    shared = docs.sparkSession.sparkContext.broadcast((hot, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, table = tb.Hasher(lower=True), tb.whitespace_words()
        hot, weights = shared.value
        bins = blobs.Bins(16 << 20)
        for batch in batches:
            for block in tb.blocks(batch.column(0), table, tb.BLOCK_BYTES // 2):
                words = hasher.spans(block.data, block.starts, block.ends)
                grams, doc, late = weighed_sets(block, words, rules.words, weights[_slot(words)])
                bounds = _bounds(doc, block.n_docs)
                cls, n = names.of(grams, bounds, rules), np.diff(bounds)
                late = np.minimum(late, HEAVIEST)
                if len(hot) and len(grams):
                    late += (HEAVIEST + 1) * (hot[np.minimum(np.searchsorted(hot, grams), len(hot) - 1)] == grams)
                late += 2 * (HEAVIEST + 1) * doc
                if block.n_docs < 1 << 20 and len(grams) < 1 << 32:  # a stable sort by values
                    order = (np.sort(late.astype(np.uint64) << _U(32) | np.arange(len(grams), dtype=np.uint64)) & _U(2**32 - 1)).astype(np.int64)
                else:
                    order = np.argsort(late, kind="stable")
                place = np.arange(len(grams)) - bounds[doc]
                _, one = np.unique(cls, return_index=True)
                once = np.zeros(block.n_docs, bool)
                once[one] = True
                take = order[(place < rules.prefix(n)[doc]) & once[doc]]
                bucket = (tb.mix64(grams[take]) % _U(n_buckets)).astype(np.int32)
                by = np.argsort(bucket, kind="stable")
                take = take[by]
                bins.add(bucket[by], (grams[take] >> _U(16), None), (cls[doc[take]], None), (n[doc[take]].astype(np.int32), None))
                if bins.full():
                    yield from bins.out()
        yield from bins.out()

    return docs.select("text").mapInArrow(run, blobs.PACKED)


def _neighbourhoods(keys: DataFrame, partitions: int, rules: JaccardRules) -> DataFrame:
    """(centre, class): the classes of each shingle under one of them, cut by set size."""

    def members(parts: list[list[np.ndarray]], pivots: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
        key, cls, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((cls, n, key))
        key, cls, n = key[order], cls[order], n[order].astype(np.int64)
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])])
        key, cls, n = key[fresh], cls[fresh], n[fresh]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        if pivots is None:
            new[1:] |= 100 * n[:-1] < rules.similarity * n[1:]
        group = np.cumsum(new) - 1
        heads = np.flatnonzero(new)
        centre = np.minimum.reduceat(cls, heads)
        if pivots is not None and len(pivots[0]):  # a centre once chosen stays
            at = np.minimum(np.searchsorted(pivots[0], key[heads]), len(pivots[0]) - 1)
            centre = np.where(pivots[0][at] == key[heads], pivots[1][at], centre)
        out = centre[group]
        other = out != cls
        return out[other], cls[other], (key[heads], centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given(centre: np.ndarray, cls: np.ndarray) -> pa.RecordBatch:
            found = np.unique(np.stack([centre.view(np.int64), cls.view(np.int64)], 1), axis=0) if len(cls) else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["centre", "class"])

        parts, size, now, pivots = [], 0, None, None

        def close() -> pa.RecordBatch:
            centre, cls, _ = members(parts, pivots)
            return given(centre, cls)

        for bucket, payload in blobs.stream(batches):
            if bucket != now and parts:
                yield close()
                parts, size, pivots = [], 0, None
            now = bucket
            parts.append(blobs.unpack(payload))
            size += len(parts[-1][0])
            if size > rules.hood_rows:  # an outsized bucket streams: each shingle keeps its centre only
                centre, cls, seen = members(parts, pivots if pivots is not None else (np.zeros(0, np.uint64), np.zeros(0, np.uint64)))
                yield given(centre, cls)
                if pivots is not None:
                    k, c = np.concatenate([pivots[0], seen[0]]), np.concatenate([pivots[1], seen[1]])
                    k, i = np.unique(k, return_index=True)
                    seen = (k, c[i])
                parts, size, pivots = [], 0, seen
        if parts:
            yield close()

    return blobs.by_bucket(keys, partitions).mapInArrow(run, "centre bigint, class bigint").distinct()


# ---- regions -------------------------------------------------------------------------


def folded(found: list[bytes], size: int | None = None) -> np.ndarray:
    """Sketches as rows of words, longer ones folded by exclusive or to `size` bytes (the least length)."""
    level = np.array([len(x) for x in found])
    size = int(level.min()) if size is None else size
    out = np.zeros((len(found), size // 8), np.uint64)
    for long in np.unique(level):
        at = np.flatnonzero(level == long)
        rows = np.frombuffer(b"".join(found[i] for i in at), np.uint64).reshape(len(at), -1, size // 8)
        out[at] = np.bitwise_xor.reduce(rows, axis=1)
    return out


def hamming(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.bitwise_count(rows ^ q).sum(1).astype(np.int64)


def voronoi_regions(n: np.ndarray, rows: np.ndarray, rules: JaccardRules, asking: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(pivot, the other classes of its region) of classes with sizes n and sketches of one length.

    Pivots are taken until each class is within linking reach of one; cells are of the nearest pivot.
    With a mask `asking`, only its classes are pivots and in cells; regions reach over all."""
    rho = rules.rho(n)
    asking = np.ones(len(n), bool) if asking is None else asking
    open_ = asking.copy()
    pivots, near, cell = [], np.full(len(n), np.iinfo(np.int64).max), np.zeros(len(n), np.int64)
    held = []
    for q in range(len(n)):
        if not open_[q]:
            continue
        h = hamming(rows, rows[q])
        closer = h < near
        near[closer], cell[closer] = h[closer], len(pivots)
        open_ &= (h > rho + rho[q]) | (100 * np.minimum(n, n[q]) < rules.similarity * np.maximum(n, n[q]))
        open_[q] = False
        pivots.append(q)
        held.append(h.astype(np.int32))
    for k, q in enumerate(pivots):
        own = (cell == k) & asking
        if not own.any():
            continue
        h = held[k]
        region = h <= (h[own] + rho[own]).max() + rho
        region &= (100 * n >= rules.similarity * n[own].min()) & (rules.similarity * n <= 100 * n[own].max())
        region[q] = False
        if region.any():
            yield q, np.flatnonzero(region)


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each value of the first column, which they are sorted by."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        for a, b in zip(cuts, np.append(cuts[1:], len(key)), strict=True):
            if held and held[0].column(0)[0].as_py() != key[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


REGION = "region bigint, class bigint, n bigint, bits int, sketch binary"


def _first_regions(hoods: DataFrame, classes: DataFrame, rules: JaccardRules) -> DataFrame:
    """(REGION): the classes of a neighbourhood by length of sketch, with those of the next length that can link to them."""
    sketched = classes.groupBy("class").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    members = hoods.unionByName(hoods.select("centre", F.col("centre").alias("class")).distinct())
    bits = F.octet_length("sketch") * 8
    rows = members.join(sketched, "class").withColumn("own", bits)
    guest = (F.col("own") > LEAST) & (rules.similarity * F.col("n") <= 50 * F.col("own"))
    rows = rows.withColumn("bits", F.explode(F.when(guest, F.array("own", (F.col("own") / 2).cast("int"))).otherwise(F.array("own"))))
    return rows.select(F.xxhash64("centre", "bits").alias("region"), "class", "n", "bits", "sketch")


def _spread(table: pa.Table, fan: int) -> tuple[list[bytes], bytes]:
    """(pivots far apart, the bits that most of the sample have)."""
    rows = folded(table.column("sketch").to_pylist(), table.column("bits")[0].as_py() // 8)
    bit = np.unpackbits(rows.view(np.uint8), axis=1)
    heart = np.packbits(2 * bit.sum(0) > len(rows)).tobytes()
    chosen = [int(np.argmin(hamming(rows, np.frombuffer(heart, np.uint64))))]
    near = hamming(rows, rows[chosen[0]])
    while len(chosen) < min(fan, len(rows)) and near.max() > 0:
        chosen.append(int(np.argmax(near)))
        near = np.minimum(near, hamming(rows, rows[chosen[-1]]))
    return [rows[i].tobytes() for i in chosen], heart


def _small(df: DataFrame, limit: int = JaccardRules.broadcast_bytes) -> DataFrame:
    """df, to be broadcast if it is small in bytes."""
    held = F.lit(16 * len(df.columns))
    for name, kind in df.dtypes:
        if kind in ("binary", "string"):
            held = held + F.length(name)
        elif kind == "array<binary>":
            held = held + F.aggregate(name, F.lit(0), lambda n, x: n + 16 + F.length(x))
    size = df.agg(F.sum(held.cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= limit else df


def _split(large: DataFrame, level: int, rules: JaccardRules) -> tuple[DataFrame, DataFrame]:
    """(regions of the cells, crowds): large has REGION and size."""
    part = F.pmod(F.xxhash64("class", F.lit(level)), F.lit(1 << 30))

    def choose(table: pa.Table) -> pa.Table:
        pivots, heart = _spread(table, rules.fan)
        return pa.table({"region": pa.array([table.column("region")[0].as_py()], pa.int64()), "pivots": pa.array([pivots], pa.list_(pa.binary())), "heart": pa.array([heart], pa.binary())})

    sample = large.filter(part * F.col("size") < 64 << 30).select(*(x.split()[0] for x in REGION.split(", ")))
    pivots = stored(sample.groupBy("region").applyInArrow(choose, "region bigint, pivots array<binary>, heart binary"), "pivots")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["region", "class", "n", "bits", "sketch", "size", "cell", "h", "far"]
        for batch in batches:
            region = batch.column(0).to_numpy()
            cell, far, h = np.zeros(len(region), np.int32), np.zeros(len(region), np.int64), [None] * len(region)
            for key in np.unique(region):
                at = np.flatnonzero(region == key)
                some = batch.take(pa.array(at))
                found, heart = batch.column(6)[int(at[0])].as_py(), batch.column(7)[int(at[0])].as_py()
                rows = folded(some.column(4).to_pylist(), some.column(3)[0].as_py() // 8)
                to = np.stack([hamming(rows, np.frombuffer(q, np.uint64)) for q in found], 1)
                cell[at], far[at] = to.argmin(1), hamming(rows, np.frombuffer(heart, np.uint64))
                for i, x in zip(at, to.astype(np.int32), strict=True):
                    h[i] = x
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(cell), pa.array(h, pa.list_(pa.int32())), pa.array(far)], names)

    assigned = large.select("region", "class", "n", "bits", "sketch", "size").join(_small(pivots), "region").mapInArrow(assign, REGION + ", size bigint, cell int, h array<int>, far bigint")
    assigned = stored(assigned, "assigned")
    rho = F.col("n") * ((100 - rules.similarity) / (100 + rules.similarity)) + 1e-9
    reach = assigned.groupBy("region", "cell").agg(F.max(F.get("h", F.col("cell")) + rho).alias("reach"), F.min("n").alias("low"), F.max("n").alias("high"))
    reach = stored(reach.groupBy("region").agg(F.collect_list(F.struct("cell", "reach", "low", "high")).alias("cells")), "reach")  # fan cells at most
    within = F.filter("cells", lambda c: (F.get("h", c["cell"]) <= c["reach"] + rho + 1e-6) & (100 * F.col("n") >= rules.similarity * c["low"]) & (rules.similarity * F.col("n") <= 100 * c["high"]))
    children = assigned.join(_small(reach), "region").withColumn("c", F.explode(within)).select(
        F.xxhash64("region", F.col("c.cell"), F.lit(level)).alias("region"), "class", "n", "bits", "sketch", F.col("region").alias("above"), "size"
    )
    children = stored(children, "cells")
    grown = children.groupBy("above", "region", "size").agg(F.count("*").alias("k")).groupBy("above", "size").agg(F.max("k").alias("most"), F.sum("k").alias("all"))
    crowded = stored(grown.filter("4 * most > 3 * size OR all > 3 * size").select("above"), "crowded")
    kept = children.join(_small(crowded), "above", "left_anti").drop("above", "size")
    crowds = assigned.join(_small(crowded.withColumnRenamed("above", "region")), "region", "left_semi").select("region", "class", "n", "bits", "sketch", "far", "size")
    return kept, crowds


#: What a task does with a row of a key: the pivot and the others of a leaf; the pivots and the members
#: of a crowd's chunk; the queries and the others of a block against a chunk.
LEAF, LEAF_OTHER, PIVOT, MEMBER, QUERY, OTHER = range(6)


def _whole(batches: Iterator[pa.RecordBatch], rows: int = 1 << 13, size: int = 16 << 20) -> Iterator[pa.Table]:
    """Tables of whole regions (the first column, which the rows are sorted by), of about so many rows or bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(x.num_rows for x in held) >= rows or sum(x.nbytes for x in held) >= size:
            found = pa.Table.from_batches(held)
            key = found.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield found.slice(0, cut)
                held = found.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _connected(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least of those that each of n is connected with by the pairs (a, b)."""
    least = np.arange(n)
    while True:
        x, y = least[a], least[b]
        if (x == y).all():
            return least
        np.minimum.at(least, x, y)
        np.minimum.at(least, y, x)
        while (further := least[least]).tolist() != least.tolist():
            least = further


def close_pairs(region: np.ndarray, n: np.ndarray, rows: np.ndarray, rules: JaccardRules, asking: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that stand for the Voronoi regions of classes sorted by region: a pivot and each other class of its region.
    Where classes are few, every one is a pivot, so its cell is itself and its region what it can link to."""
    heads = np.flatnonzero(np.concatenate([[True], region[1:] != region[:-1]]))
    size = np.diff(np.append(heads, len(region)))
    of, stop = np.repeat(size, size), np.repeat(heads + size, size)
    at = np.flatnonzero(of <= SMALL)
    after = stop[at] - at - 1
    a, b = np.repeat(at, after), blobs.gather(at + 1, after)
    may = 100 * np.minimum(n[a], n[b]) >= rules.similarity * np.maximum(n[a], n[b])
    if asking is not None:
        may &= asking[a] | asking[b]
    a, b, rho = a[may], b[may], rules.rho(n)
    near, step = np.zeros(len(a), bool), max(1, (4 << 20) // (8 * rows.shape[1]))
    for i in range(0, len(a), step):
        x, y = a[i : i + step], b[i : i + step]
        near[i : i + step] = np.bitwise_count(rows[x] ^ rows[y]).sum(1, dtype=np.int64) <= rho[x] + rho[y]
    pairs = [(a[near], b[near])]
    for i in np.flatnonzero(size > SMALL):
        own = slice(heads[i], heads[i] + size[i])
        for q, others in voronoi_regions(n[own], rows[own], rules, None if asking is None else asking[own]):
            pairs.append((np.full(len(others), heads[i] + q), heads[i] + others))
    return tuple(np.concatenate(x) for x in zip(*pairs, strict=True))


def _leaves(rows: DataFrame, partitions: int, rules: JaccardRules) -> DataFrame:
    """(key, class, role): regions that fit a task, cut down to single pivots; pivots' regions that share a class are one
    leaf, so a class stands once in what a region gives.  Equal leaves of several regions go together; with a
    column `asking` they stay apart, and only what it marks asks for links."""
    marked = "asking" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole(batches):
            bits = t.column(3).to_numpy()
            for size in np.unique(bits):
                some = t.take(pa.array(np.flatnonzero(bits == size)))
                region, cls, n = (some.column(i).to_numpy() for i in range(3))
                asking = some.column(5).to_numpy().astype(bool) if marked else None
                a, b = close_pairs(region, n, folded(some.column(4).to_pylist(), int(size) // 8), rules, asking)
                if not len(a):
                    continue
                leaf = _connected(a, b, len(cls))
                member = np.flatnonzero(np.bincount(leaf, minlength=len(cls))[leaf] > 1)
                member = member[np.argsort(leaf[member], kind="stable")]
                heads = np.flatnonzero(np.concatenate([[True], leaf[member[1:]] != leaf[member[:-1]]]))
                count = np.diff(np.append(heads, len(member)))
                key = tb.mix64(np.add.reduceat(tb.keyed64(cls[member].view(np.uint64), 0x1EAF), heads) + count.astype(np.uint64))
                if marked:
                    key = tb.mix64(key ^ tb.keyed64(region[member[heads]].view(np.uint64), 0xB10C))
                    role = np.where(asking[member], QUERY, OTHER)
                else:
                    role = np.where(leaf[member] == member, LEAF, LEAF_OTHER)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(key, count).view(np.int64)), pa.array(cls[member]), pa.array(role.astype(np.int32))], ["key", "class", "role"])

    columns = ["region", "class", "n", "bits", "sketch"]
    # dealt by region first, so that repeated rows go where they lie and sketches are shuffled once
    dealt = rows.repartition(partitions, "region")
    once = dealt.groupBy(columns).agg(F.max("asking").alias("asking")) if marked else dealt.select(columns).distinct()
    return once.sortWithinPartitions("region", "class").mapInArrow(run, "key bigint, class bigint, role int").distinct()


def _crowds(crowds: DataFrame, rules: JaccardRules) -> DataFrame:
    """(region, class, n, bits, sketch, chunk, chunks, key, near): members of crowds by chunk; near: 2 for the
    classes nearest to the centre, which stand in every chunk as well, 1 for those that may link to one of them."""
    chunks = F.ceil(F.col("size") / rules.region).cast("long")
    members = crowds.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("class", F.lit(7)), F.col("chunks")))
    nearest = members.groupBy("region", F.pmod(F.xxhash64("class"), F.lit(rules.fan)).alias("salt")).agg(F.min(F.struct("far", "class", "n", "sketch")).alias("p"))
    pivots = nearest.groupBy("region").agg(F.array_sort(F.collect_list("p")).alias("pivots"))  # fan of them at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            region, n = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            cls, near = batch.column(1).to_numpy(), np.zeros(batch.num_rows, np.int32)
            for key in np.unique(region):
                at = np.flatnonzero(region == key)
                size = batch.column(3)[int(at[0])].as_py() // 8
                rows = folded(batch.column(4).take(pa.array(at)).to_pylist(), size)
                for p in batch.column(7)[int(at[0])].as_py():
                    h = hamming(rows, folded([p["sketch"]], size)[0])
                    near[at] = np.maximum(near[at], h <= rules.rho(n[at]) + rules.rho(np.array(p["n"])))
                    near[at[cls[at] == p["class"]]] = 2
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(near)], ["region", "class", "n", "bits", "sketch", "chunks", "chunk", "near"])

    rows = members.select("region", "class", "n", "bits", "sketch", "chunks", "chunk").join(_small(stored(pivots, "hearts")), "region")
    out = rows.mapInArrow(run, REGION + ", chunks bigint, chunk bigint, near int")
    return out.withColumn("key", F.xxhash64("region", "chunk", F.lit("crowd")))


def _shared(flat: np.ndarray, heads: np.ndarray, n: np.ndarray, q: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many values each of the sets `at` (ascending) has in common with the sorted set q, PIECE values at once."""
    out = np.zeros(len(at), np.int64)
    ends = np.cumsum(n[at])
    begin = 0
    while begin < len(at):
        done = ends[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, done + PIECE, "right")))
        some = at[begin:stop]
        whole = some[-1] - some[0] + 1 == len(some)
        values = flat[heads[some[0]] : heads[some[-1]] + n[some[-1]]] if whole else flat[blobs.gather(heads[some], n[some])]
        near = np.minimum(np.searchsorted(q, values), len(q) - 1)
        out[begin:stop] = np.add.reduceat((q[near] == values).astype(np.int64), ends[begin:stop] - n[some] - done)
        begin = stop
    return out


class Overlaps:
    """How many values sets have in common.  From the fourth set that is held against others, on rows of bits, one for each
    value that two sets or more hold, if these rows are not too large."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = np.array([len(s) for s in sets])
        self.flat = np.concatenate(sets)
        self.heads = np.cumsum(self.n) - self.n
        self.asked, self.bits = 0, None

    def _rows(self) -> np.ndarray | None:
        kinds = np.sort(self.flat)
        kinds = kinds[1:][kinds[1:] == kinds[:-1]]
        kinds = np.append(kinds[:1], kinds[1:][kinds[1:] != kinds[:-1]])
        width = max(1, -(-len(kinds) // 64))
        if 8 * width * len(self.n) > BIT_BYTES:
            return None
        out = np.zeros((len(self.n), 8 * width), np.uint8)
        ends, begin = self.heads + self.n, 0
        while begin < len(self.n) and len(kinds):
            stop = min(int(np.searchsorted(ends, self.heads[begin] + PIECE, "right")), begin + (4 << 20) // (64 * width))
            stop = max(begin + 1, stop)
            values = self.flat[self.heads[begin] : ends[stop - 1]]
            at = np.minimum(np.searchsorted(kinds, values), len(kinds) - 1)
            held = np.flatnonzero(kinds[at] == values)
            dense = np.zeros((stop - begin, 64 * width), bool)
            dense[np.repeat(np.arange(stop - begin), self.n[begin:stop])[held], at[held]] = True
            out[begin:stop] = np.packbits(dense, axis=1)
            begin = stop
        return out.view(np.uint64)

    def of(self, q: int, at: np.ndarray) -> np.ndarray:
        """Of set q with each of the sets `at` (ascending; not q itself, but for the first asked)."""
        self.asked += 1
        if self.asked == 4:
            self.bits = self._rows()
        if self.bits is None:
            return _shared(self.flat, self.heads, self.n, self.flat[self.heads[q] : self.heads[q] + self.n[q]], at)
        out, step = np.zeros(len(at), np.int64), max(1, (4 << 20) // self.bits.strides[0])
        for i in range(0, len(at), step):
            out[i : i + step] = np.bitwise_count(self.bits[at[i : i + step]] & self.bits[q]).sum(1, dtype=np.int64)
        return out


def join_region(sets: list[np.ndarray], rules: JaccardRules, every: bool = False, queries: int | None = None) -> list[tuple[int, int]]:
    """Links among sets (sorted arrays; the first is the pivot) that connect all that are connected,
    or every link.  With queries, only links of the first so many count."""
    shared = Overlaps(sets)
    n, everyone = shared.n, np.arange(len(sets))
    both = shared.of(0, everyone)
    union = n + n[0] - both
    linked = 100 * both >= rules.similarity * union
    far = 1 - both / union
    links = [(0, int(x)) for x in np.flatnonzero(linked) if x]
    part = np.where(linked, 0, everyone)  # the component of each so far
    reach = 1 - rules.similarity / 100 + 1e-9
    asking = everyone[1:queries]
    for q in asking if every else asking[~linked[asking]] if queries is None else asking:
        at = np.flatnonzero((everyone > q if every else part != part[q]) & (np.abs(far - far[q]) <= reach) & (100 * np.minimum(n, n[q]) >= rules.similarity * np.maximum(n, n[q])))
        if not len(at):
            continue
        b = shared.of(q, at)
        hits = at[100 * b >= rules.similarity * (n[at] + n[q] - b)]
        if every:
            links += [(int(q), int(x)) for x in hits]
            continue
        for x in hits[np.unique(part[hits], return_index=True)[1]]:  # one link joins two components
            links.append((int(q), int(x)))
            part[part == part[x]] = part[q]
    return links


def join_chunk(sets: list[np.ndarray], pivots: int, rules: JaccardRules) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(links that connect sets by the first `pivots`, the sets that these do not connect with the first)."""
    shared = Overlaps(sets)
    n, part, links = shared.n, np.arange(len(sets)), []
    for q in range(pivots):
        at = np.flatnonzero((part != part[q]) & (100 * np.minimum(n, n[q]) >= rules.similarity * np.maximum(n, n[q])))
        if not len(at):
            continue
        b = shared.of(q, at)
        for x in at[100 * b >= rules.similarity * (n[at] + n[q] - b)]:
            if part[x] != part[q]:
                links.append((q, int(x)))
                part[part == part[x]] = part[q]
    return links, np.flatnonzero(part != part[0])


def _joined(docs: DataFrame, classes: DataFrame, dealt: DataFrame, names: Names, partitions: int, rules: JaccardRules, every: bool) -> DataFrame:
    """(a, b): links between classes that meet under a key of dealt(key, class, role), from their sets; with
    b null, a class (a) of a crowd's chunk (key) that is still to be compared."""
    shown = classes.groupBy("class").agg(F.min("doc_id").alias("want_"))
    wanted = stored(dealt.join(shown, "class").groupBy("want_", "class").agg(F.collect_list(F.struct("key", "role")).alias("keys")), "wanted")
    size = wanted.agg(F.sum(24 + 12 * F.size("keys"))).first()[0] or 0
    if size <= rules.broadcast_bytes:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("want_"), "text").join(wanted, "want_").select("text", "class", "keys")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, table = tb.Hasher(lower=True), tb.whitespace_words()
        for batch in batches:
            for block in tb.blocks(batch.column(0), table, tb.BLOCK_BYTES // 2):
                grams, doc = shingle_sets(block, hasher.spans(block.data, block.starts, block.ends), rules.words)
                bounds = _bounds(doc, block.n_docs)
                cls = names.of(grams, bounds, rules).view(np.int64)
                rows: list[tuple] = []
                size = 0
                for d in range(block.n_docs):
                    if cls[d] != batch.column(1)[block.row0 + d].as_py():
                        continue  # a repeated doc_id with another text
                    content = grams[bounds[d] : bounds[d + 1]].tobytes()
                    for x in batch.column(2)[block.row0 + d].as_py():
                        rows.append((x["key"], int(cls[d]), x["role"], content))
                        size += len(content)
                        if size > 4 << 20:
                            yield _sets(rows)
                            rows, size = [], 0
                if rows:
                    yield _sets(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_key(batches):
            cls, first = np.unique(t.column(1).to_numpy(), return_index=True)  # rows are in order of role
            order = np.argsort(first)
            cls, first = cls[order], first[order]
            if len(cls) < 2:
                continue
            role = t.column(2).to_numpy()[first]
            content = t.column(3)
            sets = [np.frombuffer(content[int(i)].as_buffer(), np.uint64) for i in first]  # views, no copies
            rest = np.zeros(0, np.int64)
            if role[0] == PIVOT:
                found, rest = join_chunk(sets, int((role == PIVOT).sum()), rules)
            else:
                found = join_region(sets, rules, every, int((role == QUERY).sum()) if role[0] == QUERY else None)
            a = [cls[i] for i, _ in found] + cls[rest].tolist()
            b = [cls[j] for _, j in found] + [None] * len(rest)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([t.column(0)[0].as_py()] * len(a), pa.int64())], ["a", "b", "key"])

    schema = "key bigint, class bigint, role int, content binary"
    rows = texts.mapInArrow(tb.released(send), schema).repartition(partitions, "key").sortWithinPartitions("key", "role", "class")
    return rows.mapInArrow(tb.released(run), "a bigint, b bigint, key bigint").distinct()


def _links(docs: DataFrame, classes: DataFrame, hoods: DataFrame, names: Names, partitions: int, rules: JaccardRules, every: bool = False) -> DataFrame:
    """(a, b): links between classes of the neighbourhoods; the spanning ones or every one."""
    rows = stored(_first_regions(hoods, classes, rules), "regions")
    keys, crowds, level = None, None, 0
    while True:
        sizes = rows.groupBy("region").agg(F.count("*").alias("size"), (8 * F.sum("n")).alias("bytes_"))
        sizes = stored(sizes.filter((F.col("size") > rules.region) | ((F.col("bytes_") > rules.region_bytes) & (F.col("size") > 2))).drop("bytes_"), "sizes")
        any_large = bool(sizes.head(1))
        fit = rows.join(_small(sizes), "region", "left_anti") if any_large else rows
        leaves = _leaves(fit, partitions, rules)
        keys = leaves if keys is None else keys.unionByName(leaves)
        if not any_large:
            break
        rows, close = _split(rows.join(_small(sizes), "region"), level, rules)
        crowds = close if crowds is None else crowds.unionByName(close)
        level += 1
    keys = stored(keys.distinct(), "leaves")
    if crowds is None or not crowds.head(1):
        return _joined(docs, classes, keys, names, partitions, rules, every).select("a", "b")
    crowds = stored(_crowds(crowds, rules), "crowds")
    out = _joined(docs, classes, keys, names, partitions, rules, every)
    asking = crowds  # where no link may be left out, all of a crowd asks
    if not every:
        pivots = crowds.filter("near = 2").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        pivots = pivots.select(F.xxhash64("region", "chunk", F.lit("crowd")).alias("key"), "class", F.lit(PIVOT).alias("role"))
        chunked = stored(crowds.filter("near = 1").select("key", "class", F.lit(MEMBER).alias("role")).unionByName(pivots), "chunks")
        out = stored(out.unionByName(_joined(docs, classes, chunked, names, partitions, rules, every)), "links")
        open_ = out.filter("b IS NULL").select("key", F.col("a").alias("class")).join(crowds.filter("near = 2").select("key", "class").unionByName(crowds.filter("near = 1").select("key", "class")).distinct(), ["key", "class"])
        asking = crowds.filter("near = 0").unionByName(crowds.filter("near > 0").join(open_, ["key", "class"], "left_semi").select(crowds.columns))
    asking = asking.select("region", "class", "chunks").distinct()
    blocks = asking.groupBy("region", "chunks").agg(F.ceil(F.count("*") / rules.region).cast("long").alias("blocks"))
    spread = crowds.drop("chunks").join(_small(stored(blocks, "sizes")), "region").join(asking.select("region", "class", F.lit(True).alias("asks")), ["region", "class"], "left")
    here = F.pmod(F.xxhash64("class", F.lit(11)), F.col("blocks"))
    # a class that asks stands in its block against every chunk, each class in its chunk against every block
    queries = spread.filter("asks").withColumn("block", here).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("asking", F.lit(True))
    others = spread.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("asking", F.lit(False))
    columns = [F.xxhash64("region", "block", "chunk", F.lit("block")).alias("region"), "class", "n", "bits", "sketch", "asking"]
    against = stored(_leaves(queries.select(columns).unionByName(others.select(columns)), partitions, rules), "blocks")
    more = _joined(docs, classes, against, names, partitions, rules, every)
    return out.filter("b IS NOT NULL").select("a", "b").unionByName(more.select("a", "b"))


def _sets(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["key", "class", "role", "content"])


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(class, root): the least class that each linked class reaches, by large-star and
    small-star rounds, each written to the shared folder."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), name)
    before = None
    while True:
        # large star: each larger neighbour of a node goes to the least of its neighbourhood
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: each smaller neighbour, and the node, go to the least of them
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(small_least.select("u", F.col("m").alias("v")))
        edges = stored(small.distinct(), name)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.sum(F.hash("u", "v").cast("long")).alias("h")).first()
        if now == before:
            return edges.select(F.col("u").alias("class"), F.col("v").alias("root"))
        before = now


def _linked(docs: DataFrame, rules: JaccardRules, every: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows with their classes, links between classes)."""
    spark = docs.sparkSession
    partitions = partitions_for(docs, 12 << 20)
    path = scratch(spark, "classes")
    _classes(docs, rules).write.partitionBy("kind").parquet(path)
    read = spark.read.schema(CLASSES).parquet(path)
    first = read.filter("kind = 0").select("doc_id", "digest", "class", "second", "n", "sketch")
    names = _names(first)
    all_rows = _named(first, names)
    classes = all_rows.filter("n > 0").withColumn("doc_id", F.coalesce("doc_id", F.lit(NULL_ID)))
    hot = _frequent(read.filter("kind = 1").select("class", "n"), rules)
    weights = _weights(read.filter("kind = 2").select("class", "n"))
    hoods = stored(_neighbourhoods(_keys(docs, hot, weights, names, 4 * partitions, rules), partitions, rules), "hoods")
    return all_rows, _links(docs, classes, hoods, names, partitions, rules, every)


def similar_classes(docs: DataFrame, rules: JaccardRules = JaccardRules()) -> DataFrame:
    """(a, b), a < b: every link between classes of different sets; near_duplicates has the class of each row."""
    links = _linked(docs, rules, every=True)[1]
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()


def _rooted(docs: DataFrame, rules: JaccardRules) -> DataFrame:
    """(doc_id, digest, n, class, root) for each row of docs."""
    all_rows, links = _linked(docs, rules)
    roots = components(links)
    return all_rows.select("doc_id", "digest", "n", "class").join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))


def near_duplicates(docs: DataFrame, rules: JaccardRules = JaccardRules()) -> DataFrame:
    """(doc_id, n_shingles, class, component_id) for each row of docs(doc_id, text)."""
    named = _rooted(docs, rules).withColumnRenamed("n", "n_shingles")
    key = F.coalesce("doc_id", F.lit(NULL_ID))
    first = stored(named.filter("n_shingles > 0").groupBy("root").agg(F.min(key).alias("first")), "firsts")
    out = named.join(first, "root", "left")
    component = F.when(F.col("n_shingles") > 0, F.nullif(F.col("first"), F.lit(NULL_ID))).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", "class", component.alias("component_id"))


def drop_near_duplicates(docs: DataFrame, rules: JaccardRules = JaccardRules()) -> DataFrame:
    """docs with exactly one row of each component: that of the least doc_id (null counts as smallest),
    then of the least digest of the text; of rows equal in both, the least in the other columns.
    Rows with empty sets all stay.  All columns unchanged."""
    found = stored(_rooted(docs, rules).filter("n > 0").select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("key"), "digest", "root"), "roots")
    chosen = found.groupBy("root").agg(F.min(F.struct("key", "digest")).alias("best"), F.count("*").alias("rows"))
    marked = found.join(stored(chosen.filter("rows > 1"), "chosen"), "root")
    gone = stored(marked.filter((F.col("key") != F.col("best.key")) | (F.col("digest") != F.col("best.digest"))).select("key", "digest").distinct(), "gone")
    id_, digest, gone_id, gone_digest = (free_name(docs, x) for x in ("key_", "digest_", "gone_key", "gone_digest"))
    own = docs.withColumn(id_, F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))).withColumn(digest, F.md5("text"))
    on = [F.col(id_) == F.col(gone_id), F.col(digest) == F.col(gone_digest)]
    kept = own.join(_small(gone.select(F.col("key").alias(gone_id), F.col("digest").alias(gone_digest)), rules.broadcast_bytes), on, "left_anti")
    twice = stored(marked.filter((F.col("key") == F.col("best.key")) & (F.col("digest") == F.col("best.digest"))).groupBy("key", "digest").count().filter("count > 1").select(F.col("key").alias(gone_id), F.col("digest").alias(gone_digest)), "twice")
    if not twice.head(1):
        return kept.select(columns(docs))
    once = kept.join(twice, on, "left_anti").select(columns(docs))
    again = kept.join(twice, on, "left_semi")
    if any(f.dataType.typeName() in ("map", "variant") for f in docs.schema):
        return once.unionByName(again.dropDuplicates([id_, digest]).select(columns(docs)))
    least = again.groupBy(id_, digest).agg(F.min(F.struct(*columns(docs))).alias("row_"))
    return once.unionByName(least.select("row_.*"))
