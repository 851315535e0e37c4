"""Benchmark decontamination over a stored, distributed positional inverted index.

Index: each block of training documents becomes one segment row in a table in the
shared folder.  A segment's terms are dealt by hash to PARTS parts; a part has two columns,
its directory (terms and counts) and its posting lists (word places in the segment,
ascending for each term, delta-coded and compressed).  A search reads the columns of the
parts that hold test terms and no others (Parquet prunes columns), so one item costs
a small share of the index.  Segments are independent of each other: building is a map
without a shuffle, a phrase's lists are always in one row, and a hot term or passage is
spread over all segments.

Search: the benchmark is taken in blocks of at most `block_bytes` of text, so what is
broadcast is bounded; each block's matches go to one stored table, so the plan that reads
them does not grow with the benchmark.  In a segment, windows with a term that the segment
lacks end at the directory; a window's candidates are the postings of its rarest term less
the term's offset; each further term, from rare to frequent, keeps the candidates
whose offset place is in its own list.  `phrase_matches` returns exact phrases,
`proximity_matches` items whose rarest terms meet within a span in any order.

Edge cases: null and empty texts have no words and match nothing; items with a null
id or without words are left out; an item of fewer words than the window is one
window; every row is judged by its own text, whatever its id (null and repeated ids too);
empty tables give empty results; other columns are ignored (`decontaminate` keeps those of its input).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blobs
from . import textblocks as tb
from .storage import drop_scratch, free_name, scratch

PARTS = 128
#: Columns of a part: its directory and its posting lists.
DIRECTORY, POSTINGS = "d{}", "p{}"


def _columns(parts: range | list[int], postings: bool = True) -> list[str]:
    return [f.format(k) for k in parts for f in ((DIRECTORY, POSTINGS) if postings else (DIRECTORY,))]


def _segment_schema(key: str) -> str:
    return f"segment string, keys array<{key}>, first array<int>, " + ", ".join(f"{c} binary" for c in _columns(range(PARTS)))


def _match_schema(key: str) -> str:
    return f"segment string, place int, doc_id {key}, item_id string, start int, stop int"


@dataclass(frozen=True)
class MatchRules:
    """window: words in a phrase; proximity: the number of an item's rarest terms that
    must meet within `slop` words; block_bytes: benchmark text searched at a time."""

    window: int = 10
    proximity: int = 4
    slop: int = 30
    block_bytes: int = 8 << 20


def _part(words: np.ndarray) -> np.ndarray:
    """The part of each word's hash: parts are ranges of hashes."""
    return (words >> np.uint64(64 - PARTS.bit_length() + 1)).astype(np.int64)


def _segment(block: tb.Block, hasher: tb.Hasher) -> list[bytes]:
    """The parts' columns: (counts, lengths, letters) of the terms, and their postings."""
    words = hasher.spans(block.data, block.starts, block.ends)
    order = np.argsort(words, kind="stable")
    ordered = words[order]
    begins = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    counts = np.diff(np.append(begins, len(ordered))).astype(np.int32)
    shown = order[begins]
    lengths = (block.ends - block.starts)[shown]
    letters = block.data[_ranges(block.starts[shown], lengths)]
    letters = np.where((letters >= 0x41) & (letters <= 0x5A), letters + 32, letters).astype(np.uint8)
    deltas = np.diff(order.astype(np.int32), prepend=np.int32(0))
    deltas[begins] = order[begins]  # each list by itself
    cut = np.searchsorted(_part(ordered[begins]), np.arange(PARTS + 1))
    posting = np.append(begins, len(ordered))[cut]
    letter = np.concatenate([[0], np.cumsum(lengths)])[cut]
    out = []
    for k in range(PARTS):
        terms = slice(cut[k], cut[k + 1])
        out.append(blobs.pack(counts[terms], lengths[terms].astype(np.int32), letters[letter[k] : letter[k + 1]]))
        out.append(blobs.pack(deltas[posting[k] : posting[k + 1]].astype(np.int32)))
    return out


def build_index(docs: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """Writes the index of docs(key, text) at path; returns its table.  Matches name a row by its key."""
    kind = docs.schema[key].dataType.simpleString()
    schema = _segment_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        hasher, table = tb.Hasher(lower=True), tb.alnum_words()
        names = ["segment", "keys", "first", *_columns(range(PARTS))]
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        for batch in batches:
            for block in tb.blocks(batch.column(1), table):
                keys = batch.column(0).slice(block.row0, block.n_docs)
                keys = pa.concat_arrays([keys])  # without the slice's offset
                columns = [pa.array([x], pa.binary()) for x in _segment(block, hasher)]
                yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), one(keys), one(pa.array(block.first.astype(np.int32))), *columns], names)

    docs.select(key, "text").mapInArrow(tb.released(run), schema).write.parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def _item_blocks(benchmark: DataFrame, rules: MatchRules) -> Iterator[tuple[list[str], list[list[str]]]]:
    """(item ids, their words) in blocks of bounded text; the driver holds one block at a time."""
    ids, words, size = [], [], 0
    table = tb.alnum_words()
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).filter("i IS NOT NULL AND t IS NOT NULL")
    for row in rows.toLocalIterator():
        block = next(tb.blocks(pa.array([row.t]), table))
        found = [block.data[a:b].tobytes().lower().decode() for a, b in zip(block.starts, block.ends, strict=True)]
        if not found:
            continue
        ids, size = [*ids, row.i], size + len(row.t)
        words.append(found)
        if size >= rules.block_bytes:
            yield ids, words
            ids, words, size = [], [], 0
    if ids:
        yield ids, words


def _parts_of(terms: list[str]) -> list[int]:
    """The parts that hold the terms."""
    block = next(tb.blocks(pa.array([" ".join(terms)]), tb.alnum_words(), 1 << 40), None)
    if block is None:
        return []
    return np.unique(_part(tb.Hasher(lower=True).spans(block.data, block.starts, block.ends))).tolist()


def _directory(batch: pa.RecordBatch, row: int, columns: list[int]) -> tuple[np.ndarray, pa.Array]:
    """(counts, terms) of the given directory columns of a row."""
    parts = [blobs.unpack(batch.column(c)[row].as_py()) for c in columns]
    counts, lengths, letters = (np.concatenate(x) for x in zip(*parts, strict=True))
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return counts.astype(np.int64), pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(letters)))


def _frequencies(index: DataFrame, terms: list[str]) -> np.ndarray:
    """How often each of the terms occurs in the whole index, from the directories of their parts."""
    parts = _parts_of(terms)
    out = np.zeros(len(terms), np.int64)
    if not parts:
        return out
    shared = index.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(shared.value, pa.string())
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                counts, found = _directory(batch, row, list(range(batch.num_columns)))
                at = pc.index_in(found, value_set=wanted)
                hit = pc.is_valid(at).to_numpy(zero_copy_only=False)
                total[at.drop_null().to_numpy()] += counts[hit]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "n"])

    for row in index.select(*_columns(parts, postings=False)).mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        out[row.term] = row.n
    return out


class _Segment:
    """A segment opened for a set of test terms: their posting lists, and which term is where.

    A batch has the columns segment, keys, first and those of the terms' parts."""

    def __init__(self, batch: pa.RecordBatch, row: int, wanted: pa.Array):
        self.name = batch.column(0)[row].as_py()
        self.keys = batch.column(1)[row].values
        self.first = batch.column(2)[row].values.to_numpy()
        self.n = int(self.first[-1]) if len(self.first) else 0
        counts, terms = _directory(batch, row, list(range(3, batch.num_columns, 2)))
        deltas = np.concatenate([blobs.unpack(batch.column(c)[row].as_py())[0] for c in range(4, batch.num_columns, 2)])
        bounds = np.concatenate([[0], np.cumsum(counts)])
        running = np.concatenate([[0], np.cumsum(deltas, dtype=np.int64)])
        self.postings = running[1:] - np.repeat(running[bounds[:-1]], counts)
        at = pc.index_in(terms, value_set=wanted)
        hit = np.flatnonzero(pc.is_valid(at).to_numpy(zero_copy_only=False))
        term = at.drop_null().to_numpy()
        self.start = np.zeros(len(wanted), np.int64)
        self.count = np.zeros(len(wanted), np.int64)
        self.start[term], self.count[term] = bounds[hit], counts[hit]
        self.term_at = np.full(self.n, -1, np.int32)
        where = _ranges(bounds[hit], counts[hit])
        self.term_at[self.postings[where]] = np.repeat(term, counts[hit])
        self.doc = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start and count."""
    total = int(counts.sum())
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else starts, counts)
    return shift + np.arange(total)


def _windows(words: list[list[str]], codes: dict[str, int], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, length, terms padded with -1 to k) of every window."""
    items, lengths, rows = [], [], []
    for i, found in enumerate(words):
        coded = np.array([codes[w] for w in found])
        if len(coded) < k:
            rows.append(np.pad(coded, (0, k - len(coded)), constant_values=-1)[None])
        else:
            rows.append(np.lib.stride_tricks.sliding_window_view(coded, k))
        items.append(np.full(len(rows[-1]), i))
        lengths.append(np.full(len(rows[-1]), min(k, len(coded))))
    return np.concatenate(items), np.concatenate(lengths), np.concatenate(rows)


def _phrases(seg: _Segment, lengths: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, first word) of every occurrence: offset-adjusted lists, intersected from the rarest."""
    frequency = np.where(terms < 0, np.iinfo(np.int64).max, seg.count[np.maximum(terms, 0)])
    alive = np.flatnonzero(frequency.min(axis=1) > 0)
    terms, lengths = terms[alive], lengths[alive]
    by_rarity = np.argsort(frequency[alive], axis=1, kind="stable")
    rare = by_rarity[:, 0]
    anchor = terms[np.arange(len(terms)), rare]
    out = []
    for part in _slices(seg.count[anchor], 4 << 20):  # candidates held at a time
        window = np.repeat(np.arange(part.start, part.stop), seg.count[anchor[part]])
        begin = seg.postings[_ranges(seg.start[anchor[part]], seg.count[anchor[part]])] - rare[window]
        ok = (begin >= 0) & (begin + lengths[window] <= seg.n)
        window, begin = window[ok], begin[ok]
        ok = seg.doc[begin] == seg.doc[begin + lengths[window] - 1]
        window, begin = window[ok], begin[ok]
        for j in range(1, terms.shape[1]):
            offset = by_rarity[window, j]
            wanted = terms[window, offset]
            ok = (wanted < 0) | (seg.term_at[np.minimum(begin + offset, seg.n - 1)] == wanted)
            window, begin = window[ok], begin[ok]
        out.append((alive[window], begin))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([w for w, _ in out]), np.concatenate([b for _, b in out])


def _slices(sizes: np.ndarray, limit: int) -> Iterator[slice]:
    """Consecutive ranges of items whose sizes sum to about `limit` at most (one item at least)."""
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, "right")))
        yield slice(at, stop)
        at = stop


def _search(index: DataFrame, benchmark: DataFrame, rules: MatchRules, prepare: Callable, find: Callable) -> DataFrame:
    """Matches of every block of items, in one stored table.  prepare(codes, ids, words) gives what
    is broadcast (None: nothing to find); find(segment, that) the (item id, start, stop) in the segment's words."""
    key = index.schema["keys"].dataType.elementType.simpleString()
    schema = _match_schema(key)
    path = scratch(index.sparkSession, "matches")
    index.sparkSession.createDataFrame([], schema).write.parquet(path)
    for ids, words in _item_blocks(benchmark, rules):
        codes: dict[str, int] = {}
        for found in words:
            for w in found:
                codes.setdefault(w, len(codes))
        ready = prepare(codes, ids, words)
        if ready is None:
            continue
        shared = index.sparkSession.sparkContext.broadcast((list(codes), ready))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            codes, ready = shared.value
            wanted = pa.array(codes, pa.string())
            for batch in batches:
                for row in range(batch.num_rows):
                    seg = _Segment(batch, row, wanted)
                    items, start, stop = find(seg, ready) if seg.n else ([], None, None)
                    if not len(items):
                        continue
                    place = seg.doc[start]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([seg.name] * len(items)), pa.array(place.astype(np.int32)), seg.keys.take(pa.array(place)), pa.array(items, pa.string()),
                         pa.array((start - seg.first[place]).astype(np.int32)), pa.array((stop - seg.first[place]).astype(np.int32))],
                        ["segment", "place", "doc_id", "item_id", "start", "stop"],
                    )

        index.select("segment", "keys", "first", *_columns(_parts_of(list(codes)))).mapInArrow(run, schema).write.mode("append").parquet(path)
        shared.unpersist()
    return index.sparkSession.read.schema(schema).parquet(path)


def phrase_matches(index: DataFrame, benchmark: DataFrame, rules: MatchRules = MatchRules()) -> DataFrame:
    """(segment, place, doc_id, item_id, start, stop): runs of words (start and stop count from the
    document's first word) that consecutive windows of an item cover exactly."""

    def prepare(codes: dict[str, int], ids: list[str], words: list[list[str]]) -> tuple:
        return ids, *_windows(words, codes, rules.window)

    def find(seg: _Segment, ready: tuple) -> tuple:
        ids, item, lengths, terms = ready
        window, begin = _phrases(seg, lengths, terms)
        key = np.unique(np.stack([item[window], begin, begin + lengths[window]], 1), axis=0)
        if not len(key):
            return [], None, None
        join = np.concatenate([[False], (key[1:, 0] == key[:-1, 0]) & (key[1:, 1] <= key[:-1, 2]) & (seg.doc[key[1:, 1]] == seg.doc[key[:-1, 1]])])
        begins = np.flatnonzero(~join)
        last = np.append(begins[1:], len(key)) - 1
        return [ids[i] for i in key[begins, 0]], key[begins, 1], key[last, 2]

    return _search(index, benchmark, rules, prepare, find)


def proximity_matches(index: DataFrame, benchmark: DataFrame, rules: MatchRules = MatchRules()) -> DataFrame:
    """Places (as of phrase_matches) where an item's `proximity` rarest terms that occur at all meet
    within `slop` words, in any order; items with fewer distinct terms are left out.  Equally
    rare terms go by their letters."""

    def prepare(codes: dict[str, int], ids: list[str], words: list[list[str]]) -> list | None:
        counts = _frequencies(index, list(codes))
        out = []
        for i, found in enumerate(words):
            distinct = sorted({w for w in found if counts[codes[w]]}, key=lambda w: (counts[codes[w]], w))
            if len(distinct) >= rules.proximity:
                out.append((ids[i], [codes[w] for w in distinct[: rules.proximity]]))
        return out or None

    def find(seg: _Segment, items: list) -> tuple:
        names, starts, stops = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for name, terms in items:
            lists = [seg.postings[seg.start[t] : seg.start[t] + seg.count[t]] for t in terms]
            if not all(map(len, lists)):
                continue
            # a span begins at the place of one of the terms and holds one of each other
            for a in lists:
                nexts = [np.append(x, np.iinfo(np.int32).max)[np.searchsorted(x, a)] for x in lists]
                far = np.max(nexts, axis=0)
                ok = (far - a < rules.slop) & (far < seg.n)
                ok[ok] = seg.doc[a[ok]] == seg.doc[far[ok]]
                names += [name] * int(ok.sum())
                starts.append(a[ok])
                stops.append(far[ok] + 1)
        return names, np.concatenate(starts), np.concatenate(stops)

    return _search(index, benchmark, rules, prepare, find)


def contamination_report(index: DataFrame, benchmark: DataFrame, rules: MatchRules = MatchRules()) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), a row for each indexed row."""
    docs = index.select(
        "segment", F.posexplode(F.arrays_zip("keys", F.expr("zip_with(slice(first, 2, greatest(size(first) - 1, 0)), slice(first, 1, greatest(size(first) - 1, 0)), (b, a) -> cast(b - a as bigint))").alias("n_words"))).alias("place", "d")
    ).select("segment", "place", F.col("d.keys").alias("doc_id"), F.col("d.n_words").alias("n_words"))
    runs = phrase_matches(index, benchmark, rules)
    per_doc = runs.groupBy("segment", "place").agg(
        F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("runs"), F.array_sort(F.collect_set("item_id")).alias("items")
    )
    # spans in order: add what lies beyond the furthest stop so far
    n_hit = F.aggregate(
        "runs", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda s, r: F.struct(F.greatest(s["end"], r["stop"]).alias("end"), (s["n"] + F.greatest(r["stop"] - F.greatest(r["start"], s["end"]), F.lit(0))).alias("n")),
    )["n"]
    hits = per_doc.select("segment", "place", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    none = F.sha2(F.lit(""), 256)
    return docs.join(hits, ["segment", "place"], "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", none).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, rules: MatchRules = MatchRules()) -> DataFrame:
    """The rows of docs that no benchmark window occurs in, all columns unchanged.

    Whether a row is hit follows from its text alone, so rows are named by their text's digest."""
    digest = F.sha2("text", 256)
    path = scratch(docs.sparkSession, "postings")
    index = build_index(docs.select(digest.alias("key"), "text").filter("text IS NOT NULL"), path, "key")
    bad = phrase_matches(index, benchmark, rules).select(F.col("doc_id").alias("hit_digest")).distinct()
    drop_scratch(docs.sparkSession, path)
    mark = free_name(docs, "hit_digest")
    return docs.join(bad.withColumnRenamed("hit_digest", mark), digest == F.col(mark), "left_anti")
