"""Token counts of a byte-level BPE tokenizer by two tiers of lookup in the tasks that read the texts.

A text is cut into pre-tokens as the tokenizer does (contractions, runs of letters, of numbers and of
other characters with the space before them, white space), by array operations on its code points.
A pre-token's count of tokens depends on nothing around it, so

* the first tier is a broadcast hash table of the pre-tokens that are most frequent in a bounded
  sample of rows: packed bytes and counts, probed for a whole block of texts at once.  Its keys
  are the pre-tokens' bytes themselves (15 at most), so no two can be taken for each other;
* what misses it is made distinct by block and looked up in a cache of the task, and what that misses is
  encoded by the library.  The cache is emptied when it reaches `cache_bytes`.

Nothing is shuffled but the sampled rows.  The sample decides how often the first tier hits and
never a count, so any sample (or none) gives the same result.

Letters, numbers and spaces are told apart as the library does: a task asks it once about each
code point that it meets.  Texts that hold an added token's string (as `<|endoftext|>`) are encoded
whole by the library.  A tokenizer whose file has a normalizer or another way to cut is encoded whole as well.

Edge cases: a null text counts as empty and has no tokens; texts of any length are taken in pieces that
end before white space; pre-tokens of any length are encoded alone; repeated rows are counted alike; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb

#: Bytes of a pre-token that a key holds; the last byte of a key is its length.
KEY_BYTES = 15
PIECE_BYTES = 1 << 20
_LETTER, _NUMBER, _SPACE, _OTHER, _UNKNOWN = 1, 2, 3, 4, 0
_U = np.uint64
#: A place where a long text may be cut: white space after a letter or digit.
_CUT = re.compile(rb"(?<=[0-9A-Za-z])[ \n]")


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary file (found on the driver; tasks get its content)."""
    import public_tokenizers

    return public_tokenizers.path(name)


@dataclass(frozen=True)
class CountRules:
    """limit: tokens beyond which a document is over it; sample_rows: rows (about) that the frequent pre-tokens are
    taken from; table_size: frequent pre-tokens at most; cache_bytes: of a task's cache."""

    limit: int = 1024
    sample_rows: int = 4_000
    table_size: int = 1 << 16
    cache_bytes: int = 32 << 20
    seed: int = 3


class Library:
    """The library's tokenizer of a file's content, and what the array form must know about it."""

    def __init__(self, content: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        spec = json.loads(content)
        pre = spec.get("pre_tokenizer") or {}
        self.arrays = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        self.added = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.kinds = np.zeros(0x110000, np.uint8)

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def kind(self, points: np.ndarray) -> np.ndarray:
        """Letter, number, space or other, of code points."""
        found = self.kinds[points]
        if not found.all():
            for p in np.unique(points[found == _UNKNOWN]).tolist():
                self.kinds[p] = self._asked(chr(p))
            found = self.kinds[points]
        return found

    def _asked(self, c: str) -> int:
        parts = lambda text: [at for _, at in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        if len(parts("a" + c)) == 1:
            return _LETTER
        if len(parts("1" + c)) == 1:
            return _NUMBER
        return _OTHER if len(parts("!" + c)) == 1 else _SPACE


def pretoken_starts(points: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in the code points of some texts; first: where each text begins."""
    n = len(points)
    fresh = np.zeros(n + 1, bool)
    fresh[first[first <= n]] = True
    fresh[n] = True
    space, blank = kind == _SPACE, points == 0x20
    change = np.ones(n, bool)
    change[1:] = kind[1:] != kind[:-1]
    start = change | fresh[:n]
    # the last space of a run begins a pre-token of its own, or the one that follows it in the text
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~fresh[1:n]
    start |= last
    glued = np.zeros(n, bool)
    glued[1:] = (last & blank)[:-1]
    start &= ~glued
    # contractions: an apostrophe that begins a pre-token, and its letters
    quote = np.flatnonzero((points == 0x27) & start)
    if len(quote):
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        inside = lambda at: ~fresh[np.minimum(at, n)]
        a, b = padded[quote + 1], padded[np.minimum(quote + 2, n + 1)]
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8)) & inside(quote + 1)
        two = (((a == 0x72) | (a == 0x76)) & (b == 0x65) | (a == 0x6C) & (b == 0x6C)) & inside(quote + 1) & inside(quote + 2)
        for hit, size in ((one, 2), (two, 3)):
            at = quote[hit]
            start[at + 1] = False
            end = at + size
            start[end[end < n]] = True
    return np.flatnonzero(start)


def _windows(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Views of the eight bytes from each place, and of the eight after these."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    view = np.lib.stride_tricks.as_strided(padded.view(np.uint8)[:8].view(np.uint64), (len(data) + 8,), (1,))
    return view[: len(data)], view[8:]


_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def keys(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of at most KEY_BYTES bytes as two numbers each, which hold the bytes and the length."""
    low, high = _windows(data)
    a = low[begin] & _MASKS[np.minimum(size, 8)]
    b = high[begin] & _MASKS[np.maximum(size - 8, 0)] | size.astype(np.uint64) << _U(56)
    return a, b


def key_text(a: int, b: int) -> bytes:
    return (int(a).to_bytes(8, "little") + int(b).to_bytes(8, "little"))[: int(b) >> 56]


class Table:
    """Open addressing over keys: counts of tokens, or -1 for what is not in it."""

    def __init__(self, a: np.ndarray, b: np.ndarray, counts: np.ndarray):
        self.a, self.b, self.counts = a, b, counts.astype(np.int32)
        self.bits = max(4, int(4 * len(a)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        home, todo, step = self._home(a, b), np.arange(len(a)), 0
        while len(todo):
            at = (home[todo] + step) & (len(self.slots) - 1)
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]  # of several at one slot, one stays
            todo, step = todo[self.slots[at] != todo], step + 1
        self.reach = step

    def _home(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (tb.mix64(a + tb.mix64(b)) >> _U(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.full(len(a), -1, np.int32)
        if not len(self.a):
            return out
        with np.errstate(over="ignore"):
            home, todo = self._home(a, b), np.arange(len(a))
        for step in range(self.reach):
            held = self.slots[(home[todo] + step) & (len(self.slots) - 1)]
            todo, held = todo[held >= 0], held[held >= 0]
            hit = (self.a[held] == a[todo]) & (self.b[held] == b[todo])
            out[todo[hit]] = self.counts[held[hit]]
            todo = todo[~hit]
            if not len(todo):
                break
        return out


class Spans:
    """Pre-tokens of some texts: byte spans, and the text of each."""

    def __init__(self, library: Library, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        lead = (data & 0xC0) != 0x80
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        at = np.append(np.flatnonzero(lead), len(data))
        begin = at[pretoken_starts(points, library.kind(points), np.searchsorted(at, offsets))]
        self.begin = begin
        self.size = np.diff(np.append(begin, len(data)))
        self.doc = np.searchsorted(offsets, begin, "right") - 1

    def text(self, i: int) -> bytes:
        return self.data[self.begin[i] : self.begin[i] + self.size[i]].tobytes()


def pieces(data: np.ndarray, offsets: np.ndarray, size: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray]]:
    """(low, high, offsets from low): runs of whole texts of about `size` bytes; longer texts in pieces by themselves."""
    row, n = 0, len(offsets) - 1
    while row < n:
        stop = min(max(int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1, row + 1), n)
        low, high = int(offsets[row]), int(offsets[stop])
        if high - low <= size:
            yield row, low, offsets[row : stop + 1] - low
        else:
            text, at = memoryview(np.ascontiguousarray(data[low:high])), 0
            while at < high - low:
                found = _CUT.search(text, at + size) if at + size < high - low else None
                end = found.start() if found else high - low
                yield row, low + at, np.array([0, end - at])
                at = end
        row = stop


class Counter:
    """Token counts of batches of texts, by the table and the task's cache."""

    def __init__(self, library: Library, table: Table, cache_bytes: int):
        self.library, self.table, self.cache_bytes = library, table, cache_bytes
        self.cache: dict[bytes, int] = {}
        self.held = 0

    def looked_up(self, texts: list[bytes]) -> list[int]:
        out = [self.cache.get(t) for t in texts]
        new = list({texts[i]: None for i, n in enumerate(out) if n is None})
        found = dict(zip(new, self.library.lengths([t.decode() for t in new]), strict=True))
        for t, n in found.items():
            self._keep(t, n)
        return [found[t] if n is None else n for t, n in zip(texts, out, strict=True)]

    def _keep(self, text: bytes, n: int) -> None:
        if len(text) > 256:
            return
        if self.held > self.cache_bytes:
            self.cache, self.held = {}, 0
        self.cache[text] = n
        self.held += len(text) + 150

    def by_text(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text of a piece."""
        spans = Spans(self.library, data, offsets)
        counts = np.zeros(len(spans.begin), np.int64)
        short = np.flatnonzero(spans.size <= KEY_BYTES)
        a, b = keys(data, spans.begin[short], spans.size[short])
        found = self.table.find(a, b)
        counts[short] = found
        lost = np.flatnonzero(found < 0)
        if len(lost):
            order = lost[np.lexsort((a[lost], b[lost]))]
            new = np.ones(len(order), bool)
            new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
            head = order[new]
            sizes = np.array(self.looked_up([key_text(x, y) for x, y in zip(a[head].tolist(), b[head].tolist(), strict=True)]))
            counts[short[order]] = sizes[np.cumsum(new) - 1]
        long = np.flatnonzero(spans.size > KEY_BYTES)
        if len(long):
            counts[long] = self.looked_up([spans.text(i) for i in long.tolist()])
        return np.bincount(spans.doc, counts, len(offsets) - 1).astype(np.int64)

    def count(self, column: pa.Array) -> np.ndarray:
        """Tokens of each text of a column."""
        data, offsets = tb.utf8(column)
        out = np.zeros(len(offsets) - 1, np.int64)
        if not self.library.arrays:
            return np.array(self.library.lengths([data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]), np.int64)
        whole = self._whole(data, offsets)
        for row, low, own in pieces(data, offsets):
            piece = data[low : low + int(own[-1])]
            if len(piece):
                out[row : row + len(own) - 1] += self.by_text(piece, own)
        for row in whole:
            out[row] = self.library.lengths([data[offsets[row] : offsets[row + 1]].tobytes().decode()])[0]
        return out

    def _whole(self, data: np.ndarray, offsets: np.ndarray) -> list[int]:
        """Rows that hold an added token's text."""
        rows, content = set(), None
        for token in self.library.added:
            content = content if content is not None else data.tobytes()
            at = content.find(token)
            while at >= 0:
                rows.add(int(np.searchsorted(offsets, at, "right")) - 1)
                at = content.find(token, at + 1)
        return sorted(rows)


def frequent(docs: DataFrame, library: str, rules: CountRules = CountRules()) -> Table:
    """The most frequent short pre-tokens of about sample_rows rows, with their counts of tokens.

    The sampled rows go to a few tasks, which return their table_size most frequent pre-tokens each."""
    n = docs.count()
    own = Library(library)
    if not n or not own.arrays:
        return Table(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0))
    rows = docs.select("text").filter("text IS NOT NULL")
    rows = rows.sample(min(1.0, rules.sample_rows / n), rules.seed).repartition(4)
    size = rules.table_size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library_, total = Library(library), Tally()
        for batch in batches:
            data, offsets = tb.utf8(batch.column(0))
            for _, low, at in pieces(data, offsets):
                if at[-1]:
                    spans = Spans(library_, data[low : low + int(at[-1])], at)
                    short = spans.size <= KEY_BYTES
                    total.add(*keys(spans.data, spans.begin[short], spans.size[short]))
            total.cut(16 * size)
        total.cut(size)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]) for x in (total.a, total.b, total.n)], ["a", "b", "n"])

    total = Tally()
    for r in rows.mapInArrow(run, "a binary, b binary, n binary").collect():
        total.add(np.frombuffer(r.a, np.uint64), np.frombuffer(r.b, np.uint64), np.frombuffer(r.n, np.int64))
    total.cut(size)
    counts = own.lengths([key_text(x, y).decode() for x, y in zip(total.a.tolist(), total.b.tolist(), strict=True)])
    return Table(total.a, total.b, np.array(counts))


class Tally:
    """How often keys were seen."""

    def __init__(self):
        self.a, self.b, self.n = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, a: np.ndarray, b: np.ndarray, n: np.ndarray | None = None) -> None:
        a, b = np.concatenate([self.a, a]), np.concatenate([self.b, b])
        n = np.concatenate([self.n, np.ones(len(a) - len(self.n), np.int64) if n is None else n])
        order = np.lexsort((a, b))
        a, b, n = a[order], b[order], n[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        at = np.flatnonzero(new)
        self.a, self.b, self.n = a[at], b[at], np.add.reduceat(n, at) if len(at) else n

    def cut(self, size: int) -> None:
        if len(self.n) > size:
            top = np.sort(np.argsort(-self.n, kind="stable")[:size])
            self.a, self.b, self.n = self.a[top], self.b[top], self.n[top]


def token_counts(docs: DataFrame, path: str | None = None, rules: CountRules = CountRules()) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of docs."""
    with open(path or tokenizer_file(), encoding="utf-8") as f:
        content = f.read()
    shared = docs.sparkSession.sparkContext.broadcast((content, frequent(docs, content, rules)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            if counter is None:
                counter = Counter(Library(shared.value[0]), shared.value[1], rules.cache_bytes)
            _, offsets = tb.utf8(batch.column(1))
            n = counter.count(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > rules.limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
