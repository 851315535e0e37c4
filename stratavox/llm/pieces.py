"""SentencePiece merge segmentation with seeded merge-dropout, and its decoding.

The vocabulary comes from a public model file (a parameter).  A text is encoded as
the model does: a space is put in front, spaces become the piece mark, and adjacent
symbols are merged by an agenda ordered by piece score, then from left to right;
characters without a piece become byte pieces.  With dropout, each candidate merge
(its place and extent in its chunk) is skipped when a keyed hash of the seed, the
chunk, its doc_id and ordinal and the candidate falls below the rate, so every occurrence of a word is cut by
itself, and always the same way again for the same seed.  With rate 0 the result is the
library's own.  As long as none of the merges that are made without dropout is skipped, dropout
changes nothing (each is still the first of the agenda in its turn): such occurrences, found by hashing those
merges, take the kept segmentation of their content, and only the others are merged anew.

No piece of the model holds a mark after another character, and some control
characters (line feeds among them) are in no longer piece, so merges never cross the
start of a run of spaces or such a character: texts are cut there into chunks.  Short chunks of a block are merged together, one merge
a chunk and round, on arrays; longer ones by `agenda`, which is also the plain form
that the arrays are tested against.

Edge cases: null and empty texts have no pieces and decode to empty; a literal mark
character (U+2581) is kept apart from a space by byte pieces, so decoding is lossless
for any text; very long words take the agenda (n log n); repeated rows are encoded
alike; an empty table stays empty; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textblocks as tb

MARK = "▁"
LONG = 48
BATCH = 4096
NONE = np.iinfo(np.int64).max
_U = np.uint64


def default_model() -> str:
    """The public model file described in /opt/tokenizers/README.md."""
    return "/opt/tokenizers/piece_bpe_32k.model"


def model_bytes(path: str) -> bytes:
    """The content of a model file, read by the driver."""
    with open(path, "rb") as f:
        return f.read()


@dataclass(frozen=True)
class Dropout:
    """rate: share of candidate merges skipped; variants: ways to cut one chunk at most, where
    fewer forms of a word are wanted (None: every occurrence by itself)."""

    rate: float = 0.1
    seed: int = 7
    variants: int | None = None


class Pieces:
    """The tables of a model (the bytes of its file): pieces of one character, merges, byte pieces and texts of ids."""

    def __init__(self, content: bytes):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=content)
        n = self.size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        ids = {names[i]: i for i in plain}
        self.byte_id = np.zeros(256, np.int32)
        for i in range(n):
            if model.is_byte(i):
                self.byte_id[int(names[i][1:-1], 16)] = i
        if any(MARK in names[i].lstrip(MARK) for i in plain):
            raise ValueError("a piece holds a mark after another character")
        #: control characters that no piece joins to another character
        joined = {c for i in plain if len(names[i]) > 1 for c in names[i]}
        self.alone = np.array([b < 0x20 and chr(b) not in joined for b in range(256)])
        scores = sorted({-model.get_score(i) for i in plain})
        rank = {s: k for k, s in enumerate(scores)}
        singles = {p.replace(MARK, " ").encode(): i for p, i in ids.items() if len(p) == 1}
        keys = np.array([int.from_bytes(k, "little") for k in singles], np.int64)
        order = np.argsort(keys)
        self.char_keys, self.char_ids = keys[order], np.array(list(singles.values()), np.int32)[order]
        merges = {}
        for p, i in ids.items():
            for k in range(1, len(p)):
                left, right = ids.get(p[:k]), ids.get(p[k:])
                if left is not None and right is not None:
                    merges[left * n + right] = (i, rank[-model.get_score(i)])
        self.merges = merges
        keys = np.array(list(merges), np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ids = np.array([v[0] for v in merges.values()], np.int64)[order]
        self.pair_rank = np.array([v[1] for v in merges.values()], np.int64)[order]
        texts = self._texts(model, names, n)
        self.text_data = np.frombuffer(b"".join(texts), np.uint8)
        self.text_offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        # direct tables for pairs would be n * n; in a hash table with a slot in eight taken, nearly all pairs need one probe
        self.bits = max(4, int(8 * len(merges) + 1).bit_length())
        self._build_slots()

    @staticmethod
    def _texts(model, names: list[str], n: int) -> list[bytes]:
        out = []
        for i in range(n):
            if model.is_byte(i):
                out.append(bytes([int(names[i][1:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                out.append(b"")
            else:
                out.append(names[i].replace(MARK, " ").encode())
        return out

    def _build_slots(self) -> None:
        size = 1 << self.bits
        self.slot = np.full(size, -1, np.int32)
        left = np.arange(len(self.pair_keys))
        at = self._home(self.pair_keys)
        while len(left):
            free = self.slot[at] < 0
            self.slot[at[free]] = left[free]
            lost = self.slot[at] != left
            left, at = left[lost], (at[lost] + 1) & (size - 1)
        self.slot_keys = np.full(size, -2, np.int64)
        taken = self.slot >= 0
        self.slot_keys[taken] = self.pair_keys[self.slot[taken]]

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair's merge, or -1; ids below 0 have none."""
        keys = left.astype(np.int64) * self.size + right
        keys[(left < 0) | (right < 0)] = -1  # no pair's key, nor that of a free slot
        at = self._home(keys)
        held = self.slot_keys[at]
        hit = held == keys
        out = np.where(hit, self.slot[at], -1).astype(np.int64)
        live = np.flatnonzero(~hit & (held >= 0))
        at, keys = at[live], keys[live]
        while len(live):
            at = (at + 1) & (len(self.slot) - 1)
            held = self.slot_keys[at]
            hit = held == keys
            out[live[hit]] = self.slot[at[hit]]
            go = ~hit & (held >= 0)
            live, at, keys = live[go], at[go], keys[go]
        return out


def place_hash(start, middle, stop) -> np.ndarray:
    """A candidate's place and extent as one hash."""
    place = (np.asarray(start, np.uint64) << _U(42)) ^ (np.asarray(middle, np.uint64) << _U(21)) ^ np.asarray(stop, np.uint64)
    return tb.mix64(np.atleast_1d(place))


def skip_hash(chunk: np.ndarray | int, start, middle, stop) -> np.ndarray:
    """The keyed hash of a candidate; chunk already holds seed, occurrence and content."""
    return tb.mix64(np.atleast_1d(np.asarray(chunk, np.uint64) ^ place_hash(start, middle, stop)))


def agenda(pieces: Pieces, chars: list[int], key: int, rate: float, made: list | None = None) -> list[tuple[int, int, int]]:
    """(id or -1, first, stop character) of the symbols that a chunk of character ids merges to;
    made: takes (start, middle, stop) of every merge."""
    n = len(chars)
    ids, stop, prev, nxt = list(chars), list(range(1, n + 1)), list(range(-1, n - 1)), [*range(1, n), -1]
    limit, heap = int(rate * 2.0**64), []

    def offer(i: int) -> None:
        j = nxt[i] if i >= 0 else -1
        if j < 0 or ids[i] < 0 or ids[j] < 0:
            return
        found = pieces.merges.get(ids[i] * pieces.size + ids[j])
        if found:
            heapq.heappush(heap, (found[1], i, j, stop[j], found[0]))

    for i in range(n - 1):
        offer(i)
    dead = [False] * n
    while heap:
        _, i, j, end, merged = heapq.heappop(heap)
        if dead[i] or dead[j] or nxt[i] != j or stop[j] != end or pieces.merges.get(ids[i] * pieces.size + ids[j], (-1,))[0] != merged:
            continue
        if limit and int(skip_hash(key, i, j, end)[0]) < limit:
            continue
        if made is not None:
            made.append((i, j, end))
        ids[i], stop[i], dead[j], nxt[i] = merged, end, True, nxt[j]
        if nxt[j] >= 0:
            prev[nxt[j]] = i
        offer(prev[i])
        offer(i)
    out, i = [], 0
    while 0 <= i < n:
        out.append((ids[i], i, stop[i]))
        i = nxt[i]
    return out


def _merge_all(pieces: Pieces, ids: np.ndarray, chunk: np.ndarray, first: np.ndarray, keys: np.ndarray, rate: float, made: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges the symbols of many chunks; (id, chunk, first character) of those left; made: takes
    (chunks, place hashes) of the merges.

    ids, chunk, first: of the characters, in order; keys: of the chunks.  Symbols are
    linked lists in arrays; a round takes the best offer of each chunk, the leftmost of
    equals, as the least of rank and place in one number.  Chunks without offers are
    taken out when they are half of all."""
    limit = _U(min(int(rate * 2.0**64), 2**64 - 1))
    none, low = np.int64(NONE), np.int64(2**32 - 1)
    n = len(ids)
    if not n:
        return ids, chunk, first
    sym, own, start = ids.copy(), chunk, first
    last = np.append(own[1:] != own[:-1], True)
    after = np.where(last, -1, np.arange(1, n + 1))
    before = np.where(start == 0, -1, np.arange(-1, n - 1))
    stop = start + 1
    alive = np.ones(n, bool)
    offer, merge = np.full(n, none), np.zeros(n, np.int64)
    done = []

    def look(x: np.ndarray) -> None:
        """Sets the offers of the symbols at x, which all have a next one."""
        y = after[x]
        found = pieces.find(sym[x], sym[y])
        ok = found >= 0
        offer[x[~ok]] = none
        x, y, found = x[ok], y[ok], found[ok]
        if limit:
            stay = skip_hash(keys[own[x]], start[x], stop[x], stop[y]) >= limit
            offer[x[~stay]] = none
            x, found = x[stay], found[stay]
        offer[x] = (pieces.pair_rank[found] << 32) | x
        merge[x] = pieces.pair_ids[found]

    look(np.flatnonzero(after >= 0))
    while len(sym):
        heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        best = np.minimum.reduceat(offer, heads)
        while True:
            live = best != none
            if 2 * np.count_nonzero(live) < len(live) or not live.any():
                break
            x = best[live] & low
            y = after[x]
            if made is not None:
                made.append((own[x], place_hash(start[x], stop[x], stop[y])))
            sym[x], stop[x], after[x] = merge[x], stop[y], after[y]
            alive[y], offer[y], offer[x] = False, none, none
            z = after[x]
            inner = z >= 0
            before[z[inner]] = x[inner]
            w = before[x]
            look(np.concatenate([x[inner], w[w >= 0]]))
            best = np.minimum.reduceat(offer, heads)
        sizes = np.diff(np.append(heads, len(sym)))
        ended = np.repeat(~live, sizes)
        out = ended & alive
        done.append((sym[out], own[out], start[out]))
        keep = ~ended & alive
        moved = np.append(np.cumsum(keep) - 1, -1)  # the last for "none"
        sym, own, start, stop, after, before, offer, merge = (x[keep] for x in (sym, own, start, stop, after, before, offer, merge))
        alive = np.ones(len(sym), bool)
        after, before = moved[after], moved[before]
        offer = np.where(offer == none, none, (offer >> 32 << 32) | np.arange(len(sym)))
    sym, own, start = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.lexsort((start, own))
    return sym[order], own[order], start[order]


def _gather(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(int(counts.sum()))


def _kept(pool: np.ndarray, begin: np.ndarray, count: np.ndarray, keep: np.ndarray, more: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pool, begin, count) of the kept lists and of more, behind them."""
    counts = np.concatenate([count[keep], per])
    held = pool[_gather(begin[keep], count[keep])] if len(keep) else pool[:0]
    return np.concatenate([held, more]), np.cumsum(counts) - counts, counts


class Encoder:
    """Encodes blocks of texts; keeps the segmentations without dropout of recent chunks by content, and their merges."""

    def __init__(self, pieces: Pieces, dropout: Dropout, memory: int = 32 << 20):
        """memory: bytes of kept segmentations beyond which those that a block does not use are dropped."""
        self.pieces, self.dropout, self.memory = pieces, dropout, memory
        self.hasher = tb.Hasher(seed=dropout.seed)
        self.known = np.zeros(0, np.uint64)
        self.pool, self.begin, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.made, self.made_begin, self.made_count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The texts with a space in front of each, chunk starts, and the first chunk of each text."""
        lengths = np.diff(offsets)
        moved = np.concatenate([[0], np.cumsum(lengths + (lengths > 0))])
        out = np.full(moved[-1], 0x20, np.uint8)
        out[_gather(moved[:-1] + 1, lengths)] = data
        start = np.zeros(len(out), bool)
        space, control = out == 0x20, self.pieces.alone[out]
        start[1:] = (space[1:] & ~space[:-1]) | control[1:] | control[:-1]
        start[moved[:-1][lengths > 0]] = True
        at = np.flatnonzero(start)
        return out, at, np.searchsorted(at, moved)

    def _segment(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray, keys: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, count for each chunk, hashes of the merges made, count of these for each chunk)."""
        log: list | None = [] if not rate and self.dropout.rate else None
        where = _gather(starts, stops - starts)
        text = data[where]
        lead = (text & 0xC0) != 0x80
        char = np.flatnonzero(lead)
        own = np.repeat(np.arange(len(starts)), stops - starts)[char]
        size = np.diff(np.append(char, len(text)))
        packed = np.zeros(len(char), np.int64)
        for k in range(4):
            more = size > k
            packed[more] |= text[char[more] + k].astype(np.int64) << (8 * k)
        at = np.minimum(np.searchsorted(self.pieces.char_keys, packed), len(self.pieces.char_keys) - 1)
        ids = np.where(self.pieces.char_keys[at] == packed, self.pieces.char_ids[at], -1).astype(np.int64)
        heads = np.searchsorted(own, np.arange(len(starts) + 1))
        first = np.arange(len(char)) - heads[own]
        long = np.diff(heads) > LONG
        brief = ~long[own]
        parts, chars, owner, firsts = [], ids[brief], own[brief], first[brief]
        cuts = np.searchsorted(owner, np.arange(0, len(starts) + BATCH, BATCH))
        for a, b in zip(cuts, cuts[1:], strict=False):  # arrays that stay in a core's cache
            parts.append(_merge_all(self.pieces, chars[a:b], owner[a:b], firsts[a:b], keys, rate, log))
        sym, chunk, begin = (np.concatenate(x) for x in zip(*parts, strict=True))
        if long.any():
            more = []
            for c in np.flatnonzero(long):
                merges: list = []
                more += [(i, c, a) for i, a, _ in agenda(self.pieces, ids[heads[c] : heads[c + 1]].tolist(), int(keys[c]), rate, merges)]
                if log is not None and merges:
                    log.append((np.full(len(merges), c), place_hash(*np.array(merges).T)))
            extra = np.array(more, np.int64).reshape(-1, 3)
            sym, chunk, begin = np.concatenate([sym, extra[:, 0]]), np.concatenate([chunk, extra[:, 1]]), np.concatenate([begin, extra[:, 2]])
            order = np.lexsort((begin, chunk))
            sym, chunk, begin = sym[order], chunk[order], begin[order]
        # symbols without a piece are single characters: a byte piece for each byte
        place = heads[chunk] + begin
        width = np.where(sym < 0, size[place], 1)
        out = np.repeat(sym, width)
        bare = out < 0
        if bare.any():
            out[bare] = self.pieces.byte_id[text[_gather(char[place[sym < 0]], width[sym < 0])]]
        made, per = np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
        if log:
            of, made = (np.concatenate(x) for x in zip(*log, strict=True))
            made, per = made[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(starts))
        return out.astype(np.int32), np.bincount(chunk, width, len(starts)).astype(np.int64), made, per

    def _plain(self, text: np.ndarray, starts: np.ndarray, stops: np.ndarray, content: np.ndarray) -> np.ndarray:
        """Places in the kept segmentations of the chunks; new contents are segmented and kept."""
        distinct, shown, inverse = np.unique(content, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, distinct), max(len(self.known) - 1, 0))
        old = self.known[at] == distinct if len(self.known) else np.zeros(len(distinct), bool)
        new = np.flatnonzero(~old)
        if len(new):
            ids, count, made, per = self._segment(text, starts[shown[new]], stops[shown[new]], distinct[new], 0.0)
            size = sum(x.nbytes for x in (self.known, self.pool, self.begin, self.count, self.made, self.made_begin, self.made_count))
            keep = np.arange(len(self.known)) if size <= self.memory else np.unique(at[old])
            self.pool, begin, self.count = _kept(self.pool, self.begin, self.count, keep, ids, count)
            self.made, made_begin, self.made_count = _kept(self.made, self.made_begin, self.made_count, keep, made, per)
            known = np.concatenate([self.known[keep], distinct[new]])
            order = np.argsort(known)
            self.known, self.begin, self.made_begin = known[order], begin[order], made_begin[order]
            self.count, self.made_count = self.count[order], self.made_count[order]
        return np.searchsorted(self.known, distinct)[inverse]

    def encode(self, data: np.ndarray, offsets: np.ndarray, doc_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets by text) of texts."""
        text, starts, first = self._cut(data, offsets)
        stops = np.append(starts[1:], len(text))
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        per_doc = np.diff(first)
        ordinal = np.arange(len(starts)) - np.repeat(first[:-1], per_doc)
        content = self.hasher.spans(text, starts, stops)
        at = self._plain(text, starts, stops, content)
        begins, counts, pool = self.begin[at], self.count[at], self.pool
        if self.dropout.rate:
            drawn = tb.mix64(tb.keyed64(np.repeat(doc_ids, per_doc), self.dropout.seed) + ordinal.astype(np.uint64))
            if self.dropout.variants:
                drawn = drawn % _U(self.dropout.variants)
            keys = tb.mix64(content + drawn * _U(0xA0761D6478BD642F))
            per = self.made_count[at]
            limit = _U(min(int(self.dropout.rate * 2.0**64), 2**64 - 1))
            skipped = tb.mix64(np.repeat(keys, per) ^ self.made[_gather(self.made_begin[at], per)]) < limit
            total = np.concatenate([[0], np.cumsum(skipped)])
            stop = np.cumsum(per)
            anew = np.flatnonzero(total[stop] > total[stop - per])
            if len(anew):
                ids, count, _, _ = self._segment(text, starts[anew], stops[anew], keys[anew], self.dropout.rate)
                begins, counts = begins.copy(), counts.copy()
                begins[anew], counts[anew] = len(pool) + np.cumsum(count) - count, count
                pool = np.concatenate([pool, ids])
        ids = pool[_gather(begins, counts)]
        total = np.concatenate([[0], np.cumsum(counts)])
        return ids, total[first]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets by text) of sequences of ids."""
        begin = self.pieces.text_offsets[ids]
        size = self.pieces.text_offsets[ids + 1] - begin
        data = self.pieces.text_data[_gather(begin, size)]
        total = np.concatenate([[0], np.cumsum(size)])
        bounds = total[offsets]
        stay = np.ones(len(data), bool)
        some = bounds[:-1] < bounds[1:]
        stay[bounds[:-1][some]] = False  # the space in front
        return data[stay], bounds - np.concatenate([[0], np.cumsum(some)])


_PIECES: dict[bytes, Pieces] = {}


def encoder(content: bytes, dropout: Dropout) -> Encoder:
    """A task's encoder.  The tables of the model that was used last stay in the worker; segmentations go with the task."""
    key = hashlib.sha256(content).digest()
    if key not in _PIECES:
        _PIECES.clear()
        _PIECES[key] = Pieces(content)
    return Encoder(_PIECES[key], dropout)


ENCODED = "doc_id bigint, n_pieces bigint, ids array<int>, lossless boolean"


def encode(docs: DataFrame, dropout: Dropout = Dropout(), path: str | None = None) -> DataFrame:
    """(ENCODED) for each row of docs(doc_id, text); lossless says that decoding ids gave the text.
    The model file at `path` is read by the driver and broadcast (under a megabyte)."""
    shared = docs.sparkSession.sparkContext.broadcast(model_bytes(path or default_model()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(shared.value, dropout)
        table = tb.whitespace_words()
        for batch in batches:
            for block in tb.blocks(batch.column(1), table, tb.BLOCK_BYTES // 2):
                own = batch.column(0).slice(block.row0, block.n_docs).cast(pa.int64())
                ids, offsets = coder.encode(block.data, block.offsets, own.fill_null(-1).to_numpy(zero_copy_only=False))
                data, bounds = coder.decode(ids, offsets)
                if np.array_equal(bounds, block.offsets) and np.array_equal(data, block.data):
                    same = np.ones(block.n_docs, bool)
                else:
                    same = np.array([data[bounds[d] : bounds[d + 1]].tobytes() == block.text(d) for d in range(block.n_docs)])
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([own, pa.array(np.diff(offsets)), lists, pa.array(same)], ["doc_id", "n_pieces", "ids", "lossless"])

    return docs.select("doc_id", "text").mapInArrow(tb.released(run), ENCODED)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of rows of encode(); null ids give an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(model_bytes(path or default_model()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(shared.value, Dropout())
        for batch in batches:
            lists = batch.column(1)
            counts = np.array([0 if x is None else x for x in lists.value_lengths().to_pylist()], np.int64)
            data, bounds = coder.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(counts)]))
            text = pa.StringArray.from_buffers(len(counts), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
            yield pa.RecordBatch.from_arrays([batch.column(0), text], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
