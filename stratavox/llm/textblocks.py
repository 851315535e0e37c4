"""Vectorised word scanning over Arrow text columns, shared by the text operators.

A batch of documents is cut into blocks of bounded size.  In a block, words are
runs of bytes of a class (a 256-entry table), found with NumPy on the column's
UTF-8 buffer, without creating a Python object per word.  A word's hash is the
64-bit value of a polynomial over its bytes, taken from one prefix sum per block.

Memory for a block is about 60 bytes per byte of text, so `BLOCK_BYTES` bounds a
worker at any table size; a single longer text makes a block of its own.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2 << 20

_U = np.uint64
_MULTIPLIER = _U(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def keyed64(x: np.ndarray, seed: int) -> np.ndarray:
    """mix64 of integers under a seed."""
    with np.errstate(over="ignore"):
        return mix64(np.asarray(x).astype(np.uint64) + _U((seed * 0x9E3779B97F4A7C15 + 0x1234567) & (2**64 - 1)))


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def whitespace_words() -> np.ndarray:
    """Byte class of words `[^\\x20\\x09-\\x0D]+`."""
    table = np.ones(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


def alnum_words() -> np.ndarray:
    """Byte class of words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`, A-Z taken as a-z."""
    table = np.zeros(256, bool)
    table[0x30:0x3A] = table[0x41:0x5B] = table[0x61:0x7B] = True
    table[0x80:] = True
    return table


class Hasher:
    """Hashes of byte spans of a buffer; with lower=True A-Z count as a-z."""

    def __init__(self, lower: bool = False, seed: int = 1):
        values = keyed64(np.arange(256), seed) | _U(1)
        if lower:
            values[0x41:0x5B] = values[0x61:0x7B]
        self.values = values
        self.power = np.ones(1, np.uint64)
        self.unpower = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if n >= len(self.power):
            size = max(n + 1, BLOCK_BYTES + 1024)
            self.power = np.full(size, _MULTIPLIER)
            self.unpower = np.full(size, _U(_inverse(int(_MULTIPLIER))))
            self.power[0] = self.unpower[0] = 1
            np.cumprod(self.power, out=self.power)
            np.cumprod(self.unpower, out=self.unpower)

    def spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of data[start:end] for each span; equal bytes give equal hashes."""
        n = len(data)
        self._grow(n)
        prefix = np.zeros(n + 1, np.uint64)
        np.multiply(self.values[data], self.power[:n], out=prefix[1:])
        np.cumsum(prefix, out=prefix)
        return mix64((prefix[ends] - prefix[starts]) * self.unpower[starts])


class Block:
    """The texts of some rows: their bytes, and the words in them.

    ids: the rows' key column (Arrow), rows: their places in the batch.
    starts, ends: byte spans of words; first: words[first[d]:first[d + 1]] are of text d.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, row0: int, table: np.ndarray):
        self.data, self.offsets, self.row0 = data, offsets, row0
        self.n_docs = len(offsets) - 1
        inside = table[data]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        close = inside.copy()
        close[:-1] &= ~inside[1:]
        edge = offsets[:-1][offsets[:-1] < offsets[1:]]
        begin[edge] = inside[edge]
        last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        close[last] = inside[last]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(close) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.n_words = len(self.starts)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), np.diff(self.first))

    def ngrams(self, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-word windows that lie in one text, and the index of their first word."""
        if self.n_words < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        doc = self.doc_of_word()
        at = np.flatnonzero(doc[: self.n_words - n + 1] == doc[n - 1 :])
        return ngram_hash(words, at, n), at

    def text(self, d: int) -> bytes:
        return self.data[self.offsets[d] : self.offsets[d + 1]].tobytes()


def ngram_hash(words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(len(at), np.uint64)
    for j in range(n):
        out = (out + words[at + j]) * _U(0xD6E8FEB86659FD93)
        out ^= out >> _U(32)
    return mix64(out)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array, table: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of consecutive rows of at most `size` bytes (one row at least)."""
    data, offsets = utf8(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        stop = int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1
        stop = min(max(stop, row + 1), n)
        yield Block(data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row], row, table)
        row = stop


def released(run):
    """A task's function that gives its freed memory back to the system at its end: Spark keeps its Python
    workers, and what an idle one holds counts against its executor."""

    @functools.wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return task


def per_doc_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[d]:first[d + 1]] for each d."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Mask of the n positions that lie in any span [start, start + length)."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + lengths, n), -1)
    return np.cumsum(step[:-1]) > 0
