"""Quality rules from repetition: a suffix array and its LCP intervals per document.

The words of a text are the symbols, in any fixed order.  Prefix doubling sorts the
suffixes of all texts of a block at once, text by text; classes of one suffix are settled
and leave, so after the first rounds only repeated suffixes are sorted.  Adjacent
suffixes' longest common prefixes follow from the ranks of each round.  A suffix's
longest repeat is the larger of its two neighbours' values, and those that cannot be
extended to the left are the maximal repeated substrings.

Edge cases: null and empty texts have no words and fail the base rule; ties and
repeated rows are judged row by row; an empty table gives an empty result; other
columns of the input are ignored by `repetition_report` and kept by `quality_filter`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textblocks as tb

#: Words of a window of the base rule.
WINDOW = 8


@dataclass(frozen=True)
class RepetitionRules:
    """Limits: min_words and max_repeat_percent are the base rule; a text also goes if
    repeats of at least min_repeat words cover more than max_covered_percent of its
    words, or if one repeat is longer than max_longest words (ValueError if min_repeat < 1 or max_longest < 0)."""

    min_words: int = 20
    max_repeat_percent: int = 30
    min_repeat: int = 10
    max_covered_percent: int = 25
    max_longest: int = 60

    def __post_init__(self):
        if self.min_repeat < 1 or self.max_longest < 0:
            raise ValueError("min_repeat must be 1 or more, max_longest 0 or more")

    def floor(self) -> int:
        """The largest power of two that no length which a rule asks for is below."""
        return 1 << (min(WINDOW, self.min_repeat, self.max_longest + 1).bit_length() - 1)


REPORT = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, n_covered_words bigint, longest_repeat bigint"


def _refined(rank: np.ndarray, sub: np.ndarray, k: int, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks by 2k words from ranks by k words, and the places whose class still has others.

    sub: places of the classes of more than one, in suffix order.  A rank is the place of
    its class's first member in suffix order, so classes that are settled keep theirs."""
    after = sub + k
    second = np.where(after < stop[sub], rank[np.minimum(after, len(rank) - 1)], -1)
    key = rank[sub].astype(np.int64) * (len(rank) + 1) + second + 1
    order = np.argsort(key, kind="stable")
    sub, key, old = sub[order], key[order], rank[sub[order]]
    fresh = np.concatenate([[True], key[1:] != key[:-1]])
    head = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), np.arange(len(sub)), 0))
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(sub)), 0))
    rank = rank.copy()
    rank[sub] = old + (first - head)
    alone = fresh & np.concatenate([fresh[1:], [True]])
    return rank, sub[~alone]


def suffix_repeats(block: tb.Block, words: np.ndarray, floor: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(positions, length): for each suffix that shares `floor` words (a power of two) or more with another
    suffix of its text, the length in words of its longest repeated prefix."""
    n = block.n_words
    none = np.zeros(0, np.int64)
    if n < floor + 1:
        return none, none
    doc = block.doc_of_word()
    stop = block.first[doc + 1]
    _, kind = np.unique(words, return_inverse=True)
    key = doc.astype(np.int64) * (kind.max() + 1) + kind
    sub = np.argsort(key, kind="stable")
    fresh = np.concatenate([[True], key[sub[1:]] != key[sub[:-1]]])
    rank = np.zeros(n, np.int64)
    rank[sub] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    sub = sub[~(fresh & np.concatenate([fresh[1:], [True]]))]
    levels, k = [(1, rank)], 1
    pos = sub
    while len(sub):
        rank, sub = _refined(rank, sub, k, stop)
        k *= 2
        levels.append((k, rank))
        if k == floor:
            pos = sub
    if k < floor or not len(pos):
        return none, none
    sa = pos[np.argsort(rank[pos])]
    a, b = sa[:-1], sa[1:]
    lcp = np.zeros(len(a), np.int64)
    near = dict(levels)[floor]
    live = near[a] == near[b]
    for k, rank in reversed(levels):
        i, j = a + lcp, b + lcp
        room = live & (i + k <= stop[a]) & (j + k <= stop[b])
        lcp[room & (rank[np.minimum(i, n - 1)] == rank[np.minimum(j, n - 1)])] += k
    longest = np.zeros(len(sa), np.int64)
    longest[:-1] = lcp
    longest[1:] = np.maximum(longest[1:], lcp)
    back = np.argsort(sa)
    return sa[back], longest[back]


def maximal_repeats(pos: np.ndarray, longest: np.ndarray) -> np.ndarray:
    """Mask of the suffixes whose repeat does not also extend one word to the left."""
    extended = np.zeros(len(pos), bool)
    extended[1:] = (pos[1:] == pos[:-1] + 1) & (longest[:-1] == longest[1:] + 1)
    return ~extended


_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


def _duplicate_lines(text: bytes) -> int:
    seen, again = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            again += 1
        elif line and line.split(None, 1):
            seen.add(line)
    return again


def measure(block: tb.Block, hasher: tb.Hasher, rules: RepetitionRules) -> dict[str, np.ndarray]:
    """The columns of REPORT but doc_id, for the texts of a block."""
    words = hasher.spans(block.data, block.starts, block.ends)
    n_words = np.diff(block.first)
    chars = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOLS[block.data])])
    pos, longest = suffix_repeats(block, words, rules.floor())
    wide = pos[longest >= WINDOW]
    repeated = tb.covered(wide, np.full(len(wide), WINDOW), block.n_words)
    enough = longest >= rules.min_repeat
    spans = enough & maximal_repeats(pos, longest)
    cover = tb.covered(pos[spans], longest[spans], block.n_words)
    top = np.zeros(block.n_docs, np.int64)
    np.maximum.at(top, np.searchsorted(block.first, pos, "right") - 1, longest)
    out = {
        "n_words": n_words,
        "word_chars": tb.per_doc_sum(chars[block.ends] - chars[block.starts], block.first),
        "n_symbols": symbols[block.offsets[1:]] - symbols[block.offsets[:-1]],
        "n_dup_lines": np.array([_duplicate_lines(block.text(d)) for d in range(block.n_docs)], np.int64),
        "n_repeat_words": tb.per_doc_sum(repeated, block.first),
        "n_covered_words": tb.per_doc_sum(cover, block.first),
        "longest_repeat": top,
    }
    out["base_failed"] = (n_words < rules.min_words) | (100 * out["n_repeat_words"] > rules.max_repeat_percent * n_words)
    out["kept"] = ~out["base_failed"] & (100 * out["n_covered_words"] <= rules.max_covered_percent * n_words) & (top <= rules.max_longest)
    return out


def repetition_report(docs: DataFrame, rules: RepetitionRules = RepetitionRules()) -> DataFrame:
    """One row of measures and verdicts (REPORT) for each row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, table = tb.Hasher(), tb.whitespace_words()
        for batch in batches:
            for block in tb.blocks(batch.column(1), table):
                found = measure(block, hasher, rules)
                ids = batch.column(0).slice(block.row0, block.n_docs)
                names = [x.split()[0] for x in REPORT.split(", ")][1:]
                yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), *(pa.array(found[x]) for x in names)], ["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(tb.released(run), REPORT)


def quality_filter(docs: DataFrame, rules: RepetitionRules = RepetitionRules(), text: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, all columns unchanged; a map without a shuffle."""
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, table = tb.Hasher(), tb.whitespace_words()
        for batch in batches:
            kept = [measure(block, hasher, rules)["kept"] for block in tb.blocks(batch.column(place), table)]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names may hold what a path may not
    return plain.mapInArrow(tb.released(run), plain.schema).toDF(*docs.columns)
