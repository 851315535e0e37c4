"""Language-model scoring by a hierarchical Pitman-Yor model over words.

Each context (the word before, or the start of the text) is a restaurant over the
next token; all share one parent restaurant over tokens, whose base is uniform over the
training vocabulary and one unknown token.  A customer is a training token in its
context; a table sends one customer to the parent.  Table counts are sampled by Gibbs:
a step draws all tables of every dish from their conditional (generalized Stirling numbers,
exact for small counts and by saddle point for large ones) given a gamma variable of its restaurant's
tables, which makes the dishes independent.  Steps start from the tables that sequential seating
expects.  Levels are sampled in turn, `turns` times: the parent from one
table a dish at first, the contexts given the parent, the parent from their tables, and so on.
Predictive probabilities are averaged: the parent's over its samples of all turns but the first, the contexts'
over their last steps (given the parent, the average needs only the mean number of tables).

Everything that is counted covers all training texts.  Word pairs are exchanged as
packed arrays by bucket of the context; contexts that hold more than a share of
all tokens (at most HOT_MOST of them) are spread over buckets by the next word, and share
their totals.  Parent probabilities are asked for and sent back in packed arrays by
bucket as well, so nothing that grows with the corpus is broadcast or held by
the driver.  Words are told apart by 64-bit hashes; a token to be scored names its pair to the bucket
that holds it by 56 bits of the pair's hash.

Edge cases: null and empty texts are one end token; rows are scored each by itself,
repeated doc_ids included; a null doc_id is hashed as the empty text; without training texts every
token is unknown; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import gc
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textblocks as tb
from .blobs import ascending, from_ascending, from_planes, pack, planes, spread, unpack
from .storage import drop_scratch, input_bytes, partitions_for, scratch

_U = np.uint64
BEGIN, END = _U(0x5107A2B3C4D5E6F7), _U(0xE9D0123456789ABC)
ROWS = "kind int, bucket int, payload binary, name bigint, a bigint, b bigint"
PAIRS, ASKED, STATS, ANSWER, SEEN = 0, 1, 2, 3, 9
#: Names of totals in STATS rows; hot contexts have their hash.
TOKENS, SINGLE, KNOWN, PARENT = 1, 2, 3, 4
#: Contexts spread over buckets at most: the list of them goes to every task.
HOT_MOST = 20_000


@dataclass(frozen=True)
class PitmanYor:
    """discount, strength: of the context restaurants (discount None: n1 / (n1 + 2 n2) of
    all pair counts); parent_*: of the parent; turns: alternations of the levels; burn, keep: Gibbs steps of
    the contexts' last turn; turn_burn, turn_keep: of the others; bucket_bytes: of
    scanned input for a bucket; flush: tokens packed together by a task."""

    discount: float | None = None
    strength: float = 1.0
    parent_discount: float = 0.75
    parent_strength: float = 10.0
    turns: int = 4
    burn: int = 4
    keep: int = 6
    turn_burn: int = 2
    turn_keep: int = 1
    seed: int = 5
    bucket_bytes: int = 8 << 20
    flush: int = 2_000_000
    splits: int = 64


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


# ---- seating -------------------------------------------------------------------------

#: Table counts up to COLUMNS are summed one by one, for dishes whose expectation is at most ENUMERATED;
#: rows of the ratio table are exact to ROWS_EXACT customers and by contour integrals from there on.
ENUMERATED, COLUMNS, ROWS_EXACT, ROW_STEP = 128, 256, 1024, 1.25


@lru_cache(maxsize=8)
def _exact_ratios(d: float) -> np.ndarray:
    """V[c, t] = S(c, t + 1) / S(c, t) of the generalized Stirling numbers of discount d, by their recurrence."""
    v = np.zeros((ROWS_EXACT + 1, COLUMNS + 1))
    t = np.arange(1, COLUMNS + 1)
    for n in range(1, ROWS_EXACT):
        before = np.zeros(COLUMNS)
        np.divide(1.0, v[n, 1:-1], out=before[1:], where=v[n, 1:-1] > 0)
        k = min(n, COLUMNS)
        v[n + 1, 1 : k + 1] = (1 + (n - d * (t[:k] + 1)) * v[n, 1 : k + 1]) / (before[:k] + n - d * t[:k])
    return v


@lru_cache(maxsize=512)
def _wide_ratios(d: float, step: int) -> np.ndarray:
    """log V[t] at ROWS_EXACT * ROW_STEP ** step customers.

    S(c, t) = c! / t! [z^c] ((1 - (1 - z)^d) / d)^t, integrated over a parabola in -log z that
    crosses the real axis at the saddle point."""
    c, t = ROWS_EXACT * ROW_STEP**step, np.arange(1, COLUMNS + 2)[:, None]
    lo, hi = np.full(t.shape, -60.0 / (1 - d)), np.zeros(t.shape)
    for _ in range(60):  # t d (1 - u) u^(d - 1) / (1 - u^d) = c by log u
        mid = (lo + hi) / 2
        above = np.log(t * -np.expm1(mid) * d) + (d - 1) * mid - np.log(-np.expm1(d * mid)) > np.log(c)
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    m = np.maximum(-np.log1p(-np.exp(lo)), 4 / c)
    x = (np.arange(96) + 0.5) / 96 * np.minimum(np.sqrt(40 / (2 * (1 - d) * c * m)), 4.0)
    z = m * (1 + 1j * x) ** 2
    g = c * z + t * np.log(-np.expm1(d * np.log(-np.expm1(-z))) / d)
    top = g.real[:, :1]
    total = (np.exp(g - top) * (1 + 1j * x)).real.sum(1) * m[:, 0] * x[:, 0]
    logs = np.log(total) + top[:, 0]
    return np.concatenate([[0.0], np.diff(logs) - np.log(t[1:, 0])])


def _expected(c: np.ndarray, a: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of the tables of c customers, for many tables: with c = a (1 - u) u^(d - 1),
    (a / d) (1 - u^d) tables, which without a discount is a log(1 + c / a)."""
    y = -np.log1p(c / a)  # log u; the root lies below, and steps from it rise to the root's left at most once
    wanted = np.log(c / a)
    for _ in range(30):
        f = np.log(-np.expm1(y)) + (d - 1) * y - wanted
        y = np.minimum(y - f / (np.exp(y) / np.expm1(y) + d - 1), -1e-15)
        if np.abs(f).max(initial=0) < 1e-9:
            break
    u = np.exp(y)
    mean = a * -np.expm1(d * y) / d
    return np.clip(mean, 1, c), np.maximum(mean - a * np.exp(d * y) * (1 - u) / (u + (1 - d) * (1 - u)), 0)


def _enumerated(c: np.ndarray, a: np.ndarray, d: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Mean and a draw of the number of tables t, of probability in proportion to S(c, t) a^t."""
    mean, drawn = np.ones(len(c)), np.ones(len(c), np.int64)
    wide = c > ROWS_EXACT
    exact = _exact_ratios(d)
    at = np.where(wide, np.log(np.maximum(c, ROWS_EXACT) / ROWS_EXACT) / np.log(ROW_STEP), 0.0)
    row = at.astype(np.int64)
    logs = np.stack([_wide_ratios(d, k) for k in range(int(row.max(initial=0)) + 2)]) if wide.any() else None
    for some in (np.flatnonzero(~wide), np.flatnonzero(wide)):
        w, total, first = np.ones(len(some)), np.ones(len(some)), np.ones(len(some))
        for t in range(1, COLUMNS + 1):
            if not len(some):
                break
            if wide[some[0]]:
                k, f = row[some], at[some] - row[some]
                ratio = np.exp((1 - f) * logs[k, t] + f * logs[k + 1, t])
            else:
                ratio = exact[c[some], t]
            x = a[some] * ratio
            w = w * x
            total, first = total + w, first + w * (t + 1)
            chosen = rng.random(len(some)) * total < w
            drawn[some[chosen]] = t + 1
            going = (w > 1e-9 * total) | (x > 0.9)
            going &= (c[some] > t + 1) & (t < COLUMNS)
            done = ~going
            mean[some[done]] = first[done] / total[done]
            some, w, total, first = some[going], w[going], total[going], first[going]
            w, total, first = w / total, np.ones(len(some)), first / total
    return mean, drawn


def seat(c: np.ndarray, r: np.ndarray, n_r: int, p: np.ndarray, other: np.ndarray, discount: float, strength: float, rng: np.random.Generator, burn: int, keep: int, grow: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(mean tables, last tables) of dishes with c customers in restaurants r.

    p: parent probability of each dish; other: tables of each restaurant that stand
    elsewhere (grow: one a dish, to be taken to grow as those here do).  A step draws a
    gamma variable of each restaurant's tables, given which dishes are independent, and then all of a dish's tables."""
    tables = np.minimum(c, 1)
    many = np.flatnonzero(c >= 2)
    if not len(many):
        return tables.astype(float), tables
    cm, rm, d = c[many], r[many], max(float(discount), 1e-6)
    pm = np.maximum(p[many], 1e-300)
    dishes = np.bincount(r, tables, n_r)
    alone = dishes - np.bincount(rm, minlength=n_r)
    large = np.flatnonzero(cm > ENUMERATED)

    def held(t: np.ndarray) -> np.ndarray:
        here = alone + np.bincount(rm, t, n_r)
        return here + (other * here / np.maximum(dishes, 1) if grow else other)

    # start: the tables that sequential seating opens, at their fixed point
    t = np.ones(len(many))
    for _ in range(40):
        before = held(t)
        t, _ = _expected(cm, (strength + d * before[rm]) * pm, d)
        if np.abs(held(t) - before).max() <= 1e-2 * max(1.0, before.max()):
            break
    total, last = np.zeros(len(many)), tables.copy()
    for step in range(burn + keep):
        a = d * rng.gamma(strength / d + held(t))[rm] * pm
        mean, t = np.empty(len(many)), np.empty(len(many), np.int64)
        about, var = _expected(cm[large], a[large], d)
        big = large[about > ENUMERATED]
        about, var = about[about > ENUMERATED], var[about > ENUMERATED]
        mean[big] = about
        t[big] = np.clip(np.rint(rng.normal(about, np.sqrt(var))), 1, cm[big])
        small = np.ones(len(many), bool)
        small[big] = False
        small = np.flatnonzero(small)
        mean[small], t[small] = _enumerated(cm[small], a[small], d, rng)
        if step >= burn:
            total += mean
    mean = tables.astype(float)
    mean[many], last[many] = total / keep, t
    return mean, last


# ---- packed words --------------------------------------------------------------------


def _planes(x: np.ndarray, size: int) -> list[np.ndarray]:
    """The low `size` bytes of integers, byte by byte: planes of like bytes compress well."""
    flat = np.ascontiguousarray(x).astype("<u8").view(np.uint8).reshape(-1, 8)
    return [np.ascontiguousarray(flat[:, k]) for k in range(size)]


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(parts[0]), 8), np.uint8)
    for k, plane in enumerate(parts):
        out[:, k] = plane
    return out.view("<u8").ravel().astype(np.uint64)


def _pair_key(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """56 bits that name a pair within its bucket."""
    return tb.mix64(u ^ tb.mix64(w)) >> _U(8)


def _row(kind: int, bucket: int, payload: bytes | None, name: int = 0, a: int = 0, b: int = 0) -> tuple:
    return kind, bucket, payload, name, a, b


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["kind", "bucket", "payload", "name", "a", "b"])


def _given(rows: Iterator[tuple], size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += 100 + len(row[2] or b"")
        if n > size:
            yield _batch(held)
            held, n = [], 0
    if held:
        yield _batch(held)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """(bucket, its rows one by one as (kind, payload)); the rows of a bucket must be used up first."""
    import itertools

    flat = ((b.column(1)[i].as_py(), b.column(0)[i].as_py(), b.column(2)[i].as_py()) for b in batches for i in range(b.num_rows))
    for bucket, rows in itertools.groupby(flat, lambda x: x[0]):
        yield bucket, ((kind, payload) for _, kind, payload in rows)


def _pairs(block: tb.Block, hasher: tb.Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, next token, document) of every token of a block, ends included."""
    words = hasher.spans(block.data, block.starts, block.ends)
    doc = block.doc_of_word()
    n = block.n_words + block.n_docs
    u, w, d = np.full(n, BEGIN), np.full(n, END), np.zeros(n, np.int64)
    at = np.arange(block.n_words) + doc
    w[at], u[at + 1] = words, words
    d[at], d[block.first[1:] + np.arange(block.n_docs)] = doc, np.arange(block.n_docs)
    return u, w, d


class _Buckets:
    """Where a pair goes: by its context, a hot one's also by the next word."""

    def __init__(self, n: int, hot: np.ndarray, splits: int):
        self.n, self.hot, self.splits = n, hot, splits

    def of(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        key = u
        if len(self.hot):
            near = np.minimum(np.searchsorted(self.hot, u), len(self.hot) - 1)
            key = np.where(self.hot[near] == u, tb.mix64(u + (w % _U(self.splits) + _U(1)) * _U(0xC2B2AE3D27D4EB4F)), u)
        return (tb.mix64(key) % _U(self.n)).astype(np.int64)


class _Packer:
    """A task's pairs, sorted by bucket, context and next word, and packed."""

    def __init__(self, buckets: _Buckets, with_docs: bool):
        self.buckets, self.with_docs, self.parts, self.size = buckets, with_docs, [], 0

    def add(self, u: np.ndarray, w: np.ndarray, x: np.ndarray) -> None:
        """x: the document's number in the flush, or 1 for training tokens and 0 for others."""
        self.parts.append((u, w, x.astype(np.uint32)))
        self.size += len(u)

    def out(self, flush: int) -> Iterator[tuple]:
        if not self.parts:
            return
        u, w, x = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        self.parts, self.size = [], 0
        bucket = self.buckets.of(u, w)
        if self.with_docs:
            yield from self._tokens(bucket, _pair_key(u, w), x, flush)
            return
        # one sort: runs of equal pairs, split at worst where shortened hashes meet
        key = (bucket.astype(np.uint64) % _U(1 << 12) << _U(52)) | (tb.mix64(u) >> _U(36) << _U(24)) | (w & _U(0xFFFFFF))
        order = np.argsort(key)
        if self.buckets.n > 1 << 12:
            order = order[np.argsort(bucket[order], kind="stable")]
        u, w, x, bucket = u[order], w[order], x[order], bucket[order]
        fresh = np.concatenate([[True], (u[1:] != u[:-1]) | (w[1:] != w[:-1]) | (bucket[1:] != bucket[:-1])])
        pair = np.flatnonzero(fresh)
        count = np.diff(np.append(pair, len(u)))
        pu, pb = u[pair], bucket[pair]
        run = np.flatnonzero(np.concatenate([[True], (pu[1:] != pu[:-1]) | (pb[1:] != pb[:-1])]))
        width = np.diff(np.append(run, len(pair)))
        cuts = np.flatnonzero(np.concatenate([[True], pb[1:] != pb[:-1]]))
        for a, b in zip(cuts, np.append(cuts[1:], len(pair)), strict=True):
            i, j = np.searchsorted(run, [a, b])
            lo, hi = pair[a], pair[b] if b < len(pair) else len(u)
            head = [pu[run[i:j]], planes(width[i:j].astype(np.uint32)), w[pair[a:b]]]
            payload = pack(*head, planes(np.add.reduceat(x[lo:hi], pair[a:b] - lo).astype(np.uint32)))
            yield _row(SEEN, int(pb[a]), payload)

    @staticmethod
    def _tokens(bucket: np.ndarray, key: np.ndarray, x: np.ndarray, flush: int) -> Iterator[tuple]:
        """For each bucket, its pairs by key, how often each occurs, and the documents."""
        order = np.argsort((bucket.astype(np.uint64) % _U(1 << 12) << _U(52)) | (key >> _U(4)))
        if bucket.max() >= 1 << 12:
            order = order[np.argsort(bucket[order], kind="stable")]
        bucket, key, x = bucket[order], key[order], x[order]
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])])
        pair = np.flatnonzero(fresh)
        count = np.diff(np.append(pair, len(key)))
        cuts = np.flatnonzero(np.concatenate([[True], bucket[pair[1:]] != bucket[pair[:-1]]]))
        for a, b in zip(cuts, np.append(cuts[1:], len(pair)), strict=True):
            lo, hi = pair[a], pair[b] if b < len(pair) else len(key)
            steps = np.diff(key[pair[a:b]], prepend=_U(0))  # keys ascend but for their last bits: steps are taken modulo 2^56
            payload = pack(np.array([flush], np.int64), *_planes(steps, 7), planes(count[a:b].astype(np.uint32)), *_planes(x[lo:hi], 4))
            yield _row(SEEN, int(bucket[lo]), payload)


def _asked(bucket: int, w: np.ndarray, t: np.ndarray, n: int) -> Iterator[tuple]:
    """The tables that a bucket's dishes send to the parent, by range of the word's hash."""
    to = (((w >> _U(32)) * _U(n)) >> _U(32)).astype(np.int64)
    cuts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
    for a, b in zip(cuts, np.append(cuts[1:], len(w)), strict=True):
        yield _row(ASKED, int(to[a]), pack(np.array([bucket], np.int64), ascending(w[a:b]), planes(t[a:b].astype(np.uint32))))


@dataclass
class _Restaurants:
    """The context restaurants of a bucket: pairs sorted by context, then next word."""

    u: np.ndarray
    width: np.ndarray
    dish: np.ndarray
    c: np.ndarray
    w: np.ndarray

    @classmethod
    def load(cls, payload: bytes) -> _Restaurants:
        u, *counts, w = unpack(payload)
        return cls(from_ascending(u), *(from_planes(x, np.uint32).astype(np.int64) for x in counts), from_ascending(w))

    def dump(self) -> bytes:
        return pack(ascending(self.u), *(planes(x.astype(np.uint32)) for x in (self.width, self.dish, self.c)), ascending(self.w))

    def context(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.u)), self.width)


@dataclass(frozen=True)
class _Totals:
    """What all tasks must know; its size is bounded by the list of hot contexts."""

    tokens: int = 0
    vocabulary: int = 0
    ends: int = 0
    discount: float = 0.75
    parents: tuple = ()  # (customers, tables) of the parent's samples
    hot: tuple = ()  # arrays of hash, customers, tables; sorted by hash

    def parent(self, less: np.ndarray, rules: PitmanYor, sample: int = 0) -> np.ndarray:
        """Parent probabilities, in a sample, of dishes with `less` customers less discounts."""
        customers, tables = self.parents[sample]
        base = (rules.parent_strength + rules.parent_discount * tables) / (self.vocabulary + 1)
        return (less + base) / (customers + rules.parent_strength)

    def shared(self, u: np.ndarray, local_c: np.ndarray, local_t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables that restaurants have in other buckets."""
        c, t = np.zeros(len(u), np.int64), np.zeros(len(u), np.int64)
        if self.hot:
            names, customers, tables = self.hot
            near = np.minimum(np.searchsorted(names, u), len(names) - 1)
            hit = names[near] == u
            c[hit], t[hit] = np.maximum(customers[near[hit]] - local_c[hit], 0), np.maximum(tables[near[hit]] - local_t[hit], 0)
        return c, t


# ---- jobs ----------------------------------------------------------------------------


def _first_look(docs: DataFrame, n_buckets: int) -> tuple[np.ndarray, int, int]:
    """(hot contexts, training tokens, training texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, table = tb.Hasher(lower=True), tb.whitespace_words()
        for batch in batches:
            train = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            for block in tb.blocks(batch.column(1), table):
                u, _, d = _pairs(block, hasher)
                here = train[block.row0 : block.row0 + block.n_docs]
                names, n = np.unique(u, return_counts=True)
                often = n > max(1, len(u) // (8 * n_buckets))
                yield pa.RecordBatch.from_arrays([pa.array(np.append(names[often].view(np.int64), [TOKENS, KNOWN])), pa.array(np.append(n[often], [here[d].sum(), here.sum()]))], ["name", "n"])

    counts = docs.mapInArrow(run, "name bigint, n bigint").groupBy("name").agg(F.sum("n").alias("n"))
    # the totals come first, so that the bound on the words leaves them in
    counts = counts.orderBy(F.col("name").isin(TOKENS, KNOWN).desc(), F.col("n").desc(), "name").limit(2 * min(2 * n_buckets, HOT_MOST) + 2)
    found = {r.name: r.n for r in counts.collect()}
    tokens, texts = found.pop(TOKENS, 0), found.pop(KNOWN, 0)
    hot = [k for k, n in found.items() if n > max(1000, tokens // min(2 * n_buckets, HOT_MOST))]
    return np.sort(np.array(hot, np.int64).view(np.uint64)), int(tokens), int(texts)


def _by_bucket(rows: DataFrame, partitions: int) -> DataFrame:
    return spread(rows.select("kind", "bucket", "payload"), partitions).sortWithinPartitions("bucket", "kind")


class _Jobs:
    def __init__(self, docs: DataFrame, rules: PitmanYor):
        self.rules, self.spark = rules, docs.sparkSession
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~is_held_out(F.col("doc_id"))).alias("train"), "text")
        self.partitions = partitions_for(docs, rules.bucket_bytes)
        self.n = int(max(1, min(self.partitions, input_bytes(docs) // rules.bucket_bytes + 1)))
        self.paths: list[str] = []

    def keep(self, df: DataFrame, name: str) -> str:
        path = scratch(self.spark, name)
        df.write.partitionBy("kind").parquet(path)
        self.paths.append(path)
        del df
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()  # lets Spark drop the finished exchange's files
        return path

    def read(self, path: str | list[str], *kinds: int) -> DataFrame:
        found = self.spark.read.schema(ROWS)
        found = found.parquet(path) if isinstance(path, str) else functools.reduce(DataFrame.unionByName, [found.parquet(p) for p in path])
        return found.filter(F.col("kind").isin(*kinds)).select("kind", "bucket", "payload", "name", "a", "b")

    def totals(self, path: str) -> dict[int, tuple[int, int]]:
        """Sums of STATS rows; as many as there are hot contexts and named totals."""
        rows = self.read(path, STATS).groupBy("name").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect()
        return {r.name: (r.a, r.b) for r in rows}

    def collect_pairs(self, buckets: _Buckets) -> str:
        rules, n = self.rules, self.n

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hasher, table, packer = tb.Hasher(lower=True), tb.whitespace_words(), _Packer(buckets, False)
            for batch in batches:
                train = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
                for block in tb.blocks(batch.column(1), table):
                    u, w, d = _pairs(block, hasher)
                    packer.add(u, w, train[block.row0 + d])
                    if packer.size > rules.flush:
                        yield from _given(packer.out(0))
            yield from _given(packer.out(0))

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows(bucket: int, parts: Iterator[tuple[int, bytes]]) -> Iterator[tuple]:
                held, size = [], 0
                for _, payload in parts:
                    u, width, w, c = unpack(payload)
                    c = from_planes(c, np.uint32).astype(np.int64)
                    held.append((np.repeat(u, from_planes(width, np.uint32)), w, c))
                    size += len(c)
                    if size > 4_000_000:  # counts of equal pairs are summed as they come
                        held = [_summed(held)]
                        size = len(held[0][0])
                u, w, c = _summed(held)
                run = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
                words, dish = np.unique(w, return_inverse=True)
                place = _Restaurants(u[run], np.diff(np.append(run, len(u))), dish, c, words)
                yield _row(PAIRS, bucket, place.dump())
                yield from _asked(bucket, words, np.bincount(dish, c > 0, len(words)), n)
                customers = np.add.reduceat(c, run)
                tables = np.add.reduceat((c > 0).astype(np.int64), run)
                hot = np.isin(place.u, buckets.hot)
                for k in np.flatnonzero(hot):
                    yield _row(STATS, bucket, None, int(place.u[k].view(np.int64)), int(customers[k]), int(tables[k]))
                yield _row(STATS, bucket, None, SINGLE, int((c == 1).sum()), int((c == 2).sum()))
                yield _row(STATS, bucket, None, KNOWN, int(((customers > 0) & ~hot & (place.u != BEGIN)).sum()))
                yield _row(STATS, bucket, None, PARENT, int((c > 0).sum()))

            for bucket, parts in _stream(batches):
                yield from _given(rows(bucket, parts))

        sent = self.docs.select("train", "text").mapInArrow(send, ROWS)
        return self.keep(_by_bucket(sent, self.partitions).mapInArrow(merge, ROWS), "pairs")

    def seat_parent(self, asked: str, totals: _Totals, turn: int) -> str:
        """Seats the parent's customers; answers each bucket with its dishes' customers less discounts."""
        rules = self.rules

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows(part: int, parts: Iterator[tuple[int, bytes]]) -> Iterator[tuple]:
                got = [unpack(p) for _, p in parts]
                w = np.concatenate([from_ascending(x[1]) for x in got])
                t = np.concatenate([from_planes(x[2], np.uint32) for x in got]).astype(np.int64)
                words, dish = np.unique(w, return_inverse=True)
                c = np.bincount(dish, t, len(words)).astype(np.int64)
                known = int((c > 0).sum())
                rng = np.random.default_rng([rules.seed, part, 1, turn])
                p = np.full(len(words), 1 / (totals.vocabulary + 1))
                mean, last = seat(c, np.zeros(len(words), np.int64), 1, p, np.array([max(0, totals.vocabulary - known)]), rules.parent_discount, rules.parent_strength, rng, rules.turn_burn, rules.turn_keep, True)
                less = (c - rules.parent_discount * mean).astype(np.float32)
                bounds = np.concatenate([[0], np.cumsum([len(x[2]) // 4 for x in got])])
                for x, a, b in zip(got, bounds[:-1], bounds[1:], strict=True):
                    yield _row(ANSWER, int(x[0][0]), pack(np.array([turn, part], np.int64), planes(less[dish[a:b]])))
                yield _row(STATS, part, None, PARENT, int(c.sum()), int(last.sum()))

            for part, parts in _stream(batches):
                yield from _given(rows(part, parts))

        return self.keep(_by_bucket(self.read(asked, ASKED), self.partitions).mapInArrow(run, ROWS), "parent")

    def seat_contexts(self, pairs: str, answer: str, totals: _Totals, turn: int) -> str:
        rules, n = self.rules, self.n
        names = np.array(totals.hot[0] if totals.hot else [], np.uint64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows(bucket: int, parts: Iterator[tuple[int, bytes]]) -> Iterator[tuple]:
                place, parent = _opened(parts, totals, rules)
                _, last = _seated(place, parent, totals, rules, bucket, turn)
                yield from _asked(bucket, place.w, np.bincount(place.dish, last, len(place.w)), n)
                run = np.cumsum(place.width) - place.width
                tables, customers = np.add.reduceat(last, run), np.add.reduceat(place.c, run)
                for k in np.flatnonzero(np.isin(place.u, names)):
                    yield _row(STATS, bucket, None, int(place.u[k].view(np.int64)), int(customers[k]), int(tables[k]))
                yield _row(STATS, bucket, None, PARENT, int(last.sum()))

            for bucket, parts in _stream(batches):
                yield from _given(rows(bucket, parts))

        return self.keep(_by_bucket(self.read(pairs, PAIRS).unionByName(self.read(answer, ANSWER)), self.partitions).mapInArrow(run, ROWS), "tables")

    def score(self, buckets: _Buckets, pairs: str, answers: list[str], totals: _Totals) -> DataFrame:
        rules = self.rules

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Tokens by bucket; for each flush, a row with its documents (kind SEEN + 1, bucket below 0)."""
            hasher, table, packer = tb.Hasher(lower=True), tb.whitespace_words(), _Packer(buckets, True)
            flush, ids, held, counts, n = TaskContext.get().partitionId() << 32, [], [], [], 0

            def close() -> Iterator[tuple]:
                yield _row(SEEN + 1, -1 - flush % buckets.n, pack(np.array([flush], np.int64), np.concatenate(ids), np.concatenate(held), np.concatenate(counts)))
                yield from packer.out(flush)

            for batch in batches:
                own = batch.column(0)
                absent = own.is_null().to_numpy(zero_copy_only=False)
                own, train = own.fill_null(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
                for block in tb.blocks(batch.column(2), table):
                    u, w, d = _pairs(block, hasher)
                    packer.add(u, w, d + n)
                    n += block.n_docs
                    rows = slice(block.row0, block.row0 + block.n_docs)
                    ids.append(own[rows])
                    held.append((~train[rows]).astype(np.uint8) | (absent[rows].astype(np.uint8) << 1))
                    counts.append(np.diff(block.first) + 1)
                    if packer.size > rules.flush:
                        yield from _given(close())
                        flush, ids, held, counts, n = flush + 1, [], [], [], 0
            if n:
                yield from _given(close())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for bucket, parts in _stream(batches):
                if bucket < 0:
                    yield from _given(_row(SEEN, 0, payload, int(unpack(payload)[0][0])) for _, payload in parts)
                    continue
                yield from _given(_scored(bucket, parts, totals, rules))

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Sums of the buckets' parts, a flush at a time; its documents come first."""
            import itertools

            flat = ((b.column(0)[i].as_py(), b.column(1)[i].as_py(), b.column(2)[i].as_py()) for b in batches for i in range(b.num_rows))
            denominator = totals.tokens + totals.vocabulary + 1
            for _, parts in itertools.groupby(flat, lambda x: x[0]):
                parts = iter(parts)
                _, ids, flags, counts = unpack(next(parts)[2])
                base = np.full(len(ids), np.log10((totals.ends + 1) / denominator))
                known = np.full(len(ids), int(totals.ends > 0), np.int64)
                score = np.zeros(len(ids))
                for _, _, payload in parts:
                    _, at, b, k, s = unpack(payload)
                    base[at] += b
                    known[at] += k
                    score[at] += s
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, mask=(flags & 2) > 0), pa.array((flags & 1) > 0), pa.array(counts), pa.array(known), pa.array(np.full(len(ids), totals.tokens)), pa.array(base), pa.array(score)],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

        sent = self.docs.mapInArrow(send, ROWS)
        model = self.read(pairs, PAIRS).unionByName(self.read(answers, ANSWER)).unionByName(sent)
        parts = _by_bucket(model, self.partitions).mapInArrow(run, ROWS)
        flushes = parts.select("name", F.when(F.col("kind") == SEEN, 0).otherwise(1).alias("kind"), "payload").repartition(self.partitions, "name").sortWithinPartitions("name", "kind")
        return flushes.mapInArrow(add, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def _summed(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs sorted by context and next word, counts of equal ones added."""
    u, w, c = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((w, u))
    u, w, c = u[order], w[order], c[order]
    cut = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (w[1:] != w[:-1])]))
    return u[cut], w[cut], np.add.reduceat(c, cut)


def _opened(parts: Iterator[tuple[int, bytes]], totals: _Totals, rules: PitmanYor) -> tuple[_Restaurants, np.ndarray]:
    """The restaurants of a bucket and their dishes' parent probabilities, averaged over the samples: answers
    of every sample, which come before any other row."""
    _, payload = next(parts)
    place, got, n = _Restaurants.load(payload), [], 0
    while n < len(place.w) * len(totals.parents):
        head, less = unpack(next(parts)[1])
        got.append((int(head[0]), int(head[1]), from_planes(less, np.float32)))
        n += len(got[-1][2])
    got.sort(key=lambda x: x[:2])
    less = np.concatenate([x for *_, x in got]).astype(float).reshape(len(totals.parents), -1)
    return place, np.mean([totals.parent(x, rules, k) for k, x in enumerate(less)], axis=0)


def _elsewhere(place: _Restaurants, parent: np.ndarray, totals: _Totals, rules: PitmanYor, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """Customers and tables that hot restaurants have in other buckets.  In the turn after the seating
    of contexts, the whole's tables are known and those expected here are taken off."""
    r, n = place.context(), len(place.u)
    customers, tables = np.bincount(r, place.c, n).astype(np.int64), np.minimum(place.c, 1).astype(float)
    if totals.hot and turn > 0:
        _, whole = totals.shared(place.u, customers, np.zeros(n, np.int64))
        some = np.flatnonzero((whole[r] > 0) & (place.c >= 2))
        p = np.maximum(parent[place.dish[some]], 1e-300)
        tables[some] = _expected(place.c[some], (rules.strength + totals.discount * whole[r[some]]) * p, max(totals.discount, 1e-6))[0]
    return totals.shared(place.u, customers, np.rint(np.bincount(r, tables, n)).astype(np.int64))


def _seated(place: _Restaurants, parent: np.ndarray, totals: _Totals, rules: PitmanYor, bucket: int, turn: int) -> tuple[np.ndarray, np.ndarray]:
    _, other = _elsewhere(place, parent, totals, rules, turn)
    rng = np.random.default_rng([rules.seed, bucket, 2, turn])
    burn, keep = (rules.burn, rules.keep) if turn >= rules.turns - 1 else (rules.turn_burn, rules.turn_keep)
    return seat(place.c, place.context(), len(place.u), parent[place.dish], other, totals.discount, rules.strength, rng, burn, keep, turn == 0)


def _scored(bucket: int, parts: Iterator[tuple[int, bytes]], totals: _Totals, rules: PitmanYor) -> Iterator[tuple]:
    """For each packed row of tokens, its documents' sums of log10 probabilities."""
    place, parent = _opened(parts, totals, rules)
    turn = max(1, rules.turns - 1)
    mean, _ = _seated(place, parent, totals, rules, bucket, turn)
    r = place.context()
    n = len(place.u)
    customers, tables = np.bincount(r, place.c, n).astype(np.int64), np.bincount(r, mean, n)
    more_c, more_t = _elsewhere(place, parent, totals, rules, turn)
    customers, tables = customers + more_c, tables + more_t
    p = (place.c - totals.discount * mean + (rules.strength + totals.discount * tables[r]) * parent[place.dish]) / (customers[r] + rules.strength)
    score = np.log10(p)
    counted = place.u != BEGIN
    base = np.where(counted, np.log10((customers + 1) / (totals.tokens + totals.vocabulary + 1)), 0.0)
    known = (counted & (customers > 0)).astype(np.int64)
    key = _pair_key(place.u[r], place.w[place.dish])
    order = np.argsort(key)
    key = key[order]
    for _, payload in parts:
        flush, *rest = unpack(payload)
        at = order[np.searchsorted(key, np.cumsum(_joined(rest[:7]), dtype=np.uint64) & _U((1 << 56) - 1))]
        x, d = np.repeat(at, from_planes(rest[7], np.uint32)), _joined(rest[8:]).astype(np.int64)
        size = int(d.max()) + 1
        seen = np.flatnonzero(np.bincount(d, minlength=size)).astype(np.uint32)
        sums = [np.bincount(d, v, size)[seen] for v in (base[r[x]], known[r[x]], score[x])]
        yield _row(SEEN + 1, 0, pack(flush, seen, sums[0], sums[1].astype(np.uint32), sums[2]), int(flush[0]))


def perplexity_scores(docs: DataFrame, rules: PitmanYor = PitmanYor()) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs."""
    jobs = _Jobs(docs, rules)
    hot, tokens, texts = _first_look(jobs.docs.select("train", "text"), jobs.n)
    buckets = _Buckets(jobs.n, hot, rules.splits)
    pairs = jobs.collect_pairs(buckets)
    found = jobs.totals(pairs)
    n1, n2 = found.get(SINGLE, (0, 0))
    discount = rules.discount if rules.discount is not None else float(np.clip(n1 / max(1, n1 + 2 * n2), 0.1, 0.95))

    def hot_totals(stats: dict[int, tuple[int, int]]) -> tuple:
        names = [int(x) for x in hot.view(np.int64)]
        return (hot, *(np.array([stats.get(x, (0, 0))[k] for x in names], np.int64) for k in (0, 1))) if names else ()

    known_hot = sum(found.get(int(x), (0, 0))[0] > 0 for x in hot[hot != BEGIN].view(np.int64)) if len(hot) else 0
    vocabulary = found.get(KNOWN, (0, 0))[0] + known_hot + (texts > 0)
    parents, answers, asked, shared = [], [], pairs, hot_totals(found)
    for turn in range(max(2, rules.turns)):
        answers.append(jobs.seat_parent(asked, _Totals(tokens, vocabulary, texts, discount), turn))
        parents.append(jobs.totals(answers[-1]).get(PARENT, (0, 0)))
        drop_scratch(jobs.spark, asked if turn else f"{pairs}/kind={ASKED}")
        if turn + 1 < max(2, rules.turns):
            asked = jobs.seat_contexts(pairs, answers[-1], _Totals(tokens, vocabulary, texts, discount, (parents[-1],), shared), turn)
            shared = hot_totals(jobs.totals(asked))
    drop_scratch(jobs.spark, answers[0])
    return jobs.score(buckets, pairs, answers[1:], _Totals(tokens, vocabulary, texts, discount, tuple(parents[1:]), shared))
