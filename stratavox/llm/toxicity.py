"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

Voters fire or stay silent on a text: groups of a hand-written lexicon, patterns,
lexicon entries (words and word beginnings, by hash) that a bounded sample of
labelled training rows shows to be tied to the label, and one voter for clean that
fires where no lexicon voter does.  The label model has for
each voter its rate of firing in toxic and in clean texts (from which its accuracy
follows), and the voters' strongest correlations within the classes as a forest of pairwise terms: a voter's
likelihood is taken given its class and whether its parent fires, so copies of one voter do not add up.  Both
are estimated by EM over
all training rows, labelled or not, with distributed sums of bounded size.  A logistic regression on hashed words and
word beginnings is then fitted to the posterior labels of a bounded sample of
training rows, and scores every whole text.

Labels are read only for rows with crc32(doc_id as text) mod 3 other than 1; labels,
lang, source and doc_id are no inputs of a score.

Edge cases: null and empty texts fire no voter and get the classifier's base score;
rows without doc_id count as held out; without labelled toxic and clean rows
the hand-written voters alone make the model; repeated rows score alike; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .storage import least_hashed, stored

#: Plain insults of general English; groups of a theme vote as one.
LEXICON = {
    "wits": ("idiot", "moron", "stupid", "dumb", "fool", "imbecile", "braindead"),
    "worth": ("worthless", "useless", "pathetic", "loser", "failure"),
    "filth": ("trash", "garbage", "scum", "filth", "filthy", "vermin"),
    "disgust": ("disgusting", "revolting", "vile", "gross", "creep", "freak"),
    "mock": ("clown", "joke", "laughable", "coward", "liar"),
}
PATTERNS = ("shouting", "exclaiming", "symbols")
_BEGINNINGS = (4, 5, 6, 7)
#: Correlation from which two voters count as dependent.
EDGE = 0.2


@dataclass(frozen=True)
class ToxicityRules:
    """max_labelled: labelled training rows read at most (smallest keyed hash first);
    max_fit: training rows that the classifier is fitted on at most; voters: induced
    voters; features: inputs of the classifier (words and beginnings that occur in exactly the same labelled
    rows are one input, the mean of about `members` of them at most); min_rows: labelled rows that an induced
    voter or feature needs; rounds: of EM; steps, penalty: of the classifier."""

    max_labelled: int = 20_000
    max_fit: int = 30_000
    voters: int = 180
    features: int = 4096
    min_rows: int = 4
    rounds: int = 6
    steps: int = 300
    penalty: float = 0.3
    members: int = 64
    threshold: float = 0.7
    seed: int = 11


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def _features(block: tb.Block, hasher: tb.Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (hash, document) of the words and word beginnings of a block."""
    doc, size = block.doc_of_word(), block.ends - block.starts
    hashes, docs = [hasher.spans(block.data, block.starts, block.ends)], [doc]
    for k in _BEGINNINGS:
        at = size > k
        hashes.append(tb.mix64(hasher.spans(block.data, block.starts[at], block.starts[at] + k) + np.uint64(k)))
        docs.append(doc[at])
    h, d = np.concatenate(hashes), np.concatenate(docs)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])]) if len(h) else np.zeros(0, bool)
    return h[fresh], d[fresh]


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False)


def labelled_rows(labels: DataFrame, rules: ToxicityRules) -> tuple[np.ndarray, np.ndarray]:
    """(doc_id sorted, toxic) of at most max_labelled training rows."""
    rows = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    found = least_hashed(stored(rows, "labelled"), ["doc_id"], rules.seed, rules.max_labelled).collect()
    ids, toxic = np.array([r.doc_id for r in found], np.int64), np.array([r.toxic for r in found], np.int64)
    order = np.argsort(ids)
    return ids[order], toxic[order]


@dataclass(frozen=True)
class Inputs:
    """The classifier's inputs: sorted hashes of words and beginnings, the input that each belongs to, its
    share of that, and the chi-square of each input, signed; heads: one entry of every input."""

    entries: np.ndarray
    column: np.ndarray
    value: np.ndarray
    z: np.ndarray
    heads: np.ndarray

    @classmethod
    def of(cls, h: np.ndarray, group: np.ndarray, z: np.ndarray) -> Inputs:
        order = np.argsort(h)
        names, column = np.unique(group[order], return_inverse=True)
        _, heads = np.unique(column, return_index=True)
        return cls(h[order], column, 1 / np.bincount(column, minlength=len(names))[column], z[order][heads], heads)


def associations(training: DataFrame, ids: np.ndarray, toxic: np.ndarray, rules: ToxicityRules) -> Inputs:
    """The inputs most tied to the label, either way."""
    none = Inputs.of(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0))
    if not len(ids) or not 0 < toxic.sum() < len(ids):
        return none
    shared = training.sparkSession.sparkContext.broadcast((ids, toxic))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, table = tb.Hasher(lower=True), tb.alnum_words()
        ids, toxic = shared.value
        for batch in batches:
            own = _ids(batch)
            chosen = np.flatnonzero(np.isin(own, ids))
            if not len(chosen):
                continue
            label = toxic[np.searchsorted(ids, own[chosen])]
            for block in tb.blocks(batch.column(1).take(pa.array(chosen)), table):
                h, d = _features(block, hasher)
                kinds, inverse = np.unique(h, return_inverse=True)
                is_toxic = label[block.row0 + d]
                order = np.argsort(inverse, kind="stable")
                rows = tb.keyed64(own[chosen][block.row0 + d[order]], rules.seed)
                place = np.bitwise_xor.reduceat(rows, np.searchsorted(inverse[order], np.arange(len(kinds)))) if len(kinds) else rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kinds.view(np.int64)), pa.array(np.bincount(inverse, minlength=len(kinds))), pa.array(np.bincount(inverse, is_toxic, len(kinds)).astype(np.int64)), pa.array(place.view(np.int64))],
                    ["h", "n", "t", "place"],
                )

    n, t = float(len(ids)), float(toxic.sum())
    counts = training.mapInArrow(run, "h bigint, n bigint, t bigint, place bigint").groupBy("h").agg(F.sum("n").alias("n"), F.sum("t").alias("t"), F.bit_xor("place").alias("place"))
    a, b = F.col("t").cast("double"), (F.col("n") - F.col("t")).cast("double")
    c, d = t - a, n - t - b
    cross = a * d - b * c
    tied = n * cross * F.abs(cross) / ((a + b) * (c + d) * t * (n - t))
    tied_to = counts.filter(F.col("n") >= rules.min_rows).withColumn("z", F.when((a + b) * (c + d) > 0, tied).otherwise(0.0)).filter(F.abs("z") > 4)
    counts = stored(tied_to, "tied")
    # features of exactly the same rows are one input
    groups = counts.groupBy("n", "t", "place").agg(F.min("h").alias("group"), F.count("*").alias("size"), F.min("z").alias("strength"))
    best = groups.orderBy(F.abs("strength").desc(), "group").limit(rules.features)
    drawn = F.pmod(F.xxhash64("h", F.lit(rules.seed)), F.lit(1 << 30))
    found = counts.join(F.broadcast(best), ["n", "t", "place"]).filter((F.col("h") == F.col("group")) | (drawn * F.col("size") < rules.members << 30)).select("h", "group", "z").toArrow()
    return Inputs.of(found.column(0).to_numpy().view(np.uint64), found.column(1).to_numpy(), found.column(2).to_numpy())


def choose_voters(rows: list[np.ndarray], toxic: np.ndarray, z: np.ndarray, rules: ToxicityRules) -> np.ndarray:
    """Places of the features that become voters, chosen one by one: each time the one
    that adds most toxic rows, where a row counts less the more voters it has, and that
    fires in few clean rows.  rows: features of the labelled rows."""
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    feature = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)
    n = len(z)
    clean = np.bincount(feature[toxic[doc] == 0], minlength=n)
    usable = (z > 0) & (clean <= 0.05 * np.bincount(feature[toxic[doc] == 1], minlength=n))
    doc, feature = doc[(toxic[doc] == 1) & usable[feature]], feature[(toxic[doc] == 1) & usable[feature]]
    worth, chosen = np.ones(len(rows)), []
    for _ in range(min(rules.voters, n)):
        gain = np.bincount(feature, worth[doc], n)
        best = int(np.argmax(gain))
        if gain[best] < 1:
            break
        chosen.append(best)
        worth[np.unique(doc[feature == best])] *= 0.4
        stay = feature != best
        doc, feature = doc[stay], feature[stay]
    return np.array(chosen, np.int64)


class Voters:
    """Which voters fire on the texts of a block; `entries` are hashes of induced lexicon entries."""

    def __init__(self, entries: np.ndarray):
        self.entries = np.sort(entries)
        self.hasher = tb.Hasher(lower=True)
        words = [w.encode() for group in LEXICON.values() for w in group]
        data = np.frombuffer(b"".join(words), np.uint8)
        stops = np.cumsum([len(w) for w in words])
        hashes = self.hasher.spans(data, stops - [len(w) for w in words], stops)
        group = np.repeat(np.arange(len(LEXICON)), [len(g) for g in LEXICON.values()])
        order = np.argsort(hashes)
        self.words, self.group = hashes[order], group[order]
        self.n = len(LEXICON) + len(PATTERNS) + len(self.entries) + 1

    @staticmethod
    def _places(sorted_hashes: np.ndarray, h: np.ndarray) -> np.ndarray:
        if not len(sorted_hashes):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(sorted_hashes, h), len(sorted_hashes) - 1)
        return np.where(sorted_hashes[at] == h, at, -1)

    def fire(self, block: tb.Block, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        out = np.zeros((block.n_docs, self.n), bool)
        at = self._places(self.words, h)
        out[d[at >= 0], self.group[at[at >= 0]]] = True
        data, n = block.data, len(LEXICON)
        size = np.maximum(np.diff(block.offsets), 1)
        count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[block.offsets])
        out[:, n] = count((data >= 0x41) & (data <= 0x5A)) > 0.5 * size
        out[:, n + 1] = count(data == 0x21) > 0.01 * size
        out[:, n + 2] = count(np.isin(data, list(b"#*$%&"))) > 0.05 * size
        at = self._places(self.entries, h)
        out[d[at >= 0], n + len(PATTERNS) + at[at >= 0]] = True
        out[:, -1] = ~out[:, :n].any(1) & ~out[:, n + len(PATTERNS) : -1].any(1)
        return out


@dataclass
class LabelModel:
    """prior: share of toxic texts; rates[c, j]: how often voter j fires in class c; parent[j]: the voter
    that j depends on (-1: none); given[c, s, j]: how often j fires in class c where its parent is
    silent (s = 0) or fires (s = 1)."""

    prior: float
    rates: np.ndarray
    parent: np.ndarray
    given: np.ndarray

    def posterior(self, fired: np.ndarray) -> np.ndarray:
        """P(toxic) from the voters that fire, each given its parent; a silent voter abstains."""
        evidence = np.log(self.given[1] / self.given[0])
        parents = np.where(self.parent >= 0, fired[:, np.maximum(self.parent, 0)], 0.0)
        logit = np.log(self.prior / (1 - self.prior)) + fired @ evidence[0] + (fired * parents) @ (evidence[1] - evidence[0])
        return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))

    def accuracies(self) -> np.ndarray:
        """P(toxic | voter fires)."""
        a = self.prior * self.rates[1]
        return a / (a + (1 - self.prior) * self.rates[0])


def _forest(correlation: np.ndarray) -> np.ndarray:
    """Parents of a maximum spanning forest over the pairs correlated by EDGE or more."""
    n = len(correlation)
    i, j = np.nonzero(np.triu(correlation, 1) >= EDGE)
    order = np.lexsort((j, i, -correlation[i, j]))
    part, near = list(range(n)), [[] for _ in range(n)]

    def find(x: int) -> int:
        while part[x] != x:
            x = part[x]
        return x

    for a, b in zip(i[order].tolist(), j[order].tolist(), strict=True):
        if find(a) != find(b):
            part[find(b)] = find(a)
            near[a].append(b)
            near[b].append(a)
    parent, seen = np.full(n, -1), np.zeros(n, bool)
    for root in range(n):
        todo = [] if seen[root] else [root]
        while todo:
            x = todo.pop()
            seen[x] = True
            for y in near[x]:
                if not seen[y]:
                    parent[y] = x
                    todo.append(y)
    return parent


def from_sums(weight: np.ndarray, fires: np.ndarray, pairs: np.ndarray) -> LabelModel:
    """The model of class weights, summed firings and summed joint firings, by class."""
    rates = (fires + 0.05) / (weight[:, None] + 1)
    rates = np.clip(rates, 1e-6, 1 - 1e-6)
    prior = float(np.clip(weight[1] / max(weight.sum(), 1), 1e-4, 0.9))
    correlation = np.zeros(pairs.shape[1:])
    for c in (0, 1):
        joint = pairs[c] / max(weight[c], 1) - np.outer(rates[c], rates[c])
        spread = np.sqrt(rates[c] * (1 - rates[c]))
        correlation = np.maximum(correlation, joint / np.outer(spread, spread))
    parent = _forest(correlation)
    given = np.stack([rates, rates], 1)
    child = np.flatnonzero(parent >= 0)
    top = parent[child]
    for c in (0, 1):
        both = pairs[c][child, top]
        given[c, 1, child] = (both + rates[c, child]) / (fires[c, top] + 1)
        given[c, 0, child] = (fires[c, child] - both + rates[c, child]) / (weight[c] - fires[c, top] + 1)
    return LabelModel(prior, rates, parent, np.clip(given, 1e-6, 1 - 1e-6))


def _first_model(voters: Voters, prior: float) -> LabelModel:
    """Before any count: lexicon voters and induced entries point to toxic, patterns to neither."""
    rates = np.tile(np.array([[0.001], [0.1]]), (1, voters.n))
    rates[:, len(LEXICON) : len(LEXICON) + len(PATTERNS)] = 0.05
    rates[:, -1] = 0.95, 0.1
    return LabelModel(prior, rates, np.full(voters.n, -1), np.stack([rates, rates], 1))


def fit_label_model(votes: DataFrame, voters: Voters, ids: np.ndarray, toxic: np.ndarray, rules: ToxicityRules) -> LabelModel:
    """EM over votes(doc_id, fired); labelled rows keep their label, the others their posterior."""
    model = _first_model(voters, float(np.clip(toxic.mean(), 0.01, 0.5)) if len(ids) else 0.05)
    n = voters.n
    for step in range(rules.rounds):
        shared = votes.sparkSession.sparkContext.broadcast((model, ids, toxic, step == 0 and len(ids) > 0))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            model, ids, toxic, labelled_only = shared.value
            weight, fires, pairs = np.zeros(2), np.zeros((2, n)), np.zeros((2, n, n))
            for batch in batches:
                packed = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                fired = np.unpackbits(packed, axis=1)[:, :n].astype(np.float64)
                own = _ids(batch)
                known = np.isin(own, ids)
                p = model.posterior(fired)
                p[known] = toxic[np.searchsorted(ids, own[known])]
                if labelled_only:
                    fired, p = fired[known], p[known]
                for c, w in ((0, 1 - p), (1, p)):
                    weight[c] += w.sum()
                    fires[c] += w @ fired
                    pairs[c] += (fired * w[:, None]).T @ fired
            sums = np.concatenate([weight, fires.ravel(), pairs.ravel()])
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["i", "s"])

        sums = np.zeros(2 + 2 * n + 2 * n * n)
        for r in votes.mapInArrow(run, "i bigint, s double").groupBy("i").agg(F.sum("s").alias("s")).toLocalIterator():
            sums[r.i] = r.s
        if sums[:2].min() <= 0:
            break
        model = from_sums(sums[:2], sums[2 : 2 + 2 * n].reshape(2, n), sums[2 + 2 * n :].reshape(2, n, n))
    return model


def fit_classifier(x: list[np.ndarray], p: np.ndarray, inputs: Inputs, rules: ToxicityRules) -> np.ndarray:
    """Weights of the entries and, last, the base; to posterior labels p, by Adam on all rows."""
    n = len(inputs.z)
    rows = np.repeat(np.arange(len(x)), [len(v) for v in x])
    entry = np.concatenate(x).astype(np.int64) if len(x) else np.zeros(0, np.int64)
    columns, value = inputs.column[entry], inputs.value[entry]
    w = np.zeros(n + 1)
    w[n] = np.log(np.clip(p.mean(), 1e-3, 0.5)) if len(p) else -3.0
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    cost = np.where(p > 0.5, max(1.0, (p <= 0.5).sum() / max(1, (p > 0.5).sum()) / 3), 1.0)
    for step in range(1, rules.steps + 1 if len(p) else 1):
        logit = np.bincount(rows, w[columns] * value, len(x)) + w[n]
        error = cost * (1 / (1 + np.exp(-np.clip(logit, -50, 50))) - p)
        gradient = np.append(np.bincount(columns, error[rows] * value, n) + rules.penalty * w[:n], error.sum()) / len(p)
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return np.append(w[inputs.column] * inputs.value, w[n])


def _selected(entries: np.ndarray, order: np.ndarray, h: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = Voters._places(entries, h)
    hit = at >= 0
    return order[at[hit]], d[hit]


def _labelled_features(training: DataFrame, entries: np.ndarray, ids: np.ndarray, toxic: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The features and labels of the (bounded) labelled rows."""
    if not len(entries):
        return [], np.zeros(0, np.int64)
    shared = training.sparkSession.sparkContext.broadcast((entries, ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, ids = shared.value
        hasher, table, all_of = tb.Hasher(lower=True), tb.alnum_words(), np.arange(len(entries))
        for batch in batches:
            own = _ids(batch)
            chosen = np.flatnonzero(np.isin(own, ids))
            for block in tb.blocks(batch.column(1).take(pa.array(chosen)), table):
                column, row = _selected(entries, all_of, *_features(block, hasher))
                offsets = np.searchsorted(row, np.arange(block.n_docs + 1)).astype(np.int32)
                names = pa.array(own[chosen[block.row0 : block.row0 + block.n_docs]])
                yield pa.RecordBatch.from_arrays([names, pa.ListArray.from_arrays(pa.array(offsets), pa.array(column.astype(np.int32)))], ["doc_id", "columns"])

    found = training.mapInArrow(run, "doc_id bigint, columns array<int>").dropDuplicates(["doc_id"]).toArrow()
    names = found.column(0).to_numpy()
    return [np.asarray(v.values) for v in found.column(1)], toxic[np.searchsorted(ids, names)]


@dataclass
class ToxicityModel:
    entries: np.ndarray
    weights: np.ndarray
    labels: LabelModel
    voters: Voters


def fit(docs: DataFrame, labels: DataFrame, rules: ToxicityRules = ToxicityRules()) -> ToxicityModel:
    """The whole of the training, on rows that are not held out."""
    training = docs.filter(~is_held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long"), "text")
    ids, toxic = labelled_rows(labels, rules)
    inputs = associations(training, ids, toxic, rules)
    entries, heads = inputs.entries, np.sort(inputs.entries[inputs.heads])
    order = inputs.column[np.searchsorted(inputs.entries, heads)]
    voters = Voters(heads[choose_voters(*_labelled_features(training, heads, ids, toxic), inputs.z[order], rules)])
    shared = docs.sparkSession.sparkContext.broadcast((voters.entries, entries))

    def cast_votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voted, entries = shared.value
        voters, table, all_of = Voters(voted), tb.alnum_words(), np.arange(len(entries))
        for batch in batches:
            for block in tb.blocks(batch.column(1), table):
                h, d = _features(block, voters.hasher)
                packed = np.packbits(voters.fire(block, h, d), axis=1)
                column, row = _selected(entries, all_of, h, d)
                offsets = np.searchsorted(row, np.arange(block.n_docs + 1)).astype(np.int32)
                own = batch.column(0).slice(block.row0, block.n_docs)
                yield pa.RecordBatch.from_arrays([own, pa.array([x.tobytes() for x in packed], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(column.astype(np.int32)))], ["doc_id", "fired", "columns"])

    votes = stored(training.mapInArrow(cast_votes, "doc_id bigint, fired binary, columns array<int>"), "votes")
    model = fit_label_model(votes.select("doc_id", "fired"), voters, ids, toxic, rules)
    sample = least_hashed(votes, ["doc_id", "fired"], rules.seed + 1, rules.max_fit).toArrow()
    packed = np.frombuffer(b"".join(sample.column(1).to_pylist()), np.uint8).reshape(sample.num_rows, -1) if sample.num_rows else np.zeros((0, 1), np.uint8)
    p = model.posterior(np.unpackbits(packed, axis=1)[:, : voters.n].astype(np.float64)) if sample.num_rows else np.zeros(0)
    x = [np.asarray(v.values) for v in sample.column(2)]
    weights = fit_classifier(x, p, inputs, rules)
    return ToxicityModel(entries, weights, model, voters)


def score(docs: DataFrame, model: ToxicityModel, rules: ToxicityRules = ToxicityRules()) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.entries, model.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, weights = shared.value
        hasher, table, all_of = tb.Hasher(lower=True), tb.alnum_words(), np.arange(len(entries))
        for batch in batches:
            for block in tb.blocks(batch.column(1), table):
                column, row = _selected(entries, all_of, *_features(block, hasher))
                logit = np.bincount(row, weights[column], block.n_docs) + weights[-1]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.row0, block.n_docs), pa.array(1 / (1 + np.exp(-np.clip(logit, -50, 50))))], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, score double")
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= rules.threshold).cast("int").alias("predicted"))
