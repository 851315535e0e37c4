"""Filter audit, token counts and target resampling against plain versions."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from stratavox.llm import interactions, resampling, tokencounts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- filter audit ----------------------------------------------------------------------


def plain_flags(rows):
    """(part, flags) of (doc_id, text, source) rows."""
    out = []
    for i, text, source in rows:
        t = text or ""
        w = WORD.findall(t)
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        out.append((source or "", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), copy)))
    return out


def plain_audit(rows, good, toxic):
    flags = plain_flags(rows)
    out, shapley = {}, Counter()
    for part in {p for p, _ in flags}:
        own = [(f, r[0]) for (p, f), r in zip(flags, rows, strict=True) if p == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, k in enumerate(order, 1):
                at = "ABCDE".index(k)
                gone = [x for x in left if x[0][at]]
                left = [x for x in left if not x[0][at]]
                shapley[part, k] += len(gone)
                only = sum(f[at] and sum(f) == 1 for f, _ in own)
                out[part, "".join(order), step] = [len(left), len(gone), sum(f[at] for f, _ in own) - len(gone), only, sum(i in good for _, i in gone), sum(i in toxic for _, i in gone)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.fixture(scope="module")
def marks(spark):
    rows = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 60, 3)] + [(3, 0, 1), (9, None, None), (None, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_audit_equals_a_plain_walk_through_all_orders(docs, marks):
    extra = docs.withColumnsRenamed({"class": "A", "key": "digest"})
    found = {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in interactions.audit(extra, marks).collect()}
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    labels = marks.filter("doc_id IS NOT NULL").collect()
    assert found == plain_audit(rows, {r.doc_id for r in labels if r.quality == 1}, {r.doc_id for r in labels if r.toxic == 1})


def test_audit_of_shared_texts_and_repeated_ids(spark, marks):
    """A third of the rows share a text over parts; rows repeat a doc_id; null sources and an empty one meet."""
    rows = [(i, "Same text" if i % 3 == 0 else f"own {i}", [None, "", "s"][i % 3]) for i in range(90)]
    rows += [(0, "Same text", "s"), (3, "Same text", "s"), (1, "own 1", "t"), (None, "Same text", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in interactions.audit(docs, marks).collect()}
    labels = marks.filter("doc_id IS NOT NULL").collect()
    assert found == plain_audit(rows, {r.doc_id for r in labels if r.quality == 1}, {r.doc_id for r in labels if r.toxic == 1})
    assert {k[0] for k in found} == {"", "s", "t"}


def test_audit_of_nothing(nothing, marks):
    assert interactions.audit(nothing, marks).count() == 0


def test_audit_without_labels(docs, marks):
    rows = interactions.audit(docs, marks.limit(0)).collect()
    assert rows and all(r.good_lost == r.toxic_lost == 0 for r in rows)


# ---- token counts ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def content():
    with open(tokencounts.tokenizer_file(), encoding="utf-8") as f:
        return f.read()


def library_counts(content, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(content)
    return [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


def odd_texts():
    rng = random.Random(1)
    parts = ["'", "s", "t", "re", "ve", "m", "ll", "d", " ", "  ", "\n", "\t", "a", "Z", "é", "1", "٣", "!", "-", "日", "🙂", "'s", "'re ", "̀", "x" * 20, "\r\n", "Ⅷ", "\x00", "\x1c", "\x85", "​", "ſ"]
    out = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 40))) for _ in range(3000)]
    return [*out, None, "", " ", "x" * 30_000, " " * 5_000, "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "<|endoftext", "|>", "it's they'll'd 's '' 's"]


def test_counts_equal_the_library_on_odd_texts(content):
    texts = odd_texts()
    library = tokencounts.Library(content)
    none = tokencounts.Table(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0))
    found = tokencounts.Counter(library, none, 2_000).count(pa.array(texts))
    assert found.tolist() == library_counts(content, texts)


def test_long_texts_in_pieces(content, monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choice(["word ", "it's", "\n", "  ", "12 ", "é", "-- "]) for _ in range(20_000))
    library = tokencounts.Library(content)
    none = tokencounts.Table(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0))
    data = np.frombuffer(text.encode(), np.uint8)
    cuts = list(tokencounts.pieces(data, np.array([0, len(data)]), 500))
    assert len(cuts) > 50 and sum(int(o[-1]) for _, _, o in cuts) == len(data)
    monkeypatch.setattr(tokencounts, "pieces", lambda d, o: iter(list(_pieces(d, o, 500))))
    found = tokencounts.Counter(library, none, 1 << 20).count(pa.array([text, "after"]))
    assert found.tolist() == library_counts(content, [text, "after"])


_pieces = tokencounts.pieces


def test_table_finds_every_key_and_no_other():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 2**63, 5000).astype(np.uint64), rng.integers(0, 2**63, 5000).astype(np.uint64)
    table = tokencounts.Table(a, b, np.arange(5000))
    assert table.find(a, b).tolist() == list(range(5000))
    assert (table.find(b, a) == -1).all() and (table.find(a, b + np.uint64(1)) == -1).all()


@pytest.mark.parametrize("rules", [tokencounts.CountRules(), tokencounts.CountRules(sample_rows=5, table_size=10, limit=20, cache_bytes=500)])
def test_counts_of_documents(docs, content, rules):
    """Any sample and any size of table give the library's counts; clashing columns are ignored."""
    found = tokencounts.token_counts(docs.withColumnsRenamed({"key": "n_tokens"}), rules=rules).collect()
    rows = docs.collect()
    wanted = [(r.doc_id, len((r.text or "").encode()), n, n > rules.limit) for r, n in zip(rows, library_counts(content, [r.text for r in rows]), strict=True)]
    assert sorted(map(tuple, found), key=repr) == sorted(wanted, key=repr)


def test_counts_of_nothing(nothing):
    assert tokencounts.token_counts(nothing).count() == 0


def test_other_tokenizers_are_encoded_whole(docs):
    path = tokencounts.tokenizer_file("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        content = f.read()
    found = {r.doc_id: r.n_tokens for r in tokencounts.token_counts(docs, path).collect() if r.doc_id in range(40)}
    rows = [r for r in docs.collect() if r.doc_id in range(40)]
    assert found == dict(zip([r.doc_id for r in rows], library_counts(content, [r.text for r in rows]), strict=True))


# ---- target resampling -----------------------------------------------------------------


def plain_features(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain_resample(docs, target):
    features = [plain_features(t) for _, t in docs]
    raw, aim = Counter(b for _, f in features for b in f), Counter(b for t in target for b in plain_features(t)[1])
    s, t = sum(raw.values()), sum(aim.values())
    gain = {b: math.floor(1000 * math.log((aim[b] + 1) * (s + 10_000) / ((raw[b] + 1) * (t + 10_000)))) for b in raw}
    out = []
    for (i, _), (n, f) in zip(docs, features, strict=True):
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    fit = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0]))
    return out, fit[: 5 * len(fit) // 100], len(fit)


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame([(1, "w1 w2 w3 w4 W5 w6"), (2, None), (3, "w7 w8-w9 repeat me"), (4, "")], "item_id long, text string")


def test_weights_scores_and_ranks(docs, target):
    found = resampling.resample(docs.withColumnsRenamed({"key": "score", "class": "rank"}), target).collect()
    rows = docs.collect()
    plain, drawn, _ = plain_resample([(r.doc_id, r.text) for r in rows], [r.text for r in target.collect()])
    assert sorted((tuple(r[:5]) for r in found), key=repr) == sorted(map(tuple, plain), key=repr)
    assert len(drawn) >= 2
    assert [(r.doc_id, r.score) for r in sorted((r for r in found if r["rank"]), key=lambda r: r["rank"])] == [(r[0], r[4]) for r in drawn]
    assert sorted(r["rank"] for r in found if r["rank"]) == list(range(1, len(drawn) + 1))


def test_draws_among_many_equal_texts(spark, target):
    """A third of the rows are one text and many rows repeat an id, so scores tie."""
    rows = [(i % 200, "w1 w2 " * 15 if i % 3 else f"w{i} other words " * 9) for i in range(600)]
    found = resampling.resample(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), target).collect()
    plain, drawn, _ = plain_resample(rows, [r.text for r in target.collect()])
    assert sorted((tuple(r[:5]) for r in found), key=repr) == sorted(map(tuple, plain), key=repr)
    assert [(r.doc_id, r.score) for r in sorted((r for r in found if r["rank"]), key=lambda r: r["rank"])] == [(r[0], r[4]) for r in drawn]


def test_draws_of_nothing_and_toward_nothing(docs, nothing, target):
    assert resampling.resample(nothing, target).count() == 0
    assert resampling.resample(docs, target.limit(0)).count() == docs.count()
    short = docs.filter("doc_id = 3")
    assert [r["rank"] for r in resampling.resample(short, target).collect()] == [None]


def test_crc_of_joined_texts():
    rng, crc = random.Random(3), resampling.Crc()
    left = [rng.randbytes(rng.randrange(0, 90)) for _ in range(300)]
    right = [rng.randbytes(n) for n in [0, 1, 63, 64, 65, 128, 5_000, 70_001] + [rng.randrange(0, 200) for _ in range(292)]]
    found = crc.joined(np.array([zlib.crc32(x) for x in left], np.uint32), np.array([zlib.crc32(x) for x in right], np.uint32), np.array([len(x) for x in right]))
    assert found.tolist() == [zlib.crc32(a + b) for a, b in zip(left, right, strict=True)]


def test_pieces_of_long_texts_overlap(monkeypatch):
    monkeypatch.setattr(resampling, "PIECE", 7)
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(6)}" for _ in range(n)) for n in (0, 1, 2, 3, 20, 50, 7, 6, 8)]
    features, counts = resampling.Features(resampling.TargetRules()), np.zeros(10_000, np.int64)
    gain = np.arange(10_000)
    for block in resampling.tb.blocks(pa.array(texts), resampling.tb.alnum_words()):
        features.count(block, counts)
        weights = features.weights(block, gain)
    plain = [plain_features(t)[1] for t in texts]
    assert weights.tolist() == [sum(f) for f in plain]
    assert {b: n for b, n in enumerate(counts.tolist()) if n} == dict(Counter(b for f in plain for b in f))


def test_runs_rank_like_a_sort(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(30), i if rng.random() < 0.9 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "score long, doc_id long").repartition(5)
    found = sorted((r["rank"], r.score, r.doc_id) for r in resampling.ranked(df, 100, "score", "doc_id", "rank").collect())
    wanted = sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0))[:100]
    assert [(r[1], r[2]) for r in found] == wanted and [r[0] for r in found] == list(range(1, 101))
