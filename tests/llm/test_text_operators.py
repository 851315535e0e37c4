"""Text operators against plain versions, with odd, empty and very long rows."""

from __future__ import annotations

import collections
import gzip
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratavox.llm import decontaminate, jaccard, linededup, pieces, repetition, substrings, warc
from stratavox.llm import textblocks as tb
from stratavox.llm.storage import scratch

SPACES = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text, pattern=SPACES, lower=False):
    text = text or ""
    return re.findall(pattern, text.translate(LOWER) if lower else text)


# ---- words ---------------------------------------------------------------------------


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB \n\t\x0b\x1cé日▁.0", max_size=40)), max_size=8), st.integers(1, 60))
def test_blocks_find_words(found, size):
    column = pa.array(found, pa.string())
    for table, pattern, lower in ((tb.whitespace_words(), SPACES, False), (tb.alnum_words(), ALNUM, True)):
        got = []
        for block in tb.blocks(column, table, size):
            for d in range(block.n_docs):
                got.append([block.data[a:b].tobytes().decode() for a, b in zip(block.starts[block.first[d] : block.first[d + 1]], block.ends[block.first[d] : block.first[d + 1]], strict=True)])
        assert [[w.translate(LOWER) for w in x] if lower else x for x in got] == [tokens(t, pattern, lower) for t in found]


def test_hashes_depend_on_content_only():
    block = next(tb.blocks(pa.array(["ab CD ab", "x ab cd"]), tb.whitespace_words()))
    h = tb.Hasher(lower=True).spans(block.data, block.starts, block.ends)
    assert h[0] == h[2] == h[4] and h[1] == h[5] and len(set(h.tolist())) == 3


# ---- op 1 ----------------------------------------------------------------------------


def plain_repetition(text, rules=repetition.RepetitionRules()):
    w = tokens(text)
    n = len(w)

    def cover(k):
        c = collections.Counter(tuple(w[i : i + k]) for i in range(n - k + 1))
        return len({j for i in range(n - k + 1) if c[tuple(w[i : i + k])] > 1 for j in range(i, i + k)})

    longest = 0
    for k in range(rules.floor(), n):
        c = collections.Counter(tuple(w[i : i + k]) for i in range(n - k + 1))
        if max(c.values(), default=0) < 2:
            break
        longest = k
    lines = [x for x in (text or "").split("\n") if tokens(x)]
    repeat = cover(8)
    failed = n < 20 or 100 * repeat > 30 * n
    kept = not failed and 100 * cover(rules.min_repeat) <= rules.max_covered_percent * n and longest <= rules.max_longest
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), repeat, failed, kept, cover(rules.min_repeat), longest


def test_repetition_matches_plain(spark, docs, texts, nothing):
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, r.n_covered_words, r.longest_repeat) for r in repetition.repetition_report(docs).collect())
    assert got == collections.Counter((i, *plain_repetition(t)) for i, t in texts)
    assert repetition.repetition_report(nothing).count() == 0
    kept = repetition.quality_filter(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r[7] * n for r, n in got.items())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=70), min_size=1, max_size=4))
def test_suffix_repeats(found):
    found = [" ".join(map(str, x)) for x in found]
    block = next(tb.blocks(pa.array(found), tb.whitespace_words()))
    got = repetition.measure(block, tb.Hasher(), repetition.RepetitionRules())
    for d, text in enumerate(found):
        wanted = plain_repetition(text)
        assert (got["n_repeat_words"][d], got["n_covered_words"][d], got["longest_repeat"][d], got["kept"][d]) == (wanted[4], wanted[7], wanted[8], wanted[6])


@pytest.mark.parametrize(("least", "most"), [(5, 60), (1, 60), (10, 3), (7, 0), (16, 20)])
def test_short_repeats_count_too(least, most):
    rng = random.Random(least)
    rules = repetition.RepetitionRules(min_repeat=least, max_longest=most, max_covered_percent=50)
    for _ in range(30):
        w = [str(rng.randrange(rng.choice([3, 40, 4000]))) for _ in range(rng.randrange(1, 120))]
        w += w[:7] if len(w) > 30 else []
        block = next(tb.blocks(pa.array([" ".join(w)]), tb.whitespace_words()))
        got, wanted = repetition.measure(block, tb.Hasher(), rules), plain_repetition(" ".join(w), rules)
        assert (got["n_repeat_words"][0], got["n_covered_words"][0], got["longest_repeat"][0], got["kept"][0]) == (wanted[4], wanted[7], wanted[8], wanted[6])
    with pytest.raises(ValueError, match="min_repeat"):
        repetition.RepetitionRules(min_repeat=0)


def test_suffix_repeats_of_copied_stretches():
    rng = random.Random(1)
    for _ in range(60):
        w = [str(rng.randrange(rng.choice([2, 8, 50]))) for _ in range(rng.randrange(20, 160))]
        for _ in range(3):
            a, size, place = rng.randrange(len(w) - 10), rng.randrange(5, 60), rng.randrange(len(w))
            w[place:place] = w[a : a + size]
        block = next(tb.blocks(pa.array(["x y", " ".join(w)]), tb.whitespace_words()))
        got, wanted = repetition.measure(block, tb.Hasher(), repetition.RepetitionRules()), plain_repetition(" ".join(w))
        assert (got["n_repeat_words"][1], got["n_covered_words"][1], got["longest_repeat"][1]) == (wanted[4], wanted[7], wanted[8])


# ---- op 2 ----------------------------------------------------------------------------


def plain_components(rows, k, percent):
    sets = []
    for _, t in rows:
        w = tokens(t, lower=True)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (name, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), (2**70,)), (-(2**63) if name is None else name,))
    return collections.Counter((name, len(sets[i]), None if least[find(i)][0] == -(2**63) else least[find(i)][0]) for i, (name, _) in enumerate(rows))


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_jaccard_matches_plain(docs, texts, k, percent):
    got = jaccard.near_duplicates(docs, jaccard.JaccardRules(words=k, similarity=percent, hot_least=3, hot_list=50))
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == plain_components(texts, k, percent)


def test_all_links_between_classes(spark):
    """A chain and a cluster of near copies: links that close cycles are there too."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    rows = []
    for i in range(40):
        own = list(base) if i < 25 else [f"v{i}x{k}" for k in range(60)]
        for k in range(i % 4):
            own[(i * 7 + k * 17) % 150 if i < 25 else k] = f"e{i}"
        rows.append((i, " ".join(own)))
    rows.append((40, rows[3][1]))
    docs, rules = spark.createDataFrame(rows, "doc_id long, text string"), jaccard.JaccardRules()
    name = {r.doc_id: r["class"] for r in jaccard.near_duplicates(docs, rules).collect()}
    sets = {}
    for i, t in rows:
        w = tokens(t, lower=True)
        sets[name[i]] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    wanted = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    got = [(r.a, r.b) for r in jaccard.similar_classes(docs, rules).collect()]
    assert len(wanted) > len(sets) and len(got) == len(set(got))
    assert set(got) == wanted


def test_jaccard_by_shuffle_and_empty(spark, docs, texts, nothing):
    rules = jaccard.JaccardRules(broadcast_bytes=0, hood_rows=50)
    got = jaccard.near_duplicates(docs, rules)
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == plain_components(texts, 5, 80)
    assert jaccard.near_duplicates(nothing).count() == 0
    kept = jaccard.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    found = collections.Counter(r.doc_id for r in kept.collect())
    n_empty = sum(n for (_, size, _), n in plain_components(texts, 5, 80).items() if not size)
    ids = {c for _, n, c in plain_components(texts, 5, 80) if n}
    assert found == collections.Counter(ids) + collections.Counter(i for i, t in texts if not tokens(t))
    assert sum(found.values()) == len(ids) + n_empty


def test_duplicates_are_dropped_by_row(spark):
    """Rows that share an id (or have none) stay unless their own text has a duplicate that is kept."""
    rng = random.Random(4)
    a, b, c, d = (" ".join(f"w{rng.randrange(9000)}" for _ in range(60)) for _ in range(4))
    rows = [(3, a, "x"), (5, a, "y"), (5, b, "z"), (5, b, "q"), (None, c, "n"), (7, c, "m"), (None, d, "k"), (8, "", "e"), (8, None, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest_ string")
    kept = collections.Counter(tuple(r) for r in jaccard.drop_near_duplicates(docs).collect())
    assert kept == collections.Counter([(3, a, "x"), (5, b, "q"), (None, c, "n"), (None, d, "k"), (8, "", "e"), (8, None, "e")])


def test_regions_lose_no_link():
    """Random clusters: every linked pair meets in a region, and a region's links connect what brute force connects."""
    rng = random.Random(2)
    rules = jaccard.JaccardRules(words=3, similarity=80)
    sets = []
    for _ in range(12):
        base = [rng.getrandbits(64) for _ in range(rng.randrange(20, 400))]
        for _ in range(rng.randrange(1, 8)):
            own = set(base)
            for _ in range(rng.randrange(0, len(base) // 8)):
                own.discard(rng.choice(base))
                own.add(rng.getrandbits(64))
            sets.append(np.array(sorted(own), np.uint64))
    n = np.array([len(s) for s in sets])
    flat, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    regions = [{q, *others.tolist()} for q, others in jaccard.voronoi_regions(n, jaccard.folded(jaccard.sketches(flat, doc, n)), rules)]
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (n[i] + n[j] - both):
                assert any({i, j} <= r for r in regions)
    links = jaccard.join_region(sets, rules)
    for a, b in links:
        both = len(np.intersect1d(sets[a], sets[b]))
        assert 100 * both >= 80 * (n[a] + n[b] - both)


def near_copies(seed=11):
    """Groups around one passage each: near copies of a hidden original, chains of small changes, sizes around powers of two."""
    rng, rows = random.Random(seed), []
    for g, size in enumerate((250, 256, 262, 500, 60)):
        base = [f"g{g}w{k}" for k in range(size)]
        own = list(base)
        for i in range(30):
            if i % 3:
                own = list(base)
            for _ in range(rng.randrange(0, 4)):
                own[rng.randrange(len(own))] = f"e{g}x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own[: len(own) - rng.randrange(0, 5)])))
    return rows


def drifted(rng, n, size, changes):
    """n sets of `size` values, with up to `changes` values of their own each."""
    base = [rng.getrandbits(64) for _ in range(size)]
    return [np.array(sorted({*base[(k := rng.randrange(changes)) :], *(rng.getrandbits(64) for _ in range(k))}), np.uint64) for _ in range(n)]


def test_a_class_stands_once_in_the_leaves_of_a_region(spark):
    """Regions of drifting near copies, below and above the size at which every class is a pivot: links stay, classes are not repeated."""
    rng, rules, rows, sets = random.Random(3), jaccard.JaccardRules(), [], {}
    for region, n in enumerate((2, 40, 150, 60)):
        group = [*drifted(rng, n - n // 4, 400, 90), *drifted(rng, n // 4, 300, 20)]
        sizes = np.array([len(x) for x in group])
        found = jaccard.sketches(np.concatenate(group), np.repeat(np.arange(len(group)), sizes), sizes)
        least = min(8 * len(x) for x in found)
        for x, size, sketch in zip(group, sizes.tolist(), found, strict=True):
            sets[len(sets)] = x
            rows.append((region, len(rows), size, least, sketch))
    got = jaccard._leaves(spark.createDataFrame(rows, jaccard.REGION), 2, rules).collect()
    assert len(got) <= len(rows)
    leaf = collections.defaultdict(set)
    for r in got:
        leaf[r["class"]].add(r.key)
    linked = 0
    for i, (region, *_) in enumerate(rows):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if region == rows[j][0] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                linked += 1
                assert leaf[i] & leaf[j]
    assert linked > len(rows)


@pytest.mark.parametrize("bit_bytes", [1 << 26, 0])
def test_overlaps_match_intersections(monkeypatch, bit_bytes):
    monkeypatch.setattr(jaccard, "BIT_BYTES", bit_bytes)
    rng = random.Random(6)
    sets = [*drifted(rng, 70, 200, 60), *drifted(rng, 5, 3, 2)]
    shared = jaccard.Overlaps(sets)
    for q in range(12):
        at = np.array([i for i in range(len(sets)) if i != q])
        assert shared.of(q, at).tolist() == [len(np.intersect1d(sets[q], sets[i])) for i in at]
    assert (shared.bits is None) == (not bit_bytes)
    # few comparisons a set: links are as by brute force
    root = {i: i for i in range(len(sets))}

    def top(i):
        return i if root[i] == i else top(root[i])

    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[top(i)] = top(j)
    links = jaccard.join_region(sets, jaccard.JaccardRules())
    assert len(links) == len(sets) - len({top(i) for i in root}) and all(top(a) == top(b) for a, b in links)


def test_prefixes_begin_with_rare_words(spark):
    """Texts of common phrases between words of their own seldom meet in a neighbourhood."""
    rng = random.Random(9)
    rows = []
    for i in range(120):
        text = []
        for k in range(40):
            text += [f"own{i}x{k}", *(f"c{rng.randrange(2)}" for _ in range(7))]
        rows.append((i, " ".join(text)))
    docs, rules = spark.createDataFrame(rows, "doc_id long, text string").repartition(1), jaccard.JaccardRules(hot_least=1000)
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs, rules).collect()) == plain_components(rows, 5, 80)
    counts = jaccard._classes(docs, rules).filter("kind = 2").select("class", "n")
    empty = np.zeros(0, np.uint64)
    met = [jaccard._neighbourhoods(jaccard._keys(docs, empty, w, jaccard.Names(empty, empty), 4, rules), 2, rules).count() for w in (np.zeros(jaccard.SLOTS, np.uint8), jaccard._weights(counts))]
    assert met[0] > 100 and met[1] < met[0] / 5


@pytest.mark.parametrize("region", [4, 12])
def test_regions_beyond_a_task(spark, region):
    """Small limits: regions split over levels, and crowds that no window splits are joined by chunks."""
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rules = jaccard.JaccardRules(words=3, similarity=90, region=region, fan=3)
    got = jaccard.near_duplicates(docs, rules)
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == plain_components(rows, 3, 90)


def test_every_link_of_a_crowd(spark):
    rows = near_copies(5)[:60]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    few = jaccard.similar_classes(docs, jaccard.JaccardRules(words=3, similarity=90, region=8, fan=3))
    assert set(map(tuple, few.collect())) == set(map(tuple, jaccard.similar_classes(docs, jaccard.JaccardRules(words=3, similarity=90)).collect()))


def test_shared_class_names_are_told_apart(docs, texts):
    got = jaccard.near_duplicates(docs, jaccard.JaccardRules(name_bits=4))
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == plain_components(texts, 5, 80)


def test_components_of_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101)], "a long, b long")
    got = {r["class"]: r.root for r in jaccard.components(links).collect()}
    assert got == {i: 0 for i in range(1, 31)} | {101: 100}


# ---- op 3 ----------------------------------------------------------------------------


@pytest.mark.parametrize("rules", [linededup.LineRules(min_pages=2), linededup.LineRules(min_pages=2, max_broadcast_lines=0, salts=3)])
def test_line_dedup_matches_plain(docs, rules, nothing):
    rows = docs.collect()
    pages = collections.Counter(r.source for r in rows)
    seen = collections.Counter((r.source, x) for r in rows for x in set((r.text or "").split("\n")) if r.text is not None and tokens(x))
    bad = {k for k, n in seen.items() if n >= 2 and n > 0.1 * pages[k[0]]}
    wanted = collections.Counter()
    for r in rows:
        lines = (r.text or "").split("\n")
        kept = [x for x in lines if (r.source, x) not in bad]
        wanted[(r.doc_id, r.source, None if r.text is None else "\n".join(kept), 0 if r.text is None else len(lines) - len(kept), r.line_host)] += 1
    out = linededup.drop_boilerplate(docs, F.col("source"), rules=rules, dropped="gone")
    assert out.columns == [*docs.columns, "gone"]
    assert collections.Counter((r.doc_id, r.source, r.text, r.gone, r.line_host) for r in out.collect()) == wanted
    assert bad and linededup.drop_boilerplate(nothing, F.col("source")).count() == 0


def test_line_dedup_of_pages_by_url_host(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rules = linededup.LineRules(min_pages=2)
    rows = [(re.sub(r"^[a-z]+://(?:[^/@]*@)?([^/:?#]+).*", r"\1", r.url).lower(), r.html) for r in pages.collect()]
    total = collections.Counter(h for h, _ in rows)
    seen = collections.Counter((h, x) for h, t in rows for x in set((t or "").split("\n")) if t is not None and tokens(x))
    bad = {k for k, n in seen.items() if n >= 2 and n > 0.1 * total[k[0]]}
    out = linededup.drop_boilerplate(pages, linededup.url_host(F.col("url")), text="html", rules=rules)
    assert collections.Counter(r.html for r in out.collect()) == collections.Counter(None if t is None else "\n".join(x for x in t.split("\n") if (h, x) not in bad) for h, t in rows)
    odd = spark.createDataFrame([("no url",), (None,), ("http://A.b:8/x",)], "url string").select(linededup.url_host(F.col("url")).alias("h"))
    assert [r.h for r in odd.collect()] == [None, None, "a.b"]


# ---- op 4 ----------------------------------------------------------------------------


def plain_repeats(rows, k=20):
    first = {}
    listed = [(-(2**63) if i is None else i, tokens(t)) for i, t in rows]
    for i, w in sorted(listed, key=lambda r: r[0]):
        for s in range(len(w) - k + 1):
            g = tuple(w[s : s + k])
            first[g] = min(first.get(g, (i, s)), (i, s))
    out = collections.Counter()
    for (name, _), (i, w) in zip(rows, listed, strict=True):
        gone = {j for s in range(len(w) - k + 1) if first[tuple(w[s : s + k])] < (i, s) for j in range(s, s + k)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[(name, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("rules", [substrings.RepeatRules(), substrings.RepeatRules(bucket_bytes=600, hot_share=5)])
def test_repeats_match_plain(docs, texts, rules, nothing):
    out = substrings.remove_repeats(docs, rules, digest=True)
    assert collections.Counter(tuple(r) for r in out.collect()) == plain_repeats(texts)
    assert substrings.remove_repeats(nothing, rules).count() == 0
    kept = substrings.remove_repeats(docs, rules).filter("doc_id = 4").first().kept
    assert kept == "two Words"


def test_equal_hashes_are_told_apart():
    words = np.array([1, 2, 3, 9, 1, 2, 4, 9, 1, 2, 3], np.uint64)
    at = np.array([0, 4, 8])
    same = np.zeros(3, np.uint64)  # one hash for unequal windows
    got = substrings._repeats(words, at, same, np.array([0, 1, 2]), np.zeros(3, np.int64), 3)
    assert got.tolist() == [False, False, True]


# ---- op 6 ----------------------------------------------------------------------------


@pytest.mark.parametrize("split", [97, 4096, 1 << 22])
def test_warc_round_trip(spark, split):
    rng = random.Random(3)
    html = [None, "", "<p>é</p>", "x" * 50_000, "\x1f\x8b\x08 WARC/1.1 \r\n\r\n", *("page %d " % rng.randrange(9) * 30 for _ in range(60))]
    rows = [(k * 3 - 7, None if k % 7 == 0 else f"http://h{k % 3}/a\r\nb", h, "extra") for k, h in enumerate(html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    manifest = warc.write_warc(pages, scratch(spark, "warc"))
    got = warc.read_warc(manifest, split).collect()
    top = {}
    for i, _, h, _ in rows:
        top[h or ""] = max(top.get(h or "", i), i)
    assert len(got) == len(rows)
    for r in got:
        h = next(h for i, _, h, _ in rows if i == r.page_id) or ""
        first = top[h]
        assert r.payload_bytes == len(h.encode()) and r.payload_digest == warc.digest(h.encode())
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == first else ("revisit", first))
        assert (r.payload.decode() if r.payload is not None else None) == (h if r.page_id == first else None)
    path = manifest.first().path.removeprefix("file:")
    assert gzip.decompress(open(path, "rb").read()).count(b"WARC/1.1\r\n") >= 1


def test_warc_damage_and_thresholds(spark):
    members = [warc.encode_record(i, None, bytes([65 + i]) * 3000, None) for i in range(5)]
    broken = members[1][:40] + b"\0" * 30 + members[1][70:]

    class File:
        def __init__(self, data):
            self.data = data

        def seek(self, at):
            self.at = at

        def read(self, n):
            return self.data[self.at : self.at + n]

    data = b"junk" + members[0] + broken + members[2] + members[3] + members[4][:-9]
    window = warc._Window(File(data), len(data))
    found = list(warc.read_range(window, 0, len(data)))
    assert [r["page_id"] for r in found if r["record_type"]] == [0, 2, 3]
    assert [r["place"] for r in found if not r["record_type"]] == [0, 4 + len(members[0]), len(data) - len(members[4]) + 9]
    assert warc.page_of(warc.record_urn(-3)) == -3
    pages = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "b" * 50), (4, "u", "b" * 50)], "page_id long, url string, html string")
    got = {r.page_id: r.record_type for r in warc.archive_round_trip(spark, pages, min_bytes=10).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    assert warc.archive_round_trip(spark, pages.limit(0)).count() == 0


def test_warc_members_around_the_buffer(spark):
    """A member that starts at any place about the end of the reader's buffer is found."""

    class File:
        def __init__(self, data):
            self.data = data

        def seek(self, at):
            self.at = at

        def read(self, n):
            return self.data[self.at : self.at + n]

    after = warc.encode_record(2, None, b"b" * 300, None) + warc.encode_record(3, None, b"c" * 300, None)
    first = warc.encode_record(1, None, b"a" * 300, None)
    for shift in range(-5, 6):
        # followed from a member that ends there, and scanned for after bytes that are none
        noise = random.Random(1).randbytes(warc.READ)
        extra, have = 0, warc.READ + shift
        while True:  # a gzip comment fills the first member up to the wanted size
            room = have - len(first) - 1 - extra
            padded = first[:3] + b"\x10" + first[4:10] + b"x" * room + b"\0" + first[10:]
            if len(padded) == have:
                break
            extra += len(padded) - have
        for data, wanted in ((padded + after, [1, 2, 3]), (noise.replace(warc.MAGIC, b"---")[: warc.READ + min(shift, 0)] + b"-" * max(shift, 0) + after, [2, 3])):
            window = warc._Window(File(data), len(data))
            assert [r["page_id"] for r in warc.read_range(window, 0, len(data)) if r["record_type"]] == wanted, shift


def test_warc_counts_follow_the_manifest(spark):
    pages = spark.createDataFrame([(k, "u", f"page {k}") for k in range(5)], "page_id long, url string, html string").coalesce(1)
    manifest = warc.write_warc(pages, scratch(spark, "warc"))
    warc.check_counts(manifest, warc._read(manifest, 100, False))
    with pytest.raises(ValueError, match="5 of 6"):
        warc.check_counts(manifest.withColumn("n_records", F.col("n_records") + 1), warc._read(manifest, 100, False))


def test_null_page_ids(spark):
    rows = [(None, "u", "same"), (4, "u", "same"), (None, "v", "own"), (None, None, "own")]
    got = warc.archive_round_trip(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert collections.Counter((r.page_id, r.url, r.record_type, r.refers_to) for r in got) == collections.Counter([(None, "u", "revisit", 4), (4, "u", "response", None), (None, "v", "response", None), (None, None, "response", None)])


@pytest.mark.parametrize("split", [50, 700, 1 << 20])
def test_foreign_archives(spark, tmp_path, split):
    """Records of every kind, as other writers make them."""

    def record(kind, block, **fields):
        head = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:0a1b2c3d-0000-4000-8000-00000000000%d>" % len(kind), "WARC-Date: 2020-02-02T02:02:02Z", f"content-length:{len(block)}"]
        head += [f"{k.replace('_', '-')}: {v}" for k, v in fields.items()]
        return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    http = {"Content_Type": "application/http; msgtype=response"}
    plain = b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\n<p>no length</p>"
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n4\r\nWiki\r\n6;x=1\r\npedia \r\n0\r\n\r\n"
    lying = b"HTTP/1.1 200 OK\r\nContent-Length: 999\r\n\r\nshort"
    asked = b"GET / HTTP/1.1\r\nHost: h\r\n\r\n"
    seen = b"HTTP/1.1 304 Not Modified\r\nContent-Length: 77\r\n\r\n"
    members = [
        record("warcinfo", b"software: other\r\n", Content_Type="application/warc-fields"),
        record("request", asked, Content_Type="application/http; msgtype=request"),
        record("response", plain, **http, WARC_Target_URI="http://a/b c") + record("metadata", b"k: v"),
        record("response", chunked, **http, WARC_Payload_Digest="sha1:" + warc.digest(b"Wikipedia ")),
        record("response", lying, **http, WARC_Payload_Digest="sha1:AAAA"),
        record("revisit", seen, **http, WARC_Payload_Digest="sha1:BBBB", WARC_Refers_To="<urn:uuid:0a1b2c3d-0000-4000-8000-000000000001>"),
        b"not a record",
        record("resource", b"", Content_Type="text/plain\r\n and more"),
        record("response", plain, **http).replace(b"content-length:%d" % len(plain), b"content-length:99999"),
        record("conversion", b"text \x1f\x8b\x08 text"),
    ]
    path = tmp_path / "foreign.warc.gz"
    path.write_bytes(b"".join(gzip.compress(m) for m in members))
    manifest = spark.createDataFrame([(f"file://{path}", path.stat().st_size)], "path string, n_bytes long")
    got = warc.read_warc(manifest, split).orderBy("place", F.desc("payload_bytes")).collect()
    assert [(r.record_type, r.payload_bytes, bytes(r.payload) if r.payload is not None else None, r.digest_ok) for r in got] == [
        ("warcinfo", 17, b"software: other\r\n", None), ("request", 0, b"", None), ("response", 16, b"<p>no length</p>", None), ("metadata", 4, b"k: v", None),
        ("response", 10, b"Wikipedia ", True), ("response", 5, b"short", False), ("revisit", 77, None, None), ("resource", 0, b"", None), ("conversion", 13, b"text \x1f\x8b\x08 text", None),
    ]
    assert all(r.page_id is None and r.refers_to is None and r.date == "2020-02-02T02:02:02Z" for r in got)
    assert got[2].url == "http://a/b c" and got[5].payload_digest == warc.digest(b"short") and got[6].payload_digest == "BBBB" and got[6].refers_to_id.endswith("1>")
    assert got[7].headers["content-type"] == "text/plain and more"
    assert [r.n for r in warc.rejected(manifest, 1 << 20).collect()] == [2]


def test_paths_of_stores():
    for path in ("file:/tmp/x", "file:///tmp/x", "/tmp/x"):
        assert warc._open(path)[1] == "/tmp/x"
    assert warc._open("dbfs:/a/b")[1] == "/dbfs/a/b"


def test_files_are_of_bounded_size(spark):
    pages = spark.createDataFrame([(k, "u", str(random.Random(k).random()) * 50) for k in range(40)], "page_id long, url string, html string").coalesce(1)
    manifest = warc.write_warc(pages, scratch(spark, "warc"), file_bytes=2000)
    assert manifest.count() > 3 and warc.read_warc(manifest).count() == 40


# ---- op 8 ----------------------------------------------------------------------------


def plain_contamination(rows, items, k=10):
    windows = collections.defaultdict(set)
    for item, t in items:
        w = tokens(t, ALNUM, True)
        if w and item is not None:
            for s in range(max(1, len(w) - k + 1)):
                windows[tuple(w[s : s + k])].add(str(item))
    out = collections.Counter()
    sizes = {len(g) for g in windows}
    for i, t in rows:
        w, hit, found = tokens(t, ALNUM, True), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if got := windows.get(tuple(w[s : s + n])):
                    hit.update(range(s, s + n))
                    found |= got
        out[(i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))] += 1
    return out


def items_of(texts):
    cut = lambda t, a, b: " ".join(tokens(t)[a:b])
    return [(1, cut(texts[12][1], 3, 40)), (2, cut(texts[16][1], 0, 12).upper()), (10, "Two, words"), (11, None), (12, ""), (None, "one"), (13, "unseen words only here and nowhere else at all in any text"), (14, cut(texts[73][1], 2, 30)), (15, "日本 é")]


@pytest.mark.parametrize("block_bytes", [1, 1 << 20])
def test_contamination_matches_plain(spark, docs, texts, nothing, block_bytes):
    items = items_of(texts)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rules = decontaminate.MatchRules(block_bytes=block_bytes)
    index = decontaminate.build_index(docs, scratch(spark, "index"))
    got = collections.Counter(tuple(r) for r in decontaminate.contamination_report(index, benchmark, rules).collect())
    assert got == plain_contamination(texts, items)
    kept = decontaminate.decontaminate(docs, benchmark, rules)
    clean = collections.Counter(i for i, t in texts if not any(k[-1] for k in plain_contamination([(i, t)], items)))
    assert collections.Counter(r.doc_id for r in kept.collect()) == clean
    empty = decontaminate.build_index(nothing, scratch(spark, "index"))
    assert decontaminate.contamination_report(empty, benchmark).count() == 0
    none = decontaminate.contamination_report(index, benchmark.limit(0))
    assert none.filter("contaminated").count() == 0 and none.count() == len(texts)


def test_rows_are_judged_by_their_own_text(spark):
    item = " ".join(f"q{i}" for i in range(12))
    rows = [(1, "x " + item), (1, "clean one"), (None, item + " y"), (None, "clean too"), (2, None), (3, "")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, hit_digest int")
    benchmark = spark.createDataFrame([("i", item)], "item_id string, text string")
    kept = sorted(((r.doc_id or 0, r.text or "") for r in decontaminate.decontaminate(docs, benchmark).collect()))
    assert kept == [(0, "clean too"), (1, "clean one"), (2, ""), (3, "")]


def test_a_search_reads_the_parts_of_its_terms(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(f"t{rng.randrange(40_000)}" for _ in range(4000))) for i in range(50)]
    rows.append((99, "alpha beta gamma"))
    index = decontaminate.build_index(spark.createDataFrame(rows, "doc_id long, text string"), scratch(spark, "index"))
    parts = decontaminate._parts_of(["alpha", "beta", "gamma"])
    assert 1 <= len(parts) <= 3
    size = index.agg(*(F.sum(F.octet_length(c)).alias(c) for c in decontaminate._columns(range(decontaminate.PARTS)))).first().asDict()
    assert 20 * sum(size[c] for c in decontaminate._columns(parts)) < sum(size.values())
    benchmark = spark.createDataFrame([("i", "alpha beta gamma")], "item_id string, text string")
    assert [(r.doc_id, r.start, r.stop) for r in decontaminate.phrase_matches(index, benchmark).collect()] == [(99, 0, 3)]


def test_proximity_matches_plain(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("abcdefghij") for _ in range(80))) for i in range(12)]
    benchmark = spark.createDataFrame([(1, "a b c"), (2, "zz a b")], "item_id long, text string")
    rules = decontaminate.MatchRules(proximity=3, slop=4)
    index = decontaminate.build_index(spark.createDataFrame(rows, "doc_id long, text string"), scratch(spark, "index"))
    got = {(r.doc_id, r.item_id, r.start) for r in decontaminate.proximity_matches(index, benchmark, rules).collect()}
    wanted = set()
    for i, t in rows:
        w = t.split()
        for s in range(len(w)):
            if w[s] in "abc" and set("abc") <= set(w[s : s + 4]):
                wanted.add((i, "1", s))
    assert got == wanted and wanted


# ---- op 9 ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(pieces.model_bytes(pieces.default_model()))


def encode_all(coder, found):
    data, offsets = tb.utf8(pa.array(found, pa.string()))
    return coder.encode(data, offsets, np.arange(len(found)))


def test_without_dropout_equals_library(model, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    found = [t for _, t in texts if t and "▁" not in t and len(t) < 40_000] + ["  lead", "x ", "\n\n", "a\r\nb", "🙂" * 9]
    ids, offsets = encode_all(pieces.Encoder(model, pieces.Dropout(rate=0.0)), found)
    for i, text in enumerate(found):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == library.encode(text)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="ab et\n\r▁é日🙂 .the", max_size=90), min_size=1, max_size=5), st.sampled_from([0.0, 0.1, 0.6, 1.0]))
def test_agenda_equals_arrays_and_decodes(found, rate):
    model = pieces.encoder(pieces.model_bytes(pieces.default_model()), pieces.Dropout()).pieces
    results = []
    for long in (0, 10**6):
        old, pieces.LONG = pieces.LONG, long
        try:
            coder = pieces.Encoder(model, pieces.Dropout(rate=rate))
            ids, offsets = encode_all(coder, found)
        finally:
            pieces.LONG = old
        results.append((ids.tolist(), offsets.tolist()))
        data, bounds = coder.decode(ids, offsets)
        assert [data[a:b].tobytes().decode() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == found
    assert results[0] == results[1]


def plain_dropout(model, text, doc_id, dropout):
    """Chunk by chunk, each occurrence through the agenda under its own key."""
    coder, out = pieces.Encoder(model, dropout), []
    data, starts, _ = coder._cut(*tb.utf8(pa.array([text], pa.string())))
    hashes = coder.hasher.spans(data, starts, np.append(starts[1:], len(data)))
    for k, (a, b) in enumerate(zip(starts, np.append(starts[1:], len(data)), strict=True)):
        chars = data[a:b].tobytes().decode()
        codes = {int.from_bytes(c.encode(), "little"): c for c in chars}
        known = {codes[int(key)]: int(i) for key, i in zip(model.char_keys, model.char_ids, strict=True) if int(key) in codes}
        drawn = tb.mix64(tb.keyed64(np.array([doc_id]), dropout.seed) + np.uint64(k))
        key = int(tb.mix64(hashes[k : k + 1] + drawn * np.uint64(0xA0761D6478BD642F))[0])
        for i, first, stop in pieces.agenda(model, [known.get(c, -1) for c in chars], key, dropout.rate):
            out += [i] if i >= 0 else [int(model.byte_id[x]) for x in chars[first:stop].encode()]
    return out


@pytest.mark.parametrize("rate", [0.1, 0.5])
def test_documents_match_plain_dropout(spark, model, rate):
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect() if len(r.text or "") < 3000][:40]
    found = [(r.doc_id, r.text) for r in rows] + [(rows[0].doc_id, rows[0].text), (10**6, "ab " * 300)]
    got = {}
    for r in pieces.encode(spark.createDataFrame(found, "doc_id long, text string"), pieces.Dropout(rate=rate)).collect():
        got.setdefault(r.doc_id, r.ids)
    for i, text in found:
        assert got[i] == plain_dropout(model, text, i, pieces.Dropout(rate=rate))


def test_dropout_varies_and_repeats(spark, docs, texts, nothing, model):
    out = pieces.encode(docs).cache()
    assert out.filter("NOT lossless").count() == 0 and out.count() == len(texts)
    assert sorted((r.doc_id or 0, r.ids) for r in out.collect()) == sorted((r.doc_id or 0, r.ids) for r in pieces.encode(docs.repartition(2)).collect())
    back = collections.Counter((r.doc_id, r.text) for r in pieces.decode(out).collect())
    assert back == collections.Counter((i, t or "") for i, t in texts)
    assert pieces.encode(nothing).count() == 0
    word = ["international"] * 400
    ids, offsets = encode_all(pieces.Encoder(model, pieces.Dropout(rate=0.3)), word)
    assert len({tuple(ids[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)}) > 20
    ids, offsets = encode_all(pieces.Encoder(model, pieces.Dropout(rate=0.3, variants=4)), word)
    assert 1 < len({tuple(ids[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)}) <= 4
    a = pieces.encode(docs, pieces.Dropout(seed=1)).agg(F.sum("n_pieces")).first()[0]
    b = pieces.encode(docs, pieces.Dropout(rate=0.0)).agg(F.sum("n_pieces")).first()[0]
    assert a > b
    memory = pieces.Encoder(model, pieces.Dropout(), memory=3)
    for _ in range(3):
        again, _ = encode_all(memory, [t for _, t in texts[:30] if t])
    plain, _ = encode_all(pieces.Encoder(model, pieces.Dropout()), [t for _, t in texts[:30] if t])
    assert np.array_equal(again, plain)


# ---- names and fingerprints ------------------------------------------------------------


def test_a_line_built_to_share_a_quick_hash_stays(spark):
    """Its 64-bit hash is that of a line on nearly every page."""
    other = "xkEkRffi\\M#5d5/N"
    rows = [(i, "Copyright notice\nown " + str(i), "s") for i in range(20)] + [(20, other, "s")]
    pages = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: r.text for r in linededup.drop_boilerplate(pages, F.col("source"), dropped="Source").collect()}
    assert out[20] == other and out[0] == "own 0"


def test_any_extra_columns(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, 1, 1, "x"), (2, text + " tail", 2, 2, "y"), (3, "q " + text, 3, 3, "z"), (1, text, 1, 0, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone_key int, gone_digest int, e string").withColumnRenamed("e", "a.b")
    out = jaccard.drop_near_duplicates(df)
    assert out.columns == df.columns and [r.doc_id for r in out.collect()] == [1]
    kept = repetition.quality_filter(df)
    assert kept.columns == df.columns and kept.count() == 4
