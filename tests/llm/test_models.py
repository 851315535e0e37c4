"""Models: exact counts against plain versions, and held-out quality."""

from __future__ import annotations

import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratavox.llm import importance, pitmanyor, toxicity
from stratavox.llm import textblocks as tb
from stratavox.llm.storage import least_hashed

SF = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- op 5 ----------------------------------------------------------------------------


def test_cut_is_exact(spark):
    rng = np.random.default_rng(1)
    values = np.round(rng.normal(size=3000), 3).tolist()
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 2, 700, 2999, 3000):
        assert importance.largest_cut(df, "x", k, bins=16) == sorted(values, reverse=True)[k - 1]
    assert importance.largest_cut(df, "x", 0) is None and importance.largest_cut(df, "x", 3001) is None
    assert importance.largest_cut(df.withColumn("x", F.lit(2.0)), "x", 5) == 2.0


def test_resampling_prefers_the_target(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rules = importance.ResampleRules(max_target=1500)
    out = importance.resample(docs, labels, rules).cache()
    n = docs.count()
    assert out.count() == n and out.filter("kept").count() == int(0.8 * n)
    used = set(importance.target_ids(labels, rules).tolist())
    rest = [(r.quality, r.kept) for r in out.join(labels, "doc_id").collect() if r.doc_id not in used]
    good = np.mean([k for q, k in rest if q == 1])
    bad = np.mean([k for q, k in rest if q == 0])
    assert good > 0.85 and bad < 0.1  # four fifths are kept, so at most 0.92 of the good ones could be
    again = importance.resample(docs.repartition(5), labels, rules)
    assert {r.doc_id for r in out.filter("kept").collect()} == {r.doc_id for r in again.filter("kept").collect()}


def test_weights_match_plain(spark, docs, texts):
    """Counts, ratios, weights and Gumbel keys against loops over counters."""
    labels = spark.createDataFrame([(i, 1 if i % 3 else 0) for i, _ in texts if i is not None and 0 < i < 60], "doc_id long, quality int")
    rules = importance.ResampleRules(buckets=257, share=0.5)
    good, hasher = {i for i, _ in texts if i is not None and 0 < i < 60 and i % 3}, tb.Hasher(lower=False)

    def grams(t):
        block = next(tb.blocks(pa.array([t or ""]), tb.whitespace_words()))
        h = hasher.spans(block.data, block.starts, block.ends)
        pairs = [tb.ngram_hash(h, np.array([k]), 2)[0] for k in range(len(h) - 1)]
        return [int(x) % 257 for x in [*h, *pairs]]

    found = [(i, grams(t)) for i, t in texts]
    raw, target = collections.Counter(), collections.Counter()
    for i, g in found:
        raw.update(g)
        if i in good:
            target.update(g)
    ratio = [math.log((target[k] + 1) / (sum(target.values()) + 257)) - math.log((raw[k] + 1) / (sum(raw.values()) + 257)) for k in range(257)]
    wanted = collections.Counter()
    for i, g in found:
        weight = sum(ratio[k] for k in g)
        x = (-1 if i is None else i) + rules.seed * 0x9E3779B97F4A7C15 + 0x1234567
        x %= 2**64
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> shift)) * factor % 2**64
        uniform = (((x ^ (x >> 31)) >> 11) + 0.5) / 2**53
        wanted[(i, len(g), round(weight, 6), round(weight - math.log(-math.log(uniform)), 6))] += 1
    out = importance.resample(docs, labels, rules).collect()
    assert collections.Counter((r.doc_id, r.n_ngrams, round(r.log_weight, 6), round(r.sample_key, 6)) for r in out) == wanted
    cut = sorted((r.sample_key for r in out), reverse=True)[int(0.5 * len(out)) - 1]
    assert all(r.kept == (r.sample_key >= cut) for r in out)


def test_resampling_odd_rows(spark, docs, nothing):
    labels = spark.createDataFrame([(10, 1), (None, 1), (11, 0)], "doc_id long, quality int")
    out = importance.resample(docs, labels)
    assert out.count() == docs.count()
    assert {r.log_weight for r in out.filter("n_ngrams = 0").collect()} == {0.0}
    assert importance.resample(docs, labels.limit(0)).agg(F.max(F.abs("log_weight"))).first()[0] == 0
    assert importance.resample(nothing, labels).count() == 0


# ---- op 7 ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def toxic(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    return docs, labels, model, toxicity.score(docs, model).cache()


def test_toxicity_held_out(toxic):
    docs, labels, model, scores = toxic
    assert scores.count() == docs.count()
    rows = scores.join(labels, "doc_id").filter("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    hit = np.mean([r.predicted for r in rows if r.toxic == 1])
    false = np.mean([r.predicted for r in rows if r.toxic == 0])
    assert hit > 0.8 and false < 0.01


def test_label_model_has_accuracies_and_correlations(toxic):
    model = toxic[2].labels
    assert model.accuracies()[: len(toxicity.LEXICON)].min() > 0.5
    assert model.accuracies()[-1] < 0.1
    assert (model.parent >= 0).any()


def test_dependent_voters_share_evidence():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.2
    a = np.where(y, rng.random(4000) < 0.7, rng.random(4000) < 0.02)
    b = np.where(y, rng.random(4000) < 0.7, rng.random(4000) < 0.02)
    fired = np.stack([a, a, b], 1).astype(float)
    weight = np.array([(~y).sum(), y.sum()], float)
    fires = np.stack([(~y).astype(float) @ fired, y.astype(float) @ fired])
    pairs = np.stack([(fired * (~y)[:, None]).T @ fired, (fired * y[:, None]).T @ fired])
    model = toxicity.from_sums(weight, fires, pairs)
    assert model.parent[1] == 0  # the copy, whose firing says nothing more
    one, two, both = model.posterior(np.array([[1.0, 0, 0], [1, 1, 0], [1, 1, 1]]))
    assert two == pytest.approx(one, abs=0.02) and both > two
    assert model.rates[1] == pytest.approx(0.7, abs=0.05)


def test_votes_and_em_match_plain(spark):
    """Votes by sets of strings and EM by loops over a small table."""
    rng = np.random.default_rng(3)
    bad, mild = ["idiot", "moron", "scum", "liar", "trash"], [f"word{i}" for i in range(30)]
    rows = []
    for i in range(60):
        w = [mild[k] for k in rng.integers(0, 30, 12)] + ([bad[k] for k in rng.integers(0, 5, 2)] if i % 3 == 0 else [])
        rows.append((i, " ".join(w).upper() if i % 7 == 0 else "! " * (i % 5 == 0) + " ".join(w)))
    entries = ["word1", "word7", "scum"]
    hasher = tb.Hasher(lower=True)
    block = next(tb.blocks(pa.array([" ".join(entries)]), tb.alnum_words()))
    hashes = hasher.spans(block.data, block.starts, block.ends)
    hashes = np.append(hashes, tb.mix64(hasher.spans(block.data, block.starts[:1], block.starts[:1] + 4) + np.uint64(4)))  # the beginning "word"
    voters = toxicity.Voters(hashes)
    order = [[*entries, ""][k] for k in np.argsort(hashes)]
    docs = next(tb.blocks(pa.array([t for _, t in rows]), tb.alnum_words()))
    fired = voters.fire(docs, *toxicity._features(docs, hasher))
    plain = []
    for _, t in rows:
        own = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER)))
        vote = [bool(own & set(group)) for group in toxicity.LEXICON.values()]
        vote += [sum(c.isupper() for c in t) > 0.5 * len(t), t.count("!") > 0.01 * len(t), sum(c in "#*$%&" for c in t) > 0.05 * len(t)]
        vote += [e in own if e else any(w[:4] == "word" and len(w) > 4 for w in own) for e in order]
        plain.append(vote + [not any(vote[: len(toxicity.LEXICON)]) and not any(vote[-len(order) :])])
    assert fired.tolist() == plain

    ids, toxic = np.arange(0, 30), (np.arange(0, 30) % 3 == 0).astype(np.int64)
    packed = np.packbits(fired, axis=1)
    votes = spark.createDataFrame([(i, bytearray(p.tobytes())) for (i, _), p in zip(rows, packed, strict=True)], "doc_id long, fired binary").repartition(3)
    rules = toxicity.ToxicityRules(rounds=3)
    got = toxicity.fit_label_model(votes, voters, ids, toxic, rules)
    model = toxicity._first_model(voters, float(np.clip(toxic.mean(), 0.01, 0.5)))
    for step in range(rules.rounds):
        n = voters.n
        weight, fires, pairs = [0.0, 0.0], [[0.0] * n, [0.0] * n], [[[0.0] * n for _ in range(n)] for _ in (0, 1)]
        for i, vote in enumerate(plain):
            if step == 0 and i >= 30:
                continue
            odds = math.log(model.prior / (1 - model.prior))
            for j in range(n):
                if vote[j]:
                    s = int(model.parent[j] >= 0 and vote[model.parent[j]])
                    odds += math.log(model.given[1][s][j] / model.given[0][s][j])
            p = float(toxic[i]) if i < 30 else 1 / (1 + math.exp(-odds))
            for c, x in ((0, 1 - p), (1, p)):
                weight[c] += x
                for j in range(n):
                    fires[c][j] += x * vote[j]
                    for k in range(n):
                        pairs[c][j][k] += x * (vote[j] and vote[k])
        model = toxicity.from_sums(np.array(weight), np.array(fires), np.array(pairs))
    assert got.parent.tolist() == model.parent.tolist()
    assert got.prior == pytest.approx(model.prior) and np.allclose(got.rates, model.rates) and np.allclose(got.given, model.given)


def test_least_hashed_is_exact(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    wanted = [r.k for r in df.orderBy(F.xxhash64("k", F.lit(3)), "k").limit(40).collect()]
    assert [r.k for r in least_hashed(df, ["k"], 3, 40).collect()] == wanted
    assert least_hashed(df, ["k"], 3, 9000).count() == 5000


def test_toxicity_odd_rows(spark, docs, nothing):
    labels = spark.createDataFrame([(10, 1), (12, 0), (None, 1), (11, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs, model)
    rows = out.collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert toxicity.score(nothing, model).count() == 0
    assert toxicity.fit(nothing, labels.limit(0)).weights.shape == (1,)


# ---- op 10 ---------------------------------------------------------------------------


def plain_base(rows):
    found = [(i, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + ["\0end"]) for i, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in found]
    c = collections.Counter(w for (_, x), h in zip(found, held, strict=True) if not h for w in x)
    n, v = sum(c.values()), len(c)
    return collections.Counter((i, h, len(x), sum(c[w] > 0 for w in x), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x), 6)) for (i, x), h in zip(found, held, strict=True))


@pytest.mark.parametrize("rules", [pitmanyor.PitmanYor(), pitmanyor.PitmanYor(bucket_bytes=2000, flush=300, splits=3)])
def test_counts_match_plain(docs, texts, rules, nothing):
    out = pitmanyor.perplexity_scores(docs, rules).collect()
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == plain_base(texts)
    assert all(-1e7 < r.score < 0 for r in out)
    assert pitmanyor.perplexity_scores(nothing).count() == 0


def test_totals_outlast_frequent_words(spark):
    """Few texts of words more frequent than the number of texts: the bounded list of words keeps the totals."""
    rows = [(i, " ".join(f"w{k}" for k in range(6)) + " " + " ".join(f"w{k}" for k in range(6)) * (40 + i)) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _, tokens, texts = pitmanyor._first_look(docs.select((~pitmanyor.is_held_out(F.col("doc_id"))).alias("train"), "text"), 1)
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    assert (tokens, texts) == (sum(len(t.split()) + 1 for t in train), len(train))
    out = pitmanyor.perplexity_scores(docs).collect()
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == plain_base(rows)


def test_model_beats_base_on_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = pitmanyor.perplexity_scores(docs).filter("held_out").agg(F.sum("n_tokens").alias("n"), F.sum("base_score").alias("b"), F.sum("score").alias("s")).first()
    assert got.s > got.b * 0.9  # log10 probabilities are below zero: at least a tenth nearer to it


def test_predictions_sum_to_one(monkeypatch):
    """Over all dishes of the vocabulary and one unknown, with seatings of both levels."""
    rng = np.random.default_rng(2)
    v, contexts = 30, 5
    counts = rng.poisson(rng.gamma(0.3, 4.0, (contexts, v)))
    counts[:, counts.sum(0) == 0] = 1
    u, w = np.nonzero(counts)
    c = counts[u, w]
    rules = pitmanyor.PitmanYor()
    tables = np.bincount(w, minlength=v)
    mean, last = pitmanyor.seat(tables, np.zeros(v, np.int64), 1, np.full(v, 1 / (v + 1)), np.zeros(1), rules.parent_discount, rules.parent_strength, rng, 5, 5)
    totals = pitmanyor._Totals(int(c.sum()), v, 0, 0.7, ((int(tables.sum()), mean.sum()),))
    parent = totals.parent(tables - rules.parent_discount * mean, rules)
    unknown = totals.parent(np.zeros(1), rules)[0]
    assert parent.sum() + unknown == pytest.approx(1)
    t, _ = pitmanyor.seat(c, u, contexts, parent[w], np.zeros(contexts), 0.7, 1.0, rng, 5, 5)
    assert (t >= np.minimum(c, 1)).all() and (t <= c).all()
    p = np.tile(parent, (contexts, 1)) * (1.0 + 0.7 * np.bincount(u, t, contexts))[:, None]
    p[u, w] += c - 0.7 * t
    p = np.column_stack([p, unknown * (1.0 + 0.7 * np.bincount(u, t, contexts))]) / (counts.sum(1) + 1.0)[:, None]
    assert p.sum(1) == pytest.approx(np.ones(contexts))


def test_seating_follows_the_restaurant():
    """Mean tables of one dish with base probability one match the sequential process."""
    rng = np.random.default_rng(4)
    n, d, theta = 30, 0.5, 1.0
    wanted = np.mean([_open_tables(rng, n, d, theta) for _ in range(3000)])
    c = np.full(400, n)
    mean, _ = pitmanyor.seat(c, np.arange(400), 400, np.ones(400), np.zeros(400), d, theta, rng, 300, 60)
    assert mean.mean() == pytest.approx(wanted, rel=0.05)


def _open_tables(rng, n, d, theta):
    t = 1
    for k in range(1, n):
        t += rng.random() < (theta + d * t) / (k + theta)
    return t


def _stirling(c, d):
    """Logarithms of the generalized Stirling numbers S(c, 1..c)."""
    found = np.full(c + 1, -np.inf)
    found[1] = 0
    for n in range(1, c):
        t = np.arange(1, n + 2)
        found[1 : n + 2] = np.logaddexp(found[: n + 1], np.log(np.maximum(n - d * t, 1e-300)) + found[1 : n + 2])
    return found[1:]


def test_large_dishes_at_production_steps():
    """Tables of dishes with thousands of customers, against Gibbs sampling of exact conditionals."""
    rng = np.random.default_rng(6)
    d, theta, rules = 0.7, 1.0, pitmanyor.PitmanYor()
    c = np.array([3000, 2500, 1800, 1200, 600, 90, 7] + [1] * 400)
    p = np.array([0.2, 0.02, 0.05, 0.001, 0.1, 1e-4, 0.01] + [1e-4] * 400)
    sums = [_stirling(int(n), d) for n in c[:7]]
    t = np.ones(len(c))
    kept = []
    for _ in range(150):
        for k in range(7):
            n = np.arange(1, c[k] + 1)
            rest = theta / d + t.sum() - t[k]
            w = sums[k] + n * math.log(p[k] * d) + np.concatenate([[0.0], np.cumsum(np.log(rest + n[1:] - 1))])
            t[k] = rng.choice(n, p=np.exp(w - w.max()) / np.exp(w - w.max()).sum())
        kept.append(t.copy())
    wanted = np.mean(kept[50:], 0)
    n = 40
    mean, last = pitmanyor.seat(np.tile(c, n), np.repeat(np.arange(n), len(c)), n, np.tile(p, n), np.zeros(n), d, theta, rng, rules.burn, rules.keep)
    found = mean.reshape(n, -1).mean(0)
    assert found[:7] == pytest.approx(wanted[:7], rel=0.04)
    assert (last >= 1).all() and (last <= np.tile(c, n)).all()


def test_hot_dish_is_not_capped():
    """One dish of 4,000 customers beside 10,000 other tables, against the exact conditional."""
    rules, d, p, other = pitmanyor.PitmanYor(), 0.7, 0.02, 10_000
    n = np.arange(1, 4001)
    w = _stirling(4000, d) + n * math.log(p * d) + np.concatenate([[0.0], np.cumsum(np.log(1 / d + other + n[1:] - 1))])
    wanted = (np.exp(w - w.max()) * n).sum() / np.exp(w - w.max()).sum()
    mean, last = pitmanyor.seat(np.full(50, 4000), np.arange(50), 50, np.full(50, p), np.full(50, other), d, 1.0, np.random.default_rng(7), rules.burn, rules.keep)
    assert wanted > 150 and mean.mean() == pytest.approx(wanted, rel=0.02) and last.mean() == pytest.approx(wanted, rel=0.05)


def plain_scores(train, texts, d, theta, d0, theta0, sweeps, rng):
    """A two-level restaurant franchise with every customer and table, reseated one by one; averaged probabilities."""
    split = lambda t: ["\0begin", *re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER)), "\0end"]
    pairs = [p for t in train for p in zip(split(t), split(t)[1:], strict=False)]
    vocabulary = len({w for _, w in pairs})
    seats, parent = {}, {}  # tables of each (context, word) and of each word, as lists of customers
    held, upper = collections.Counter(), [0, 0]  # context: customers, tables

    def up(w):
        own = parent.get(w, [])
        return (sum(own) - d0 * len(own) + (theta0 + d0 * upper[1]) / (vocabulary + 1)) / (upper[0] + theta0)

    def pick(own, fresh, less):
        x = rng.random() * (sum(own) - less * len(own) + fresh)
        for k, n in enumerate(own):
            x -= n - less
            if x < 0:
                return k
        return len(own)

    def sit(u, w):
        own = seats.setdefault((u, w), [])
        k = pick(own, (theta + d * held[u, "t"]) * up(w), d)
        if k < len(own):
            own[k] += 1
        else:
            above = parent.setdefault(w, [])
            j = pick(above, (theta0 + d0 * upper[1]) / (vocabulary + 1), d0)
            if j < len(above):
                above[j] += 1
            else:
                above.append(1)
                upper[1] += 1
            upper[0] += 1
            own.append(1)
            held[u, "t"] += 1
        held[u, "c"] += 1

    def rise(u, w):
        own = seats[u, w]
        k = rng.choice(len(own), p=np.array(own) / sum(own))
        own[k] -= 1
        held[u, "c"] -= 1
        if not own[k]:
            own.pop(k)
            held[u, "t"] -= 1
            above = parent[w]
            j = rng.choice(len(above), p=np.array(above) / sum(above))
            above[j] -= 1
            upper[0] -= 1
            if not above[j]:
                above.pop(j)
                upper[1] -= 1

    for u, w in pairs:
        sit(u, w)
    total = collections.Counter()
    wanted = {p for t in texts for p in zip(split(t), split(t)[1:], strict=False)}
    for sweep in range(sweeps):
        for u, w in pairs:
            rise(u, w)
            sit(u, w)
        if sweep >= sweeps // 5:
            for u, w in wanted:
                own = seats.get((u, w), [])
                total[u, w] += (sum(own) - d * len(own) + (theta + d * held[u, "t"]) * up(w)) / (held[u, "c"] + theta)
    n = sweeps - sweeps // 5
    return [sum(math.log10(total[p] / n) for p in zip(split(t), split(t)[1:], strict=False)) for t in texts]


def test_scores_match_a_plain_franchise(spark):
    rng = np.random.default_rng(6)
    found = [(i, " ".join(f"w{min(int(x), 14)}" for x in rng.geometric(0.25, 14))) for i in range(24)]
    rules = pitmanyor.PitmanYor(discount=0.6)
    out = {r.doc_id: r for r in pitmanyor.perplexity_scores(spark.createDataFrame(found, "doc_id long, text string"), rules).collect()}
    train = [t for i, t in found if not out[i].held_out]
    wanted = plain_scores(train, [t for _, t in found], 0.6, rules.strength, rules.parent_discount, rules.parent_strength, 250, rng)
    for (i, _), score in zip(found, wanted, strict=True):
        assert out[i].score / out[i].n_tokens == pytest.approx(score / out[i].n_tokens, abs=0.03)
