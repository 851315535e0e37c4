"""Audit of five filters over all their orders, by inclusion and exclusion.

A text fails A with few words, B with few distinct words, C with many capitals, D when it
holds a symbol, E when a smaller doc_id has the same text.  J[S], the documents of a part
that fail every filter of S, is an aggregate of flag products for each of the 32 sets S
(over all documents, the good ones and the toxic ones).  Möbius inversion of J gives the rest:

* survivors of the filters in P: the sum over T within P of (-1)^|T| J[T];
* failing f only: the sum over T with f of (-1)^(|T| - 1) J[T];
* the Harsanyi dividend of T in the game "documents removed by a set" is (-1)^(|T| + 1) J[T],
  so f's removals, summed over all 120 orders, are the sum over T with f of 120 / |T| dividends.

Texts are read once: a table of flags and digests goes to the shared folder.  Copies are
found by digests (SHA-256) with map-side combine, and marked by a join on digest and
doc_id, so a text that a third of all rows share is no hot key.  What is inverted is one
row a part.

Edge cases: a null text counts as empty; a null source and an empty one are the part "";
a null doc_id is no copy of others and makes none, and takes no labels; rows that repeat a doc_id are a
document each (one fails E where a smaller doc_id has its text); a document is good or
toxic if any of its label rows says so, null labels say nothing; other columns are ignored,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
SETS = range(1 << len(FILTERS))
MEASURES = ("n", "good", "toxic")


@dataclass(frozen=True)
class AuditRules:
    """min_words: A; min_distinct_percent: of words, B; max_capital_percent: of code points, C; symbols: D, a regular expression."""

    min_words: int = 200
    min_distinct_percent: int = 50
    max_capital_percent: int = 2
    symbols: str = r"[#$%&*|]"


def text_flags(text: Column, rules: AuditRules = AuditRules()) -> dict[str, Column]:
    """Failure of A to D, as 0 or 1; text must not be null."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    failed = {
        "A": n < rules.min_words,
        "B": 100 * distinct.cast("long") < rules.min_distinct_percent * n.cast("long"),
        "C": 100 * capitals.cast("long") > rules.max_capital_percent * F.length(text).cast("long"),
        "D": text.rlike(rules.symbols),
    }
    return {k: c.cast("int") for k, c in failed.items()}


def failure_flags(docs: DataFrame, labels: DataFrame, rules: AuditRules = AuditRules()) -> DataFrame:
    """(doc_id, part, A .. E, good, toxic): one row a document, flags as 0 or 1."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"), *[c.alias(k) for k, c in text_flags(text, rules).items()],
    )
    own = stored(own, "filter-flags")
    first = own.filter("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(1))
    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    named = own.join(first, ["digest", "doc_id"], "left").join(marks, "doc_id", "left")
    copy = F.when(F.col("doc_id").isNull() | F.col("first").isNotNull(), 0).otherwise(1)
    return named.select("doc_id", "part", *"ABCD", copy.alias("E"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def joint_failures(flags: DataFrame) -> DataFrame:
    """(part, n, good, toxic): arrays of 32 counts, at S (bit i: the i-th filter) those of the documents that fail all of S."""
    seen = flags.groupBy("part", *FILTERS).agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))

    def product(s: int) -> Column:
        out = F.lit(1)
        for i, k in enumerate(FILTERS):
            if s >> i & 1:
                out = out * F.col(k)
        return out

    # up to 32 rows a part are left: each set's product of flags over them
    terms = F.array(*[F.struct(F.lit(s).alias("s"), product(s).alias("p")) for s in SETS])
    sums = seen.withColumn("term", F.explode(terms)).groupBy("part", F.col("term.s").alias("s")).agg(*[F.sum(F.col("term.p") * F.col(m)).alias(m) for m in MEASURES])
    ordered = sums.groupBy("part").agg(*[F.sort_array(F.collect_list(F.struct("s", m))).alias(m) for m in MEASURES])
    return ordered.select("part", *[F.col(m)[m].alias(m) for m in MEASURES])


def _size(s: int) -> int:
    return bin(s).count("1")


def _weighted(counts: Column, weights: list[int]) -> Column:
    """The sum of counts[T] * weights[T] over all sets T."""
    used = [F.element_at(counts, t + 1) * w for t, w in enumerate(weights) if w]
    return sum(used[1:], used[0])


def _by_set(counts: Column, weight) -> Column:
    """Array over sets S of the sum over T of weight(S, T) * counts[T]."""
    return F.array(*[_weighted(counts, [weight(s, t) for t in SETS]) for s in SETS])


def inverted(joint: DataFrame) -> DataFrame:
    """joint_failures() with kept, kept_good, kept_toxic (by set P: survivors of its filters), unique and shapley (by filter)."""
    survive = lambda p, t: 0 if t & ~p else (-1) ** _size(t)
    alone = lambda f: [(-1) ** (_size(t) - 1) if t >> f & 1 else 0 for t in SETS]
    dividends = lambda f: [120 // _size(t) * (-1) ** (_size(t) + 1) if t >> f & 1 else 0 for t in SETS]
    n, filters = F.col("n"), range(len(FILTERS))
    return joint.select(
        "part", "n", *[_by_set(F.col(m), survive).alias(f"kept_{m}") for m in MEASURES],
        F.array(*[_weighted(n, alone(f)) for f in filters]).alias("unique"), F.array(*[_weighted(n, dividends(f)) for f in filters]).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, rules: AuditRules = AuditRules()) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): a row
    for each part, each of the 120 orders and each of its steps, as counts of documents of the part."""
    every = F.explode(F.array(*map(F.lit, ORDERS)))
    rows = inverted(joint_failures(failure_flags(docs, labels, rules))).select("*", every.alias("filter_order"))
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    place = lambda k: F.instr(F.col("filter_order"), k)
    upto = lambda step: sum(F.when(place(k) <= step, 1 << i).otherwise(0) for i, k in enumerate(FILTERS))
    own = F.instr(F.lit(FILTERS), F.substring("filter_order", F.col("step"), F.lit(1)))
    rows = rows.withColumns({"after": upto(F.col("step")), "before": upto(F.col("step") - 1), "own": own})
    at = lambda c, s: F.element_at(c, s + 1)
    lost = lambda m: at(F.col(f"kept_{m}"), F.col("before")) - at(F.col(f"kept_{m}"), F.col("after"))
    fails = at(F.col("n"), F.expr("shiftleft(1, own - 1)"))
    return rows.select(
        "part", "filter_order", "step", at(F.col("kept_n"), F.col("after")).alias("kept"), lost("n").alias("removed"), (fails - lost("n")).alias("redundant"),
        F.element_at("unique", F.col("own")).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.element_at("shapley", F.col("own")).alias("shapley"),
    )
