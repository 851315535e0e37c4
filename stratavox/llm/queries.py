"""The queries of this subpackage and the SQL that they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, importance, interactions, jaccard, linededup, pieces, pitmanyor, repetition, resampling, substrings, tokencounts, toxicity, warc
from .storage import scratch, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures, repeat coverage and verdict per document."""
    return repetition.repetition_report(table(spark, sf_dir, "documents")).drop("longest_repeat")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (source as host) without their source's boilerplate lines."""
    docs = table(spark, sf_dir, "documents")
    out = linededup.drop_boilerplate(docs, F.col("source"), dropped="n_dropped")
    return out.select("doc_id", "text", "n_dropped")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of all pages, written to archives and read back."""
    out = warc.archive_round_trip(spark, table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op3_line_dedup": op3_line_dedup,
    "op6_warc": op6_warc,
}

#: DuckDB has no byte classes for "[^ \t-\r]" over raw text other than this pattern.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _window_cover(k: int, name: str) -> str:
    """SQL: words in k-word windows that are found twice or more in their text."""
    return f"""{name} AS (
  SELECT doc_id, count(*) AS n FROM (
    SELECT DISTINCT doc_id, s + unnest(range({k})) AS p FROM (
      SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, g) AS c FROM (
        SELECT doc_id, s, array_to_string(w[s:s + {k - 1}], ' ') AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - {k - 2})) AS s FROM t WHERE len(w) >= {k})))
    WHERE c > 1) GROUP BY doc_id)"""


_R = repetition.RepetitionRules()
ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": f"""
WITH t AS (SELECT doc_id, text, {_WORDS} AS w FROM documents),
{_window_cover(8, "r8")}, {_window_cover(_R.min_repeat, "cov")}, {_window_cover(_R.max_longest + 1, "far")},
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM t)
  WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
m AS (
  SELECT t.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(lines.n, 0) AS n_dup_lines, coalesce(r8.n, 0) AS n_repeat_words, coalesce(cov.n, 0) AS n_covered_words, far.n AS far
  FROM t LEFT JOIN lines USING (doc_id) LEFT JOIN r8 USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN far USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * n_covered_words <= {_R.max_covered_percent} * n_words AND far IS NULL AS kept, n_covered_words
FROM b""",
    "op3_line_dedup": """
WITH p AS (SELECT doc_id, coalesce(source, '') AS host, string_split(text, chr(10)) AS ls FROM documents),
tot AS (SELECT host, count(*) AS n FROM p GROUP BY host),
c AS (SELECT host, l, count(*) AS k FROM (SELECT host, unnest(list_distinct(ls)) AS l FROM p) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY host, l),
b AS (SELECT host, list(l) AS bad FROM c JOIN tot USING (host) WHERE k >= 5 AND k > 0.1 * n GROUP BY host),
o AS (SELECT doc_id, ls, [x FOR x IN ls IF NOT list_contains(coalesce(bad, []), x)] AS kept FROM p LEFT JOIN b USING (host))
SELECT doc_id, array_to_string(kept, chr(10)) AS text, len(ls) - len(kept) AS n_dropped FROM o""",
    "op6_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS top FROM p)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(d, 1 + 5 * CAST(floor(i / 4) AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT), 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to
FROM r""",
}


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of ten words in all documents, by the stored index."""
    index = decontaminate.build_index(table(spark, sf_dir, "documents"), scratch(spark, "postings"))
    return decontaminate.contamination_report(index, table(spark, sf_dir, "benchmark"))


QUERIES["op8_decontaminate"] = op8_decontaminate
_ALNUM = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL["op8_decontaminate"] = f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
b AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, len(g) AS k, array_to_string(g, ' ') AS g FROM (
  SELECT item_id, w[s:s + 9] AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS s FROM b WHERE len(w) > 0))),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, s, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM (
  SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, ks WHERE len(w) >= k)),
m AS (SELECT doc_id, s, dw.k AS k, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k),
h AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, s + unnest(range(k)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items,
  sha256(coalesce(i.l, '')) AS items_sha256, h.n IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)"""


def benchmark_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where an item's four rarest terms meet within 30 words of a document, in any order."""
    index = decontaminate.build_index(table(spark, sf_dir, "documents"), scratch(spark, "postings"))
    return decontaminate.proximity_matches(index, table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "start", "stop").distinct()


QUERIES["benchmark_proximity"] = benchmark_proximity
ORACLE_SQL["benchmark_proximity"] = f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
dw AS (SELECT doc_id, unnest(w) AS t, unnest(range(len(w))) AS p FROM d),
f AS (SELECT t, count(*) AS n FROM dw GROUP BY t),
bt AS (SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest({_ALNUM}) AS t FROM benchmark)),
r AS (SELECT item_id, t FROM (
  SELECT item_id, t, row_number() OVER (PARTITION BY item_id ORDER BY n, t) AS k, count(*) OVER (PARTITION BY item_id) AS c FROM bt JOIN f USING (t)) WHERE k <= 4 AND c >= 4),
o AS (SELECT item_id, doc_id, t, p FROM r JOIN dw USING (t)),
full4 AS (SELECT item_id, doc_id FROM o GROUP BY ALL HAVING count(DISTINCT t) = 4),
o4 AS (SELECT o.* FROM o JOIN full4 USING (item_id, doc_id)),
nx AS (SELECT a.item_id, a.doc_id, a.p, b.t, min(b.p) AS q FROM o4 a JOIN o4 b ON a.item_id = b.item_id AND a.doc_id = b.doc_id AND b.p >= a.p AND b.p < a.p + 30 GROUP BY ALL)
SELECT doc_id, CAST(item_id AS VARCHAR) AS item_id, CAST(p AS INT) AS start, CAST(max(q) + 1 AS INT) AS stop FROM nx GROUP BY doc_id, item_id, p HAVING count(*) = 4"""


def op5_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight, and whether it is in the sampled share."""
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES["op5_importance_resampling"] = op5_importance_resampling


def op9_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document under merge-dropout, and whether they decode to its text."""
    return pieces.encode(table(spark, sf_dir, "documents"))


QUERIES["op9_merge_dropout"] = op9_merge_dropout


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by the classifier that weak supervision trains."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


QUERIES["op7_toxicity"] = op7_toxicity


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the words of 20-word windows that start earlier elsewhere."""
    out = substrings.remove_repeats(table(spark, sf_dir, "documents"), digest=True)
    return out.withColumnRenamed("kept", "kept_sha256")


QUERIES["op4_substring_dedup"] = op4_substring_dedup
ORACLE_SQL["op4_substring_dedup"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS k FROM g) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, s + unnest(range(20)) AS p FROM r),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""


def op10_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability under the hierarchical model and the unigram base."""
    return pitmanyor.perplexity_scores(table(spark, sf_dir, "documents"))


QUERIES["op10_pitman_yor"] = op10_pitman_yor


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked at 90 % of three-word shingles."""
    rules = jaccard.JaccardRules(words=3, similarity=90)
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), rules).select("doc_id", "n_shingles", "component_id")


QUERIES["op2_jaccard_join"] = op2_jaccard_join
ORACLE_SQL["op2_jaccard_join"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 90 * (a.n + b.n - k)),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.m AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS m FROM r GROUP BY x) c ON c.x = d.doc_id"""


def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removals of five filters in all their orders, by part."""
    return interactions.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES["op11_filter_interactions"] = op11_filter_interactions
ORACLE_SQL["op11_filter_interactions"] = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {_WORDS} AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
g AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, CAST(len(w) < 200 AS INT) AS a, CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT) AS b,
    CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS INT) AS c, CAST(regexp_matches(t, '[#$%&*|]') AS INT) AS d,
    CASE WHEN doc_id > first THEN 1 ELSE 0 END AS e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM d LEFT JOIN g USING (doc_id)),
p AS (SELECT part, concat(CASE WHEN a = 1 THEN 'A' ELSE '' END, CASE WHEN b = 1 THEN 'B' ELSE '' END, CASE WHEN c = 1 THEN 'C' ELSE '' END,
    CASE WHEN d = 1 THEN 'D' ELSE '' END, CASE WHEN e = 1 THEN 'E' ELSE '' END) AS fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT concat(v.x, w.x, x.x, y.x, z.x) AS filter_order FROM l v, l w, l x, l y, l z WHERE len(list_distinct([v.x, w.x, x.x, y.x, z.x])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS own, CASE WHEN step = 1 THEN '[^A-E]' ELSE concat('[', substr(filter_order, 1, step - 1), ']') END AS earlier FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND hit), 0) AS removed, coalesce(sum(n) FILTER (gone AND hit), 0) AS redundant,
    coalesce(sum(n) FILTER (fails = own), 0) AS unique_fails, coalesce(sum(good) FILTER (NOT gone AND hit), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND hit), 0) AS toxic_lost
  FROM (SELECT *, regexp_matches(fails, earlier) AS gone, contains(fails, own) AS hit FROM p, s) GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r"""


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by two tiers of lookup."""
    return tokencounts.token_counts(table(spark, sf_dir, "documents"))


QUERIES["op12_token_counts"] = op12_token_counts


def op13_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight toward the benchmark, its noisy score and the rank of those drawn."""
    out = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES["op13_target_resampling"] = op13_target_resampling
#: CRC-32 in SQL: a table of its 256 steps, applied to the bytes of each distinct feature.
ORACLE_SQL["op13_target_resampling"] = f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
b AS (SELECT {_ALNUM} AS w FROM benchmark),
df AS (SELECT doc_id, array_to_string(w[s:s + k - 1], ' ') AS f, count(*) AS n FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k) GROUP BY ALL),
bf AS (SELECT array_to_string(w[s:s + k - 1], ' ') AS f, count(*) AS n FROM (SELECT w, k, unnest(range(1, len(w) - k + 2)) AS s FROM b, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k) GROUP BY ALL),
tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, j: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM (SELECT unnest(range(256)) AS i))),
fs AS (SELECT DISTINCT f FROM (SELECT f FROM df UNION ALL SELECT f FROM bf)),
bk AS (SELECT f, xor(list_reduce(list_concat([4294967295], [CAST('0x' || substr(h, 2 * j + 1, 2) AS BIGINT) FOR j IN range(len(h) // 2)]),
    lambda c, x: xor(c // 256, t[1 + (xor(c, x) & 255)])), 4294967295) % 10000 AS k FROM (SELECT f, hex(f) AS h FROM fs), tab),
s AS (SELECT k, sum(n) AS s FROM df JOIN bk USING (f) GROUP BY k),
t AS (SELECT k, sum(n) AS t FROM bf JOIN bk USING (f) GROUP BY k),
tot AS (SELECT coalesce((SELECT sum(n) FROM df), 0) AS ss, coalesce((SELECT sum(n) FROM bf), 0) AS tt),
g AS (SELECT k, CAST(floor(1000 * ln(((coalesce(t, 0) + 1.0::DOUBLE) * (ss + 10000)) / ((s + 1.0::DOUBLE) * (tt + 10000)))) AS BIGINT) AS g FROM s LEFT JOIN t USING (k), tot),
wt AS (SELECT doc_id, sum(n) AS n, sum(n * g) AS w FROM df JOIN bk USING (f) JOIN g USING (k) GROUP BY doc_id),
sc AS (SELECT doc_id, len(d.w) AS words, coalesce(n, 0) AS n_features, coalesce(wt.w, 0) AS weight,
    coalesce(wt.w, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS score FROM d LEFT JOIN wt USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM sc WHERE words >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN r <= floor(5 * n / 100) THEN r END AS rank FROM sc LEFT JOIN r USING (doc_id)"""


