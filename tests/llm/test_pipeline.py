"""The pipeline against plain versions of its stages, and the queries against their SQL."""

from __future__ import annotations

import collections
import glob
import os

import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

from stratavox.llm import queries
from tests.llm.test_text_operators import plain_components, plain_contamination, plain_repetition, tokens

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, oracle, name):
    df = queries.QUERIES[name](spark, SF)
    result = oracle.sql(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(result.columns)
    columns = sorted(df.columns)
    wanted = collections.Counter(tuple(dict(zip(result.columns, r, strict=True))[c] for c in columns) for r in result.fetchall())
    assert collections.Counter(tuple(r[c] for c in columns) for r in df.collect()) == wanted


def plain_stages(rows, items):
    rows = [r for r in rows if plain_repetition(r["text"])[6]]
    yield rows
    pages = collections.Counter(r["source"] for r in rows)
    seen = collections.Counter((r["source"], x) for r in rows for x in set((r["text"] or "").split("\n")) if tokens(x))
    bad = {k for k, n in seen.items() if n >= 5 and n > 0.1 * pages[k[0]]}
    rows = [r | {"text": "\n".join(x for x in r["text"].split("\n") if (r["source"], x) not in bad)} for r in rows]
    rows = [r | {"n_chars": len(r["text"])} for r in rows]
    yield rows
    keep = {i for i, n, c in plain_components([(r["doc_id"], r["text"]) for r in rows], 5, 80) if n == 0 or i == c}
    rows = [r for r in rows if r["doc_id"] in keep]
    yield rows
    dirty = {k[0] for k in plain_contamination([(r["doc_id"], r["text"]) for r in rows], items) if k[-1]}
    rows = [r for r in rows if r["doc_id"] not in dirty]
    yield rows


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    plain = plain_stages([r.asDict() for r in docs.collect()], items)
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        wanted = next(plain)
        assert docs.columns == columns
        assert collections.Counter(tuple(r) for r in docs.collect()) == collections.Counter(tuple(r[c] for c in columns) for r in wanted), name
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.count() == docs.count() and out.filter("NOT lossless").count() == 0


def test_run_and_odd_rows(spark, docs, nothing):
    assert corpus_pipeline.run(spark, SF).filter("NOT lossless").count() == 0
    for frame in (docs, nothing):
        for name, stage in corpus_pipeline.STAGES:
            one = stage(spark, frame, SF)
            assert one.count() <= frame.count(), name
    assert docs.filter(F.col("doc_id").isNull()).count() == 1
