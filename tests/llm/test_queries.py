"""Registered queries: against SQL where there is one, and the pipeline stage by stage against plain versions."""

import duckdb
import pytest

import check
import corpus_pipeline
from shelfwise.llm import ngram_join, quality_rules, queries, sql

from . import brute
from .test_packing import check as check_pieces


@pytest.fixture(scope="module")
def engine(sf):
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(sql.ORACLES) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_query_equals_sql(spark, sf, engine, name):
    df = queries.QUERIES[name](spark, sf)
    cursor = engine.execute(sql.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert check.rows_of(df.columns, df.collect()) == check.rows_of(columns, cursor.fetchall())


def test_suffix_query_equals_plain_removal(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in queries.op6_suffix_dedup(spark, sf).collect())
    assert got == sorted(brute.remove_repeats(rows))


def test_packing_query_holds_all_ids(spark, sf):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check_pieces(rows, queries.op4_harmonic_packing(spark, sf).collect())


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    good = corpus_pipeline.quality_stage(spark, docs, sf)
    judged = {r.doc_id for r in quality_rules.judge(docs).where("kept").collect()}
    assert {r.doc_id for r in good.collect()} == judged and good.columns == columns
    lines = corpus_pipeline.line_stage(spark, good, sf)
    after = {r.doc_id: r for r in lines.collect()}
    assert set(after) == judged and lines.columns == columns
    assert all(set(after[d].text.split("\n")) <= set(before[d].text.split("\n")) for d in after if after[d].text)
    held = [x for r in after.values() for x in (r.text or "").split("\n") if x.strip()]
    assert len(held) == len(set(held))
    single = corpus_pipeline.near_stage(spark, lines, sf)
    root = {d: c for d, _, c in brute.join_components([(d, r.text) for d, r in after.items()], 5, 80, 100)}
    assert sorted(r.doc_id for r in single.collect()) == sorted(d for d in after if root[d] == d)
    mixed = corpus_pipeline.mix_stage(spark, single, sf)
    assert mixed.columns == columns and mixed.count() > 0


def test_pipeline_runs_as_a_whole(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert "sequence_id" in out.columns and out.count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES][-1] == "packing" and callable(ngram_join.keep_one)
