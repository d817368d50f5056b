"""Every query and pipeline stage on nulls, ties, long and empty texts, clashing columns, and no rows."""

import pytest
from oracle import differences, duck

import corpus_pipeline
from inkprint.llm.common import table
from inkprint.llm.registry import oracle_sql, queries

PER_DOCUMENT = [q for q in queries() if not q.startswith(("op2_", "op7_", "op12_", "op13_"))]


@pytest.mark.parametrize("name", list(queries()))
def test_empty_tables_give_no_rows(spark, empty, name):
    assert queries()[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_a_row_per_document(spark, edge, name):
    rows = queries()[name](spark, edge).collect()
    ids = sorted(str(r["doc_id"]) for r in rows)
    assert ids == sorted(str(r["doc_id"]) for r in table(spark, edge, "documents").collect())


@pytest.mark.parametrize("name", [q for q in queries() if q not in PER_DOCUMENT])
def test_other_queries_run(spark, edge, name):
    assert queries()[name](spark, edge).collect()


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, small, duck_con, name):
    assert differences(queries()[name](spark, small), duck_con, oracle_sql()[name]) is None


def test_stages_keep_columns_and_whole_rows(spark, edge):
    docs = table(spark, edge, "documents")
    before = {tuple(r) for r in docs.drop("text", "n_chars").collect()}
    for _, work in corpus_pipeline.STAGES[:-1]:
        out = work(spark, table(spark, edge, "documents"), edge)
        assert out.columns == docs.columns
        assert {tuple(r) for r in out.drop("text", "n_chars").collect()} <= before


def test_stages_on_no_rows(spark, empty):
    for _, work in corpus_pipeline.STAGES:
        assert work(spark, table(spark, empty, "documents"), empty).collect() == []


def test_pipeline_takes_effect(spark, small):
    docs = {r["doc_id"] for r in table(spark, small, "documents").select("doc_id").collect()}
    out = corpus_pipeline.run(spark, small).orderBy("doc_id").collect()
    kept = [r["doc_id"] for r in out]
    assert set(kept) < docs and len(kept) == len(set(kept))
    assert [r["start"] for r in out] == [sum(x["n_tokens"] for x in out[:i]) for i in range(len(out))]
