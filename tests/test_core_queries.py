"""Every core query against its SQL equivalent on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest

from corpusloom.plans import registry
from tests.support import DATA, spark_rows, sql_rows

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    assert spark_rows(registry.queries()[name](spark, DATA)) == sql_rows(registry.oracle_sql()[name], DATA)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs_without_sql(spark, name):
    assert registry.queries()[name](spark, DATA).count() >= 0


def test_entry_and_names():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert registry.FLAGSHIP in __spark_entry__.queries()


def test_hybrid_retrieval_searches_documents_without_vectors(spark):
    folder = "/root/testdata/sf0.01"
    sql = registry.oracle_sql()["hybrid_retrieval"]
    assert "doc_id in (select vec_id from embeddings)" not in sql
    assert spark_rows(registry.queries()["hybrid_retrieval"](spark, folder)) == sql_rows(sql, folder)


def test_metrics_by_type_reads_only_the_query_set(spark):
    found = registry.queries()["metrics_by_type"](spark, DATA)
    assert "reference_answer" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_reranked_retrieval_shuffles_only_texts_that_were_found(spark, monkeypatch):
    from corpusloom.plans import document_queries

    found = document_queries.reranked_retrieval(spark, DATA)
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()
    rows = spark_rows(found)
    monkeypatch.setattr(document_queries, "FEW", 0)
    assert spark_rows(document_queries.reranked_retrieval(spark, DATA)) == rows


def test_context_budget_takes_a_repeated_document_as_often_as_sql(spark, tmp_path):
    rows = [(i, f"alpha n{i % 7} " * (i % 5 + 1), f"alpha n{i % 7}") for i in range(1, 121)]
    documents = spark.createDataFrame([*rows, rows[49], rows[6]], "doc_id long, text string, title string")
    documents.toPandas().to_parquet(tmp_path / "documents.parquet")
    (tmp_path / "embeddings.parquet").symlink_to(f"{DATA}/embeddings.parquet")
    found = registry.queries()["context_budget"](spark, str(tmp_path))
    assert spark_rows(found) == sql_rows(registry.oracle_sql()["context_budget"], str(tmp_path))
    assert "LeftOuter" not in found._jdf.queryExecution().optimizedPlan().toString()
