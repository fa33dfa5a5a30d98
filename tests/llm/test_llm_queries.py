"""Training-data queries against SQL on the smallest tables, and the shape of those that SQL cannot express."""

from __future__ import annotations

from pathlib import Path

import pytest

from corpusloom.llm import queries, sql
from tests.support import DATA, spark_rows, sql_rows

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")

COLUMNS = {
    "p1_found": ["case_id", "group_no", "term_no"], "p2_found": ["element_id", "noise"], "p3_found": ["document_id", "component_id"], "p4_found": ["case_id", "defect"],
    "p5_found": ["case_id_a", "case_id_b"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id", "content_class"],
}


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    assert spark_rows(queries.queries()[name](spark, DATA)) == sql_rows(sql.oracle_sql()[name], DATA)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(sql.oracle_sql())))
def test_runs_without_sql(spark, name):
    df = queries.queries()[name](spark, DATA)
    assert df.columns == COLUMNS.get(name, df.columns)
    assert df.count() == df.distinct().count()
