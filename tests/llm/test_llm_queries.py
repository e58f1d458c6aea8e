"""The training-data queries: against SQL where there is some, else by what must hold of their results."""

import pytest

from spindrift.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, small, duck, same):
    same(QUERIES[name](spark, small), duck.execute(SQL[name]))


COLUMNS = {
    "p2_found": ["id", "line_no"], "p3_found": ["id"], "p4_found": ["id"], "p6_found": ["id_a", "id_b"], "p7_found": ["id", "word"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id", "level"],
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows(name, spark, small):
    df = QUERIES[name](spark, small)
    assert df.columns == COLUMNS.get(name, df.columns)
    rows = df.collect()
    assert rows and len({str(r) for r in rows}) == len(rows)
