import oracle
import pytest

from probelake.llm.queries import QUERIES, SQL

COLUMNS = {
    "p2_found": ["target_set", "level_name"], "p3_found": ["group_id", "row_id"], "p4_found": ["row_id_a", "row_id_b"], "p5_found": ["vec_id_a", "vec_id_b"],
    "p6_ids": ["doc_id", "ids"], "p7_found": ["source"], "p8_found": ["doc_id", "band"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, sf, name):
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    assert df.columns == COLUMNS[name] and rows
    assert name == "p6_ids" or len(set(rows)) == len(rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, name):
    assert oracle.difference(QUERIES[name](spark, sf), oracle.connect(sf), SQL[name]) == ""
