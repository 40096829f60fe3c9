import pytest

from tessera.plans.catalog import ORACLE_SQL, QUERIES

from .compare import differences, duck_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, name):
    rows = [r.asDict() for r in QUERIES[name](spark, SF).collect()]
    assert differences(rows, duck_rows(ORACLE_SQL[name], SF)) is None


def test_all_queries_have_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
