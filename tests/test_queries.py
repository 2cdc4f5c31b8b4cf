import os

import pytest

from seriesframe import queries, special_queries, store_queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", [*queries.ORACLE_SQL, *store_queries.ORACLE_SQL, *special_queries.ORACLE_SQL])
def test_query_matches_sql(spark, compare, tmp_path, name):
    query = (queries.QUERIES | store_queries.QUERIES | special_queries.QUERIES)[name]
    compare(spark, query, (queries.ORACLE_SQL | store_queries.ORACLE_SQL | special_queries.ORACLE_SQL)[name], SF, tmp_path)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
