import pytest

from compare import same
from tributary.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_duckdb(spark, name):
    same(spark, queries.QUERIES[name], queries.ORACLES[name], SF)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["o_orderkey", "o_custkey", "o_orderstatus", "_row_id", "_op_type"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
