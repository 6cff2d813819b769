import pytest

from tessera.plans.catalog import ORACLE_SQL, QUERIES
from tests.oracle import duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLE_SQL:
        assert spark_rows(df) == duck_rows(ORACLE_SQL[name], sf_dir)
    else:
        first = sorted(map(tuple, df.collect()))
        assert first == sorted(map(tuple, QUERIES[name](spark, sf_dir).collect()))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
