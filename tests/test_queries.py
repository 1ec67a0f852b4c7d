import pytest
from oracle import same

from tidemark import queries as engine

QUERIES, SQL = engine.queries(), engine.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, name):
    same(spark, sf, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    rows = {r["dimension"]: r["score"] for r in __spark_entry__.entry(spark).collect()}
    assert len(rows) == 5 and all(0 <= v <= 100 for v in rows.values())
