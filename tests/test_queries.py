"""Every registered query against its SQL on the smallest tables; queries without SQL must at least give rows."""
import pytest
from conftest import DATA, norm

import __spark_entry__ as entry

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, duck, key):
    df = QUERIES[key](spark, DATA)
    rows = [tuple(r) for r in df.collect()]
    if key not in ORACLE:
        assert rows
        return
    cur = duck.execute(ORACLE[key])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert norm(df.columns, rows) == norm(names, cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 3
