"""The closing and its SQL: ties and tiles change no row."""
import duckdb
import pytest
from conftest import DATA, norm

import __spark_entry__ as entry
from atrium import session
from atrium.catalog import tables
from atrium.operators import spatial

SQL = entry.oracle_sql()["buffer_closing"]


def test_sql_leaves_no_tie_to_chance(spark):
    """Rooms 0, 3 and 6 lie above each other between the same x, so their intervals in a slab are equal."""
    con = duckdb.connect()
    con.execute("CREATE TABLE lineitem AS SELECT 1::BIGINT AS l_orderkey, 16::BIGINT AS l_partkey, 0::BIGINT AS l_suppkey, i::INTEGER AS l_linenumber, "
                "10.0::DOUBLE AS l_quantity, 0.0::DOUBLE AS l_extendedprice, TIMESTAMP '2020-01-01' AS l_shipdate FROM range(9) r(i)")
    other = SQL
    for u in ("x0, x1", "y0, y1"):
        other = other.replace(f"ORDER BY {u} ROWS UNBOUNDED", f"ORDER BY {u}, prev DESC ROWS UNBOUNDED")
    assert other != SQL
    assert sorted(con.execute(SQL).fetchall()) == sorted(con.execute(other).fetchall())


@pytest.mark.parametrize("tile", [300, 500, 1000])
def test_tiles_cut_no_box(spark, duck, monkeypatch, tile):
    monkeypatch.setattr(session, "GROUP_LIMIT", 3)
    monkeypatch.setattr(spatial, "TILE", tile)
    monkeypatch.setattr(tables, "_LARGE", {})
    assert tables.Tables(spark, DATA).large.count() > 20
    df = entry.queries()["buffer_closing"](spark, DATA)
    cur = duck.execute(SQL)
    assert norm(df.columns, [tuple(r) for r in df.collect()]) == norm([d[0] for d in cur.description], cur.fetchall())
