"""The distributed paths for oversized groups give the rows of the ordinary paths: the limit is lowered so that they run."""
import pytest
from conftest import DATA, norm

import __spark_entry__ as entry
from atrium import session
from atrium.catalog import tables
from atrium.operators import spatial

KEYS = ["room_index", "wall_adjacency", "door_edges", "union_area", "type_union", "components", "hole_ratio", "plan_components",
        "outline_shape", "boundary_cover", "difference", "bfs_order", "paint_order", "room_numbering", "reachability", "spatial_probe",
        "box_relation", "conv_rename_rooms", "run_components", "storey_rank", "window_touch"]


@pytest.fixture()
def small_limit(monkeypatch):
    monkeypatch.setattr(session, "GROUP_LIMIT", 6)
    monkeypatch.setattr(spatial, "TILE", 500)
    monkeypatch.setattr(tables, "_LARGE", {})


@pytest.mark.parametrize("key", KEYS)
def test_large_path(spark, duck, small_limit, key):
    t = tables.Tables(spark, DATA)
    assert t.large is not None and t.large.count() > 20
    df = entry.queries()[key](spark, DATA)
    cur = duck.execute(entry.oracle_sql()[key])
    assert norm(df.columns, [tuple(r) for r in df.collect()]) == norm([d[0] for d in cur.description], cur.fetchall())
