"""Plans at scale: what is broadcast, shuffled and kept does not grow with guesses, and results hold for large ids."""
import duckdb
import pytest
from conftest import DATA, NAMES, norm
from pyspark.sql import functions as F

import __spark_entry__ as entry
from atrium.catalog import spatial_queries
from atrium.catalog.tables import Tables
from atrium.operators import overlay as V
from atrium.plans import outlines, shape


def plan_text(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_sweep_broadcasts_no_edges(spark):
    t = Tables(spark, DATA)
    text = plan_text(V.cells(V.ring_edges(t.rings, ["plan_id"]), ["plan_id"]))
    assert "BroadcastExchange" not in text and "BroadcastHashJoin" not in text


@pytest.fixture(scope="module")
def shifted(spark, tmp_path_factory):
    """The smallest tables with plan ids of seven digits."""
    path = str(tmp_path_factory.mktemp("shifted"))
    for name, key in (("lineitem", "l_orderkey"), ("orders", "o_orderkey")):
        spark.read.parquet(f"{DATA}/{name}.parquet").withColumn(key, F.col(key) + 1_000_000).write.parquet(f"{path}/{name}.parquet")
    return path


def test_long_ids_stay_whole(spark, shifted):
    con = duckdb.connect()
    for n in NAMES:
        at = f"{shifted}/{n}.parquet/*.parquet" if n in ("lineitem", "orders") else f"{DATA}/{n}.parquet"
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{at}'")
    df = entry.queries()["read_stage_csv"](spark, shifted)
    cur = con.execute(entry.oracle_sql()["read_stage_csv"])
    rows = [tuple(r) for r in df.collect()]
    assert len({r[0] for r in rows}) == Tables(spark, shifted).adj.select("plan_id").distinct().count()
    assert norm(df.columns, rows) == norm([d[0] for d in cur.description], cur.fetchall())


@pytest.mark.parametrize("key", ["conv_node_masks", "rasterize_rooms", "fill_wall_gaps", "layout_features"])
def test_rows_of_images_are_not_shuffled(spark, key):
    t = Tables(spark, DATA)
    t.rooms  # built before
    assert "Exchange" not in plan_text(entry.queries()[key](spark, DATA))


IN_BUCKETS = ["split_segments_rings", "shared_walls_rings", "ring_shrink", "wall_adjacency_rings", "door_edges_rings", "hole_ratio", "outline_shape",
              "plan_components", "boundary_cover"]


@pytest.mark.parametrize("key", IN_BUCKETS)
def test_steps_within_plans_stay_in_their_buckets(spark, monkeypatch, key):
    def shuffles(*a, **k):
        raise AssertionError("rows leave their buckets")

    t = Tables(spark, DATA)
    t.rooms, t.door_edges  # built before
    for module in (V, outlines, shape, spatial_queries):
        for name in ("in_buckets", "checkpointed"):
            monkeypatch.setattr(module, name, shuffles, raising=False)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in plan_text(entry.queries()[key](spark, DATA))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


@pytest.mark.parametrize("key", ["check_norms", "edge_list_export"])
def test_rule_tables_shuffle_no_facts(spark, key):
    t = Tables(spark, DATA)
    t.rooms, t.door_edges, t.dealt_plans  # built before
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange hashpartitioning" not in plan_text(entry.queries()[key](spark, DATA))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
