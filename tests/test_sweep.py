"""The sweep in kernels: rings alone as in groups, long groups in pieces, and no rows of edges moved or written."""
import numpy as np
from conftest import DATA
from pyspark.sql import functions as F

import __spark_entry__ as entry
from atrium.catalog.tables import Tables
from atrium.functions import sweep as K
from atrium.operators import overlay as O


def test_rings_alone_and_in_groups(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rings = [[(0, 0), (90, 0), (90, 50), (40, 50), (40, 80), (0, 80)], [(0, 0), (0, 70), (70, 70)], [(3, 3), (9, 3)], [(0, 0), (20, 0), (20, 20), (0, 20)]]
    rings += [[(x + a * w, y + b * h) for a, b in ((0, 0), (1, 0.1), (0.9, 1), (0.2, 0.8))] for x, y, w, h in rng.uniform(30, 1500, (40, 4))]
    df = spark.createDataFrame([(i, [(float(x), float(y)) for x, y in r]) for i, r in enumerate(rings)], "plan_id long, ring array<struct<x double, y double>>")
    want = {r.plan_id: r.a for r in O.shrunk_cells(df, ["plan_id"], 12.0).groupBy("plan_id").agg(F.sum("area").alias("a")).collect()}
    for edges, pairs in ((K.EDGES, K.PAIRS), (7, 5)):
        monkeypatch.setattr(K, "EDGES", edges)
        monkeypatch.setattr(K, "PAIRS", pairs)
        got = {r.plan_id: r.a for r in df.select("plan_id", O.shrunk_area(F.col("ring"), 12.0).alias("a")).collect()}
        assert len(got) == len(rings) and all(abs(a - want.get(i, 0.0)) < 1e-6 for i, a in got.items())
    assert abs(got[3] - 0.0) < 1e-9 and abs(got[0] - (66 * 26 + 16 * 30)) < 1e-6


def test_edges_are_neither_joined_nor_written(spark, monkeypatch):
    Tables(spark, DATA).rooms  # built before
    for key in ("ring_shrink", "type_iou_rings"):
        text = entry.queries()[key](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in text and "Window" not in text
    assert "Join" not in entry.queries()["ring_shrink"](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_closing_stays_in_its_buckets(spark, monkeypatch):
    from atrium.plans import outlines

    t = Tables(spark, DATA)
    t.rooms  # built before
    whole = {}

    def shuffles(*a, **k):
        raise AssertionError("rows leave their buckets")

    monkeypatch.setattr(O, "checkpointed", shuffles)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for key in ("closing_rings", "boundary_cover_rings"):
            df = entry.queries()[key](spark, DATA)
            whole[key] = sorted(map(tuple, df.collect()))
            assert whole[key]
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    # the path without buckets gives the same
    monkeypatch.undo()
    facts = outlines.closed_facts(t.rings.filter("plan_id < 400"), 30.0)
    got = {r.plan_id: (round(r.closed_cm2, 3), round(r.hole_cm2, 3), r.n_components) for r in facts.collect()}
    assert got == {r[0]: (r[1], r[2], r[4]) for r in whole["closing_rings"] if r[0] < 400}


def test_links_join_all_parts():
    rng = np.random.default_rng(2)
    for n, m in ((1, 0), (30, 20), (200, 150), (50, 400)):
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        want = np.arange(n)
        while True:
            low = want.copy()
            np.minimum.at(low, a, want[b])
            np.minimum.at(low, b, low[a])
            if (low == want).all():
                break
            want = low
        assert (K.linked(n, a, b) == want).all()
