"""Rings chained for a whole batch at once: the same as one group at a time, and without moving the edges of plans in buckets."""
import numpy as np
import pytest
from conftest import DATA

import __spark_entry__ as entry
from atrium.catalog import conversions
from atrium.catalog.tables import Tables
from atrium.functions import kernels as K


def loop(*points):
    return [(*p, *q) for p, q in zip(points, [*points[1:], points[0]])]


SQUARE = loop((0, 0), (4, 0), (4, 4), (2, 4), (0, 4))
GROUPS = [SQUARE, SQUARE + loop((9, 9), (9, 12), (12, 9)), [], SQUARE + loop((4, 4), (8, 4), (8, 8)), SQUARE[:3], [(1, 1, 1, 1)],
          SQUARE + loop((5, 5), (6, 5)), [(0, 0, 4, 0), (4, 0, 4, 4), (8, 8, 4, 4), (4, 4, 0, 0)], loop((-0.0, 0), (4, 0), (4, 4), (0.0, 4))]


def random_groups(n, seed=1):
    rng = np.random.default_rng(seed)
    return [[tuple(map(float, rng.integers(0, 3, 4))) for _ in range(rng.integers(0, 9))] for _ in range(n)]


@pytest.mark.parametrize("groups", [GROUPS, random_groups(500), GROUPS * 3 + random_groups(20, 2), []])
def test_batch_gives_the_rings_of_single_groups(groups):
    groups = [np.array(sorted(g), float).reshape(-1, 4) for g in groups]
    group = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    g, first, corner = K._chain_all(group, np.concatenate([*groups, np.zeros((0, 4))]))
    for k, segs in enumerate(groups):
        mine = g == k
        rings = [corner[mine & (first == f)].tolist() for f in dict.fromkeys(first[mine].tolist())]
        assert rings == [r.tolist() for r in K._chain(segs)]


def test_udf_keeps_groups_without_rings_out(spark):
    rows = [(k, *map(float, s)) for k, g in enumerate(GROUPS) for s in g]
    d = K.chain_rings(spark.createDataFrame(rows, "id int, x0 double, y0 double, x1 double, y1 double"), ["id"])
    got = [(r.id, r.part, [[p.x, p.y] for p in r.ring]) for r in d.orderBy("id", "part").collect()]
    want = [(k, i, r.tolist()) for k, g in enumerate(GROUPS) for i, r in enumerate(K._chain(np.array(sorted(g), float).reshape(-1, 4)))]
    assert got == want


def test_edges_of_rooms_stay_in_their_buckets(spark, monkeypatch):
    t = Tables(spark, DATA)
    t.rooms  # built before
    monkeypatch.setattr(conversions, "spread", lambda d: d)  # not below the number of cores

    def cut(d):
        raise AssertionError("written between")

    monkeypatch.setattr(conversions, "checkpointed", cut)
    d = entry.queries()["conv_lifull"](spark, DATA)
    d.write.format("noop").mode("overwrite").save()
    assert "Exchange" not in d._jdf.queryExecution().executedPlan().toString()
