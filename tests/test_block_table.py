"""The block table has all its columns: reach of whole plans, graphs of the input, distances minus those of the inputs' real plans."""
import hashlib

import numpy as np
from conftest import DATA

import __spark_entry__ as entry
from atrium.catalog.tables import Tables
from atrium.plans import distribution as D
from atrium.plans.metrics import type_multiset


def test_shares_are_those_of_whole_plans(spark):
    Q, t = entry.queries(), Tables(spark, DATA)
    variant = {r.plan_id: r.variant for r in t.plans.collect()}
    reached = {r.plan_id for r in Q["reachability"](spark, DATA).collect() if r.all_reachable}
    equal = {r.plan_id for r in Q["graph_equal"](spark, DATA).collect() if r.equal}
    types = {r.plan_id: r.type_multiset_match for r in type_multiset(t.gen_rooms, t.rooms).collect()}
    for row in Q["block_table"](spark, DATA).collect():
        plans = [p for p, v in variant.items() if v == row.variant]
        known = [p for p in plans if p in types]
        assert row.reach == round(len(reached.intersection(plans)) / len(plans), 6)
        assert row.graph == round(sum(types[p] and p in equal for p in known) / len(known), 6)
        assert row.delta_fid is not None and row.delta_kid is not None


def test_kernel_distance_of_sets(spark):
    rng = np.random.default_rng(3)
    rows = {k: [(i, rng.normal(k == "y", 1, 3).tolist()) for i in range(n)] for k, n in (("x", 7), ("y", 40), ("ref", 30))}
    sets = spark.createDataFrame([(k, *r) for k in "xy" for r in rows[k]], "k string, vec_id long, vec array<double>")
    got = {r.k: r.kid for r in D.kid_of_sets(sets, spark.createDataFrame(rows["ref"], "vec_id long, vec array<double>"), ["k"], 4, 12).collect()}

    def placed(k):
        return np.array([v for i, v in sorted(rows[k], key=lambda r: hashlib.md5(f"{r[0]}:0".encode()).hexdigest())])

    ref = placed("ref")
    for k in "xy":
        own, each = placed(k), []
        m = min(12, len(own), len(ref))
        for s in range(4):
            a, b = (v[(s * m + np.arange(m)) % len(v)] for v in (own, ref))
            f = lambda p, q: (p @ q.T / 3 + 1) ** 3
            off = ~np.eye(m, dtype=bool)
            each.append(f(a, a)[off].mean() + f(b, b)[off].mean() - 2 * f(a, b).mean())
        assert abs(got[k] - np.mean(each)) < 1e-9
