"""Hand-sized cases and brute force for operators without SQL."""
import itertools
import math
import random

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from atrium.catalog.tables import Tables
from atrium.functions import geometry as G
from atrium.functions import kernels as K
from atrium.functions.labels import feet_inches, norm_label, strict_json
from atrium.operators import graph, isomorphism, joins, nearest, ranking, spatial
from atrium.plans import distribution, runs, shape
from atrium.sources import samples


def boxes(spark, rows):
    return spark.createDataFrame([(1, i, *b) for i, b in enumerate(rows)], "plan_id long, idx long, x0 long, y0 long, x1 long, y1 long")


RING = [(0, 0, 900, 200), (0, 700, 900, 900), (0, 0, 200, 900), (700, 0, 900, 900)]


def test_union_and_holes(spark):
    r = boxes(spark, RING)
    assert spatial.union_area(r, ["plan_id"]).first().union_area == 900 * 900 - 500 * 500
    h = shape.hole_ratio(spatial.closing(r, ["plan_id"], 30)).first()
    assert (h.closed_cm2, h.hole_cm2) == (900 * 900 - 500 * 500, 500 * 500)
    o = shape.outline_shape(spatial.closing(r, ["plan_id"], 30)).first()
    assert o.outline_rectangularity == 1.0 and o.outline_corners == 4


def test_closing_brute_force(spark):
    """Closing on a pixel grid: dilate and erode a boolean image by the same square."""
    rnd = random.Random(3)
    for _ in range(3):
        rows = []
        for _ in range(6):
            x, y = rnd.randrange(0, 40), rnd.randrange(0, 40)
            rows.append((x, y, x + rnd.randrange(3, 15), y + rnd.randrange(3, 15)))
        img = np.zeros((90, 90), bool)
        for x0, y0, x1, y1 in rows:
            img[y0 + 15:y1 + 15, x0 + 15:x1 + 15] = True
        r = 3
        sh = [(a, b) for a in range(-r, r + 1) for b in range(-r, r + 1)]
        dil = np.any([np.roll(img, s, (0, 1)) for s in sh], axis=0)
        ero = np.all([np.roll(dil, s, (0, 1)) for s in sh], axis=0)
        got = np.zeros_like(img)
        for b in spatial.closing(boxes(spark, rows), ["plan_id"], r).collect():
            got[b.y0 + 15:b.y1 + 15, b.x0 + 15:b.x1 + 15] = True
        assert (got == ero).all()


def test_pieces(spark):
    c = spatial.closing(boxes(spark, [(0, 0, 300, 300), (340, 0, 600, 300), (900, 0, 1200, 300)]), ["plan_id"], 30)
    assert shape.plan_pieces(c).first().n_components == 2


def test_kernels():
    sq = np.array([[0, 0], [4, 0], [4, 3], [0, 3]], float)
    bow = np.array([[0, 0], [4, 4], [4, 0], [0, 4]], float)
    ell = np.array([[0, 0], [6, 0], [6, 2], [2, 2], [2, 6], [0, 6]], float)
    assert K._min_rect(sq) == (3.0, 4.0) and K._is_simple(sq) and K._is_simple(ell) and not K._is_simple(bow)
    assert K._even_odd_area(bow) == pytest.approx(8.0)
    assert K._clear_width(sq) == pytest.approx(3.0, abs=0.01)
    assert K._area(K._hull(ell)) == pytest.approx(28.0)
    turned = sq @ np.array([[math.cos(0.4), math.sin(0.4)], [-math.sin(0.4), math.cos(0.4)]])
    assert K._min_rect(turned) == pytest.approx((3.0, 4.0))
    many = np.array([[0, 0], [2, 0.01], [4, 0], [4, 3], [0, 3]], float)
    assert len(K._simplify(many, 0.05)) == 4 and len(K._simplify(ell, 0.05)) == 6
    # The widest circle of the L sits in its corner: r (1 + sqrt 2) against the inner corner.
    grid = [(x, y) for x in np.linspace(0.02, 5.98, 299) for y in np.linspace(0.02, 5.98, 299)]
    assert K._clear_width(ell) == pytest.approx(2 * K._edge_dist(np.array(grid), ell).max(), abs=0.05)


def test_assignment_brute_force():
    rng = np.random.default_rng(0)
    for n, m in [(1, 1), (2, 5), (4, 4), (5, 4), (6, 6), (4, 6)]:
        c = rng.random((n, m))
        got = sum(c[i, j] for i, j in joins._best_assignment(c))
        k = min(n, m)
        best = min(sum(c[i, j] for i, j in zip(a, b)) for a in itertools.combinations(range(n), k) for b in itertools.permutations(range(m), k))
        assert got == pytest.approx(best)


def test_edit_distance_brute_force():
    rnd = random.Random(5)

    def brute(ta, ma, tb, mb):
        n, m, best = len(ta), len(tb), 10 ** 9
        for image in itertools.product([None, *range(m)], repeat=n):
            used = [w for w in image if w is not None]
            if len(set(used)) != len(used) or any(w is not None and ta[v] != tb[w] for v, w in enumerate(image)):
                continue
            cost = n + m - 2 * len(used)
            ea = {(image[u], image[v]) if None not in (image[u], image[v]) else ("x", u, v) for u in range(n) for v in range(u) if ma[u, v]}
            ea = {tuple(sorted(e)) if e[0] != "x" else e for e in ea}
            eb = {tuple(sorted((u, v))) for u in range(m) for v in range(u) if mb[u, v]}
            best = min(best, cost + len(ea ^ eb))
        return best

    for _ in range(12):
        g = []
        for n in (rnd.randrange(1, 5), rnd.randrange(1, 5)):
            m = np.zeros((n, n), bool)
            for u in range(n):
                for v in range(u):
                    m[u, v] = m[v, u] = rnd.random() < 0.5
            g.append(([rnd.choice("ab") for _ in range(n)], m))
        (ta, ma), (tb, mb) = g
        turn = rnd.sample(range(len(ta)), len(ta))
        assert isomorphism._same(ta, ma, [ta[k] for k in turn], ma[np.ix_(turn, turn)])
        assert isomorphism._same(ta, ma, tb, mb) == (brute(ta, ma, tb, mb) == 0)


def test_components_two_ways(spark):
    rnd = random.Random(1)
    nodes = [(p, i) for p in range(5) for i in range(30)]
    edges = [(p, rnd.randrange(30), rnd.randrange(30)) for p in range(5) for _ in range(22)]
    n, e = spark.createDataFrame(nodes, "plan_id long, idx long"), spark.createDataFrame(edges, "plan_id long, i long, j long")
    a = {tuple(r) for r in graph.components(n, e).collect()}
    big = n.select("plan_id").distinct()
    assert a == {tuple(r) for r in graph.components(n, e, big).select("plan_id", "idx", "comp").collect()}


def test_quantiles(spark):
    rnd = random.Random(2)
    rows = [(k, rnd.choice([rnd.random() * 1e4 - 5e3, 7.0])) for k in "ab" for _ in range(400)]
    got = {r.k: r for r in ranking.quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", [0, 0.05, 0.5, 0.95, 1]).collect()}
    for k in "ab":
        want = np.percentile([v for q, v in rows if q == k], [0, 5, 50, 95, 100])
        assert np.allclose([got[k].p0, got[k].p5, got[k].p50, got[k].p95, got[k].p100], want) and got[k].n == 400


def test_rank_distributed_hot_group(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 2500, 0).otherwise(F.col("id") % 7).alias("g"), F.md5(F.col("id").cast("string")).alias("h"))
    a = {(r.g, r.h): r.pos for r in ranking.rank_distributed(df, ["g"], ["h"], "pos").collect()}
    b = {(r.g, r.h): r.pos for r in ranking.rank_within(df, ["g"], ["h"], "pos").collect()}
    assert a == b


def test_nearest_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 16)
    rng = np.random.default_rng(1)
    x = np.r_[rng.normal(size=(150, 4)), rng.normal(size=(150, 4)) * 0.01 + 3]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>")
    got = {r.id: r.dist for r in nearest.nearest_neighbour(df, "id", "vec").collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    assert np.allclose([got[i] for i in range(len(x))], d.min(1))


def test_frechet_full(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(80, 3)), rng.normal(size=(90, 3)) @ np.diag([1, 2, 3.0]) + 1
    df = spark.createDataFrame([("a", [float(v) for v in r]) for r in a] + [("b", [float(v) for v in r]) for r in b], "side string, vec array<double>")
    c1, c2 = np.cov(a, rowvar=False), np.cov(b, rowvar=False)
    ev = np.linalg.eigvals(c1 @ c2)
    want = ((a.mean(0) - b.mean(0)) ** 2).sum() + np.trace(c1 + c2) - 2 * np.sqrt(np.abs(ev)).sum()
    assert distribution.frechet(df, "side", "a", "b") == pytest.approx(want, rel=1e-9)
    assert distribution.frechet(df, "side", "a", "a") == pytest.approx(0, abs=1e-9)


def test_contours_keep_area(spark):
    t = Tables(spark, DATA)
    c = runs.run_components(t.runs.filter("plan_id < 200").select("plan_id", "label", "r", "c0", "c1"))
    rings = K.chain_rings(runs.boundary_edges(c), ["plan_id", "comp"])
    signed = F.aggregate(G.edges_of(F.col("ring")), F.lit(0.0), lambda s, e: s + e["x0"] * e["y1"] - e["x1"] * e["y0"]) / 2
    a = {(r.plan_id, r.comp): r.a for r in rings.groupBy("plan_id", "comp").agg(F.abs(F.sum(signed)).alias("a")).collect()}
    b = {(r.plan_id, r.comp): float(r.px) for r in c.select("plan_id", "comp", "px").distinct().collect()}
    assert a == b and a


def test_assign_rooms_is_one_to_one(spark):
    t = Tables(spark, DATA)
    d = joins.assign_rooms(t.gen_rooms, t.rooms)
    for side in ("a_idx", "b_idx"):
        assert d.groupBy("plan_id", side).count().filter("count > 1").isEmpty()


def test_json_lines_are_numbered(spark):
    from atrium.catalog import load
    d = load()[0]["read_jsonl_gz"](spark, DATA)
    per = d.groupBy("part").agg(F.min("line").alias("lo"), F.max("line").alias("hi"), F.count("*").alias("n"))
    assert per.filter("lo <> 0 OR hi <> n - 1").isEmpty()
    assert d.count() == spark.read.parquet(f"{DATA}/events.parquet").count()


def test_infer_edges_connects(spark):
    n = spark.createDataFrame([(1, i) for i in range(6)], "plan_id long, idx long")
    e = spark.createDataFrame([(1, 0, 1)], "plan_id long, i long, j long")
    c = spark.createDataFrame([(1, i, i + 1, 10 + i) for i in range(5)], "plan_id long, i long, j long, len long")
    new = graph.infer_edges(n, e, c)
    both = e.unionByName(new.select("plan_id", "i", "j"))
    assert graph.components(n, both).select("comp").distinct().count() == 1


def test_small_functions(spark):
    r = spark.createDataFrame([(" Living-Room ", "9'8\"", '{"k": 1} x', '{"k": 1}')], "a string, b string, c string, d string").select(
        norm_label(F.col("a")), feet_inches(F.col("b")), strict_json(F.col("c")).isNull(), strict_json(F.col("d")).isNull()).first()
    assert r[0] == "living_room" and r[1] == pytest.approx(2.9464) and r[2] and not r[3]
    with pytest.raises(ValueError):
        samples.make_samples(spark.createDataFrame([("x",)], "colour string"))


def test_empty_inputs(spark):
    r = boxes(spark, RING).limit(0)
    assert spatial.union_area(r, ["plan_id"]).isEmpty() and spatial.wall_adjacency(r).isEmpty()
    assert graph.components(r, r.select("plan_id", F.col("idx").alias("i"), F.col("idx").alias("j"))).isEmpty()


def test_edit_size(spark):
    """Plans that only one side has, retyped rooms, and a plan far above the size of any search."""
    big = [(3, k, "kitchen") for k in range(3000)]
    ra = spark.createDataFrame([(1, 0, "bath"), (1, 1, "hall"), (2, 0, "hall")] + big, "plan_id long, idx long, type string")
    rb = spark.createDataFrame([(1, 0, "bath"), (1, 1, "study"), (4, 0, "hall"), (4, 1, "hall")] + big[1:], "plan_id long, idx long, type string")
    ea = spark.createDataFrame([(1, 0, 1)] + [(3, k, k + 1) for k in range(2999)], "plan_id long, i long, j long")
    eb = spark.createDataFrame([(1, 1, 0), (4, 0, 1)] + [(3, k + 1, k) for k in range(1, 2999)], "plan_id long, i long, j long")
    assert {r.plan_id: r.ged for r in isomorphism.edit_size(ra, ea, rb, eb).collect()} == {1: 2, 2: 1, 3: 2, 4: 3}
    equal = {r.plan_id: r.equal for r in isomorphism.graph_equal(ra.filter("plan_id < 3"), ea.filter("plan_id < 3"), rb.filter("plan_id <> 3"), eb.filter("plan_id <> 3")).collect()}
    assert equal == {1: False, 2: False, 4: False}


def test_json_status(spark):
    from atrium.sources.convert import json_status
    cases = {'{"k": 3}': "json", 'Output: {"k": 3}': "json", 'x {"a":{"b":1}} y': "json_prefix", '{"k": 3} done': "json_prefix", '{"k": 3': "unparseable",
             '{"a": [1, {"k": 3}': "repaired", "nothing": "unparseable", "": "unparseable"}
    d = spark.createDataFrame([(k,) for k in cases], "text string").select("text", json_status(F.col("text")).alias("s"))
    assert {r.text: r.s for r in d.collect()} == cases


def test_edges_of_a_plan_in_parts(spark):
    from atrium.sources import samples as S
    rooms = spark.createDataFrame([(1, k, "kitchen", 0, 0, 9, 9) for k in range(5)], "plan_id long, idx long, type string, x0 long, y0 long, x1 long, y1 long")
    parts = S.nested_rooms(rooms).crossJoin(spark.range(2).select(F.col("id").alias("cut"))).select(
        F.lit("s").alias("source"), F.lit("v").alias("variant"), F.lit("1").alias("id"), F.col("cut").alias("part"),
        F.when(F.col("cut") == 0, F.slice("rooms", 1, 2)).otherwise(F.slice("rooms", 3, 3)).alias("rooms"),
        F.struct(F.array(F.struct(F.lit(0).cast("long").alias("i"), F.lit(4).cast("long").alias("j"), F.lit("door").alias("kind"))).alias("edges")).alias("graph"))
    s = S.make_samples(parts)
    assert [r.p for r in s.select(S.problems(s, F.lit(5)).alias("p")).collect()] == [[], []]
