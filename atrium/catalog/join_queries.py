"""Joins and set operations."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators.nearest import nearest_neighbour
from ..operators.ranking import hash_order, rank_distributed
from ..plans import metrics as M
from ..plans.rules import room_attributes
from .tables import HOMES
from .base import CTE, query

C, lit = F.col, F.lit


@query("threshold_join", """SELECT plan_id, idx, type_canonical AS type, area_cm2 < min_area * 10000 AS small, width_cm < min_width * 100 AS narrow, coalesce(aspect > max_aspect, false) AS long_room
  FROM room_attrs r JOIN thresholds t ON t.type = r.type_canonical""")
def threshold_join(t):
    r = room_attributes(t.rooms).join(F.broadcast(t.thresholds), "type")
    return r.select("plan_id", "idx", "type", (C("area_cm2") < C("min_area") * 10000).alias("small"), (C("width_cm") < C("min_width") * 100).alias("narrow"),
                    F.coalesce(C("aspect") > C("max_aspect"), lit(False)).alias("long_room"))


@query("edge_types", """SELECT e.plan_id, e.i, e.j, e.kind, a.type AS ti, b.type AS tj FROM edges e JOIN rooms a ON e.plan_id = a.plan_id AND e.i = a.idx JOIN rooms b ON e.plan_id = b.plan_id AND e.j = b.idx""")
def edge_types(t):
    return M.typed_pairs(t.edges, t.rooms).select("plan_id", "i", "j", "kind", "ti", "tj")


@query("neighbour_types", """SELECT DISTINCT e.plan_id, e.a AS idx, r.type AS nb FROM (SELECT plan_id, i AS a, j AS b FROM adj UNION ALL SELECT plan_id, j, i FROM adj) e JOIN rooms r ON e.plan_id = r.plan_id AND e.b = r.idx""")
def neighbour_types(t):
    from ..operators.graph import both_ways
    return both_ways(t.adj).join(t.rooms.select("plan_id", C("idx").alias("nb"), "type"), ["plan_id", "nb"]).select(
        "plan_id", "idx", C("type").alias("nb")).distinct()


@query("full_type_join", """SELECT coalesce(g.plan_id, r.plan_id) AS plan_id, coalesce(g.type, r.type) AS type, coalesce(a, 0) AS n_gen, coalesce(b, 0) AS n_gt FROM (SELECT plan_id, type, count(*) AS a FROM gen_rooms GROUP BY ALL) g
  FULL JOIN (SELECT plan_id, type, count(*) AS b FROM rooms GROUP BY ALL) r ON g.plan_id = r.plan_id AND g.type = r.type""")
def full_type_join(t):
    g = t.gen_rooms.groupBy("plan_id", "type").agg(F.count(lit(1)).alias("a"))
    r = t.rooms.groupBy("plan_id", "type").agg(F.count(lit(1)).alias("b"))
    return g.join(r, ["plan_id", "type"], "full_outer").select("plan_id", "type", F.coalesce("a", lit(0)).alias("n_gen"), F.coalesce("b", lit(0)).alias("n_gt"))


@query("pickle_join", """SELECT 'test_' || p.plan_id AS sample_id, p.plan_id AS record_id, n.n AS n_rooms FROM plans p JOIN (SELECT plan_id, count(*) AS n FROM rooms GROUP BY plan_id) n
  ON p.plan_id = n.plan_id WHERE p.plan_id IN (SELECT plan_id FROM storeys WHERE storey = 0)""")
def pickle_join(t):
    """Samples joined to archive records by the number at the end of their id, limited to an id list."""
    s = t.plans.select(F.concat(lit("test_"), C("plan_id")).alias("sample_id"))
    arch = t.rooms.groupBy("plan_id").agg(F.count(lit(1)).alias("n_rooms")).withColumnRenamed("plan_id", "record_id")
    ids = t.storeys.filter("storey = 0").select(C("plan_id").alias("record_id")).distinct()
    key = F.split_part("sample_id", lit("_"), lit(-1)).cast("long")
    return s.withColumn("record_id", key).join(arch, "record_id").join(ids, "record_id", "left_semi").select("sample_id", "record_id", "n_rooms")


@query("exclude_reference", "SELECT plan_id FROM plans WHERE dataset = 'F' AND plan_id NOT IN (SELECT plan_id FROM storeys WHERE storey = 0)")
def exclude_reference(t):
    return t.plans.filter("dataset = 'F'").select("plan_id").join(t.storeys.filter("storey = 0").select("plan_id"), "plan_id", "left_anti")


@query("nearest_join", """SELECT a.vec_id, min_by(b.vec_id, struct_pack(d := list_distance(a.vec, b.vec), v := b.vec_id)) AS nn_id, round(min(list_distance(a.vec, b.vec)), 6) AS dist
  FROM features a JOIN features b ON a.vec_id <> b.vec_id GROUP BY a.vec_id""")
def nearest_join(t):
    return nearest_neighbour(t.features, "vec_id", "vec").withColumn("dist", F.round("dist", 6))


@query("assign_rooms")
def assign_rooms(t):
    """One-to-one same-type matching of generated and real rooms with the least total centroid distance."""
    return J.assign_rooms(t.gen_rooms, t.rooms)


CTE["plinks"] = "SELECT e.plan_id, e.a, e.b, e.kind FROM program_edges e JOIN gen_rooms x ON e.plan_id = x.plan_id AND e.a = x.idx JOIN gen_rooms y ON e.plan_id = y.plan_id AND e.b = y.idx"


@query("program_link", "SELECT * FROM plinks")
def program_link(t):
    return J.linked_edges(t.program_edges, t.gen_rooms)


CTE["wall_cover"] = """SELECT w.plan_id, w.idx, w.x0 AS lo, w.x1 AS hi, greatest(d.x0, w.x0) AS a, least(d.x1, w.x1) AS b FROM rooms w LEFT JOIN windows d
  ON w.plan_id = d.plan_id AND d.room = w.idx"""
CTE["cover_pieces"] = """SELECT plan_id, idx, x0 AS lo, x1 AS hi, x0 + 40 AS a, x0 + 100 + pk % 50 AS b FROM rooms
  UNION ALL SELECT plan_id, idx, x0, x1, x0 + 90, x0 + 170 FROM rooms WHERE pk % 2 = 0 UNION ALL SELECT plan_id, idx, x0, x1, x0 + 220, x1 - pk % 60 FROM rooms"""
CTE["wall_gaps"] = """SELECT plan_id, idx, g0, g1 FROM (SELECT plan_id, idx, coalesce(max(b) OVER (PARTITION BY plan_id, idx ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lo) AS g0, a AS g1 FROM cover_pieces
   UNION ALL SELECT plan_id, idx, max(b), max(hi) FROM cover_pieces GROUP BY plan_id, idx) WHERE g1 - g0 > 30"""


def cover_pieces(t):
    a = [F.struct((C("x0") + 40).alias("a"), (C("x0") + 100 + C("pk") % 50).alias("b")),
         F.struct(F.when(C("pk") % 2 == 0, C("x0") + 90).alias("a"), (C("x0") + 170).alias("b")),
         F.struct((C("x0") + 220).alias("a"), (C("x1") - C("pk") % 60).alias("b"))]
    return t.rooms.select("plan_id", "idx", C("x0").alias("lo"), C("x1").alias("hi"), F.inline(F.array(*a))).filter("a IS NOT NULL")


@query("interval_gap", "SELECT * FROM wall_gaps")
def interval_gap(t):
    return J.interval_gaps(cover_pieces(t), ["plan_id", "idx"], 30)


@query("find_sample", """SELECT p.plan_id, coalesce(a.gen_id, b.gen_id) AS found FROM plans p LEFT JOIN gen_ids a ON a.gen_id = p.plan_id::VARCHAR LEFT JOIN gen_ids b ON b.gen_id = p.plan_id || '_0'""")
def find_sample(t):
    g = t.gen_ids
    p = t.plans.select("plan_id", C("plan_id").cast("string").alias("k"), F.concat(C("plan_id"), lit("_0")).alias("k0"))
    d = p.join(g.select(C("gen_id").alias("k"), C("gen_id").alias("a")), "k", "left").join(g.select(C("gen_id").alias("k0"), C("gen_id").alias("b")), "k0", "left")
    return d.select("plan_id", F.coalesce("a", "b").alias("found"))


@query("condition_join", """SELECT h.home, h.storey, p.plan_id, p.plan_id IS NULL AS missing FROM (SELECT c_custkey * 1000000 AS home, s AS storey FROM customer, (SELECT unnest([0, 1, 2]) AS s) WHERE s < 1 + c_custkey % 3) h
  LEFT JOIN storeys p ON h.home = p.home AND h.storey = p.storey""")
def condition_join(t):
    want = t.raw("customer").select((C("c_custkey") * HOMES).alias("home"), F.explode(F.sequence(lit(0).cast("long"), C("c_custkey") % 3)).alias("storey"))
    return want.join(t.storeys.select("home", "storey", "plan_id"), ["home", "storey"], "left").select(
        "home", "storey", "plan_id", C("plan_id").isNull().alias("missing"))


# ---- set operations ----

@query("union_edges", "SELECT * FROM edges")
def union_edges(t):
    return t.edges


@query("merge_results", """SELECT plan_id, dataset, 'new' AS origin FROM plans WHERE dataset = 'F' UNION ALL SELECT plan_id, dataset, 'old' FROM plans WHERE dataset NOT IN (SELECT dataset FROM plans WHERE dataset = 'F')""")
def merge_results(t):
    old = t.plans.select("plan_id", "dataset", lit("old").alias("origin"))
    new = t.plans.filter("dataset = 'F'").select("plan_id", "dataset", lit("new").alias("origin"))
    return J.merge_targets(old, new, "dataset")


@query("distinct_pairs", """SELECT DISTINCT plan_id, least(a, b) AS i, greatest(a, b) AS j FROM (SELECT plan_id, a, b FROM program_edges UNION ALL SELECT plan_id, b, a FROM program_edges UNION ALL SELECT plan_id, i, j FROM adj)""")
def distinct_pairs(t):
    p = t.program_edges
    e = p.select("plan_id", "a", "b").unionByName(p.select("plan_id", C("b").alias("a"), C("a").alias("b"))).unionByName(
        t.adj.select("plan_id", C("i").alias("a"), C("j").alias("b")))
    return e.select("plan_id", F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).distinct()


CTE["set_cmp"] = """SELECT coalesce(a.plan_id, s.plan_id) AS plan_id, count(a.i) AS n_a, count(s.i) AS n_b, count(*) FILTER (a.i IS NOT NULL AND s.i IS NOT NULL) AS n_both, count(*) AS n_any
  FROM (SELECT DISTINCT plan_id, i, j FROM door_edges) a FULL JOIN (SELECT DISTINCT plan_id, a AS i, b AS j FROM program_edges WHERE kind = 'door') s ON a.plan_id = s.plan_id AND a.i = s.i AND a.j = s.j GROUP BY 1"""


@query("edge_set_compare", """SELECT plan_id, n_a, n_b, n_both, round(n_both::DOUBLE / nullif(n_a, 0), 9) AS precision, round(n_both::DOUBLE / nullif(n_b, 0), 9) AS recall, round(n_both::DOUBLE / n_any, 9) AS jaccard FROM set_cmp""")
def edge_set_compare(t):
    prog = t.program_edges.filter("kind = 'door'").select("plan_id", C("a").alias("i"), C("b").alias("j"))
    d = J.edge_sets(t.door_edges, prog)
    return d.select("plan_id", "n_a", "n_b", "n_both", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "jaccard")])


@query("edge_override", "SELECT plan_id, i, j, CASE WHEN bool_or(kind = 'door') THEN 'door' ELSE 'adjacent' END AS kind FROM edges GROUP BY plan_id, i, j")
def edge_override(t):
    e = t.edges.withColumn("kind", F.when(C("kind") == "door", "door").otherwise("adjacent"))
    return e.groupBy("plan_id", "i", "j").agg(F.max_by("kind", F.when(C("kind") == "door", 1).otherwise(0)).alias("kind"))


@query("disjoint_halves", """SELECT plan_id, dataset, CASE WHEN (row_number() OVER (PARTITION BY dataset ORDER BY md5(plan_id || ':1'))) * 2 <= count(*) OVER (PARTITION BY dataset) THEN 0 ELSE 1 END AS half FROM plans""")
def disjoint_halves(t):
    """Hash-ordered halves of every dataset. A dataset may hold most plans, so positions come from one range sort."""
    p = t.plans.select("plan_id", "dataset")
    r = rank_distributed(p, ["dataset"], [hash_order("plan_id", seed=1)], "pos")
    n = p.groupBy("dataset").agg(F.count(lit(1)).alias("n"))
    return r.join(n, "dataset").select("plan_id", "dataset", F.when((C("pos") + 1) * 2 <= C("n"), 0).otherwise(1).alias("half"))


@query("restore_rejected", """SELECT event_id, user_id, 'room' AS op, value FROM events WHERE event_type = 'signup' UNION ALL SELECT event_id, user_id, 'opening', value FROM events WHERE event_type = 'error' AND value > 10
  UNION ALL SELECT event_id, user_id, 'room', value * 2 FROM events WHERE event_type = 'error' AND value <= 10""")
def restore_rejected(t):
    """Accepted rooms plus the payloads of rejected commands, by operation."""
    e = t.raw("events").select("event_id", "user_id", "event_type", "value")
    rej = e.filter("event_type = 'error'")
    keep = e.filter("event_type = 'signup'").select("event_id", "user_id", lit("room").alias("op"), "value")
    openings = rej.filter("value > 10").select("event_id", "user_id", lit("opening").alias("op"), "value")
    rooms = rej.filter("value <= 10").select("event_id", "user_id", lit("room").alias("op"), (C("value") * 2).alias("value"))
    return keep.unionByName(openings).unionByName(rooms)


@query("concat_datasets", "SELECT plan_id, variant, NULL::BIGINT AS home, 'F' AS label FROM plans WHERE dataset = 'F' UNION ALL SELECT plan_id, variant, home, 'O' FROM plans WHERE dataset = 'O'")
def concat_datasets(t):
    f = t.plans.filter("dataset = 'F'").select("plan_id", "variant", lit("F").alias("label"))
    o = t.plans.filter("dataset = 'O'").select("plan_id", "variant", "home", lit("O").alias("label"))
    return f.unionByName(o, allowMissingColumns=True)


