"""Graph operators."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as N
from ..operators import isomorphism as I
from ..operators.joins import edge_sets
from ..plans import programs as PR
from ..vocab import HABITABLE
from .base import CTE, comp_sql, query
from .window_queries import front_rooms

C, lit = F.col, F.lit

CTE["adj_sym"] = "SELECT plan_id, i AS a, j AS b FROM adj UNION SELECT plan_id, j, i FROM adj"
CTE["door_sym"] = "SELECT plan_id, i AS a, j AS b FROM door_edges UNION SELECT plan_id, j, i FROM door_edges"


@query("components", "SELECT plan_id, idx, comp FROM adj_comp")
def components(t):
    return N.components(t.rooms, t.adj, t.large)


CTE["reach_rooms"] = """SELECT c.plan_id, c.idx FROM door_comp c JOIN front_room f ON c.plan_id = f.plan_id
  JOIN door_comp s ON s.plan_id = f.plan_id AND s.idx = f.seed AND s.comp = c.comp"""


@query("reachability", """SELECT f.plan_id, round(k.n::DOUBLE / n.n, 9) AS frac_reachable, k.n = n.n AS all_reachable FROM front_room f JOIN (SELECT plan_id, count(*) AS n FROM reach_rooms GROUP BY plan_id) k ON f.plan_id = k.plan_id
  JOIN (SELECT plan_id, count(*) AS n FROM rooms GROUP BY plan_id) n ON f.plan_id = n.plan_id""")
def reachability(t):
    r = N.reachable(t.rooms, t.door_edges, front_rooms(t), t.large).groupBy("plan_id").agg(F.count(lit(1)).alias("k"))
    n = t.rooms.groupBy("plan_id").agg(F.count(lit(1)).alias("n"))
    return r.join(n, "plan_id").select("plan_id", F.round(C("k") / C("n"), 9).alias("frac_reachable"), (C("k") == C("n")).alias("all_reachable"))


CTE["nobed_rooms"] = "SELECT r.plan_id, r.idx FROM rooms r JOIN front_room f ON r.plan_id = f.plan_id WHERE r.type <> 'bedroom' OR r.idx = f.seed"
CTE["nobed_edges"] = """SELECT e.plan_id, e.i, e.j FROM door_edges e JOIN nobed_rooms a ON e.plan_id = a.plan_id AND e.i = a.idx JOIN nobed_rooms b ON e.plan_id = b.plan_id AND e.j = b.idx"""
CTE["nobed_comp"] = comp_sql("nobed_rooms", "nobed_edges")
CTE["nobed_ok"] = "SELECT c.plan_id, c.idx FROM nobed_comp c JOIN front_room f ON c.plan_id = f.plan_id JOIN nobed_comp s ON s.plan_id = f.plan_id AND s.idx = f.seed AND s.comp = c.comp"


@query("via_bedroom", """SELECT f.plan_id, count(r.idx) AS n_habitable_via_bedroom FROM front_room f LEFT JOIN rooms r ON r.plan_id = f.plan_id AND r.type IN ('living_room','kitchen','bedroom','dining_room','study')
   AND NOT EXISTS (FROM nobed_ok o WHERE o.plan_id = r.plan_id AND o.idx = r.idx) AND NOT EXISTS (FROM door_sym e JOIN nobed_ok o ON o.plan_id = e.plan_id AND o.idx = e.b WHERE e.plan_id = r.plan_id AND e.a = r.idx) GROUP BY f.plan_id""")
def via_bedroom(t):
    return via_bedroom_count(t.rooms, t.door_edges, front_rooms(t), t.large)


def via_bedroom_count(rooms, doors, seeds, large=None):
    """Habitable rooms neither reachable nor next to a reachable room once bedrooms are closed."""
    nodes = rooms.join(seeds, "plan_id").filter((C("type") != "bedroom") | (C("idx") == C("seed"))).select("plan_id", "idx")
    keep = doors.select("plan_id", "i", "j").join(nodes.select("plan_id", C("idx").alias("i")), ["plan_id", "i"], "left_semi").join(
        nodes.select("plan_id", C("idx").alias("j")), ["plan_id", "j"], "left_semi")
    ok = N.reachable(nodes, keep, seeds, large)
    near = N.both_ways(doors).join(ok.select("plan_id", C("idx").alias("nb")), ["plan_id", "nb"], "left_semi").select("plan_id", "idx")
    bad = rooms.filter(C("type").isin(HABITABLE)).select("plan_id", "idx").join(ok.unionByName(near).distinct(), ["plan_id", "idx"], "left_anti")
    n = bad.groupBy("plan_id").agg(F.count(lit(1)).alias("n"))
    return seeds.select("plan_id").join(n, "plan_id", "left").select("plan_id", F.coalesce("n", lit(0)).alias("n_habitable_via_bedroom"))


@query("degrees", """WITH d AS (SELECT r.plan_id, r.idx, r.type, count(e.b) AS deg, coalesce(max((n.type IN ('corridor','entrance'))::INT), 0) AS hall FROM rooms r LEFT JOIN door_sym e ON r.plan_id = e.plan_id AND r.idx = e.a LEFT JOIN rooms n ON n.plan_id = e.plan_id AND n.idx = e.b GROUP BY ALL),
  a AS (SELECT r.plan_id, count(e.b)::DOUBLE / count(DISTINCT r.idx) AS m FROM rooms r LEFT JOIN adj_sym e ON r.plan_id = e.plan_id AND r.idx = e.a GROUP BY r.plan_id)
  SELECT d.plan_id, round(avg(deg), 9) AS mean_door_degree, max(deg) AS max_door_degree, round(any_value(a.m), 9) AS mean_adjacency_degree,
    round(CASE WHEN count(*) FILTER (type IN ('corridor','entrance')) > 0 THEN coalesce(avg(hall) FILTER (type NOT IN ('corridor','entrance')), 0) ELSE 0 END, 9) AS frac_off_hallway FROM d JOIN a ON d.plan_id = a.plan_id GROUP BY d.plan_id""")
def degrees(t):
    hall = C("type").isin("corridor", "entrance")
    r = t.rooms.select("plan_id", "idx", "type")
    nb = N.both_ways(t.door_edges).join(r.select("plan_id", C("idx").alias("nb"), hall.cast("int").alias("h")), ["plan_id", "nb"])
    d = nb.groupBy("plan_id", "idx").agg(F.count(lit(1)).alias("deg"), F.max("h").alias("h"))
    x = r.join(d, ["plan_id", "idx"], "left").na.fill(0, ["deg", "h"])
    g = x.groupBy("plan_id").agg(F.avg("deg").alias("mean"), F.max("deg").alias("max_door_degree"), F.count(lit(1)).alias("n"),
                                 F.max(hall.cast("int")).alias("has"), F.avg(F.when(~hall, C("h"))).alias("off"))
    a = t.adj.groupBy("plan_id").agg(F.count(lit(1)).alias("e"))
    g = g.join(a, "plan_id", "left")
    return g.select("plan_id", F.round("mean", 9).alias("mean_door_degree"), "max_door_degree", F.round(2 * F.coalesce("e", lit(0)) / C("n"), 9).alias("mean_adjacency_degree"),
                    F.round(F.when(C("has") == 1, F.coalesce("off", lit(0.0))).otherwise(0.0), 9).alias("frac_off_hallway"))


H60 = "('0x' || substr(md5({0}), 1, 15))::BIGINT"
CTE["wl0"] = "SELECT plan_id, idx, " + H60.format("type") + " AS h FROM rooms"
for _r in (1, 2, 3):
    CTE[f"wl{_r}"] = f"""SELECT n.plan_id, n.idx, {H60.format("n.h || '|' || coalesce(s.s, '0')")} AS h FROM wl{_r - 1} n LEFT JOIN (SELECT e.plan_id, e.a, CAST(sum(w.h) AS VARCHAR) AS s
      FROM adj_sym e JOIN wl{_r - 1} w ON e.plan_id = w.plan_id AND e.b = w.idx GROUP BY ALL) s ON n.plan_id = s.plan_id AND n.idx = s.a"""
CTE["topo"] = f"""SELECT plan_id, md5(count(*) || '|' || CAST(sum(h) AS VARCHAR) || '|' || CAST(sum({H60.format("h || '#'")}) AS VARCHAR)) AS topology
  FROM wl3 GROUP BY plan_id"""


@query("wl_hash", "SELECT * FROM topo")
def wl_hash(t):
    return N.wl_hash(t.rooms, t.adj)


@query("graph_equal")
def graph_equal(t):
    """Typed isomorphism of the program graph and the door graph."""
    prog = t.program_edges.filter("kind = 'door'").select("plan_id", C("a").alias("i"), C("b").alias("j"))
    return I.graph_equal(t.rooms, prog, t.rooms, t.door_edges)


@query("graph_edit_distance", """WITH g AS (SELECT DISTINCT a.plan_id, a.idx AS i, b.idx AS j FROM gen_rooms a JOIN gen_rooms b ON a.plan_id = b.plan_id AND a.idx < b.idx
    WHERE least(a.x1, b.x1) - greatest(a.x0, b.x0) + 60 > 0 AND least(a.y1, b.y1) - greatest(a.y0, b.y0) + 60 > 0
      AND (least(a.x1, b.x1) - greatest(a.x0, b.x0) + 60) * (least(a.y1, b.y1) - greatest(a.y0, b.y0) + 60) >= 50 * 60),
  a AS (SELECT plan_id, idx AS i, -1 AS j, type AS what FROM gen_rooms UNION SELECT plan_id, i, j, 'edge' FROM g),
  b AS (SELECT plan_id, idx AS i, -1 AS j, type AS what FROM rooms UNION SELECT plan_id, least(i, j), greatest(i, j), 'edge' FROM adj)
  SELECT plan_id, count(*) FILTER (NOT (x AND y)) AS ged FROM (SELECT plan_id, i, j, what, bool_or(s = 1) AS x, bool_or(s = 2) AS y
    FROM (SELECT *, 1 AS s FROM a UNION ALL SELECT *, 2 FROM b) GROUP BY ALL) GROUP BY plan_id""")
def graph_edit_distance(t):
    """Edit size of generated and real adjacency under the room ids that both share."""
    from ..operators.spatial import wall_adjacency
    return I.edit_size(t.gen_rooms, wall_adjacency(t.gen_rooms, large=t.large), t.rooms, t.adj)


@query("home_graph", """WITH n AS (SELECT s.home, s.storey, r.idx, r.type, s.plan_id FROM storeys s JOIN rooms r ON s.plan_id = r.plan_id)
  SELECT s.home, s.storey AS sa, e.i AS ia, s.storey AS sb, e.j AS ib, 'door' AS kind FROM (SELECT DISTINCT plan_id, i, j FROM door_edges) e JOIN storeys s ON e.plan_id = s.plan_id
  UNION ALL SELECT a.home, a.storey, a.idx, b.storey, b.idx, 'stair' FROM n a JOIN n b ON a.home = b.home AND b.storey = a.storey + 1 AND a.type = 'other' AND b.type = 'other'""")
def home_graph(t):
    """Storey graphs joined by the stair rooms of consecutive storeys."""
    inner = t.door_edges.select("plan_id", "i", "j").distinct().join(t.storeys, "plan_id").select(
        "home", C("storey").alias("sa"), C("i").alias("ia"), C("storey").alias("sb"), C("j").alias("ib"), lit("door").alias("kind"))
    st = t.rooms.filter("type = 'other'").join(t.storeys, "plan_id").select("home", "storey", "idx")
    up = st.select("home", (C("storey") - 1).alias("storey"), C("idx").alias("ib"))
    stairs = st.join(up, ["home", "storey"]).select("home", C("storey").alias("sa"), C("idx").alias("ia"), (C("storey") + 1).alias("sb"), "ib", lit("stair").alias("kind"))
    return inner.unionByName(stairs)


@query("program_recall", """SELECT s.plan_id, round(n_both::DOUBLE / nullif(n_b, 0), 9) AS door_recall, round(n_both::DOUBLE / nullif(n_a, 0), 9) AS door_precision, round(w.r, 9) AS wall_adjacent FROM set_cmp s
  LEFT JOIN (SELECT p.plan_id, avg((a.i IS NOT NULL)::INT) AS r FROM program_edges p LEFT JOIN adj a ON p.plan_id = a.plan_id AND p.a = a.i AND p.b = a.j WHERE p.kind = 'wall' GROUP BY p.plan_id) w ON s.plan_id = w.plan_id""")
def program_recall(t):
    p = t.program_edges.select("plan_id", C("a").alias("i"), C("b").alias("j"), "kind")
    s = edge_sets(t.door_edges, p.filter("kind = 'door'"))
    w = p.filter("kind = 'wall'").join(t.adj.withColumn("hit", lit(1)), ["plan_id", "i", "j"], "left").groupBy("plan_id").agg(F.avg(F.coalesce("hit", lit(0))).alias("r"))
    return s.join(w, "plan_id", "left").select("plan_id", F.round("recall", 9).alias("door_recall"), F.round("precision", 9).alias("door_precision"), F.round("r", 9).alias("wall_adjacent"))


CTE["contact"] = """SELECT a.plan_id, a.i, a.j, greatest(least(x.x1, y.x1) - greatest(x.x0, y.x0), least(x.y1, y.y1) - greatest(x.y0, y.y0)) AS len FROM adj a
  JOIN rooms x ON a.plan_id = x.plan_id AND a.i = x.idx JOIN rooms y ON a.plan_id = y.plan_id AND a.j = y.idx"""


def contacts(t):
    r = t.rooms
    x = r.select("plan_id", C("idx").alias("i"), *[C(c).alias("x" + c) for c in ("x0", "y0", "x1", "y1")])
    y = r.select("plan_id", C("idx").alias("j"), *[C(c).alias("y" + c) for c in ("x0", "y0", "x1", "y1")])
    d = t.adj.join(x, ["plan_id", "i"]).join(y, ["plan_id", "j"])
    return d.select("plan_id", "i", "j", F.greatest(F.least("xx1", "yx1") - F.greatest("xx0", "yx0"), F.least("xy1", "yy1") - F.greatest("xy0", "yy0")).alias("len"))


@query("infer_edges", """WITH c AS (SELECT k.plan_id, k.i, k.j, k.len, a.comp AS ca, b.comp AS cb FROM contact k JOIN door_comp a ON k.plan_id = a.plan_id AND k.i = a.idx JOIN door_comp b ON k.plan_id = b.plan_id AND k.j = b.idx WHERE a.comp <> b.comp),
  d AS (SELECT plan_id, ca AS comp, i, j, len FROM c UNION ALL SELECT plan_id, cb, i, j, len FROM c)
  SELECT DISTINCT plan_id, i, j, len FROM (SELECT *, row_number() OVER (PARTITION BY plan_id, comp ORDER BY len DESC, i, j) AS rn FROM d) WHERE rn = 1""")
def infer_edges(t):
    """One round: every left-over component links to another one over its longest shared wall."""
    return N.infer_round(N.components(t.rooms, t.door_edges, t.large), contacts(t))


CTE["bub_nodes"] = "SELECT plan_id, idx AS node, 'room' AS kind FROM rooms UNION ALL SELECT plan_id, 1000000 + k, CASE WHEN type = 'front_door' THEN 'front' ELSE 'door' END FROM doors"
CTE["bub_edges"] = "SELECT plan_id, 1000000 + k AS a, idx AS b FROM door_hits WHERE area >= 600"


@query("bubble_to_rooms", """SELECT plan_id, i, j, 'door' AS kind FROM (SELECT DISTINCT plan_id, min(b) AS i, max(b) AS j FROM bub_edges WHERE a <> 999999 GROUP BY plan_id, a HAVING count(DISTINCT b) = 2)
  UNION ALL SELECT DISTINCT plan_id, b, NULL, 'front' FROM bub_edges WHERE a = 999999""")
def bubble_to_rooms(t):
    nodes, e = bubble(t)
    rooms = PR.bubble_edges(e, nodes).select("plan_id", "i", "j", lit("door").alias("kind"))
    front = e.join(nodes.filter("kind = 'front'").select("plan_id", C("node").alias("a")), ["plan_id", "a"], "left_semi").select(
        "plan_id", C("b").alias("i"), lit(None).cast("long").alias("j"), lit("front").alias("kind")).distinct()
    return rooms.unionByName(front)


def bubble(t):
    """Bubble diagram: room and door nodes, an edge where a door meets a room."""
    from ..operators.spatial import door_hits
    nodes = t.rooms.select("plan_id", C("idx").alias("node"), lit("room").alias("kind")).unionByName(t.doors.select(
        "plan_id", (C("k") + 1000000).alias("node"), F.when(C("type") == "front_door", "front").otherwise("door").alias("kind")))
    e = door_hits(t.doors, t.rooms, 30, t.large).filter("area >= 600").select("plan_id", (C("k") + 1000000).alias("a"), C("idx").alias("b"))
    return nodes, e


@query("door_graph_reduce", "SELECT plan_id, i, j FROM adj a WHERE EXISTS (FROM door_edges d WHERE d.plan_id = a.plan_id AND d.i = a.i AND d.j = a.j)")
def door_graph_reduce(t):
    return t.adj.join(t.door_edges.select("plan_id", "i", "j"), ["plan_id", "i", "j"], "left_semi")


@query("is_tree", """SELECT n.plan_id, c.k = 1 AND coalesce(e.e, 0) = n.n - 1 AS is_tree FROM (SELECT plan_id, count(*) AS n FROM rooms GROUP BY 1) n JOIN (SELECT plan_id, count(DISTINCT comp) AS k FROM door_comp GROUP BY 1) c ON n.plan_id = c.plan_id
  LEFT JOIN (SELECT plan_id, count(DISTINCT (i, j)) AS e FROM door_edges GROUP BY 1) e ON n.plan_id = e.plan_id""")
def is_tree(t):
    return tree_flags(t.rooms, t.door_edges, t.large).select("plan_id", "is_tree")


def tree_flags(rooms, edges, large=None):
    c = N.components(rooms, edges, large).groupBy("plan_id").agg(F.count(lit(1)).alias("n"), F.count_if(C("idx") == C("comp")).alias("k"))
    e = edges.select("plan_id", "i", "j").distinct().groupBy("plan_id").agg(F.count(lit(1)).alias("e"))
    d = c.join(e, "plan_id", "left")
    return d.select("plan_id", (C("k") == 1).alias("connected"), ((C("k") == 1) & (F.coalesce("e", lit(0)) == C("n") - 1)).alias("is_tree"))


@query("add_stair_rooms", """SELECT home, storey, plan_id, idx AS host, p AS rule FROM (SELECT s.home, s.storey, s.plan_id, r.idx, CASE WHEN type = 'other' THEN 0 WHEN type IN ('corridor','entrance') THEN 1 ELSE 2 END AS p,
   row_number() OVER (PARTITION BY s.plan_id ORDER BY CASE WHEN type = 'other' THEN 0 WHEN type IN ('corridor','entrance') THEN 1 ELSE 2 END, (x1 - x0) * (y1 - y0) DESC, idx) AS rn
   FROM storeys s JOIN rooms r ON s.plan_id = r.plan_id WHERE s.n_storeys > 1) WHERE rn = 1""")
def add_stair_rooms(t):
    return PR.stair_rooms(t.rooms, t.storeys)


@query("make_program", """SELECT r.plan_id, 'r' || r.idx AS id, r.type, (x1 - x0) * (y1 - y0) / 10000 AS target_net_area, r.type IN ('living_room','bedroom','kitchen','study') AS needs_exterior,
   coalesce(f.seed = r.idx, false) AS entrance, count(e.i) AS n_doors FROM rooms r LEFT JOIN front_room f ON r.plan_id = f.plan_id
   LEFT JOIN (SELECT DISTINCT plan_id, i, j FROM door_edges) e ON e.plan_id = r.plan_id AND (e.i = r.idx OR e.j = r.idx) GROUP BY ALL""")
def make_program(t):
    """Program rooms with their number of door connections and the entrance mark."""
    d = N.both_ways(t.door_edges).groupBy("plan_id", "idx").agg(F.count(lit(1)).alias("n"))
    p = PR.program_rooms(t.rooms).withColumn("idx", F.substring("id", 2, 12).cast("long"))
    j = p.join(d, ["plan_id", "idx"], "left").join(front_rooms(t), "plan_id", "left")
    return j.select("plan_id", "id", "type", "target_net_area", "needs_exterior", F.coalesce(C("seed") == C("idx"), lit(False)).alias("entrance"),
                    F.coalesce("n", lit(0)).alias("n_doors"))


@query("door_graph_summary", """WITH m AS (SELECT p.plan_id, p.dataset, s.n_a, s.n_b, s.n_both, s.n_any, t.c, t.tr FROM plans p JOIN set_cmp s ON p.plan_id = s.plan_id JOIN (SELECT n.plan_id, c.k = 1 AS c, c.k = 1 AND coalesce(e.e, 0) = n.n - 1 AS tr
    FROM (SELECT plan_id, count(*) AS n FROM rooms GROUP BY 1) n JOIN (SELECT plan_id, count(DISTINCT comp) AS k FROM door_comp GROUP BY 1) c ON n.plan_id = c.plan_id LEFT JOIN (SELECT plan_id, count(DISTINCT (i, j)) AS e FROM door_edges GROUP BY 1) e ON n.plan_id = e.plan_id) t ON p.plan_id = t.plan_id)
  SELECT dataset, count(*) AS n_plans, round(avg((n_both = n_any)::INT), 9) AS equal, round(avg(n_both::DOUBLE / n_any), 9) AS jaccard, round(avg(n_both::DOUBLE / nullif(n_b, 0)), 9) AS recall, round(avg(c::INT), 9) AS connected, round(avg(tr::INT), 9) AS tree FROM m GROUP BY dataset""")
def door_graph_summary(t):
    prog = t.program_edges.filter("kind = 'door'").select("plan_id", C("a").alias("i"), C("b").alias("j"))
    d = edge_sets(t.door_edges, prog).join(tree_flags(t.rooms, t.door_edges, t.large), "plan_id").join(t.plans.select("plan_id", "dataset"), "plan_id")
    a = lambda c: F.round(F.avg(c), 9)
    return d.groupBy("dataset").agg(F.count(lit(1)).alias("n_plans"), a((C("n_both") == C("n_any")).cast("int")).alias("equal"), a("jaccard").alias("jaccard"),
                                    a("recall").alias("recall"), a(C("connected").cast("int")).alias("connected"), a(C("is_tree").cast("int")).alias("tree"))
