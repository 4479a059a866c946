"""Conversions to plan tables, over record shapes derived from the given tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import kernels as K

from ..operators.joins import interval_gaps
from ..operators.ranking import rank_within
from ..operators.spatial import door_hits

from ..plans import edge_lists, openings
from ..plans import runs as R
from ..plans.shape import set_areas
from ..session import checkpointed, kept_rows, spread
from ..sources import convert as V
from ..sources.outputs import output_rooms, parse_outputs
from . import spatial_queries  # noqa: F401  (defines the shared walls that the edge list's SQL uses)
from .base import CTE, SQL, _list, query
from .join_queries import cover_pieces
from .tables import ANSWER_LABELS, pick

C, lit = F.col, F.lit
BOX = ("x0", "y0", "x1", "y1")
FIN = ["MH 1", "KPH/WC", "OH+K", "ET", "KHH", "PARVEKE 2", "??", "VH"]
FIN_T = ["bedroom", "bathroom", "living_room", "entrance", "laundry", "balcony", "other", "closet"]


@query("conv_cubicasa", """WITH r AS (SELECT plan_id, idx, pk, [""" + ",".join(f"'{x}'" for x in FIN_T) + """][pk % 8 + 1] AS type, (x1 - x0) AS px, ((x1 - x0) // 30 + ((y1 - y0) % 12) / 12.0::DOUBLE) * 0.3048 AS m, (x1 - x0) * (y1 - y0) AS a, pk % 10 = 9 AS overlay FROM rooms),
  s AS (SELECT plan_id, quantile_cont(m / px, 0.5) AS scale FROM r GROUP BY plan_id)
  SELECT r.plan_id, idx, type, a / 10000 AS area_m2, overlay, round(s.scale, 9) AS scale FROM r JOIN s ON r.plan_id = s.plan_id""")
def conv_cubicasa(t):
    """Floors with label tokens and imperial dimension labels; overlay spaces are marked."""
    r = t.rooms.withColumn("overlay", C("pk") % 10 == 9).withColumn("label", pick(FIN, C("pk") % len(FIN)))
    dims = r.select("plan_id", (C("x1") - C("x0")).alias("px"), F.concat(F.floor((C("x1") - C("x0")) / 30), lit("' "), (C("y1") - C("y0")) % 12, lit('"')).alias("label"))
    s = V.floor_scale(dims, ["plan_id"])
    return r.join(s, "plan_id").select("plan_id", "idx", F.coalesce(V.label_token_type(C("label")), lit("other")).alias("type"),
                                       ((C("x1") - C("x0")) * (C("y1") - C("y0")) / 10000).alias("area_m2"), "overlay", F.round("scale_p50", 9).alias("scale"))


@query("conv_lifull", """SELECT plan_id, idx, CASE WHEN pk % 3 = 2 AND pk % 2 = 0 THEN (x1 - x0) * (y1 - y0) ELSE ra END::DOUBLE AS area FROM (
  SELECT r.*, abs(s.a) AS ra FROM rooms r JOIN (SELECT plan_id, idx, sum(x0 * y1 - x1 * y0) / 2 AS a FROM ring_segs GROUP BY ALL) s USING (plan_id, idx))""")
def conv_lifull(t):
    """Loose edges chained to rings; a ring covering under half of its box becomes the box."""
    r = C("ring")
    thin = F.when((C("pk") % 3 == 2) & (C("pk") % 2 == 0), F.array(r[0], r[1], F.struct(r[1]["x"].alias("x"), (r[1]["y"] + 1).alias("y")), F.struct(r[4]["x"].alias("x"), r[4]["y"].alias("y")))).otherwise(r)
    e = t.rings.select("plan_id", "idx", F.inline(F.shuffle(G.edges_of(thin))))
    c = V.bbox_fallback(K.chain_rings(spread(e), ["plan_id", "idx"]), "ring", 0.51)
    return c.select("plan_id", "idx", G.polygon_area(C("ring")).alias("area"))


@query("conv_magicplan", """WITH d AS (SELECT plan_id, k, x0, y0, x1, y1 FROM doors), ok AS (SELECT plan_id, idx FROM rooms WHERE pk % 19 <> 0)
  SELECT r.plan_id, r.idx, r.x0::DOUBLE AS x0, -r.y1::DOUBLE AS y_top, count(h.k) AS n_doors FROM rooms r JOIN ok ON r.plan_id = ok.plan_id AND r.idx = ok.idx LEFT JOIN door_hits h ON h.plan_id = r.plan_id AND h.idx = r.idx GROUP BY ALL""")
def conv_magicplan(t):
    """Room-local rings moved to the floor with y negated; rooms with non-finite points dropped; doors within 0.3 m link."""
    local = F.transform("ring", lambda p: F.struct(F.when(C("pk") % 19 == 0, lit(float("nan"))).otherwise(p["x"] - C("x0")).alias("x"), (p["y"] - C("y0")).alias("y")))
    r = t.rings.withColumn("ring", V.local_to_world(local, C("x0").cast("double"), C("y0").cast("double"))).filter(G.finite_ring(C("ring")))
    h = door_hits(t.doors, t.rooms, 30, t.large).groupBy("plan_id", "idx").agg(F.count(lit(1)).alias("n"))
    b = G.bbox(C("ring"))
    return r.join(h, ["plan_id", "idx"], "left").select("plan_id", "idx", b["x0"].alias("x0"), b["y0"].alias("y_top"), F.coalesce("n", lit(0)).alias("n_doors"))


@query("conv_msd", """SELECT DISTINCT plan_id, least(a, b) AS i, greatest(a, b) AS j, CASE WHEN kind = 'door' THEN 'door' ELSE 'passage' END AS kind FROM program_edges WHERE a <> b AND a NOT IN (SELECT 5)""")
def conv_msd(t):
    """Class ids named, structure split off, edges ordered and deduplicated."""
    p = t.program_edges
    both = p.select("plan_id", "a", "b", "kind").unionByName(p.select("plan_id", C("b").alias("a"), C("a").alias("b"), "kind").filter("b <> 5")).filter("a <> 5 OR b < a")
    both = both.unionByName(p.select("plan_id", "a", C("a").alias("b"), "kind"))
    e = V.norm_edges(both.withColumn("kind", F.when(C("kind") == "door", "door").otherwise("passage")))
    return e.filter("i <> 5")


@query("conv_procthor", """SELECT plan_id, idx, (x0 + 50)::DOUBLE AS x0, y0::DOUBLE AS z0, (x0 + 140)::DOUBLE AS x1, y0::DOUBLE AS z1, CASE WHEN idx = 0 THEN 'front_door' ELSE 'interior_door' END AS type FROM rooms""")
def conv_procthor(t):
    wall = F.concat_ws("|", lit("wall"), F.when(C("idx") == 0, "exterior").otherwise(C("idx").cast("string")), *[C(c).cast("string") for c in ("x0", "y0", "x1", "y0")])
    d = t.rooms.select("plan_id", "idx", wall.alias("wall_id"), lit(50.0).alias("lo"), lit(140.0).alias("hi"))
    return V.wall_holes(d).select("plan_id", "idx", "x0", "z0", "x1", "z1", "type")


CTE["type_parts"] = "SELECT plan_id, type, (x1 - x0) * (y1 - y0) AS a, idx FROM rooms"


@query("conv_resplan", """SELECT r.plan_id, r.idx, round(sqrt((50.0 + r.plan_id % 50) / (u.union_cm2 / 1.0)), 9) AS scale, r.idx = m.big AS is_boundary FROM rooms r JOIN plan_union u ON r.plan_id = u.plan_id
  JOIN (SELECT plan_id, arg_max(idx, (x1 - x0) * (y1 - y0) * 10000 - idx) AS big FROM rooms GROUP BY plan_id) m ON m.plan_id = r.plan_id""")
def conv_resplan(t):
    """Scale from the declared over the drawn inner area; the largest ring marks the boundary."""
    from ..operators.spatial import union_area
    u = union_area(t.rooms, ["plan_id"], t.large)
    area = (C("x1") - C("x0")) * (C("y1") - C("y0"))
    big = t.rooms.groupBy("plan_id").agg(F.max_by("idx", F.struct(area, -C("idx"))).alias("big"))
    return t.rooms.join(u, "plan_id").join(big, "plan_id").select(
        "plan_id", "idx", F.round(V.area_scale(lit(50.0) + C("plan_id") % 50, C("union_area")), 9).alias("scale"), (C("idx") == C("big")).alias("is_boundary"))


@query("conv_rplan", "SELECT plan_id, idx, type FROM rooms WHERE plan_id NOT IN (SELECT plan_id FROM rooms WHERE y1 > 1500 OR pk % 23 = 0)")
def conv_rplan(t):
    ring = F.transform("ring", lambda p: F.struct(p["x"].alias("x"), F.when(C("pk") % 23 == 0, lit(None).cast("double")).otherwise(p["y"]).alias("y")))
    return V.clean_plans(t.rings.withColumn("ring", ring), "ring", 0.0, 1500.0).select("plan_id", "idx", "type")


@query("conv_rplan_doors", """WITH ok AS (SELECT plan_id FROM type_diff GROUP BY plan_id HAVING sum(abs(a - b)) = 0)
  SELECT r.plan_id, r.idx, CASE WHEN f.plan_id IS NULL THEN NULL ELSE q.idx IS NOT NULL END AS reachable FROM rooms r JOIN ok ON r.plan_id = ok.plan_id LEFT JOIN front_room f ON f.plan_id = r.plan_id LEFT JOIN reach_rooms q ON q.plan_id = r.plan_id AND q.idx = r.idx""")
def conv_rplan_doors(t):
    """Plans whose categories agree with the mask archive, with the reachability of every room through the real doors."""
    from ..operators.graph import reachable
    from .window_queries import front_rooms
    ok = V.same_multiset(t.gen_rooms, t.rooms)
    f = front_rooms(t)
    q = reachable(t.rooms, t.door_edges, f, t.large).withColumn("hit", lit(True))
    d = t.rooms.select("plan_id", "idx").join(ok, "plan_id", "left_semi").join(f.select("plan_id", lit(True).alias("has")), "plan_id", "left").join(q, ["plan_id", "idx"], "left")
    return d.select("plan_id", "idx", F.when(C("has"), F.coalesce("hit", lit(False))).alias("reachable"))


CTE["swiss_rooms"] = """SELECT plan_id, idx AS k, type, string_agg(CAST(x AS BIGINT) || ' ' || CAST(-y AS BIGINT), ', ' ORDER BY p.k DESC) AS ring
  FROM ring_points p JOIN rooms r USING (plan_id, idx) WHERE type NOT IN ('garage', 'outdoor') GROUP BY ALL"""


@query("conv_swiss", """SELECT plan_id, CASE WHEN type = 'other' THEN 'wall' ELSE 'room' END AS kind, k, type, ring FROM swiss_rooms
  UNION ALL SELECT plan_id, 'door', k, type, x0 || ' ' || -y1 || ', ' || x1 || ' ' || -y1 || ', ' || x1 || ' ' || -y0 || ', ' || x0 || ' ' || -y0 FROM doors
  UNION ALL SELECT plan_id, 'window', room, 'window', x0 || ' ' || -y1 || ', ' || x1 || ' ' || -y1 || ', ' || x1 || ' ' || -y0 || ', ' || x0 || ' ' || -y0 FROM windows""")
def conv_swiss(t):
    """Entity rows with their outlines: areas become rooms, separators walls, openings doors or windows; y is turned over, unwanted subtypes go."""
    def boxed(d, kind, k, name):
        ys = (-C("y1"), -C("y0"))
        pts = [(C("x0"), ys[0]), (C("x1"), ys[0]), (C("x1"), ys[1]), (C("x0"), ys[1])]
        ring = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in pts])
        return d.select("plan_id", lit(kind).alias("kind"), k.cast("long").alias("k"), name.alias("type"), V.ring_text(ring).alias("ring"))

    a = t.rings.filter(~C("type").isin("garage", "outdoor"))
    flipped = F.reverse(G.affine(C("ring"), 1, 0, 0, -1))
    rows = a.select("plan_id", F.when(C("type") == "other", "wall").otherwise("room").alias("kind"), C("idx").alias("k"), "type", V.ring_text(flipped).alias("ring"))
    return rows.unionByName(boxed(t.doors, "door", C("k"), C("type"))).unionByName(boxed(t.windows, "window", C("room"), lit("window")))


@query("conv_t2d", "SELECT b.plan_id, b.label, b.x0, b.y0, b.x1, b.y1, p.dataset AS split FROM run_boxes b JOIN plans p ON b.plan_id = p.plan_id")
def conv_t2d(t):
    """Label image to room components of at least nine pixels, with their split."""
    c = R.run_components(t.runs.select("plan_id", "label", "r", "c0", "c1"), 9)
    return R.component_boxes(c).join(t.plans.select("plan_id", C("dataset").alias("split")), "plan_id").select("plan_id", "label", "x0", "y0", "x1", "y1", "split")


@query("conv_node_masks", """SELECT r.plan_id, r.idx AS node, coalesce(v.px, 0) AS pixels, v.px IS NULL AS missing FROM rooms r LEFT JOIN (SELECT plan_id, top, CAST(sum(c1 - c0) AS BIGINT) AS px FROM paint_cells GROUP BY ALL) v ON r.plan_id = v.plan_id AND r.idx = v.top""")
def conv_node_masks(t):
    """Masks painted in node order, later nodes win; nodes without a visible pixel are reported."""
    v = R.painted(t.runs, "idx").groupBy("plan_id", C("top").alias("idx")).agg(F.sum(C("c1") - C("c0")).alias("px"))
    return t.rooms.select("plan_id", "idx").join(v.hint("merge"), ["plan_id", "idx"], "left").select("plan_id", C("idx").alias("node"), F.coalesce("px", lit(0)).alias("pixels"), C("px").isNull().alias("missing"))


@query("conv_node_polys", "SELECT plan_id, idx, CASE pk % 3 WHEN 0 THEN 4 WHEN 1 THEN 6 ELSE 5 END AS corners FROM rooms WHERE pk % 6 <> 0")
def conv_node_polys(t):
    """Repeated corners dropped; polygons with fewer than three distinct corners dropped."""
    r = C("ring")
    bad = F.when(C("pk") % 6 == 0, F.array(r[0], r[0], r[1], r[1])).otherwise(F.flatten(F.transform(r, lambda p: F.array(p, p))))
    d = t.rings.withColumn("ring", F.filter(bad, lambda p, i: (i == 0) | (p != F.get(bad, i - 1))))
    return d.filter(F.size(F.array_distinct("ring")) >= 3).select("plan_id", "idx", F.size("ring").cast("long").alias("corners"))


@query("conv_wall_graph", "SELECT plan_id, idx, k, round(y * 256.0 / 120.0, 6) AS x, round(x * 256.0 / 120.0, 6) AS y FROM ring_points")
def conv_wall_graph(t):
    """Node cycles looked up in the node table by position, then turned from (row, col) of 120 px to (x, y) of 256 px."""
    nodes = t.ring_points
    cycles = t.rings.select("plan_id", "idx", F.explode(F.sequence(lit(0), F.size("ring") - 1)).alias("k")).withColumn("k", C("k").cast("long"))
    return cycles.join(nodes, ["plan_id", "idx", "k"]).select("plan_id", "idx", "k", F.round(C("y") * 256.0 / 120.0, 6).alias("x"), F.round(C("x") * 256.0 / 120.0, 6).alias("y"))


@query("conv_post_segments", """SELECT e.plan_id, a.n AS i, b.n AS j, count(*) AS n FROM program_edges e JOIN (SELECT plan_id, idx, row_number() OVER (PARTITION BY plan_id ORDER BY idx) - 1 AS n FROM rooms WHERE pk % 8 <> 0) a ON e.plan_id = a.plan_id AND e.a = a.idx
  JOIN (SELECT plan_id, idx, row_number() OVER (PARTITION BY plan_id ORDER BY idx) - 1 AS n FROM rooms WHERE pk % 8 <> 0) b ON e.plan_id = b.plan_id AND e.b = b.idx GROUP BY ALL""")
def conv_post_segments(t):
    """Short rings dropped, survivors renumbered, edges carried to the new numbers."""
    closed = F.when(C("pk") % 8 == 0, F.slice("ring", 1, 2)).otherwise(F.concat("ring", F.slice("ring", 1, 1)))
    r = t.rings.withColumn("ring", F.slice(closed, 1, F.size(closed) - 1)).filter(F.size("ring") >= 3).select("plan_id", "idx")
    r = rank_within(r, ["plan_id"], ["idx"], "n", t.large)
    e = t.program_edges.join(r.select("plan_id", C("idx").alias("a"), C("n").alias("i")), ["plan_id", "a"]).join(r.select("plan_id", C("idx").alias("b"), C("n").alias("j")), ["plan_id", "b"])
    return e.groupBy("plan_id", "i", "j").agg(F.count(lit(1)).alias("n"))


PAL = [("living_room", 250, 240, 200), ("bedroom", 30, 200, 40), ("kitchen", 200, 30, 30), ("bathroom", 20, 40, 220), ("corridor", 120, 120, 120), ("balcony", 10, 10, 10), ("other", 240, 20, 230)]
CTE["palette"] = "SELECT * FROM (VALUES " + ",".join(f"('{n}',{r},{g},{b},{i})" for i, (n, r, g, b) in enumerate(PAL)) + ") v(label, r, g, b, i)"


@query("conv_label_map", """WITH p AS (SELECT plan_id, idx, pk % 256 AS r, (pk * 7) % 256 AS g, (pk * 13 + idx) % 256 AS b FROM rooms)
  SELECT p.plan_id, p.idx, arg_min(q.label, ((p.r - q.r) ** 2 + (p.g - q.g) ** 2 + (p.b - q.b) ** 2) * 100 + q.i) AS label FROM p, palette q GROUP BY p.plan_id, p.idx""")
def conv_label_map(t):
    px = t.rooms.select("plan_id", "idx", (C("pk") % 256).alias("r"), (C("pk") * 7 % 256).alias("g"), ((C("pk") * 13 + C("idx")) % 256).alias("b"))
    return V.nearest_colour(px, PAL).select("plan_id", "idx", "label")


@query("json_status_counts", """SELECT status, count(*) AS n, CAST(sum(k) AS BIGINT) AS k_total FROM (SELECT CASE WHEN json_valid(text) THEN 'json' WHEN text LIKE '%} done' THEN 'json_prefix' WHEN regexp_matches(text, '\\{[^{}]*\\}') THEN 'repaired' ELSE 'unparseable' END AS status,
  CAST(regexp_extract(text, '([0-9]+)\\}', 1) AS VARCHAR) AS ks, CASE WHEN regexp_matches(text, '\\}') THEN CAST(regexp_extract(text, '([0-9]+)\\}', 1) AS BIGINT) END AS k FROM raw_text) GROUP BY status""")
def json_status_counts(t):
    d = t.raw_text.withColumn("status", V.json_status(C("text")))
    return d.groupBy("status").agg(F.count(lit(1)).alias("n"), F.sum(F.try_variant_get(F.try_parse_json("text"), "$.k", "bigint")).alias("k_total"))


CTE["answers"] = f"""SELECT plan_id, idx, pk, j, {_list(ANSWER_LABELS)}[(pk + j) % {len(ANSWER_LABELS)} + 1] AS label, x0 + 400 * j AS x0, y0, x1 + 400 * j AS x1, y1,
    (pk + j) % 17 = 0 OR (pk + j) % 19 = 0 AS bad, pk % 4 = 0 AS turned, CASE WHEN pk % 13 = 0 OR pk % 29 = 0 THEN 'unparseable' WHEN pk % 7 = 0 THEN 'repaired'
    WHEN pk % 11 = 0 THEN 'json_prefix' ELSE 'json' END AS status FROM (SELECT *, unnest(range(pk % 3 + 1)) AS j FROM rooms)"""


@query("conv_llm_json", """SELECT plan_id, idx, status, CAST(row_number() OVER (PARTITION BY plan_id, idx ORDER BY j) - 1 AS INTEGER) AS k, j::VARCHAR AS id,
  CASE label WHEN 'WC' THEN 'bathroom' WHEN 'Living-Room' THEN 'living_room' ELSE lower(label) END AS type, label AS type_native,
  CASE WHEN turned THEN y0 || ' ' || x0 || ', ' || y0 || ' ' || x1 || ', ' || y1 || ' ' || x1 || ', ' || y1 || ' ' || x0
       ELSE x0 || ' ' || y0 || ', ' || x1 || ' ' || y0 || ', ' || x1 || ' ' || y1 || ', ' || x0 || ' ' || y1 END AS ring FROM answers WHERE NOT bad AND status <> 'unparseable'""")
def conv_llm_json(t):
    """Rooms with proper polygons of every answer, with what kind of text they were read from."""
    p = parse_outputs(t.outputs, C("dataset") == "rows")
    r = output_rooms(p, ["plan_id", "idx", "status"])
    return r.select("plan_id", "idx", "status", "k", "id", "type", "type_native", V.ring_text(C("ring")).alias("ring"))


@query("conv_state", """SELECT s.home, s.storey, count(*) AS n_rooms, CAST(sum((x1 - x0 - 24) * (y1 - y0 - 24)) AS BIGINT) AS net_cm2 FROM storeys s JOIN rooms r ON s.plan_id = r.plan_id GROUP BY ALL""")
def conv_state(t):
    """Net rooms (room minus wall strips) per home and storey."""
    strips = t.rooms.select("plan_id", "idx", F.inline(F.array(
        F.struct("x0", "y0", "x1", (C("y0") + 12).alias("y1")), F.struct("x0", (C("y1") - 12).alias("y0"), "x1", "y1"),
        F.struct("x0", "y0", (C("x0") + 12).alias("x1"), "y1"), F.struct((C("x1") - 12).alias("x0"), "y0", "x1", "y1"))))
    a = set_areas(t.rooms, strips, ["plan_id", "idx"], t.large).select("plan_id", (C("area_ab") - C("area_b")).alias("net"))
    return t.storeys.join(a, "plan_id").groupBy("home", "storey").agg(F.count(lit(1)).alias("n_rooms"), F.sum("net").alias("net_cm2"))


@query("conv_home", """SELECT s.home, s.storey, p.plan_id, p.idx, p.k, round(cos(a) * x - sin(a) * y, 4) + 0.0 AS x, round(sin(a) * x + cos(a) * y, 4) + 0.0 AS y FROM (SELECT *, radians(home % 8 * 15.0) AS a FROM storeys) s JOIN ring_points p ON s.plan_id = p.plan_id""")
def conv_home(t):
    """Rings turned by the home's placement, with the storey of their plan."""
    d = t.storeys.join(t.rings.select("plan_id", "idx", "ring"), "plan_id").withColumn("ring", G.rotate(C("ring"), F.radians(C("home") % 8 * lit(15.0))))
    return d.select("home", "storey", "plan_id", "idx", F.posexplode("ring").alias("k", "p")).select(
        "home", "storey", "plan_id", "idx", C("k").cast("long").alias("k"), (F.round("p.x", 4) + 0.0).alias("x"), (F.round("p.y", 4) + 0.0).alias("y"))


@query("conv_shrink", """SELECT plan_id, CASE WHEN type = 'closet' THEN 0 ELSE idx END AS host, CAST(sum((x1 - x0 - 10) * (y1 - y0 - 10)) AS BIGINT) AS area_cm2, count(*) AS parts FROM rooms GROUP BY plan_id, 2""")
def conv_shrink(t):
    """Centre-line rooms shrunk by half a wall; synthetic stair rooms go back to their host room."""
    r = t.rooms.select("plan_id", F.when(C("type") == "closet", lit(0)).otherwise(C("idx")).alias("host"),
                       (C("x0") + 5).alias("x0"), (C("y0") + 5).alias("y0"), (C("x1") - 5).alias("x1"), (C("y1") - 5).alias("y1"))
    return r.groupBy("plan_id", "host").agg(F.sum((C("x1") - C("x0")) * (C("y1") - C("y0"))).alias("area_cm2"), F.count(lit(1)).alias("parts"))


@query("conv_gap_doors", """SELECT plan_id, idx, g0, g1, CASE WHEN idx = 0 THEN 'front_door' WHEN g1 - g0 > 120 THEN 'opening' ELSE 'interior_door' END AS type FROM wall_gaps""")
def conv_gap_doors(t):
    """Uncovered wall intervals as doors, typed by width and outer wall."""
    g = interval_gaps(cover_pieces(t), ["plan_id", "idx"], 30)
    return g.withColumn("type", F.when(C("idx") == 0, "front_door").when(C("g1") - C("g0") > 120, "opening").otherwise("interior_door"))


@query("objects_footprint", """WITH o AS (SELECT plan_id, idx, radians(pk % 360) AS a, x0, y0, (x1 - x0) / 10 AS w, (y1 - y0) / 10 AS d FROM rooms)
  SELECT plan_id, idx, round(cos(a) * 0 + sin(a) * 0 + x0, 4) AS ax, round(0 * -sin(a) + y0, 4) AS ay, round(cos(a) * w + sin(a) * d + x0, 4) AS cx, round(-sin(a) * w + cos(a) * d + y0, 4) AS cy FROM o""")
def objects_footprint(t):
    a = F.radians(C("pk") % 360)
    z, one = lit(0.0), lit(1.0)
    m = F.array(F.cos(a), z, F.sin(a), C("x0").cast("double"), z, one, z, z, -F.sin(a), z, F.cos(a), C("y0").cast("double"), z, z, z, one)
    b = F.array(z, z, z, (C("x1") - C("x0")) / 10, one, (C("y1") - C("y0")) / 10)
    r = t.rooms.select("plan_id", "idx", V.footprint(m, b).alias("r"))
    return r.select("plan_id", "idx", *[F.round(C("r")[i][c], 4).alias(n) for n, i, c in (("ax", 0, "x"), ("ay", 0, "y"), ("cx", 2, "x"), ("cy", 2, "y"))])


@query("conv_rename_rooms", """WITH a AS (SELECT plan_id, type, idx, row_number() OVER (PARTITION BY plan_id, type ORDER BY (x1 - x0) * (y1 - y0) DESC, idx) AS k FROM gen_rooms), b AS (SELECT plan_id, type, idx, row_number() OVER (PARTITION BY plan_id, type ORDER BY (x1 - x0) * (y1 - y0) DESC, idx) AS k FROM rooms)
  SELECT a.plan_id, a.type, a.idx AS room, b.idx AS program_room FROM a JOIN b ON a.plan_id = b.plan_id AND a.type = b.type AND a.k = b.k""")
def conv_rename_rooms(t):
    f = lambda d: d.select("plan_id", "type", "idx", ((C("x1") - C("x0")) * (C("y1") - C("y0"))).alias("area"))
    return V.rank_match(f(t.gen_rooms), f(t.rooms), ["plan_id", "type"], t.large)


@query("to_metres", "SELECT plan_id, idx, k, round(x * 0.01, 6) AS x, round(y * 0.01, 6) AS y FROM ring_points")
def to_metres(t):
    r = t.rings.withColumn("ring", G.affine(C("ring"), 0.01, 0, 0, 0.01))
    return r.select("plan_id", "idx", F.posexplode("ring").alias("k", "p")).select("plan_id", "idx", C("k").cast("long").alias("k"), F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@query("as_benchmark", "SELECT home AS ref, min(plan_id) AS plan_id FROM plans WHERE plan_id % 5 <> 0 GROUP BY home")
def as_benchmark(t):
    """Records re-keyed by the only reference they name; the first record per reference stays."""
    txt = F.concat(lit("from ref:"), C("home"), lit(" checked ref:"), F.when(C("plan_id") % 5 == 0, C("home") + 1).otherwise(C("home")))
    d = t.plans.select("plan_id", V.single_ref(txt).cast("long").alias("ref")).filter("ref IS NOT NULL")
    return d.groupBy("ref").agg(F.min("plan_id").alias("plan_id"))


@query("common_frame", """SELECT r.plan_id, r.idx, r.x0 - b.sx AS x0, r.y0 - b.sy AS y0, r.x1 - b.sx AS x1, r.y1 - b.sy AS y1 FROM rooms r JOIN (SELECT plan_id, (min(x0) + max(x1)) / 2 - 128.0::DOUBLE AS sx, (min(y0) + max(y1)) / 2 - 128.0::DOUBLE AS sy FROM rooms GROUP BY plan_id) b ON r.plan_id = b.plan_id""")
def common_frame(t):
    return V.centred(t.rooms)


@query("conv_scene_rooms", """SELECT d.plan_id, d.k, d.type, (x1 - x0)::BIGINT AS w, s.storey FROM doors d JOIN storeys s ON d.plan_id = s.plan_id WHERE NOT (d.type = 'front_door' AND s.storey > 0)""")
def conv_scene_rooms(t):
    """Door rectangles of scenes; upper storeys get no exterior door."""
    d = t.doors.join(t.storeys.select("plan_id", "storey"), "plan_id").filter(~((C("type") == "front_door") & (C("storey") > 0)))
    return d.select("plan_id", "k", "type", (C("x1") - C("x0")).alias("w"), "storey")


@query("gt_fallback", """WITH b AS (SELECT plan_id, min(x0) AS bx, min(y0) AS by_, max(x1) - min(x0) AS bw, max(y1) - min(y0) AS bh FROM rooms GROUP BY plan_id)
  SELECT r.plan_id, r.idx, CASE WHEN r.plan_id % 3 = 0 THEN r.x0::DOUBLE ELSE round(bx + floor((r.x0 - bx) * 20.0 / bw) * bw / 20.0, 6) END AS x0, CASE WHEN r.plan_id % 3 = 0 THEN r.y0::DOUBLE ELSE round(by_ + floor((r.y0 - by_) * 20.0 / bh) * bh / 20.0, 6) END AS y0, r.plan_id % 3 = 0 AS exact FROM rooms r JOIN b ON r.plan_id = b.plan_id""")
def gt_fallback(t):
    """The exact record when there is one, else boxes from a 20-level grid over the plan's box."""
    b = t.rooms.groupBy("plan_id").agg(F.min("x0").alias("bx"), F.min("y0").alias("by"), (F.max("x1") - F.min("x0")).alias("bw"), (F.max("y1") - F.min("y0")).alias("bh"))
    exact = t.rooms.filter("plan_id % 3 = 0").select("plan_id", "idx", C("x0").cast("double").alias("ex"), C("y0").cast("double").alias("ey"))
    d = t.rooms.join(b, "plan_id").join(exact, ["plan_id", "idx"], "left")
    gx = C("bx") + F.floor((C("x0") - C("bx")) * 20.0 / C("bw")) * C("bw") / 20.0
    gy = C("by") + F.floor((C("y0") - C("by")) * 20.0 / C("bh")) * C("bh") / 20.0
    return d.select("plan_id", "idx", F.coalesce("ex", F.round(gx, 6)).alias("x0"), F.coalesce("ey", F.round(gy, 6)).alias("y0"), C("ex").isNotNull().alias("exact"))


CTE["list_lines"] = """SELECT plan_id, idx, k, x0 = x1 AS v, CASE WHEN x0 = x1 THEN x0 ELSE y0 END AS line, CASE WHEN x0 = x1 THEN least(y0, y1) ELSE least(x0, x1) END AS lo,
    CASE WHEN x0 = x1 THEN greatest(y0, y1) ELSE greatest(x0, x1) END AS hi FROM ring_edges"""
CTE["list_segments"] = """SELECT plan_id, idx, k, v, line, a, b FROM (SELECT *, lead(a) OVER (PARTITION BY plan_id, idx, k ORDER BY a) AS b FROM (
    SELECT plan_id, idx, k, v, line, lo AS a FROM list_lines UNION SELECT plan_id, idx, k, v, line, hi FROM list_lines UNION
    SELECT e.plan_id, e.idx, e.k, v, line, CASE WHEN v THEN c.y0 ELSE c.x0 END FROM list_lines e JOIN ring_edges c ON e.plan_id = c.plan_id AND c.idx <> e.idx
      AND (CASE WHEN v THEN c.x0 ELSE c.y0 END) = line AND (CASE WHEN v THEN c.y0 ELSE c.x0 END) > lo AND (CASE WHEN v THEN c.y0 ELSE c.x0 END) < hi)) WHERE b IS NOT NULL"""
CTE["list_other"] = """SELECT plan_id, idx, k, a, min(o) AS other FROM (SELECT s.plan_id, s.idx, s.k, s.a, s.b, l.idx AS o, sum(least(s.b, l.hi) - greatest(s.a, l.lo)) AS c FROM list_segments s
    JOIN list_lines l ON s.plan_id = l.plan_id AND s.v = l.v AND s.line = l.line AND s.idx <> l.idx AND least(s.b, l.hi) > greatest(s.a, l.lo)
    JOIN shared_best h ON h.plan_id = s.plan_id AND h.i = least(s.idx, l.idx) AND h.j = greatest(s.idx, l.idx) AND h.len >= 20 GROUP BY ALL) WHERE 2 * c > b - a GROUP BY ALL"""
CTE["list_doors"] = """SELECT plan_id, n + row_number() OVER (PARTITION BY plan_id ORDER BY idx) - 1 AS node, type, x0, y0, x1, y1, first, second FROM (
    SELECT plan_id, 'interior_door' AS type, idx, x0, y0, x1, y1, idx AS first, nb AS second FROM synth_list
    UNION ALL SELECT d.plan_id, 'front_door', 1099511627776, d.x0::DOUBLE, d.y0::DOUBLE, d.x1::DOUBLE, d.y1::DOUBLE, f.seed, f.seed FROM doors d JOIN front_room f USING (plan_id) WHERE d.type = 'front_door')
  JOIN (SELECT plan_id, count(*) AS n FROM rooms GROUP BY plan_id) USING (plan_id)"""
CTE["synth_list"] = SQL["synth_doors"]


@query("edge_list_export", """WITH e AS (SELECT s.plan_id, s.idx AS node, r.type, row_number() OVER (PARTITION BY s.plan_id, s.idx ORDER BY s.k, s.a) AS k, (CASE WHEN v THEN line ELSE s.a END)::DOUBLE AS x0,
      (CASE WHEN v THEN s.a ELSE line END)::DOUBLE AS y0, (CASE WHEN v THEN line ELSE s.b END)::DOUBLE AS x1, (CASE WHEN v THEN s.b ELSE line END)::DOUBLE AS y1, o.other
    FROM list_segments s JOIN rooms r USING (plan_id, idx) LEFT JOIN list_other o ON o.plan_id = s.plan_id AND o.idx = s.idx AND o.k = s.k AND o.a = s.a
    UNION ALL SELECT plan_id, node, type, 1, x0, y0, x0, y1, CASE WHEN y1 - y0 > x1 - x0 THEN first END FROM list_doors
    UNION ALL SELECT plan_id, node, type, 2, x0, y1, x1, y1, CASE WHEN y1 - y0 <= x1 - x0 THEN first END FROM list_doors
    UNION ALL SELECT plan_id, node, type, 3, x1, y1, x1, y0, CASE WHEN y1 - y0 > x1 - x0 THEN second END FROM list_doors
    UNION ALL SELECT plan_id, node, type, 4, x1, y0, x0, y0, CASE WHEN y1 - y0 <= x1 - x0 THEN second END FROM list_doors)
  SELECT e.plan_id, node, e.type, CAST(k AS INTEGER) AS k, e.x0, e.y0, e.x1, e.y1, other, r.type AS other_type FROM e LEFT JOIN rooms r ON r.plan_id = e.plan_id AND r.idx = e.other""")
def edge_list_export(t):
    """All edges of rooms and doors with the nodes on both sides; doors are nodes behind the rooms."""
    hit = door_hits(t.doors.filter("type = 'front_door'"), t.rooms, 30, t.large).groupBy("plan_id").agg(F.max_by("idx", F.struct("area", "idx")).alias("room"))
    front = t.doors.filter("type = 'front_door'").join(hit.hint("merge"), "plan_id")
    return edge_lists.edge_list(t.rooms, t.ring_edges, kept_rows(openings.shared_boundary(t.ring_edges), ["plan_id"], t.dealt), front)
