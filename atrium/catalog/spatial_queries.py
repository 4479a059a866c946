"""Spatial operators and spatial joins."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import spatial as S
from ..plans import openings as O
from ..plans import shape as P
from ..plans.rules import room_attributes
from ..session import checkpointed, kept_rows
from .base import CTE, comp_sql, query, slab_sql  # noqa: F401

C, lit = F.col, F.lit


def closed(t):
    """Closed plans, written once: several steps below read them."""
    return kept_rows(S.closing(t.rooms, ["plan_id"], 30, t.large), ["plan_id"], t.dealt)


@query("union_area", """SELECT u.plan_id, union_cm2, round((s.a - union_cm2)::DOUBLE / union_cm2, 9) AS overlap_ratio FROM plan_union u
  JOIN (SELECT plan_id, sum((x1 - x0) * (y1 - y0)) AS a FROM rooms GROUP BY plan_id) s ON u.plan_id = s.plan_id""")
def union_area(t):
    return P.overlap_ratio(t.rooms, t.large).select("plan_id", "union_cm2", F.round("overlap_ratio", 9).alias("overlap_ratio"))


CTE["closed_rows_once"] = "SELECT plan_id, x0 + 30 AS x0, x1 - 30 AS x1, y0, y1 FROM (" + slab_sql("grown_rooms", "y", once=True) + ") WHERE x1 - x0 > 60"
CTE["closed_once"] = "SELECT plan_id, x0, x1, y0 + 30 AS y0, y1 - 30 AS y1 FROM (" + slab_sql("closed_rows_once", "x", once=True) + ") WHERE y1 - y0 > 60"


@query("buffer_closing", "SELECT plan_id, x0, y0, x1, y1 FROM closed_once")
def buffer_closing(t):
    return closed(t) if t.large is None else S.whole_columns(closed(t), t.rooms, ["plan_id"], 30, t.large)


@query("hole_ratio", "SELECT plan_id, closed_cm2, hole_cm2, round(hole_cm2::DOUBLE / (closed_cm2 + hole_cm2), 9) AS hole_ratio FROM plan_holes")
def hole_ratio(t):
    return P.hole_ratio(closed(t), t.large, t.dealt).withColumn("hole_ratio", F.round("hole_ratio", 9))


@query("plan_components", "SELECT plan_id, count(DISTINCT comp) AS n_components FROM closed_comp GROUP BY plan_id")
def plan_components(t):
    return P.plan_pieces(closed(t), t.large, t.dealt)


CTE["outer_area"] = """WITH c AS (SELECT r.plan_id, r.x0, r.y0, r.x1, r.y1, b.x0 - 30 AS bx0, b.y0 - 30 AS by0, b.x1 + 30 AS bx1, b.y1 + 30 AS by1
    FROM rooms r JOIN boundary b ON r.plan_id = b.plan_id),
  k AS (SELECT plan_id, greatest(x0, bx0) AS x0, greatest(y0, by0) AS y0, least(x1, bx1) AS x1, least(y1, by1) AS y1 FROM c),
  xs AS (SELECT plan_id, x0 AS x FROM k UNION SELECT plan_id, x1 FROM k), ys AS (SELECT plan_id, y0 AS y FROM k UNION SELECT plan_id, y1 FROM k),
  sx AS (SELECT plan_id, x AS a, lead(x) OVER (PARTITION BY plan_id ORDER BY x) AS b FROM xs),
  sy AS (SELECT plan_id, y AS c, lead(y) OVER (PARTITION BY plan_id ORDER BY y) AS e FROM ys),
  cov AS (SELECT DISTINCT sx.plan_id, a, b, c, e FROM sx JOIN sy ON sx.plan_id = sy.plan_id JOIN k ON k.plan_id = sx.plan_id
    AND k.x0 <= a AND k.x1 >= b AND k.y0 <= c AND k.y1 >= e)
  SELECT plan_id, sum((b - a) * (e - c)) AS inner_cm2 FROM cov GROUP BY plan_id"""


@query("boundary_cover", """SELECT b.plan_id, round(coalesce(i.a, 0)::DOUBLE / ((b.x1 - b.x0) * (b.y1 - b.y0)), 9) AS boundary_coverage,
    round((u.union_cm2 - o.inner_cm2)::DOUBLE / u.union_cm2, 9) AS outside_boundary_ratio
  FROM boundary b JOIN plan_union u ON b.plan_id = u.plan_id JOIN outer_area o ON b.plan_id = o.plan_id
  LEFT JOIN (SELECT c.plan_id, sum((least(c.x1, b.x1) - greatest(c.x0, b.x0)) * (least(c.y1, b.y1) - greatest(c.y0, b.y0))) AS a
    FROM closed_plan c JOIN boundary b ON c.plan_id = b.plan_id WHERE least(c.x1, b.x1) > greatest(c.x0, b.x0)
      AND least(c.y1, b.y1) > greatest(c.y0, b.y0) GROUP BY c.plan_id) i ON b.plan_id = i.plan_id""")
def boundary_cover(t):
    d = P.boundary_cover(t.rooms, closed(t), t.boundary, 30, t.large)
    return d.select("plan_id", *[F.round(c, 9).alias(c) for c in d.columns[1:]])


CTE["typed_rooms"] = "SELECT plan_id, type, x0, y0, x1, y1 FROM rooms"


@query("type_union", f"SELECT plan_id, type, CAST(sum((x1 - x0) * (y1 - y0)) AS BIGINT) AS area_cm2 FROM ({slab_sql('typed_rooms', 'y', 'plan_id, type')}) GROUP BY plan_id, type")
def type_union(t):
    return S.union_area(t.rooms, ["plan_id", "type"], t.large, "area_cm2")


@query("difference", """WITH s AS (SELECT r.plan_id, r.idx, least(r.x1 - 12, r.x1) - (r.x0 + 12) AS w, (r.y1 - 12) - (r.y0 + 12) AS h, r.* FROM rooms r)
  SELECT plan_id, idx, CAST(w * h AS BIGINT) AS net_cm2, CAST((x1 - x0) * (y1 - y0) - w * h AS BIGINT) AS wall_cm2 FROM s""")
def difference(t):
    """Rooms minus the wall strips along their four edges (12 cm inside), through the two-sided union area."""
    strips = t.rooms.select("plan_id", "idx", F.inline(F.array(
        F.struct("x0", "y0", "x1", (C("y0") + 12).alias("y1")), F.struct("x0", (C("y1") - 12).alias("y0"), "x1", "y1"),
        F.struct("x0", "y0", (C("x0") + 12).alias("x1"), "y1"), F.struct((C("x1") - 12).alias("x0"), "y0", "x1", "y1"))))
    a = P.set_areas(t.rooms, strips, ["plan_id", "idx"], t.large)
    return a.select("plan_id", "idx", (C("area_ab") - C("area_b")).alias("net_cm2"), C("area_b").alias("wall_cm2"))


CTE["iou_sides"] = """SELECT plan_id, type, 'a' AS side, x0, y0, x1, y1 FROM gen_rooms UNION ALL SELECT plan_id, type, 'ab', x0, y0, x1, y1 FROM gen_rooms
  UNION ALL SELECT plan_id, type, 'b', x0, y0, x1, y1 FROM rooms UNION ALL SELECT plan_id, type, 'ab', x0, y0, x1, y1 FROM rooms"""


@query("type_iou", f"""WITH u AS (SELECT plan_id, type, side, sum((x1 - x0) * (y1 - y0)) AS area FROM ({slab_sql('iou_sides', 'y', 'plan_id, type, side')}) GROUP BY ALL),
  p AS (SELECT plan_id, type, coalesce(max(area) FILTER (side = 'a'), 0) AS a, coalesce(max(area) FILTER (side = 'b'), 0) AS b,
        max(area) FILTER (side = 'ab') AS ab FROM u GROUP BY ALL)
  SELECT plan_id, round(avg((a + b - ab)::DOUBLE / ab), 9) AS type_iou FROM p GROUP BY plan_id""")
def type_iou(t):
    return P.type_iou(t.gen_rooms, t.rooms, t.large).withColumn("type_iou", F.round("type_iou", 9))


@query("dominant_orientation", """SELECT r.plan_id, round(0.25 * atan2(sum(len * sin(4 * (ang + a))), sum(len * cos(4 * (ang + a)))), 6) + 0.0 AS theta
  FROM ring_segs s JOIN (SELECT plan_id, idx, radians(plan_id % 7 * 5.0) AS a FROM rooms) r ON s.plan_id = r.plan_id AND s.idx = r.idx GROUP BY r.plan_id""")
def dominant_orientation(t):
    """Plans turned by a known angle first, so the dominant direction is not trivially zero."""
    return orientation(turned(t)).select("plan_id", (F.round("theta", 6) + 0.0).alias("theta"))


def turned(t):
    r = t.rings.withColumn("ring", G.rotate(C("ring"), F.radians(C("plan_id") % 7 * lit(5.0))))
    e = r.select("plan_id", "idx", "type", F.inline(G.edges_of(C("ring"))))
    return e.select("plan_id", "idx", "type", (C("x1") - C("x0")).alias("dx"), (C("y1") - C("y0")).alias("dy")).withColumn(
        "len", G.edge_length(C("dx"), C("dy"))).withColumn("ang", F.atan2("dy", "dx"))


def orientation(edges):
    return edges.groupBy("plan_id").agg((0.25 * F.atan2(F.sum(C("len") * F.sin(4 * C("ang"))), F.sum(
        C("len") * F.cos(4 * C("ang"))))).alias("theta"))


@query("rectilinear_fraction", """WITH o AS (SELECT s.plan_id, s.idx, len, ang + radians(s.plan_id % 7 * 5.0) AS ang FROM ring_segs s),
  th AS (SELECT plan_id, 0.25 * atan2(sum(len * sin(4 * ang)), sum(len * cos(4 * ang))) AS theta FROM o GROUP BY plan_id),
  d AS (SELECT o.plan_id, o.idx, len, (((degrees(ang - theta) % 90) + 90) % 90) AS m FROM o JOIN th ON o.plan_id = th.plan_id WHERE len >= 25)
  SELECT plan_id, idx, round(coalesce(sum(len) FILTER (m < 5 OR m > 85), 0) / sum(len), 6) AS rectilinear FROM d GROUP BY plan_id, idx""")
def rectilinear_fraction(t):
    return rectilinear(turned(t), 25.0).withColumn("rectilinear", F.round("rectilinear", 6))


def rectilinear(edges, min_edge, tol_deg=5.0):
    """Share of a room's perimeter within the tolerance of the plan's axes; short edges are ignored."""
    d = edges.join(orientation(edges), "plan_id")
    m = F.pmod(F.degrees(C("ang") - C("theta")), lit(90.0))
    ok = (m < tol_deg) | (m > 90 - tol_deg)
    long_ = C("len") >= min_edge
    tot = F.sum(F.when(long_, C("len")))
    return d.groupBy("plan_id", "idx").agg(F.coalesce(F.coalesce(F.sum(F.when(long_ & ok, C("len"))), lit(0.0)) / tot, lit(1.0)).alias("rectilinear"))


@query("wall_adjacency", "SELECT plan_id, i, j FROM adj")
def wall_adjacency(t):
    return t.adj


@query("door_edges", "SELECT plan_id, k, i, j FROM door_edges")
def door_edges(t):
    return t.door_edges


CTE["shared_best"] = """WITH e AS (SELECT plan_id, idx, x0 = x1 AS vertical, CASE WHEN x0 = x1 THEN x0 ELSE y0 END AS line,
      CASE WHEN x0 = x1 THEN least(y0, y1) ELSE least(x0, x1) END AS lo, CASE WHEN x0 = x1 THEN greatest(y0, y1) ELSE greatest(x0, x1) END AS hi FROM ring_edges),
  d AS (SELECT a.plan_id, a.idx AS i, b.idx AS j, a.vertical, a.line, greatest(a.lo, b.lo) AS a, least(a.hi, b.hi) AS b
    FROM e a JOIN e b ON a.plan_id = b.plan_id AND a.vertical = b.vertical AND a.line = b.line AND a.idx < b.idx AND least(a.hi, b.hi) > greatest(a.lo, b.lo))
  SELECT plan_id, i, j, b - a AS len, vertical, line, a, b FROM (SELECT *, row_number() OVER (PARTITION BY plan_id, i, j
    ORDER BY b - a DESC, vertical DESC, line DESC, a DESC) AS rn FROM d) WHERE rn = 1"""


@query("shared_boundary", "SELECT * FROM shared_best")
def shared_boundary(t):
    return O.shared_boundary(t.ring_edges)


@query("synth_doors", """WITH b AS (SELECT plan_id, i AS idx, j AS nb, len, vertical, line, a, b FROM shared_best WHERE len >= 20
    UNION ALL SELECT plan_id, j, i, len, vertical, line, a, b FROM shared_best WHERE len >= 20),
  c AS (SELECT b.*, row_number() OVER (PARTITION BY b.plan_id, b.idx ORDER BY CASE n.type WHEN 'living_room' THEN 0 WHEN 'dining_room' THEN 1
      WHEN 'entrance' THEN 2 ELSE 9 END, len DESC, nb, vertical, line, a) AS rn, least(90, greatest(b.b - b.a - 20, 20)) AS ln, (b.a + b.b) / 2 AS mid
    FROM b JOIN rooms r ON r.plan_id = b.plan_id AND r.idx = b.idx AND r.type <> 'living_room'
    JOIN rooms n ON n.plan_id = b.plan_id AND n.idx = b.nb)
  SELECT plan_id, idx, nb, (CASE WHEN vertical THEN line - 5 ELSE mid - ln / 2 END)::DOUBLE AS x0, (CASE WHEN vertical THEN mid - ln / 2 ELSE line - 5 END)::DOUBLE AS y0,
    (CASE WHEN vertical THEN line + 5 ELSE mid + ln / 2 END)::DOUBLE AS x1, (CASE WHEN vertical THEN mid + ln / 2 ELSE line + 5 END)::DOUBLE AS y1 FROM c WHERE rn = 1""")
def synth_doors(t):
    d = O.synth_doors(O.shared_boundary(t.ring_edges), t.rooms)
    return d.select("plan_id", "idx", "nb", *[C(c).cast("double").alias(c) for c in S.BOX])


@query("split_segments", """WITH e AS (SELECT plan_id, idx, k, x0 = x1 AS v, CASE WHEN x0 = x1 THEN x0 ELSE y0 END AS line,
    CASE WHEN x0 = x1 THEN y0 ELSE x0 END AS s, CASE WHEN x0 = x1 THEN y1 ELSE x1 END AS t FROM ring_edges),
  p AS (SELECT plan_id, idx, k, s AS pt FROM e UNION SELECT plan_id, idx, k, t FROM e UNION
    SELECT e.plan_id, e.idx, e.k, CASE WHEN v THEN c.y0 ELSE c.x0 END FROM e JOIN ring_edges c ON e.plan_id = c.plan_id AND c.idx <> e.idx
      AND (CASE WHEN v THEN c.x0 ELSE c.y0 END) = line AND (CASE WHEN v THEN c.y0 ELSE c.x0 END) > least(s, t) AND (CASE WHEN v THEN c.y0 ELSE c.x0 END) < greatest(s, t))
  SELECT plan_id, idx, k, pt AS a, b FROM (SELECT *, lead(pt) OVER (PARTITION BY plan_id, idx, k ORDER BY pt) AS b FROM p) WHERE b IS NOT NULL""")
def split_segments(t):
    corners = t.ring_edges.select("plan_id", "idx", C("x0").alias("x"), C("y0").alias("y"))
    return O.split_segments(t.ring_edges, corners)


@query("opening_slice", """WITH w AS (SELECT r.plan_id, r.idx, atan2((r.y1 - r.y0)::DOUBLE, (r.x1 - r.x0)::DOUBLE) AS a, r.x0, r.y0, v.width_cm AS width FROM rooms r
    JOIN windows v ON r.plan_id = v.plan_id AND r.idx = v.room)
  SELECT plan_id, idx, round(x0 + cos(a) * 20 - sin(a) * 6, 4) AS ax, round(y0 + sin(a) * 20 + cos(a) * 6, 4) AS ay,
    round(x0 + cos(a) * (20 + width) + sin(a) * 6, 4) AS cx, round(y0 + sin(a) * (20 + width) - cos(a) * 6, 4) AS cy FROM w""")
def opening_slice(t):
    w = t.rooms.join(t.windows.select("plan_id", C("room").alias("idx"), "width_cm"), ["plan_id", "idx"])
    r = O.opening_slice(*[C(c).cast("double") for c in S.BOX], lit(20.0), C("width_cm"), lit(12.0))
    w = w.withColumn("r", r)
    return w.select("plan_id", "idx", F.round(C("r")[0]["x"], 4).alias("ax"), F.round(C("r")[0]["y"], 4).alias("ay"),
                    F.round(C("r")[2]["x"], 4).alias("cx"), F.round(C("r")[2]["y"], 4).alias("cy"))


@query("room_facts", """SELECT plan_id, idx, type_canonical AS type, area_cm2 / 10000 AS area_m2, width_cm / 100 AS width_m, depth_cm / 100 AS depth_m FROM room_attrs""")
def room_facts(t):
    r = room_attributes(t.rooms)
    return r.select("plan_id", "idx", "type", (C("area_cm2") / 10000).alias("area_m2"), (C("width_cm") / 100).alias("width_m"),
                    (C("depth_cm") / 100).alias("depth_m"))


CTE["filled_plan"] = "SELECT plan_id, x0, y0, x1, y1 FROM closed_plan UNION ALL SELECT plan_id, x0, y0, x1, y1 FROM hole_parts"


@query("outline_shape", """WITH a AS (SELECT plan_id, sum((x1 - x0) * (y1 - y0))::DOUBLE / ((max(x1) - min(x0)) * (max(y1) - min(y0))) AS r FROM filled_plan GROUP BY plan_id),
  c AS (SELECT plan_id, x0 AS x, y0 AS y, 1 AS s FROM filled_plan UNION ALL SELECT plan_id, x1, y0, -1 FROM filled_plan
        UNION ALL SELECT plan_id, x1, y1, 1 FROM filled_plan UNION ALL SELECT plan_id, x0, y1, -1 FROM filled_plan),
  n AS (SELECT plan_id, CAST(sum(abs(s)) AS BIGINT) AS k FROM (SELECT plan_id, x, y, sum(s) AS s FROM c GROUP BY ALL) GROUP BY plan_id)
  SELECT a.plan_id, round(r, 9) AS outline_rectangularity, k AS outline_corners FROM a JOIN n ON a.plan_id = n.plan_id""")
def outline_shape(t):
    return P.outline_shape(closed(t), t.large, t.dealt).withColumn("outline_rectangularity", F.round("outline_rectangularity", 9))


CTE["window_hit"] = """SELECT r.plan_id, r.idx, max(CASE WHEN w.x0 - 30 <= r.x1 AND w.x1 + 30 >= r.x0 AND w.y0 - 30 <= r.y1 AND w.y1 + 30 >= r.y0 THEN 1 ELSE 0 END) AS hit
  FROM rooms r LEFT JOIN windows w ON r.plan_id = w.plan_id WHERE r.type IN ('living_room','kitchen','bedroom','dining_room','study') GROUP BY ALL"""


@query("window_touch", "SELECT plan_id, round(avg(hit), 9) AS frac_habitable_with_window FROM window_hit GROUP BY plan_id")
def window_touch(t):
    d = O.window_touch(t.windows, t.rooms, 30, t.large)
    return d.select("plan_id", F.round(d.columns[1], 9).alias(d.columns[1]))


@query("pair_overlap_sum", """SELECT a.plan_id, CAST(sum((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0))) AS BIGINT) AS overlap_cm2
  FROM rooms a JOIN rooms b ON a.plan_id = b.plan_id AND a.idx < b.idx AND least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0) GROUP BY a.plan_id""")
def pair_overlap_sum(t):
    return O.pair_overlap(t.rooms, t.large)


# ---- spatial joins ----

@query("spatial_self_join", """SELECT a.plan_id, a.idx AS i, b.idx AS j FROM rooms a JOIN rooms b ON a.plan_id = b.plan_id AND a.idx < b.idx
  AND a.x0 - 30 <= b.x1 + 30 AND a.x1 + 30 >= b.x0 - 30 AND a.y0 - 30 <= b.y1 + 30 AND a.y1 + 30 >= b.y0 - 30""")
def spatial_self_join(t):
    d = S.overlap_join(S.side(t.rooms, "a", ["idx"]), S.side(t.rooms, "b", ["idx"]), 30, 30, t.large, C("aidx") < C("bidx"), touch=True)
    return d.select("plan_id", C("aidx").alias("i"), C("bidx").alias("j"))


@query("spatial_probe", "SELECT plan_id, k, idx, area FROM door_hits")
def spatial_probe(t):
    return S.door_hits(t.doors, t.rooms, 30, t.large).select("plan_id", "k", "idx", "area")


@query("within_distance", """WITH p AS (SELECT a.plan_id, a.k AS i, b.k AS j, greatest(0, greatest(a.x0, b.x0) - least(a.x1, b.x1)) AS dx,
    greatest(0, greatest(a.y0, b.y0) - least(a.y1, b.y1)) AS dy FROM doors a JOIN doors b ON a.plan_id = b.plan_id AND a.k < b.k)
  SELECT plan_id, i, j, round(sqrt(dx * dx + dy * dy), 6) AS dist FROM p WHERE dx * dx + dy * dy <= 300 * 300""")
def within_distance(t):
    d = S.overlap_join(S.side(t.doors, "a", ["k"]), S.side(t.doors, "b", ["k"]), 300, 0, t.large, C("ak") < C("bk"), touch=True)
    dx = F.greatest(lit(0), F.greatest("ax0", "bx0") - F.least("ax1", "bx1"))
    dy = F.greatest(lit(0), F.greatest("ay0", "by0") - F.least("ay1", "by1"))
    d = d.withColumn("dist", F.round(F.sqrt(dx * dx + dy * dy), 6)).filter(dx * dx + dy * dy <= 300 * 300)
    return d.select("plan_id", C("ak").alias("i"), C("bk").alias("j"), "dist")
