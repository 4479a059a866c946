"""Overlay of rings of any shape: rooms with notches and slants instead of boxes."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import overlay as V
from ..operators import spatial as S
from ..plans import outlines as P
from ..plans import walls
from ..session import checkpointed, stacked
from .base import CTE, SQL, query
from .distribution_queries import shapes
from .spatial_queries import rectilinear, turned

C, lit = F.col, F.lit

CTE["ring_sides"] = """SELECT plan_id, idx, CASE WHEN x < nx THEN x ELSE nx END AS ex0, CASE WHEN x < nx THEN y ELSE ny END AS ey0,
    CASE WHEN x < nx THEN nx ELSE x END AS ex1, CASE WHEN x < nx THEN ny ELSE y END AS ey1, CASE WHEN x < nx THEN 1 ELSE -1 END AS w
  FROM (SELECT plan_id, idx, x, y, coalesce(lead(x) OVER r, first_value(x) OVER r) AS nx, coalesce(lead(y) OVER r, first_value(y) OVER r) AS ny
        FROM ring_points WINDOW r AS (PARTITION BY plan_id, idx ORDER BY k)) WHERE x <> nx"""


def sweep_sql(src: str, keys: str, sides: str = "a") -> str:
    """Cells of a slab sweep over ``src`` (keys, side, ex0, ey0, ex1, ey1, w): area and n_<side>."""
    ks = keys.split(", ")
    on = " AND ".join(f"a.{k} = b.{k}" for k in ks)
    at = "{e}.ey0 + ({x} - {e}.ex0) * ({e}.ey1 - {e}.ey0) / ({e}.ex1 - {e}.ex0)"
    counts = ", ".join(f"sum(CASE WHEN side = '{s}' THEN w ELSE 0 END) OVER (PARTITION BY {keys}, xl ORDER BY ym, yl ROWS UNBOUNDED PRECEDING) AS n_{s}" for s in sides)
    return f"""SELECT *, (zm - ym) * (xr - xl) AS area FROM (SELECT {keys}, xl, xr, ym, lead(ym) OVER (PARTITION BY {keys}, xl ORDER BY ym, yl) AS zm, {counts}
    FROM (SELECT {', '.join('a.' + k for k in ks)}, a.side, a.w, b.xl, b.xr, {at.format(e='a', x='((b.xl + b.xr) / 2)')} AS ym, {at.format(e='a', x='b.xl')} AS yl FROM {src} a JOIN (
      SELECT {keys}, x AS xl, lead(x) OVER (PARTITION BY {keys} ORDER BY x) AS xr FROM (SELECT {keys}, ex0 AS x FROM {src} UNION SELECT {keys}, ex1 FROM {src} UNION
        SELECT {keys}, l + (r - l) * dl / (dl - dr) FROM (SELECT *, {at.format(e='a', x='l')} - ({at.format(e='b', x='l')}) AS dl, {at.format(e='a', x='r')} - ({at.format(e='b', x='r')}) AS dr
          FROM (SELECT {', '.join('a.' + k for k in ks)}, a, b, greatest(a.ex0, b.ex0) AS l, least(a.ex1, b.ex1) AS r FROM {src} a JOIN {src} b ON {on} AND a.ex0 < b.ex1 AND b.ex0 < a.ex1)) WHERE dl * dr < 0)) b
      ON {on} AND b.xr IS NOT NULL AND a.ex0 <= b.xl AND a.ex1 >= b.xr)) WHERE zm IS NOT NULL"""


CTE["plan_sides"] = "SELECT plan_id, 'a' AS side, ex0, ey0, ex1, ey1, w FROM ring_sides"
CTE["plan_cells"] = sweep_sql("plan_sides", "plan_id")
CTE["typed_sides"] = """SELECT s.plan_id, r.type, 'b' AS side, ex0, ey0, ex1, ey1, w FROM ring_sides s JOIN rooms r USING (plan_id, idx)
  UNION ALL SELECT s.plan_id, r.type, 'a', ex0, ey0, ex1, ey1, w FROM ring_sides s JOIN gen_rooms r USING (plan_id, idx)"""
CTE["typed_cells"] = sweep_sql("typed_sides", "plan_id, type", "ab")
CTE["gen_cells"] = sweep_sql("typed_sides", "plan_id", "ab")


def gen_rings(t):
    """Rings of the generated rooms: those of the plan under the generated types."""
    return t.gen_rooms.select("plan_id", "idx", "type").join(t.rings.select("plan_id", "idx", "ring"), ["plan_id", "idx"])


@query("union_area_rings", """SELECT c.plan_id, round(u, 3) AS union_cm2, round((s - u) / u, 8) AS overlap_ratio
  FROM (SELECT plan_id, sum(area) FILTER (n_a > 0) AS u FROM plan_cells GROUP BY plan_id) c
  JOIN (SELECT plan_id, sum(area * n_a) AS s FROM plan_cells GROUP BY plan_id) d USING (plan_id)""")
def union_area_rings(t):
    d = P.overlap_ratio(t.rings)
    return d.select("plan_id", F.round("union_cm2", 3).alias("union_cm2"), F.round("overlap_ratio", 8).alias("overlap_ratio"))


@query("pair_overlap_rings", "SELECT plan_id, round(sum(area * n_a * (n_a - 1) / 2), 3) + 0.0 AS overlap_cm2 FROM plan_cells GROUP BY plan_id")
def pair_overlap_rings(t):
    return V.pair_overlap(t.rings, ["plan_id"], t.dealt).select("plan_id", (F.round("overlap", 3) + 0.0).alias("overlap_cm2"))


@query("type_union_rings", "SELECT plan_id, type, round(sum(area) FILTER (n_b > 0), 3) AS area_cm2 FROM typed_cells GROUP BY ALL HAVING area_cm2 IS NOT NULL")
def type_union_rings(t):
    return V.union_area(t.rings, ["plan_id", "type"], "area_cm2", t.dealt).withColumn("area_cm2", F.round("area_cm2", 3))


@query("difference_rings", """SELECT plan_id, round(coalesce(sum(area) FILTER (n_b > 0 AND n_a = 0), 0), 3) AS missing_cm2, round(coalesce(sum(area) FILTER (n_a > 0 AND n_b > 0), 0), 3) AS kept_cm2
  FROM gen_cells GROUP BY plan_id""")
def difference_rings(t):
    """Area of the plan that no generated room covers, and what both cover."""
    a = V.set_areas(V.ring_edges(gen_rings(t), ["plan_id"], "a"), V.ring_edges(t.rings, ["plan_id"], "b"), ["plan_id"], t.dealt)
    return a.select("plan_id", (F.round(C("area_b") - C("both"), 3) + 0.0).alias("missing_cm2"), F.round("both", 3).alias("kept_cm2"))


@query("type_iou_rings", """SELECT plan_id, round(avg(iou), 8) AS type_iou FROM (SELECT plan_id, type,
    coalesce(sum(area) FILTER (n_a > 0 AND n_b > 0), 0) / sum(area) FILTER (n_a > 0 OR n_b > 0) AS iou FROM typed_cells GROUP BY ALL) GROUP BY plan_id""")
def type_iou_rings(t):
    return P.type_iou(gen_rings(t), t.rings, t.dealt).withColumn("type_iou", F.round("type_iou", 8))


CTE["door_sides"] = """SELECT c.plan_id, c.k, c.idx, 'a' AS side, ex0, ey0, ex1, ey1, w FROM ring_sides s
    JOIN (SELECT * FROM door_hits WHERE door_type <> 'front_door') c ON s.plan_id = c.plan_id AND s.idx = c.idx
  UNION ALL SELECT h.plan_id, h.k, h.idx, 'b', d.x0 - 30, d.y0 - 30, d.x1 + 30, d.y0 - 30, 1 FROM door_hits h JOIN doors d USING (plan_id, k) WHERE d.type <> 'front_door'
  UNION ALL SELECT h.plan_id, h.k, h.idx, 'b', d.x0 - 30, d.y1 + 30, d.x1 + 30, d.y1 + 30, -1 FROM door_hits h JOIN doors d USING (plan_id, k) WHERE d.type <> 'front_door'"""
CTE["door_cells"] = sweep_sql("door_sides", "plan_id, k, idx", "ab")


@query("door_edges_rings", """SELECT plan_id, k, min(idx) AS i, max(idx) AS j FROM (SELECT *, row_number() OVER (PARTITION BY plan_id, k ORDER BY round(a, 3) DESC, idx DESC) AS rn
    FROM (SELECT plan_id, k, idx, sum(area) FILTER (n_a > 0 AND n_b > 0) AS a FROM door_cells GROUP BY ALL) WHERE a > 1e-6) WHERE rn <= 2 GROUP BY plan_id, k HAVING count(*) = 2""")
def door_edges_rings(t):
    return P.door_edges(t.doors, t.rings, 30.0, t.dealt)


@query("wall_adjacency_rings")
def wall_adjacency_rings(t):
    """Rooms whose outlines, grown by 30 cm, overlap along at least 50 cm of wall; tests compare it with boxes and brute force."""
    return P.wall_adjacency(t.rings, 30.0, 50.0, t.dealt)


@query("closing_rings")
def closing_rings(t):
    """Closed footprint, holes and pieces of every plan; tests compare it with the box path, pixels and arithmetic."""
    d = P.closed_facts(t.rings, 30.0, t.dealt)
    return d.select("plan_id", *[F.round(c, 3).alias(c) for c in ("closed_cm2", "hole_cm2")], F.round("hole_ratio", 8).alias("hole_ratio"), "n_components")


@query("boundary_cover_rings")
def boundary_cover_rings(t):
    """Covered share of the boundary by the closed plan, and share of rooms outside the grown boundary."""
    x0, y0, x1, y1 = (C(c).cast("double") for c in S.BOX)
    bounds = t.boundary.select("plan_id", F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]).alias("ring"))
    d = P.boundary_cover(t.rings, bounds, 30.0, t.dealt)
    return d.select("plan_id", *[F.round(c, 8).alias(c) for c in d.columns[1:]])


@query("ring_shrink", """WITH p AS (SELECT plan_id, idx, k, x, y, coalesce(lag(x) OVER r, last_value(x) OVER f) AS px, coalesce(lag(y) OVER r, last_value(y) OVER f) AS py,
      coalesce(lead(x) OVER r, first_value(x) OVER f) AS nx, coalesce(lead(y) OVER r, first_value(y) OVER f) AS ny
    FROM ring_points WINDOW r AS (PARTITION BY plan_id, idx ORDER BY k), f AS (PARTITION BY plan_id, idx ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
  a AS (SELECT plan_id, idx, (x * ny - nx * y) / 2 AS part, sqrt((nx - x) ** 2 + (ny - y) ** 2) AS len,
      atan2((x - px) * (ny - y) - (y - py) * (nx - x), (x - px) * (nx - x) + (y - py) * (ny - y)) AS turn FROM p)
  SELECT plan_id, idx, round(sum(part) - 12 * sum(len) + 144 * sum(tan(turn / 2)), 3) AS net_cm2, round(12 * sum(len) - 144 * sum(tan(turn / 2)), 3) AS wall_cm2 FROM a GROUP BY ALL""")
def ring_shrink(t):
    """Rooms without the wall strip of 12 cm along their outline. A shrunk ring loses its girth times the width but for the corners."""
    keys = ["plan_id", "idx"]
    d = t.rings.select(*keys, G.polygon_area(C("ring")).alias("whole"), V.shrunk_area(C("ring"), 12.0).alias("net"))
    return d.select(*keys, F.round("net", 3).alias("net_cm2"), F.round(C("whole") - C("net"), 3).alias("wall_cm2"))


@query("repair_parts", """SELECT plan_id, idx, part, round(CASE WHEN t = 0 THEN a ELSE a / 4 END, 3)::DOUBLE AS area_cm2 FROM twist, (SELECT unnest([1, 2]) AS part) WHERE part = 1 OR t = 1""")
def repair_parts(t):
    """Rooms of which every fourth is drawn as a bow tie: parts of the even-odd inside, largest first."""
    from pyspark.sql import Window as W
    x0, y0, x1, y1 = (C(c).cast("double") for c in S.BOX)
    ring = lambda *p: F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in p])
    drawn = F.when(C("pk") % 4 == 1, ring((x0, y0), (x1, y1), (x1, y0), (x0, y1))).otherwise(ring((x0, y0), (x1, y0), (x1, y1), (x0, y1)))
    keys = ["plan_id", "idx"]
    d = V.part_areas(checkpointed(V.even_odd_cells(t.rooms.select(*keys, drawn.alias("ring")), keys)), keys)
    w = W.partitionBy(*keys).orderBy(F.desc("area"), "part")
    return d.select(*keys, F.row_number().over(w).alias("part"), F.round("area", 3).alias("area_cm2"))


# ---- shared walls and corner cuts at any angle ----

CTE["nook_points"] = """SELECT plan_id, idx, k, x::BIGINT AS x, y::BIGINT AS y FROM ring_points UNION ALL
  SELECT plan_id, idx + 1000, unnest([0, 1, 2]), unnest([x1, x1, x1 - (x1 - x0) // 2]), unnest([y1 - (y1 - y0) // 3, y1, y1]) FROM rooms WHERE pk % 3 = 2"""
CTE["nook_edges"] = """SELECT plan_id, idx, k, x AS x0, y AS y0, coalesce(lead(x) OVER r, first_value(x) OVER r) AS x1, coalesce(lead(y) OVER r, first_value(y) OVER r) AS y1
  FROM nook_points WINDOW r AS (PARTITION BY plan_id, idx ORDER BY k)"""
CTE["nook_lines"] = """SELECT *, dx // g AS p, dy // g AS q, (dx * ay - dy * ax) // g AS c FROM (SELECT *, bx - ax AS dx, by_ - ay AS dy, gcd(bx - ax, by_ - ay) AS g FROM (
    SELECT plan_id, idx, CASE WHEN s THEN x1 ELSE x0 END AS ax, CASE WHEN s THEN y1 ELSE y0 END AS ay, CASE WHEN s THEN x0 ELSE x1 END AS bx, CASE WHEN s THEN y0 ELSE y1 END AS by_
    FROM (SELECT *, x1 < x0 OR (x1 = x0 AND y1 < y0) AS s FROM nook_edges)))"""


def nooks(t):
    """Rings and, for rooms with a cut corner, the triangle behind it as a room of its own: a slanted wall that two rooms share."""
    xm, ym = C("x1") - F.floor((C("x1") - C("x0")) / 2), C("y1") - F.floor((C("y1") - C("y0")) / 3)
    pts = [(C("x1"), ym), (C("x1"), C("y1")), (xm, C("y1"))]
    tri = F.array(*[F.struct(a.cast("double").alias("x"), b.cast("double").alias("y")) for a, b in pts])
    return stacked(t.rings.select("plan_id", "idx", "ring"), t.rooms.filter("pk % 3 = 2").select("plan_id", (C("idx") + 1000).alias("idx"), tri.alias("ring")))


@query("shared_walls_rings", """SELECT plan_id, i, j, len, x0, y0, x1, y1 FROM (SELECT *, row_number() OVER (PARTITION BY plan_id, i, j ORDER BY len DESC, x0, y0, x1, y1) AS rn FROM (
    SELECT a.plan_id, a.idx AS i, b.idx AS j, (CASE WHEN a.p = 0 THEN a.ax ELSE greatest(a.ax, b.ax) END)::DOUBLE AS x0, (CASE WHEN (a.ax, a.ay) > (b.ax, b.ay) THEN a.ay ELSE b.ay END)::DOUBLE AS y0,
      (CASE WHEN a.p = 0 THEN a.ax ELSE least(a.bx, b.bx) END)::DOUBLE AS x1, (CASE WHEN (a.bx, a.by_) < (b.bx, b.by_) THEN a.by_ ELSE b.by_ END)::DOUBLE AS y1,
      round(CASE WHEN a.p = 0 THEN least(a.by_, b.by_) - greatest(a.ay, b.ay) ELSE (least(a.bx, b.bx) - greatest(a.ax, b.ax)) * sqrt(1 + (a.q::DOUBLE / a.p) ** 2) END, 6) AS len
    FROM nook_lines a JOIN nook_lines b ON a.plan_id = b.plan_id AND a.p = b.p AND a.q = b.q AND a.c = b.c AND a.idx < b.idx) WHERE len > 0) WHERE rn = 1""")
def shared_walls_rings(t):
    return walls.shared_walls(walls.numbered_edges(nooks(t)))


@query("split_segments_rings", """SELECT plan_id, idx, k, CAST(row_number() OVER w AS INTEGER) AS part, x::DOUBLE AS x0, y::DOUBLE AS y0, nx::DOUBLE AS x1, ny::DOUBLE AS y1
  FROM (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM (SELECT plan_id, idx, k, x0 AS x, y0 AS y, 0 AS d FROM nook_edges UNION SELECT plan_id, idx, k, x1, y1, (x1 - x0) ** 2 + (y1 - y0) ** 2 FROM nook_edges UNION
      SELECT e.plan_id, e.idx, e.k, c.x, c.y, (c.x - e.x0) ** 2 + (c.y - e.y0) ** 2 FROM nook_edges e JOIN nook_points c ON e.plan_id = c.plan_id AND c.idx <> e.idx
        AND (c.x - e.x0) * (e.y1 - e.y0) = (c.y - e.y0) * (e.x1 - e.x0) AND (c.x - e.x0) * (e.x1 - e.x0) + (c.y - e.y0) * (e.y1 - e.y0) > 0
        AND (c.x - e.x1) * (e.x0 - e.x1) + (c.y - e.y1) * (e.y0 - e.y1) > 0) WINDOW w AS (PARTITION BY plan_id, idx, k ORDER BY d)) WHERE nx IS NOT NULL WINDOW w AS (PARTITION BY plan_id, idx, k ORDER BY d)""")
def split_segments_rings(t):
    return walls.cut_at_corners(walls.numbered_edges(nooks(t)))


# ---- plan metrics from outlines ----

CTE["rect_rooms"] = SQL["rectilinear_fraction"]
CTE["convex_rooms"] = SQL["convexity"]
CTE["shape_rooms"] = """SELECT r.plan_id, count(*) AS n, avg(rectilinear) AS rectilinear, avg((rectilinear < 0.98)::INT) AS slanted, avg(round(convexity, 6)) AS convexity, avg(corners) AS corners
  FROM rect_rooms r JOIN convex_rooms USING (plan_id, idx) JOIN (SELECT plan_id, idx, count(*) AS corners FROM ring_points GROUP BY ALL) USING (plan_id, idx) GROUP BY r.plan_id"""


@query("plan_shape_rings", """SELECT p.plan_id, coalesce(s.n, 0) AS n_rooms_declared, coalesce(s.n, 0) AS n_rooms, CASE WHEN s.n > 0 THEN 0.0::DOUBLE END AS frac_invalid_polygons, round((u.s - u.u) / u.u, 8) AS overlap_ratio,
    round(s.rectilinear, 9) AS mean_rectilinear, round(slanted, 9) AS frac_nonrectilinear_rooms, round(convexity, 9) AS mean_convexity, round(corners, 9) AS mean_corners,
    CASE WHEN scale_known THEN round(u.u / 10000, 6) END AS total_area_m2
  FROM plans p LEFT JOIN shape_rooms s ON p.plan_id = s.plan_id LEFT JOIN (SELECT plan_id, sum(area) FILTER (n_a > 0) AS u, sum(area * n_a) AS s FROM plan_cells GROUP BY plan_id) u ON p.plan_id = u.plan_id""")
def plan_shape_rings(t):
    """Shape columns of the plan metrics from outlines with notches and slants."""
    straight = rectilinear(turned(t), 25.0).withColumn("rectilinear", F.round("rectilinear", 6))
    d = P.plan_shape(t.plans, t.rooms, shapes(t).withColumn("convexity", F.round(F.round("convexity", 9), 6)), straight, P.overlap_ratio(t.rings))
    digits = {"overlap_ratio": 8, "mean_rectilinear": 9, "frac_nonrectilinear_rooms": 9, "mean_convexity": 9, "mean_corners": 9, "total_area_m2": 6, "frac_invalid_polygons": 9}
    return d.withColumns({c: F.round(c, k) for c, k in digits.items()})


@query("isolated_rooms", """SELECT r.plan_id, count(*) AS n_rooms, round(avg((a.idx IS NULL)::INT), 9) AS frac_isolated_rooms FROM rooms r
  LEFT JOIN (SELECT plan_id, i AS idx FROM adj UNION SELECT plan_id, j FROM adj) a ON r.plan_id = a.plan_id AND r.idx = a.idx GROUP BY r.plan_id""")
def isolated_rooms(t):
    """Share of a plan's rooms that share a wall with no other room."""
    ends = t.adj.select("plan_id", F.explode(F.array("i", "j")).alias("idx")).distinct().withColumn("linked", lit(True))
    d = t.rooms.select("plan_id", "idx").join(ends, ["plan_id", "idx"], "left").groupBy("plan_id")
    return d.agg(F.count(lit(1)).alias("n_rooms"), F.round(F.avg(C("linked").isNull().cast("double")), 9).alias("frac_isolated_rooms"))
