"""Scalar functions (labels, text, rings) and filters."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import labels as L
from ..operators.ranking import hash_order, rank_within
from ..operators.spatial import overlap_join, side
from ..vocab import ALIAS_TO_TYPE, BINDING, COUNTED_ROOMS, HOUSE_MERGE, NOT_DWELLING, ROOM_TYPES  # noqa: F401
from .base import CTE, query

C, lit = F.col, F.lit

CTE["alias_map"] = "SELECT * FROM (VALUES " + ",".join(f"('{a}','{t}')" for a, t in ALIAS_TO_TYPE.items()) + ") v(alias, type)"
CTE["norm_native"] = """SELECT plan_id, idx, pk, label,
  regexp_replace(regexp_replace(lower(trim(label)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS norm FROM native"""


@query("norm_label", "SELECT plan_id, idx, norm FROM norm_native")
def norm_label(t):
    return t.native.select("plan_id", "idx", L.norm_label(C("label")).alias("norm"))


@query("canonical_type", """SELECT n.plan_id, n.idx, coalesce(a.type, 'other') AS type
  FROM norm_native n LEFT JOIN alias_map a ON n.norm = a.alias""")
def canonical_type(t):
    return L.canonical_type(t.native, "label").select("plan_id", "idx", "type")


@query("alias_extension", f"""WITH extra AS (SELECT norm, min([{",".join("'" + x + "'" for x in ROOM_TYPES)}][pk % 15 + 1]) AS type
    FROM norm_native WHERE pk % 10 = 4 GROUP BY norm)
  SELECT n.plan_id, n.idx, coalesce(e.type, a.type, 'other') AS type FROM norm_native n
  LEFT JOIN extra e ON n.norm = e.norm LEFT JOIN alias_map a ON n.norm = a.alias""")
def alias_extension(t):
    from .tables import type_name
    extra = t.native.filter("pk % 10 = 4").select("label", type_name(C("pk") % 15).alias("type"))
    return L.canonical_type(t.native, "label", extra=extra).select("plan_id", "idx", "type")


@query("type_group", """SELECT plan_id, idx, CASE WHEN type IN ('entrance', 'corridor') THEN 'hallway' ELSE type END AS stat_type,
  CASE WHEN type IN ('entrance', 'corridor') THEN 'hallway' WHEN type = 'balcony' THEN 'outdoor'
       WHEN type = 'closet' THEN 'storage' ELSE type END AS house_type FROM rooms""")
def type_group(t):
    return t.rooms.select("plan_id", "idx", L.type_group(C("type")).alias("stat_type"),
                          L.type_group(C("type"), HOUSE_MERGE).alias("house_type"))


@query("gt_base_id", """SELECT gen_id AS id, regexp_replace(gen_id, '_[0-9]+$', '') AS base FROM gen_ids
  UNION ALL SELECT home || '_s' || storey, home::VARCHAR FROM storeys""")
def gt_base_id(t):
    s = t.storeys.select(F.concat(C("home"), lit("_s"), C("storey")).alias("id"))
    return t.gen_ids.select(C("gen_id").alias("id"), L.gt_base_id(C("gen_id")).alias("base")).unionByName(
        s.select("id", L.storey_base_id(C("id")).alias("base")))


@query("polygon_area", """SELECT p.plan_id, p.idx, abs(sum(p.x * q.y - q.x * p.y)) / 2 AS area
  FROM (SELECT *, count(*) OVER (PARTITION BY plan_id, idx) AS n FROM ring_points) p
  JOIN ring_points q ON p.plan_id = q.plan_id AND p.idx = q.idx AND q.k = (p.k + 1) % p.n GROUP BY p.plan_id, p.idx""")
def polygon_area(t):
    return t.rings.select("plan_id", "idx", G.polygon_area(C("ring")).alias("area"))


@query("bbox", "SELECT plan_id, idx, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM ring_points GROUP BY plan_id, idx")
def bbox(t):
    return t.rings.select("plan_id", "idx", *[c.alias(n) for n, c in G.bbox(C("ring")).items()])


@query("seg_rect", """WITH s AS (SELECT plan_id, idx, k, x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1 + idx % 2 * 37.0 AS x1, y1 + k * 11.0 AS y1 FROM ring_edges),
  d AS (SELECT *, -(y1 - y0) / sqrt((x1-x0)*(x1-x0) + (y1-y0)*(y1-y0)) * 5.0 AS ox,
               (x1 - x0) / sqrt((x1-x0)*(x1-x0) + (y1-y0)*(y1-y0)) * 5.0 AS oy FROM s)
  SELECT plan_id, idx, k, round(x0 + ox, 4) AS ax, round(y0 + oy, 4) AS ay, round(x1 - ox, 4) AS cx, round(y1 - oy, 4) AS cy FROM d""")
def seg_rect(t):
    e = t.ring_edges.select("plan_id", "idx", "k", C("x0").cast("double").alias("x0"), C("y0").cast("double").alias("y0"),
                            (C("x1") + C("idx") % 2 * 37.0).alias("x1"), (C("y1") + C("k") * 11.0).alias("y1"))
    e = e.withColumn("r", G.seg_rect(C("x0"), C("y0"), C("x1"), C("y1"), 5.0))
    return e.select("plan_id", "idx", "k", C("r")[0]["x"].alias("ax"), C("r")[0]["y"].alias("ay"),
                    C("r")[2]["x"].alias("cx"), C("r")[2]["y"].alias("cy"))


@query("affine", """WITH p AS (SELECT r.plan_id, r.idx, k, x, y, radians(pk % 4 * 30.0) AS a FROM ring_points r
    JOIN rooms m ON r.plan_id = m.plan_id AND r.idx = m.idx)
  SELECT plan_id, idx, k, round((cos(a) * x - sin(a) * y) * 0.01 + 2.5, 6) + 0.0 AS x,
         round((0 - (sin(a) * x + cos(a) * y)) * 0.01, 6) + 0.0 AS y FROM p""")
def affine(t):
    a = F.radians(C("pk") % 4 * lit(30.0))
    r = t.rings.withColumn("ring", G.affine(G.rotate(C("ring"), a), 0.01, 0, 0, -0.01, 2.5, 0))
    return r.select("plan_id", "idx", F.posexplode("ring").alias("k", "p")).select(
        "plan_id", "idx", C("k").cast("long").alias("k"), F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@query("clean_ring", "SELECT plan_id, idx, k, x, y FROM ring_points")
def clean_ring(t):
    """Rings dirtied with a repeated point, a collinear midpoint and a closing point clean back to themselves."""
    r = C("ring")
    mid = F.struct(((r[0]["x"] + r[1]["x"]) / 2).alias("x"), ((r[0]["y"] + r[1]["y"]) / 2).alias("y"))
    dirty = F.concat(F.slice(r, 1, 1), F.array(mid), F.slice(r, 2, 1), F.slice(r, 2, F.size(r) - 1), F.slice(r, 1, 1))
    return t.rings.withColumn("ring", G.clean_ring(dirty)).select(
        "plan_id", "idx", F.posexplode("ring").alias("k", "p")).select("plan_id", "idx", C("k").cast("long").alias("k"), "p.x", "p.y")


@query("feet_inches", """SELECT plan_id, idx, CASE WHEN pk % 7 <> 0 THEN round(((x1 - x0) // 30 + ((y1 - y0) % 12) / 12.0::DOUBLE) * 0.3048, 6) END AS metres FROM rooms""")
def feet_inches(t):
    txt = F.when(C("pk") % 7 != 0, F.concat(F.floor((C("x1") - C("x0")) / 30), lit("' "), (C("y1") - C("y0")) % 12, lit('" wide'))) \
        .otherwise(F.concat(lit("unlabelled "), C("pk")))
    return t.rooms.select("plan_id", "idx", F.round(L.feet_inches(txt), 6).alias("metres"))


@query("rel_err", """WITH a AS (SELECT plan_id, sum((x1 - x0) * (y1 - y0)) FILTER (type NOT IN ('outdoor', 'other')) AS net,
    sum((x1 - x0) * (y1 - y0)) FILTER (type = 'other') AS stairs, count(*) * 120000 AS brief FROM rooms GROUP BY plan_id)
  SELECT plan_id, round(abs(coalesce(net, 0) - brief)::DOUBLE / brief, 9) AS net_rel_err,
         round(abs(coalesce(net, 0) + coalesce(stairs, 0) - brief)::DOUBLE / brief, 9) AS incl_stairs_rel_err FROM a""")
def rel_err(t):
    area = (C("x1") - C("x0")) * (C("y1") - C("y0"))
    a = t.rooms.groupBy("plan_id").agg(
        F.coalesce(F.sum(F.when(~C("type").isin("outdoor", "other"), area)), lit(0)).alias("net"),
        F.coalesce(F.sum(F.when(C("type") == "other", area)), lit(0)).alias("stairs"),
        (F.count(lit(1)) * 120000).alias("brief"))
    return a.select("plan_id", F.round(G.rel_err(C("net"), C("brief")), 9).alias("net_rel_err"),
                    F.round(G.rel_err(C("net") + C("stairs"), C("brief")), 9).alias("incl_stairs_rel_err"))


CTE["ring_segs"] = """SELECT p.plan_id, p.idx, p.k, p.x AS x0, p.y AS y0, q.x AS x1, q.y AS y1,
    sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)) AS len, atan2(q.y - p.y, q.x - p.x) AS ang
  FROM (SELECT *, count(*) OVER (PARTITION BY plan_id, idx) AS n FROM ring_points) p
  JOIN ring_points q ON p.plan_id = q.plan_id AND p.idx = q.idx AND q.k = (p.k + 1) % p.n"""


def ring_segments(t):
    e = t.rings.select("plan_id", "idx", "type", F.inline(G.edges_of(C("ring"))))
    return e.withColumn("dx", C("x1") - C("x0")).withColumn("dy", C("y1") - C("y0")) \
        .withColumn("len", G.edge_length(C("dx"), C("dy")))


@query("edge_angle_hist", """WITH a AS (SELECT r.type, s.len, (((degrees(ang) % 90) + 90) % 90) AS d FROM ring_segs s
    JOIN rooms r ON s.plan_id = r.plan_id AND s.idx = r.idx)
  SELECT type, CAST(floor((d + 2.5) / 5) AS BIGINT) % 18 AS bin, count(*) AS n, round(sum(len), 3) AS total_len FROM a GROUP BY ALL""")
def edge_angle_hist(t):
    s = ring_segments(t).withColumn("bin", F.floor((G.edge_angle(C("dx"), C("dy")) + 2.5) / 5) % 18)
    return s.groupBy("type", "bin").agg(F.count(lit(1)).alias("n"), F.round(F.sum("len"), 3).alias("total_len"))


@query("brief_text", """WITH n AS (SELECT *, count(*) OVER (PARTITION BY plan_id, type) AS c,
    row_number() OVER (PARTITION BY plan_id, type ORDER BY idx) AS k FROM rooms),
  l AS (SELECT plan_id, idx, CASE WHEN c > 1 THEN type || ' ' || k ELSE type END AS name, (x1 - x0) * (y1 - y0) AS a FROM n),
  o AS (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY a DESC, idx) - 1 AS pos FROM l)
  SELECT plan_id, pos // 500 AS part, string_agg(name || ' (' || (a // 1000) || ' dm2)', ', ' ORDER BY pos) AS text
  FROM o GROUP BY plan_id, pos // 500""")
def brief_text(t):
    """Program as text: rooms by decreasing area, repeated names numbered. A text is cut into parts of 500 rooms."""
    r = t.rooms.withColumn("a", (C("x1") - C("x0")) * (C("y1") - C("y0")))
    r = L.number_repeats(r, ["plan_id"], "type", ["idx"], t.large, "name")
    o = rank_within(r, ["plan_id"], [-C("a"), C("idx")], "pos", t.large)
    line = F.concat(C("name"), lit(" ("), F.floor(C("a") / 1000), lit(" dm2)"))
    g = o.groupBy("plan_id", F.floor(C("pos") / 500).alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("pos", line.alias("s")))).alias("l"))
    return g.select("plan_id", "part", F.array_join(F.transform("l", lambda x: x["s"]), ", ").alias("text"))


@query("mask_prompt", """WITH h AS (SELECT plan_id, idx, type, (x1 - x0) * (y1 - y0) AS a,
    md5(plan_id || ':' || idx || ':0') AS h FROM rooms),
  m AS (SELECT plan_id, max(h) AS top, sum(a) AS total FROM h GROUP BY plan_id)
  SELECT h.plan_id, idx, CAST(m.total AS BIGINT) AS total_area,
    '{"room_type":"' || type || '","area":' || a || '}' AS full_room, '{"area":' || a || '}' AS area_room,
    CASE WHEN h.h >= '8' OR h.h = m.top THEN '{"area":' || a || '}' END AS some_room
  FROM h JOIN m ON h.plan_id = m.plan_id""")
def mask_prompt(t):
    """Prompt levels per room; the partial level keeps hash-drawn rooms and always the one with the largest draw."""
    r = t.rooms.select("plan_id", "idx", "type", ((C("x1") - C("x0")) * (C("y1") - C("y0"))).alias("area"),
                       hash_order("plan_id", "idx").alias("h"))
    m = r.groupBy("plan_id").agg(F.max("h").alias("top"), F.sum("area").alias("total_area"))
    j = r.join(m, "plan_id")
    small = F.to_json(F.struct("area"))
    return j.select("plan_id", "idx", "total_area", F.to_json(F.struct(C("type").alias("room_type"), "area")).alias("full_room"),
                    small.alias("area_room"), F.when((C("h") >= "8") | (C("h") == C("top")), small).alias("some_room"))


@query("fmt_cell", """SELECT plan_id, idx, CASE WHEN pk % 9 = 0 THEN '–' ELSE printf('%.2f', (x1 - x0) / 100) END AS width,
  CASE WHEN pk % 9 = 0 THEN '–' ELSE printf('%.1f%%', ((x1 - x0) % 100)::DOUBLE) END AS pct FROM rooms""")
def fmt_cell(t):
    w = F.when(C("pk") % 9 != 0, C("x1") - C("x0"))
    return t.rooms.select("plan_id", "idx", L.fmt_cell(w / 100).alias("width"), L.fmt_cell((w % 100) / 100, 1, True).alias("pct"))


@query("slug_key", """SELECT plan_id, replace(replace(lower(variant || ' ' || dataset), ' ', '_'), '-', '') AS slug,
  regexp_replace(variant || ':' || dataset || '/' || plan_id, '[:/]', '_', 'g') AS file_key,
  CASE WHEN plan_id % 2 = 0 THEN dataset ELSE dataset || '+' || substr(variant, 1, 1) END AS tag FROM plans""")
def slug_key(t):
    tag = F.when(C("plan_id") % 2 == 0, F.array("dataset")).otherwise(F.array("dataset", F.substring("variant", 1, 1)))
    return t.plans.select("plan_id", L.slug(F.concat_ws(" ", "variant", "dataset")).alias("slug"),
                          L.file_key(F.concat(C("variant"), lit(":"), C("dataset"), lit("/"), C("plan_id"))).alias("file_key"),
                          F.array_join(tag, "+").alias("tag"))


# Codes of where a box lies around another, by row (above, beside, below) and column (left, level, right); 5 is around it, 4 inside.
AROUND = [[0, 3, 8], [2, 4, 7], [1, 6, 9]]


@query("box_relation", f"""WITH p AS (SELECT a.plan_id, a.idx AS i, b.idx AS j, a.x0 < b.x0 AND a.x1 > b.x1 AND a.y0 < b.y0 AND a.y1 > b.y1 AS around,
    a.x0 >= b.x0 AND a.x1 <= b.x1 AND a.y0 >= b.y0 AND a.y1 <= b.y1 AS inside,
    (a.x0 + a.x1) / 2 - b.x0 AS from_left, (a.x0 + a.x1) / 2 - b.x1 AS from_right, (a.y0 + a.y1) / 2 - b.y0 AS from_top, (a.y0 + a.y1) / 2 - b.y1 AS from_bottom
  FROM rooms a JOIN rooms b ON a.plan_id = b.plan_id AND a.idx < b.idx
  WHERE a.x0 - 9 <= b.x1 AND a.x1 + 9 >= b.x0 AND a.y0 - 9 <= b.y1 AND a.y1 + 9 >= b.y0),
  -- a centre on the line of a side is beyond it on that line's half from the side's first corner on, going round
  q AS (SELECT *, 2 + (from_right > 0 OR (from_right = 0 AND from_bottom <= 0))::INT - (from_left < 0 OR (from_left = 0 AND from_top >= 0))::INT AS col,
    2 + (from_bottom > 0 OR (from_bottom = 0 AND from_left >= 0))::INT - (from_top < 0 OR (from_top = 0 AND from_right <= 0))::INT AS line FROM p)
  SELECT plan_id, i, j, CASE WHEN around THEN 5 WHEN inside THEN 4 ELSE ({AROUND})[line][col] END AS relation FROM q""")
def box_relation(t):
    d = overlap_join(side(t.rooms, "a", ["idx"]), side(t.rooms, "b", ["idx"]), 9, 0, t.large,
                     C("aidx") < C("bidx"), touch=True)
    u, v = ({c: C(p + c) for c in ("x0", "y0", "x1", "y1")} for p in "ab")
    return d.select("plan_id", C("aidx").alias("i"), C("bidx").alias("j"), G.box_relation(u, v).alias("relation"))


@query("plan_spec", """WITH g AS (SELECT plan_id, idx, max(x) - min(x) AS w, max(y) - min(y) AS h FROM ring_points GROUP BY ALL),
  a AS (SELECT p.plan_id, p.idx, abs(sum(p.x0 * p.y1 - p.x1 * p.y0)) / 2 AS area FROM ring_segs p GROUP BY ALL),
  r AS (SELECT g.plan_id, g.idx, w, h, area FROM g JOIN a ON g.plan_id = a.plan_id AND g.idx = a.idx)
  SELECT r.plan_id, r.idx, 'room|' || r.idx AS id, m.type AS room_type, floor(area / 100 + 0.5) / 100 AS area, floor(h + 0.5) / 100 AS height,
    floor(w + 0.5) / 100 AS width, t.room_count, floor(t.total / 100 + 0.5) / 100 AS total_area
  FROM r JOIN (SELECT plan_id, count(*) AS room_count, sum(area) AS total FROM r GROUP BY plan_id) t ON r.plan_id = t.plan_id
  JOIN rooms m ON m.plan_id = r.plan_id AND m.idx = r.idx""")
def plan_spec(t):
    """Room attributes without the outline, next to the plan totals, one row per room."""
    b = G.bbox(C("ring"))
    r = t.rings.select("plan_id", "idx", C("type").alias("room_type"), G.polygon_area(C("ring")).alias("a"),
                       (b["x1"] - b["x0"]).alias("w"), (b["y1"] - b["y0"]).alias("h"))
    p = r.groupBy("plan_id").agg(F.count(lit(1)).alias("room_count"), (F.floor(F.sum("a") / 100 + 0.5) / 100).alias("total_area"))
    return r.join(p, "plan_id").select(
        "plan_id", "idx", F.concat(lit("room|"), C("idx")).alias("id"), "room_type", (F.floor(C("a") / 100 + 0.5) / 100).alias("area"),
        (F.floor(C("h") + 0.5) / 100).alias("height"), (F.floor(C("w") + 0.5) / 100).alias("width"), "room_count", "total_area")


# Keywords of free room names for the given labels, in order of precedence.
TYPE_WORDS = [("bathroom", ["bath", "wc", "sauna"]), ("closet", ["closet"]), ("living_room", ["living", "lounge", "draw"]),
              ("bedroom", ["bed", "master"]), ("storage", ["store"]), ("study", ["study"]), ("hallway", ["hall", "foyer"])]


@query("keyword_type", """SELECT plan_id, idx, CASE WHEN l LIKE '%bath%' OR l LIKE '%wc%' OR l LIKE '%sauna%' THEN 'bathroom'
  WHEN l LIKE '%closet%' THEN 'closet' WHEN l LIKE '%living%' OR l LIKE '%lounge%' OR l LIKE '%draw%' THEN 'living_room'
  WHEN l LIKE '%bed%' OR l LIKE '%master%' THEN 'bedroom' WHEN l LIKE '%store%' THEN 'storage' WHEN l LIKE '%study%' THEN 'study'
  WHEN l LIKE '%hall%' OR l LIKE '%foyer%' THEN 'hallway' END AS type FROM (SELECT plan_id, idx, lower(label) AS l FROM native)""")
def keyword_type(t):
    return t.native.select("plan_id", "idx", L.keyword_type(C("label"), TYPE_WORDS).alias("type"))


# ---- filters ----

@query("drop_zero_rooms", """SELECT plan_id, idx, row_number() OVER (PARTITION BY plan_id ORDER BY idx) - 1 AS new_idx FROM rooms
  WHERE (CASE WHEN pk % 6 = 0 THEN 0 ELSE x1 - x0 END) * (y1 - y0) > 0""")
def drop_zero_rooms(t):
    r = t.rooms.withColumn("x1", F.when(C("pk") % 6 == 0, C("x0")).otherwise(C("x1")))
    return reindexed(r, t.large).select("plan_id", "idx", "new_idx")


def reindexed(rooms, large=None):
    """Rooms with area, numbered again in their old order."""
    keep = rooms.filter((C("x1") - C("x0")) * (C("y1") - C("y0")) > 0)
    return rank_within(keep, ["plan_id"], ["idx"], "new_idx", large)


@query("drop_small_parts", "SELECT plan_id, idx, area FROM (SELECT plan_id, idx, abs(sum(x0 * y1 - x1 * y0)) / 2 AS area FROM ring_segs GROUP BY ALL) WHERE area > 110000")
def drop_small_parts(t):
    return t.rings.select("plan_id", "idx", G.polygon_area(C("ring")).alias("area")).filter(C("area") > 110000)


@query("finite_coords", """SELECT plan_id, min(CASE WHEN pk % 17 = 0 THEN false ELSE y1 <= 2000 END) AS ok FROM rooms GROUP BY plan_id""")
def finite_coords(t):
    """A plan is rejected when any ring has a non-finite coordinate or leaves the frame."""
    bad = F.transform("ring", lambda p: F.struct(F.when(C("pk") % 17 == 0, lit(float("nan"))).otherwise(p["x"]).alias("x"), p["y"].alias("y")))
    r = t.rings.withColumn("ring", bad)
    return r.groupBy("plan_id").agg(F.min(G.finite_ring(C("ring"), 0.0, 2000.0)).alias("ok"))


@query("known_scale_only", "SELECT plan_id, dataset FROM plans WHERE scale_known")
def known_scale_only(t):
    return t.plans.filter("scale_known").select("plan_id", "dataset")


@query("type_in_set", """SELECT plan_id, count(*) FILTER (type IN ('living_room','bedroom','study','dining_room')) AS n_counted,
  count(*) FILTER (type NOT IN ('balcony','outdoor','garage')) AS n_dwelling FROM rooms GROUP BY plan_id""")
def type_in_set(t):
    return t.rooms.groupBy("plan_id").agg(F.count_if(C("type").isin(COUNTED_ROOMS)).alias("n_counted"),
                                          F.count_if(~C("type").isin(NOT_DWELLING)).alias("n_dwelling"))


@query("obsolete_variants", "SELECT plan_id, variant FROM plans WHERE NOT (variant LIKE '1-%' OR variant LIKE '5-%')")
def obsolete_variants(t):
    return t.plans.filter(~(C("variant").startswith("1-") | C("variant").startswith("5-"))).select("plan_id", "variant")


@query("complete_homes", """SELECT home, storey, plan_id FROM storeys
  WHERE home IN (SELECT home FROM storeys GROUP BY home HAVING count(*) = min(n_storeys))""")
def complete_homes(t):
    full = t.storeys.groupBy("home").agg(F.count(lit(1)).alias("n"), F.min("n_storeys").alias("want")).filter("n = want")
    return t.storeys.join(full.select("home"), "home", "left_semi").select("home", "storey", "plan_id")


@query("min_yield_gate", """SELECT count(*) AS n_inputs, count(r.plan_id) AS n_converted,
  round(count(r.plan_id)::DOUBLE / count(*), 6) AS yield, count(r.plan_id) >= 0.95 * count(*) AS passed
  FROM plans p LEFT JOIN (SELECT DISTINCT plan_id FROM rooms) r ON p.plan_id = r.plan_id""")
def min_yield_gate(t):
    return yield_gate(t.plans, t.rooms)


def yield_gate(inputs, outputs, min_share: float = 0.95, fail: bool = False):
    """Share of inputs with output; with ``fail`` the job stops when the share is too low."""
    d = inputs.select("plan_id").join(outputs.select(C("plan_id").alias("o")).distinct(), C("plan_id") == C("o"), "left")
    d = d.agg(F.count(lit(1)).alias("n_inputs"), F.count("o").alias("n_converted"))
    d = d.withColumn("passed", C("n_converted") >= min_share * C("n_inputs"))
    if fail:
        d = d.withColumn("passed", F.when(C("passed"), True).otherwise(
            F.raise_error(F.concat(lit("yield too low: "), C("n_converted"), lit(" of "), C("n_inputs")))))
    return d.select("n_inputs", "n_converted", F.round(C("n_converted") / C("n_inputs"), 6).alias("yield"), "passed")


@query("types_present", """SELECT dataset, type, count(*) AS n FROM rooms r JOIN plans p ON r.plan_id = p.plan_id
  GROUP BY dataset, type HAVING count(*) >= 0.05 * 100""")
def types_present(t):
    return t.rooms.join(t.plans, "plan_id").groupBy("dataset", "type").agg(F.count(lit(1)).alias("n")).filter("n >= 5")
