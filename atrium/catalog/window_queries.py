"""Window functions, ordering, sampling."""
from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.labels import number_repeats
from ..operators import spatial as S

from ..operators.ranking import hash_order, rank_within, top_k
from ..operators.sampling import matched_reference, sample_n, sample_per_group
from ..plans import programs as PR
from ..plans.stats import mean_edges
from .base import CTE, query

C, lit = F.col, F.lit


@query("room_index", "SELECT plan_id, idx, pk, type FROM rooms")
def room_index(t):
    return t.rooms.select("plan_id", "idx", "pk", "type")


@query("top2_overlap", """SELECT plan_id, k, max(idx) FILTER (rn = 1) AS first, max(idx) FILTER (rn = 2) AS second FROM (
  SELECT *, row_number() OVER (PARTITION BY plan_id, k ORDER BY area DESC, idx DESC) AS rn FROM door_hits) WHERE rn <= 2 GROUP BY plan_id, k""")
def top2_overlap(t):
    h = S.door_hits(t.doors, t.rooms, 30, t.large)
    w = W.partitionBy("plan_id", "k").orderBy(F.desc("area"), F.desc("idx"))
    d = h.withColumn("rn", F.row_number().over(w)).filter("rn <= 2")
    return d.groupBy("plan_id", "k").agg(F.max(F.when(C("rn") == 1, C("idx"))).alias("first"), F.max(F.when(C("rn") == 2, C("idx"))).alias("second"))


@query("front_room", "SELECT plan_id, seed AS front_room FROM front_room")
def front_room(t):
    return front_rooms(t).withColumnRenamed("seed", "front_room")


def front_rooms(t):
    """Room overlapping the first usable front door most."""
    h = S.door_hits(t.doors.filter("type = 'front_door'"), t.rooms, 30, t.large)
    return h.groupBy("plan_id").agg(F.max_by("idx", F.struct(-C("k"), C("area"), C("idx"))).alias("seed"))


@query("largest_part", "SELECT plan_id, type, idx, area FROM (SELECT plan_id, type, idx, (x1 - x0) * (y1 - y0) AS area, row_number() OVER (PARTITION BY plan_id, type ORDER BY (x1 - x0) * (y1 - y0) DESC, idx) AS rn FROM rooms) WHERE rn = 1")
def largest_part(t):
    area = (C("x1") - C("x0")) * (C("y1") - C("y0"))
    return t.rooms.groupBy("plan_id", "type").agg(F.max(F.struct(area.alias("area"), (-C("idx")).alias("n"))).alias("m")).select(
        "plan_id", "type", (-C("m.n")).alias("idx"), C("m.area").alias("area"))


CTE["pair_means"] = "SELECT kind, type_a, type_b, avg(mean_edges) AS m FROM edge_means WHERE kind = 'wall' GROUP BY ALL"


@query("top_k_connections", """WITH k AS (SELECT type_a, type_b FROM pair_means ORDER BY round(m, 9) DESC, type_a, type_b LIMIT 10)
  SELECT e.dataset, e.type_a, e.type_b, round(mean_edges, 9) AS mean_edges FROM edge_means e JOIN k ON e.type_a = k.type_a AND e.type_b = k.type_b WHERE e.kind = 'wall'""")
def top_k_connections(t):
    from .aggregate_queries import tedges
    m = mean_edges(tedges(t), t.plans).filter("kind = 'wall'")
    top = m.groupBy("type_a", "type_b").agg(F.round(F.avg("mean_edges"), 9).alias("m")).orderBy(F.desc("m"), "type_a", "type_b").limit(10)
    return m.join(F.broadcast(top.select("type_a", "type_b")), ["type_a", "type_b"], "left_semi").select(
        "dataset", "type_a", "type_b", F.round("mean_edges", 9).alias("mean_edges"))


@query("latest_version", "SELECT home, dataset, plan_id FROM (SELECT *, row_number() OVER (PARTITION BY home, dataset ORDER BY created DESC, plan_id DESC) AS rn FROM plans) WHERE rn = 1")
def latest_version(t):
    return t.plans.groupBy("home", "dataset").agg(F.max_by("plan_id", F.struct("created", "plan_id")).alias("plan_id"))


@query("sample_n", "SELECT plan_id, dataset FROM plans ORDER BY md5(plan_id || ':0'), plan_id LIMIT 1000")
def sample_n_(t):
    return sample_n(t.plans.select("plan_id", "dataset"), "plan_id", 1000)


@query("sample_per_group", """SELECT r AS round, home, plan_id FROM (SELECT r, home, plan_id, row_number() OVER (PARTITION BY r, home ORDER BY md5(plan_id || ':' || r), plan_id) AS rn
  FROM plans, (SELECT unnest(range(5)) AS r)) WHERE rn = 1""")
def sample_per_group_(t):
    return sample_per_group(t.plans.select("home", "plan_id"), ["home"], "plan_id", 5)


CTE["comp_keys"] = """SELECT p.plan_id, p.dataset, count(*) FILTER (r.type = 'bedroom') AS bed, count(*) FILTER (r.type = 'bathroom') AS bath, least(count(*) FILTER (r.type = 'balcony'), 1) AS balc
  FROM plans p JOIN rooms r ON p.plan_id = r.plan_id GROUP BY p.plan_id, p.dataset"""
CTE["matched"] = """WITH pool AS (SELECT *, row_number() OVER (PARTITION BY bed, bath, balc ORDER BY md5(plan_id || ':0')) - 1 AS pos, count(*) OVER (PARTITION BY bed, bath, balc) AS m FROM comp_keys WHERE dataset = 'O'),
  s AS (SELECT bed, bath, balc, count(*) AS m FROM pool GROUP BY ALL),
  g AS (SELECT c.plan_id, c.bed, c.bath, c.balc, s.m, unnest(range(least(20, coalesce(s.m, 1)))) AS rk, ('0x' || substr(md5(c.plan_id || ':start'), 1, 8))::BIGINT % s.m AS st
        FROM comp_keys c LEFT JOIN s ON c.bed = s.bed AND c.bath = s.bath AND c.balc = s.balc WHERE c.dataset = 'F')
  SELECT g.plan_id AS gen_id, CASE WHEN p.plan_id IS NOT NULL THEN rk END AS rank, p.plan_id AS real_id FROM g LEFT JOIN pool p ON g.bed = p.bed AND g.bath = p.bath AND g.balc = p.balc AND p.pos = (g.st + g.rk) % g.m"""


def comp_keys(t):
    r = t.rooms.join(t.plans.select("plan_id", "dataset"), "plan_id")
    n = lambda x: F.count(F.when(C("type") == x, 1))
    return r.groupBy("plan_id", "dataset").agg(n("bedroom").alias("bed"), n("bathroom").alias("bath"), F.least(n("balcony"), lit(1)).cast("long").alias("balc"))


def matched(t):
    k = comp_keys(t)
    return matched_reference(k.filter("dataset = 'F'").withColumnRenamed("plan_id", "gen_id"), k.filter("dataset = 'O'").withColumnRenamed("plan_id", "real_id"),
                             ["bed", "bath", "balc"])


@query("matched_reference", "SELECT * FROM matched")
def matched_reference_(t):
    return matched(t)


@query("room_count_holdout", """SELECT n, plan_id, rk FROM (SELECT n, plan_id, row_number() OVER (PARTITION BY n ORDER BY md5(plan_id || ':12345'), plan_id) AS rk FROM plan_n WHERE n BETWEEN 5 AND 8) WHERE rk <= 100""")
def room_count_holdout(t):
    n = t.rooms.groupBy("plan_id").agg(F.count(lit(1)).alias("n")).filter("n BETWEEN 5 AND 8")
    return top_k(n, ["n"], [hash_order("plan_id", seed=12345), "plan_id"], 100).select("n", "plan_id", C("rank").alias("rk"))


@query("paint_order", "SELECT plan_id, idx, row_number() OVER (PARTITION BY plan_id ORDER BY (x1 - x0) * (y1 - y0) DESC, idx) - 1 AS paint FROM rooms")
def paint_order(t):
    r = t.rooms.select("plan_id", "idx", ((C("x1") - C("x0")) * (C("y1") - C("y0"))).alias("area"))
    return rank_within(r, ["plan_id"], [-C("area"), "idx"], "paint", t.large).select("plan_id", "idx", "paint")


@query("best_of_n", """SELECT user_id, min_by(event_id, struct_pack(bad := CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END, ov := value, id := event_id)) AS best FROM events GROUP BY user_id""")
def best_of_n(t):
    """Candidate with valid JSON first, then the least overlap; candidates arrive as raw text."""
    from ..functions.labels import strict_json
    d = t.raw_text.select("user_id", "id", "value", (strict_json(F.regexp_replace("text", " done$", "")).isNull()).cast("int").alias("bad"))
    return d.groupBy("user_id").agg(F.min_by("id", F.struct("bad", "value", "id")).alias("best"))


@query("best_highlight", """WITH m AS (SELECT dataset, variant, round(avg(n), 2) AS rooms, round(avg(scale_known::INT), 2) AS scaled FROM plans p JOIN plan_n n ON p.plan_id = n.plan_id GROUP BY dataset, variant),
  u AS (SELECT dataset, variant, 'rooms' AS metric, rooms AS value FROM m UNION ALL SELECT dataset, variant, 'scaled', scaled FROM m)
  SELECT *, value = max(value) OVER (PARTITION BY metric) AS best FROM u""")
def best_highlight(t):
    n = t.rooms.groupBy("plan_id").agg(F.count(lit(1)).alias("n"))
    m = t.plans.join(n, "plan_id").groupBy("dataset", "variant").agg(F.round(F.avg("n"), 2).alias("rooms"), F.round(F.avg(C("scale_known").cast("int")), 2).alias("scaled"))
    u = m.select("dataset", "variant", F.inline(F.array(F.struct(lit("rooms").alias("metric"), C("rooms").alias("value")),
                                                        F.struct(lit("scaled").alias("metric"), C("scaled").alias("value")))))
    return mark_best(u, ["metric"])


def mark_best(df, keys, lowest=()):
    """Flag the best printed value per metric, ties all marked; names in ``lowest`` want the minimum."""
    hi = df.groupBy(*keys).agg(F.max("value").alias("hi"), F.min("value").alias("lo"))
    target = F.when(C("metric").isin(list(lowest)), C("lo")).otherwise(C("hi")) if lowest else C("hi")
    return df.join(hi, keys).withColumn("best", C("value") == target).drop("hi", "lo")


@query("bfs_order", """WITH RECURSIVE walk AS (SELECT plan_id, seed AS idx, 0 AS d FROM front_room UNION
    SELECT w.plan_id, e.b, w.d + 1 FROM walk w JOIN (SELECT plan_id, i AS a, j AS b FROM adj UNION SELECT plan_id, j, i FROM adj) e ON w.plan_id = e.plan_id AND w.idx = e.a WHERE w.d < 40),
  m AS (SELECT plan_id, idx, min(d) AS depth FROM walk GROUP BY ALL)
  SELECT plan_id, idx, depth, row_number() OVER (PARTITION BY plan_id ORDER BY depth, idx) - 1 AS pos FROM m""")
def bfs_order(t):
    d = PR.bfs_depth(t.rooms, t.adj, front_rooms(t), t.large)
    return rank_within(d, ["plan_id"], ["depth", "idx"], "pos", t.large)


@query("room_numbering", """SELECT plan_id, idx, CASE WHEN count(*) OVER (PARTITION BY plan_id, type) > 1 THEN type || ' ' || row_number() OVER (PARTITION BY plan_id, type ORDER BY idx) ELSE type END AS label FROM rooms""")
def room_numbering(t):
    return number_repeats(t.rooms, ["plan_id"], "type", ["idx"], t.large).select("plan_id", "idx", "label")


@query("storey_rank", "SELECT home, plan_id, dense_rank() OVER (PARTITION BY home ORDER BY plan_id // 7) - 1 AS storey FROM plans")
def storey_rank(t):
    """Storey index from a height: distinct heights are ranked, then joined back."""
    p = t.plans.select("home", "plan_id", F.floor(C("plan_id") / 7).alias("h"))
    r = rank_within(p.select("home", "h").distinct(), ["home"], ["h"], "storey", t.large_homes)
    return p.join(r, ["home", "h"]).select("home", "plan_id", "storey")


CTE["prog_deg"] = """SELECT r.plan_id, r.idx, count(DISTINCT e.b) AS deg, min(e.b) AS nb FROM rooms r LEFT JOIN (SELECT plan_id, a, b FROM program_edges WHERE kind = 'door' UNION ALL SELECT plan_id, b, a FROM program_edges WHERE kind = 'door') e
  ON r.plan_id = e.plan_id AND r.idx = e.a GROUP BY ALL"""


@query("hanging_rooms", """WITH root AS (SELECT plan_id, coalesce(min(idx) FILTER (type = 'entrance'), min(idx) FILTER (type = 'other'), arg_max(idx, deg * 100000 - idx)) AS root FROM (SELECT d.*, r.type FROM prog_deg d JOIN rooms r ON d.plan_id = r.plan_id AND d.idx = r.idx) GROUP BY plan_id),
  h AS (SELECT d.plan_id, d.idx, d.nb, r.root FROM prog_deg d JOIN root r ON d.plan_id = r.plan_id WHERE d.deg = 1 AND d.idx <> r.root)
  SELECT h.plan_id, h.idx, h.nb AS host, h.root FROM h WHERE h.nb <> h.root AND NOT EXISTS (FROM h g WHERE g.plan_id = h.plan_id AND g.idx = h.nb)""")
def hanging_rooms(t):
    e = t.program_edges.filter("kind = 'door'").select("plan_id", C("a").alias("i"), C("b").alias("j"))
    return PR.hanging_rooms(t.rooms, e)


@query("retry_accounting", """WITH a AS (SELECT user_id, event_type = 'purchase' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
  f AS (SELECT user_id, min(k) FILTER (ok) AS attempts FROM a GROUP BY user_id) SELECT attempts, count(*) AS n FROM f GROUP BY attempts""")
def retry_accounting(t):
    """Attempts until the first success per job: events up to the first success are counted, nothing is ranked."""
    e = t.raw("events").select("user_id", "ts", "event_id", (C("event_type") == "purchase").alias("ok"))
    first = e.groupBy("user_id").agg(F.min(F.when(C("ok"), F.struct("ts", "event_id"))).alias("f"))
    d = e.join(first, "user_id").groupBy("user_id").agg(
        F.when(F.max(C("f").isNotNull()), F.count_if(F.struct("ts", "event_id") <= C("f"))).alias("attempts"))
    return d.groupBy("attempts").agg(F.count(lit(1)).alias("n"))


