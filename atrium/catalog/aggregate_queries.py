"""Aggregations: plan metrics, dataset statistics, summaries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.labels import strict_json, type_group
from ..operators import graph as N
from ..operators import spatial as S
from ..operators.ranking import quantiles
from ..plans import metrics as M
from ..plans import shape as P
from ..plans import stats as T
from ..plans.norms import example_rules, failed_rules, norm_results, norm_summary
from ..plans.rules import room_attributes
from ..session import checkpointed, kept_rows
from ..sources.outputs import accounting, parse_outputs
from ..vocab import COUNTED_ROOMS, HABITABLE, NOT_DWELLING, ROOM_TYPES, STAT_TYPES
from .base import CTE, query

C, lit = F.col, F.lit
R9 = lambda d, *cols: d.select(*[F.round(c, 9).alias(c) if c in cols else C(c) for c in d.columns])

CTE["plan_n"] = "SELECT plan_id, count(*) AS n FROM rooms GROUP BY plan_id"


@query("plan_counts", "SELECT p.plan_id, count(r.idx) AS n_rooms, " + ", ".join(
    f"count(*) FILTER (r.type = '{t}') AS n_{t}" for t in ROOM_TYPES) + " FROM plans p LEFT JOIN rooms r ON p.plan_id = r.plan_id GROUP BY p.plan_id")
def plan_counts(t):
    return M.plan_counts(t.plans, t.rooms)


CTE["shares"] = """SELECT p.plan_id, avg(CASE WHEN r.aspect > t.max_aspect THEN 1.0 ELSE 0.0 END::DOUBLE) AS frac_aspect_violation,
    avg(CASE WHEN p.scale_known THEN (r.area_cm2 < t.min_area * 10000)::INT END) AS frac_area_violation,
    avg(CASE WHEN p.scale_known THEN (r.width_cm < t.min_width * 100)::INT END) AS frac_width_violation, avg(r.aspect) AS mean_aspect
  FROM plans p JOIN room_attrs r ON p.plan_id = r.plan_id JOIN thresholds t ON t.type = r.type_canonical GROUP BY p.plan_id"""


@query("plan_shares", """SELECT p.plan_id, round(frac_aspect_violation, 9) AS frac_aspect_violation, round(frac_area_violation, 9) AS frac_area_violation,
  round(frac_width_violation, 9) AS frac_width_violation, round(mean_aspect, 9) AS mean_aspect FROM plans p LEFT JOIN shares s ON p.plan_id = s.plan_id""")
def plan_shares(t):
    d = M.plan_shares(t.plans, t.rooms, t.thresholds)
    return R9(d, *d.columns[1:])


CTE["rule_rows"] = """SELECT p.plan_id, p.dataset, p.variant, s.* EXCLUDE (plan_id), (n.area_sum - u.union_cm2)::DOUBLE / u.union_cm2 AS overlap_ratio,
    h.hole_cm2::DOUBLE / (h.closed_cm2 + h.hole_cm2) AS hole_ratio, c.k AS adj_components, n.n AS n_rooms
  FROM plans p LEFT JOIN shares s ON p.plan_id = s.plan_id LEFT JOIN plan_union u ON p.plan_id = u.plan_id LEFT JOIN plan_holes h ON p.plan_id = h.plan_id
  LEFT JOIN (SELECT plan_id, count(DISTINCT comp) AS k FROM adj_comp GROUP BY plan_id) c ON p.plan_id = c.plan_id
  LEFT JOIN (SELECT plan_id, count(*) AS n, sum((x1 - x0) * (y1 - y0)) AS area_sum FROM rooms GROUP BY plan_id) n ON p.plan_id = n.plan_id"""
CTE["rule_flags"] = """SELECT *, CASE WHEN n_rooms IS NOT NULL THEN coalesce(overlap_ratio > 0.02, false) OR coalesce(hole_ratio > 0.02, false) OR coalesce(adj_components > 1, false)
   OR coalesce(frac_aspect_violation > 0, false) OR coalesce(frac_area_violation > 0, false) OR coalesce(frac_width_violation > 0, false) END AS any_rule FROM rule_rows"""


def rule_rows(t):
    """Every rule metric per plan; the flag stays missing for plans without rooms."""
    from .spatial_queries import closed
    ov = P.overlap_ratio(t.rooms, t.large).select("plan_id", "overlap_ratio")
    ho = P.hole_ratio(closed(t), t.large, t.dealt).select("plan_id", "hole_ratio")
    comp = N.components(t.rooms, t.adj, t.large).filter("idx = comp").groupBy("plan_id").agg(F.count(lit(1)).alias("adj_components"))
    n = t.rooms.groupBy("plan_id").agg(F.count(lit(1)).alias("n_rooms"))
    plans = t.dealt_plans
    # a row per plan each, written between, so that one task does not hold the sorts of all of them
    ov, ho, comp = (kept_rows(x, ["plan_id"], t.dealt) for x in (ov, ho, comp))
    d = plans.select("plan_id", "dataset", "variant").join(M.plan_shares(plans, t.rooms, t.thresholds).hint("merge"), "plan_id", "left")
    for x in (ov, ho, comp, n):
        d = d.join(x.hint("merge"), "plan_id", "left")
    flag = M.any_rule(C("overlap_ratio"), C("hole_ratio"), C("adj_components"), C("frac_aspect_violation"),
                      C("frac_area_violation"), C("frac_width_violation"))
    return d.withColumn("any_rule", F.when(C("n_rooms").isNotNull(), flag))


@query("any_rule", "SELECT plan_id, any_rule FROM rule_flags")
def any_rule(t):
    return rule_rows(t).select("plan_id", "any_rule")


RULE_COLS = ["frac_aspect_violation", "frac_area_violation", "frac_width_violation", "mean_aspect", "overlap_ratio", "hole_ratio", "adj_components"]


@query("rule_report", "SELECT dataset, count(*) AS n_plans, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in RULE_COLS)
       + ", round(avg(any_rule::INT), 6) AS any_rule_violation FROM rule_flags GROUP BY dataset")
def rule_report(t):
    return rule_rows(t).groupBy("dataset").agg(F.count(lit(1)).alias("n_plans"), *[F.round(F.avg(c), 6).alias(c) for c in RULE_COLS],
                                               F.round(F.avg(C("any_rule").cast("int")), 6).alias("any_rule_violation"))


SUM_COLS = ["n_rooms", *[f"n_{x}" for x in ROOM_TYPES]]


@query("summarize", "SELECT dataset, " + ", ".join(
    ["round(avg(n_rooms), 6) AS n_rooms"] + [f"round(avg(n_{x}), 6) AS n_{x}" for x in ROOM_TYPES])
    + ", round(avg(mean_aspect), 6) AS mean_aspect FROM (SELECT p.plan_id, p.dataset, count(r.idx) AS n_rooms, avg(r.aspect) AS mean_aspect, "
    + ", ".join(f"count(*) FILTER (r.type_canonical = '{x}') AS n_{x}" for x in ROOM_TYPES)
    + " FROM plans p LEFT JOIN room_attrs r ON p.plan_id = r.plan_id GROUP BY p.plan_id, p.dataset) GROUP BY dataset")
def summarize(t):
    d = M.plan_counts(t.plans, t.rooms).join(M.plan_shares(t.plans, t.rooms, t.thresholds).select("plan_id", "mean_aspect"), "plan_id")
    return M.summarize(d.join(t.plans.select("plan_id", "dataset"), "plan_id").drop("plan_id"), ["dataset"])


CTE["paired"] = """SELECT g.gen_id, coalesce(e.plan_id, b.plan_id)::VARCHAR AS gt_id FROM gen_ids g LEFT JOIN plans e ON g.gen_id = e.plan_id::VARCHAR
  LEFT JOIN plans b ON e.plan_id IS NULL AND regexp_replace(g.gen_id, '_[0-9]+$', '') = b.plan_id::VARCHAR"""


def pairs(t):
    return M.pair_ids(t.gen_ids, t.plans.select(C("plan_id").cast("string").alias("gt_id")))


@query("pair_gt", "SELECT * FROM paired")
def pair_gt(t):
    return pairs(t)


@query("yield", """SELECT CAST(sum(n) AS BIGINT) AS n_samples, (SELECT count(*) FROM plans) AS n_inputs,
  round(sum(n)::DOUBLE / ((SELECT count(*) FROM plans) * max(n) FILTER (gt_id IS NOT NULL)), 9) AS yield FROM (SELECT gt_id, count(*) AS n FROM paired GROUP BY gt_id)""")
def yield_(t):
    return M.yield_share(pairs(t), t.plans)


def srooms(t):
    return T.stat_rooms(t.dealt_plans, t.rooms)


CTE["stat_types"] = "SELECT unnest([" + ",".join(f"'{x}'" for x in STAT_TYPES) + "]) AS type"
CTE["comp_stats"] = """SELECT g.dataset, g.type, coalesce(c.w, 0)::DOUBLE / g.n AS presence, coalesce(c.s, 0)::DOUBLE / g.n AS mean_count
  FROM (SELECT dataset, count(*) AS n, t.type FROM plans, stat_types t GROUP BY dataset, t.type) g LEFT JOIN (
    SELECT dataset, type, count(*) AS w, sum(k) AS s FROM (SELECT p.dataset, p.plan_id, r.type, count(*) AS k FROM stat_rooms r JOIN plans p ON r.plan_id = p.plan_id GROUP BY ALL) GROUP BY ALL) c
  ON g.dataset = c.dataset AND g.type = c.type"""


@query("composition", "SELECT dataset, type, round(presence, 9) AS presence, round(mean_count, 9) AS mean_count FROM comp_stats")
def composition(t):
    return R9(T.composition(t.plans, srooms(t)), "presence", "mean_count")


CTE["pct_stats"] = """SELECT p.dataset, r.type, count(*) AS n_rooms, quantile_cont(area_cm2, 0.05) AS area_p5, quantile_cont(area_cm2, 0.5) AS area_p50, quantile_cont(area_cm2, 0.95) AS area_p95,
  quantile_cont(width_cm, 0.05) AS width_p5, quantile_cont(width_cm, 0.5) AS width_p50, quantile_cont(width_cm, 0.95) AS width_p95
  FROM room_attrs r JOIN plans p ON r.plan_id = p.plan_id GROUP BY p.dataset, r.type"""
PCT = [f"{a}_p{q}" for a in ("area", "width") for q in (5, 50, 95)]


@query("area_percentiles", "SELECT dataset, type, n_rooms, " + ", ".join(f"round({c}, 6) AS {c}" for c in PCT) + " FROM pct_stats")
def area_percentiles(t):
    d = T.area_percentiles(srooms(t))
    return d.select("dataset", "type", "n_rooms", *[F.round(c, 6).alias(c) for c in PCT])


@query("quantile_uda", "SELECT round(quantile_cont(l_extendedprice, 0.05), 6) AS p5, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95, l_returnflag FROM lineitem GROUP BY l_returnflag")
def quantile_uda(t):
    d = quantiles(t.raw("lineitem"), ["l_returnflag"], "l_extendedprice", [0.05, 0.5, 0.95])
    return d.select("l_returnflag", *[F.round(c, 6).alias(c) for c in ("p5", "p50", "p95")])


CTE["viol_stats"] = """SELECT p.dataset, r.type, count(*) AS n_rooms, avg((area_cm2 < min_area * 10000)::INT) AS below_min_area,
  avg((width_cm < min_width * 100)::INT) AS below_min_width, avg((aspect > max_aspect)::INT) FILTER (max_aspect IS NOT NULL) AS above_max_aspect
  FROM room_attrs r JOIN plans p ON r.plan_id = p.plan_id JOIN thresholds t ON t.type = r.type_canonical GROUP BY p.dataset, r.type"""


@query("violations", "SELECT dataset, type, n_rooms, round(below_min_area, 9) AS below_min_area, round(below_min_width, 9) AS below_min_width, round(above_max_aspect, 9) AS above_max_aspect FROM viol_stats")
def violations(t):
    return R9(T.violations(srooms(t), t.thresholds), "below_min_area", "below_min_width", "above_max_aspect")


CTE["tedges"] = """SELECT DISTINCT p.dataset, e.kind, e.plan_id, e.i, e.j, a.type AS ta, b.type AS tb FROM edges e JOIN plans p ON e.plan_id = p.plan_id
  JOIN stat_rooms a ON e.plan_id = a.plan_id AND e.i = a.idx JOIN stat_rooms b ON e.plan_id = b.plan_id AND e.j = b.idx"""


def tedges(t):
    return kept_rows(T.typed_edges(t.edges, srooms(t)), ["plan_id"], t.dealt)


@query("conn_p_room", """WITH nb AS (SELECT dataset, kind, plan_id, i AS idx, ta AS type, tb AS nb FROM tedges UNION SELECT dataset, kind, plan_id, j, tb, ta FROM tedges)
  SELECT k.dataset, k.kind, k.type AS type_a, k.nb AS type_b, round(k.k::DOUBLE / n.n, 9) AS p_room FROM (SELECT dataset, kind, type, nb, count(*) AS k FROM nb GROUP BY ALL) k
  JOIN (SELECT dataset, type, count(*) AS n FROM stat_rooms r JOIN plans p ON r.plan_id = p.plan_id GROUP BY ALL) n ON k.dataset = n.dataset AND k.type = n.type""")
def conn_p_room(t):
    return R9(T.p_room(tedges(t), srooms(t)), "p_room")


@query("conn_p_plan", """WITH c AS (SELECT p.dataset, r.plan_id, r.type, count(*) AS c FROM stat_rooms r JOIN plans p ON r.plan_id = p.plan_id GROUP BY ALL),
  b AS (SELECT a.dataset, a.type AS type_a, b.type AS type_b, count(*) AS n FROM c a JOIN c b ON a.plan_id = b.plan_id AND (a.type < b.type OR (a.type = b.type AND a.c >= 2)) GROUP BY ALL),
  k AS (SELECT dataset, kind, type_a, type_b, count(*) AS k FROM (SELECT DISTINCT dataset, kind, plan_id, least(ta, tb) AS type_a, greatest(ta, tb) AS type_b FROM tedges) GROUP BY ALL)
  SELECT b.dataset, d.kind, b.type_a, b.type_b, round(coalesce(k.k, 0)::DOUBLE / b.n, 9) AS p_plan, b.n AS n_plans_both FROM b CROSS JOIN (SELECT unnest(['wall', 'door']) AS kind) d
  LEFT JOIN k ON k.dataset = b.dataset AND k.kind = d.kind AND k.type_a = b.type_a AND k.type_b = b.type_b""")
def conn_p_plan(t):
    return R9(T.p_plan(tedges(t), srooms(t)), "p_plan")


CTE["edge_means"] = """SELECT t.dataset, kind, least(ta, tb) AS type_a, greatest(ta, tb) AS type_b, count(*)::DOUBLE / n.n AS mean_edges FROM tedges t
  JOIN (SELECT dataset, count(*) AS n FROM plans GROUP BY dataset) n ON t.dataset = n.dataset GROUP BY t.dataset, kind, 3, 4, n.n"""


@query("conn_mean_edges", "SELECT dataset, kind, type_a, type_b, round(mean_edges, 9) AS mean_edges FROM edge_means")
def conn_mean_edges(t):
    return R9(T.mean_edges(tedges(t), t.plans), "mean_edges")


@query("average_graph", """SELECT dataset, 'node' AS kind, type AS a, NULL::VARCHAR AS b, round(mean_count, 9) AS value FROM comp_stats WHERE mean_count >= 0.1
  UNION ALL SELECT e.dataset, kind, type_a, type_b, round(mean_edges, 9) FROM edge_means e WHERE mean_edges >= 0.02
   AND EXISTS (FROM comp_stats c WHERE c.dataset = e.dataset AND c.type = e.type_a AND c.mean_count >= 0.1)
   AND EXISTS (FROM comp_stats c WHERE c.dataset = e.dataset AND c.type = e.type_b AND c.mean_count >= 0.1)""")
def average_graph(t):
    d = T.average_graph(T.composition(t.plans, srooms(t)), T.mean_edges(tedges(t), t.plans), 0.1, 0.02)
    return R9(d, "value")


@query("dataset_info", """SELECT dataset, count(*) AS n_samples, round(avg(coalesce(n, 0)), 6) AS mean_rooms, round(avg(CASE WHEN scale_known THEN union_cm2 END), 3) AS mean_area_cm2,
  CASE WHEN avg(coalesce(d.k, 0)) >= 0.5 THEN 'wall+door' ELSE 'wall' END AS kinds FROM plans p LEFT JOIN plan_n n ON p.plan_id = n.plan_id
  LEFT JOIN plan_union u ON p.plan_id = u.plan_id LEFT JOIN (SELECT plan_id, count(*) AS k FROM door_edges GROUP BY plan_id) d ON p.plan_id = d.plan_id GROUP BY dataset""")
def dataset_info(t):
    d = T.dataset_info(t.plans, t.rooms, P.overlap_ratio(t.rooms, t.large), t.door_edges)
    return d.withColumn("mean_rooms", F.round("mean_rooms", 6)).withColumn("mean_area_cm2", F.round("mean_area_cm2", 3))


CTE["type_diff"] = """SELECT coalesce(g.plan_id, r.plan_id) AS plan_id, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM (SELECT plan_id, type, count(*) AS a FROM gen_rooms GROUP BY ALL) g
  FULL JOIN (SELECT plan_id, type, count(*) AS b FROM rooms GROUP BY ALL) r ON g.plan_id = r.plan_id AND g.type = r.type"""


@query("type_multiset", """SELECT plan_id, abs(CAST(sum(a) - sum(b) AS BIGINT)) AS room_count_abs_err, sum(a) = sum(b) AS room_count_match, CAST(sum(abs(a - b)) AS BIGINT) AS type_hist_l1,
  sum(abs(a - b)) = 0 AS type_multiset_match FROM type_diff GROUP BY plan_id""")
def type_multiset(t):
    return M.type_multiset(t.gen_rooms, t.rooms)


CTE["gen_adj"] = CTE["adj"].replace("FROM rooms a JOIN rooms b", "FROM gen_rooms a JOIN gen_rooms b")


@query("multiset_f1", """WITH g AS (SELECT e.plan_id, least(a.type, b.type) AS ta, greatest(a.type, b.type) AS tb, count(*) AS p FROM gen_adj e JOIN gen_rooms a ON e.plan_id = a.plan_id AND e.i = a.idx
    JOIN gen_rooms b ON e.plan_id = b.plan_id AND e.j = b.idx GROUP BY ALL),
  r AS (SELECT e.plan_id, least(a.type, b.type) AS ta, greatest(a.type, b.type) AS tb, count(*) AS r FROM adj e JOIN rooms a ON e.plan_id = a.plan_id AND e.i = a.idx
    JOIN rooms b ON e.plan_id = b.plan_id AND e.j = b.idx GROUP BY ALL),
  s AS (SELECT coalesce(g.plan_id, r.plan_id) AS plan_id, sum(p) AS np, sum(r) AS nr, sum(least(coalesce(p, 0), coalesce(r, 0))) AS tp FROM g FULL JOIN r ON g.plan_id = r.plan_id AND g.ta = r.ta AND g.tb = r.tb GROUP BY 1)
  SELECT p.plan_id, round(CASE WHEN s.plan_id IS NULL THEN 1.0 WHEN np IS NULL OR nr IS NULL THEN 0.0 ELSE 2.0 * tp / (np + nr) END::DOUBLE, 9) AS adjacency_f1 FROM plans p LEFT JOIN s ON p.plan_id = s.plan_id""")
def multiset_f1(t):
    gen_adj = S.wall_adjacency(t.gen_rooms, large=t.large)
    d = M.multiset_f1(M.typed_pairs(gen_adj, t.gen_rooms), M.typed_pairs(t.adj, t.rooms), t.plans)
    return R9(d, "adjacency_f1")


CTE["norm_facts"] = """SELECT plan_id, type_canonical AS subject, idx AS item, 'area_m2' AS parameter, area_cm2 / 10000 AS value FROM room_attrs
  UNION ALL SELECT plan_id, type_canonical, idx, 'width_m', width_cm / 100 FROM room_attrs
  UNION ALL SELECT plan_id, type_canonical, idx, 'depth_m', depth_cm / 100 FROM room_attrs
  UNION ALL SELECT plan_id, 'door', k, 'door_clear_width', greatest(x1 - x0, y1 - y0) / 100 - plan_id % 4 * 0.05 FROM doors
  UNION ALL SELECT plan_id, 'dwelling', 0, 'area_m2', coalesce(sum(area_cm2) FILTER (type_canonical NOT IN ('balcony','outdoor','garage')), 0) / 10000 FROM room_attrs GROUP BY plan_id"""
CTE["norm_rows"] = """SELECT p.plan_id, r.rule, r.parameter, r.bindingness, CASE WHEN count(f.value) = 0 THEN 'not measured' WHEN min((f.value >= r.threshold)::INT) = 1 THEN 'met' ELSE 'not met' END AS result
  FROM plans p CROSS JOIN norm_rules r LEFT JOIN norm_facts f ON f.plan_id = p.plan_id AND f.subject = r.subject AND f.parameter = r.parameter WHERE p.scale_known GROUP BY ALL"""
CTE["norm_plans"] = """SELECT plan_id, count(*) FILTER (b AND result <> 'not measured') AS n_binding_checked, count(*) FILTER (b AND result = 'not met') AS n_binding_not_met,
  count(*) FILTER (b AND result = 'not met') > 0 AS any_binding_not_met, count(*) FILTER (b AND result = 'not met' AND parameter <> 'door_clear_width') > 0 AS any_binding_not_met_excl_doors,
  count(*) FILTER (NOT b AND result = 'not met') AS n_other_not_met, coalesce(string_agg(rule, ';' ORDER BY rule) FILTER (b AND result = 'not met'), '') AS failed_rules
  FROM (SELECT *, bindingness IN ('law', 'model_code') AS b FROM norm_rows) GROUP BY plan_id"""


@query("failed_rules", "SELECT rule, count(*) AS n_plans, round(count(*)::DOUBLE / (SELECT count(*) FROM norm_plans), 9) AS share_of_plans FROM (SELECT plan_id, unnest(string_split(failed_rules, ';')) AS rule FROM norm_plans WHERE failed_rules <> '') GROUP BY rule ORDER BY n_plans DESC, rule LIMIT 10")
def failed_rules_(t):
    return R9(failed_rules(norm_results(t)), "share_of_plans")


@query("norm_summary", """SELECT p.dataset, count(*) AS n_plans, round(avg(any_binding_not_met::INT), 9) AS share_breaking, round(avg(any_binding_not_met_excl_doors::INT), 9) AS share_breaking_excl_doors,
  round(avg(n_binding_checked), 9) AS mean_binding_checked, round(avg(n_binding_not_met), 9) AS mean_binding_not_met FROM norm_plans n JOIN plans p ON n.plan_id = p.plan_id GROUP BY p.dataset""")
def norm_summary_(t):
    d = norm_summary(norm_results(t).join(t.dealt_plans.select("plan_id", "dataset").hint("merge"), "plan_id"), ["dataset"])
    return R9(d, *d.columns[2:])


@query("home_rollup", """SELECT s.home, count(DISTINCT s.storey) AS n_storeys, count(r.idx) AS n_rooms, CAST(coalesce(sum(area_cm2) FILTER (type_canonical NOT IN ('outdoor', 'other')), 0) AS BIGINT) AS net_cm2,
  CAST(coalesce(sum(area_cm2) FILTER (type_canonical = 'other'), 0) AS BIGINT) AS stair_cm2, count(*) FILTER (type_canonical = 'bedroom') AS n_bedroom FROM storeys s LEFT JOIN room_attrs r ON s.plan_id = r.plan_id GROUP BY s.home""")
def home_rollup(t):
    return homes(t)


def homes(t):
    """Per home over its storeys: counts and areas, stairs apart."""
    r = room_attributes(t.rooms).select("plan_id", "idx", "type", "area_cm2")
    d = t.storeys.join(r, "plan_id", "left").groupBy("home", "storey").agg(
        F.count("idx").alias("n"), F.sum(F.when(~C("type").isin("outdoor", "other"), C("area_cm2"))).alias("net"),
        F.sum(F.when(C("type") == "other", C("area_cm2"))).alias("stair"), F.count(F.when(C("type") == "bedroom", 1)).alias("bed"))
    return d.groupBy("home").agg(F.count(lit(1)).alias("n_storeys"), F.sum("n").alias("n_rooms"), F.coalesce(F.sum("net"), lit(0)).alias("net_cm2"),
                                 F.coalesce(F.sum("stair"), lit(0)).alias("stair_cm2"), F.sum("bed").alias("n_bedroom"))


CTE["home_rows"] = """SELECT s.home, count(DISTINCT s.storey) AS n_storeys, count(r.idx) AS n_rooms, coalesce(sum(area_cm2) FILTER (type_canonical NOT IN ('outdoor', 'other')), 0) AS net_cm2
  FROM storeys s LEFT JOIN room_attrs r ON s.plan_id = r.plan_id GROUP BY s.home"""


@query("group_by_storeys", """SELECT CASE WHEN grouping(n_storeys) = 1 THEN 'all' ELSE n_storeys || ' storeys' END AS grp, count(*) AS n, round(avg(n_rooms), 6) AS mean_rooms, round(avg(net_cm2), 3) AS mean_net_cm2
  FROM home_rows GROUP BY ROLLUP (n_storeys)""")
def group_by_storeys(t):
    d = homes(t).rollup("n_storeys").agg(F.grouping("n_storeys").alias("g"), F.count(lit(1)).alias("n"), F.round(F.avg("n_rooms"), 6).alias("mean_rooms"),
                                         F.round(F.avg("net_cm2"), 3).alias("mean_net_cm2"))
    return d.select(F.when(C("g") == 1, "all").otherwise(F.concat(C("n_storeys"), lit(" storeys"))).alias("grp"), "n", "mean_rooms", "mean_net_cm2")


@query("window_floor_ratio", """WITH w AS (SELECT plan_id, room, sum(width_cm * (head_cm - sill_cm)) AS win FROM windows GROUP BY ALL),
  has AS (SELECT DISTINCT plan_id FROM windows),
  r AS (SELECT a.plan_id, coalesce(w.win, 0)::DOUBLE / area_cm2 AS ratio FROM room_attrs a JOIN has ON a.plan_id = has.plan_id LEFT JOIN w ON a.plan_id = w.plan_id AND a.idx = w.room
        WHERE type_canonical IN ('living_room','kitchen','bedroom','dining_room','study'))
  SELECT p.plan_id, round(min(ratio), 9) AS min_ratio, round(avg((ratio >= 0.125)::INT), 9) AS share_ge_1_8, round(avg((ratio >= 0.1)::INT), 9) AS share_ge_1_10 FROM plans p LEFT JOIN r ON p.plan_id = r.plan_id GROUP BY p.plan_id""")
def window_floor_ratio(t):
    """Window area over floor area of habitable rooms; plans without any window are not measured."""
    w = t.windows.groupBy("plan_id", C("room").alias("idx")).agg(F.sum(C("width_cm") * (C("head_cm") - C("sill_cm"))).alias("win"))
    has = t.windows.select("plan_id").distinct()
    r = room_attributes(t.rooms).filter(C("type").isin(HABITABLE)).join(has, "plan_id", "left_semi").join(w, ["plan_id", "idx"], "left")
    r = r.withColumn("ratio", F.coalesce("win", lit(0)) / C("area_cm2"))
    d = r.groupBy("plan_id").agg(F.min("ratio").alias("min_ratio"), F.avg((C("ratio") >= 0.125).cast("int")).alias("share_ge_1_8"),
                                 F.avg((C("ratio") >= 0.1).cast("int")).alias("share_ge_1_10"))
    return R9(t.plans.select("plan_id").join(d, "plan_id", "left"), *d.columns[1:])


FEATS = ["n_rooms", "total", "bedrooms", "baths", "halls", "aspect"]
CTE["plan_feats"] = """SELECT p.plan_id, CASE WHEN p.dataset = 'F' THEN 'ours' WHEN p.dataset = 'O' THEN 'real' END AS side, count(*) AS n_rooms, sum(area_cm2) / 10000 AS total, count(*) FILTER (type_canonical = 'bedroom') AS bedrooms,
  count(*) FILTER (type_canonical = 'bathroom') AS baths, count(*) FILTER (r.type = 'hallway') AS halls, avg(least(aspect, 10)) AS aspect FROM room_attrs r JOIN plans p ON r.plan_id = p.plan_id WHERE p.dataset IN ('F', 'O') GROUP BY p.plan_id, p.dataset"""


def plan_feats(t):
    """Small per-plan feature table of two datasets."""
    r = room_attributes(t.rooms).join(t.plans.filter(C("dataset").isin("F", "O")).select("plan_id", "dataset"), "plan_id")
    return r.groupBy("plan_id", F.when(C("dataset") == "F", "ours").otherwise("real").alias("side")).agg(
        F.count(lit(1)).alias("n_rooms"), (F.sum("area_cm2") / 10000).alias("total"), F.count(F.when(C("type") == "bedroom", 1)).alias("bedrooms"),
        F.count(F.when(C("type") == "bathroom", 1)).alias("baths"), F.count(F.when(type_group(C("type")) == "hallway", 1)).alias("halls"),
        F.avg(F.least(C("aspect"), lit(10.0))).alias("aspect"))


@query("cohens_d", "WITH u AS (UNPIVOT (SELECT side, " + ", ".join(f"{c}::DOUBLE AS {c}" for c in FEATS) + " FROM plan_feats) ON " + ", ".join(FEATS) + """ INTO NAME feature VALUE v),
  m AS (SELECT feature, avg(v) FILTER (side = 'ours') AS a, avg(v) FILTER (side = 'real') AS b, var_pop(v) FILTER (side = 'ours') AS va, var_pop(v) FILTER (side = 'real') AS vb FROM u GROUP BY feature)
  SELECT feature, round((a - b) / (sqrt((va + vb) / 2) + 1e-9), 6) AS d, round(a, 6) AS ours, round(b, 6) AS real FROM m ORDER BY abs((a - b) / (sqrt((va + vb) / 2) + 1e-9)) DESC LIMIT 8""")
def cohens_d(t):
    f = plan_feats(t)
    long = f.select("side", F.inline(F.array(*[F.struct(lit(c).alias("feature"), C(c).cast("double").alias("v")) for c in FEATS])))
    o, r = C("side") == "ours", C("side") == "real"
    m = long.groupBy("feature").agg(F.avg(F.when(o, C("v"))).alias("a"), F.avg(F.when(r, C("v"))).alias("b"),
                                    F.var_pop(F.when(o, C("v"))).alias("va"), F.var_pop(F.when(r, C("v"))).alias("vb"))
    d = m.withColumn("d", (C("a") - C("b")) / (F.sqrt((C("va") + C("vb")) / 2) + 1e-9)).orderBy(F.desc(F.abs("d"))).limit(8)
    return d.select("feature", F.round("d", 6).alias("d"), F.round("a", 6).alias("ours"), F.round("b", 6).alias("real"))


@query("within_p5_p95", """SELECT g.type, round(avg((((g.x1 - g.x0) * (g.y1 - g.y0)) BETWEEN q.lo AND q.hi)::INT), 9) AS share, count(*) AS n FROM gen_rooms g JOIN (
   SELECT type_canonical AS type, quantile_cont(area_cm2, 0.05) AS lo, quantile_cont(area_cm2, 0.95) AS hi FROM room_attrs GROUP BY 1) q ON g.type = q.type GROUP BY g.type""")
def within_p5_p95(t):
    q = quantiles(room_attributes(t.rooms), ["type"], "area_cm2", [0.05, 0.95])
    g = room_attributes(t.gen_rooms).join(F.broadcast(q.select("type", "p5", "p95")), "type")
    return g.groupBy("type").agg(F.round(F.avg(C("area_cm2").between(C("p5"), C("p95")).cast("int")), 9).alias("share"), F.count(lit(1)).alias("n"))


@query("event_accounting", """SELECT event_type, count(*) AS requested, count(*) FILTER (length(text) > 0) AS generated, count(*) FILTER (json_valid(text)) AS parsed,
  count(*) FILTER (json_valid(text) AND CAST(json_extract(CASE WHEN json_valid(text) THEN text END, '$.k') AS BIGINT) >= 10) AS valid, count(*) FILTER (NOT text LIKE '%}%') AS truncated,
  count(*) FILTER (json_valid(text) AND CAST(json_extract(CASE WHEN json_valid(text) THEN text END, '$.k') AS BIGINT) % 10 = user_id % 10) AS id_match FROM raw_text GROUP BY event_type""")
def event_accounting(t):
    j = strict_json(C("text"))
    d = t.raw_text.withColumn("ok", j.isNotNull()).withColumn("k", F.try_variant_get(j, "$.k", "bigint"))
    return d.groupBy("event_type").agg(
        F.count(lit(1)).alias("requested"), F.count_if(F.length("text") > 0).alias("generated"), F.count_if("ok").alias("parsed"),
        F.count_if(C("k") >= 10).alias("valid"), F.count_if(~C("text").contains("}")).alias("truncated"),
        F.count_if(C("k") % 10 == C("user_id") % 10).alias("id_match"))


@query("parse_accounting", """WITH s AS (SELECT plan_id, idx, pk, turned, status, count(*) FILTER (status <> 'unparseable') AS n_out, count(*) FILTER (bad AND status <> 'unparseable') AS n_bad,
    coalesce(list(label ORDER BY label) FILTER (NOT bad AND status <> 'unparseable'), []) AS types,
    coalesce(list(w ORDER BY w) FILTER (NOT (pk % 5 = 0 AND j = pk % 3)), []) AS wanted FROM (SELECT *, CASE WHEN pk % 10 = 3 AND j = 0 THEN 'WC' ELSE label END AS w FROM answers) GROUP BY plan_id, idx, pk, turned, status)
  SELECT CASE WHEN turned THEN 'rows' ELSE 'columns' END AS dataset, count(*) AS requested, count(*) FILTER (pk % 13 <> 0) AS generated, count(*) FILTER (status = 'json') AS n_json,
    count(*) FILTER (status = 'json_prefix') AS n_json_prefix, count(*) FILTER (status = 'repaired') AS n_repaired, count(*) FILTER (status = 'unparseable') AS n_unparseable,
    count(*) FILTER (len(types) > 0) AS valid, count(*) FILTER (len(types) > 0 AND n_bad = 0) AS valid_all, count(*) FILTER (pk % 7 = 0 AND pk % 31 <> 0) AS truncated,
    count(*) FILTER (len(types) > 0 AND len(types) = len(wanted)) AS count_match, count(*) FILTER (len(types) > 0 AND types = wanted) AS type_match,
    CAST(sum(n_out) AS BIGINT) AS n_output, CAST(sum(n_bad) AS BIGINT) AS n_dropped FROM s GROUP BY turned""")
def parse_accounting(t):
    """Answers by dataset: read or not, valid, cut short, and agreeing with the wanted rooms."""
    return accounting(parse_outputs(t.outputs, C("dataset") == "rows"), ["dataset"])


@query("split_counts", """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN n.n IS NULL THEN 'empty' WHEN n.n > 8 THEN 'too_many_rooms' WHEN NOT p.scale_known THEN 'no_scale' ELSE 'converted' END AS reason
  FROM plans p LEFT JOIN plan_n n ON p.plan_id = n.plan_id) GROUP BY reason""")
def split_counts(t):
    n = t.rooms.groupBy("plan_id").agg(F.count(lit(1)).alias("n"))
    d = t.plans.join(n, "plan_id", "left")
    reason = F.when(C("n").isNull(), "empty").when(C("n") > 8, "too_many_rooms").when(~C("scale_known"), "no_scale").otherwise("converted")
    return d.groupBy(reason.alias("reason")).agg(F.count(lit(1)).alias("n"))


@query("layout_totals", "SELECT count(DISTINCT variant) AS n_variants, count(*) AS n_plans, count(DISTINCT dataset) AS n_datasets, count(*) FILTER (dataset = 'O') AS n_real FROM plans")
def layout_totals(t):
    return t.plans.agg(F.count_distinct("variant").alias("n_variants"), F.count(lit(1)).alias("n_plans"), F.count_distinct("dataset").alias("n_datasets"),
                       F.count_if(C("dataset") == "O").alias("n_real"))


@query("dwelling_facts", """SELECT plan_id, coalesce(sum(area_cm2) FILTER (type_canonical NOT IN ('balcony','outdoor','garage')), 0) / 10000 AS area_m2,
  count(*) FILTER (type_canonical IN ('living_room','bedroom','study','dining_room')) AS rooms_count FROM room_attrs GROUP BY plan_id""")
def dwelling_facts(t):
    r = room_attributes(t.rooms)
    return r.groupBy("plan_id").agg((F.coalesce(F.sum(F.when(~C("type").isin(NOT_DWELLING), C("area_cm2"))), lit(0)) / 10000).alias("area_m2"),
                                    F.count_if(C("type").isin(COUNTED_ROOMS)).alias("rooms_count"))


SH = ["living_room", "kitchen", "bedroom", "bathroom", "balcony", "hallway"]


@query("share_features", "SELECT plan_id, " + ", ".join(
    f"round(coalesce(sum(area_cm2) FILTER (type = '{x}') / nullif(sum(area_cm2) FILTER (type IN ({','.join(repr(y) for y in SH)})), 0), 0), 9) AS share_{x}" for x in SH) + " FROM room_attrs GROUP BY plan_id")
def share_features(t):
    r = room_attributes(t.rooms).withColumn("type", type_group(C("type")))
    tot = F.nullif(F.sum(F.when(C("type").isin(SH), C("area_cm2"))), lit(0))
    return r.groupBy("plan_id").agg(*[F.round(F.coalesce(F.sum(F.when(C("type") == x, C("area_cm2"))) / tot, lit(0.0)), 9).alias(f"share_{x}") for x in SH])


@query("corner_distribution", "SELECT type, corners, count(*) AS n FROM (SELECT plan_id, idx, count(*) AS corners FROM ring_points GROUP BY ALL) c JOIN rooms r ON c.plan_id = r.plan_id AND c.idx = r.idx GROUP BY type, corners")
def corner_distribution(t):
    return t.rings.groupBy("type", F.size("ring").cast("long").alias("corners")).agg(F.count(lit(1)).alias("n"))


@query("adjacency_agreement", """WITH a AS (SELECT plan_id, i, j FROM adj), s AS (SELECT plan_id, a AS i, b AS j FROM program_edges),
  c AS (SELECT coalesce(a.plan_id, s.plan_id) AS plan_id, count(*) FILTER (a.i IS NOT NULL AND s.i IS NOT NULL) AS both, count(*) AS any_ FROM a FULL JOIN s ON a.plan_id = s.plan_id AND a.i = s.i AND a.j = s.j GROUP BY 1)
  SELECT n.n AS n_rooms, count(*) AS n_plans, round(avg(c.both::DOUBLE / c.any_), 9) AS mean_agreement FROM c JOIN plan_n n ON c.plan_id = n.plan_id GROUP BY n.n""")
def adjacency_agreement(t):
    k = ["plan_id", "i", "j"]
    a = t.adj.select(*k, lit(1).alias("x"))
    s = t.program_edges.select("plan_id", C("a").alias("i"), C("b").alias("j")).distinct().withColumn("y", lit(1))
    c = a.join(s, k, "full_outer").groupBy("plan_id").agg((F.count_if(C("x").isNotNull() & C("y").isNotNull()) / F.count(lit(1))).alias("v"))
    n = t.rooms.groupBy("plan_id").agg(F.count(lit(1)).alias("n_rooms"))
    return c.join(n, "plan_id").groupBy("n_rooms").agg(F.count(lit(1)).alias("n_plans"), F.round(F.avg("v"), 9).alias("mean_agreement"))


@query("usage_totals", """SELECT user_id, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k_total, count(*) AS calls, CAST(sum(floor(value)) AS BIGINT) AS tokens FROM events GROUP BY user_id""")
def usage_totals(t):
    """Integer counters of call logs summed per job: the logs arrive as a JSON map and are exploded by counter."""
    e = t.raw("events").select("user_id", F.from_json("props", "map<string,bigint>").alias("m"), F.floor("value").alias("v"))
    e = e.select("user_id", F.explode(F.map_concat("m", F.create_map(lit("calls"), lit(1).cast("bigint"), lit("tokens"), C("v")))).alias("counter", "n"))
    g = e.groupBy("user_id").pivot("counter", ["k", "calls", "tokens"]).agg(F.sum("n"))
    return g.select("user_id", C("k").alias("k_total"), "calls", "tokens")
