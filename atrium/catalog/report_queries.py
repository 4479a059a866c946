"""Norm checks and reports."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.ranking import hash_order, top_k
from ..plans import distribution as D
from ..plans import norms as K
from ..plans import report as B
from ..plans import stats as T
from ..session import checkpointed, kept_rows
from ..vocab import STAT_TYPES
from .aggregate_queries import R9, pairs, rule_rows, srooms, tedges
from .base import CTE, query
from .window_queries import mark_best

C, lit = F.col, F.lit


def facts(t):
    doors = t.doors.select("plan_id", "k", (F.greatest(C("x1") - C("x0"), C("y1") - C("y0")) / 100 - C("plan_id") % 4 * lit(0.05)).alias("clear_width"))
    return K.plan_facts(t.rooms, doors)


@query("plan_facts", "SELECT plan_id, subject, item, parameter, round(value, 6) AS value FROM norm_facts")
def plan_facts(t):
    return facts(t).withColumn("value", F.round("value", 6))


@query("check_norms", "SELECT plan_id, rule, bindingness, result FROM norm_rows")
def check_norms(t):
    return K.check_norms(t.dealt_plans.filter("scale_known"), facts(t), K.example_rules(t.spark)).select("plan_id", "rule", "bindingness", "result")


@query("norm_targets", """WITH s AS (SELECT plan_id, variant FROM (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY md5(plan_id || ':0'), plan_id) AS rn FROM plans WHERE scale_known) WHERE rn <= 3000)
  SELECT s.variant, count(*) AS n_plans, round(avg(any_binding_not_met::INT), 9) AS share_breaking FROM s JOIN norm_plans n ON s.plan_id = n.plan_id GROUP BY s.variant""")
def norm_targets(t):
    """Every target with a metric scale, at most 3,000 hash-drawn plans each."""
    pick = top_k(t.plans.filter("scale_known").select("plan_id", "variant"), ["variant"], [hash_order("plan_id"), "plan_id"], 3000)
    r = K.norm_results(t).join(pick.select("plan_id", "variant"), "plan_id")
    return r.groupBy("variant").agg(F.count(lit(1)).alias("n_plans"), F.round(F.avg(C("any_binding_not_met").cast("int")), 9).alias("share_breaking"))


@query("rule_table", "SELECT t.type, min_area, min_width, max_aspect, count(r.idx) AS n_rooms FROM thresholds t LEFT JOIN rooms r ON t.type = r.type GROUP BY ALL")
def rule_table(t):
    n = t.rooms.groupBy("type").agg(F.count(lit(1)).alias("n"))
    return t.thresholds.join(n, "type", "left").select("type", "min_area", "min_width", "max_aspect", F.coalesce("n", lit(0)).alias("n_rooms"))


@query("pivot_counts", "SELECT dataset, " + ", ".join(f"round(max(mean_count) FILTER (type = '{x}'), 9) AS {x}" for x in STAT_TYPES) + " FROM comp_stats GROUP BY dataset")
def pivot_counts(t):
    return R9(B.pivot_counts(T.composition(t.plans, srooms(t)), STAT_TYPES), *STAT_TYPES)


def _cell(a, b, c):
    f = lambda x: f"printf('%.1f', floor({x} / 1000 + 0.5) / 10)"
    return f"{f(a)} || ' / ' || {f(b)} || ' / ' || {f(c)}"


@query("pivot_areas", "SELECT dataset, " + ", ".join(f"max(cell) FILTER (type = '{x}') AS {x}" for x in STAT_TYPES)
       + f" FROM (SELECT dataset, type, {_cell('area_p5', 'area_p50', 'area_p95')} AS cell FROM pct_stats) GROUP BY dataset")
def pivot_areas(t):
    d = T.area_percentiles(srooms(t)).select("dataset", "type", B.area_cell(C("area_p5"), C("area_p50"), C("area_p95")).alias("cell"))
    return d.groupBy("dataset").pivot("type", STAT_TYPES).agg(F.first("cell"))


@query("pivot_connections", """WITH k AS (SELECT type_a, type_b, row_number() OVER (ORDER BY round(m, 9) DESC, type_a, type_b) AS rk FROM pair_means ORDER BY rk LIMIT 10)
  SELECT dataset, """ + ", ".join(f"round(max(mean_edges) FILTER (rk = {i}), 9) AS pair_{i}" for i in range(1, 11)) + " FROM edge_means e JOIN k ON e.type_a = k.type_a AND e.type_b = k.type_b WHERE kind = 'wall' GROUP BY dataset")
def pivot_connections(t):
    """The ten most frequent type pairs as columns, numbered by their mean over the datasets."""
    from pyspark.sql import Window as W
    m = T.mean_edges(tedges(t), t.plans).filter("kind = 'wall'")
    top = m.groupBy("type_a", "type_b").agg(F.round(F.avg("mean_edges"), 9).alias("m")).orderBy(F.desc("m"), "type_a", "type_b").limit(10)
    top = top.withColumn("rk", F.row_number().over(W.orderBy(F.desc("m"), "type_a", "type_b")))
    d = m.join(F.broadcast(top.select("type_a", "type_b", F.concat(lit("pair_"), C("rk")).alias("col"))), ["type_a", "type_b"])
    names = [f"pair_{i}" for i in range(1, 11)]
    return R9(d.groupBy("dataset").pivot("col", names).agg(F.first("mean_edges")), *names)


@query("blank_raster", """SELECT variant, variant LIKE '%H%' AS raster, CASE WHEN NOT variant LIKE '%H%' THEN round(avg(aspect), 6) END AS mean_aspect FROM room_attrs r JOIN plans p ON r.plan_id = p.plan_id GROUP BY variant""")
def blank_raster(t):
    d = srooms(t).join(t.plans.select("plan_id", "variant"), "plan_id").groupBy("variant").agg(F.round(F.avg("aspect"), 6).alias("mean_aspect"))
    return B.blank_raster(d.withColumn("raster", C("variant").contains("H")), "mean_aspect")


CTE["variant_means"] = "SELECT variant, dataset AS ref, count(*) AS n, round(avg(any_rule::INT), 6) AS any_rule_violation, round(avg(overlap_ratio), 6) AS overlap_ratio FROM rule_flags GROUP BY variant, dataset"


@query("variant_report", "SELECT * FROM variant_means")
def variant_report(t):
    return variant_means(t)


def variant_means(t):
    return rule_rows(t).groupBy("variant", C("dataset").alias("ref")).agg(
        F.count(lit(1)).alias("n"), F.round(F.avg(C("any_rule").cast("int")), 6).alias("any_rule_violation"), F.round(F.avg("overlap_ratio"), 6).alias("overlap_ratio"))


CTE["method_feats"] = """SELECT f.plan_id, f.role, p.variant, p.dataset AS ref, unnest(range(3)) AS k, unnest([n::DOUBLE, total, bedrooms::DOUBLE]) AS v FROM (
    SELECT plan_id, 'gen' AS role, count(*) AS n, sum((x1 - x0) * (y1 - y0)) / 10000 AS total, count(*) FILTER (type = 'bedroom') AS bedrooms FROM gen_rooms GROUP BY plan_id
    UNION ALL SELECT plan_id, CASE WHEN plan_id % 2 = 0 THEN 'ref' ELSE 'floor' END, count(*), sum((x1 - x0) * (y1 - y0)) / 10000, count(*) FILTER (type = 'bedroom') FROM rooms GROUP BY plan_id) f
  JOIN plans p ON f.plan_id = p.plan_id"""
CTE["method_scores"] = """WITH g AS (SELECT variant, ref, k, avg(v) AS mu, var_samp(v) AS var FROM method_feats WHERE role = 'gen' GROUP BY ALL),
  r AS (SELECT ref, role, k, avg(v) AS mu, var_samp(v) AS var FROM method_feats WHERE role <> 'gen' GROUP BY ALL),
  a AS (SELECT g.variant, g.ref, sum((g.mu - r.mu) ** 2 + g.var + r.var - 2 * sqrt(g.var * r.var)) AS fid FROM g JOIN r ON g.ref = r.ref AND g.k = r.k AND r.role = 'ref' GROUP BY ALL),
  b AS (SELECT x.ref, sum((x.mu - r.mu) ** 2 + x.var + r.var - 2 * sqrt(x.var * r.var)) AS fid_floor FROM r x JOIN r ON x.ref = r.ref AND x.k = r.k AND x.role = 'floor' AND r.role = 'ref' GROUP BY ALL)
  SELECT a.variant, a.ref, fid, fid_floor FROM a JOIN b ON a.ref = b.ref"""


def score_rows(t):
    """Diagonal Frechet distance of plan features (rooms, area, bedrooms) of every (variant, reference) from half of the
    reference's real plans, and of the other half from it."""
    def vectors(rooms):
        area = (C("x1") - C("x0")) * (C("y1") - C("y0"))
        f = rooms.groupBy("plan_id").agg(F.count(lit(1)).alias("n"), (F.sum(area) / 10000).alias("total"), F.count_if(C("type") == "bedroom").alias("bedrooms"))
        f = f.join(t.plans.select("plan_id", "variant", C("dataset").alias("ref")), "plan_id")
        return f.select("plan_id", "variant", "ref", F.array(C("n").cast("double"), C("total"), C("bedrooms").cast("double")).alias("vec"))
    real = vectors(t.rooms).withColumn("role", F.when(C("plan_id") % 2 == 0, "ref").otherwise("floor"))
    m = checkpointed(D.moments(real, ["ref", "role"]))
    ref = m.filter("role = 'ref'").drop("role")
    gen = checkpointed(D.moments(vectors(t.gen_rooms), ["variant", "ref"]))
    fid = D.frechet_diagonal(gen, ref.join(gen.select("variant", "ref").distinct(), "ref"), ["variant", "ref"]).withColumnRenamed("frechet", "fid")
    floor = D.frechet_diagonal(m.filter("role = 'floor'").drop("role"), ref, ["ref"]).withColumnRenamed("frechet", "fid_floor")
    return fid.join(floor, "ref")


@query("compare_methods", """SELECT s.variant, s.ref, round(fid, 6) AS fid, round(fid_floor, 6) AS fid_floor, round(fid - fid_floor, 6) AS fid_minus_floor, v.any_rule_violation FROM method_scores s JOIN variant_means v ON s.variant = v.variant AND s.ref = v.ref""")
def compare_methods(t):
    """One row per (variant, reference): score, floor, their difference, rule share."""
    d = B.minus_floor(score_rows(t)).join(variant_means(t).select("variant", "ref", "any_rule_violation"), ["variant", "ref"])
    return d.select("variant", "ref", *[F.round(c, 6).alias(c) for c in ("fid", "fid_floor", "fid_minus_floor")], "any_rule_violation")


@query("same_program_table", """SELECT gt_id AS program, max(CASE WHEN k = '0' THEN gen_id END) AS m0, max(CASE WHEN k = '1' THEN gen_id END) AS m1, max(CASE WHEN k = '2' THEN gen_id END) AS m2, count(*) AS n
  FROM (SELECT *, CASE WHEN gen_id = gt_id THEN '0' ELSE regexp_extract(gen_id, '_([0-9]+)$', 1) END AS k FROM paired WHERE gt_id IS NOT NULL) GROUP BY gt_id""")
def same_program_table(t):
    k = F.when(C("gen_id") == C("gt_id"), "0").otherwise(F.regexp_extract("gen_id", "_([0-9]+)$", 1))
    d = pairs(t).filter("gt_id IS NOT NULL").withColumn("k", k)
    return d.groupBy(C("gt_id").alias("program")).agg(*[F.max(F.when(C("k") == str(i), C("gen_id"))).alias(f"m{i}") for i in range(3)], F.count(lit(1)).alias("n"))


CTE["block_graphs"] = """WITH RECURSIVE g AS (SELECT r.plan_id, r.n, r.ty, coalesce(a.e, []) AS ea, coalesce(b.e, []) AS eb FROM (SELECT plan_id, count(*) AS n, list(type ORDER BY idx) AS ty FROM rooms GROUP BY plan_id) r
    LEFT JOIN (SELECT plan_id, list(DISTINCT a * 1000000 + b) AS e FROM program_edges WHERE kind = 'door' GROUP BY plan_id) a ON a.plan_id = r.plan_id
    LEFT JOIN (SELECT plan_id, list(DISTINCT least(i, j) * 1000000 + greatest(i, j)) AS e FROM door_edges GROUP BY plan_id) b ON b.plan_id = r.plan_id),
  m AS (SELECT plan_id, 0::BIGINT AS k, []::BIGINT[] AS im FROM g WHERE len(ea) = len(eb)
    UNION ALL SELECT plan_id, k + 1, list_append(im, w) FROM (SELECT m.*, g.n, g.ty, g.ea, g.eb, unnest(range(g.n)) AS w FROM m JOIN g ON m.plan_id = g.plan_id WHERE m.k < g.n)
      WHERE NOT list_contains(im, w) AND ty[w + 1] = ty[k + 1]
        AND len(list_filter(range(k), lambda q: list_contains(ea, q * 1000000 + k) <> list_contains(eb, least(im[q + 1], w) * 1000000 + greatest(im[q + 1], w)))) = 0)
  SELECT DISTINCT m.plan_id FROM m JOIN g ON m.plan_id = g.plan_id AND m.k = g.n"""
CTE["block_sets"] = """SELECT CASE WHEN f.made THEN 'gen' WHEN f.plan_id % 2 = 0 THEN 'ref' ELSE 'floor' END AS role, CASE WHEN f.plan_id % 2 = 1 THEN p.variant END AS variant, f.plan_id, n, total, bedrooms FROM (
    SELECT plan_id, true AS made, count(*)::DOUBLE AS n, sum((x1 - x0) * (y1 - y0)) / 10000 AS total, (count(*) FILTER (type = 'bedroom'))::DOUBLE AS bedrooms FROM gen_rooms GROUP BY plan_id
    UNION ALL SELECT plan_id, false, count(*), sum((x1 - x0) * (y1 - y0)) / 10000, count(*) FILTER (type = 'bedroom') FROM rooms GROUP BY plan_id) f JOIN plans p ON f.plan_id = p.plan_id WHERE f.plan_id % 2 = 1 OR NOT f.made"""
CTE["block_fid"] = """WITH d AS (SELECT role, variant, unnest(range(3)) AS k, unnest([n, total, bedrooms]) AS v FROM block_sets), m AS (SELECT role, variant, k, avg(v) AS mu, var_samp(v) AS var FROM d GROUP BY ALL),
  f AS (SELECT a.role, a.variant, sum((a.mu - r.mu) ** 2 + a.var + r.var - 2 * sqrt(a.var * r.var)) AS f FROM m a JOIN m r ON a.k = r.k AND r.role = 'ref' WHERE a.role <> 'ref' GROUP BY ALL)
  SELECT g.variant, g.f - h.f AS d FROM f g JOIN f h ON g.variant = h.variant AND g.role = 'gen' AND h.role = 'floor'"""
CTE["block_draws"] = """WITH z AS (SELECT avg(n) AS an, stddev_pop(n) + 1e-9 AS sn, avg(total) AS at_, stddev_pop(total) + 1e-9 AS st, avg(bedrooms) AS ab, stddev_pop(bedrooms) + 1e-9 AS sb FROM block_sets WHERE role = 'ref'),
  r AS (SELECT role, variant, (n - an) / sn AS a, (total - at_) / st AS b, (bedrooms - ab) / sb AS c, row_number() OVER (PARTITION BY role, variant ORDER BY md5(plan_id || ':0'), plan_id) - 1 AS pos FROM block_sets, z),
  s AS (SELECT x.role, x.variant, x.n, y.n AS n_ref, least(500, x.n, y.n) AS m FROM (SELECT role, variant, count(*) AS n FROM block_sets GROUP BY ALL) x, (SELECT count(*) AS n FROM block_sets WHERE role = 'ref') y WHERE x.role <> 'ref'),
  d AS (SELECT *, s * m + turn AS k FROM (SELECT *, unnest(range(m)) AS turn FROM (SELECT *, unnest(range(50)) AS s FROM s)))
  SELECT d.role, d.variant, d.s, d.m, 'a' AS side, a, b, c FROM d JOIN r ON r.role = d.role AND r.variant = d.variant AND r.pos = d.k % d.n
  UNION ALL SELECT d.role, d.variant, d.s, d.m, 'b', a, b, c FROM d JOIN r ON r.role = 'ref' AND r.pos = d.k % d.n_ref"""
CTE["block_kid"] = """WITH p AS (SELECT x.role, x.variant, x.s, x.m, x.side AS u, y.side AS w, sum(pow((x.a * y.a + x.b * y.b + x.c * y.c) / 3 + 1, 3)) AS k FROM block_draws x JOIN block_draws y ON x.role = y.role AND x.variant = y.variant AND x.s = y.s AND x.side <= y.side GROUP BY ALL),
  t AS (SELECT role, variant, s, sum(pow((a * a + b * b + c * c) / 3 + 1, 3)) AS tr FROM block_draws GROUP BY ALL),
  v AS (SELECT p.role, p.variant, p.s, (sum(k) FILTER (u = w) - any_value(tr)) / any_value(m * (m - 1)) - 2 * sum(k) FILTER (u <> w) / any_value(m * m) AS kid FROM p JOIN t ON t.role = p.role AND t.variant = p.variant AND t.s = p.s WHERE m > 1 GROUP BY ALL)
  SELECT variant, 1000 * (avg(kid) FILTER (role = 'gen') - avg(kid) FILTER (role = 'floor')) AS d FROM v GROUP BY variant"""


def block_scores(t):
    """(variant, delta_fid, delta_kid): Frechet distance and 1,000 times the kernel distance of a variant's generated plans from real plans, minus those
    of the real plans of the same inputs. Plans of even number are the reference, the others inputs; vectors are rooms, area and bedrooms,
    for the kernel in deviations of the reference."""
    def vectors(rooms):
        area = (C("x1") - C("x0")) * (C("y1") - C("y0"))
        f = rooms.groupBy("plan_id").agg(F.count(lit(1)).alias("n"), (F.sum(area) / 10000).alias("total"), F.count_if(C("type") == "bedroom").alias("bedrooms"))
        vec = F.array(C("n").cast("double"), C("total"), C("bedrooms").cast("double")).alias("vec")
        return f.join(t.dealt_plans.select("plan_id", "variant").hint("merge"), "plan_id").select(C("plan_id").alias("vec_id"), "variant", vec)
    real = kept_rows(vectors(t.rooms), [], None)
    ref, inputs = real.filter("vec_id % 2 = 0").select("vec_id", "vec"), real.filter("vec_id % 2 = 1").withColumn("role", lit("floor"))
    sets = checkpointed(inputs.unionByName(vectors(t.gen_rooms.filter("plan_id % 2 = 1")).withColumn("role", lit("gen"))))
    m, r = checkpointed(D.moments(sets, ["role", "variant"])), checkpointed(D.moments(ref, []))
    by = ["role", "variant"]
    fid = D.frechet_diagonal(m, m.select(*by).distinct().crossJoin(r), by).withColumnRenamed("frechet", "fid")
    dev = ref.select(F.posexplode("vec").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("mu"), F.stddev_pop("v").alias("sd"))
    dev = F.broadcast(checkpointed(dev.agg(F.array_sort(F.collect_list(F.struct("k", "mu", "sd"))).alias("ms"))))
    scaled = lambda d: d.crossJoin(dev).withColumn("vec", F.zip_with("vec", "ms", lambda x, s: (x - s["mu"]) / (s["sd"] + 1e-9))).drop("ms")
    both = fid.join(D.kid_of_sets(scaled(sets), scaled(ref), by), by, "left").groupBy("variant")
    minus = lambda c: F.max(F.when(C("role") == "gen", C(c))) - F.max(F.when(C("role") == "floor", C(c)))
    return both.agg(minus("fid").alias("delta_fid"), (1000 * minus("kid")).alias("delta_kid"))


@query("block_table", """SELECT p.variant, round(avg((NOT any_rule)::INT), 6) AS valid, round(avg(coalesce(r.f, false)::INT), 6) AS reach, round(avg((t.l = 0)::INT), 6) AS types,
    round(avg((t.l = 0 AND g.plan_id IS NOT NULL)::INT) FILTER (t.l IS NOT NULL), 6) AS graph, round(avg(abs(n.a - 120000.0 * n.n) / (120000.0 * n.n)), 6) AS area_err,
    round(any_value(fi.d), 6) AS delta_fid, round(any_value(ki.d), 6) AS delta_kid
  FROM plans p LEFT JOIN rule_flags f ON p.plan_id = f.plan_id LEFT JOIN (SELECT k.plan_id, k.n = c.n AS f FROM (SELECT plan_id, count(*) AS n FROM reach_rooms GROUP BY plan_id) k JOIN (SELECT plan_id, count(*) AS n FROM rooms GROUP BY plan_id) c ON k.plan_id = c.plan_id) r ON p.plan_id = r.plan_id
  LEFT JOIN (SELECT plan_id, sum(abs(a - b)) AS l FROM type_diff GROUP BY plan_id) t ON p.plan_id = t.plan_id LEFT JOIN block_graphs g ON p.plan_id = g.plan_id
  LEFT JOIN (SELECT plan_id, count(*) AS n, sum((x1 - x0) * (y1 - y0)) AS a FROM rooms GROUP BY plan_id) n ON p.plan_id = n.plan_id
  LEFT JOIN block_fid fi ON fi.variant = p.variant LEFT JOIN block_kid ki ON ki.variant = p.variant GROUP BY p.variant""")
def block_table(t):
    """Per variant: plans that break no rule; plans with a front door from which every room is reachable; types as in the input; types and door graph as in the
    input (typed isomorphism); relative error of the area; Frechet and kernel distance from real plans, minus those of the inputs' real plans."""
    from ..operators.graph import reachable
    from ..operators.isomorphism import graph_equal
    from ..plans.metrics import type_multiset
    from .window_queries import front_rooms
    a = t.rooms.groupBy("plan_id").agg(F.count(lit(1)).alias("n"), F.sum((C("x1") - C("x0")) * (C("y1") - C("y0"))).alias("a"))
    reach = reachable(t.rooms, t.door_edges, front_rooms(t), t.large).groupBy("plan_id").agg(F.count(lit(1)).alias("k"))
    types = kept_rows(type_multiset(t.gen_rooms, t.rooms).select("plan_id", "type_multiset_match"), ["plan_id"], t.dealt)
    # a graph can only be that of the input where the types are
    same = types.filter("type_multiset_match").select("plan_id")
    semi = lambda d: d.join(same.hint("merge"), "plan_id", "left_semi")
    wanted = semi(t.program_edges.filter("kind = 'door'").select("plan_id", C("a").alias("i"), C("b").alias("j")))
    rooms = semi(t.rooms.select("plan_id", "idx", "type"))
    graph = kept_rows(graph_equal(rooms, wanted, rooms, semi(t.door_edges.select("plan_id", "i", "j"))), [], None)
    d = rule_rows(t).select("plan_id", "variant", "any_rule")
    for x in (reach, a, types, graph):
        d = d.join(x.hint("merge"), "plan_id", "left")
    m = lambda c: F.round(F.avg(c), 6)
    share = lambda c: m(c.cast("int"))
    d = d.groupBy("variant").agg(share(~C("any_rule")).alias("valid"), share(F.coalesce(C("k") == C("n"), lit(False))).alias("reach"), share(C("type_multiset_match")).alias("types"),
                                 share(F.when(C("type_multiset_match"), F.coalesce("equal", lit(False))).otherwise(C("type_multiset_match"))).alias("graph"),
                                 m(F.abs(C("a") - lit(120000.0) * C("n")) / (lit(120000.0) * C("n"))).alias("area_err"))
    return d.join(block_scores(t).select("variant", F.round("delta_fid", 6).alias("delta_fid"), F.round("delta_kid", 6).alias("delta_kid")), "variant", "left")


@query("dataset_page_data", "SELECT dataset, unnest(map_keys(m)) AS type, unnest(map_values(m)) AS mean_count FROM (SELECT dataset, map_from_entries(list((type, round(mean_count, 9)) ORDER BY type)) AS m FROM comp_stats GROUP BY dataset)")
def dataset_page_data(t):
    p = B.payload(T.composition(t.plans, srooms(t)), "dataset", "type", F.round("mean_count", 9))
    return p.select("dataset", F.explode("payload").alias("type", "mean_count"))


CTE["method_metrics"] = """SELECT variant, 'rooms' AS metric, round(avg(n), 2) AS value FROM plans p JOIN plan_n k ON p.plan_id = k.plan_id GROUP BY variant
  UNION ALL SELECT variant, 'scaled', round(avg(scale_known::INT), 2) FROM plans GROUP BY variant UNION ALL SELECT variant, 'violations', round(any_, 2) FROM (SELECT variant, avg(any_rule::INT) AS any_ FROM rule_flags GROUP BY variant)"""


@query("best_values", "SELECT variant, metric, value, value = CASE WHEN metric = 'violations' THEN min(value) OVER (PARTITION BY metric) ELSE max(value) OVER (PARTITION BY metric) END AS best FROM method_metrics")
def best_values(t):
    n = t.rooms.groupBy("plan_id").agg(F.count(lit(1)).alias("n"))
    r2 = lambda c, name: F.round(F.avg(c), 2).alias(name)
    a = t.plans.join(n, "plan_id").groupBy("variant").agg(r2("n", "value")).select("variant", lit("rooms").alias("metric"), "value")
    b = t.plans.groupBy("variant").agg(r2(C("scale_known").cast("int"), "value")).select("variant", lit("scaled").alias("metric"), "value")
    c = rule_rows(t).groupBy("variant").agg(r2(C("any_rule").cast("int"), "value")).select("variant", lit("violations").alias("metric"), "value")
    return mark_best(a.unionByName(b).unionByName(c), ["metric"], lowest=("violations",))


@query("rank_variants", """SELECT variant, any_rule_violation, row_number() OVER (ORDER BY any_rule_violation, variant) AS place FROM variant_means WHERE ref = 'F' AND NOT variant LIKE '1-%'""")
def rank_variants(t):
    """Variants of one reference without bundles, by rule share; a handful of summary rows is ranked."""
    from pyspark.sql import Window as W
    d = variant_means(t).filter((C("ref") == "F") & ~C("variant").startswith("1-")).select("variant", "any_rule_violation")
    return d.withColumn("place", F.row_number().over(W.orderBy("any_rule_violation", "variant")))


