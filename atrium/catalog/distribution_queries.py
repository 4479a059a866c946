"""Distribution distances."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kernels as K
from ..operators.graph import wl_hash
from ..operators.ranking import rank_distributed
from ..plans import distribution as D
from ..plans.rules import room_attributes
from ..session import checkpointed, spread
from .aggregate_queries import FEATS, plan_feats
from .base import CTE, query
from .window_queries import matched

C, lit = F.col, F.lit

CTE["feat_dims"] = "SELECT vec_id, set_id, generate_subscripts(vec, 1) AS k, unnest(vec) AS v FROM features"


@query("frechet", """WITH m AS (SELECT set_id, k, avg(v) AS mu, var_samp(v) AS var FROM feat_dims GROUP BY ALL)
  SELECT round(sum((a.mu - b.mu) * (a.mu - b.mu) + a.var + b.var - 2 * sqrt(a.var * b.var)), 9) AS frechet FROM m a JOIN m b ON a.k = b.k AND a.set_id = 'gen' AND b.set_id = 'real'""")
def frechet(t):
    m = D.moments(t.features, ["set_id"])
    one = lambda s: m.filter(C("set_id") == s).drop("set_id")
    return D.frechet_diagonal(one("gen"), one("real"), []).select(F.round("frechet", 9).alias("frechet"))


@query("frechet_full")
def frechet_full(t):
    """Full-covariance distance; the value is exact up to the d x d eigen step on the driver."""
    v = D.frechet(t.features, "set_id", "gen", "real")
    return t.features.groupBy("set_id").agg(F.count(lit(1)).alias("n")).withColumn("frechet", F.round(lit(v), 6))


CTE["kid_draws"] = """SELECT s, set_id, vec FROM (SELECT s, set_id, vec, row_number() OVER (PARTITION BY s, set_id ORDER BY md5(vec_id || ':' || s), vec_id) AS rn FROM features, (SELECT unnest(range(50)) AS s))
  WHERE rn <= (SELECT least(500, min(n)) FROM (SELECT count(*) AS n FROM features GROUP BY set_id))"""


@query("kid", """WITH p AS (SELECT a.s, a.set_id AS x, b.set_id AS y, sum(pow(list_dot_product(a.vec, b.vec) / 64 + 1, 3)) AS k FROM kid_draws a JOIN kid_draws b ON a.s = b.s AND a.set_id <= b.set_id GROUP BY ALL),
  t AS (SELECT s, set_id, count(*) AS m, sum(pow(list_dot_product(vec, vec) / 64 + 1, 3)) AS tr FROM kid_draws GROUP BY ALL),
  v AS (SELECT g.s, (a.k - g.tr) / (g.m * (g.m - 1)) + (b.k - r.tr) / (r.m * (r.m - 1)) - 2 * c.k / (g.m * r.m) AS kid FROM t g JOIN t r ON g.s = r.s AND g.set_id = 'gen' AND r.set_id = 'real'
    JOIN p a ON a.s = g.s AND a.x = 'gen' AND a.y = 'gen' JOIN p b ON b.s = g.s AND b.x = 'real' AND b.y = 'real' JOIN p c ON c.s = g.s AND c.x = 'gen' AND c.y = 'real')
  SELECT round(avg(kid), 10) AS kid, round(stddev_pop(kid), 10) AS kid_std, count(*) AS n_subsets FROM v""")
def kid(t):
    k = D.kid(t.features, "set_id", "gen", "real", 50, 500)
    return k.agg(F.round(F.avg("kid"), 10).alias("kid"), F.round(F.stddev_pop("kid"), 10).alias("kid_std"), F.count(lit(1)).alias("n_subsets"))


CTE["role_dims"] = """SELECT CASE WHEN label >= 5 THEN 'gen' WHEN f.vec_id % 2 = 0 THEN 'ref' ELSE 'floor' END AS role, k, v FROM feat_dims d JOIN features f ON d.vec_id = f.vec_id"""


CTE["floor_share"] = "SELECT avg((g.vec_id + 1 IN (SELECT vec_id FROM features WHERE set_id = 'real'))::INT) >= 0.9 AS same FROM features g WHERE set_id = 'gen'"


@query("floor_score", """WITH r AS (SELECT vec_id, CASE WHEN set_id = 'gen' THEN 'gen' WHEN CASE WHEN (SELECT same FROM floor_share) THEN vec_id - 1 IN (SELECT vec_id FROM features WHERE set_id = 'gen') ELSE vec_id % 2 = 1 END
    THEN 'floor' ELSE 'ref' END AS role FROM features),
  m AS (SELECT role, k, avg(v) AS mu, var_samp(v) AS var FROM feat_dims d JOIN r ON d.vec_id = r.vec_id GROUP BY ALL),
  s AS (SELECT a.role, sum((a.mu - b.mu) * (a.mu - b.mu) + a.var + b.var - 2 * sqrt(a.var * b.var)) AS f FROM m a JOIN m b ON a.k = b.k AND b.role = 'ref' WHERE a.role <> 'ref' GROUP BY a.role)
  SELECT round(max(f) FILTER (role = 'gen'), 9) AS fid, round(max(f) FILTER (role = 'floor'), 9) AS fid_floor, CASE WHEN (SELECT same FROM floor_share)
    THEN 'GT of the same inputs' ELSE 'random real plans' END AS floor FROM s""")
def floor_score(t):
    """Generated and floor sets scored against the same reference. The floor set is the real plans of the same inputs, taken
    out of the reference, when at least 90 % of the generated plans have one; otherwise real plans outside the reference."""
    gen = t.features.filter("set_id = 'gen'").select((C("vec_id") + 1).alias("vec_id"), lit(1).alias("hit"))
    real = t.features.filter("set_id = 'real'").select("vec_id", lit(1).alias("known"))
    share = gen.join(real, "vec_id", "left").agg((F.avg(F.coalesce("known", lit(0))) >= 0.9).alias("same"))
    f = t.features.join(gen, "vec_id", "left").crossJoin(share)
    floor = F.when(C("same"), C("hit").isNotNull()).otherwise(C("vec_id") % 2 == 1)
    f = f.withColumn("role", F.when(C("set_id") == "gen", "gen").when(floor, "floor").otherwise("ref"))
    m = checkpointed(D.moments(f, ["role"]))
    ref = m.filter("role = 'ref'").select("k", "mu", "var")
    sc = lambda r, n: D.frechet_diagonal(m.filter(C("role") == r).drop("role"), ref, []).select(F.round("frechet", 9).alias(n))
    kind = share.select(F.when(C("same"), "GT of the same inputs").otherwise("random real plans").alias("floor"))
    return sc("gen", "fid").crossJoin(sc("floor", "fid_floor")).crossJoin(kind)


def _c2st_sql(src: str, a: str, b: str) -> str:
    return f"""WITH m AS (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM {src} GROUP BY side)),
  d AS (SELECT id, side, vec FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY md5(id || ':0'), id) AS rn FROM {src}) WHERE rn <= (SELECT m FROM m)),
  x AS (SELECT id, side, generate_subscripts(vec, 1) AS k, unnest(vec) AS v FROM d), mo AS (SELECT k, avg(v) AS mu, stddev_pop(v) + 1e-9 AS sd FROM x GROUP BY k),
  z AS (SELECT id, side, list((v - mu) / sd ORDER BY x.k) AS vec FROM x JOIN mo ON x.k = mo.k GROUP BY id, side),
  nn AS (SELECT a.side, min_by(b.side, struct_pack(d := list_distance(a.vec, b.vec), i := b.id)) AS s2 FROM z a JOIN z b ON a.id <> b.id GROUP BY a.id, a.side)
  SELECT round(avg((side = s2)::INT), 9) AS accuracy, count(*) AS n FROM nn"""


CTE["c2_main"] = "SELECT vec_id AS id, set_id AS side, vec FROM features"
CTE["c2_half"] = "SELECT vec_id AS id, CASE WHEN (row_number() OVER (ORDER BY md5(vec_id || ':1'))) * 2 <= count(*) OVER () THEN 'a' ELSE 'b' END AS side, vec FROM features WHERE set_id = 'real'"


@query("c2st_1nn", _c2st_sql("c2_main", "gen", "real"))
def c2st_1nn(t):
    return D.c2st(t.features, "vec_id", "set_id", "gen", "real").select(F.round("accuracy", 9).alias("accuracy"), "n")


@query("real_floor", _c2st_sql("c2_half", "a", "b"))
def real_floor(t):
    """The same test between two disjoint hash-ordered halves of the real set."""
    from ..operators.ranking import hash_order
    r = t.features.filter("set_id = 'real'").select("vec_id", "vec", lit(0).alias("g"))
    r = rank_distributed(r, ["g"], [hash_order("vec_id", seed=1)], "pos")
    n = r.agg(F.count(lit(1)).alias("n"))
    h = r.crossJoin(F.broadcast(n)).select("vec_id", "vec", F.when((C("pos") + 1) * 2 <= C("n"), "a").otherwise("b").alias("side"))
    return D.c2st(checkpointed(h), "vec_id", "side", "a", "b").select(F.round("accuracy", 9).alias("accuracy"), "n")


@query("wasserstein1", """WITH p AS (SELECT list(i / 200.0::DOUBLE ORDER BY i) AS ps FROM (SELECT unnest(range(201)) AS i)),
  g AS (SELECT type, quantile_cont((x1 - x0) * (y1 - y0), [""" + ",".join(f"{i / 200!r}" for i in range(201)) + """]) AS q FROM gen_rooms GROUP BY type),
  r AS (SELECT type_canonical AS type, quantile_cont(area_cm2, [""" + ",".join(f"{i / 200!r}" for i in range(201)) + """]) AS q FROM room_attrs GROUP BY 1)
  SELECT g.type, round(list_avg(list_transform(range(1, 202), lambda i: abs(g.q[i] - r.q[i]))), 4) AS w1 FROM g JOIN r ON g.type = r.type""")
def wasserstein1(t):
    w = D.wasserstein1(room_attributes(t.gen_rooms), room_attributes(t.rooms), ["type"], "area_cm2")
    return w.withColumn("w1", F.round("w1", 4))


CTE["held"] = """SELECT s.r, m.gen_id, m.real_id, row_number() OVER (PARTITION BY s.r, m.gen_id ORDER BY md5(m.real_id || ':' || s.r), m.real_id) = 1 AS held FROM matched m, (SELECT unnest(range(5)) AS r) s WHERE m.real_id IS NOT NULL"""
CTE["held_dims"] = "SELECT h.r, h.held, k.k, k.v FROM held h JOIN (SELECT plan_id, unnest(['n_rooms','total','bedrooms','baths','halls','aspect']) AS k, unnest([n_rooms::DOUBLE, total, bedrooms, baths, halls, aspect]) AS v FROM plan_feats) k ON h.real_id = k.plan_id"


@query("held_out_rounds", """WITH m AS (SELECT r, CASE WHEN held THEN 'held' ELSE 'rest' END AS s, k, avg(v) AS mu, var_samp(v) AS var FROM held_dims GROUP BY ALL),
  o AS (SELECT k, avg(v) AS mu, var_samp(v) AS var FROM (SELECT unnest(['n_rooms','total','bedrooms','baths','halls','aspect']) AS k, unnest([n_rooms::DOUBLE, total, bedrooms, baths, halls, aspect]) AS v FROM plan_feats WHERE side = 'ours') GROUP BY k),
  f AS (SELECT a.r, sum((h.mu - a.mu) ** 2 + h.var + a.var - 2 * sqrt(h.var * a.var)) AS real_real, sum((o.mu - a.mu) ** 2 + o.var + a.var - 2 * sqrt(o.var * a.var)) AS ours FROM m a JOIN m h ON a.r = h.r AND a.k = h.k AND a.s = 'rest' AND h.s = 'held' JOIN o ON o.k = a.k GROUP BY a.r)
  SELECT round(avg(ours), 6) AS fid, round(stddev_pop(ours), 6) AS fid_std, round(avg(real_real), 6) AS fid_real, round(stddev_pop(real_real), 6) AS fid_real_std FROM f""")
def held_out_rounds(t):
    """Five rounds: one matched real plan per generated plan is held out; ours and the held-out set meet the rest."""
    m = checkpointed(matched(t).filter("real_id IS NOT NULL").select("gen_id", "real_id"))
    d = m.withColumn("r", F.explode(F.sequence(lit(0), lit(4))))
    h = F.md5(F.concat_ws(":", C("real_id").cast("string"), C("r").cast("string")))
    first = d.groupBy("r", "gen_id").agg(F.min_by("real_id", F.struct(h, C("real_id"))).alias("held_id"))
    d = d.join(first, ["r", "gen_id"]).withColumn("s", F.when(C("real_id") == C("held_id"), "held").otherwise("rest"))
    vec = plan_feats(t).select("plan_id", "side", F.array(*[C(c).cast("double") for c in FEATS]).alias("vec"))
    mo = checkpointed(D.moments(d.join(vec.select(C("plan_id").alias("real_id"), "vec"), "real_id"), ["r", "s"]))
    rest = mo.filter("s = 'rest'").drop("s")
    ours = D.moments(vec.filter("side = 'ours'"), []).crossJoin(F.broadcast(rest.select("r").distinct()))
    a = D.frechet_diagonal(ours, rest, ["r"]).withColumnRenamed("frechet", "ours")
    b = D.frechet_diagonal(mo.filter("s = 'held'").drop("s"), rest, ["r"]).withColumnRenamed("frechet", "real")
    f = a.join(b, "r")
    return f.agg(F.round(F.avg("ours"), 6).alias("fid"), F.round(F.stddev_pop("ours"), 6).alias("fid_std"), F.round(F.avg("real"), 6).alias("fid_real"),
                 F.round(F.stddev_pop("real"), 6).alias("fid_real_std"))


@query("diversity", """WITH o AS (SELECT t.topology FROM topo t JOIN plans p ON t.plan_id = p.plan_id WHERE p.dataset = 'F'), r AS (SELECT t.plan_id, t.topology FROM topo t JOIN plans p ON t.plan_id = p.plan_id WHERE p.dataset = 'O'),
  m AS (SELECT least((SELECT count(*) FROM o), (SELECT count(*) FROM r)) AS m),
  d AS (SELECT s, topology, row_number() OVER (PARTITION BY s ORDER BY md5(plan_id || ':' || s), plan_id) AS rn FROM r, (SELECT unnest(range(20)) AS s)),
  g AS (SELECT s, count(DISTINCT topology)::DOUBLE / count(*) AS v FROM d WHERE rn <= (SELECT m FROM m) GROUP BY s)
  SELECT (SELECT round(count(DISTINCT topology)::DOUBLE / count(*), 9) FROM o) AS ours, round(avg(v), 9) AS real FROM g""")
def diversity(t):
    """Distinct topologies per plan, against the mean over 20 equally large draws of real plans."""
    topo = checkpointed(wl_hash(t.rooms, t.adj).join(t.plans.select("plan_id", "dataset"), "plan_id").filter("dataset IN ('F', 'O')"))
    ours = topo.filter("dataset = 'F'").agg(F.count_distinct("topology").alias("k"), F.count(lit(1)).alias("n"))
    real = topo.filter("dataset = 'O'").select("plan_id", "topology")
    m = real.agg(F.count(lit(1)).alias("nr")).crossJoin(ours.select("n")).select(F.least("n", "nr").alias("m"))
    d = real.withColumn("s", F.explode(F.sequence(lit(0), lit(19))))
    d = rank_distributed(d, ["s"], [F.md5(F.concat_ws(":", C("plan_id").cast("string"), C("s").cast("string"))), "plan_id"], "pos")
    g = d.crossJoin(F.broadcast(m)).filter("pos < m").groupBy("s").agg((F.count_distinct("topology") / F.count(lit(1))).alias("v"))
    return ours.select(F.round(C("k") / C("n"), 9).alias("ours")).crossJoin(g.agg(F.round(F.avg("v"), 9).alias("real")))


# ---- ring kernels ----

def shapes(t):
    """Shape facts of all rings."""
    return K.room_shape(t.rings.select("plan_id", "idx", "type", "ring"), 5.0)


CTE["hull_pairs"] = """SELECT a.plan_id, a.idx, a.k AS i, b.k AS j, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS len FROM ring_points a JOIN ring_points b ON a.plan_id = b.plan_id AND a.idx = b.idx AND a.k <> b.k"""
CTE["hull_edges"] = """SELECT h.plan_id, h.idx, h.i, h.j, h.ax, h.ay, h.bx, h.by_, h.len, max(((c.x - h.ax) * (h.bx - h.ax) + (c.y - h.ay) * (h.by_ - h.ay)) / len) - min(((c.x - h.ax) * (h.bx - h.ax) + (c.y - h.ay) * (h.by_ - h.ay)) / len) AS w,
    max(abs((h.bx - h.ax) * (c.y - h.ay) - (h.by_ - h.ay) * (c.x - h.ax)) / len) AS d
  FROM hull_pairs h JOIN ring_points c ON h.plan_id = c.plan_id AND h.idx = c.idx GROUP BY ALL HAVING min((h.bx - h.ax) * (c.y - h.ay) - (h.by_ - h.ay) * (c.x - h.ax)) >= 0"""


@query("min_rotated_rect", """SELECT plan_id, idx, round(min_by(least(w, d), struct_pack(a := round(w * d, 4), s := least(w, d))), 4) AS short, round(min(w * d), 2) AS area FROM hull_edges GROUP BY plan_id, idx""")
def min_rotated_rect(t):
    return shapes(t).select("plan_id", "idx", F.round("short", 4).alias("short"), F.round(C("short") * C("long"), 2).alias("area"))


@query("convexity", """SELECT a.plan_id, a.idx, round(a.area / (SELECT sum(h.ax * h.by_ - h.bx * h.ay) / 2 FROM hull_edges h WHERE h.plan_id = a.plan_id AND h.idx = a.idx), 9) AS convexity
  FROM (SELECT plan_id, idx, abs(sum(x0 * y1 - x1 * y0)) / 2 AS area FROM ring_segs GROUP BY ALL) a""")
def convexity(t):
    return shapes(t).select("plan_id", "idx", F.round("convexity", 9).alias("convexity"))


@query("n_corners", "SELECT plan_id, idx, count(*) AS corners FROM ring_points GROUP BY plan_id, idx")
def n_corners(t):
    return shapes(t).select("plan_id", "idx", C("corners").cast("long").alias("corners"))


@query("clear_width")
def clear_width(t):
    """Diameter of the largest inscribed circle, found to a thousandth of the room's size."""
    return shapes(t).select("plan_id", "idx", F.round("clear_width", 3).alias("clear_width"))


CTE["twist"] = """SELECT plan_id, idx, CASE WHEN pk % 4 = 1 THEN 1 ELSE 0 END AS t, x0, y0, x1, y1, (x1 - x0) * (y1 - y0) AS a FROM rooms"""


@query("repair_polygon", """SELECT plan_id, idx, t = 0 AS valid, CASE WHEN t = 0 THEN a ELSE a / 2 END::DOUBLE AS area FROM twist""")
def repair_polygon(t):
    """Every fourth room is drawn as a bow tie; the valid flag finds it and the even-odd repair gives its two triangles."""
    x0, y0, x1, y1 = [C(c).cast("double") for c in ("x0", "y0", "x1", "y1")]
    pts = lambda *p: F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in p])
    ring = F.when(C("pk") % 4 == 1, pts((x0, y0), (x1, y1), (x1, y0), (x0, y1))).otherwise(pts((x0, y0), (x1, y0), (x1, y1), (x0, y1)))
    s = K.room_shape(spread(checkpointed(t.rooms.select("plan_id", "idx", ring.alias("ring")))), 5.0)
    return s.select("plan_id", "idx", "valid", F.round("repaired", 6).alias("area"))


@query("kernel_udf")
def kernel_udf(t):
    return shapes(t)


@query("ring_chain", "SELECT plan_id, idx, CASE pk % 3 WHEN 0 THEN 4 WHEN 1 THEN 6 ELSE 5 END AS points, abs(a.area) AS area FROM (SELECT plan_id, idx, sum(x0 * y1 - x1 * y0) / 2 AS area FROM ring_segs GROUP BY ALL) a JOIN rooms r USING (plan_id, idx)")
def ring_chain(t):
    """Edges of a ring in shuffled order chained back to one ring."""
    from ..functions.geometry import edges_of, polygon_area
    e = t.rings.select("plan_id", "idx", F.inline(F.shuffle(edges_of(C("ring")))))
    r = K.chain_rings(spread(checkpointed(e)), ["plan_id", "idx"])
    return r.select("plan_id", "idx", F.size("ring").cast("long").alias("points"), polygon_area(C("ring")).alias("area"))
