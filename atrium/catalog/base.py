"""Query registry and the named SQL tables shared by the check statements."""
from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from ..vocab import NORM_RULES, ROOM_TYPES, STAT_GROUPS, THRESHOLDS
from .tables import NATIVE_LABELS, Tables

REGISTRY: dict[str, Callable] = {}
SQL: dict[str, str] = {}
CTE: dict[str, str] = {}


def _list(values):
    return "[" + ",".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


TYPES_SQL = _list(ROOM_TYPES)
BOXCOLS = "x0, y0, x1, y1"

CTE["rooms"] = f"""
  SELECT plan_id, idx, pk, pk % 15 AS type_id, {TYPES_SQL}[pk % 15 + 1] AS type, x0, y0, x0 + w AS x1, y0 + h AS y1
  FROM (SELECT plan_id, idx, pk, (idx % 3) * 400 + (sk % 5) * 10 AS x0, (idx // 3) * 400 + (pk % 4) * 10 AS y0,
               300 + CAST(q AS BIGINT) * 3 AS w, 300 + (pk * 7 + idx * 31) % 151 AS h
        FROM (SELECT l_orderkey AS plan_id, l_partkey AS pk, l_suppkey AS sk, l_quantity AS q,
                     row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
                                        l_quantity, l_extendedprice, l_shipdate) - 1 AS idx FROM lineitem))"""
CTE["plans"] = """
  SELECT o_orderkey AS plan_id, o_orderstatus AS dataset, o_orderpriority AS variant, o_orderdate AS created,
         o_custkey AS home, o_custkey % 10 <> 0 AS scale_known FROM orders"""
CTE["doors"] = """
  SELECT plan_id, k, type, mx - 45 AS x0, my - 10 AS y0, mx + 45 AS x1, my + 10 AS y1 FROM (
    SELECT a.plan_id, a.idx AS k, 'interior_door' AS type, (a.x0 + a.x1 + b.x0 + b.x1) // 4 AS mx,
           (a.y0 + a.y1 + b.y0 + b.y1) // 4 AS my
    FROM rooms a JOIN rooms b ON a.plan_id = b.plan_id AND b.idx = a.idx + 1 WHERE (a.plan_id + a.idx) % 4 <> 0
    UNION ALL
    SELECT plan_id, -1, 'front_door', (x0 + x1) // 2, (y0 + y1) // 2 FROM rooms WHERE idx = 0 AND plan_id % 5 <> 0)"""
CTE["windows"] = """
  SELECT plan_id, idx AS room, 60 + pk % 120 AS width_cm, 90 AS sill_cm, 220 AS head_cm,
         x0, y0 - 10 AS y0, x0 + 60 + pk % 120 AS x1, y0 + 10 AS y1 FROM rooms WHERE pk % 3 <> 0"""
CTE["boundary"] = """
  SELECT plan_id, min(x0) + 20 AS x0, min(y0) + 20 AS y0, max(x1) - 20 AS x1, max(y1) - 20 AS y1
  FROM rooms GROUP BY plan_id"""
CTE["gen_rooms"] = f"""
  SELECT plan_id, idx, pk, t AS type_id, {TYPES_SQL}[t + 1] AS type, x0, y0, x1, y1
  FROM (SELECT *, CASE WHEN pk % 13 = 0 THEN (type_id + 1) % 15 ELSE type_id END AS t FROM rooms WHERE pk % 11 <> 0)"""
CTE["gen_ids"] = """
  SELECT CASE WHEN plan_id % 3 = 0 AND k = 0 THEN plan_id::VARCHAR ELSE plan_id || '_' || k END AS gen_id
  FROM plans, (SELECT unnest([0, 1, 2]) AS k) WHERE k < 3 - CAST(plan_id % 8 = 0 AS INTEGER)"""
CTE["program_edges"] = """
  SELECT plan_id, idx - 1 AS a, idx AS b, 'door' AS kind FROM rooms WHERE idx >= 1
  UNION ALL SELECT plan_id, 0, idx, 'wall' FROM rooms WHERE idx >= 2"""
CTE["storeys"] = """
  SELECT owner * 1000000 + turn // n_storeys AS home, turn % n_storeys AS storey, n_storeys, plan_id FROM (
    SELECT home AS owner, plan_id, row_number() OVER (PARTITION BY home ORDER BY plan_id) - 1 AS turn, 1 + home % 3 AS n_storeys FROM plans)"""
CTE["adj"] = """
  SELECT a.plan_id, a.idx AS i, b.idx AS j FROM rooms a JOIN rooms b ON a.plan_id = b.plan_id AND a.idx < b.idx
  WHERE least(a.x1, b.x1) - greatest(a.x0, b.x0) + 60 > 0 AND least(a.y1, b.y1) - greatest(a.y0, b.y0) + 60 > 0
    AND (least(a.x1, b.x1) - greatest(a.x0, b.x0) + 60) * (least(a.y1, b.y1) - greatest(a.y0, b.y0) + 60) >= 3000"""
CTE["door_hits"] = """
  SELECT d.plan_id, d.k, d.type AS door_type, r.idx,
         (least(d.x1 + 30, r.x1) - greatest(d.x0 - 30, r.x0)) * (least(d.y1 + 30, r.y1) - greatest(d.y0 - 30, r.y0)) AS area
  FROM doors d JOIN rooms r ON d.plan_id = r.plan_id
  WHERE least(d.x1 + 30, r.x1) > greatest(d.x0 - 30, r.x0) AND least(d.y1 + 30, r.y1) > greatest(d.y0 - 30, r.y0)"""
CTE["door_edges"] = """
  SELECT plan_id, k, min(idx) AS i, max(idx) AS j FROM (
    SELECT *, row_number() OVER (PARTITION BY plan_id, k ORDER BY area DESC, idx DESC) AS rn
    FROM door_hits WHERE door_type <> 'front_door') WHERE rn <= 2 GROUP BY plan_id, k HAVING count(*) = 2"""
CTE["edges"] = """
  SELECT plan_id, i, j, 'wall' AS kind FROM adj UNION ALL SELECT plan_id, i, j, 'door' FROM door_edges"""
CTE["ring_edges"] = """
  SELECT plan_id, idx, k, CASE k WHEN 0 THEN x0 WHEN 1 THEN x1 WHEN 2 THEN x1 ELSE x0 END AS x0,
         CASE k WHEN 0 THEN y0 WHEN 1 THEN y0 WHEN 2 THEN y1 ELSE y1 END AS y0,
         CASE k WHEN 0 THEN x1 WHEN 1 THEN x1 WHEN 2 THEN x0 ELSE x0 END AS x1,
         CASE k WHEN 0 THEN y0 WHEN 1 THEN y1 WHEN 2 THEN y1 ELSE y0 END AS y1
  FROM rooms, (SELECT unnest([0, 1, 2, 3]) AS k)"""
CTE["ring_points"] = """
  SELECT plan_id, idx, k - 1 AS k, xs[k]::DOUBLE AS x, ys[k]::DOUBLE AS y FROM (
    SELECT plan_id, idx, xs, ys, unnest(range(1, len(xs) + 1)) AS k FROM (
      SELECT plan_id, idx,
        CASE pk % 3 WHEN 0 THEN [x0, x1, x1, x0] WHEN 1 THEN [x0, x1, x1, xm, xm, x0] ELSE [x0, x1, x1, xm, x0] END AS xs,
        CASE pk % 3 WHEN 0 THEN [y0, y0, y1, y1] WHEN 1 THEN [y0, y0, ym, ym, y1, y1] ELSE [y0, y0, ym, y1, y1] END AS ys
      FROM (SELECT *, x1 - (x1 - x0) // 2 AS xm, y1 - (y1 - y0) // 3 AS ym FROM rooms)))"""
CTE["runs"] = """
  SELECT plan_id, r, (x0 + 19) // 20 AS c0, (x1 + 19) // 20 AS c1, type_id AS label, idx FROM (
    SELECT *, unnest(range((y0 + 19) // 20, (y1 + 19) // 20)) AS r FROM rooms)"""
CTE["native"] = f"""
  SELECT plan_id, idx, pk, CASE WHEN pk % 5 = 4 THEN lab || ' ' || pk ELSE lab END AS label
  FROM (SELECT *, {_list(NATIVE_LABELS)}[pk % {len(NATIVE_LABELS)} + 1] AS lab FROM rooms)"""
CTE["features"] = """
  SELECT vec_id, CASE WHEN label < 5 THEN 'real' ELSE 'gen' END AS set_id, label, embedding::DOUBLE[] AS vec
  FROM embeddings"""
CTE["raw_text"] = """
  SELECT event_id AS id, user_id, event_type, value, CASE WHEN event_id % 7 = 0 THEN substr(props, 1, length(props) - 1)
         WHEN event_id % 11 = 0 THEN props || ' done' ELSE props END AS text FROM events"""
CTE["thresholds"] = "SELECT * FROM (VALUES " + ", ".join(
    f"('{t}', {a}::DOUBLE, {w}::DOUBLE, {'NULL' if m is None else m}::DOUBLE)" for t, a, w, m in THRESHOLDS) \
    + ") v(type, min_area, min_width, max_aspect)"
CTE["norm_rules"] = "SELECT * FROM (VALUES " + ", ".join(
    f"('{a}','{b}','{c}','{d}',{e}::DOUBLE,'{f}')" for a, b, c, d, e, f in NORM_RULES) \
    + ") v(rule, subject, parameter, op, threshold, bindingness)"
CTE["stat_rooms"] = "SELECT * REPLACE (CASE " + " ".join(
    f"WHEN type = '{k}' THEN '{v}'" for k, v in STAT_GROUPS.items()) + " ELSE type END AS type), type AS type_canonical FROM rooms"
CTE["room_attrs"] = """
  SELECT plan_id, idx, pk, type, type_canonical, x0, y0, x1, y1, (x1 - x0) * (y1 - y0) AS area_cm2, least(x1 - x0, y1 - y0) AS width_cm,
         greatest(x1 - x0, y1 - y0) AS depth_cm,
         greatest(x1 - x0, y1 - y0)::DOUBLE / least(x1 - x0, y1 - y0) AS aspect FROM stat_rooms"""
CTE["plan_union"] = """
  WITH xs AS (SELECT plan_id, x0 AS x FROM rooms UNION SELECT plan_id, x1 FROM rooms),
  ys AS (SELECT plan_id, y0 AS y FROM rooms UNION SELECT plan_id, y1 FROM rooms),
  sx AS (SELECT plan_id, x AS a, lead(x) OVER (PARTITION BY plan_id ORDER BY x) AS b FROM xs),
  sy AS (SELECT plan_id, y AS c, lead(y) OVER (PARTITION BY plan_id ORDER BY y) AS e FROM ys),
  cov AS (SELECT DISTINCT sx.plan_id, a, b, c, e FROM sx JOIN sy ON sx.plan_id = sy.plan_id AND b IS NOT NULL AND e IS NOT NULL
          JOIN rooms r ON r.plan_id = sx.plan_id AND r.x0 <= a AND r.x1 >= b AND r.y0 <= c AND r.y1 >= e)
  SELECT plan_id, CAST(sum((b - a) * (e - c)) AS BIGINT) AS union_cm2 FROM cov GROUP BY plan_id"""

_COMP = """
  SELECT n.plan_id, n.idx, least(n.idx, coalesce(min(r.b), n.idx)) AS comp FROM rooms n LEFT JOIN (
    WITH RECURSIVE sym AS (SELECT plan_id, i AS a, j AS b FROM {e} UNION SELECT plan_id, j, i FROM {e}),
    reach AS (SELECT plan_id, a, b FROM sym UNION
              SELECT r.plan_id, r.a, s.b FROM reach r JOIN sym s ON r.plan_id = s.plan_id AND r.b = s.a)
    SELECT * FROM reach) r ON n.plan_id = r.plan_id AND n.idx = r.a GROUP BY n.plan_id, n.idx"""
CTE["adj_comp"] = _COMP.format(e="adj")
CTE["door_comp"] = _COMP.format(e="door_edges")
CTE["front_room"] = """
  SELECT plan_id, arg_max(idx, area * 1000 + idx) AS seed FROM door_hits WHERE door_type = 'front_door' GROUP BY plan_id"""


def _deps(text: str, skip=()) -> list[str]:
    words = set(re.findall(r"[a-z_0-9]+", text))
    return [n for n in CTE if n in words and n not in skip]


def expand(body: str, own: set[str] = frozenset()) -> str:
    """Put the shared tables a statement mentions in front of it."""
    need: list[str] = []

    def visit(n):
        if n in need:
            return
        for d in _deps(CTE[n], skip=(n,)):
            if d != n:
                visit(d)
        need.append(n)

    for n in _deps(body):
        visit(n)
    need = [n for n in need if n not in own]
    head = ", ".join(f"{n} AS ({CTE[n]})" for n in need)
    body = body.strip()
    m = re.match(r"(?is)with\s+(recursive\s+)?", body)
    if m:
        rest = body[m.end():]
        return f"WITH RECURSIVE {head + ', ' if head else ''}{rest}"
    return f"WITH RECURSIVE {head} {body}" if head else body


def query(key: str, sql: str | None = None):
    """Register a query; ``sql`` may use the shared tables by name."""

    def wrap(fn):
        assert key not in REGISTRY, key

        def run(spark, sf_dir) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__name__ = key
        REGISTRY[key] = run
        if sql is not None:
            SQL[key] = sql
        return fn

    return wrap


def slab_sql(src: str, along: str, keys: str = "plan_id", once: bool = False) -> str:
    """Slabs of ``src``. ``once``: equal intervals of a slab count as one, so no tie is left to the order of the windows."""
    lo, hi, u0, u1 = ("x0", "x1", "y0", "y1") if along == "x" else ("y0", "y1", "x0", "x1")
    ks = keys.split(", ")
    on = " AND ".join(f"s.{k} = l.{k}" for k in ks)
    cut = f"""(SELECT DISTINCT {keys}, x0, y0, x1, y1 FROM {src}) s JOIN (SELECT {keys}, v AS a, lead(v) OVER (PARTITION BY {keys} ORDER BY v) AS b FROM (
          SELECT {keys}, {lo} AS v FROM {src} UNION SELECT {keys}, {hi} FROM {src})) l
        ON {on} AND l.b IS NOT NULL AND s.{lo} <= l.a AND s.{hi} >= l.b"""
    if once:
        cut = f"""(SELECT DISTINCT {", ".join("s." + k for k in ks)}, a, b, {u0}, {u1} FROM {cut}) s"""
    return f"""SELECT {keys}, a AS {lo}, b AS {hi}, min({u0}) AS {u0}, max({u1}) AS {u1} FROM (
    SELECT *, sum(CASE WHEN prev IS NULL OR {u0} > prev THEN 1 ELSE 0 END) OVER (
        PARTITION BY {keys}, a ORDER BY {u0}, {u1} ROWS UNBOUNDED PRECEDING) AS isl FROM (
      SELECT {", ".join("s." + k for k in ks)}, a, b, {u0}, {u1}, max({u1}) OVER (PARTITION BY {", ".join("s." + k for k in ks)}, a ORDER BY {u0}, {u1}
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
      FROM {cut})) GROUP BY {keys}, a, b, isl"""


def comp_sql(nodes: str, e: str) -> str:
    return _COMP.format(e=e).replace("FROM rooms n", f"FROM {nodes} n")


CTE["grown_rooms"] = "SELECT DISTINCT plan_id, x0 - 30 AS x0, y0 - 30 AS y0, x1 + 30 AS x1, y1 + 30 AS y1 FROM rooms"
CTE["grown_rows"] = "SELECT plan_id, x0 + 30 AS x0, x1 - 30 AS x1, y0, y1 FROM (" + slab_sql("grown_rooms", "y") + ") WHERE x1 - x0 > 60"
CTE["closed_plan"] = "SELECT plan_id, x0, x1, y0 + 30 AS y0, y1 - 30 AS y1 FROM (" + slab_sql("grown_rows", "x") + ") WHERE y1 - y0 > 60"
CTE["closed_pieces"] = "SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY x0, y0) - 1 AS idx FROM closed_plan"
CTE["closed_links"] = """SELECT a.plan_id, a.idx AS i, b.idx AS j FROM closed_pieces a JOIN closed_pieces b
  ON a.plan_id = b.plan_id AND a.x1 = b.x0 AND least(a.y1, b.y1) > greatest(a.y0, b.y0)"""
CTE["closed_comp"] = comp_sql("closed_pieces", "closed_links")
CTE["gap_pieces"] = """SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY x0, y0) - 1 AS idx FROM (
  WITH d AS (SELECT *, lead(y0) OVER w AS nxt, lag(y1) OVER w AS prv FROM closed_plan WINDOW w AS (PARTITION BY plan_id, x0 ORDER BY y0)),
  g AS (SELECT plan_id, x0, x1, y1 AS y0, coalesce(nxt, 1000000000) AS y1, nxt IS NULL AS o FROM d
        UNION ALL SELECT plan_id, x0, x1, -1000000000, y0, true FROM d WHERE prv IS NULL)
  SELECT g.plan_id, g.x0, g.x1, g.y0, g.y1, g.o OR NOT EXISTS (FROM closed_plan c WHERE c.plan_id = g.plan_id AND c.x0 = g.x1)
      OR NOT EXISTS (FROM closed_plan c WHERE c.plan_id = g.plan_id AND c.x1 = g.x0) AS o
  FROM g WHERE g.plan_id IN (SELECT plan_id FROM g WHERE NOT o))"""
CTE["gap_links"] = """SELECT a.plan_id, a.idx AS i, b.idx AS j FROM gap_pieces a JOIN gap_pieces b
  ON a.plan_id = b.plan_id AND a.x1 = b.x0 AND least(a.y1, b.y1) > greatest(a.y0, b.y0)"""
CTE["gap_comp"] = comp_sql("gap_pieces", "gap_links")
CTE["hole_parts"] = """SELECT p.* FROM gap_pieces p JOIN gap_comp c ON p.plan_id = c.plan_id AND p.idx = c.idx
  WHERE NOT EXISTS (FROM gap_pieces q JOIN gap_comp d ON q.plan_id = d.plan_id AND q.idx = d.idx
                    WHERE q.o AND d.plan_id = c.plan_id AND d.comp = c.comp)"""
CTE["plan_holes"] = """SELECT c.plan_id, c.closed_cm2, coalesce(h.hole_cm2, 0) AS hole_cm2 FROM
    (SELECT plan_id, CAST(sum((x1 - x0) * (y1 - y0)) AS BIGINT) AS closed_cm2 FROM closed_plan GROUP BY plan_id) c LEFT JOIN
    (SELECT plan_id, CAST(sum((x1 - x0) * (y1 - y0)) AS BIGINT) AS hole_cm2 FROM hole_parts GROUP BY plan_id) h ON c.plan_id = h.plan_id"""
