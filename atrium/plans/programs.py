"""Programs and room graphs: depth order, hanging rooms, stairs, program records."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import both_ways
from ..session import checkpointed

C, lit = F.col, F.lit


def _depth_fold(rooms, edges, seeds):
    """Depths of a plan's rooms in one row: relax the edge list as often as the plan has rooms, stop when stable."""
    e = both_ways(edges).groupBy("plan_id").agg(F.collect_list(F.struct(C("idx").alias("a"), C("nb").alias("b"))).alias("es"))
    n = rooms.groupBy("plan_id").agg(F.count(lit(1)).alias("n"))
    d = seeds.join(n, "plan_id").join(e, "plan_id", "left")
    d = d.withColumn("es", F.coalesce("es", F.array().cast("array<struct<a:bigint,b:bigint>>")))
    d = d.withColumn("m", F.expr("""
        aggregate(sequence(1, CAST(n AS INT)), map(seed, 0), (m, r) ->
          CASE WHEN r > 1 AND NOT exists(map_values(m), v -> v = r - 1) THEN m
          ELSE map_concat(m, map_from_arrays(
            array_distinct(transform(filter(es, e -> m[e.a] = r - 1 AND m[e.b] IS NULL), e -> e.b)),
            transform(array_distinct(transform(filter(es, e -> m[e.a] = r - 1 AND m[e.b] IS NULL), e -> e.b)), x -> r))) END)"""))
    return d.select("plan_id", F.explode("m").alias("idx", "depth"))


def _depth_joins(edges, seeds):
    """Breadth-first frontier by joins, one round per depth, for plans of any size."""
    nb = checkpointed(both_ways(edges))
    seen = seeds.select("plan_id", C("seed").alias("idx"), lit(0).alias("depth"))
    front, depth = seen, 0
    while True:
        depth += 1
        nxt = front.join(nb, ["plan_id", "idx"]).select("plan_id", C("nb").alias("idx")).distinct().join(
            seen.select("plan_id", "idx"), ["plan_id", "idx"], "left_anti").withColumn("depth", lit(depth))
        front = checkpointed(nxt)
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)


def bfs_depth(rooms: DataFrame, edges: DataFrame, seeds: DataFrame, large: DataFrame | None = None) -> DataFrame:
    """(plan_id, idx, depth) of the rooms reachable from the seed."""
    if large is None:
        return _depth_fold(rooms, edges, seeds)
    anti, semi = (lambda d: d.join(large, "plan_id", "left_anti")), (lambda d: d.join(large, "plan_id", "left_semi"))
    return _depth_fold(anti(rooms), anti(edges), anti(seeds)).unionByName(_depth_joins(semi(edges), semi(seeds)))


def hanging_rooms(rooms: DataFrame, edges: DataFrame) -> DataFrame:
    """Rooms with one neighbour, grouped under it. The root (entrance, else stairs, else most doors) and its rooms stay."""
    nb = both_ways(edges)
    deg = rooms.select("plan_id", "idx", "type").join(
        nb.groupBy("plan_id", "idx").agg(F.count(lit(1)).alias("deg"), F.min("nb").alias("nb")), ["plan_id", "idx"], "left")
    deg = deg.withColumn("deg", F.coalesce("deg", lit(0)))
    root = deg.groupBy("plan_id").agg(F.coalesce(
        F.min(F.when(C("type") == "entrance", C("idx"))), F.min(F.when(C("type") == "other", C("idx"))),
        F.max_by("idx", F.struct("deg", -C("idx")))).alias("root"))
    h = deg.join(root, "plan_id").filter("deg = 1 AND idx <> root").select("plan_id", "idx", C("nb").alias("host"), "root")
    return h.filter("host <> root").join(h.select("plan_id", C("idx").alias("host")), ["plan_id", "host"], "left_anti").select(
        "plan_id", "idx", "host", "root")


def stair_rooms(rooms: DataFrame, storeys: DataFrame, halls=("corridor", "entrance")) -> DataFrame:
    """One synthetic stair room per storey of a multi-storey home: at its stair room, else in its largest hall,
    else in its largest room."""
    s = storeys.filter("n_storeys > 1").join(rooms, "plan_id")
    area = (C("x1") - C("x0")) * (C("y1") - C("y0"))
    key = F.struct(F.when(C("type") == "other", 0).when(C("type").isin(*halls), 1).otherwise(2).alias("p"), (-area).alias("a"), C("idx").alias("i"))
    return s.groupBy("home", "storey", "plan_id").agg(F.min(key).alias("k")).select(
        "home", "storey", "plan_id", C("k.i").alias("host"), C("k.p").alias("rule"))


def program_rooms(rooms: DataFrame, exterior=("living_room", "bedroom", "kitchen", "study")) -> DataFrame:
    """Program rooms of a plan: id, type, target area, need of an outer wall."""
    return rooms.select("plan_id", F.concat(lit("r"), C("idx")).alias("id"), "type",
                        (((C("x1") - C("x0")) * (C("y1") - C("y0"))) / 10000).alias("target_net_area"), C("type").isin(*exterior).alias("needs_exterior"))


def bubble_edges(node_edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Room - door - room in a bubble diagram becomes one door edge when a door touches exactly two rooms."""
    d = node_edges.select(C("plan_id"), C("a"), C("b")).unionByName(node_edges.select("plan_id", C("b").alias("a"), C("a").alias("b")))
    t = nodes.select("plan_id", C("node").alias("a"), C("kind").alias("ka"))
    u = nodes.select("plan_id", C("node").alias("b"), C("kind").alias("kb"))
    x = d.join(t, ["plan_id", "a"]).join(u, ["plan_id", "b"]).filter("ka = 'door' AND kb = 'room'")
    g = x.groupBy("plan_id", "a").agg(F.count_distinct("b").alias("n"), F.min("b").alias("i"), F.max("b").alias("j"))
    return g.filter("n = 2").select("plan_id", "i", "j").distinct()
