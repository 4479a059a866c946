"""Dataset statistics: composition, percentiles, violations, connections, average graph."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import type_group
from ..operators.ranking import quantiles
from ..vocab import STAT_TYPES
from .rules import room_attributes

C, lit = F.col, F.lit


def stat_rooms(plans: DataFrame, rooms: DataFrame) -> DataFrame:
    """Rooms with attributes, dataset, grouped type, and the canonical type kept for thresholds."""
    r = room_attributes(rooms).withColumn("type_canonical", C("type")).withColumn("type", type_group(C("type")))
    return r.join(plans.select("plan_id", "dataset").hint("merge"), "plan_id")


def composition(plans: DataFrame, rooms: DataFrame) -> DataFrame:
    """Per dataset and type: share of plans having it and mean count, zeros included."""
    n = plans.groupBy("dataset").agg(F.count(lit(1)).alias("n"))
    c = rooms.groupBy("dataset", "plan_id", "type").agg(F.count(lit(1)).alias("c")).groupBy("dataset", "type").agg(
        F.count(lit(1)).alias("with_type"), F.sum("c").alias("total"))
    grid = n.withColumn("type", F.explode(F.array(*[lit(t) for t in STAT_TYPES])))
    d = grid.join(c, ["dataset", "type"], "left")
    return d.select("dataset", "type", (F.coalesce("with_type", lit(0)) / C("n")).alias("presence"),
                    (F.coalesce("total", lit(0)) / C("n")).alias("mean_count"))


def area_percentiles(rooms: DataFrame, by=("dataset", "type")) -> DataFrame:
    by = list(by)
    a = quantiles(rooms, by, "area_cm2", [0.05, 0.5, 0.95], "area_p")
    w = quantiles(rooms, by, "width_cm", [0.05, 0.5, 0.95], "width_p").drop("n")
    return a.withColumnRenamed("n", "n_rooms").join(w, by)


def violations(rooms: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Share of rooms per type below area or width, or above aspect; unconstrained types leave the denominator."""
    t = thresholds.withColumnRenamed("type", "type_canonical")
    r = rooms.join(F.broadcast(t), "type_canonical")
    return r.groupBy("dataset", "type").agg(
        F.count(lit(1)).alias("n_rooms"),
        F.avg((C("area_cm2") < C("min_area") * 10000).cast("double")).alias("below_min_area"),
        F.avg((C("width_cm") < C("min_width") * 100).cast("double")).alias("below_min_width"),
        F.avg((C("aspect") > C("max_aspect")).cast("double")).alias("above_max_aspect"))


def typed_edges(edges: DataFrame, rooms: DataFrame) -> DataFrame:
    """Distinct (plan, i, j, kind) with dataset and the types of both ends."""
    t = rooms.select("plan_id", "idx", "type", "dataset")
    e = edges.select("plan_id", "i", "j", "kind").distinct()
    return e.join(t.select("plan_id", C("idx").alias("i"), C("type").alias("ta"), "dataset").hint("merge"), ["plan_id", "i"]) \
        .join(t.select("plan_id", C("idx").alias("j"), C("type").alias("tb")).hint("merge"), ["plan_id", "j"])


def neighbour_types(te: DataFrame) -> DataFrame:
    """Distinct (room, neighbour type), both directions."""
    return te.select("dataset", "kind", "plan_id", C("i").alias("idx"), C("ta").alias("type"), C("tb").alias("nb")).unionByName(
        te.select("dataset", "kind", "plan_id", C("j").alias("idx"), C("tb").alias("type"), C("ta").alias("nb"))).distinct()


def p_room(te: DataFrame, rooms: DataFrame) -> DataFrame:
    """Chance that a room of a type has at least one neighbour of another type."""
    n = rooms.groupBy("dataset", "type").agg(F.count(lit(1)).alias("n"))
    k = neighbour_types(te).groupBy("dataset", "kind", "type", "nb").agg(F.count(lit(1)).alias("k"))
    return k.join(n, ["dataset", "type"]).select("dataset", "kind", C("type").alias("type_a"), C("nb").alias("type_b"),
                                                 (C("k") / C("n")).alias("p_room"))


def p_plan(te: DataFrame, rooms: DataFrame) -> DataFrame:
    """Chance that a plan connects two types, given both are present (twice, for a pair of equal types)."""
    pairs = te.select("dataset", "kind", "plan_id", F.least("ta", "tb").alias("type_a"), F.greatest("ta", "tb").alias("type_b"))
    k = pairs.distinct().groupBy("dataset", "kind", "type_a", "type_b").agg(F.count(lit(1)).alias("k"))
    # At most 15 types per plan, so pairs of present types stay bounded whatever the number of rooms.
    c = rooms.groupBy("dataset", "plan_id", "type").agg(F.count(lit(1)).alias("c"))
    b = c.select("plan_id", C("type").alias("type_b"))
    both = c.withColumnRenamed("type", "type_a").join(b.hint("merge"), "plan_id").filter(
        (C("type_a") < C("type_b")) | ((C("type_a") == C("type_b")) & (C("c") >= 2)))
    both = both.groupBy("dataset", "type_a", "type_b").agg(F.count(lit(1)).alias("n_plans_both"))
    kinds = te.select("kind").distinct()
    d = both.crossJoin(F.broadcast(kinds)).join(k, ["dataset", "kind", "type_a", "type_b"], "left")
    return d.select("dataset", "kind", "type_a", "type_b", (F.coalesce("k", lit(0)) / C("n_plans_both")).alias("p_plan"), "n_plans_both")


def mean_edges(te: DataFrame, plans: DataFrame) -> DataFrame:
    n = plans.groupBy("dataset").agg(F.count(lit(1)).alias("n"))
    k = te.groupBy("dataset", "kind", F.least("ta", "tb").alias("type_a"), F.greatest("ta", "tb").alias("type_b")).agg(
        F.count(lit(1)).alias("k"))
    return k.join(n, "dataset").select("dataset", "kind", "type_a", "type_b", (C("k") / C("n")).alias("mean_edges"))


def average_graph(comp: DataFrame, edges: DataFrame, min_count: float = 0.1, min_edges: float = 0.1) -> DataFrame:
    """Nodes above the mean count and edges above the mean number between kept nodes, as one table."""
    nodes = comp.filter(C("mean_count") >= min_count)
    keep = nodes.select("dataset", C("type").alias("type_a"))
    e = edges.filter(C("mean_edges") >= min_edges).join(keep, ["dataset", "type_a"], "left_semi") \
        .join(keep.withColumnRenamed("type_a", "type_b"), ["dataset", "type_b"], "left_semi")
    return nodes.select("dataset", lit("node").alias("kind"), C("type").alias("a"), lit(None).cast("string").alias("b"),
                        C("mean_count").alias("value")).unionByName(
        e.select("dataset", "kind", C("type_a").alias("a"), C("type_b").alias("b"), C("mean_edges").alias("value")))


def dataset_info(plans: DataFrame, rooms: DataFrame, union: DataFrame, doors: DataFrame) -> DataFrame:
    """Plans, mean rooms, mean area, and whether door connections are reported (mean doors of at least 0.5)."""
    n = rooms.groupBy("plan_id").agg(F.count(lit(1)).alias("n_rooms"))
    d = doors.groupBy("plan_id").agg(F.count(lit(1)).alias("n_doors"))
    p = plans.join(n, "plan_id", "left").join(union.select("plan_id", "union_cm2"), "plan_id", "left").join(d, "plan_id", "left")
    g = p.groupBy("dataset").agg(
        F.count(lit(1)).alias("n_samples"), F.avg(F.coalesce("n_rooms", lit(0))).alias("mean_rooms"),
        F.avg(F.when(C("scale_known"), C("union_cm2"))).alias("mean_area_cm2"), F.avg(F.coalesce("n_doors", lit(0))).alias("doors"))
    return g.withColumn("kinds", F.when(C("doors") >= 0.5, "wall+door").otherwise("wall")).drop("doors")
