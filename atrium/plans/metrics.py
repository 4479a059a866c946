"""Per-plan metrics, paired metrics and summaries. Missing values are NULL, so means skip them."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..vocab import ROOM_TYPES
from .rules import room_attributes

C, lit = F.col, F.lit


def plan_counts(plans: DataFrame, rooms: DataFrame) -> DataFrame:
    """Room counts per plan and type; a plan without rooms keeps zeros."""
    n = [F.count(F.when(C("type") == t, 1)).alias(f"n_{t}") for t in ROOM_TYPES]
    c = rooms.groupBy("plan_id").agg(F.count(lit(1)).alias("n_rooms"), *n)
    d = plans.select("plan_id").join(c, "plan_id", "left")
    return d.select("plan_id", *[F.coalesce(x, lit(0)).alias(x) for x in c.columns[1:]])


def plan_shares(plans: DataFrame, rooms: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Shares of violating rooms per plan. Unconstrained types never violate; metric rules need a known scale."""
    r = room_attributes(rooms).join(F.broadcast(thresholds), "type", "left")
    r = r.join(plans.select("plan_id", "scale_known").hint("merge"), "plan_id")
    bad_aspect = F.coalesce(C("aspect") > C("max_aspect"), lit(False)).cast("double")
    known = C("scale_known")
    d = r.groupBy("plan_id").agg(
        F.avg(bad_aspect).alias("frac_aspect_violation"),
        F.avg(F.when(known, (C("area_cm2") < C("min_area") * 10000).cast("double"))).alias("frac_area_violation"),
        F.avg(F.when(known, (C("width_cm") < C("min_width") * 100).cast("double"))).alias("frac_width_violation"),
        F.avg("aspect").alias("mean_aspect"))
    return plans.select("plan_id").join(d.hint("merge"), "plan_id", "left")


def any_rule(overlap, hole, adj_components, aspect, area, width):
    """Combined flag with strict limits; missing parts do not violate."""
    parts = [overlap > 0.02, hole > 0.02, adj_components > 1, aspect > 0, area > 0, width > 0]
    flag = lit(False)
    for p in parts:
        flag = flag | F.coalesce(p, lit(False))
    return flag


def summarize(df: DataFrame, by: list[str], digits: int = 6) -> DataFrame:
    """Mean of every numeric column per group, missing values skipped."""
    num = [f.name for f in df.schema.fields if f.name not in by and f.dataType.typeName() in (
        "integer", "long", "double", "float", "short", "byte")]
    return df.groupBy(*by).agg(*[F.round(F.avg(c), digits).alias(c) for c in num])


def type_multiset(gen: DataFrame, gt: DataFrame) -> DataFrame:
    """Count error, L1 distance of type histograms and multiset equality of plans present on both sides."""
    g = gen.groupBy("plan_id", "type").agg(F.count(lit(1)).alias("a"))
    h = gt.groupBy("plan_id", "type").agg(F.count(lit(1)).alias("b"))
    j = g.join(h, ["plan_id", "type"], "full_outer").select(
        "plan_id", "type", F.coalesce("a", lit(0)).alias("a"), F.coalesce("b", lit(0)).alias("b"))
    d = j.groupBy("plan_id").agg(F.sum("a").alias("n"), F.sum("b").alias("n_gt"), F.sum(F.abs(C("a") - C("b"))).alias("type_hist_l1"))
    return d.select("plan_id", F.abs(C("n") - C("n_gt")).alias("room_count_abs_err"), (C("n") == C("n_gt")).alias("room_count_match"),
                    "type_hist_l1", (C("type_hist_l1") == 0).alias("type_multiset_match"))


def typed_pairs(edges: DataFrame, rooms: DataFrame) -> DataFrame:
    """Edges with their sorted type pair."""
    t = rooms.select("plan_id", "idx", "type")
    e = edges.join(t.select("plan_id", C("idx").alias("i"), C("type").alias("ti")), ["plan_id", "i"]) \
        .join(t.select("plan_id", C("idx").alias("j"), C("type").alias("tj")), ["plan_id", "j"])
    return e.withColumn("ta", F.least("ti", "tj")).withColumn("tb", F.greatest("ti", "tj"))


def multiset_f1(pred: DataFrame, ref: DataFrame, plans: DataFrame) -> DataFrame:
    """F1 of two edge-type multisets per plan: both empty = 1, one empty = 0."""
    k = ["plan_id", "ta", "tb"]
    p = pred.groupBy(*k).agg(F.count(lit(1)).alias("p"))
    r = ref.groupBy(*k).agg(F.count(lit(1)).alias("r"))
    s = p.join(r, k, "full_outer").groupBy("plan_id").agg(
        F.coalesce(F.sum("p"), lit(0)).alias("np"), F.coalesce(F.sum("r"), lit(0)).alias("nr"),
        F.coalesce(F.sum(F.least("p", "r") * F.when(C("p").isNotNull() & C("r").isNotNull(), 1)), lit(0)).alias("tp"))
    d = plans.select("plan_id").join(s, "plan_id", "left").na.fill(0, ["np", "nr", "tp"])
    f1 = F.when((C("np") == 0) & (C("nr") == 0), 1.0).when((C("np") == 0) | (C("nr") == 0), 0.0) \
        .otherwise(2.0 * C("tp") / (C("np") + C("nr")))
    return d.select("plan_id", f1.alias("adjacency_f1"))


def pair_ids(gen: DataFrame, gt: DataFrame) -> DataFrame:
    """(gen_id, gt_id): the exact id first, otherwise the id without its ``_<k>`` suffix; unmatched ids stay."""
    from ..functions.labels import gt_base_id
    g = gt.select(C("gt_id").alias("exact"))
    d = gen.join(g, C("gen_id") == C("exact"), "left").withColumn("base", F.when(C("exact").isNull(), gt_base_id(C("gen_id"))))
    d = d.join(gt.select(C("gt_id").alias("stripped")), C("base") == C("stripped"), "left")
    return d.select("gen_id", F.coalesce("exact", "stripped").alias("gt_id"))


def yield_share(pairs: DataFrame, n_inputs: DataFrame) -> DataFrame:
    """Samples over inputs times the largest number of samples any input has."""
    per = pairs.groupBy("gt_id").agg(F.count(lit(1)).alias("n"))
    m = per.agg(F.sum("n").alias("n_samples"), F.max(F.when(C("gt_id").isNotNull(), C("n"))).alias("per_input"))
    return m.crossJoin(n_inputs.agg(F.count(lit(1)).alias("n_inputs"))).select(
        "n_samples", "n_inputs", F.round(C("n_samples") / (C("n_inputs") * F.coalesce("per_input", lit(1))), 9).alias("yield"))
