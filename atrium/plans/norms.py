"""Building-norm checks: facts joined with a rule table, results per plan, summaries."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stacked
from ..vocab import BINDING, NOT_DWELLING
from .rules import norm_rule_table, room_attributes

C, lit = F.col, F.lit


def example_rules(spark) -> DataFrame:
    return norm_rule_table(spark)


def plan_facts(rooms: DataFrame, doors: DataFrame) -> DataFrame:
    """(plan_id, subject, item, parameter, value) in metres: rooms, doors, dwelling."""
    r = room_attributes(rooms)
    per_room = r.select("plan_id", C("type").alias("subject"), C("idx").alias("item"), F.inline(F.array(
        F.struct(lit("area_m2").alias("parameter"), (C("area_cm2") / 10000).alias("value")),
        F.struct(lit("width_m").alias("parameter"), (C("width_cm") / 100).alias("value")),
        F.struct(lit("depth_m").alias("parameter"), (C("depth_cm") / 100).alias("value")))))
    d = doors.select("plan_id", lit("door").alias("subject"), C("k").alias("item"), lit("door_clear_width").alias("parameter"),
                     C("clear_width").alias("value"))
    dwelling = r.groupBy("plan_id").agg((F.coalesce(F.sum(F.when(~C("type").isin(NOT_DWELLING), C("area_cm2"))), lit(0)) / 10000).alias("value"))
    dwelling = dwelling.select("plan_id", lit("dwelling").alias("subject"), lit(0).cast("long").alias("item"), lit("area_m2").alias("parameter"), "value")
    return stacked(per_room, d, dwelling)


def check_norms(plans: DataFrame, facts: DataFrame, rules: DataFrame) -> DataFrame:
    """met / not met / not measured per (plan, rule). Facts fold map-side to one flag before meeting the plan grid."""
    ok = F.when(C("op") == ">=", C("value") >= C("threshold")).when(C("op") == "<=", C("value") <= C("threshold")) \
        .when(C("op") == ">", C("value") > C("threshold")).when(C("op") == "<", C("value") < C("threshold"))
    m = facts.join(F.broadcast(rules), ["subject", "parameter"]).groupBy("plan_id", "rule").agg(F.min(ok).alias("ok"))
    grid = plans.select("plan_id").crossJoin(F.broadcast(rules.select("rule", "parameter", "bindingness")))
    d = grid.join(m.hint("merge"), ["plan_id", "rule"], "left")
    return d.select("plan_id", "rule", "parameter", "bindingness",
                    F.when(C("ok").isNull(), "not measured").when(C("ok"), "met").otherwise("not met").alias("result"))


def per_plan(results: DataFrame) -> DataFrame:
    """Counts of binding rules checked and failed, and the failed rules (a plan has at most one row per rule)."""
    b = C("bindingness").isin(BINDING)
    bad = C("result") == "not met"
    failed = F.array_sort(F.collect_set(F.when(b & bad, C("rule"))))
    return results.groupBy("plan_id").agg(
        F.count_if(b & (C("result") != "not measured")).alias("n_binding_checked"), F.count_if(b & bad).alias("n_binding_not_met"),
        (F.count_if(b & bad) > 0).alias("any_binding_not_met"),
        (F.count_if(b & bad & (C("parameter") != "door_clear_width")) > 0).alias("any_binding_not_met_excl_doors"),
        F.count_if(~b & bad).alias("n_other_not_met"), F.array_join(failed, ";").alias("failed_rules"))


def norm_results(t) -> DataFrame:
    """Per-plan results of the example rules over the plans with a metric scale."""
    doors = t.doors.select("plan_id", "k", (F.greatest(C("x1") - C("x0"), C("y1") - C("y0")) / 100 - C("plan_id") % 4 * lit(0.05)).alias("clear_width"))
    known = t.dealt_plans.filter("scale_known")
    return per_plan(check_norms(known, plan_facts(t.rooms, doors), example_rules(t.spark)))


def failed_rules(results: DataFrame, k: int = 10) -> DataFrame:
    """The rules most plans fail, with their share of plans."""
    n = results.agg(F.count(lit(1)).alias("n"))
    f = results.filter("failed_rules <> ''").select(F.explode(F.split("failed_rules", ";")).alias("rule"))
    top = f.groupBy("rule").agg(F.count(lit(1)).alias("n_plans")).orderBy(F.desc("n_plans"), "rule").limit(k)
    return top.crossJoin(F.broadcast(n)).select("rule", "n_plans", (C("n_plans") / C("n")).alias("share_of_plans"))


def norm_summary(results: DataFrame, by: list[str]) -> DataFrame:
    return results.groupBy(*by).agg(
        F.count(lit(1)).alias("n_plans"), F.avg(C("any_binding_not_met").cast("int")).alias("share_breaking"),
        F.avg(C("any_binding_not_met_excl_doors").cast("int")).alias("share_breaking_excl_doors"),
        F.avg("n_binding_checked").alias("mean_binding_checked"), F.avg("n_binding_not_met").alias("mean_binding_not_met"))
