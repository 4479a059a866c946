"""Time-varying curriculum: sources are mixed to target weights along a weight schedule over training time."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, documents, partitions, placed_rows, running, saved

# Parameters of the registered mix: weights by rank of source, demand in relation to all sizes, most passes over a source.
WEIGHTS = (3, 1, 2)
DEMAND = 1.5
PASSES = 2
# Schedule of a source by rank: (training time, relative weight) knots, linear in between.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 0.5), (0.5, 1.5), (1.0, 0.5)))


def n_words(text):
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text."""
    t = F.coalesce(text, F.lit(""))
    return F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _time(share, knots):
    """Training time at which a source has had ``share`` (0 to 1) of its demand: inverse of the integrated schedule."""
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:])]
    whole, done, out = sum(areas), 0.0, F.lit(float(knots[-1][0]))
    cases = []
    for area, (t0, w0), (t1, w1) in zip(areas, knots, knots[1:]):
        y = F.greatest(share * whole - done, F.lit(0.0))
        slope = (w1 - w0) / (t1 - t0)
        x = y / w0 if abs(slope) < 1e-12 else (F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * y, F.lit(0.0))) - w0) / slope
        done += area
        cases.append((share * whole <= done, F.lit(t0) + F.least(x, F.lit(t1 - t0))))
    for test, value in reversed(cases):
        out = F.when(test, value).otherwise(out)
    return out


def targets(sizes: DataFrame, weights=WEIGHTS, demand=DEMAND, passes=PASSES) -> DataFrame:
    """Targets of sources (source, source_size): code (rank by code point, null last), target.

    Shares follow the weights; a target stops at ``passes`` times its source's size, and the excess is shared again by
    weight until none is above: the level c with sum(min(cap, c * weight)) = demand. One row per source in, one out."""
    by_rank = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("code", F.row_number().over(by_rank).cast("long") - 1)
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("code") % len(weights)).cast("int") + 1)
    ranked = ranked.withColumns({"weight": pick, "cap": F.col("source_size") * float(passes)})
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "code")
    before, every = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.lit(float(demand)) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("level", level)
    # sources in order of cap / weight are full up to the first whose cap is at or above its level
    found = F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "code", F.col("level").alias("c")))).over(every)["c"]
    return ranked.select("source", "source_size", "code", F.least("cap", F.coalesce(found, F.lit(math.inf)) * F.col("weight")).alias("target"))


def curriculum(df: DataFrame, weights=WEIGHTS, demand=DEMAND, passes=PASSES, schedules=SCHEDULES, carry: tuple = ()) -> DataFrame:
    """Assign training positions to (doc_id, text, source): one row per document and pass, range-sorted by position.

    A source's documents follow each other in a hashed order; a document's place in that cumulative demand, put through the
    inverse of the source's integrated weight schedule, is its time in training. The document in which the target is met
    is cut at that word. Every document has a row for pass 0; ``take`` 0 means not taken (time null, at the end).
    Result: row_id (of the document), doc_id, size, source_size, target, pass, take, time, position and ``carry`` as in_<name>.
    Null text has size 0, null source is a source; repeated rows are documents of their own; empty tables give no rows."""
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source"), n_words(F.col("text")).alias("size"),
                     F.struct(*[F.col(c) for c in carry] or [F.lit(0).alias("none")]).alias("rest"))
    docs = saved(docs, "mix-sizes")
    sizes = saved(docs.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    goal = saved(targets(sizes, weights, demand, passes), "mix-targets")
    coded = (docs.withColumnRenamed("source", "src").join(goal, F.col("src").eqNullSafe(F.col("source"))).drop("src", "source")
             .withColumn("mixed", F.xxhash64("doc_id", F.lit(11))))
    placed = running(coded, "code", [F.col("mixed"), F.col("doc_id"), F.col("size")], "size", "mix-order")
    goal_words = F.round("target").cast("long")
    start = F.col("before") + F.col("pass") * F.col("source_size")
    take = F.greatest(F.least(goal_words - start, F.col("size")), F.lit(0)).cast("long")
    share = (start + F.col("take") / 2) / F.nullif(goal_words, F.lit(0))
    kind = F.col("code") % len(schedules)
    time = F.lit(None).cast("double")
    for k, knots in enumerate(schedules):
        time = F.when((kind == k) & (F.col("take") > 0), _time(share, knots)).otherwise(time)
    taken = (placed.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1)))).withColumn("take", take)
             .filter((F.col("pass") == 0) | (F.col("take") > 0)).withColumn("time", time).withColumn("all", F.lit(0).cast("long"))
             .withColumnRenamed("pos", "in_source").drop("before"))
    ordered = running(taken, "all", [F.col("time").asc_nulls_last(), F.col("code"), F.col("in_source"), F.col("pass")], "take", "mix-sequence")
    return ordered.select(F.struct("code", "in_source").alias("row_id"), "doc_id", "size", "source_size", "target", "pass", "take", "time",
                          F.col("pos").alias("position"), *[F.col("rest")[c].alias(f"in_{c}") for c in carry])


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents in training order: one row per document and pass; the last document of a source may be cut
    at a word end. Documents that the mix does not take go; documents without words stay once.

    The mix is planned on narrow rows with a key for every row; texts move for the join and for the final order only."""
    spark, key = docs.sparkSession, ["row_file", "row_at"]
    rows = placed_rows(docs, docs.columns, "mix-documents")
    mix = curriculum(rows, carry=tuple(key)).filter((F.col("take") > 0) | ((F.col("size") == 0) & (F.col("pass") == 0)))
    plan = saved(mix.select(*[F.col(f"in_{k}").alias(k) for k in key], F.struct("take", "size", "position").alias("mixed_as")), "mix-plan")
    whole = rows.select(F.struct(*docs.columns).alias("row"), *key).join(plan, key)
    ordered = whole.repartitionByRange(partitions(spark), "mixed_as.position").sortWithinPartitions("mixed_as.position")
    cut = F.col("mixed_as.take") < F.col("mixed_as.size")
    text = F.when(cut, first_words(F.col("row.text"), F.col("mixed_as.take"))).otherwise(F.col("row.text"))
    out = {c: F.col("row")[c] for c in docs.columns} | {"text": text}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(cut, F.length(text)).otherwise(out["n_chars"])
    return ordered.select(*[out[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def first_words(text, count):
    """A text up to the end of its ``count``-th word, line breaks and spacing as they are.

    White space is one character each, so the stretches between single characters of it give the offsets."""
    start = F.struct(F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("end"))

    def step(s, part):
        words = s["words"] + F.when(part == "", 0).otherwise(1)
        end = F.when((part != "") & (words <= count), s["at"] + F.length(part)).otherwise(s["end"])
        return F.struct(words.cast("long").alias("words"), (s["at"] + F.length(part) + 1).cast("long").alias("at"), end.cast("long").alias("end"))

    end = F.aggregate(F.split(text, SPACE), start, step)["end"]
    return F.substring(text, F.lit(1), end.cast("int"))


def op3_curriculum(spark, sf_dir):
    mix = curriculum(documents(spark, sf_dir))
    out = mix.groupBy("row_id").agg(F.first("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("source_size").alias("source_size"),
                                    F.first("target").alias("target"), F.sum("take").alias("taken"),
                                    F.min(F.when(F.col("take") > 0, F.col("position"))).alias("first_position"))
    return out.drop("row_id")
