"""Exact dedup by content sort, in DataFrame operations only.

Sampled splitters over (first characters, SHA-256, id) cut the order of normalised texts into ranges; a range is sorted
externally by (first characters, SHA-256, whole normalised text, id), so equal texts are neighbours; each text is compared
in full with its predecessor. Splitters hold a bounded prefix and a digest, so their size does not depend on text lengths,
and the id, so a group of copies of any size is cut into several ranges. Pieces of one group are joined again by comparing
the texts at the borders of ranges (two per range).
"""
from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, documents, partitions, saved

SAMPLES_PER_RANGE = 64
PREFIX_CHARS = 32


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", " ")


def _splitters(keyed: DataFrame, ranges: int) -> list[dict]:
    """At most ``ranges - 1`` cut points from about SAMPLES_PER_RANGE * ranges rows drawn by a hash of id and length."""
    total = keyed.count()
    want = SAMPLES_PER_RANGE * ranges
    draw = keyed.filter(F.pmod(F.xxhash64("id", F.length("norm"), F.lit(7)), F.lit(max(total, 1))) < want) if total > want else keyed
    rows = draw.select("p", "sha", "id").collect()
    rows = sorted({(r.p, r.sha, r.id is None, r.id or 0) for r in rows})
    picks = sorted({len(rows) * k // ranges for k in range(1, ranges)}) if rows else []
    return [{"p": p, "sha": s, "missing": n, "id": i} for p, s, n, i in (rows[j] for j in picks)]


def content_sort(df: DataFrame, carry: tuple = ()) -> DataFrame:
    """Groups of equal normalised texts of (doc_id, text), one row per input row.

    Result: doc_id, keep_id, group_size, kept, text_sha256 and the columns of ``carry`` as in_<name>. Null text counts as empty. The row
    with the smallest doc_id stays (null ids come last); of fully repeated rows exactly one stays. Texts are equal when
    they agree after runs of white space become one space, whatever their length. An empty table gives an empty result."""
    spark = df.sparkSession
    ranges = partitions(spark)
    keyed = df.select(F.col("doc_id").cast("long").alias("id"), normalised(F.col("text")).alias("norm"),
                      F.struct(*[F.col(c) for c in carry] or [F.lit(0).alias("none")]).alias("rest"))
    keyed = keyed.withColumns({"p": F.substring("norm", 1, PREFIX_CHARS), "sha": F.sha2(F.col("norm"), 256)})
    cuts = _splitters(keyed, ranges)
    steps = max(1, len(cuts).bit_length())
    table = F.from_json(F.lit(json.dumps(cuts)), "array<struct<p:string,sha:string,missing:boolean,id:bigint>>")
    key = F.struct("p", "sha", F.col("id").isNull().alias("missing"), F.coalesce("id", F.lit(0)).alias("id"))

    def halve(acc, _):
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        right = (acc["lo"] < acc["hi"]) & (F.element_at(table, mid + 1) <= key)
        return F.when(right, F.struct((mid + 1).alias("lo"), acc["hi"].alias("hi"))).otherwise(
            F.struct(acc["lo"].alias("lo"), F.least(mid, acc["hi"]).alias("hi")))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))
    bucket = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda acc: acc["lo"]) if cuts else F.lit(0)
    order = ["p", "sha", "norm", F.col("id").asc_nulls_last()]
    w = Window.partitionBy("bucket").orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = (keyed.withColumn("bucket", bucket)
             .withColumns({"before": F.lag("norm").over(w), "at_end": F.lead(F.lit(1)).over(w).isNull()})
             .withColumn("first", F.col("before").isNull() | (F.col("before") != F.col("norm")))
             .withColumn("g", F.sum(F.col("first").cast("long")).over(upto))
             .select("bucket", "g", "id", "sha", "first", "rest",
                     F.when(F.col("before").isNull() | F.col("at_end"), F.col("norm")).alias("edge")))
    lines = saved(lines, "content-sort")
    local = lines.groupBy("bucket", "g").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("m"))
    edges = lines.filter(F.col("edge").isNotNull()).select("bucket", "g", "edge").distinct()
    whole = edges.join(local, ["bucket", "g"]).groupBy("edge").agg(F.sum("n").alias("all_n"), F.min("m").alias("all_m"))
    joined = edges.join(whole, "edge").select("bucket", "g", "all_n", "all_m")
    sized = local.join(joined, ["bucket", "g"], "left").select(
        "bucket", "g", F.when(F.col("all_n").isNull(), F.col("m")).otherwise(F.col("all_m")).alias("keep_id"),
        F.coalesce("all_n", "n").alias("group_size"))
    out = lines.join(sized, ["bucket", "g"])
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size",
                      (F.col("first") & F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"), F.col("sha").alias("text_sha256"),
                      *[F.col("rest")[c].alias(f"in_{c}") for c in carry])


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns."""
    keep = content_sort(docs, tuple(docs.columns)).filter("kept")
    return keep.select(*[F.col(f"in_{c}").alias(c) for c in docs.columns])


def op2_content_sort(spark, sf_dir):
    return content_sort(documents(spark, sf_dir))


SQL = """
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t.norm) AS text_sha256 FROM t JOIN g ON t.norm = g.norm
"""
