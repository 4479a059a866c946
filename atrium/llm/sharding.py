"""K-d tree sharding: split at distributed weighted medians along the widest metadata dimension."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, running, saved

DIMENSIONS = ("lang", "source", "n_chars")


def _with_axis(df: DataFrame, name: str, axis: str, text: bool) -> DataFrame:
    """Replace a dimension by a number that grows with it, missing values lowest: texts by the rank among their distinct values.

    Values are ranked by one range sort of the distinct ones, however long or alike they are; the join has one row per value on one side."""
    if not text:
        return df.withColumn(axis, F.coalesce(F.col(name).cast("double"), F.lit(-1.0))).drop(name)
    values = df.filter(F.col(name).isNotNull()).select(name).distinct().withColumn("all", F.lit(0).cast("long")).withColumn("one", F.lit(1).cast("long"))
    ranks = running(values, "all", [F.col(name)], "one", "kd-values").select(name, F.col("pos").cast("double").alias(axis))
    return df.join(ranks, name, "left").withColumn(axis, F.coalesce(axis, F.lit(-1.0))).drop(name)


def kd_shards(df: DataFrame, shards: int | None = None, target_bytes: int | None = None, dimensions=DIMENSIONS) -> DataFrame:
    """Shard every row of (doc_id, text, *dimensions) into leaves of nearly equal bytes.

    A node that stands for k leaves is cut at the weighted quantile floor(k/2) / k along its dimension of largest extent
    (as a share of the whole extent); ties follow the text's CRC-32 and doc_id, so equal texts stay neighbours and a group
    of any size can be cut. Cuts are exact: each level is one range shuffle of a narrow table with running byte sums.
    ``target_bytes`` sets the number of leaves where ``shards`` is not given. Size is UTF-8 bytes plus 16 (null text: 16).
    Result: doc_id, size, text_crc32, shard, slot. Repeated rows are rows of their own; an empty table gives no rows."""
    axes = [f"a{k}" for k in range(len(dimensions))]
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
                     F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("crc"), *[F.col(d).alias(f"d_{d}") for d in dimensions],
                     F.lit(0).cast("long").alias("node"))
    rows = saved(rows, "kd-rows")
    for a, d in zip(axes, dimensions):
        rows = _with_axis(rows, f"d_{d}", a, dict(df.dtypes)[d] == "string")
    rows = saved(rows, "kd-axes")
    if shards is None:
        shards = max(1, -(-(rows.agg(F.sum("size")).first()[0] or 0) // int(target_bytes)))
    extent = rows.agg(*[(F.max(a) - F.min(a)).alias(a) for a in axes]).first()
    # a node is the first shard of its range; leaves holds how many shards it stands for
    rows = rows.withColumn("leaves", F.lit(shards).cast("long"))
    for _ in range((shards - 1).bit_length()):
        stats = rows.groupBy("node").agg(F.sum("size").alias("total"), *[((F.max(a) - F.min(a)) / F.lit(extent[a] or 1.0)).alias(f"w_{a}") for a in axes])
        widest = F.greatest(*[F.col(f"w_{a}") for a in axes], F.lit(0.0))
        pick = F.lit(0.0)
        for a in reversed(axes):
            pick = F.when(F.col(f"w_{a}") == widest, F.col(a)).otherwise(pick)
        cut = rows.join(stats, "node").withColumn("axis", pick).drop(*[f"w_{a}" for a in axes])
        cut = running(cut, "node", [F.col("axis"), F.col("crc"), F.col("doc_id")], "size", "kd-level")
        half = F.floor(F.col("leaves") / 2)
        left = (F.col("before") + F.col("size") / 2) * F.col("leaves") <= F.col("total") * half
        rows = cut.select("doc_id", "size", "crc", *axes, F.when(left | (F.col("leaves") == 1), F.col("node")).otherwise(F.col("node") + half).alias("node"),
                          F.when(F.col("leaves") == 1, F.lit(1)).when(left, half).otherwise(F.col("leaves") - half).cast("long").alias("leaves"))
    placed = running(rows, "node", [F.col("crc"), F.col("doc_id")], "size", "kd-slots")
    return placed.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.col("node").cast("int").alias("shard"), F.col("pos").alias("slot"))


def op1_kd_shards(spark, sf_dir):
    out = kd_shards(documents(spark, sf_dir), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
