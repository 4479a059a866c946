"""Skew-safe ranking, top-k, hash-ordered sampling and exact quantiles."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import checkpointed


def _cols(order):
    return [F.col(c) if isinstance(c, str) else c for c in order]


def rank_distributed(df: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    """0-based position inside a group of any size; order by ascending expressions (negate for descending).

    One range sort spreads even a single group over all tasks. The sorted rows are checkpointed, so positions
    inside a task are stable; each (group, task) segment then only needs the row count of the segments before it.
    """
    marks = [f"__o{i}" for i in range(len(order))]
    d = df.select("*", *[c.alias(m) for c, m in zip(_cols(order), marks)])
    by = [*keys, *marks]
    d = d.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__m", F.monotonically_increasing_id())
    d = checkpointed(d).withColumn("__p", F.shiftright("__m", 33))
    seg = d.groupBy(*keys, "__p").agg(F.min("__m").alias("__lo"), F.count(F.lit(1)).alias("__c"))
    w = W.partitionBy(*keys).orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    seg = seg.select(*[F.col(k).alias(f"__s_{k}") for k in keys], F.col("__p").alias("__sp"), "__lo",
                     F.coalesce(F.sum("__c").over(w), F.lit(0)).alias("__off"))
    on = F.col("__p") == F.col("__sp")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__s_{k}"))
    return d.join(seg, on).select(*df.columns, (F.col("__m") - F.col("__lo") + F.col("__off")).alias(name))


def rank_within(df: DataFrame, keys: list[str], order: list, name: str, large: DataFrame | None = None) -> DataFrame:
    """0-based position inside each group; groups listed in ``large`` take the distributed path."""
    w = W.partitionBy(*keys).orderBy(*_cols(order))

    def plain(d):
        return d.withColumn(name, (F.row_number().over(w) - 1).cast("long"))

    if large is None:
        return plain(df)
    on = [c for c in large.columns if c in keys]
    small = plain(df.join(large, on, "left_anti"))
    big = rank_distributed(df.join(large, on, "left_semi"), keys, order, name)
    return small.unionByName(big)


def top_k(df: DataFrame, keys: list[str], order: list, k: int, salts: int = 64) -> DataFrame:
    """First k rows per group. A salted first pass leaves at most salts * k rows per group for the second."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(salts))
    d = df.withColumn("__s", salt)
    w1 = W.partitionBy(*keys, "__s").orderBy(*_cols(order))
    w2 = W.partitionBy(*keys).orderBy(*_cols(order))
    d = d.withColumn("__r", F.row_number().over(w1)).filter(F.col("__r") <= k).drop("__s")
    return d.withColumn("__r", F.row_number().over(w2)).filter(F.col("__r") <= k).withColumnRenamed("__r", "rank")


def hash_order(*cols, seed: int | str = 0) -> Column:
    """Reproducible pseudo-random order: md5 of the values and the seed."""
    return F.md5(F.concat_ws(":", *[F.col(c).cast("string") if isinstance(c, str) else c for c in cols],
                             F.lit(str(seed))))


def quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], prefix: str = "p") -> DataFrame:
    """Exact quantiles as columns next to the group size n."""
    r = quantile_rows(df, keys, value, probs)
    picks = [F.max(F.when(F.col("i") == i, F.col("value"))).alias(f"{prefix}{_pname(p)}") for i, p in enumerate(probs)]
    return r.groupBy(*keys).agg(F.max("n").alias("n"), *picks)


def quantile_rows(df: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    """Exact linear-interpolated quantiles of groups of any size: one row (keys, i, n, value) per probability.

    Values are counted per (group, value) first. A monotone bucket of the value then localises the wanted ranks;
    only the few buckets holding a wanted rank are ranked exactly, each inside its own small window.
    """
    v = F.col(value).cast("double")
    vals = df.filter(v.isNotNull()).groupBy(*keys, v.alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    # 4,096 buckets an octave: even values that all lie near one another spread over many buckets
    mag = F.floor(F.log2(F.abs(F.col("__v"))) * 4096) + (1 << 23)
    vals = vals.withColumn("__b", F.when(F.col("__v") == 0, F.lit(0)).when(F.col("__v") < 0, -mag).otherwise(mag).cast("long"))
    buckets = vals.groupBy(*keys, "__b").agg(F.sum("__c").alias("__bc"))
    wb = W.partitionBy(*keys)
    buckets = buckets.select(
        *keys, "__b", "__bc", F.sum("__bc").over(wb).alias("__n"),
        (F.sum("__bc").over(wb.orderBy("__b")) - F.col("__bc")).alias("__before"))
    want = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)])
    b = buckets.withColumn("__q", F.explode(want))
    pos = F.col("__q.p") * (F.col("__n") - 1)
    b = b.withColumn("__side", F.explode(F.array(F.lit(0), F.lit(1)))) \
         .withColumn("__pos", pos) \
         .withColumn("__k", F.when(F.col("__side") == 0, F.floor("__pos")).otherwise(F.ceil("__pos")))
    b = b.filter((F.col("__k") >= F.col("__before")) & (F.col("__k") < F.col("__before") + F.col("__bc")))
    hit = b.select(*keys, "__b").distinct()
    on = [*keys, "__b"]
    w = W.partitionBy(*on).orderBy("__v")
    cum = vals.join(hit, on, "left_semi").withColumn("__hi", F.sum("__c").over(w))
    r = b.join(cum, on).filter((F.col("__k") >= F.col("__before") + F.col("__hi") - F.col("__c"))
                               & (F.col("__k") < F.col("__before") + F.col("__hi")))
    r = r.groupBy(*keys, F.col("__q.i").alias("__i")).agg(
        F.max("__pos").alias("__pos"), F.max("__n").alias("__n"),
        F.max(F.when(F.col("__side") == 0, F.col("__v"))).alias("__lo"),
        F.max(F.when(F.col("__side") == 1, F.col("__v"))).alias("__up"))
    r = r.withColumn("__val", F.col("__lo") + (F.col("__pos") - F.floor("__pos")) * (F.col("__up") - F.col("__lo")))
    return r.select(*keys, F.col("__i").alias("i"), F.col("__n").alias("n"), F.col("__val").alias("value"))


def _pname(p: float) -> str:
    s = f"{p * 100:g}"
    return s.replace(".", "_")
