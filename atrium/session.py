"""Session helpers: shared scratch folder, lineage cuts, row-count gates."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A group with more rows than this is handled by the distributed paths instead of inside one task.
GROUP_LIMIT = 2000


def scratch_dir(spark: SparkSession) -> str:
    """Folder shared by all executors. The cluster names it; tests fall back to a local one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(root)
    return root


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through reliable storage, so a lost executor never changes what later steps read."""
    spark = df.sparkSession
    scratch_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_dir(spark))
    return df.checkpoint(eager=True)


def large_groups(df: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame | None:
    """Keys owning more than ``limit`` rows, or None when there are none (one map-side combined count)."""
    limit = GROUP_LIMIT if limit is None else limit
    big = df.groupBy(*keys).count().filter(F.col("count") > limit).select(*keys)
    if big.isEmpty():
        return None
    return checkpointed(big)


def bucketed(df: DataFrame, keys: list[str], n: int | None = None, dealt: bool = False) -> str:
    """Name of a written table dealt into ``n`` buckets by ``keys`` (as many as the session's shuffles), for steps that read it several times:
    joins, groups and windows on these and further keys find their rows in one task and shuffle nothing. ``dealt``: already in order of the buckets."""
    spark = df.sparkSession
    n = n or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path, name = new_path(spark, "bucketed"), f"bucketed_{uuid.uuid4().hex}"
    # else a join on further keys shuffles what already lies together
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    # else a step that writes its rows back in the same buckets reads several of them in one task and sorts them apart again
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    rows = df if dealt else df.repartition(n, *keys)
    rows.write.bucketBy(n, *keys).option("path", path).saveAsTable(name, format="parquet")
    return name


def in_buckets(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.sparkSession.table(bucketed(df, keys))


def kept_rows(df: DataFrame, keys: list[str], buckets: int | None) -> DataFrame:
    """A lineage cut that keeps the ``buckets`` in which the rows already lie by ``keys``; a checkpoint where they lie in none."""
    return checkpointed(df) if buckets is None else df.sparkSession.table(bucketed(df, keys, buckets, dealt=True))


def stacked(first: DataFrame, *others: DataFrame, keys: tuple[str, ...] | list[str] = ("plan_id",)) -> DataFrame:
    """``unionByName`` of tables that all lie in the same buckets by ``keys``: a union keeps them only under names that its parts give anew."""
    names = {k: f"__{k}" for k in keys}
    d = first.withColumnsRenamed(names)
    for o in others:
        d = d.unionByName(o.withColumnsRenamed(names))
    return d.withColumnsRenamed({n: k for k, n in names.items()})


def spread(df: DataFrame) -> DataFrame:
    """More partitions in front of a Python kernel when a small input would leave cores idle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * 2) if df.rdd.getNumPartitions() < cores else df
