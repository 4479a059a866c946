"""Helpers of the corpus operators: saved intermediate tables and distributed running positions."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import new_path

SPACE = r"[\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write to the folder that all executors share and read back: later steps survive the loss of any executor."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def words_column(text):
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text column as an array (null: no words)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), lambda w: w != "")


def running(df: DataFrame, group: str, by: list, weight: str, name: str) -> DataFrame:
    """Add ``pos`` (rank from 0) and ``before`` (sum of ``weight`` of earlier rows) within ``group``, in the order ``by``.

    One range shuffle on (group, by) splits any group over tasks; each task counts within its slice, and offsets of the
    slices (one row per slice and group) are added by a join. ``group`` is a long column without nulls."""
    spark = df.sparkSession
    keys = [F.col(group), *by]
    out = T.StructType([*df.schema.fields, T.StructField("pid", T.IntegerType()), T.StructField("pos", T.LongType()),
                        T.StructField("before", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        pid = TaskContext.get().partitionId()
        last, n, total = None, 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            g = b.column(group).to_numpy(zero_copy_only=False)
            w = b.column(weight).to_numpy(zero_copy_only=False).astype(np.int64)
            fresh = np.r_[g[0] != last if last is not None else True, g[1:] != g[:-1]]
            cum = np.cumsum(w)
            idx = np.arange(len(g))
            first = np.maximum.accumulate(np.where(fresh, idx, -1))
            base_n = np.where(first < 0, -n, first)
            base_w = np.where(first < 0, -total, np.where(first > 0, cum[np.maximum(first, 1) - 1], 0))
            pos, before = idx - base_n, cum - w - base_w
            last, n, total = g[-1], int(pos[-1]) + 1, int(before[-1] + w[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(g), pid, np.int32)), pa.array(pos.astype(np.int64)),
                                              pa.array(before.astype(np.int64))], names=out.fieldNames())

    sliced = df.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys).mapInArrow(count, out)
    part = saved(sliced, name)
    ends = part.groupBy("pid", group).agg(F.max("pos").alias("m"), F.max(F.col("before") + F.col(weight)).alias("s"))
    w = Window.partitionBy(group).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ends.select("pid", group, F.coalesce(F.sum(F.col("m") + 1).over(w), F.lit(0)).alias("o_n"),
                          F.coalesce(F.sum("s").over(w), F.lit(0)).alias("o_s"))
    return (part.join(offsets, ["pid", group])
            .select(*[c for c in df.columns], (F.col("pos") + F.col("o_n")).alias("pos"), (F.col("before") + F.col("o_s")).alias("before")))


def placed_rows(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Columns with the file (``row_file``) and place in it (``row_at``) of every row: a key that is the same at every read.

    A table that does not come straight from files is written first."""
    def keyed(rows: DataFrame) -> DataFrame:
        return rows.select(*columns, F.xxhash64("_metadata.file_path").alias("row_file"), F.col("_metadata.row_index").cast("long").alias("row_at"))
    try:
        return keyed(df)
    except AnalysisException:
        return keyed(saved(df.select(*columns), name))
