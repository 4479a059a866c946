"""Report tables: pivots, comparisons, nested payloads."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

C, lit = F.col, F.lit


def pivot_counts(comp: DataFrame, types: list[str]) -> DataFrame:
    """Dataset x type table of mean counts; the type list is given, so the pivot needs no extra pass."""
    return comp.groupBy("dataset").pivot("type", types).agg(F.first("mean_count"))


def area_cell(p5, p50, p95):
    """``low / median / high`` in square metres; whole square centimetres keep the text exact."""
    f = lambda c: F.format_string("%.1f", F.floor(c / 1000 + 0.5) / 10)
    return F.concat_ws(" / ", f(p5), f(p50), f(p95))


def blank_raster(df: DataFrame, col: str, raster: str = "raster") -> DataFrame:
    return df.withColumn(col, F.when(~C(raster), C(col)))


def minus_floor(scores: DataFrame) -> DataFrame:
    """Distances with the floor taken off."""
    return scores.withColumn("fid_minus_floor", C("fid") - C("fid_floor"))


def payload(df: DataFrame, key: str, entry: str, value) -> DataFrame:
    """One map column per key row; the entries of a key are a fixed vocabulary."""
    return df.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(C(entry), value)))).alias("payload"))
