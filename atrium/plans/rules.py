"""Rule thresholds and rule checks."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..vocab import NORM_RULES, THRESHOLDS


def threshold_table(spark: SparkSession) -> DataFrame:
    """15 rows: type, min_area, min_width, max_aspect (NULL = unconstrained)."""
    return spark.createDataFrame(THRESHOLDS, "type string, min_area double, min_width double, max_aspect double")


def norm_rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NORM_RULES, "rule string, subject string, parameter string, op string, "
                                             "threshold double, bindingness string")


def room_attributes(rooms: DataFrame) -> DataFrame:
    """Area, clear width, depth and aspect of box rooms (cm), with the canonical type kept next to the group."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    short, long_ = F.least(w, h), F.greatest(w, h)
    return rooms.select("*", (w * h).alias("area_cm2"), short.alias("width_cm"), long_.alias("depth_cm"),
                        F.when(short > 0, long_.cast("double") / short).otherwise(F.lit(float("inf"))).alias("aspect"))
