"""SQL functions for users who write SQL."""
from pyspark.sql import SparkSession

FUNCTIONS = {
    "plan_norm_label(label STRING) RETURNS STRING":
        "regexp_replace(regexp_replace(lower(trim(label)), '[^a-z0-9]+', '_'), '^_+|_+$', '')",
    "plan_box_area(x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE) RETURNS DOUBLE": "(x1 - x0) * (y1 - y0)",
    "plan_aspect(w DOUBLE, h DOUBLE) RETURNS DOUBLE":
        "CASE WHEN least(w, h) > 0 THEN greatest(w, h) / least(w, h) ELSE double('inf') END",
    "plan_gt_base(id STRING) RETURNS STRING": "regexp_replace(id, '_[0-9]+$', '')",
    "plan_edge_angle(dx DOUBLE, dy DOUBLE) RETURNS DOUBLE": "pmod(degrees(atan2(dy, dx)), 90D)",
}


def register(spark: SparkSession) -> None:
    """Create the functions for this session."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
