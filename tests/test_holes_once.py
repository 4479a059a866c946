"""Holes of a closed plan are found once: steps that use them twice read a written table or one window."""
import pytest
from conftest import DATA

import __spark_entry__ as entry


@pytest.mark.parametrize("key,folds", [("hole_ratio", 1), ("outline_shape", 0)])
def test_components_of_gaps_are_folded_once(spark, key, folds):
    d = entry.queries()[key](spark, DATA)
    old = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        text = d._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", old)
    assert text.count("collect_set") == 2 * folds  # nodes and edges of one fold
