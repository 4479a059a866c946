"""Registered queries: every operator over whole tables, next to the SQL that must give the same rows."""
from importlib import import_module
from importlib.util import find_spec

MODULES = ["labels_filters", "source_queries", "conversions", "join_queries", "aggregate_queries", "window_queries",
           "spatial_queries", "overlay_queries", "graph_queries", "raster_queries", "distribution_queries", "report_queries",
           "streaming_queries"]


def load():
    from .base import REGISTRY, SQL, expand
    for m in MODULES:
        if find_spec(f"{__name__}.{m}"):
            import_module(f"{__name__}.{m}")
    return REGISTRY, {k: expand(v) for k, v in SQL.items()}
