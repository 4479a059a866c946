"""Plan-level joins: assignment, program links, interval gaps, edge sets, merges."""
from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

C, lit = F.col, F.lit


def linked_edges(edges: DataFrame, rooms: DataFrame) -> DataFrame:
    """Program edges whose two rooms both exist in the layout."""
    r = rooms.select("plan_id", "idx")
    return edges.join(r.withColumnRenamed("idx", "a"), ["plan_id", "a"], "left_semi").join(
        r.withColumnRenamed("idx", "b"), ["plan_id", "b"], "left_semi").select("plan_id", "a", "b", "kind")


def interval_gaps(pieces: DataFrame, keys: list[str], min_gap: float) -> DataFrame:
    """Uncovered parts of [lo, hi] wider than ``min_gap``, given covered pieces [a, b]."""
    w = W.partitionBy(*keys).orderBy("a", "b").rowsBetween(W.unboundedPreceding, -1)
    inner = pieces.select(*keys, F.coalesce(F.max("b").over(w), C("lo")).alias("g0"), C("a").alias("g1"))
    tail = pieces.groupBy(*keys).agg(F.max("b").alias("g0"), F.max("hi").alias("g1"))
    return inner.unionByName(tail).filter(C("g1") - C("g0") > min_gap)


def merge_targets(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New targets replace their old rows, other rows stay."""
    return new.unionByName(old.join(new.select(key).distinct(), key, "left_anti"))


def edge_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sizes, precision, recall and Jaccard of two edge sets per plan."""
    k = ["plan_id", "i", "j"]
    x = a.select(*k).distinct().withColumn("x", lit(1))
    y = b.select(*k).distinct().withColumn("y", lit(1))
    d = x.join(y, k, "full_outer").groupBy("plan_id").agg(
        F.count("x").alias("n_a"), F.count("y").alias("n_b"), F.count_if(C("x").isNotNull() & C("y").isNotNull()).alias("n_both"),
        F.count(lit(1)).alias("n_any"))
    return d.select("plan_id", "n_a", "n_b", "n_both", "n_any", (C("n_both") / F.nullif("n_a", lit(0))).alias("precision"),
                    (C("n_both") / F.nullif("n_b", lit(0))).alias("recall"), (C("n_both") / C("n_any")).alias("jaccard"))


def _best_assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Exact least-cost one-to-one matching by shortest augmenting paths with potentials."""
    turned = cost.shape[0] > cost.shape[1]
    c = cost.T if turned else cost
    n, m = c.shape
    if n <= 3:
        best = min(permutations(range(m), n), key=lambda p: (sum(c[i, j] for i, j in enumerate(p)), p))
        pairs = list(enumerate(best))
    else:
        u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
        for i in range(1, n + 1):
            match[0], j0 = i, 0
            dist, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
            while True:
                used[j0] = True
                i0 = match[j0]
                free = ~used
                free[0] = False
                red = c[i0 - 1, :] - u[i0] - v[1:]
                better = free[1:] & (red < dist[1:])
                dist[1:][better], way[1:][better] = red[better], j0
                j1 = int(np.argmin(np.where(free, dist, np.inf)))
                delta = dist[j1]
                u[match[used]] += delta
                v[used] -= delta
                dist[free] -= delta
                j0 = j1
                if match[j0] == 0:
                    break
            while j0:
                match[j0] = match[way[j0]]
                j0 = way[j0]
        pairs = [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return [(j, i) for i, j in pairs] if turned else pairs


MATCHES = T.ArrayType(T.StructType().add("a_idx", T.LongType()).add("b_idx", T.LongType()).add("dist", T.DoubleType()))


@F.pandas_udf(MATCHES)
def _match(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b):
        p = np.array([[v["cx"], v["cy"]] for v in x])
        q = np.array([[v["cx"], v["cy"]] for v in y])
        d = np.hypot(p[:, None, 0] - q[None, :, 0], p[:, None, 1] - q[None, :, 1])
        out.append([{"a_idx": x[i]["idx"], "b_idx": y[j]["idx"], "dist": float(d[i, j])} for i, j in _best_assignment(d)])
    return pd.Series(out)


def assign_rooms(a: DataFrame, b: DataFrame) -> DataFrame:
    """One-to-one matching of same-type rooms of a plan by centroid distance.

    Types a plan has at most once on both sides, the common case, match by a plain join; only repeated types go
    through the assignment kernel, one packed row per (plan, type).
    """
    def prep(d):
        return d.select("plan_id", "type", "idx", ((C("x0") + C("x1")) / 2).alias("cx"), ((C("y0") + C("y1")) / 2).alias("cy"))

    a, b = prep(a), prep(b)
    k = ["plan_id", "type"]
    many = a.groupBy(*k).count().unionByName(b.groupBy(*k).count()).filter("count > 1").select(*k).distinct()
    one = a.join(many, k, "left_anti").withColumnRenamed("idx", "a_idx").join(
        b.select(*k, C("idx").alias("b_idx"), C("cx").alias("bx"), C("cy").alias("by")), k)
    one = one.select(*k, "a_idx", "b_idx", F.sqrt((C("cx") - C("bx")) ** 2 + (C("cy") - C("by")) ** 2).alias("dist"))
    def packed(d, name):
        return d.join(many, k, "left_semi").groupBy(*k).agg(F.array_sort(F.collect_list(F.struct("idx", "cx", "cy"))).alias(name))

    both = packed(a, "a").join(packed(b, "b"), k)
    out = both.select(*k, F.explode(_match("a", "b")).alias("m")).select(*k, "m.a_idx", "m.b_idx", "m.dist")
    return one.unionByName(out)
