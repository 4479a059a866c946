"""Exact nearest neighbours without comparing all pairs."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

BLOCK = 4096
PIVOT_BYTES = 64 << 20  # the pivots are broadcast, so their number is bounded by their size


def _matrix(col) -> np.ndarray:
    return np.asarray(col.tolist(), dtype=np.float64)


def _slices(m: np.ndarray, pivots: np.ndarray):
    """Rows in slices whose distances to all pivots stay a few million numbers."""
    step = max(1, 4_000_000 // max(1, len(pivots)))
    return [m[s:s + step] for s in range(0, len(m), step)]


def _from_pivots(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Squared distances of rows and pivots as one matrix product."""
    return (m ** 2).sum(1)[:, None] + (pivots ** 2).sum(1)[None, :] - 2 * m @ pivots.T


def _closest(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
    """Closest candidate (ties: smallest id) of every query among the candidates of one block."""
    qm, cm = _matrix(q["vec"]), _matrix(c["cvec"])
    cid, qid = c["cid"].to_numpy(), q["id"].to_numpy()
    order = np.argsort(cid, kind="stable")
    cm, cid = cm[order], cid[order]
    nn, dist = np.empty(len(qid), dtype=cid.dtype), np.empty(len(qid))
    step = max(1, 2_000_000 // max(1, len(cid)))
    for s in range(0, len(qid), step):
        part = qm[s:s + step]
        d2 = (part ** 2).sum(1)[:, None] + (cm ** 2).sum(1)[None, :] - 2 * part @ cm.T
        d2[qid[s:s + step, None] == cid[None, :]] = np.inf
        best = d2.argmin(1)
        dist[s:s + step] = np.sqrt(((part - cm[best]) ** 2).sum(1))
        dist[s:s + step][~np.isfinite(d2[np.arange(len(best)), best])] = np.inf
        nn[s:s + step] = cid[best]
    return pd.DataFrame({"id": qid, "nn_id": nn, "dist": dist})


def nearest_neighbour(df: DataFrame, id_col: str, vec_col: str, n_pivots: int | None = None) -> DataFrame:
    """(id, nn_id, dist): nearest other row by Euclidean distance, exact.

    Rows join the cell of their closest pivot. A first pass looks inside the own cell only and gives an upper bound;
    the second pass sends a row just to the cells that could hold something closer (distance to the pivot minus the
    cell's radius below the bound). Cells are cut into hashed blocks, so a crowded cell is many small tasks.
    Pivots are a hash-ordered sample whose size grows with the square root of the rows, up to PIVOT_BYTES of vectors; they
    and one row per pivot are all that is broadcast.
    """
    d = df.select(F.col(id_col).alias("id"), F.transform(vec_col, lambda x: x.cast("double")).alias("vec"))
    n = d.count()
    width = 8 * max(1, d.agg(F.max(F.size("vec"))).first()[0] or 1)
    k = n_pivots or int(min(max(1, PIVOT_BYTES // width), max(1, round(n ** 0.5 / 2))))
    piv = d.orderBy(F.md5(F.col("id").cast("string"))).limit(k).select("vec").toPandas()
    pm = _matrix(piv["vec"]) if len(piv) else np.zeros((1, 1))
    bc = d.sparkSession.sparkContext.broadcast(pm)

    @F.pandas_udf("struct<cell:int,pd:double>")
    def own_cell(v: pd.Series) -> pd.DataFrame:
        m = _matrix(v)
        c = np.concatenate([_from_pivots(part, bc.value).argmin(1) for part in _slices(m, bc.value)] or [np.zeros(0, int)])
        # any pivot will do for a cell, but the distance to it has to be exact
        return pd.DataFrame({"cell": c.astype("int32"), "pd": np.sqrt(((m - bc.value[c]) ** 2).sum(1)) if len(m) else np.zeros(0)})

    d = checkpointed(d.withColumn("c", own_cell("vec")).select("id", "vec", "c.cell", "c.pd"))
    stats = d.groupBy("cell").agg(F.count(F.lit(1)).alias("m"), F.max("pd").alias("radius"))
    cells = F.broadcast(stats.withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")))
    cand = d.join(cells, "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    cand = cand.select(F.col("cell").alias("ccell"), F.col("block").alias("cblock"), F.col("id").alias("cid"), F.col("vec").alias("cvec"))

    def search(queries: DataFrame) -> DataFrame:
        """Queries of a cell meet every block of it. Both sides are cut by hash, so no task sees a whole crowded cell."""
        qn = queries.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / (4 * BLOCK)).cast("int").alias("batches"))
        q = queries.join(cells, "cell").join(F.broadcast(qn), "cell").withColumn(
            "batch", F.pmod(F.xxhash64(F.col("id"), F.lit(7)), F.col("batches")).cast("int")).withColumn(
            "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        c = cand.join(F.broadcast(qn.withColumnRenamed("cell", "ccell")), "ccell").withColumn(
            "cbatch", F.explode(F.sequence(F.lit(0), F.col("batches") - 1))).select("ccell", "cblock", "cbatch", "cid", "cvec")

        def run(key, a, b):
            return _closest(a, b) if len(a) and len(b) else pd.DataFrame({"id": [], "nn_id": [], "dist": []})

        t = d.schema["id"].dataType.simpleString()
        out = q.select("cell", "block", "batch", "id", "vec").groupBy("cell", "block", "batch").cogroup(
            c.groupBy("ccell", "cblock", "cbatch")).applyInPandas(run, f"id {t}, nn_id {t}, dist double")
        return out.filter("dist < double('inf')")

    pick = F.min(F.struct("dist", "nn_id")).alias("m")
    first = search(d.select("cell", "id", "vec"))
    bound = first.groupBy("id").agg(F.min("dist").alias("ub"))
    rad = {r["cell"]: r["radius"] for r in stats.select("cell", "radius").collect()}
    radii = d.sparkSession.sparkContext.broadcast(np.array([rad.get(i, -1.0) for i in range(len(pm))]))

    @F.pandas_udf("array<int>")
    def other_cells(v: pd.Series, cell: pd.Series, ub: pd.Series) -> pd.Series:
        m, out, done = _matrix(v), [], 0
        for part in _slices(m, bc.value):
            own, most = cell.to_numpy()[done:done + len(part)], ub.to_numpy()[done:done + len(part)]
            # the product form of a squared distance is off by rounding only; the margin covers that
            margin = 1e-7 * (1 + np.sqrt((part ** 2).sum(1)) + np.sqrt((bc.value ** 2).sum(1)).max())
            dist = np.sqrt(np.maximum(_from_pivots(part, bc.value) - margin[:, None] ** 2, 0)) - margin[:, None]
            ok = (radii.value >= 0) & (dist - radii.value <= most[:, None])
            ok[np.arange(len(part)), own] = False
            out += [np.flatnonzero(r).astype("int32") for r in ok]
            done += len(part)
        return pd.Series(out)

    b = d.join(bound, "id", "left").na.fill(1e300, ["ub"])
    far = checkpointed(b.select("id", "vec", F.explode(other_cells("vec", "cell", "ub")).alias("cell")))
    best = first.unionByName(search(far)).groupBy("id").agg(pick)
    return best.select(F.col("id").alias(id_col), F.col("m.nn_id").alias("nn_id"), F.col("m.dist").alias("dist"))
