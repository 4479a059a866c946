"""Shared walls and corner cuts at any angle: edges meet in cells of their line (direction and offset) or of the plane."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators.overlay import once
from ..session import stacked

C, lit = F.col, F.lit
ANGLE, APART = 1e-4, 0.5  # edges are on one line within this many radians and centimetres
TILE = 200.0


def numbered_edges(rings: DataFrame) -> DataFrame:
    """(plan_id, idx, k, x0, y0, x1, y1) of rings (plan_id, idx, ring)."""
    d = rings.select("plan_id", "idx", F.posexplode(G.edges_of(C("ring"))).alias("k", "e"))
    return d.select("plan_id", "idx", C("k").cast("long").alias("k"), "e.*").filter("x0 <> x1 OR y0 <> y1")


def _on_lines(edges: DataFrame) -> DataFrame:
    """Edges from left to right (vertical ones upwards) with their angle, distance of the line from the origin and cell of both."""
    swap = (C("x1") < C("x0")) | ((C("x1") == C("x0")) & (C("y1") < C("y0")))
    ends = [F.when(swap, b).otherwise(a).cast("double").alias(n) for n, a, b in
            (("ax", C("x0"), C("x1")), ("ay", C("y0"), C("y1")), ("bx", C("x1"), C("x0")), ("by", C("y1"), C("y0")))]
    d = edges.select("plan_id", "idx", once(F.struct(*ends)).alias("e")).select("plan_id", "idx", "e.*")
    d = d.withColumn("angle", once(F.atan2(C("by") - C("ay"), C("bx") - C("ax"))))
    off = (C("ay") + C("by")) / 2 * F.cos("angle") - (C("ax") + C("bx")) / 2 * F.sin("angle")
    cell = F.struct(off.alias("off"), F.floor(C("angle") / (2 * ANGLE)).alias("turn"), F.floor(off / (2 * APART)).alias("row"))
    return d.select("*", once(cell).alias("cell")).select(*d.columns, "cell.*")


def shared_walls(edges: DataFrame) -> DataFrame:
    """(plan_id, i, j, len, x0, y0, x1, y1): longest common stretch of outline of every two rooms i < j (ties: lower left).

    An edge looks in its own and the neighbouring cells of its line; each pair of edges meets in one of them, and is then measured."""
    e = _on_lines(edges)
    near = F.array(*[F.struct((C("turn") + a).alias("turn"), (C("row") + b).alias("row")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    # lines just off upright have neighbours on the other side of it, where angle and distance change their sign
    top, low = (math.floor(side * math.pi / 2 / (2 * ANGLE)) for side in (1, -1))

    def over(turn: int) -> Column:
        return F.array(*[F.struct(lit(turn + a).cast("long").alias("turn"), (b - 1 - C("row")).alias("row")) for a in (-1, 0, 1) for b in (-1, 0, 1)])

    cells = F.array_distinct(F.when(C("turn") >= top - 1, F.concat(near, over(low))).when(C("turn") <= low + 1, F.concat(near, over(top))).otherwise(near))
    q = e.select("plan_id", C("idx").alias("j"), *[C(c).alias(f"q{c}") for c in ("ax", "ay", "bx", "by", "angle")], F.inline(cells))
    d = e.withColumnRenamed("idx", "i").join(q.hint("merge"), ["plan_id", "turn", "row"]).filter("i < j")
    ux, uy = F.cos("angle"), F.sin("angle")

    def along(x: str, y: str) -> Column:
        return (C(x) - C("ax")) * ux + (C(y) - C("ay")) * uy

    def apart(x: str, y: str) -> Column:
        return F.abs((C(y) - C("ay")) * ux - (C(x) - C("ax")) * uy)

    lo, hi = F.greatest(lit(0.0), F.least(along("qax", "qay"), along("qbx", "qby"))), F.least(along("bx", "by"), F.greatest(along("qax", "qay"), along("qbx", "qby")))
    d = d.filter((apart("qax", "qay") <= APART) & (apart("qbx", "qby") <= APART)).withColumn("lo", lo).withColumn("hi", hi).filter(C("hi") - C("lo") > 1e-6)
    d = d.select("plan_id", "i", "j", F.round(C("hi") - C("lo"), 6).alias("len"), *[F.round(v, 4).alias(n) for n, v in (
        ("x0", C("ax") + C("lo") * ux), ("y0", C("ay") + C("lo") * uy), ("x1", C("ax") + C("hi") * ux), ("y1", C("ay") + C("hi") * uy))])
    best = F.min(F.struct((-C("len")).alias("neg"), "x0", "y0", "x1", "y1")).alias("m")
    return d.groupBy("plan_id", "i", "j").agg(best).select("plan_id", "i", "j", (-C("m.neg")).alias("len"), "m.x0", "m.y0", "m.x1", "m.y1")


def cut_at_corners(edges: DataFrame, tol: float = 1e-6) -> DataFrame:
    """(plan_id, idx, k, part, x0, y0, x1, y1): edges of any angle cut where corners of other rooms lie on them, from their start on.

    Corners and edges meet in the tiles of the plane that they touch."""
    def tiles(a, b):
        return F.sequence(F.floor(F.least(a, b) / TILE), F.floor(F.greatest(a, b) / TILE))

    e = edges.select("plan_id", "idx", "k", *[C(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    corners = e.select("plan_id", C("idx").alias("o"), C("x0").alias("px"), C("y0").alias("py")).distinct().withColumn(
        "tx", F.floor(C("px") / TILE)).withColumn("ty", F.floor(C("py") / TILE))
    spread = e.withColumn("tx", F.explode(tiles(C("x0"), C("x1")))).withColumn("ty", F.explode(tiles(C("y0"), C("y1"))))
    dx, dy = C("x1") - C("x0"), C("y1") - C("y0")
    n2 = dx * dx + dy * dy
    at = ((C("px") - C("x0")) * dx + (C("py") - C("y0")) * dy) / n2
    off = F.abs((C("py") - C("y0")) * dx - (C("px") - C("x0")) * dy) / F.sqrt(n2)
    hit = spread.join(corners.hint("merge"), ["plan_id", "tx", "ty"]).filter((C("o") != C("idx")) & (off <= tol)).withColumn("at", at).filter(
        (C("at") > 1e-9) & (C("at") < 1 - 1e-9)).select("plan_id", "idx", "k", C("px").alias("x"), C("py").alias("y"), F.round("at", 9).alias("at"))
    ends = e.select("plan_id", "idx", "k", F.inline(F.array(F.struct(C("x0").alias("x"), C("y0").alias("y"), lit(0.0).alias("at")),
                                                            F.struct(C("x1").alias("x"), C("y1").alias("y"), lit(1.0).alias("at")))))
    # several corners may lie in one place, as far as the grid tells: the least stands for all
    pts = stacked(ends, hit).groupBy("plan_id", "idx", "k", "at").agg(F.min(F.struct("x", "y")).alias("p")).select("plan_id", "idx", "k", "at", "p.*")
    w = W.partitionBy("plan_id", "idx", "k").orderBy("at")
    d = pts.select("plan_id", "idx", "k", F.row_number().over(w).alias("part"), C("x").alias("x0"), C("y").alias("y0"), F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1"))
    return d.filter("x1 IS NOT NULL")
