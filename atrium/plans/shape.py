"""Plan-level shape facts: union and overlap, closing, holes, pieces, boundary cover, type overlays."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import spatial
from ..operators.graph import components
from ..operators.ranking import rank_within
from ..session import checkpointed, kept_rows, large_groups, stacked

C, lit = F.col, F.lit


def overlap_ratio(rooms: DataFrame, large: DataFrame | None = None) -> DataFrame:
    """(plan_id, area_sum, union_cm2, overlap_ratio)"""
    s = rooms.groupBy("plan_id").agg(F.sum((C("x1") - C("x0")) * (C("y1") - C("y0"))).alias("area_sum"))
    u = spatial.union_area(rooms, ["plan_id"], large, "union_cm2")
    return s.join(u.hint("merge"), "plan_id").withColumn("overlap_ratio", (C("area_sum") - C("union_cm2")) / C("union_cm2"))


def _touching(pieces: DataFrame, tiled: bool = False) -> DataFrame:
    """Edges between pieces sharing a stretch of border: equi-joins on the shared cut.

    Slabs of one decomposition only meet along x cuts; tiles of a large plan also meet along y.
    """
    def along(c, o):
        a = pieces.select("plan_id", C("idx").alias("i"), C(f"{c}1").alias("at"), C(f"{o}0").alias("a0"), C(f"{o}1").alias("a1"))
        b = pieces.select("plan_id", C("idx").alias("j"), C(f"{c}0").alias("at"), C(f"{o}0").alias("b0"), C(f"{o}1").alias("b1"))
        return a.join(b.hint("merge"), ["plan_id", "at"]).filter("least(a1, b1) > greatest(a0, b0)").select("plan_id", "i", "j")

    e = along("x", "y")
    return e.unionByName(along("y", "x")) if tiled else e


def plan_pieces(closed: DataFrame, large: DataFrame | None = None, dealt: int | None = None) -> DataFrame:
    """Connected pieces of a closed plan: (plan_id, n_components)."""
    many = large_groups(closed, ["plan_id"])
    p = kept_rows(rank_within(closed, ["plan_id"], ["x0", "y0"], "idx", many), ["plan_id"], None if many is not None else dealt)
    return components(p, _touching(p, large is not None), many).filter("idx = comp").groupBy("plan_id").agg(
        F.count(lit(1)).alias("n_components"))


def _slab_gaps(closed: DataFrame) -> DataFrame:
    """Complement of ordinary plans: gaps above, below and between the boxes of each slab, outer ones flagged."""
    far = 10 ** 9
    w = W.partitionBy("plan_id", "x0").orderBy("y0")
    d = closed.select("plan_id", "x0", "x1", "y0", "y1", F.lead("y0").over(w).alias("next"), F.lag("y1").over(w).alias("prev"))
    gaps = d.select("plan_id", "x0", "x1", F.inline(F.array(
        F.struct(C("y1").alias("y0"), F.coalesce("next", lit(far)).alias("y1"), C("next").isNull().alias("out"), lit(True).alias("keep")),
        F.struct(lit(-far).cast("long").alias("y0"), C("y0").alias("y1"), lit(True).alias("out"), C("prev").isNull().alias("keep")))))
    gaps = gaps.filter("keep").select("plan_id", "x0", "x1", "y0", "y1", "out")
    # Only plans with an inner gap can have a hole.
    gaps = gaps.withColumn("inner", F.max(~C("out")).over(W.partitionBy("plan_id"))).filter("inner").drop("inner")
    slabs = closed.select("plan_id", "x0", "x1").distinct()
    right = slabs.select("plan_id", C("x0").alias("x1"), lit(True).alias("r"))
    left = slabs.select("plan_id", C("x1").alias("x0"), lit(True).alias("l"))
    gaps = gaps.join(right.hint("merge"), ["plan_id", "x1"], "left").join(left.hint("merge"), ["plan_id", "x0"], "left")
    gaps = gaps.select("plan_id", "x0", "x1", "y0", "y1", (C("out") | C("r").isNull() | C("l").isNull()).alias("out"))
    return gaps.withColumn("inner", F.max(~C("out")).over(W.partitionBy("plan_id"))).filter("inner").drop("inner")


def _tile_gaps(closed: DataFrame) -> DataFrame:
    """Complement of large plans, tile by tile, over the plan's tiles and one empty ring around them (the outside)."""
    size = spatial.TILE
    t = closed.select("plan_id", *spatial.BOX, F.floor(C("x0") / size).alias("tx"), F.floor(C("y0") / size).alias("ty"))
    g = t.groupBy("plan_id").agg(*[f(c).alias(n) for f, c, n in ((F.min, "tx", "a"), (F.max, "tx", "b"), (F.min, "ty", "c"), (F.max, "ty", "d"))])
    g = g.withColumn("tx", F.explode(F.sequence(C("a") - 1, C("b") + 1))).withColumn("ty", F.explode(F.sequence(C("c") - 1, C("d") + 1)))
    g = g.withColumn("out", (C("tx") < C("a")) | (C("tx") > C("b")) | (C("ty") < C("c")) | (C("ty") > C("d")))
    # Flat boxes along the lower and upper tile border turn every free stretch into a gap between two boxes.
    rim = g.select("plan_id", "tx", "ty", (C("tx") * size).alias("x0"), ((C("tx") + 1) * size).alias("x1"),
                   F.explode(F.array(C("ty") * size, (C("ty") + 1) * size)).alias("y0")).withColumn("y1", C("y0"))
    runs = spatial.slab_runs(t.unionByName(rim), ["plan_id", "tx", "ty"], "x")
    w = W.partitionBy("plan_id", "tx", "ty", "x0").orderBy("y0")
    d = runs.select("plan_id", "tx", "ty", "x0", "x1", C("y1").alias("y0"), F.lead("y0").over(w).alias("y1")).filter("y1 > y0")
    return d.join(g.select("plan_id", "tx", "ty", "out"), ["plan_id", "tx", "ty"]).select("plan_id", "x0", "x1", "y0", "y1", "out")


def hole_pieces(closed: DataFrame, large: DataFrame | None = None, dealt: int | None = None) -> DataFrame:
    """Complement pieces of a closed plan that no path links to the outside."""
    if large is None:
        gaps = _slab_gaps(closed)
    else:
        gaps = _slab_gaps(closed.join(large, "plan_id", "left_anti")).unionByName(_tile_gaps(closed.join(large, "plan_id", "left_semi")))
    gaps = kept_rows(gaps, ["plan_id"], dealt)
    many = large_groups(gaps, ["plan_id"])
    p = kept_rows(rank_within(gaps, ["plan_id"], ["x0", "y0"], "idx", many), ["plan_id"], None if many is not None else dealt)
    comp = components(p, _touching(p, large is not None), many)
    pc = p.join(comp.hint("merge"), ["plan_id", "idx"])
    if large is None and many is None:
        # the pieces of one small plan: one pass, where a join would find the components twice
        pc = pc.withColumn("open", F.max("out").over(W.partitionBy("plan_id", "comp"))).filter("NOT open")
        return pc.select("plan_id", "comp", "x0", "x1", "y0", "y1")
    open_ = pc.filter("out").select("plan_id", "comp").distinct()
    return pc.join(open_.hint("merge"), ["plan_id", "comp"], "left_anti").select("plan_id", "comp", "x0", "x1", "y0", "y1")


def hole_ratio(closed: DataFrame, large: DataFrame | None = None, dealt: int | None = None) -> DataFrame:
    """(plan_id, closed_cm2, hole_cm2, hole_ratio): enclosed gaps over the filled footprint.

    ``closed`` is read several times: pass a written or checkpointed table.
    """
    box = (C("x1") - C("x0")) * (C("y1") - C("y0"))
    c = closed.groupBy("plan_id").agg(F.sum(box).alias("closed_cm2"))
    h = hole_pieces(closed, large, dealt).groupBy("plan_id").agg(F.sum(box).alias("h"))
    d = c.join(h.hint("merge"), "plan_id", "left").withColumn("hole_cm2", F.coalesce("h", lit(0)))
    return d.select("plan_id", "closed_cm2", "hole_cm2", (C("hole_cm2") / (C("closed_cm2") + C("hole_cm2"))).alias("hole_ratio"))


def outline_shape(closed: DataFrame, large: DataFrame | None = None, dealt: int | None = None) -> DataFrame:
    """Filled outline: share of its bounding box and number of corners.

    A corner is a grid point where the filled cells around it do not form a straight line. Each box of a slab
    decomposition adds its four corners with signs; corners that cancel or pair up along a line vanish in the sum.
    """
    filled = stacked(closed.select("plan_id", *spatial.BOX), hole_pieces(closed, large, dealt).select("plan_id", *spatial.BOX))
    filled = kept_rows(filled, ["plan_id"], dealt)  # read twice
    box = (C("x1") - C("x0")) * (C("y1") - C("y0"))
    a = filled.groupBy("plan_id").agg(F.sum(box).alias("area"), ((F.max("x1") - F.min("x0")) * (F.max("y1") - F.min("y0"))).alias("bb"))
    pts = filled.select("plan_id", F.inline(F.array(
        F.struct(C("x0").alias("x"), C("y0").alias("y"), lit(1).alias("s")), F.struct(C("x1").alias("x"), C("y0").alias("y"), lit(-1).alias("s")),
        F.struct(C("x1").alias("x"), C("y1").alias("y"), lit(1).alias("s")), F.struct(C("x0").alias("x"), C("y1").alias("y"), lit(-1).alias("s")))))
    n = pts.groupBy("plan_id", "x", "y").agg(F.abs(F.sum("s")).alias("s")).filter("s > 0").groupBy("plan_id").agg(
        F.sum("s").alias("outline_corners"))
    return a.join(n.hint("merge"), "plan_id").select("plan_id", (C("area") / C("bb")).alias("outline_rectangularity"), "outline_corners")


def set_areas(a: DataFrame, b: DataFrame, keys: list[str], large: DataFrame | None = None) -> DataFrame:
    """Areas of union a, union b and their union per key, from one tagged union-area pass."""
    box = [*keys, *spatial.BOX]
    sides = stacked(a.select(*box, F.explode(F.array(lit("a"), lit("ab"))).alias("side")),
        b.select(*box, F.explode(F.array(lit("b"), lit("ab"))).alias("side")))
    u = spatial.union_area(sides, [*keys, "side"], large, "area")
    v = [F.coalesce(F.sum(F.when(C("side") == s, C("area"))), lit(0)).alias(n)
         for s, n in (("a", "area_a"), ("b", "area_b"), ("ab", "area_ab"))]
    return u.groupBy(*keys).agg(*v)


def boundary_cover(rooms: DataFrame, closed: DataFrame, boundary: DataFrame, tol: int = 30,
                   large: DataFrame | None = None) -> DataFrame:
    """Covered share of the boundary, and share of the rooms outside the boundary grown by ``tol``."""
    bnd = boundary.select("plan_id", *[C(c).alias("b" + c) for c in spatial.BOX])
    cl = closed.join(bnd.hint("merge"), "plan_id")
    w = F.least("x1", "bx1") - F.greatest("x0", "bx0")
    h = F.least("y1", "by1") - F.greatest("y0", "by0")
    inside = cl.filter((w > 0) & (h > 0)).groupBy("plan_id").agg(F.sum(w * h).alias("inside"))
    grown = boundary.select("plan_id", (C("x0") - tol).alias("x0"), (C("y0") - tol).alias("y0"),
                            (C("x1") + tol).alias("x1"), (C("y1") + tol).alias("y1"))
    s = set_areas(rooms, grown, ["plan_id"], large)
    d = bnd.join(inside.hint("merge"), "plan_id", "left").join(s.hint("merge"), "plan_id")
    area = (C("bx1") - C("bx0")) * (C("by1") - C("by0"))
    return d.select("plan_id", (F.coalesce("inside", lit(0)) / area).alias("boundary_coverage"),
                    ((C("area_ab") - C("area_b")) / C("area_a")).alias("outside_boundary_ratio"))


def type_iou(gen: DataFrame, gt: DataFrame, large: DataFrame | None = None) -> DataFrame:
    """Mean over the types of either side of the IoU of the type's rooms."""
    s = set_areas(gen, gt, ["plan_id", "type"], large)
    iou = F.when(C("area_ab") > 0, (C("area_a") + C("area_b") - C("area_ab")) / C("area_ab")).otherwise(0.0)
    return s.groupBy("plan_id").agg(F.avg(iou).alias("type_iou"))
