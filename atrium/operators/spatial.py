"""Rectangle operators on integer coordinates (cm): tiling, overlap joins, union areas, closing.

Plans are small, so a plan is the unit of work. Plans listed in ``large`` are cut into tiles first, and every step
then runs per (plan, tile), which keeps a plan of any size spread over the cluster.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TILE = 1000
BOX = ("x0", "y0", "x1", "y1")


def _flag_large(df: DataFrame, large: DataFrame | None) -> DataFrame:
    if large is None:
        return df.withColumn("__big", F.lit(False))
    d = df.join(large.withColumn("__big", F.lit(True)), large.columns, "left")
    return d.withColumn("__big", F.coalesce("__big", F.lit(False)))


def with_tiles(df: DataFrame, large: DataFrame | None, grow: float = 0, cols=BOX) -> DataFrame:
    """One row per tile a grown box touches; boxes of ordinary plans stay on the single tile (0, 0)."""
    d = _flag_large(df, large)
    if large is None:
        return d.withColumn("tx", F.lit(0)).withColumn("ty", F.lit(0))
    x0, y0, x1, y1 = [F.col(c) for c in cols]

    def span(a, b):
        lo, hi = F.floor((a - grow) / TILE).cast("int"), F.floor((b + grow) / TILE).cast("int")
        return F.when(F.col("__big"), F.sequence(lo, hi)).otherwise(F.array(F.lit(0)))

    return d.withColumn("tx", F.explode(span(x0, x1))).withColumn("ty", F.explode(span(y0, y1)))


def overlap_join(a: DataFrame, b: DataFrame, grow_a: float = 0, grow_b: float = 0,
                 large: DataFrame | None = None, extra: Column | None = None, touch: bool = False) -> DataFrame:
    """Pairs of boxes of the same plan whose grown boxes overlap.

    ``a`` carries ax0..ay1 and ``b`` bx0..by1 next to plan_id. A pair is reported once, in the tile holding the
    corner of its overlap. Adds ow, oh: width and height of the overlap.
    """
    ca, cb = ("ax0", "ay0", "ax1", "ay1"), ("bx0", "by0", "bx1", "by1")
    ta = with_tiles(a, large, grow_a, ca)
    tb = with_tiles(b, large, grow_b, cb).drop("__big")
    d = ta.join(tb, ["plan_id", "tx", "ty"] if large is not None else ["plan_id"])
    lox = F.greatest(F.col("ax0") - grow_a, F.col("bx0") - grow_b)
    loy = F.greatest(F.col("ay0") - grow_a, F.col("by0") - grow_b)
    ow = F.least(F.col("ax1") + grow_a, F.col("bx1") + grow_b) - lox
    oh = F.least(F.col("ay1") + grow_a, F.col("by1") + grow_b) - loy
    keep = ((ow >= 0) & (oh >= 0)) if touch else ((ow > 0) & (oh > 0))
    if large is not None:
        keep = keep & (~F.col("__big") | ((F.col("tx") == F.floor(lox / TILE)) & (F.col("ty") == F.floor(loy / TILE))))
    if extra is not None:
        keep = keep & extra
    names = [c for c in d.columns if c not in ("tx", "ty", "__big")]
    return d.filter(keep).select(*names, ow.alias("ow"), oh.alias("oh"))


def side(df: DataFrame, p: str, keep: list[str]) -> DataFrame:
    """Box columns and ``keep`` renamed with a prefix, for overlap joins."""
    return df.select("plan_id", *[F.col(c).alias(p + c) for c in (*keep, *BOX)])


def wall_adjacency(rooms: DataFrame, tol: int = 30, min_shared: int = 50, large: DataFrame | None = None) -> DataFrame:
    """Room pairs i < j sharing at least ``min_shared`` of wall: overlap of grown boxes / (2 tol)."""
    d = overlap_join(side(rooms, "a", ["idx"]), side(rooms, "b", ["idx"]), tol, tol, large,
                     F.col("aidx") < F.col("bidx"))
    return d.filter(F.col("ow") * F.col("oh") >= min_shared * 2 * tol).select(
        "plan_id", F.col("aidx").alias("i"), F.col("bidx").alias("j"), (F.col("ow") * F.col("oh")).alias("overlap"))


def door_hits(doors: DataFrame, rooms: DataFrame, tol: int = 30, large: DataFrame | None = None) -> DataFrame:
    """Rooms overlapping a grown door, with the overlap area."""
    a = side(doors, "a", ["k", "type"])
    d = overlap_join(a, side(rooms, "b", ["idx"]), tol, 0, large)
    return d.select("plan_id", F.col("ak").alias("k"), F.col("atype").alias("door_type"),
                    F.col("bidx").alias("idx"), (F.col("ow") * F.col("oh")).alias("area"))


def door_edges(doors: DataFrame, rooms: DataFrame, tol: int = 30, large: DataFrame | None = None) -> DataFrame:
    """The two rooms an interior door overlaps most, one row per door. A door's candidates are the few rooms around it."""
    h = door_hits(doors.filter(F.col("type") != "front_door"), rooms, tol, large)
    h = h.withColumn("s", F.struct("area", "idx"))
    w = W.partitionBy("plan_id", "k").orderBy(F.desc("area"), F.desc("idx"))
    two = h.withColumn("rn", F.row_number().over(w)).filter("rn <= 2").groupBy("plan_id", "k").agg(
        F.count(F.lit(1)).alias("n"), F.min("idx").alias("i"), F.max("idx").alias("j"))
    return two.filter("n = 2").select("plan_id", "k", "i", "j")


def clip_tiles(rects: DataFrame, large: DataFrame | None, halo: int = 0) -> DataFrame:
    """Boxes with tile columns; boxes of large plans are cut to each tile they touch, grown by ``halo``."""
    t = with_tiles(rects, large, halo)
    if large is None:
        return t.drop("__big")
    for lo, hi, tile in (("x0", "x1", "tx"), ("y0", "y1", "ty")):
        base = F.col(tile).cast("long") * TILE
        t = t.withColumn(lo, F.when(F.col("__big"), F.greatest(F.col(lo), base - halo)).otherwise(F.col(lo)))
        t = t.withColumn(hi, F.when(F.col("__big"), F.least(F.col(hi), base + TILE + halo)).otherwise(F.col(hi)))
    return t.filter("x1 > x0 AND y1 > y0")


def union_area(rects: DataFrame, keys: list[str], large: DataFrame | None = None, name: str = "union_area") -> DataFrame:
    """Area of the union of boxes per group. Tile sums of large plans add up exactly."""
    if large is None:
        runs = slab_runs(rects, keys, "x")
    else:
        runs = slab_runs(clip_tiles(rects, large), [*keys, "tx", "ty"], "x")
    return runs.groupBy(*keys).agg(F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias(name))


def slab_runs(rects: DataFrame, keys: list[str], along: str) -> DataFrame:
    """Disjoint boxes covering the same area: slabs across ``along`` cuts, touching intervals merged in a slab.

    One shuffle by the group: its distinct boxes and cut positions travel together (a group is a plan, or a tile of
    a large plan), each box is spread over the slabs it spans, and the merge windows reuse that partitioning.
    """
    lo, hi, u0, u1 = ("x0", "x1", "y0", "y1") if along == "x" else ("y0", "y1", "x0", "x1")
    g = rects.groupBy(*keys).agg(F.collect_set(F.struct(*BOX)).alias("__rs"))
    cuts = F.array_sort(F.array_distinct(F.concat(F.transform("__rs", lambda r: r[lo]), F.transform("__rs", lambda r: r[hi]))))
    g = g.withColumn("__cuts", cuts)
    n = F.greatest(F.size("__cuts") - 1, F.lit(0))
    g = g.withColumn("__slabs", F.zip_with(F.slice("__cuts", 1, n), F.slice("__cuts", 2, n),
                                           lambda a, b: F.struct(a.alias("__a"), b.alias("__b")))).drop("__cuts")
    s = g.select(*keys, "__slabs", F.explode("__rs").alias("__r"))
    s = s.select(*keys, F.col(f"__r.{lo}").alias("__lo"), F.col(f"__r.{u0}").alias(u0), F.col(f"__r.{u1}").alias(u1),
                 F.inline(F.filter("__slabs", lambda c: (c["__a"] >= F.col(f"__r.{lo}")) & (c["__b"] <= F.col(f"__r.{hi}")))))
    m = {lo: "__a", hi: "__b", u0: "__u0", u1: "__u1"}
    return _merged(s, keys, u0, u1).select(*keys, *[F.col(m[c]).alias(c) for c in BOX])


def _merged(s: DataFrame, keys: list[str], u0: str, u1: str) -> DataFrame:
    """Touching intervals of a slab (__a, __b) as one: (keys, __a, __b, __u0, __u1)."""
    w = W.partitionBy(*keys, "__a").orderBy(u0, u1)
    prev = F.max(u1).over(w.rowsBetween(W.unboundedPreceding, -1))
    s = s.withColumn("__new", F.when(prev.isNull() | (F.col(u0) > prev), 1).otherwise(0))
    s = s.withColumn("__isl", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return s.groupBy(*keys, "__a", "__b", "__isl").agg(F.min(u0).alias("__u0"), F.max(u1).alias("__u1"))


def _closed_rows(rects: DataFrame, keys: list[str], r: int) -> DataFrame:
    """First pass of the closing: rows of the grown boxes, shrunk along x."""
    g = rects.select(*keys, (F.col("x0") - r).alias("x0"), (F.col("y0") - r).alias("y0"),
                     (F.col("x1") + r).alias("x1"), (F.col("y1") + r).alias("y1"))
    return slab_runs(g, keys, "y").withColumn("x0", F.col("x0") + r).withColumn("x1", F.col("x1") - r).filter("x1 > x0")


def closing(rects: DataFrame, keys: list[str], r: int, large: DataFrame | None = None) -> DataFrame:
    """Mitre closing of a rectilinear union: grow, merge rows and shrink them, merge columns and shrink them.

    A square structuring element is separable, so the erosion is one pass per axis. Result: disjoint column boxes.
    A point depends on boxes at most 2 r away, so tiles of large plans close on their own with a halo of 2 r.
    """
    k = keys
    if large is not None:
        rects, k = clip_tiles(rects, large, 2 * r), [*keys, "tx", "ty"]
    cols = slab_runs(_closed_rows(rects, k, r), k, "x")
    out = cols.withColumn("y0", F.col("y0") + r).withColumn("y1", F.col("y1") - r).filter("y1 > y0")
    if large is None:
        return out
    out = _flag_large(out, large)
    for lo, hi, tile in (("x0", "x1", "tx"), ("y0", "y1", "ty")):
        base = F.col(tile).cast("long") * TILE
        out = out.withColumn(lo, F.when(F.col("__big"), F.greatest(F.col(lo), base)).otherwise(F.col(lo)))
        out = out.withColumn(hi, F.when(F.col("__big"), F.least(F.col(hi), base + TILE)).otherwise(F.col(hi)))
    return out.filter("x1 > x0 AND y1 > y0").select(*keys, *BOX)


def whole_columns(closed: DataFrame, rects: DataFrame, keys: list[str], r: int, large: DataFrame) -> DataFrame:
    """``closing`` of ``rects`` with the boxes of large plans put together over their tiles: a column reaches from one end of a closed
    row to the next in the whole plan, as in ordinary plans. A tile knows the ends inside it; neighbours hand over the nearest one."""
    small = closed.join(large, large.columns, "left_anti").select(*keys, *BOX)
    boxes = closed.join(large, large.columns, "left_semi").withColumn("tx", F.floor(F.col("x0") / TILE).cast("int"))
    rows = _closed_rows(clip_tiles(rects.join(large, large.columns, "left_semi"), large, 2 * r), [*keys, "tx", "ty"], r)
    low, left = F.col("ty").cast("long") * TILE, F.col("tx").cast("long") * TILE
    rows = rows.filter((F.col("y0") < low + TILE) & (F.col("y1") > low))
    ends = rows.select(*keys, "tx", F.explode(F.array("x0", "x1")).alias("x")).filter((F.col("x") >= left) & (F.col("x") < left + TILE))
    marks = ends.unionByName(boxes.select(*keys, "tx", F.lit(None).cast("long").alias("x")))
    tiles = marks.groupBy(*keys, "tx").agg(F.sort_array(F.collect_set("x")).alias("__xs"), F.min("x").alias("__lo"), F.max("x").alias("__hi"))
    w = W.partitionBy(*keys).orderBy("tx")
    before, after = F.max("__hi").over(w.rowsBetween(W.unboundedPreceding, -1)), F.min("__lo").over(w.rowsBetween(1, W.unboundedFollowing))
    tiles = tiles.select(*keys, "tx", F.array_compact(F.concat(F.array(before), "__xs", F.array(after))).alias("__xs"))
    n = F.greatest(F.size("__xs") - 1, F.lit(0))
    slabs = F.zip_with(F.slice("__xs", 1, n), F.slice("__xs", 2, n), lambda a, b: F.struct(a.alias("__a"), b.alias("__b")))
    s = boxes.join(tiles, [*keys, "tx"]).select(*keys, "x0", "x1", "y0", "y1", slabs.alias("__slabs"))
    s = s.select(*keys, "y0", "y1", F.inline(F.filter("__slabs", lambda c: (c["__a"] < F.col("x1")) & (c["__b"] > F.col("x0")))))
    names = {"x0": "__a", "x1": "__b", "y0": "__u0", "y1": "__u1"}
    return small.unionByName(_merged(s, keys, "y0", "y1").select(*keys, *[F.col(names[c]).alias(c) for c in BOX]))
