"""Ring and segment functions as native Column expressions. A ring is array<struct<x, y>>, open, in order."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def polygon_area(ring: Column) -> Column:
    """Shoelace area: each point is paired with its successor in a rotated copy of the ring."""
    nxt = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    cross = F.zip_with(ring, nxt, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.when(F.size(ring) >= 3, F.abs(F.aggregate(cross, F.lit(0.0), lambda a, v: a + v)) / 2).otherwise(F.lit(0.0))


def bbox(ring: Column) -> dict[str, Column]:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return {"x0": F.array_min(xs), "y0": F.array_min(ys), "x1": F.array_max(xs), "y1": F.array_max(ys)}


def affine(ring: Column, a, b, c, d, tx=0.0, ty=0.0) -> Column:
    """Map (x, y) to (a x + b y + tx, c x + d y + ty)."""
    a, b, c, d, tx, ty = [v if isinstance(v, Column) else F.lit(float(v)) for v in (a, b, c, d, tx, ty)]
    return F.transform(ring, lambda p: F.struct((a * p["x"] + b * p["y"] + tx).alias("x"),
                                                (c * p["x"] + d * p["y"] + ty).alias("y")))


def rotate(ring: Column, radians: Column) -> Column:
    return affine(ring, F.cos(radians), -F.sin(radians), F.sin(radians), F.cos(radians))


def seg_rect(x0: Column, y0: Column, x1: Column, y1: Column, half: Column | float) -> Column:
    """Rectangle around a segment, ``half`` to each side, flat ends. NULL for a zero-length segment."""
    dx, dy = x1 - x0, y1 - y0
    n = F.sqrt(dx * dx + dy * dy)
    half = half if isinstance(half, Column) else F.lit(float(half))
    ox, oy = -dy / n * half, dx / n * half
    pts = [(x0 + ox, y0 + oy), (x1 + ox, y1 + oy), (x1 - ox, y1 - oy), (x0 - ox, y0 - oy)]
    ring = F.array(*[F.struct(F.round(x, 4).alias("x"), F.round(y, 4).alias("y")) for x, y in pts])
    return F.when(n > 0, ring)


def clean_ring(ring: Column, digits: int = 4) -> Column:
    """Round, then drop consecutive duplicates, the closing point and collinear points."""
    rounded = F.transform(ring, lambda p: F.struct(F.round(p["x"], digits).alias("x"), F.round(p["y"], digits).alias("y")))

    def let(value, body):
        """Evaluate ``value`` once and bind it inside ``body``."""
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def at(a, i):
        return F.get(a, F.pmod(i, F.size(a)))

    def opened(r):
        """Ring without repeated points; a last point equal to the first one closes the ring and goes too."""
        d = F.filter(r, lambda p, i: (i == 0) | (p != at(r, i - 1)))
        return let(d, lambda a: F.when((F.size(a) > 1) & (at(a, F.lit(0)) == at(a, F.lit(-1))),
                                       F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(1)))).otherwise(a))

    def straightened(r):
        def bends(p, i):
            return let(F.struct(at(r, i - 1).alias("a"), at(r, i + 1).alias("b")), lambda n: F.abs(
                (p["x"] - n["a"]["x"]) * (n["b"]["y"] - p["y"]) - (p["y"] - n["a"]["y"]) * (n["b"]["x"] - p["x"])) > 1e-9)
        return let(F.filter(r, bends), lambda out: F.when(F.size(out) >= 3, out).otherwise(r))

    return let(rounded, lambda r: let(opened(r), straightened))


def edges_of(ring: Column) -> Column:
    """array<struct<x0, y0, x1, y1>> of a ring."""
    nxt = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(ring, nxt, lambda p, q: F.struct(p["x"].alias("x0"), p["y"].alias("y0"),
                                                       q["x"].alias("x1"), q["y"].alias("y1")))


def signed_area(ring: Column) -> Column:
    """Shoelace sum: positive for counter-clockwise rings."""
    cross = F.transform(edges_of(ring), lambda e: e["x0"] * e["y1"] - e["x1"] * e["y0"])
    return F.aggregate(cross, F.lit(0.0), lambda a, v: a + v) / 2


def counter_clockwise(ring: Column) -> Column:
    return F.when(signed_area(ring) < 0, F.reverse(ring)).otherwise(ring)


MITRE_LIMIT = 5.0  # a corner moves by at most this many times the distance


def edge_normal(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Unit normal to the right of an edge: the outer side of a counter-clockwise ring."""
    n = F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))
    return F.struct(((y1 - y0) / n).alias("x"), ((x0 - x1) / n).alias("y"))


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def _mitre(p: Column, a: Column, b: Column, r: float) -> Column:
    k = F.lit(float(r)) / F.greatest(1 + a["x"] * b["x"] + a["y"] * b["y"], F.lit(2.0 / MITRE_LIMIT ** 2))
    return _point(p["x"] + k * (a["x"] + b["x"]), p["y"] + k * (a["y"] + b["y"]))


def edge_strip(x0: Column, y0: Column, x1: Column, y1: Column, n: Column, r: float) -> Column:
    """Rectangle between an edge and its copy moved by ``r`` along its normal."""
    return F.array(_point(x0, y0), _point(x0 + r * n["x"], y0 + r * n["y"]), _point(x1 + r * n["x"], y1 + r * n["y"]), _point(x1, y1))


def corner_kite(p: Column, a: Column, b: Column, r: float) -> Column:
    """What the strips of two edges with normals a and b leave open at their corner p; NULL where they overlap."""
    turn = (a["x"] * b["y"] - a["y"] * b["x"]) * (1 if r > 0 else -1)
    return F.when(turn > 1e-12, F.array(_point(p["x"], p["y"]), _point(p["x"] + r * a["x"], p["y"] + r * a["y"]), _mitre(p, a, b, r),
                                        _point(p["x"] + r * b["x"], p["y"] + r * b["y"])))


def _corners(ring: Column) -> Column:
    """Points with the normals of the edges before and after them."""
    def at(i):
        return F.get(ring, F.pmod(i, F.size(ring)))

    def normal(p, q):
        return edge_normal(p["x"], p["y"], q["x"], q["y"])

    return F.transform(ring, lambda p, i: F.struct(p.alias("p"), normal(at(i - 1), p).alias("a"), normal(p, at(i + 1)).alias("b")))


def offset_ring(ring: Column, r: float) -> Column:
    """Counter-clockwise ring with every edge moved outwards by ``r`` (inwards if negative) and mitred corners. Neighbouring points differ."""
    return F.transform(_corners(ring), lambda c: _mitre(c["p"], c["a"], c["b"], r))


def same_sense(ring: Column, moved: Column) -> Column:
    """True if every edge of ``moved`` runs in the direction of the same edge of ``ring``."""
    pairs = F.zip_with(edges_of(ring), edges_of(moved), lambda e, m: (e["x1"] - e["x0"]) * (m["x1"] - m["x0"]) + (e["y1"] - e["y0"]) * (m["y1"] - m["y0"]))
    return F.forall(pairs, lambda v: v > 0)


def ring_bands(ring: Column, r: float) -> Column:
    """Strips and kites that cover what lies within ``r`` of a counter-clockwise ring on its outer (r > 0) or inner side."""
    strips = F.transform(edges_of(ring), lambda e: edge_strip(e["x0"], e["y0"], e["x1"], e["y1"], edge_normal(e["x0"], e["y0"], e["x1"], e["y1"]), r))
    kites = F.filter(F.transform(_corners(ring), lambda c: corner_kite(c["p"], c["a"], c["b"], r)), lambda k: k.isNotNull())
    return F.concat(strips, kites)


def edge_length(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def edge_angle(dx: Column, dy: Column) -> Column:
    """Direction in degrees modulo a right angle."""
    return F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(90.0))


def finite_ring(ring: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """True when every coordinate is finite and, if given, inside the frame."""
    def ok(v):
        c = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
        return c & v.between(lo, hi) if lo is not None else c
    return F.coalesce((F.size(ring) >= 3) & F.forall(ring, lambda p: ok(p["x"]) & ok(p["y"])), F.lit(False))


def rel_err(value: Column, target: Column) -> Column:
    return F.when(target != 0, F.abs(value - target) / target)


def box_relation(u: dict[str, Column], v: dict[str, Column]) -> Column:
    """Ten-class relation of box u to box v. Fixed codes: 5 contains, 4 inside or centre inside, then the side the
    centre of u lies on: 0 up-left, 3 up, 8 up-right, 7 right, 9 down-right, 6 down, 1 down-left, 2 left."""
    cx, cy = (u["x0"] + u["x1"]) / 2, (u["y0"] + u["y1"]) / 2
    contains = (u["x0"] < v["x0"]) & (u["x1"] > v["x1"]) & (u["y0"] < v["y0"]) & (u["y1"] > v["y1"])
    inside = (u["x0"] >= v["x0"]) & (u["x1"] <= v["x1"]) & (u["y0"] >= v["y0"]) & (u["y1"] <= v["y1"])
    left, right = cx < v["x0"], cx > v["x1"]
    on_l, on_r = cx == v["x0"], cx == v["x1"]
    up, down = cy < v["y0"], cy > v["y1"]
    on_u, on_d = cy == v["y0"], cy == v["y1"]
    # Each side owns one of the two corners next to it and half of the border line.
    side = (F.when((left & (up | on_u)) | (on_l & on_u), 0)
            .when((on_r & (up | on_u)) | (right & up), 8)
            .when(up | (on_u & ~right), 3)
            .when((right & (down | on_d)) | (on_r & on_d), 9)
            .when((right | on_r) & ~down, 7)
            .when((left & down) | (on_l & (down | on_d)), 1)
            .when(down | (on_d & ~left), 6)
            .when(left | on_l, 2)
            .otherwise(4))
    return F.when(contains, 5).when(inside, 4).otherwise(side)


def round_half_up(col: Column, digits: int) -> Column:
    """Round through floor, so that every engine gives the same double."""
    f = float(10 ** digits)
    return F.floor(col * f + 0.5) / f
