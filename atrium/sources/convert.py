"""Conversions of source records to plan tables. Each takes and returns DataFrames; none loops over plans."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import affine, bbox, finite_ring, polygon_area
from ..functions.labels import feet_inches, lookup
from ..operators.ranking import quantiles, rank_within

C, lit = F.col, F.lit

# First token of a Finnish room label.
FINNISH = {
    "PH": "bathroom", "KH": "bathroom", "KPH": "bathroom", "WC": "bathroom", "SH": "bathroom", "PSH": "bathroom", "INV.WC": "bathroom",
    "S": "bathroom", "SAUNA": "bathroom", "KHH": "laundry", "PKH": "laundry", "K": "kitchen", "KK": "kitchen", "KT": "kitchen",
    "MH": "bedroom", "H": "bedroom", "OH": "living_room", "TUPA": "living_room", "OLESKELU": "living_room", "TH": "living_room",
    "RUOK": "dining_room", "R": "dining_room", "TSTO": "study", "TYÖH": "study", "TYÖTILA": "study", "KIRJASTO": "study",
    "VAR": "storage", "VARASTO": "storage", "KELL": "storage", "TEKN": "storage", "LÄMM": "storage", "KYLMÄ": "storage",
    "KOM": "closet", "KOMERO": "closet", "KYLMIÖ": "storage", "VH": "closet", "PUKUH": "closet", "ET": "entrance", "TK": "entrance",
    "AULA": "entrance", "KÄYT": "corridor", "KÄYTÄVÄ": "corridor", "HALLI": "entrance", "PARVEKE": "balcony", "LASITETTU": "balcony",
    "AVOKUISTI": "balcony", "TERASSI": "balcony", "AUTOTALLI": "garage", "AT": "garage", "AK": "garage",
}


def label_token_type(label: Column) -> Column:
    """Type of a label by its first token, up to a blank, slash or plus."""
    return lookup(FINNISH, F.upper(F.split(F.trim(label), "[ /+]")[0]))


def floor_scale(dims: DataFrame, keys: list[str]) -> DataFrame:
    """Metres per pixel per floor: exact median of labelled length over drawn length, short marks ignored."""
    d = dims.withColumn("ratio", F.when(C("px") > 20, feet_inches(C("label")) / C("px")))
    return quantiles(d, keys, "ratio", [0.5], "scale_p")


def bbox_fallback(rooms: DataFrame, ring: str, min_share: float = 0.5) -> DataFrame:
    """Ring replaced by its box when it covers less than ``min_share`` of it."""
    b = bbox(C(ring))
    box = (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    rect = F.array(corner(b["x0"], b["y0"]), corner(b["x1"], b["y0"]), corner(b["x1"], b["y1"]), corner(b["x0"], b["y1"]))
    return rooms.withColumn(ring, F.when(polygon_area(C(ring)) < min_share * box, rect).otherwise(C(ring)))


def local_to_world(ring: Column, dx: Column, dy: Column) -> Column:
    """Room-local points moved to the floor, y turned down."""
    return affine(ring, 1, 0, 0, -1, dx, -dy)


def ring_text(ring: Column) -> Column:
    """Corners in whole units as text: ``x y, x y, ...``."""
    return F.array_join(F.transform(ring, lambda p: F.concat_ws(" ", p["x"].cast("long"), p["y"].cast("long"))), ", ")


def norm_edges(edges: DataFrame) -> DataFrame:
    """Edges with ordered ends, without self-edges and repeats."""
    return edges.filter(C("a") != C("b")).select("plan_id", F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), "kind").distinct()


def wall_holes(doors: DataFrame) -> DataFrame:
    """Extent of an opening along its wall, decoded from the wall id ``wall|room|x0|z0|x1|z1``."""
    p = F.split("wall_id", r"\|")
    n = lambda i: p[i].cast("double")
    ln = F.sqrt((n(4) - n(2)) ** 2 + (n(5) - n(3)) ** 2)
    at = lambda t, a, b: n(a) + (n(b) - n(a)) * t / ln
    return doors.select("*", at(C("lo"), 2, 4).alias("x0"), at(C("lo"), 3, 5).alias("z0"), at(C("hi"), 2, 4).alias("x1"), at(C("hi"), 3, 5).alias("z1"),
                        F.when(p[1] == "exterior", "front_door").otherwise("interior_door").alias("type"))


def area_scale(declared: Column, drawn: Column) -> Column:
    """Metres per unit from a declared and a drawn area."""
    return F.sqrt(declared / drawn)


def clean_plans(rooms: DataFrame, ring: str, lo: float = 0.0, hi: float = 256.0) -> DataFrame:
    """Rooms of plans all of whose rings are finite and inside the frame."""
    bad = rooms.filter(~finite_ring(C(ring), lo, hi)).select("plan_id").distinct()
    return rooms.join(bad, "plan_id", "left_anti")


def same_multiset(a: DataFrame, b: DataFrame) -> DataFrame:
    """Plans whose category counts agree on both sides."""
    x = a.groupBy("plan_id", "type").agg(F.count(lit(1)).alias("n"))
    y = b.groupBy("plan_id", "type").agg(F.count(lit(1)).alias("m"))
    d = x.join(y, ["plan_id", "type"], "full_outer")
    return d.groupBy("plan_id").agg(F.min((F.coalesce("n", lit(0)) == F.coalesce("m", lit(0))).cast("int")).alias("ok")).filter("ok = 1").select("plan_id")


def nearest_colour(pixels: DataFrame, palette: list[tuple[str, int, int, int]]) -> DataFrame:
    """Label of the closest palette colour; a handful of colours, so the distances stay in one expression."""
    opts = [F.struct(((C("r") - r) ** 2 + (C("g") - g) ** 2 + (C("b") - b) ** 2).cast("double").alias("d"), lit(i).alias("i"), lit(n).alias("label"))
            for i, (n, r, g, b) in enumerate(palette)]
    return pixels.withColumn("label", F.array_min(F.array(*opts))["label"])


def json_body(text: Column) -> Column:
    """Text from the first opening brace on, behind an ``Output:`` mark if there is one."""
    mark = "Output:"
    rest = F.when(F.instr(text, mark) > 0, F.substring(text, F.instr(text, mark) + len(mark), F.length(text))).otherwise(text)
    return F.when(F.instr(rest, "{") > 0, F.substring(rest, F.instr(rest, "{"), F.length(rest))).when(text.isNotNull(), "")


def json_status(text: Column) -> Column:
    """json / json_prefix / repaired / unparseable: the body is one value, a value followed by text, holds a complete flat
    object further on, or nothing that can be read."""
    from ..functions.labels import strict_json
    body = json_body(text)
    flat = F.regexp_extract_all(body, lit(r"(\{[^{}]*\})"), lit(1))
    return (F.when(body == "", "unparseable").when(strict_json(body).isNotNull(), "json").when(F.try_parse_json(body).isNotNull(), "json_prefix")
            .when(F.exists(flat, lambda x: F.try_parse_json(x).isNotNull()), "repaired").otherwise("unparseable"))


def footprint(matrix: Column, bounds: Column) -> Column:
    """Ground corners of an asset box under a row-major 4 x 4 matrix: ring of (x, z)."""
    def put(x, y, z):
        v = lambda r: matrix[r * 4] * x + matrix[r * 4 + 1] * y + matrix[r * 4 + 2] * z + matrix[r * 4 + 3]
        return F.struct(v(0).alias("x"), v(2).alias("y"))
    x0, y0, z0, x1, z1 = bounds[0], bounds[1], bounds[2], bounds[3], bounds[5]
    return F.array(put(x0, y0, z0), put(x1, y0, z0), put(x1, y0, z1), put(x0, y0, z1))


def rank_match(named: DataFrame, program: DataFrame, keys: list[str], large: DataFrame | None = None) -> DataFrame:
    """Layout and program rooms of a type paired by falling area."""
    ranked = lambda d: rank_within(d, keys, [-C("area"), "idx"], "k", large)
    a = ranked(named).select(*keys, "k", C("idx").alias("room"))
    b = ranked(program).select(*keys, "k", C("idx").alias("program_room"))
    return a.join(b, [*keys, "k"]).select(*keys, "room", "program_room")


def single_ref(text: Column, pattern: str = r"ref:([0-9]+)") -> Column:
    """The only reference named in a record, NULL when there is none or more than one."""
    ids = F.array_distinct(F.regexp_extract_all(text, lit(pattern), lit(1)))
    return F.when(F.size(ids) == 1, ids[0])


def centred(rooms: DataFrame, cx: float = 128.0, cy: float = 128.0) -> DataFrame:
    """Boxes moved so that the plan's box is centred on a point."""
    b = rooms.groupBy("plan_id").agg(((F.min("x0") + F.max("x1")) / 2 - cx).alias("sx"), ((F.min("y0") + F.max("y1")) / 2 - cy).alias("sy"))
    d = rooms.join(b, "plan_id")
    return d.select("plan_id", "idx", *[(C(c) - C("s" + c[0])).alias(c) for c in ("x0", "y0", "x1", "y1")])
