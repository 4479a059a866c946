"""Reading, building, checking and writing plans in the common sample format, plus the table formats around it."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranking import rank_distributed
from ..session import checkpointed
from ..vocab import ROOM_TYPES

C, lit = F.col, F.lit
PART = 2000  # rooms per record; a larger plan is stored as several parts

POLYGON = T.ArrayType(T.ArrayType(T.DoubleType()))
OPENING = T.StructType().add("type", T.StringType()).add("polygon", POLYGON)
ROOM = T.StructType().add("type", T.StringType()).add("type_native", T.StringType()).add("polygon", POLYGON)
GRAPH = T.StructType().add("edges", T.ArrayType(T.StructType().add("i", T.LongType()).add("j", T.LongType()).add("kind", T.StringType())))
SAMPLE = T.StructType([T.StructField(n, t) for n, t in [
    ("source", T.StringType()), ("variant", T.StringType()), ("id", T.StringType()), ("part", T.LongType()), ("units", T.StringType()),
    ("scale_m_per_unit", T.DoubleType()), ("boundary", POLYGON), ("rooms", T.ArrayType(ROOM)), ("doors", T.ArrayType(OPENING)),
    ("windows", T.ArrayType(OPENING)), ("walls", T.ArrayType(OPENING)), ("graph", GRAPH), ("condition", T.StringType())]])


def box_polygon() -> Column:
    x0, y0, x1, y1 = [C(c).cast("double") for c in ("x0", "y0", "x1", "y1")]
    return F.array(F.array(x0, y0), F.array(x1, y0), F.array(x1, y1), F.array(x0, y1))


def make_samples(df: DataFrame) -> DataFrame:
    """Rows in the sample schema: missing fields get their defaults, unknown fields are an error."""
    unknown = set(df.columns) - set(SAMPLE.names)
    if unknown:
        raise ValueError(f"unknown fields: {sorted(unknown)}")
    defaults = {"units": lit("px"), "part": lit(0), "doors": F.array(), "windows": F.array(), "walls": F.array()}
    cols = []
    for f in SAMPLE.fields:
        v = C(f.name) if f.name in df.columns else defaults.get(f.name, lit(None))
        cols.append(v.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def nested_rooms(rooms: DataFrame) -> DataFrame:
    """(plan_id, part, rooms): at most PART rooms per record."""
    r = F.struct("idx", F.struct("type", C("type").alias("type_native"), box_polygon().alias("polygon")).alias("room"))
    g = rooms.groupBy("plan_id", F.floor(C("idx") / PART).alias("part")).agg(F.array_sort(F.collect_list(r)).alias("rs"))
    return g.select("plan_id", "part", F.transform("rs", lambda x: x["room"]).alias("rooms"))


def problems(sample: DataFrame, n_rooms: Column | None = None) -> Column:
    """Reasons a sample breaks the format, empty when it is valid. ``n_rooms`` is the room count of the whole plan, which edge
    ends refer to; without it a record is taken to be a whole plan."""
    n = F.size("rooms") if n_rooms is None else n_rooms
    tests = [
        (C("source").isNull() | C("variant").isNull() | C("id").isNull() | C("rooms").isNull(), "missing field"),
        (~F.coalesce(C("units").isin("px", "m"), lit(False)), "bad units"),
        (F.exists("rooms", lambda r: ~F.coalesce(r["type"].isin(ROOM_TYPES), lit(False))), "type not canonical"),
        (F.exists("rooms", lambda r: F.coalesce((F.size(r["polygon"]) < 3) | F.exists(r["polygon"], lambda p: F.size(p) != 2), lit(True))), "bad polygon"),
        (F.exists("graph.edges", lambda e: (e["i"] < 0) | (e["j"] < 0) | (e["i"] >= n) | (e["j"] >= n)), "edge out of range"),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(c, lit(False)), lit(m)) for c, m in tests]))


def write_samples(samples: DataFrame, path: str) -> None:
    """Valid samples partitioned by source and variant, the rest next to them with their reasons."""
    key = ["source", "variant", "id"]
    whole = samples.groupBy(*key).agg(F.sum(F.size("rooms")).alias("plan_rooms"))
    same = [C(k).eqNullSafe(C(f"w_{k}")) for k in key]
    s = samples.join(whole.select("plan_rooms", *[C(k).alias(f"w_{k}") for k in key]), same).drop(*[f"w_{k}" for k in key])
    s = s.withColumn("problems", problems(s, C("plan_rooms"))).drop("plan_rooms")
    s.filter(F.size("problems") == 0).drop("problems").write.mode("overwrite").partitionBy("source", "variant").parquet(f"{path}/valid")
    s.filter(F.size("problems") > 0).write.mode("overwrite").parquet(f"{path}/quarantine")


def read_samples(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Sample JSON of a directory with the file stem; the schema is fixed, so no pass infers it."""
    d = spark.read.schema(SAMPLE).option("multiLine", multi_line).json(path)
    return d.withColumn("stem", F.regexp_replace(C("_metadata.file_name"), r"\..*$", ""))


def write_splits(ids: DataFrame, path: str, chunk: int = 1000) -> None:
    """Split manifest as one record per (split, part) with at most ``chunk`` sorted ids and the split's count."""
    r = rank_distributed(ids.select("split", "id"), ["split"], ["id"], "pos")
    n = ids.groupBy("split").agg(F.count(lit(1)).alias("count"))
    g = r.groupBy("split", F.floor(C("pos") / chunk).alias("part")).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    g.join(n, "split").write.mode("overwrite").json(path)


def read_splits(spark: SparkSession, path: str, splits: list[str] | None = None) -> DataFrame:
    """(split, id) of one split, several, or all."""
    d = spark.read.schema("split string, part long, count long, ids array<string>").json(path)
    d = d.filter(C("split").isin(splits)) if splits is not None else d
    return d.select("split", F.explode("ids").alias("id"))


def read_jsonl_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of compressed JSON lines. A compressed file is read by one task front to back, so positions
    inside it are consecutive; the checkpoint fixes them."""
    d = spark.read.text(path).select("value", C("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("m"))
    d = checkpointed(d)
    lo = d.groupBy("file").agg(F.min("m").alias("lo"))
    return d.join(lo, "file").select("file", (C("m") - C("lo")).alias("line"), "value")


def wkt_ring(col: Column) -> Column:
    """Outer ring of a WKT polygon, closing point dropped."""
    body = F.regexp_extract(col, r"\(\(([^)]*)\)", 1)
    pts = F.transform(F.split(body, ", *"), lambda p: F.struct(F.split(p, " ")[0].cast("double").alias("x"), F.split(p, " ")[1].cast("double").alias("y")))
    return F.slice(pts, 1, F.greatest(F.size(pts) - 1, lit(0)))


def svg_points(col: Column) -> Column:
    return F.transform(F.split(F.trim(col), " +"), lambda p: F.struct(F.split(p, ",")[0].cast("double").alias("x"), F.split(p, ",")[1].cast("double").alias("y")))


def digest(df: DataFrame, body: Column, by: list[str]) -> DataFrame:
    """Record count and an order-free digest, so no task ever holds the whole body: the exact sum, in decimal digits, of the
    first 60 bits of every record's SHA-256. (A digest of the whole body, in order, would need it in one place.)"""
    h = F.conv(F.substring(F.sha2(body, 256), 1, 15), 16, 10).cast("decimal(20,0)")
    return df.groupBy(*by).agg(F.count(lit(1)).alias("records"), F.sum(h).cast("string").alias("digest"))


def missing_only(keys: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    return keys.join(cache.select(key), key, "left_anti")
