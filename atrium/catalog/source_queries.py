"""Sources and sinks, each written to the shared folder and read back."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import register
from ..functions.geometry import polygon_area
from ..plans import metrics as M
from ..plans.rules import room_attributes
from ..sources import samples as S
from ..session import new_path
from .base import query

C, lit = F.col, F.lit


def samples(t):
    p = t.plans.select("plan_id", C("dataset").alias("source"), "variant")
    d = S.nested_rooms(t.rooms).join(p, "plan_id")
    return S.make_samples(d.select("source", "variant", C("plan_id").cast("string").alias("id"), "part", lit("px").alias("units"),
                                   lit(0.01).alias("scale_m_per_unit"), "rooms"))


SAMPLE_SQL = "SELECT p.plan_id::VARCHAR AS id, p.dataset AS source, p.variant, count(*) AS n_rooms, round(sum((x1 - x0) * (y1 - y0))::DOUBLE, 3) AS area FROM plans p JOIN rooms r ON p.plan_id = r.plan_id GROUP BY ALL"


def sample_summary(s):
    r = s.select("id", "source", "variant", F.explode("rooms").alias("r"))
    ring = F.transform(C("r.polygon"), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return r.groupBy("id", "source", "variant").agg(F.count(lit(1)).alias("n_rooms"), F.round(F.sum(polygon_area(ring)), 3).alias("area"))


@query("read_samples", SAMPLE_SQL)
def read_samples(t):
    path = new_path(t.spark, "samples")
    samples(t).write.json(path)
    return sample_summary(S.read_samples(t.spark, path))


@query("write_samples", SAMPLE_SQL)
def write_samples(t):
    path = new_path(t.spark, "samples")
    S.write_samples(samples(t), path)
    return sample_summary(t.spark.read.parquet(f"{path}/valid"))


@query("make_sample", "SELECT p.plan_id::VARCHAR AS id, 'px' AS units, 0 AS n_doors, NULL::VARCHAR AS condition, count(*) AS n_rooms FROM plans p JOIN rooms r ON p.plan_id = r.plan_id GROUP BY ALL")
def make_sample(t):
    d = S.make_samples(S.nested_rooms(t.rooms).select(C("plan_id").cast("string").alias("id"), "part", "rooms"))
    return d.groupBy("id", "units", "condition").agg(F.sum(F.size("doors")).alias("n_doors"), F.sum(F.size("rooms")).alias("n_rooms"))


@query("validate_samples", """SELECT p.plan_id::VARCHAR AS id, concat_ws(';', CASE WHEN p.plan_id % 13 = 0 THEN 'bad units' END, CASE WHEN bool_or(pk % 29 = 0) THEN 'type not canonical' END,
  CASE WHEN bool_or(pk % 31 = 0) THEN 'bad polygon' END, CASE WHEN p.plan_id % 17 = 0 THEN 'edge out of range' END) AS problems FROM plans p JOIN rooms r ON p.plan_id = r.plan_id GROUP BY p.plan_id""")
def validate_samples(t):
    """Whole plans with planted faults, checked inside Spark; edge ends of every part refer to the whole plan."""
    room = F.struct(F.when(C("pk") % 29 == 0, "attic").otherwise(C("type")).alias("type"), C("type").alias("type_native"),
                    F.when(C("pk") % 31 == 0, F.slice(S.box_polygon(), 1, 2)).otherwise(S.box_polygon()).alias("polygon"))
    g = t.rooms.groupBy("plan_id", F.floor(C("idx") / S.PART).alias("part")).agg(F.collect_list(room).alias("rooms"))
    d = g.join(t.plans.select("plan_id", C("dataset").alias("source"), "variant"), "plan_id")
    d = d.join(g.groupBy("plan_id").agg(F.sum(F.size("rooms")).alias("plan_rooms")), "plan_id")
    edge = F.struct(lit(0).cast("long").alias("i"), C("plan_rooms").alias("j"), lit("door").alias("kind"))
    s = S.make_samples(d.select("source", "variant", C("plan_id").cast("string").alias("id"), "part", F.when(C("plan_id") % 13 == 0, "ft").otherwise("px").alias("units"), "rooms",
                                F.struct(F.when(C("plan_id") % 17 == 0, F.array(edge)).otherwise(F.array()).alias("edges")).alias("graph")))
    whole = d.groupBy(C("plan_id").cast("string").alias("id")).agg(F.first("plan_rooms").alias("plan_rooms"))
    s = s.join(whole, "id")
    bad = s.select("id", S.problems(s, C("plan_rooms")).alias("p"))
    order = ["missing field", "bad units", "type not canonical", "bad polygon", "edge out of range"]
    has = lambda m: F.when(F.max(F.array_contains("p", m)), lit(m))
    return bad.groupBy("id").agg(F.array_join(F.array_compact(F.array(*[has(m) for m in order])), ";").alias("problems"))


def splits(t):
    return t.plans.select(C("dataset").alias("split"), F.lpad(C("plan_id").cast("string"), 9, "0").alias("id"))


@query("read_splits", "SELECT dataset AS split, lpad(plan_id::VARCHAR, 9, '0') AS id FROM plans WHERE dataset IN ('F', 'O')")
def read_splits(t):
    path = new_path(t.spark, "splits")
    S.write_splits(splits(t), path)
    return S.read_splits(t.spark, path, ["F", "O"])


@query("write_splits", """SELECT split, part, any_value(n) AS count, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT dataset AS split, lpad(plan_id::VARCHAR, 9, '0') AS id, (row_number() OVER (PARTITION BY dataset ORDER BY lpad(plan_id::VARCHAR, 9, '0')) - 1) // 1000 AS part,
  count(*) OVER (PARTITION BY dataset) AS n FROM plans) GROUP BY split, part""")
def write_splits(t):
    path = new_path(t.spark, "splits")
    S.write_splits(splits(t), path)
    d = t.spark.read.schema("split string, part long, count long, ids array<string>").json(path)
    return d.select("split", "part", "count", F.array_join("ids", ",").alias("ids"))


@query("sink_tables", "SELECT plan_id::VARCHAR AS id, idx, type, (x1 - x0) * (y1 - y0) AS area_cm2 FROM rooms")
def sink_tables(t):
    path = new_path(t.spark, "per_room")
    d = room_attributes(t.rooms).select(C("plan_id").cast("string").alias("id"), "idx", "type", "area_cm2")
    d.write.option("header", True).csv(path)
    return t.spark.read.schema("id string, idx long, type string, area_cm2 long").option("header", True).csv(path)


@query("read_stage_csv", "SELECT lpad(plan_id::VARCHAR, greatest(6, length(plan_id::VARCHAR))::INTEGER, '0') AS id, count(*) AS n_edges FROM adj GROUP BY plan_id")
def read_stage_csv(t):
    """Ids are read as text, so leading zeros survive. They are filled up to six digits; longer ones stay whole."""
    path = new_path(t.spark, "per_edge")
    text = C("plan_id").cast("string")
    t.adj.select(F.lpad(text, F.greatest(F.lit(6), F.length(text)), "0").alias("id"), "i", "j").write.option("header", True).csv(path)
    d = t.spark.read.schema("id string, i long, j long").option("header", True).csv(path)
    return d.groupBy("id").agg(F.count(lit(1)).alias("n_edges"))


@query("sink_summary", "SELECT count(*) AS n_samples, round(avg(n), 6) AS n_rooms FROM (SELECT count(r.idx) AS n FROM plans p LEFT JOIN rooms r ON p.plan_id = r.plan_id GROUP BY p.plan_id)")
def sink_summary(t):
    path = new_path(t.spark, "summary")
    d = M.plan_counts(t.plans, t.rooms)
    d.agg(F.count(lit(1)).alias("n_samples"), F.round(F.avg("n_rooms"), 6).alias("n_rooms")).write.json(path)
    return t.spark.read.schema("n_samples long, n_rooms double").json(path)


@query("read_jsonl_gz")
def read_jsonl_gz(t):
    """Compressed JSON lines with their line number per file."""
    path = new_path(t.spark, "lines")
    e = t.raw("events").select("event_id", "event_type", "value")
    e.repartitionByRange("event_id").sortWithinPartitions("event_id").write.option("compression", "gzip").json(path)
    d = S.read_jsonl_lines(t.spark, path)
    return d.select(F.regexp_extract("file", "part-([0-9]+)", 1).alias("part"), "line", F.from_json("value", "event_id long, event_type string, value double").alias("r")).select("part", "line", "r.*")


@query("read_wkt_csv", "SELECT plan_id, idx, 'AREA' AS entity_type, ((x1 - x0) * (y1 - y0))::DOUBLE AS area FROM rooms")
def read_wkt_csv(t):
    path = new_path(t.spark, "wkt")
    p = lambda x, y: F.concat_ws(" ", C(x), C(y))
    wkt = F.concat(lit("POLYGON (("), F.concat_ws(", ", p("x0", "y0"), p("x1", "y0"), p("x1", "y1"), p("x0", "y1"), p("x0", "y0")), lit("))"))
    t.rooms.select("plan_id", "idx", lit("AREA").alias("entity_type"), wkt.alias("geometry")).write.option("header", True).csv(path)
    d = t.spark.read.schema("plan_id long, idx long, entity_type string, geometry string").option("header", True).csv(path)
    return d.select("plan_id", "idx", "entity_type", polygon_area(S.wkt_ring(C("geometry"))).alias("area"))


@query("read_svg_xml", "SELECT plan_id, idx, 'Space ' || type AS class, ((x1 - x0) * (y1 - y0))::DOUBLE AS area FROM rooms WHERE type <> 'other'")
def read_svg_xml(t):
    """Groups with a class and a point list; only room groups are kept."""
    path = new_path(t.spark, "svg")
    p = lambda x, y: F.concat_ws(",", C(x), C(y))
    pts = F.concat_ws(" ", p("x0", "y0"), p("x1", "y0"), p("x1", "y1"), p("x0", "y1"))
    cls = F.when(C("type") == "other", "Wall External").otherwise(F.concat(lit("Space "), C("type")))
    t.rooms.select(C("plan_id").alias("_plan"), C("idx").alias("_idx"), cls.alias("_class"), pts.alias("polygon")).write.format("xml").option("rowTag", "g").option("rootTag", "svg").save(path)
    d = t.spark.read.format("xml").option("rowTag", "g").schema("_plan long, _idx long, _class string, polygon string").load(path)
    d = d.filter(C("_class").startswith("Space "))
    return d.select(C("_plan").alias("plan_id"), C("_idx").alias("idx"), C("_class").alias("class"), polygon_area(S.svg_points(C("polygon"))).alias("area"))


@query("read_nested_json", "SELECT s.home, s.storey, s.plan_id, count(r.idx) AS n_rooms FROM storeys s LEFT JOIN rooms r ON s.plan_id = r.plan_id GROUP BY ALL")
def read_nested_json(t):
    """Home records (at most three storeys each) in compressed JSON, exploded to storeys."""
    path = new_path(t.spark, "homes")
    n = t.rooms.groupBy("plan_id").agg(F.count(lit(1)).alias("n_rooms"))
    s = t.storeys.join(n, "plan_id", "left").select("home", F.struct("storey", "plan_id", F.coalesce("n_rooms", lit(0)).alias("n_rooms")).alias("s"))
    s.groupBy("home").agg(F.collect_list("s").alias("storeys")).write.option("compression", "gzip").json(path)
    d = t.spark.read.schema("home long, storeys array<struct<storey:long,plan_id:long,n_rooms:long>>").json(path)
    return d.select("home", F.inline("storeys"))


@query("read_raster_runs", "SELECT plan_id, count(*) AS n_runs, CAST(sum(c1 - c0) AS BIGINT) AS pixels FROM runs GROUP BY plan_id")
def read_raster_runs(t):
    path = new_path(t.spark, "runs")
    t.runs.write.parquet(path)
    return t.spark.read.parquet(path).groupBy("plan_id").agg(F.count(lit(1)).alias("n_runs"), F.sum(C("c1") - C("c0")).alias("pixels"))


@query("read_array_archives", "SELECT plan_id, idx, type_id AS type, x0, y0, x1, y1 FROM rooms")
def read_array_archives(t):
    """Records of parallel arrays (types, boxes), zipped back to rows."""
    path = new_path(t.spark, "arrays")
    r = F.array_sort(F.collect_list(F.struct("idx", C("type_id").cast("long").alias("type"), F.array("x0", "y0", "x1", "y1").alias("box"))))
    g = t.rooms.groupBy("plan_id", F.floor(C("idx") / S.PART).alias("part")).agg(r.alias("r"))
    g.select("plan_id", C("r.idx").alias("ids"), C("r.type").alias("types"), C("r.box").alias("boxes")).write.parquet(path)
    d = t.spark.read.parquet(path).select("plan_id", F.inline(F.arrays_zip("ids", "types", "boxes")))
    return d.select("plan_id", C("ids").alias("idx"), C("types").alias("type"), *[C("boxes")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])


@query("export_jsonl", """SELECT p.dataset, count(*) AS records, CAST(sum(('0x' || substr(sha256('{"plan_id":' || r.plan_id || ',"idx":' || r.idx || ',"type":"' || r.type || '"}'), 1, 15))::BIGINT) AS VARCHAR) AS digest FROM rooms r JOIN plans p ON r.plan_id = p.plan_id GROUP BY p.dataset""")
def export_jsonl(t):
    path = new_path(t.spark, "export")
    d = t.rooms.join(t.plans.select("plan_id", "dataset"), "plan_id").select("dataset", F.to_json(F.struct("plan_id", "idx", "type")).alias("value"))
    d.write.partitionBy("dataset").text(path)
    return S.digest(t.spark.read.text(path), C("value"), ["dataset"])


@query("feature_cache", "SELECT plan_id % 3 = 0 AS cached, count(*) AS n, CAST(sum(n) AS BIGINT) AS rooms FROM plan_n GROUP BY 1")
def feature_cache(t):
    """Only features missing from the cache are computed and appended."""
    path = new_path(t.spark, "features")
    feats = lambda rooms, flag: rooms.groupBy("plan_id").agg(F.count(lit(1)).alias("rooms"), lit(flag).alias("cached"))
    feats(t.rooms.filter("plan_id % 3 = 0"), True).write.parquet(path)
    have = t.spark.read.parquet(path)
    feats(t.rooms.join(have.select("plan_id"), "plan_id", "left_anti"), False).write.mode("append").parquet(path)
    return t.spark.read.parquet(path).groupBy("cached").agg(F.count(lit(1)).alias("n"), F.sum("rooms").alias("rooms"))


@query("render_manifest", "SELECT DISTINCT dataset AS feature_set, plan_id AS sample, plan_id || '.png' AS render FROM plans UNION SELECT 'homes', plan_id, plan_id || '.png' FROM storeys")
def render_manifest(t):
    path = new_path(t.spark, "renders")
    d = t.plans.select(C("dataset").alias("feature_set"), C("plan_id").alias("sample")).unionByName(t.storeys.select(lit("homes").alias("feature_set"), C("plan_id").alias("sample"))).distinct()
    d.withColumn("render", F.concat("sample", lit(".png"))).write.option("header", True).csv(path)
    return t.spark.read.schema("feature_set string, sample long, render string").option("header", True).csv(path)


@query("run_manifest", "SELECT (SELECT count(*) FROM plans) AS n_inputs, (SELECT count(*) FROM gen_ids) AS n_samples, (SELECT count(DISTINCT gt_id) FROM paired) AS n_gt, (SELECT count(*) FROM plans WHERE plan_id NOT IN (SELECT plan_id FROM rooms)) AS n_failed, (SELECT round(sum(value), 2) FROM events) AS seconds")
def run_manifest(t):
    from .aggregate_queries import pairs
    one = lambda d, e, n: d.agg(e.alias(n))
    failed = t.plans.join(t.rooms.select("plan_id").distinct(), "plan_id", "left_anti")
    return one(t.plans, F.count(lit(1)), "n_inputs").crossJoin(one(t.gen_ids, F.count(lit(1)), "n_samples")).crossJoin(one(pairs(t), F.count_distinct("gt_id"), "n_gt")) \
        .crossJoin(one(failed, F.count(lit(1)), "n_failed")).crossJoin(one(t.raw("events"), F.round(F.sum("value"), 2), "seconds"))


@query("read_prompts_csv", "SELECT 'scene_' || p.plan_id AS scene, d.c_name AS prompt FROM plans p JOIN customer d ON p.home = d.c_custkey")
def read_prompts_csv(t):
    """Prompt table joined to scenes by the number inside the scene id."""
    path = new_path(t.spark, "prompts")
    scenes = t.plans.select(F.concat(lit("scene_"), C("plan_id")).alias("scene"), "home")
    t.raw("customer").select(C("c_custkey").alias("ID"), C("c_name").alias("Description")).write.option("header", True).csv(path)
    p = t.spark.read.schema("ID long, Description string").option("header", True).csv(path)
    keyed = scenes.withColumn("ID", F.regexp_extract(F.concat(lit("h"), C("home")), "([0-9]+)", 1).cast("long"))
    return keyed.join(p, "ID").select("scene", C("Description").alias("prompt"))


@query("register_functions", "SELECT plan_id, idx, norm, (x1 - x0) * (y1 - y0)::DOUBLE AS area FROM norm_native JOIN rooms USING (plan_id, idx)")
def register_functions(t):
    """Label and geometry functions called from SQL."""
    register.register(t.spark)
    t.native.createOrReplaceTempView("atrium_native")
    t.rooms.createOrReplaceTempView("atrium_rooms")
    return t.spark.sql("""SELECT n.plan_id, n.idx, plan_norm_label(n.label) AS norm, plan_box_area(x0, y0, x1, y1) AS area
                          FROM atrium_native n JOIN atrium_rooms r ON n.plan_id = r.plan_id AND n.idx = r.idx""")


@query("explode_udtf", "SELECT plan_id, idx, k, x0, y0, x1, y1 FROM ring_segs")
def explode_udtf(t):
    """Rings to edge rows with built-in generators."""
    from ..functions.geometry import edges_of
    d = t.rings.select("plan_id", "idx", F.posexplode(edges_of(C("ring"))).alias("k", "e"))
    return d.select("plan_id", "idx", C("k").cast("long").alias("k"), "e.*")
