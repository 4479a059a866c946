"""Floor-plan tables derived from the given star-schema tables. All geometry is in whole centimetres."""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import spatial
from ..operators.ranking import rank_within
from .. import session
from ..session import bucketed, large_groups, new_path
from ..vocab import ROOM_TYPES

HOMES = 1_000_000  # homes an owner may have
BUCKET_ROWS = 20_000  # rooms that one task takes
_LARGE: dict = {}
_KEPT: dict = {}

# Native labels cycled over the parts; one entry per spelling variant the label functions must handle.
NATIVE_LABELS = ["Living-Room", " MasterRoom ", "WC", "walk in closet", "???", "Draw Room", "Hallway", "carport",
                 "Study.Room", "sauna", "LOUNGE", "garden", "Undefined", "Dining", "Store--Room", "Foyer", "loggia"]


def type_name(col) -> F.Column:
    """Canonical type at a position of the vocabulary."""
    return F.element_at(F.array(*[F.lit(t) for t in ROOM_TYPES]), col.cast("int") + 1)


def pick(values: list[str], pos) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), pos.cast("int") + 1)

ANSWER_LABELS = ["Bedroom", "WC", "Kitchen", "Living-Room"]


class Tables:
    """Lazy DataFrames over one data directory."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, str(path)

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def version(self) -> tuple:
        """The application and the files that the plan tables come from: what is kept holds for just these. The files are listed, none is read."""
        files = []
        for name in ("lineitem", "orders"):
            listed = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{self.path}/{name}.parquet")
            files += sorted(tuple(map(str, r)) for r in listed.select("path", "length", "modificationTime").collect())
        return (self.spark.sparkContext.applicationId, session.GROUP_LIMIT, *files)

    @cached_property
    def buckets(self) -> int:
        """Buckets of the plan tables: their number grows with the rooms, so a task's share does not."""
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-self.raw("lineitem").count() // BUCKET_ROWS))

    def kept(self, name: str, build) -> DataFrame:
        """A table that many steps read: built once per application and version, as Parquet in the shared folder. Its plans lie in buckets,
        so steps within plans shuffle nothing; with plans above the limit it has none, and these spread by their tiles."""
        key = (*self.version, name)
        if self.large is None:
            if key not in _KEPT:
                _KEPT[key] = bucketed(build(), ["plan_id"], self.buckets, dealt=True)
            return self.spark.table(_KEPT[key])
        if key not in _KEPT:
            path, df = new_path(self.spark, name), build()
            df.write.parquet(path)
            _KEPT[key] = (path, df.schema)
        path, schema = _KEPT[key]
        return self.spark.read.schema(schema).parquet(path)

    @cached_property
    def large(self) -> DataFrame | None:
        """Plans too big for per-plan work, found once per version of the data."""
        key = self.version
        if key not in _LARGE:
            _LARGE[key] = large_groups(self.raw("lineitem").select(F.col("l_orderkey").alias("plan_id")), ["plan_id"])
        return _LARGE[key]

    @property
    def dealt(self) -> int | None:
        """Number of buckets by plan in which the plan tables lie, if they do."""
        return self.buckets if self.large is None else None

    @cached_property
    def rooms(self) -> DataFrame:
        return self.kept("rooms", self._rooms)

    def _rooms(self) -> DataFrame:
        li = self.raw("lineitem").select(
            F.col("l_orderkey").alias("plan_id"), F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"),
            F.col("l_quantity").alias("q"), F.col("l_linenumber").alias("ln"),
            F.col("l_extendedprice").alias("ep"), F.col("l_shipdate").alias("sd"))
        if self.large is None:
            li = li.repartition(self.buckets, "plan_id")
        r = rank_within(li, ["plan_id"], ["ln", "pk", "sk", "q", "ep", "sd"], "idx", self.large)
        x0 = (F.col("idx") % 3) * 400 + (F.col("sk") % 5) * 10
        y0 = F.floor(F.col("idx") / 3) * 400 + (F.col("pk") % 4) * 10
        r = r.select("plan_id", "idx", "pk", (F.col("pk") % 15).cast("int").alias("type_id"),
                     x0.alias("x0"), y0.alias("y0"), (x0 + 300 + F.col("q").cast("long") * 3).alias("x1"),
                     (y0 + 300 + (F.col("pk") * 7 + F.col("idx") * 31) % 151).alias("y1"))
        return r.withColumn("type", type_name(F.col("type_id")))

    @cached_property
    def plans(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("plan_id"), F.col("o_orderstatus").alias("dataset"),
            F.col("o_orderpriority").alias("variant"), F.col("o_orderdate").alias("created"),
            F.col("o_custkey").alias("home"), (F.col("o_custkey") % 10 != 0).alias("scale_known"))

    @cached_property
    def dealt_plans(self) -> DataFrame:
        """The plans in the buckets of their rooms, for steps that join both."""
        if self.dealt is None:
            return self.plans
        return self.kept("plans", lambda: self.plans.repartition(self.buckets, "plan_id"))

    @cached_property
    def doors(self) -> DataFrame:
        a = self.rooms.select("plan_id", "idx", *[F.col(c).alias("a" + c) for c in spatial.BOX])
        b = self.rooms.select("plan_id", (F.col("idx") - 1).alias("idx"), *[F.col(c).alias("b" + c) for c in spatial.BOX])
        mid = a.filter((F.col("plan_id") + F.col("idx")) % 4 != 0).join(b.hint("merge"), ["plan_id", "idx"]).select(
            "plan_id", F.col("idx").alias("k"), F.lit("interior_door").alias("type"),
            F.floor((F.col("ax0") + F.col("ax1") + F.col("bx0") + F.col("bx1")) / 4).alias("mx"),
            F.floor((F.col("ay0") + F.col("ay1") + F.col("by0") + F.col("by1")) / 4).alias("my"))
        front = self.rooms.filter((F.col("idx") == 0) & (F.col("plan_id") % 5 != 0)).select(
            "plan_id", F.lit(-1).cast("long").alias("k"), F.lit("front_door").alias("type"),
            F.floor((F.col("x0") + F.col("x1")) / 2).alias("mx"), F.floor((F.col("y0") + F.col("y1")) / 2).alias("my"))
        d = session.stacked(mid, front)
        return d.select("plan_id", "k", "type", (F.col("mx") - 45).alias("x0"), (F.col("my") - 10).alias("y0"),
                        (F.col("mx") + 45).alias("x1"), (F.col("my") + 10).alias("y1"))

    @cached_property
    def windows(self) -> DataFrame:
        return self.rooms.filter("pk % 3 <> 0").select(
            "plan_id", F.col("idx").alias("room"), (F.lit(60) + F.col("pk") % 120).alias("width_cm"),
            F.lit(90).alias("sill_cm"), F.lit(220).alias("head_cm"),
            F.col("x0"), (F.col("y0") - 10).alias("y0"),
            (F.col("x0") + 60 + F.col("pk") % 120).alias("x1"), (F.col("y0") + 10).alias("y1"))

    @cached_property
    def boundary(self) -> DataFrame:
        return self.rooms.groupBy("plan_id").agg(
            (F.min("x0") + 20).alias("x0"), (F.min("y0") + 20).alias("y0"),
            (F.max("x1") - 20).alias("x1"), (F.max("y1") - 20).alias("y1"))

    @cached_property
    def gen_rooms(self) -> DataFrame:
        t = F.when(F.col("pk") % 13 == 0, (F.col("type_id") + 1) % 15).otherwise(F.col("type_id")).cast("int")
        return self.rooms.filter("pk % 11 <> 0").withColumns({"type_id": t, "type": type_name(t)})

    @cached_property
    def gen_ids(self) -> DataFrame:
        """Ids of three generated samples per plan, two where plan_id % 8 = 0; the first one of every third plan has the plan's own id."""
        last = F.when(F.col("plan_id") % 8 == 0, 1).otherwise(2)
        p = self.plans.select("plan_id", F.explode(F.sequence(F.lit(0), last)).alias("k"))
        return p.select(
            F.when((F.col("plan_id") % 3 == 0) & (F.col("k") == 0), F.col("plan_id").cast("string"))
            .otherwise(F.concat_ws("_", F.col("plan_id").cast("string"), F.col("k").cast("string"))).alias("gen_id"))

    @cached_property
    def program_edges(self) -> DataFrame:
        r = self.rooms.select("plan_id", "idx")
        chain = r.filter("idx >= 1").select("plan_id", (F.col("idx") - 1).alias("a"), F.col("idx").alias("b"),
                                            F.lit("door").alias("kind"))
        star = r.filter("idx >= 2").select("plan_id", F.lit(0).cast("long").alias("a"), F.col("idx").alias("b"),
                                           F.lit("wall").alias("kind"))
        return chain.unionByName(star)

    @cached_property
    def storeys(self) -> DataFrame:
        """All plans as storeys: those of an owner in turn make homes of 1 + owner % 3 storeys, numbered owner * 1000000 + turn; the last may lack some."""
        p = self.plans.select(F.col("home").alias("owner"), "plan_id")
        s = rank_within(p, ["owner"], ["plan_id"], "turn", self.large_owners).withColumn("n_storeys", F.lit(1) + F.col("owner") % 3)
        return s.select((F.col("owner") * HOMES + F.floor(F.col("turn") / F.col("n_storeys"))).alias("home"),
                        (F.col("turn") % F.col("n_storeys")).alias("storey"), "n_storeys", "plan_id")

    @cached_property
    def large_owners(self) -> DataFrame | None:
        key = (*self.version, "owner")
        if key not in _LARGE:
            _LARGE[key] = large_groups(self.raw("orders").select(F.col("o_custkey").alias("owner")), ["owner"])
        return _LARGE[key]

    @property
    def large_homes(self) -> DataFrame | None:
        """The same under the name that plans have for their owner."""
        return None if self.large_owners is None else self.large_owners.withColumnRenamed("owner", "home")

    @cached_property
    def adj(self) -> DataFrame:
        return self.kept("adj", lambda: spatial.wall_adjacency(self.rooms, large=self.large).select("plan_id", "i", "j"))

    @cached_property
    def door_edges(self) -> DataFrame:
        return self.kept("door-edges", lambda: spatial.door_edges(self.doors, self.rooms, large=self.large))

    @cached_property
    def edges(self) -> DataFrame:
        return session.stacked(self.adj.select("plan_id", "i", "j", F.lit("wall").alias("kind")),
                               self.door_edges.select("plan_id", "i", "j", F.lit("door").alias("kind")))

    @cached_property
    def ring_edges(self) -> DataFrame:
        c = [("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")]
        arr = F.array(*[F.struct(F.lit(k).alias("k"), F.col(c[k][0]).alias("x0"), F.col(c[k][1]).alias("y0"),
                                 F.col(c[(k + 1) % 4][0]).alias("x1"), F.col(c[(k + 1) % 4][1]).alias("y1"))
                        for k in range(4)])
        return self.rooms.select("plan_id", "idx", F.inline(arr))

    @cached_property
    def rings(self) -> DataFrame:
        """Non-rectangular outlines: rectangle, L (notch at the last corner) or chamfered corner, by pk % 3."""
        w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
        xm, ym = F.col("x1") - F.floor(w / 2), F.col("y1") - F.floor(h / 3)
        x0, y0, x1, y1 = [F.col(c).cast("double") for c in spatial.BOX]
        xm, ym = xm.cast("double"), ym.cast("double")

        def ring(*pts):
            return F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in pts])

        r = F.when(F.col("pk") % 3 == 0, ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))) \
             .when(F.col("pk") % 3 == 1, ring((x0, y0), (x1, y0), (x1, ym), (xm, ym), (xm, y1), (x0, y1))) \
             .otherwise(ring((x0, y0), (x1, y0), (x1, ym), (xm, y1), (x0, y1)))
        return self.rooms.select("plan_id", "idx", "pk", "type", *spatial.BOX, r.alias("ring"))

    @cached_property
    def ring_points(self) -> DataFrame:
        return self.rings.select("plan_id", "idx", F.posexplode("ring").alias("k", "p")).select(
            "plan_id", "idx", F.col("k").cast("long").alias("k"), "p.x", "p.y")

    @cached_property
    def runs(self) -> DataFrame:
        """Label image rows: every room sampled at 20 cm, as half-open column runs."""
        lo, hi = F.ceil(F.col("y0") / 20), F.ceil(F.col("y1") / 20) - 1
        return self.rooms.withColumn("r", F.explode(F.sequence(lo, hi))).select(
            "plan_id", "r", F.ceil(F.col("x0") / 20).alias("c0"), F.ceil(F.col("x1") / 20).alias("c1"),
            F.col("type_id").cast("long").alias("label"), "idx")

    @cached_property
    def native(self) -> DataFrame:
        """Rooms with a native label: a fixed spelling variant chosen by part, sometimes with the part name."""
        lab = pick(NATIVE_LABELS, F.col("pk") % len(NATIVE_LABELS))
        return self.rooms.select("plan_id", "idx", "pk", F.when(F.col("pk") % 5 == 4, F.concat(lab, F.lit(" "), F.col("pk")))
                                 .otherwise(lab).alias("label"))

    @cached_property
    def features(self) -> DataFrame:
        return self.raw("embeddings").select(
            "vec_id", F.when(F.col("label") < 5, "real").otherwise("gen").alias("set_id"), "label",
            F.transform("embedding", lambda x: x.cast("double")).alias("vec"))

    @cached_property
    def raw_text(self) -> DataFrame:
        """Generated JSON text: every 7th cut short, every 11th with trailing text."""
        p = F.col("props")
        return self.raw("events").select(
            F.col("event_id").alias("id"), "user_id", "event_type", "value",
            F.when(F.col("event_id") % 7 == 0, F.expr("substring(props, 1, length(props) - 1)"))
            .when(F.col("event_id") % 11 == 0, F.concat(p, F.lit(" done")))
            .otherwise(p).alias("text"))

    @cached_property
    def outputs(self) -> DataFrame:
        """A model's answer per room: a text of 1 + pk % 3 rooms in a row, some cut short, followed by words, without a plan or missing.

        Faults of single rooms: a corner that is no number (every 17th), two corners (every 19th), a number as text (every 23rd).
        """
        pk = F.col("pk")

        def answer(j):
            label, n = pick(ANSWER_LABELS, (pk + j) % len(ANSWER_LABELS)), pk + j
            ends = [(F.col(x) + 400 * j, F.col(y)) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))]

            def corner(k):
                x = ends[k][0].cast("string")
                if k == 1:
                    x = F.when(n % 17 == 0, '"wide"').when(n % 23 == 0, F.concat(F.lit('"'), x, F.lit('"'))).otherwise(x)
                return F.concat(F.lit('{"x": '), x, F.lit(', "z": '), ends[k][1], F.lit("}"))

            first, rest = F.concat_ws(", ", corner(0), corner(1)), F.concat_ws(", ", corner(2), corner(3))
            corners = F.when(n % 19 == 0, first).otherwise(F.concat_ws(", ", first, rest))
            return F.concat(F.lit('{"id": '), j, F.lit(', "room_type": "'), label, F.lit('", "floor_polygon": ['), corners, F.lit("]}"))

        places = F.sequence(F.lit(0), (pk % 3).cast("int"))
        head = F.concat(F.when(pk % 2 == 0, "Output: ").otherwise("Here it is. "), F.lit('{"rooms": ['), F.array_join(F.transform(places, answer), ", "))
        text = (F.when(pk % 13 == 0, F.lit(None)).when(pk % 29 == 0, "no plan").when(pk % 7 == 0, head)
                .when(pk % 11 == 0, F.concat(head, F.lit("]} done"))).otherwise(F.concat(head, F.lit("]}"))))
        wanted = F.transform(places, lambda j: F.when((pk % 10 == 3) & (j == 0), "WC").otherwise(pick(ANSWER_LABELS, (pk + j) % len(ANSWER_LABELS))))
        wanted = F.when(pk % 5 == 0, F.slice(wanted, 1, (pk % 3).cast("int"))).otherwise(wanted)
        return session.spread(self.rooms).select("plan_id", "idx", F.when(pk % 4 == 0, "rows").otherwise("columns").alias("dataset"), text.alias("text"), wanted.alias("wanted"),
                                 F.when(pk % 31 != 0, pk % 7 != 0).alias("ended"))

    @cached_property
    def thresholds(self) -> DataFrame:
        from ..plans.rules import threshold_table
        return threshold_table(self.spark)
