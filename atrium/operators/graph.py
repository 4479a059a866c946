"""Graph operators on node / edge tables keyed by plan."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed


def _fold(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Label per node by folding a plan's edge list over its label array (one exact pass, all native)."""
    e = edges.groupBy("plan_id").agg(F.collect_set(F.struct(F.least("i", "j").cast("int").alias("i"),
                                                            F.greatest("i", "j").cast("int").alias("j"))).alias("es"))
    n = nodes.groupBy("plan_id").agg(F.sort_array(F.collect_set(F.col("idx").cast("int"))).alias("ns"))
    d = n.join(e.hint("merge"), "plan_id", "left")
    d = d.withColumn("es", F.coalesce("es", F.array().cast("array<struct<i:int,j:int>>")))
    # Labels are positions in the sorted node array; an edge moves the later class to the earlier one.
    lab = F.expr("""
        aggregate(filter(transform(es, e -> struct(CAST(array_position(ns, e.i) AS INT) - 1 AS i, CAST(array_position(ns, e.j) AS INT) - 1 AS j)),
                         e -> e.i >= 0 AND e.j >= 0),
          sequence(0, size(ns) - 1), (l, e) -> IF(l[e.i] = l[e.j], l,
            transform(l, v -> IF(v = greatest(l[e.i], l[e.j]), least(l[e.i], l[e.j]), v))))""")
    d = d.select("plan_id", "ns", F.posexplode(lab).alias("pos", "lab"))
    return d.select("plan_id", F.get("ns", F.col("pos")).cast("long").alias("idx"), F.get("ns", F.col("lab")).cast("long").alias("comp"))


def _iterate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest reachable node id per node by joins, with pointer jumping; used for graphs of any size."""
    key = ["plan_id"]
    both = edges.select("plan_id", F.col("i").alias("idx"), F.col("j").alias("nb")).unionByName(
        edges.select("plan_id", F.col("j").alias("idx"), F.col("i").alias("nb"))).distinct()
    both = checkpointed(both)
    lab = checkpointed(nodes.select("plan_id", "idx").distinct().withColumn("comp", F.col("idx")))
    while True:
        nb = both.join(lab.select("plan_id", F.col("idx").alias("nb"), F.col("comp").alias("c")), [*key, "nb"])
        low = nb.groupBy(*key, "idx").agg(F.min("c").alias("c"))
        nxt = lab.join(low, [*key, "idx"], "left").select(
            *key, "idx", F.least("comp", F.coalesce("c", "comp")).alias("new"), F.col("comp").alias("old"))
        # Pointer jump: follow the label's own label once.
        ptr = nxt.select(*key, F.col("idx").alias("new"), F.col("new").alias("jump"))
        nxt = nxt.join(ptr, [*key, "new"], "left").select(
            *key, "idx", F.least("new", F.coalesce("jump", "new")).alias("comp"), "old")
        nxt = checkpointed(nxt)
        changed = not nxt.filter("comp <> old").isEmpty()
        lab = nxt.select(*key, "idx", "comp")
        if not changed:
            return lab


def components(nodes: DataFrame, edges: DataFrame, large: DataFrame | None = None) -> DataFrame:
    """(plan_id, idx, comp): comp = smallest node id of the component. Large plans take the iterative path."""
    nodes = nodes.select("plan_id", F.col("idx").cast("long").alias("idx"))
    edges = edges.select("plan_id", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"))
    if large is None:
        return _fold(nodes, edges)
    small = _fold(nodes.join(large, "plan_id", "left_anti"), edges.join(large, "plan_id", "left_anti"))
    big = _iterate(nodes.join(large, "plan_id", "left_semi"), edges.join(large, "plan_id", "left_semi"))
    return small.unionByName(big)


def both_ways(edges: DataFrame) -> DataFrame:
    """Symmetric, de-duplicated neighbour table (plan_id, idx, nb)."""
    return edges.select("plan_id", F.col("i").alias("idx"), F.col("j").alias("nb")).unionByName(
        edges.select("plan_id", F.col("j").alias("idx"), F.col("i").alias("nb"))).distinct()


def reachable(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, large: DataFrame | None = None) -> DataFrame:
    """Nodes in the component of the plan's seed node: (plan_id, idx)."""
    comp = components(nodes, edges, large)
    seed = comp.join(seeds.select("plan_id", F.col("seed").cast("long").alias("idx")), ["plan_id", "idx"], "left_semi")
    return comp.join(seed.select("plan_id", "comp").distinct(), ["plan_id", "comp"], "left_semi").select("plan_id", "idx")


def hash60(col):
    """First 60 bits of md5 as a long, reproducible in SQL."""
    return F.conv(F.substring(F.md5(col), 1, 15), 16, 10).cast("long")


def wl_labels(nodes: DataFrame, edges: DataFrame, rounds: int = 3) -> DataFrame:
    """Weisfeiler-Lehman node labels. A neighbourhood is the sum of its label hashes, so it needs no sorted list
    and a node of any degree combines map-side. Only equality of labels is meaningful."""
    nb = checkpointed(both_ways(edges))
    lab = nodes.select("plan_id", "idx", hash60(F.col("type")).alias("h"))
    for _ in range(rounds):
        s = nb.join(lab.select("plan_id", F.col("idx").alias("nb"), "h"), ["plan_id", "nb"]).groupBy(
            "plan_id", "idx").agg(F.sum(F.col("h").cast("decimal(20,0)")).cast("string").alias("s"))
        # Each round reads the labels twice, so they are written between rounds.
        lab = checkpointed(lab.join(s, ["plan_id", "idx"], "left").select(
            "plan_id", "idx", hash60(F.concat_ws("|", F.col("h").cast("string"),
                                                 F.coalesce("s", F.lit("0")))).alias("h")))
    return lab


def wl_hash(nodes: DataFrame, edges: DataFrame, rounds: int = 3) -> DataFrame:
    """One topology hash per plan from its node labels."""
    lab = wl_labels(nodes, edges, rounds)
    # two exact sums of 60-bit hashes, so that a thousand million topologies stay apart
    exact = lambda h: F.sum(h.cast("decimal(20,0)")).cast("string")
    second = hash60(F.concat(F.col("h").cast("string"), F.lit("#")))
    return lab.groupBy("plan_id").agg(exact(F.col("h")).alias("s"), exact(second).alias("s2"), F.count(F.lit(1)).alias("n")) \
        .select("plan_id", F.md5(F.concat_ws("|", F.col("n").cast("string"), "s", "s2")).alias("topology"))


def infer_round(comp: DataFrame, contact: DataFrame) -> DataFrame:
    """One linking round: each component's longest contact to another component (plan_id, i, j, len)."""
    c = contact.join(comp.select("plan_id", F.col("idx").alias("i"), F.col("comp").alias("ca")), ["plan_id", "i"]).join(
        comp.select("plan_id", F.col("idx").alias("j"), F.col("comp").alias("cb")), ["plan_id", "j"]).filter("ca <> cb")
    both = c.select("plan_id", F.explode(F.array("ca", "cb")).alias("comp"), "i", "j", "len")
    best = both.groupBy("plan_id", "comp").agg(F.min(F.struct((-F.col("len")).alias("neg"), "i", "j")).alias("m"))
    return best.select("plan_id", "m.i", "m.j", (-F.col("m.neg")).alias("len")).distinct()


def infer_edges(nodes: DataFrame, edges: DataFrame, contact: DataFrame, large: DataFrame | None = None) -> DataFrame:
    """Rounds of linking until no component has a contact left; components at least halve each round."""
    known = edges.select("plan_id", "i", "j").distinct()
    added = None
    while True:
        new = checkpointed(infer_round(components(nodes, known, large), contact))
        if new.isEmpty():
            return added if added is not None else new
        added = new if added is None else added.unionByName(new)
        known = known.unionByName(new.select("plan_id", "i", "j"))
