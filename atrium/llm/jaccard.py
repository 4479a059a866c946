"""N-gram Jaccard join: size-aware heavy-light join on sets of word shingles, reduced to components of linked documents.

Two documents link when the Jaccard similarity of their shingle sets is at least 3/4. Sets are 64-bit shingle hashes in
rising order. The steps:

1. ``shingle_sets``: size and fingerprint of every set; equal sets become one.
2. ``plausible``: of linked sets, enough of the first shingles in hash order are common. First shingles meet by hash; a set
   of which too few are seen in any other set has no link and goes, before its whole set is ever moved.
3. ``keyed``: small sets list all pairs of their first shingles (sets that link share two of them); large sets, and small
   ones that a large set can reach, go to inverted lists of single shingles. The boundary minimises the cost counted from
   the sizes and list lengths.
4. Each set joins the family of the set it shares most keys with. Families are cut into blocks of bounded size; small ones
   share blocks with those of the same most common key. Within a block all sets outside its first component are compared
   with all others.
5. ``probes``: a set that shares enough keys with another block, where some set is of another, larger component, is
   compared with that block. Smaller components do the probing, so a large group of linked copies is not paired with itself.

No pair of a candidate list is ever a row: rows are sets, keys and (set, block) probes. Overlaps are counted exactly.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import documents, saved

SHINGLE = 5
BUCKET_SHINGLES = 2_000_000   # shingles that meet in one task
SLICE_SHINGLES = 250_000      # first shingles that such a task compares at once
BLOCK_SHINGLES = 200_000      # shingles of one block of a family
BROADCAST_ROWS = 300_000      # tables of up to so many rows of at most 64 bytes may be broadcast; others are shuffled
SHARED = np.uint16(0xFFFF)


def least_overlap(n):
    """Shingles that any linked partner has in common with a set of n: ceil(3 n / 4)."""
    return (3 * n + 3) // 4


def linked(common, n, m):
    return 4 * common >= 3 * (n + m - common)


def shingles(data: np.ndarray, offsets: np.ndarray, hasher: hashing.SpanHash, size: int = SHINGLE):
    """Distinct shingle hashes of a block's rows, sorted by row and hash: (hashes, row of each, set sizes)."""
    rows = len(offsets) - 1
    data = hashing.lower_ascii(data)
    starts, ends, row = hashing.word_spans(data, offsets)
    words = hasher.words(data, starts, ends)
    grams = hashing.window_hash(words, size)
    at = np.flatnonzero(row[:len(grams)] == row[size - 1:size - 1 + len(grams)])
    hashes, owner = [grams[at]], [row[at]]
    count = np.bincount(row, minlength=rows)
    first = np.cumsum(count) - count
    for k in range(1, size):
        short = np.flatnonzero(count == k)
        h = words[first[short]]
        for j in range(1, k):
            h = hashing.combine(h, words[first[short] + j])
        hashes.append(hashing.mix(h + np.uint64(k)))
        owner.append(short)
    h, r = np.concatenate(hashes), np.concatenate(owner).astype(np.uint16 if rows < 65536 else np.int64)
    order = np.argsort(h)
    order = order[np.argsort(r[order], kind="stable")]
    h, r = h[order], r[order].astype(np.int64)
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    h, r = h[new], r[new]
    return h, r, np.bincount(r, minlength=rows)


def fingerprints(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Order-free 64-bit fingerprint of every set (0 for empty ones)."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        out[full] = hashing.mix(np.add.reduceat(hashing.mix(h + np.uint64(0x5851F42D4C957F2D)), (np.cumsum(sizes) - sizes)[full]) + sizes[full].astype(np.uint64))
    return out


def _texts(df: DataFrame, *more) -> DataFrame:
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def shingle_sets(df: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles and set_id (fingerprint; null without words) of every row."""
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = hashing.SpanHash()
        for b in batches:
            for i, data, offsets in hashing.blocks(b.column(1)):
                h, _, n = shingles(data, offsets, hasher, size)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(n)), pa.array(n.astype(np.int64)),
                                                  pa.array(fingerprints(h, n).view(np.int64), mask=n == 0)], names=["doc_id", "n_shingles", "set_id"])

    return _texts(df).mapInArrow(measure, "doc_id long, n_shingles long, set_id long")


def _met(tokens: np.ndarray, owners: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """A set id per token that the set shares with any other; owner -1: sets of some other block, already counted there."""
    order = np.argsort(tokens)
    tokens, owners = tokens[order], owners[order]
    same = np.zeros(len(tokens) + 1, bool)
    same[1:-1] = tokens[1:] == tokens[:-1]
    many = same[1:] | same[:-1]
    tokens, owners = tokens[many], owners[many]
    group = np.cumsum(np.r_[True, tokens[1:] != tokens[:-1]]) - 1 if len(tokens) else np.zeros(0, np.int64)
    lone = owners < 0
    groups = int(group[-1]) + 1 if len(group) else 0
    open_to_all = np.bincount(group[lone], minlength=groups) > 0
    who = np.where(lone, 0, ids[owners])
    low, high = np.full(groups, np.iinfo(np.int64).max), np.full(groups, np.iinfo(np.int64).min)
    np.minimum.at(low, group[~lone], who[~lone])
    np.maximum.at(high, group[~lone], who[~lone])
    hit = ~lone & (open_to_all | (low < high))[group]
    group, who = group[hit], who[hit]
    order = np.lexsort((who, group))
    group, who = group[order], who[order]
    return who[np.r_[True, (group[1:] != group[:-1]) | (who[1:] != who[:-1])][:len(who)]]


def plausible(df: DataFrame, buckets: int, size: int = SHINGLE) -> DataFrame:
    """Common first shingles (set_id, hits) of sets: an upper bound of those that it shares with any one set.

    Of the first 2 floor(n/4) + 1 shingles in hash order, a linked partner has floor(ceil(3 n / 4) / 4) + 1 among its own
    first ones. Shingles that two sets of one input block share are counted there and sent on once without owners."""
    sums = max(1, buckets // 4)  # tasks that add up what the buckets found

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = hashing.SpanHash()
        for b in batches:
            for _, data, offsets in hashing.blocks(b.column(0)):
                h, row, n = shingles(data, offsets, hasher, size)
                ids = fingerprints(h, n)
                _, one = np.unique(ids, return_index=True)
                chosen = np.zeros(len(n), bool)
                chosen[one] = True
                place = np.arange(len(h)) - (np.cumsum(n) - n)[row]
                take = chosen[row] & (place < 2 * (n // 4)[row] + 1)
                h, row = h[take], row[take]
                order = np.argsort(h)
                h, row = h[order], row[order].astype(np.uint16)
                same = np.zeros(len(h) + 1, bool)
                same[1:-1] = h[1:] == h[:-1]
                shared = same[1:] | same[:-1]
                send_on = ~same[:-1]
                bucket = (h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
                cuts = np.searchsorted(bucket, np.arange(buckets + 1))
                used = np.flatnonzero(np.diff(cuts))
                rows: list[list] = [[], [], [], [], []]
                for k in used.tolist():
                    part = slice(cuts[k], cuts[k + 1])
                    go, r, s = send_on[part], row[part], shared[part]
                    own, back = np.unique(r, return_inverse=True)
                    refs = np.where(s, SHARED, back.astype(np.uint16))[go]
                    hits = np.bincount(back[s], minlength=len(own)).astype(np.uint32)
                    for c, v in zip(rows, (k, ids[own].tobytes(), hits.tobytes(), h[part][go].tobytes(), refs.tobytes())):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), *[pa.array(c, pa.binary()) for c in rows[1:]]],
                                                 names=["bucket", "ids", "hits", "tokens", "refs"])

    def meet(table: pa.Table) -> pa.Table:
        # views of the batch; the tokens of a piece are in order, so a slice of the bucket's hashes is a stretch of each piece
        ids, hits, tokens, refs = [[np.frombuffer(v.as_buffer(), kind) for v in table.column(c)] for c, kind in
                                   (("ids", np.uint64), ("hits", np.uint32), ("tokens", np.uint64), ("refs", np.uint16))]
        base = np.cumsum([0, *map(len, ids)]).tolist()
        ids, hits = np.concatenate(ids).view(np.int64), np.concatenate(hits)
        k, slices = table.column("bucket")[0].as_py(), max(1, -(-sum(map(len, tokens)) // SLICE_SHINGLES))
        low, high = -(-(k << 32) // buckets), -(-(k + 1 << 32) // buckets)
        edges = np.array([low + (high - low) * j // slices << 32 for j in range(1, slices)], np.uint64)
        cuts = [[0, *np.searchsorted(t, edges).tolist(), len(t)] for t in tokens]
        found, count = [ids], [hits]
        for j in range(slices):
            token = np.concatenate([t[c[j]:c[j + 1]] for t, c in zip(tokens, cuts)])
            owner = np.concatenate([np.where((part := r[c[j]:c[j + 1]]) == SHARED, -1, part.astype(np.int64) + b) for r, c, b in zip(refs, cuts, base)])
            who, n = np.unique(_met(token, owner, ids), return_counts=True)
            found.append(who)
            count.append(n)
        key, back = np.unique(np.concatenate(found), return_inverse=True)
        total = np.bincount(back, np.concatenate(count)).astype(np.int64)
        key, total = key[total > 0].view(np.uint64), total[total > 0]
        key, total = key[order := np.argsort(key)], total[order]
        part = (key >> np.uint64(32)) * np.uint64(sums) >> np.uint64(32)
        cuts = np.searchsorted(part, np.arange(sums + 1))
        used = np.flatnonzero(np.diff(cuts)).tolist()
        return pa.table({"part": pa.array(used, pa.int64()), "ids": pa.array([key[cuts[k]:cuts[k + 1]].tobytes() for k in used], pa.binary()),
                         "hits": pa.array([total[cuts[k]:cuts[k + 1]].tobytes() for k in used], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        ids, hits = (np.concatenate([np.frombuffer(v, np.int64) for v in table.column(c).to_pylist()]) for c in ("ids", "hits"))
        key, back = np.unique(ids, return_inverse=True)
        return pa.table({"set_id": key, "hits": np.bincount(back, hits).astype(np.int64)})

    sent = df.select(F.col("text").cast("string").alias("text")).mapInArrow(send, "bucket long, ids binary, hits binary, tokens binary, refs binary")
    met = sent.groupBy("bucket").applyInArrow(meet, "part long, ids binary, hits binary")
    return met.groupBy("part").applyInArrow(add, "set_id long, hits long")


def _near(big: DataFrame, narrow: DataFrame, rows: int, on: list[str], how: str = "inner") -> DataFrame:
    """Join with a narrow table: broadcast behind a check of its row count, shuffled beyond."""
    return big.join(F.broadcast(narrow) if rows <= BROADCAST_ROWS else narrow, on, how)


def whole_sets(df: DataFrame, alive: DataFrame, rows: int, size: int = SHINGLE) -> DataFrame:
    """set_id, n and all shingles (packed) of the representatives named by alive (doc_id, set_id, ...)."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = hashing.SpanHash()
        for b in batches:
            for i, data, offsets in hashing.blocks(b.column(0)):
                h, _, n = shingles(data, offsets, hasher, size)
                ids, ends = fingerprints(h, n).view(np.int64), np.cumsum(n)
                want = b.column(1).slice(i, len(n)).to_numpy(zero_copy_only=False)
                rows = np.flatnonzero(ids == want)
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(n[rows].astype(np.int64)), b.column(2).slice(i, len(n)).take(pa.array(rows)),
                                                  pa.array([h[ends[k] - n[k]:ends[k]].tobytes() for k in rows], pa.binary())], names=["set_id", "n", "q", "tokens"])

    chosen = _near(_texts(df), alive.select("doc_id", "set_id", "q"), rows, ["doc_id"]).select("text", "set_id", "q")
    return chosen.mapInArrow(pack, "set_id long, n long, q long, tokens binary")


def first_count(n):
    """Length of the list prefix, and how many keys linked sets then share at least: l = floor(n / 16) + 1."""
    return n // 4 + n // 16 + 1


def least_keys(n):
    return least_overlap(n) // 16 + 1


def list_keys(cores: DataFrame, boundary: int | None) -> DataFrame:
    """Keys of sets (key, set_id, light): single first shingles of sets above, or within reach of sets above, the boundary;
    pairs of first shingles of sets up to it. Without a boundary, all single first shingles."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, owners, light = [], [], []
            for sid, n, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                h = np.frombuffer(raw, np.uint64)
                if boundary is None or 4 * n >= 3 * (boundary + 1):
                    k = h[:first_count(n)]
                    keys.append(k)
                    light.append(np.zeros(len(k), bool))
                    owners.append(np.full(len(k), sid))
                if boundary is not None and n <= boundary:
                    k = h[:n // 4 + 2]
                    x, y = np.triu_indices(len(k), 1)
                    keys.append(hashing.combine(k[x], k[y]))
                    light.append(np.ones(len(x), bool))
                    owners.append(np.full(len(x), sid))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owners).astype(np.int64)),
                                                  pa.array(np.concatenate(light))], names=["key", "set_id", "light"])

    return cores.select("set_id", "n", "tokens").mapInArrow(emit, "key long, set_id long, light boolean")


def cost_boundary(cores: DataFrame) -> int:
    """Set size up to which listing pairs is cheaper than scanning lists, in rows that either way makes.

    A set of n lists C(floor(n/4) + 2, 2) pairs; scanning, it makes a row per first shingle and one per block of each list.
    Sums by power-of-two size class (at most 64 rows) decide; small sets within reach of large ones do both."""
    single = list_keys(cores, None)
    lists = single.groupBy("key").agg(F.count(F.lit(1)).alias("long"))
    scan = single.join(lists, "key").groupBy("set_id").agg(F.sum(1 + F.col("long") / 256).alias("scan"))
    p = F.floor(F.col("n") / 4) + 2
    sized = cores.select("set_id", "n").join(scan, "set_id").select(F.ceil(F.log2("n")).cast("int").alias("class"), (p * (p - 1) / 2).alias("pairs"), "scan")
    rows = sized.groupBy("class").agg(F.sum("pairs").alias("pairs"), F.sum("scan").alias("scan")).collect()
    by_class = {r["class"]: (r["pairs"], r["scan"]) for r in rows}
    cost = {-1: sum(s for _, s in by_class.values())}
    for c in by_class:
        cost[c] = sum(p + (s if k == c else 0) if k <= c else s for k, (p, s) in by_class.items())
    best = min(cost, key=lambda c: (cost[c], c))
    return 2 ** best if best >= 0 else 0


class Index:
    """Inverted lists of the sets of one block."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, self.owner = tokens[order], owner[order]
        new = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
        self.tokens, self.starts = tokens[new], np.append(new, len(tokens))

    def links(self, tokens: np.ndarray) -> np.ndarray:
        """Sets of the block that link with a set, from the lists of all its shingles."""
        at = np.searchsorted(self.tokens, tokens)
        at = at[self.tokens[np.minimum(at, len(self.tokens) - 1)] == tokens]
        a, size = self.starts[at], self.starts[at + 1] - self.starts[at]
        where = np.repeat(a - np.cumsum(size) + size, size) + np.arange(size.sum())
        common = np.bincount(self.owner[where], minlength=len(self.sizes))
        return np.flatnonzero((common > 0) & linked(common, len(tokens), self.sizes))


def block_components(sets: list[np.ndarray]) -> np.ndarray:
    """Component (least member) of every set of a block. Sets outside the first set's component are compared with all."""
    parent = np.arange(len(sets))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    index = Index(sets)
    for k, s in enumerate(sets):
        if k and root(k) == root(0):
            continue
        for j in index.links(s).tolist():
            a, b = root(k), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return np.array([root(k) for k in range(len(sets))])


def components(edges: DataFrame) -> DataFrame:
    """Least reachable label (node, root) of every node of edges (a, b), by alternating large and small stars."""
    edges = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(small_least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(small_least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
        edges = saved(small, "edges")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def near_duplicates(df: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Sets and components of (doc_id, text): one row per input row with doc_id, n_shingles, component_id.

    ``component_id`` is the smallest doc_id reachable over links. Documents without words or text have an empty set and no
    links; rows without doc_id link with nothing and have a null component; repeated rows and equal texts link. Texts of any
    length are taken whole. Shingles and sets are compared by 64-bit hashes."""
    spark = df.sparkSession
    sets = saved(shingle_sets(df, size), "shingle-sets")
    named = sets.filter(F.col("set_id").isNotNull() & F.col("doc_id").isNotNull())
    distinct = saved(named.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n")), "distinct-sets")
    total = distinct.agg(F.sum("n")).first()[0] or 0
    hits = plausible(df.filter(F.col("doc_id").isNotNull()), max(1, -(-(total // 2) // BUCKET_SHINGLES)), size)
    least = F.floor(F.floor((3 * F.col("n") + 3) / 4) / 4) + 1
    alive = saved(distinct.join(hits, "set_id").filter(F.col("hits") >= least)
                  .select("set_id", "doc_id", "n", F.floor(1000 * F.col("hits") / F.col("n")).cast("long").alias("q")), "plausible-sets")
    known = alive.count()
    cores = saved(whole_sets(df, alive, known, size), "whole-sets")

    keys = list_keys(cores, cost_boundary(cores))
    keys = saved(_near(keys, alive.select("set_id", "n", "q"), known, ["set_id"]), "set-keys")
    lists = keys.groupBy("key").agg(F.max(F.struct("q", "set_id"))["set_id"].alias("hub"), F.count(F.lit(1)).alias("long")).filter("long > 1")
    shared = keys.join(lists, "key").groupBy("set_id", "n", "q", "hub").agg(F.count(F.lit(1)).alias("c"), F.max(F.struct("long", "key")).alias("top"))
    family = shared.groupBy("set_id", "n", "q").agg(F.max(F.struct("c", "hub"))["hub"].alias("family"), F.max("top")["key"].alias("anchor"))
    family = saved(family, "families")
    # families of some size are cut into blocks of their own; small ones share blocks with those of the same most common key
    sized = family.groupBy("family").agg(F.sum("n").alias("total")).join(family.select(F.col("set_id").alias("family"), "anchor"), "family")
    sized = saved(sized, "family-sizes")
    large, small = sized.filter(2 * F.col("total") > BLOCK_SHINGLES), sized.filter(2 * F.col("total") <= BLOCK_SHINGLES)
    shelves = small.groupBy("anchor").agg(F.ceil(F.sum("total") / BLOCK_SHINGLES).alias("shelves"))
    shelf = F.xxhash64("anchor", F.pmod(F.xxhash64("family"), "shelves"), F.lit(1)).alias("shelf")
    spread = large.select("family", F.ceil(F.col("total") / BLOCK_SHINGLES).alias("chunks"), F.lit(None).cast("long").alias("shelf")).union(
        small.join(shelves, "anchor").select("family", F.lit(1).cast("long"), shelf))
    block = F.coalesce("shelf", F.xxhash64("family", "chunk")).alias("block")
    home = saved(family.join(spread, "family").withColumn("chunk", F.pmod(F.xxhash64("set_id"), "chunks")).select("set_id", "n", "q", block), "placed-sets")
    # every block of a family also gets the family's hub, so that what links with it has one label in all of them
    guests = (spread.filter(F.col("shelf").isNull()).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).select(F.col("family").alias("set_id"), block)
              .join(home.select("set_id", "block"), ["set_id", "block"], "left_anti"))
    placed = home.select("set_id", "block", F.lit(False).alias("guest")).union(guests.select("set_id", "block", F.lit(True)))
    placed = placed.join(family.select("set_id", "n", "q"), "set_id")
    placed = saved(placed, "block-members")
    many = placed.agg(F.count(F.lit(1)), F.sum("n")).first()
    tasks = max(1, -(-(many[1] or 0) // BUCKET_SHINGLES), min(many[0], 2 * spark.sparkContext.defaultParallelism))
    task = F.pmod(F.xxhash64("block"), F.lit(tasks))
    blocks = _near(cores.select("set_id", "tokens"), placed, many[0], ["set_id"]).withColumn("task", task)

    def inside(table: pa.Table) -> pa.Table:
        table = table.sort_by([("block", "ascending"), ("guest", "descending"), ("q", "descending"), ("set_id", "descending")]).combine_chunks()
        ids, root, block = table.column("set_id").to_numpy(), [], table.column("block").to_numpy()
        edge = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
        for a, z in zip(edge, edge[1:]):
            root.append(ids[a + block_components([np.frombuffer(t, np.uint64) for t in table.column("tokens").slice(a, z - a).to_pylist()])])
        return table.select(["set_id", "n", "block", "guest"]).append_column("part", pa.array(np.concatenate(root)))

    parts = saved(blocks.groupBy("task").applyInArrow(inside, "set_id long, n long, block long, guest boolean, part long").distinct(), "block-components")
    own = parts.filter("NOT guest")
    counted = own.join(own.groupBy("part").agg(F.count(F.lit(1)).alias("members")), "part")
    rank = saved(counted.select("set_id", "n", "block", "part", F.struct("members", "part").alias("rank")), "ranked-sets")
    hosts = parts.filter("guest").select("set_id", F.col("part").alias("b")).join(rank.select("set_id", F.col("part").alias("a")), "set_id").select("a", "b")

    asked = saved(probes(keys, rank, many[0]), "probes")
    wanted = asked.select("block").distinct()
    target = _near(cores.select("set_id", "tokens"), rank.select("set_id", "block", "part").join(wanted, "block", "left_semi"), many[0], ["set_id"])
    prober = cores.select("set_id", "tokens").join(asked, "set_id")
    # the probes of one block are cut into slices, each of which gets a copy of the block
    slices = asked.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / 2000).cast("int").alias("slices"))
    target = target.join(slices, "block").select(
        F.col("block").alias("h_block"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("h_slice"), F.col("part").alias("h_part"), F.col("tokens").alias("h_tokens"))
    prober = prober.join(slices, "block").select("block", F.pmod(F.xxhash64("set_id"), "slices").cast("int").alias("slice"), "part", "tokens")

    def across(asking: pa.Table, held: pa.Table) -> pa.Table:
        held = held.sort_by([("h_block", "ascending"), ("h_slice", "ascending")]).combine_chunks()
        out: list[tuple[int, int]] = []
        queries: dict = {}
        for k, (b, s) in enumerate(zip(asking.column("block").to_pylist(), asking.column("slice").to_pylist())):
            queries.setdefault((b, s), []).append(k)
        hb, hs, part = held.column("h_block").to_numpy(), held.column("h_slice").to_numpy(), held.column("h_part").to_numpy()
        edge = np.flatnonzero(np.r_[True, (hb[1:] != hb[:-1]) | (hs[1:] != hs[:-1]), True]) if len(hb) else np.zeros(1, np.int64)
        for a, z in zip(edge, edge[1:]):
            index = Index([np.frombuffer(t, np.uint64) for t in held.column("h_tokens").slice(a, z - a).to_pylist()])
            for k in queries.get((hb[a], hs[a]), []):
                mine = asking.column("part")[k].as_py()
                found = index.links(np.frombuffer(asking.column("tokens")[k].as_py(), np.uint64))
                out += [(mine, p) for p in np.unique(part[a + found]).tolist() if p != mine]
        pairs = np.array(sorted(set(out)), np.int64).reshape(-1, 2)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    asking = prober.withColumn("spot", F.pmod(F.xxhash64("block", "slice"), F.lit(tasks))).groupBy("spot")
    held = target.withColumn("h_spot", F.pmod(F.xxhash64("h_block", "h_slice"), F.lit(tasks))).groupBy("h_spot")
    joins = asking.cogroup(held).applyInArrow(across, "a long, b long")
    merged = components(joins.union(hosts))
    final = rank.join(merged, F.col("part") == F.col("node"), "left").select("set_id", F.coalesce("root", "part").alias("root"))
    named_root = final.join(distinct.select("set_id", "doc_id"), "set_id")
    label = named_root.join(named_root.groupBy("root").agg(F.min("doc_id").alias("first_id")), "root").select("set_id", "first_id")
    by_set = distinct.join(label, "set_id", "left").select("set_id", F.coalesce("first_id", "doc_id").alias("component"))
    out = sets.join(by_set, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"))


def probes(keys: DataFrame, rank: DataFrame, rows: int) -> DataFrame:
    """Blocks of other sets that a set has to be compared with: distinct (set_id, part, block).

    Keys that stand in the same blocks are taken together, so that a set asks per group of keys and not per key. A block is
    asked where it holds, for these keys, a set of a component above the asking set's (larger, ties by label), of a size
    that can link, and where single keys shared with the block are as many as links need; pair keys count in full."""
    at = _near(keys.select("key", "set_id", "light"), rank, rows, ["set_id"])
    spots = at.groupBy("key", "block").agg(F.max("rank").alias("top"), F.min("n").alias("low"), F.max("n").alias("high"), F.first("light").alias("light"))
    groups = spots.groupBy("key").agg(F.count(F.lit(1)).alias("blocks"), F.bit_xor(F.xxhash64("block")).alias("group"), F.max("top").alias("peak"))
    groups = saved(groups.filter("blocks > 1"), "key-groups")
    where = spots.join(groups, "key").groupBy("group", "block").agg(F.max("top").alias("top"), F.min("low").alias("low"), F.max("high").alias("high"))
    mine = (at.join(groups, "key").filter(F.col("peak") > F.col("rank")).groupBy("set_id", "n", "part", "rank", F.col("block").alias("home"), "group")
            .agg(F.sum(F.when(F.col("light"), F.lit(1 << 20)).otherwise(1)).alias("c")))
    met = mine.join(where, "group").filter((F.col("block") != F.col("home")) & (F.col("top") > F.col("rank")) & (4 * F.col("high") >= 3 * F.col("n")) & (4 * F.col("n") >= 3 * F.col("low")))
    need = F.floor(F.floor((3 * F.col("n") + 3) / 4) / 16) + 1
    return met.groupBy("set_id", "n", "part", "block").agg(F.sum("c").alias("c")).filter(F.col("c") >= need).select("set_id", "part", "block")


def first_of_groups(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with its smallest id, with all columns; documents without id stay."""
    found = near_duplicates(docs).filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def op8_heavy_light(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir))


SQL = """
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
j AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT j.a, j.b FROM j JOIN n x ON x.doc_id = j.a JOIN n y ON y.doc_id = j.b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce((SELECT min(b) FROM r WHERE r.a = d.doc_id), d.doc_id)) AS component_id FROM d LEFT JOIN n ON d.doc_id = n.doc_id
"""
