"""Packing as a cutting-stock problem: sequences are stock, patterns of length classes are cut from it.

Lengths fall into classes (single lengths up to 64, then 32 to the octave). The linear program over the histogram of
classes takes as few padded tokens as it can: a pattern costs the sequence length, or its own length where that is a power of two,
since such a sequence needs no padding. Columns are generated: a knapsack by dynamic programming over the token count finds the
patterns of the best dual value, until the cost is close to its lower bound. Pattern numbers are rounded down; documents,
ranked within their class, take the places in order. What rounding leaves is cut freely: its tokens fill the gaps that classes
leave in the patterns, exactly, and the rest becomes whole sequences and a tail of powers of two. Nothing is left to pad.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, placed_rows, running, saved
from .packing import SEQUENCE, Tokens

END_ID = 1
FINE = 64  # lengths up to this are classes of their own
PER_OCTAVE = 32
GAP = 0.003  # the linear program ends this close to its lower bound
SMOOTH = 0.9
NEAR = 40
MOST_TURNS = 400


def class_bounds(length: int) -> np.ndarray:
    """Largest length of every class up to ``length``."""
    bounds = list(range(1, min(FINE, length) + 1))
    while bounds[-1] < length:
        step = max(1, (1 << (bounds[-1].bit_length() - 1)) // PER_OCTAVE)
        bounds.append(min(length, bounds[-1] + step))
    return np.array(bounds)


def knapsack(values: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest value of items (any number of each) that fill exactly 0, 1, ... tokens, and the last item taken (-1: none).

    Items come one by one, long ones first; for one item, every chain of lengths a size apart is a running maximum."""
    best, last = np.full(length + 1, -np.inf), np.full(length + 1, -1)
    best[0] = 0
    for k in np.argsort(-sizes, kind="stable").tolist():
        value, size = values[k], int(sizes[k])
        rows = -(-(length + 1) // size)
        grid = np.full(rows * size, -np.inf)
        grid[:length + 1] = best
        grid = grid.reshape(rows, size)
        steps = (np.arange(rows) * value)[:, None]
        with_item = (np.maximum.accumulate(grid - steps, axis=0) + steps).ravel()[:length + 1]
        better = with_item > best + 1e-9
        best[better], last[better] = with_item[better], k
    return best, last


def taken_items(last: np.ndarray, sizes: np.ndarray, at: int) -> np.ndarray:
    """Items of each class in the best filling of ``at`` tokens."""
    items = np.zeros(len(sizes), np.int64)
    while at:
        items[last[at]] += 1
        at -= sizes[last[at]]
    return items


def best_patterns(duals: np.ndarray, sizes: np.ndarray, length: int) -> tuple[float, list[tuple[np.ndarray, int]]]:
    """Largest dual value per token of cost over all patterns, and patterns (items, cost) by falling value above their cost:
    the best ones of the last ``NEAR`` fillings of a sequence and of every power of two."""
    best, last = knapsack(duals, sizes, length)
    ends = [(at, length) for at in range(max(1, length - NEAR + 1), length + 1)] + [(1 << k, 1 << k) for k in range(length.bit_length() - 1)]
    offers = sorted(((best[at] - cost, at, cost) for at, cost in ends if np.isfinite(best[at])), reverse=True)
    top = max(float(best.max()) / length, *(best[at] / cost for at, cost in ends))
    return top, [(taken_items(last, sizes, at), cost) for _, at, cost in offers]


def first_patterns(demand: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """A first basis: fractional first fit from the longest class down. Pattern k holds as many of class k as fit and what is
    left of shorter classes, so the basis is triangular and its amounts are not negative."""
    m = len(sizes)
    single = (sizes & (sizes - 1)) == 0  # a single item of a power of two needs no padding
    cost = np.where(single, sizes, length).astype(float)
    columns, left = np.zeros((m, m)), demand.astype(float).copy()
    for k in range(m - 1, -1, -1):
        columns[k, k] = cost[k] // sizes[k]
        amount, room = left[k] / columns[k, k], int(cost[k] - columns[k, k] * sizes[k])
        for j in range(k - 1, -1, -1):
            if amount <= 0 or not room:
                break
            n = int(min(room // sizes[j], left[j] / amount + 1e-9))
            if n > 0:
                columns[k, j], left[j], room = n, max(0.0, left[j] - n * amount), room - n * int(sizes[j])
    return columns, cost


def column_generation(demand: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Patterns, their costs and how often the linear program takes each, for a demand per class (all above zero).

    A revised simplex method: dual values price the classes, the knapsack brings entering columns. Prices are smoothed towards one
    per token, which favours full patterns; the smoothing fades where it finds no column. It ends when the cost is within ``GAP`` of a lower
    bound (the tokens, or the cost divided by the best dual value per token) or after ``MOST_TURNS``: only the padding before
    gaps are filled depends on how far it came."""
    columns, cost = first_patterns(demand, sizes, length)
    inverse = np.linalg.inv(columns.T)
    amount = np.maximum(inverse @ demand, 0)
    tokens, smooth, pivots = float(demand @ sizes), SMOOTH, 0
    for _ in range(MOST_TURNS):
        value, offers = best_patterns(smooth * sizes + (1 - smooth) * (cost @ inverse), sizes, length)
        total = float(cost @ amount)
        if total <= (1 + GAP) * max(tokens, 0 if smooth else total / max(value, 1)):
            break
        before = pivots
        for items, price in offers:
            if (cost @ inverse) @ items - price <= 1e-6 * price:
                continue
            step = inverse @ items
            ratio = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1), np.inf)
            out = int(np.argmin(ratio))
            if not np.isfinite(ratio[out]):
                continue
            columns[out], cost[out] = items, price
            row = inverse[out] / step[out]
            inverse -= np.outer(step, row)
            inverse[out] = row
            pivots += 1
            if pivots % 200 == 0:
                inverse = np.linalg.inv(columns.T)
            amount = np.maximum(inverse @ demand, 0)
        if pivots == before:
            if not smooth:
                break
            smooth = smooth / 2 if smooth > 0.05 else 0.0
    return columns.astype(np.int64), cost.astype(np.int64), amount


@dataclass
class Plan:
    """Places per class: documents of class ``k`` with ranks from ``start`` on, ``per`` to a sequence, in sequences from ``base`` on."""
    classes: np.ndarray
    start: np.ndarray
    count: np.ndarray
    per: np.ndarray
    base: np.ndarray
    target: np.ndarray
    taken: np.ndarray  # documents of every class that have a place
    sequences: int


def rounded_plan(demand: np.ndarray, bounds: np.ndarray, length: int) -> Plan:
    """Whole numbers of patterns. They shrink by steps until what is left surely fills all gaps, even if every document has the
    least length of its class; with no pattern at all there is no gap, so this ends."""
    used = np.flatnonzero(demand)
    least = np.r_[0, bounds[:-1]] + 1
    empty = np.zeros(0, np.int64)
    table, cost, amount = column_generation(demand[used], bounds[used], length) if len(used) else (empty.reshape(0, 0), empty, empty)
    for shrink in np.arange(0, 1.0001, 0.01):
        times = np.floor(amount * (1 - shrink) + 1e-7).astype(np.int64)
        taken = times @ table
        while (taken > demand[used]).any():  # rounding errors of the program
            k = int(np.argmax(taken > demand[used]))
            times[np.argmax((table[:, k] > 0) & (times > 0))] -= 1
            taken = times @ table
        gaps = int(times @ (cost - table @ least[used]))
        if int((demand[used] - taken) @ least[used]) >= gaps:
            break
    rows, base, filled = [], 0, np.zeros(len(used), np.int64)
    for p in np.flatnonzero(times):
        for k in np.flatnonzero(table[p]):
            rows.append((used[k], filled[k], table[p, k] * times[p], table[p, k], base, cost[p]))
            filled[k] += table[p, k] * times[p]
        base += int(times[p])
    whole = np.zeros(len(demand), np.int64)
    whole[used] = filled
    parts = np.array(sorted(rows), np.int64).reshape(len(rows), 6).T
    return Plan(*parts, whole, base)


def token_rows(df: DataFrame, length: int = SEQUENCE) -> DataFrame:
    """Token ids of (doc_id, text) ended by id 1: full pieces of ``length`` (class ``cut``, rank irrelevant) and one last piece per
    document, with its ids as 16-bit numbers (null where they do not fit; then as 32-bit ones in ``wide``)."""
    bounds = class_bounds(length)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Tokens()
        end = np.array([END_ID], dtype="<u4").tobytes()
        for b in batches:
            rows = []
            for doc, text, file, at in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist()):
                raw = coder.encode(text.as_py() or "") + end
                n = len(raw) // 4
                whole = n - n % length
                for a in range(0, whole, length):
                    rows.append((doc, file, at, a, length, zlib.crc32(raw[4 * a:4 * (a + length)]), n, len(bounds), None, None))
                if n > whole:
                    rest = raw[4 * whole:]
                    ids = np.frombuffer(rest, "<u4")
                    narrow = int(ids.max()) < 1 << 16
                    rows.append((doc, file, at, whole, n - whole, zlib.crc32(rest), n, int(np.searchsorted(bounds, n - whole)),
                                 ids.astype("<u2").tobytes() if narrow else None, None if narrow else rest))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    types = [pa.int64()] * 8 + [pa.binary()] * 2
    names = ["doc_id", "row_file", "row_at", "start", "length", "ids_crc32", "doc_tokens", "class", "ids", "wide"]
    schema = ", ".join(f"{n} {'binary' if t == pa.binary() else 'long'}" for n, t in zip(names, types))
    rows = placed_rows(df, ["doc_id", "text"], "placed")
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "row_file", "row_at").mapInArrow(cut, schema)


def _take_places(ranked: DataFrame, plan: Plan, full: int, length: int) -> DataFrame:
    """Sequence, order within it and target length of every ranked row; rows without a place have a null sequence."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = plan.classes * (1 << 40) + plan.start
        for b in batches:
            kind, pos = b.column("class").to_numpy(), b.column("pos").to_numpy()
            whole = kind == full
            sequence, slot, target = plan.sequences + pos, np.zeros(len(pos), np.int64), np.full(len(pos), length)
            got = whole.copy()
            part = np.flatnonzero(~whole & (pos < plan.taken[np.minimum(kind, len(plan.taken) - 1)]))
            if len(part):
                j = np.searchsorted(key, kind[part] * (1 << 40) + pos[part], side="right") - 1
                at = pos[part] - plan.start[j]
                sequence[part], slot[part], target[part] = plan.base[j] + at // plan.per[j], kind[part] * length + at % plan.per[j], plan.target[j]
                got[part] = True
            values = [pa.array(v, pa.int64(), mask=~got) for v in (sequence, slot, target)]
            yield pa.RecordBatch.from_arrays([*b.columns, *values], names=[*b.schema.names, "sequence_id", "slot", "target"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema) + ", sequence_id long, slot long, target long"
    return ranked.mapInArrow(place, schema)


def _free_room(spark: SparkSession, start: int, rest: int, first: int, length: int) -> DataFrame:
    """Room for the loose tokens behind the gaps: whole sequences, then one of each power of two in what is left."""
    whole = rest // length
    tail, at, rows = rest % length, start + whole * length, []
    for k in reversed(range(length.bit_length())):
        if tail >> k & 1:
            rows.append((first + whole + len(rows), at, 1 << k, 0))
            at += 1 << k
    out = spark.range(whole).select((F.col("id") + first).alias("sequence_id"), (F.col("id") * length + start).alias("before"),
                                    F.lit(length).cast("long").alias("room"), F.lit(0).cast("long").alias("used"))
    return out.unionByName(spark.createDataFrame(rows, "sequence_id long, before long, room long, used long"))


def _cuts(loose: DataFrame, room: DataFrame, length: int) -> DataFrame:
    """Where loose documents and free room, both laid end to end, overlap. No stretch is longer than a sequence, so each lies in
    at most two buckets of that length; an overlap counts in the bucket where it starts."""
    def bucketed(df: DataFrame, size: str) -> DataFrame:
        first, last = F.floor(F.col("before") / length), F.floor((F.col("before") + F.col(size) - 1) / length)
        return df.withColumn("bucket", F.explode(F.sequence(first, last)))

    a = bucketed(loose, "length").withColumnRenamed("before", "a_at")
    b = bucketed(room, "room").withColumnRenamed("before", "b_at")
    begin, end = F.greatest("a_at", "b_at"), F.least(F.col("a_at") + F.col("length"), F.col("b_at") + F.col("room"))
    both = a.join(b, "bucket").filter((begin < end) & (F.floor(begin / length) == F.col("bucket")))
    return both.select("row_file", "row_at", (begin - F.col("a_at")).alias("skip"), (end - begin).alias("size"), "sequence_id",
                       (F.col("used") + begin - F.col("b_at")).alias("offset"))


def _cut_pieces(rows: DataFrame) -> DataFrame:
    """Pieces of loose documents with the checksums of their ids, from rows with ``cuts`` (skip, size, sequence_id, offset)."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                raw = r["wide"] if r["ids"] is None else np.frombuffer(r["ids"], "<u2").astype("<u4").tobytes()
                for c in r["cuts"]:
                    part = raw[4 * c["skip"]:4 * (c["skip"] + c["size"])]
                    out.append((r["doc_id"], r["start"] + c["skip"], c["size"], zlib.crc32(part), r["doc_tokens"], c["sequence_id"], c["offset"]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)

    return rows.mapInArrow(cut, ", ".join(f"{n} long" for n in names))


def cut_and_packed(df: DataFrame, length: int = SEQUENCE) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of (doc_id, text), one row per piece.

    Every id of a document and its end id 1 lie in one piece; offsets are gapless from 0; every sequence has ``length`` (a power of
    two) tokens or a smaller power of two, so none is padded. Null text is empty and gives one piece with the end id. Repeated rows are documents
    of their own. An empty table gives no rows. Other columns are ignored. Only the histogram (at most some 230 classes), the plan
    (as many patterns) and two sums are held by the driver."""
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    spark = df.sparkSession
    bounds, full = class_bounds(length), len(class_bounds(length))
    pieces = saved(token_rows(df, length), "tokens")
    key = ["row_file", "row_at"]
    narrow = pieces.select("doc_id", *key, "start", "length", "ids_crc32", "doc_tokens", "class")
    demand = np.zeros(full, np.int64)
    for r in narrow.filter(F.col("class") < full).groupBy("class").count().collect():
        demand[r["class"]] = r["count"]
    plan = rounded_plan(demand, bounds, length)
    mixed = narrow.withColumn("spread", F.xxhash64(*key))
    order = [F.col(c) for c in ("spread", *key, "start")]
    ranked = running(mixed, "class", order, "length", "ranks").drop("before", "spread")
    placed = saved(_take_places(ranked, plan, full, length), "places")
    n_full = narrow.filter(F.col("class") == full).count()

    within = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    fixed = placed.filter("sequence_id IS NOT NULL").withColumn("offset", F.coalesce(F.sum("length").over(within), F.lit(0)))
    gaps = (placed.filter("sequence_id IS NOT NULL").groupBy("sequence_id").agg(F.sum("length").alias("used"), F.max("target").alias("target"))
            .select("sequence_id", "used", (F.col("target") - F.col("used")).alias("room")).filter("room > 0").withColumn("all", F.lit(0).cast("long")))
    loose = placed.filter("sequence_id IS NULL").select(*key, "length", "class", "pos").withColumn("all", F.lit(0).cast("long"))
    gaps = saved(running(gaps, "all", [F.col("sequence_id")], "room", "gaps").drop("all", "pos"), "gaps")
    loose = saved(running(loose.drop("pos"), "all", [F.col(c) for c in ("class", *key)], "length", "loose").drop("all", "pos"), "loose")
    wanted = gaps.agg(F.sum("room")).first()[0] or 0
    given = loose.agg(F.sum("length")).first()[0] or 0
    room = gaps.unionByName(_free_room(spark, wanted, given - wanted, plan.sequences + n_full, length))
    cuts = _cuts(loose.drop("class"), room, length).groupBy(*key).agg(F.collect_list(F.struct("skip", "size", "sequence_id", "offset")).alias("cuts"))
    # loose documents are the last ones of their class in the order of the ranks: a row can tell by itself, so no other ids are moved
    spread = F.struct(F.xxhash64(*key).alias("spread"), *key)
    border = F.broadcast(placed.filter("sequence_id IS NULL").groupBy("class").agg(F.min(spread).alias("border")))
    ids = pieces.join(border, "class").filter(spread >= F.col("border")).select("doc_id", *key, "start", "doc_tokens", "ids", "wide")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return fixed.select(*columns).unionByName(_cut_pieces(ids.join(cuts, key)).select(*columns))


def op12_column_generation(spark, sf_dir):
    return cut_and_packed(documents(spark, sf_dir))
