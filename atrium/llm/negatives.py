"""Hard negatives by the threshold algorithm: sorted candidate lists per dimension, signed access, integer scores.

Rows are dealt into blocks, anchors into batches; every block meets every batch once, as a query set meets an index. A block keeps
one list per dimension, sorted by that component. For an anchor, the list of dimension j is read from its large end if the anchor's
component is positive, from its small end if negative, not at all if zero; so contributions fall along every list, and the sum of
the last ones read is a threshold that no unread row can exceed. Rows met in any list are scored in full. An anchor's reading of a
block ends once the threshold is strictly below the k-th score of every window, or below the window's least allowed score.
The first rows of all blocks are merged by a ranking that keeps k rows per task before it shuffles.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

BLOCK_ROWS = 4096
BATCH_ANCHORS = 4096
POSITIVES = NEGATIVES = 5
QUERY_EVERY = 100
SCALE = 256
LOW, HIGH = 80, 100  # a negative's score lies between LOW and HIGH hundredths of the positive's
EXACT = 1 << 53
NONE = np.iinfo(np.int64).min


class Lists:
    """A block of integer vectors with one sorted candidate list per dimension."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.order = np.argsort(vectors, axis=0, kind="stable").T.copy()  # per dimension: row numbers by rising component
        self.sorted = np.sort(vectors, axis=0).T.copy()
        self.most = int(np.abs(vectors).max(initial=0))
        self.floats = vectors.astype(np.float64) if self.most < EXACT else None

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Integer inner products. Doubles are used where every partial sum is below 2**53, so that they are exact."""
        bound = self.most * int(np.abs(anchor).max(initial=0)) * len(anchor)
        if self.floats is not None and 0 <= bound < EXACT:
            return (self.floats[rows] @ anchor.astype(np.float64)).astype(np.int64)
        return self.vectors[rows] @ anchor

    def depths(self, anchor: np.ndarray, first: int = 32):
        """Rows not met before, and the threshold of all that are still unread, at doubling depths of all lists."""
        n, dims = len(self.vectors), np.flatnonzero(anchor)
        up, down = dims[anchor[dims] < 0], dims[anchor[dims] > 0]
        seen = np.zeros(n, bool)
        done, depth = 0, min(n, first) if len(dims) else n
        while True:
            met = np.zeros(n, bool)
            if len(dims):
                met[self.order[up, done:depth].ravel()] = True
                met[self.order[down, n - depth:n - done].ravel()] = True
            else:
                met[:] = True  # all scores are zero
            fresh = np.flatnonzero(met & ~seen)
            seen |= met
            if depth == n:
                yield fresh, NONE
                return
            # python integers: the sum of the bounds may pass 64 bits where no score does
            ends = [*zip(anchor[up].tolist(), self.sorted[up, depth - 1].tolist()), *zip(anchor[down].tolist(), self.sorted[down, n - depth].tolist())]
            yield fresh, sum(a * v for a, v in ends)
            done, depth = depth, min(n, 2 * depth)


class First:
    """The first k of the rows seen, by falling score and rising id, within bounds on the score."""

    def __init__(self, k: int, least: int | None = None, most: int | None = None):
        self.k, self.least, self.most = k, least, most
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray):
        ok = np.ones(len(scores), bool)
        if self.least is not None:
            ok &= (scores >= self.least) & (scores <= self.most)
        if len(self.scores) == self.k:
            ok &= scores >= self.scores[-1]
        if ok.any():
            s, i = np.r_[self.scores, scores[ok]], np.r_[self.ids, ids[ok]]
            best = np.lexsort((i, -s))[:self.k]
            self.scores, self.ids = s[best], i[best]

    def closed(self, threshold: int) -> bool:
        """No row at or below the threshold can still come in. Strict: a row with the k-th score and a smaller id would."""
        if self.least is not None and (self.least > self.most or threshold < self.least):
            return True
        return len(self.scores) == self.k and threshold < int(self.scores[-1])


def positives_of(lists: Lists, ids: np.ndarray, labels: np.ndarray, anchor: np.ndarray, anchor_id: int, label: int, k: int) -> First:
    best = First(k)
    for fresh, threshold in lists.depths(anchor):
        fresh = fresh[(labels[fresh] == label) & (ids[fresh] != anchor_id)]
        best.add(lists.scores(fresh, anchor), ids[fresh])
        if best.closed(threshold):
            break
    return best


def negatives_of(lists: Lists, ids: np.ndarray, labels: np.ndarray, anchor: np.ndarray, label: int, positive_scores: list[int], k: int,
                 low: int = LOW, high: int = HIGH) -> dict[int, First]:
    """First negatives for every distinct score of a positive."""
    windows = {s: First(k, -(-low * s // 100), high * s // 100) for s in set(positive_scores)}
    for fresh, threshold in lists.depths(anchor):
        fresh = fresh[labels[fresh] != label]
        scores = lists.scores(fresh, anchor)
        for w in windows.values():
            w.add(scores, ids[fresh])
        if all(w.closed(threshold) for w in windows.values()):
            break
    return windows


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column side by side; components that a row lacks are zero."""
    column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0)
    n = len(column)
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (lengths == width).all():
        return values.reshape(n, width)
    out = np.zeros((n, width), np.int64)
    row = np.repeat(np.arange(n), lengths)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def _meet(rows: DataFrame, anchors: DataFrame, blocks: int, batches: int, search, schema: str) -> DataFrame:
    """Every block of rows with every batch of anchors, in one task per pair; ``search`` gets both as tables.

    Rows are copied once per batch and anchors once per block, both of which are large."""
    left = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn(
        "batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))))
    right = anchors.withColumn("batch", F.pmod(F.xxhash64("anchor_id", F.lit(3)), F.lit(batches)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return left.groupBy("block", "batch").cogroup(right.groupBy("block", "batch")).applyInArrow(search, schema)


def _first_rows(df: DataFrame, by: list[str], score: str, row: str, k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(row))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def integer_rows(df: DataFrame) -> DataFrame:
    """(vec_id, label, v): rows that take part, with planted labels and components floor(256 * x) as longs."""
    vector = F.transform("embedding", lambda x: x.cast("double"))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return (df.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad)
            .select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"),
                    F.transform(vector, lambda x: F.floor(x * SCALE)).alias("v"))
            .groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("m")).select("vec_id", "m.label", "m.v"))


def hard_negatives(df: DataFrame, every: int = QUERY_EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW,
                   high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of (vec_id, embedding, label).

    Rows with a null label, a null vector or a null or non-finite component take no part, nor do rows without a vec_id, which
    could not be named. Of rows with one vec_id the least (label, integer vector) takes part, so repeated rows count once. Vectors
    of different lengths are compared over the components that both have; an empty vector scores zero with all. Ties go to the
    smaller vec_id. An anchor without other rows of its label, or without rows in a window, gives no rows; so does an empty table.
    Products are longs: components beyond 2**31 / 256 may overflow."""
    rows = saved(integer_rows(df), "vectors")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width"),
                    F.sum((F.col("vec_id") % every == 0).cast("long")).alias("anchors")).first()
    width = int(size["width"] or 0)
    blocks, batches = max(1, -(-size["n"] // BLOCK_ROWS)), max(1, -(-(size["anchors"] or 0) // BATCH_ANCHORS))
    anchors = rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("anchor_id"), F.col("label").alias("anchor_label"), F.col("v").alias("av"))

    def opened(left: pa.Table, right: pa.Table):
        ids, labels = left.column("vec_id").to_numpy(), left.column("label").to_numpy()
        return Lists(_matrix(left.column("v"), width)), ids, labels, _matrix(right.column("av"), width)

    def empty(names: list[str]) -> pa.Table:
        return pa.table({n: pa.array([], pa.int64()) for n in names})

    def find_positives(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["anchor_id", "positive_id", "positive_score"]
        if not left.num_rows or not right.num_rows:
            return empty(names)
        lists, ids, labels, vectors = opened(left, right)
        found = [[], [], []]
        for a, label, v in zip(right.column("anchor_id").to_pylist(), right.column("anchor_label").to_pylist(), vectors):
            best = positives_of(lists, ids, labels, v, a, label, positives)
            for c, values in zip(found, (np.full(len(best.ids), a), best.ids, best.scores)):
                c.append(values)
        return pa.table({n: pa.array(np.concatenate(c).astype(np.int64)) for n, c in zip(names, found)})

    def find_negatives(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["anchor_id", "positive_score", "negative_id", "negative_score"]
        if not left.num_rows or not right.num_rows:
            return empty(names)
        lists, ids, labels, vectors = opened(left, right)
        found = [[], [], [], []]
        for a, label, scores, v in zip(*(right.column(c).to_pylist() for c in ("anchor_id", "anchor_label", "positive_scores")), vectors):
            for s, best in negatives_of(lists, ids, labels, v, label, scores, negatives, low, high).items():
                for c, values in zip(found, (np.full(len(best.ids), a), np.full(len(best.ids), s), best.ids, best.scores)):
                    c.append(values)
        return pa.table({n: pa.array(np.concatenate(c).astype(np.int64)) for n, c in zip(names, found)})

    near = _meet(rows, anchors, blocks, batches, find_positives, "anchor_id long, positive_id long, positive_score long")
    near = saved(_first_rows(near, ["anchor_id"], "positive_score", "positive_id", positives).drop("rank"), "positives")
    wanted = anchors.join(near.groupBy("anchor_id").agg(F.collect_set("positive_score").alias("positive_scores")), "anchor_id")
    far = _meet(rows, wanted, blocks, batches, find_negatives, "anchor_id long, positive_score long, negative_id long, negative_score long")
    far = _first_rows(far, ["anchor_id", "positive_score"], "negative_score", "negative_id", negatives)
    return near.join(far, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
                                                                 "positive_score", "negative_score")


def op11_threshold_negatives(spark, sf_dir):
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH parts AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
                      list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
               FROM embeddings
               WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
one AS (SELECT vec_id, min({'label': label, 'v': v}) AS m FROM parts GROUP BY vec_id),
r AS (SELECT vec_id, m.label AS label, m.v AS v FROM one),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
                  CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: coalesce(z[1] * z[2], 0))) AS BIGINT) AS score
           FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
near AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
         QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.other_id AS negative_id, positive_score, s.score AS negative_score
FROM near JOIN scored s USING (anchor_id)
WHERE NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.other_id)
QUALIFY row_number() OVER w <= 5
"""
