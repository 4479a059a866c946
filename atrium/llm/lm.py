"""Stupid-backoff language-model scores from n-gram counts of the whole corpus, computed relationally.

Documents are taken in pieces of neighbouring rows. A piece sends its distinct n-grams with their numbers to the count
tables, which are partitioned by hash range; each part adds up its n-grams over all pieces and answers every piece with the
totals in the order of the question. The answers are joined to the pieces, whose exploded n-grams are looked up by place
and summed per document. Every n-gram of every document is counted; a frequent one is one row per piece, not per use.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import documents, placed_rows

ORDER = 3
BACKOFF = 0.4
MIN_COUNT = 2                 # an n-gram seen once is only its own document's; scores back off from it
PIECE_ROWS = 4096
TABLE_GRAMS = 1_000_000       # n-grams that one part of a count table receives, about
HASH_BITS = np.uint64(0xFFFFFFFFFFFFFF00)  # 56 bits tell n-grams apart: of 10**13 different ones, one in 7,000 meets another
MICRO = 1_000_000             # scores are sums of rounded millionths of nats, so that they do not depend on the order


def pack(values: np.ndarray) -> bytes:
    """Rising 64-bit values as compressed byte planes of their differences."""
    steps = np.diff(values, prepend=np.uint64(0))
    planes = steps.view(np.uint8).reshape(-1, 8).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def unpack(raw: bytes, count: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, count * 8, codec="zstd"), np.uint8).reshape(8, count)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_counts(values: np.ndarray) -> bytes:
    planes = values.astype("<i8").view(np.uint8).reshape(-1, 8).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def unpack_counts(raw: bytes, count: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(pa.decompress(raw, count * 8, codec="zstd"), np.uint8).reshape(8, count).T).view("<i8").ravel()


def piece_words(texts: pa.Array, hasher: hashing.SpanHash) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word of a piece."""
    words, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, data, offsets in hashing.blocks(texts):
        starts, ends, row = hashing.word_spans(data, offsets)
        words.append(hasher.words(data, starts, ends))
        rows.append(row + i)
    return np.concatenate(words), np.concatenate(rows)


def grams(words: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of a piece and the place of their last word."""
    h = hashing.window_hash(words, n)
    at = np.flatnonzero(rows[:len(h)] == rows[n - 1:n - 1 + len(h)])
    return h[at] & HASH_BITS, at + n - 1


def _pieces(df: DataFrame) -> DataFrame:
    """doc_id, text, and the piece and place of every row, stable over reads: the rows of a file in runs of PIECE_ROWS."""
    placed = placed_rows(df, ["doc_id", "text"], "lm-documents")
    return placed.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                         F.xxhash64("row_file", F.floor(F.col("row_at") / PIECE_ROWS)).alias("piece"), F.col("row_at").alias("at"))


def _runs(batches: Iterator[pa.RecordBatch]):
    """Rows of one piece at a time: (piece, first place, table)."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        piece = b.column(2).to_numpy()
        edge = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1], True]) if len(piece) else np.zeros(1, np.int64)
        for a, z in zip(edge.tolist(), edge[1:].tolist()):
            part = b.slice(a, z - a)
            if held and held[0].column(2)[0].as_py() != int(piece[a]):
                yield held
                held = []
            held.append(part)
    if held:
        yield held


def backoff_scores(df: DataFrame, order: int = ORDER, backoff: float = BACKOFF, min_count: int = MIN_COUNT) -> DataFrame:
    """Score every row of (doc_id, text): doc_id, n_words, score_micro, used_1 .. used_order, nats_per_word.

    A word's score is log(c(n-gram) / c(its first n - 1 words)) for the longest n-gram up to ``order`` that the corpus holds
    ``min_count`` times, times the backoff factor for every order given up; single words score c / all words. A document's
    first words have shorter contexts and no penalty for them. Null and empty texts have no words and score 0; repeated rows
    are documents of their own and count as such; an empty table gives no rows. n-grams are compared by 56-bit hashes."""
    source = _pieces(df)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:
            for _, data, offsets in hashing.blocks(b.column(0)):
                n += len(hashing.word_spans(data, offsets)[0])
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    everything = source.select("text").mapInArrow(tally, "n long").agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-everything // TABLE_GRAMS))

    def question(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = hashing.SpanHash()
        for held in _runs(batches):
            words, rows = piece_words(pa.chunked_array([b.column(1) for b in held]), hasher)
            piece, at = held[0].column(2)[0].as_py(), held[0].column(3)[0].as_py()
            for n in range(1, order + 1):
                h, count = np.unique(grams(words, rows, n)[0], return_counts=True)
                table = (h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
                cuts = np.searchsorted(table, np.arange(parts + 1))
                used = np.flatnonzero(np.diff(cuts)).tolist()
                spans = [slice(cuts[k], cuts[k + 1]) for k in used]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k * order + n - 1 for k in used], pa.int64()), pa.array([piece] * len(used), pa.int64()), pa.array([at] * len(used), pa.int64()),
                     pa.array([s.stop - s.start for s in spans], pa.int64()), pa.array([pack(h[s]) for s in spans], pa.binary()),
                     pa.array([pack_counts(count[s]) for s in spans], pa.binary())], names=["part", "piece", "at", "size", "grams", "counts"])

    def answer(table: pa.Table) -> pa.Table:
        sizes = table.column("size").to_pylist()
        h = np.concatenate([unpack(g.as_py(), n) for g, n in zip(table.column("grams"), sizes)])
        c = np.concatenate([unpack_counts(g.as_py(), n) for g, n in zip(table.column("counts"), sizes)])
        seen, place = np.unique(h, return_inverse=True)
        total = np.bincount(place, c, len(seen)).astype(np.int64)[place]
        ends = np.cumsum(sizes)
        return pa.table({"piece": table.column("piece"), "at": table.column("at"), "part": table.column("part"), "size": table.column("size"),
                         "counts": pa.array([pack_counts(total[z - n:z]) for z, n in zip(ends, sizes)], pa.binary())})

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _runs(batches):
            texts = pa.chunked_array([b.column(1) for b in held]).combine_chunks().cast(pa.large_string()).fill_null("")
            lengths = pa.compute.binary_length(texts).to_numpy().astype(np.int64)
            raw = b"".join(data.tobytes() for _, data, _ in hashing.blocks(texts))
            ids = pa.chunked_array([b.column(0) for b in held]).combine_chunks()
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [held[0].column(2).slice(0, 1), held[0].column(3).slice(0, 1), pa.array([len(texts)], pa.int64()), pa.array([len(raw)], pa.int64()),
                 *[pa.array([v], pa.binary()) for v in (ids.fill_null(0).to_numpy().tobytes(), known.tobytes(), lengths.tobytes(), pa.Codec("zstd", compression_level=6).compress(raw, asbytes=True))]],
                names=["b_piece", "b_at", "rows", "bytes", "ids", "known", "lengths", "texts"])

    names = ["doc_id", "n_words", "score_micro", *[f"used_{n}" for n in range(1, order + 1)]]

    def score(bundles: pa.Table, answers: pa.Table) -> pa.Table:
        hasher = hashing.SpanHash()
        out: list[list] = [[] for _ in names]
        replies = answers.to_pydict()
        for r in bundles.to_pylist():
            lengths = np.frombuffer(r["lengths"], np.int64)
            raw = pa.decompress(r["texts"], r["bytes"], codec="zstd") if r["bytes"] else pa.py_buffer(b"")
            texts = pa.LargeStringArray.from_buffers(r["rows"], pa.py_buffer(np.r_[0, np.cumsum(lengths)].astype(np.int64).tobytes()), raw)
            words, rows = piece_words(texts, hasher)
            mine = sorted(k for k in range(len(replies["part"])) if replies["at"][k] == r["b_at"] and replies["piece"][k] == r["b_piece"])
            place = np.arange(len(words)) - np.searchsorted(rows, rows)
            value, used = np.zeros(len(words)), np.zeros(len(words), np.int64)
            shorter = np.full(len(words), max(everything, 1), np.int64)
            for n in range(1, order + 1):
                h, ends = grams(words, rows, n)
                seen, back = np.unique(h, return_inverse=True)
                own = sorted((replies["part"][k], k) for k in mine if replies["part"][k] % order == n - 1)
                total = np.concatenate([np.zeros(0, np.int64), *[unpack_counts(replies["counts"][k], replies["size"][k]) for _, k in own]])
                if len(total) != len(seen):
                    raise ValueError("a piece was read with other rows than before")
                count = np.zeros(len(words), np.int64)
                count[ends] = total[back]
                # the context of the n-gram that ends here is the (n - 1)-gram that ends one word before
                context = shorter if n == 1 else np.r_[0, shorter[:-1]] if len(words) else shorter
                take = count >= (1 if n == 1 else min_count)
                value[take] = np.log(count[take]) - np.log(context[take])
                used[take] = n
                shorter = count
            value += (np.minimum(place + 1, order) - used) * np.log(backoff)
            micro = np.rint(value * MICRO)
            docs = r["rows"]
            ids, known = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["known"], bool)
            columns = [pa.array(ids, mask=~known), np.bincount(rows, minlength=docs), np.bincount(rows, micro, docs).astype(np.int64),
                       *[np.bincount(rows[used == n], minlength=docs) for n in range(1, order + 1)]]
            for c, v in zip(out, columns):
                c.append(v if isinstance(v, pa.Array) else pa.array(v.astype(np.int64)))
        return pa.table({n: pa.chunked_array(c, pa.int64()) for n, c in zip(names, out)})

    asked = source.mapInArrow(question, "part long, piece long, at long, size long, grams binary, counts binary")
    told = asked.groupBy("part").applyInArrow(answer, "piece long, at long, part long, size long, counts binary")
    bundles = source.mapInArrow(bundle, "b_piece long, b_at long, rows long, bytes long, ids binary, known binary, lengths binary, texts binary")
    scored = bundles.groupBy("b_piece").cogroup(told.groupBy("piece")).applyInArrow(score, ", ".join(f"{n} long" for n in names))
    return scored.withColumn("nats_per_word", F.col("score_micro") / F.nullif("n_words", F.lit(0)) / MICRO)


def op10_stupid_backoff(spark, sf_dir):
    return backoff_scores(documents(spark, sf_dir))


SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT r, i, w[i] AS c, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS a
      FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
c1 AS (SELECT c, count(*) AS n FROM p GROUP BY c),
c2 AS (SELECT b, c, count(*) AS n FROM p WHERE b IS NOT NULL GROUP BY b, c),
c3 AS (SELECT a, b, c, count(*) AS n FROM p WHERE a IS NOT NULL GROUP BY a, b, c),
s AS (SELECT p.r, p.i, CASE WHEN c3.n >= 2 THEN 3 WHEN c2.n >= 2 THEN 2 ELSE 1 END AS k,
             CASE WHEN c3.n >= 2 THEN ln(c3.n) - ln(ab.n) WHEN c2.n >= 2 THEN ln(c2.n) - ln(wb.n)
                  ELSE ln(c1.n) - ln((SELECT count(*) FROM p)) END AS v
      FROM p JOIN c1 ON c1.c = p.c LEFT JOIN c2 ON c2.b = p.b AND c2.c = p.c LEFT JOIN c3 ON c3.a = p.a AND c3.b = p.b AND c3.c = p.c
      LEFT JOIN c2 ab ON ab.b = p.a AND ab.c = p.b LEFT JOIN c1 wb ON wb.c = p.b),
t AS (SELECT r, sum(CAST(round((v + (least(i, 3) - k) * ln(0.4)) * 1e6) AS BIGINT)) AS m, count(*) AS n,
             count(*) FILTER (k = 1) AS u1, count(*) FILTER (k = 2) AS u2, count(*) FILTER (k = 3) AS u3 FROM s GROUP BY r)
SELECT d.doc_id, coalesce(n, 0) AS n_words, CAST(coalesce(m, 0) AS BIGINT) AS score_micro, coalesce(u1, 0) AS used_1, coalesce(u2, 0) AS used_2, coalesce(u3, 0) AS used_3,
       m / n / 1000000 AS nats_per_word FROM d LEFT JOIN t ON d.r = t.r
"""
