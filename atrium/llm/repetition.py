"""Quality rules on repetition: characters inside duplicated n-grams and lines, from rolling hashes in numpy."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import documents

# Largest allowed share of characters inside n-grams (by n) and lines that occurred before in the text.
NGRAM_LIMITS = {5: 0.15, 8: 0.12, 10: 0.10}
LINE_LIMIT = 0.20
BASE_WINDOW = 5
MIN_WORDS = 10
SYMBOLS = b"#*$%&|<>"


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values between offsets."""
    cum = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=cum[1:])
    return cum[offsets[1:]] - cum[offsets[:-1]]


def repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every key: does it occur twice or more; did it occur before."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = k[1:] == k[:-1]
    twice, before = np.zeros(len(k), bool), np.zeros(len(k), bool)
    twice[order] = same[1:] | same[:-1]
    before[order] = same[:-1]
    return twice, before


def covered(starts: np.ndarray, size: int, words: int) -> np.ndarray:
    """Words inside the windows that begin at ``starts``."""
    edge = np.zeros(words + 1, np.int32)
    edge[starts] += 1
    edge[starts + size] -= 1
    return np.cumsum(edge[:-1]) > 0


def text_counts(data: np.ndarray, offsets: np.ndarray, hasher: hashing.SpanHash, sizes=tuple(NGRAM_LIMITS)) -> dict[str, np.ndarray]:
    """Counts of every document of a block: words, characters, symbols, repeated words and lines, duplicated characters."""
    rows = len(offsets) - 1
    starts, ends, row = hashing.word_spans(data, offsets)
    prefix = hasher.prefix(data)
    words = hasher.spans(prefix, starts, ends)
    letter = ~hashing.space_mask(data)
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    chars = points[ends] - points[starts]
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    out = {"n_words": np.bincount(row, minlength=rows), "word_chars": np.bincount(row, chars, rows).astype(np.int64),
           "n_symbols": sums(symbol[data], offsets)}
    row_key = hashing.mix(np.arange(1, rows + 1, dtype=np.uint64))
    for size in dict.fromkeys((BASE_WINDOW, *sizes)):
        grams = hashing.window_hash(words, size)
        at = np.flatnonzero(row[:len(grams)] == row[size - 1:size - 1 + len(grams)])
        twice, before = repeats(grams[at] ^ row_key[row[at]])
        if size == BASE_WINDOW:
            out["n_repeat_words"] = np.bincount(row[covered(at[twice], size, len(row))], minlength=rows)
        inside = covered(at[before], size, len(row))
        out[f"dup_chars_{size}"] = np.bincount(row[inside], chars[inside], rows).astype(np.int64)
    breaks = np.flatnonzero(data == 10)
    begin = np.union1d(offsets[:-1], breaks + 1)
    begin = begin[begin < len(data)]
    limit = np.append(begin[1:], len(data))
    line_row = np.searchsorted(offsets, begin, side="right") - 1
    stop = limit - ((limit > begin) & (data[limit - 1] == 10)) if len(begin) else limit
    filled = np.zeros(len(data) + 1, np.int64)
    np.cumsum(letter & ((data & 0xC0) != 0x80), out=filled[1:])
    size = filled[stop] - filled[begin]
    keep = size > 0
    begin, stop, line_row, size = begin[keep], stop[keep], line_row[keep], size[keep]
    _, before = repeats(hasher.spans(prefix, begin, stop) ^ row_key[line_row])
    out["n_dup_lines"] = np.bincount(line_row[before], minlength=rows)
    out["dup_line_chars"] = np.bincount(line_row[before], size[before], rows).astype(np.int64)
    return out


def repetition_rules(df: DataFrame, ngram_limits: dict[int, float] = NGRAM_LIMITS, line_limit: float = LINE_LIMIT) -> DataFrame:
    """Counts and verdict for (doc_id, text), one row per input row.

    ``dup_chars_n`` are code points in words of n-grams that occurred before in the text, ``dup_line_chars`` those of
    lines that did. ``kept`` is false for base failures (fewer than 10 words, or over 20 % of words in repeated 5-word
    windows) and where a share of duplicated characters is above its limit. Null and empty texts have no words and fail.
    Texts of any length are taken whole; equality is equality of 64-bit hashes within one text."""
    sizes = tuple(ngram_limits)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *[f"dup_chars_{n}" for n in sizes], "dup_line_chars"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = hashing.SpanHash()
        for b in batches:
            for i, data, offsets in hashing.blocks(b.column(1)):
                counts = text_counts(data, offsets, hasher, sizes)
                ids = b.column(0).slice(i, len(offsets) - 1)
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(counts[n].astype(np.int64)) for n in names]], names=["doc_id", *names])

    counted = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        measure, "doc_id long, " + ", ".join(f"{n} long" for n in names))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    within = F.lit(True)
    for n, limit in ngram_limits.items():
        within &= F.col(f"dup_chars_{n}") <= limit * F.col("word_chars")
    within &= F.col("dup_line_chars") <= line_limit * F.col("word_chars")
    return counted.withColumn("base_failed", failed).withColumn("kept", ~failed & within)


def op4_repetition(spark, sf_dir):
    return repetition_rules(documents(spark, sf_dir))


SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT r, i, length(w[i]) AS chars FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
g AS (SELECT r, n, i, count(*) OVER (PARTITION BY r, n, gram) AS times, row_number() OVER (PARTITION BY r, n, gram ORDER BY i) AS k
      FROM (SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS gram FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (VALUES (5), (8), (10)) v(n)))),
c AS (SELECT r, n, i, bool_or(k > 1) AS again FROM (SELECT r, n, k, unnest(range(i, i + n)) AS i FROM g WHERE times > 1) GROUP BY ALL),
s AS (SELECT c.r, count(*) FILTER (n = 5) AS n_repeat_words, sum(chars) FILTER (n = 5 AND again) AS c5, sum(chars) FILTER (n = 8 AND again) AS c8, sum(chars) FILTER (n = 10 AND again) AS c10
      FROM c JOIN p ON c.r = p.r AND c.i = p.i GROUP BY c.r),
l AS (SELECT r, line, row_number() OVER (PARTITION BY r, line ORDER BY i) AS k FROM (SELECT r, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS i FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
m AS (SELECT r, count(*) AS n_dup_lines, sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g'))) AS chars FROM l WHERE k > 1 GROUP BY r),
a AS (SELECT d.doc_id, len(w) AS n_words, CAST(coalesce((SELECT sum(chars) FROM p WHERE p.r = d.r), 0) AS BIGINT) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
      coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(coalesce(c5, 0) AS BIGINT) AS dup_chars_5, CAST(coalesce(c8, 0) AS BIGINT) AS dup_chars_8,
      CAST(coalesce(c10, 0) AS BIGINT) AS dup_chars_10, CAST(coalesce(m.chars, 0) AS BIGINT) AS dup_line_chars FROM d LEFT JOIN s ON d.r = s.r LEFT JOIN m ON d.r = m.r)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND dup_chars_5 <= 0.15::DOUBLE * word_chars AND dup_chars_8 <= 0.12::DOUBLE * word_chars AND dup_chars_10 <= 0.1::DOUBLE * word_chars
       AND dup_line_chars <= 0.2::DOUBLE * word_chars AS kept FROM a
"""
