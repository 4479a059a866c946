"""Weak-label quality model: expectation-maximisation over overlapping heuristic labellers, then a hashed linear scorer.

1. Labellers vote good, bad or abstain on every document; vote patterns are counted over all documents.
2. EM on the pattern counts estimates the share of good documents and, per labeller, how often it votes what for either
   class; no labels are read.
3. Posterior labels of a hashed sample of at most ``SAMPLE`` documents train a logistic scorer on hashed byte trigrams and
   statistics. The scorer and its threshold decide on every document.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import documents
from .repetition import sums, text_counts

SAMPLE = 4000        # documents that the scorer is fitted on, at most
BUCKETS = 4096       # hashed features
FEATURE_BYTES = 1 << 19  # bytes of text whose features a task holds at a time
THRESHOLD = 0.4      # least score of a document that stays: in doubt it does
BAD, ABSTAIN, GOOD = 0, 1, 2
# Very common words of English, German, French and Spanish.
COMMON = "the of and to in is that for der die und das ist mit zu ein le la les et de que un une el los y en por".split()
# Chances of a bad vote, an abstention and a good vote on bad and on good documents before any document is seen.
PRIOR = np.array([[0.35, 0.25, 0.40], [0.01, 0.20, 0.79]])
LABELLERS = ("symbols", "repeats", "phrases", "word_length", "common_words", "bars", "capitals", "exclamations", "ending", "length")


def statistics(data: np.ndarray, offsets: np.ndarray, hasher: hashing.SpanHash) -> dict[str, np.ndarray]:
    """Shares of every document of a block that the labellers look at."""
    rows = len(offsets) - 1
    counts = text_counts(data, offsets, hasher, ())
    lower = hashing.lower_ascii(data)
    starts, ends, row = hashing.word_spans(data, offsets)
    words = hasher.words(lower, starts, ends)
    known = np.concatenate([hasher.words(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())])) for w in (*COMMON, "|")])
    n = np.maximum(counts["n_words"], 1)
    common = np.isin(words, known[:-1])
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    last = np.zeros(rows, np.uint8)
    np.put(last, row, data[ends - 1] if len(ends) else np.zeros(0, np.uint8))
    share = lambda mask: np.bincount(row[mask], minlength=rows) / n
    upper, marks = ((data - np.uint8(65)) < 26), data == 33
    return {"n": counts["n_words"], "capitals": sums(upper, offsets) / np.maximum(sums(upper | ((data - np.uint8(97)) < 26), offsets), 1),
            "exclamations": sums(marks, offsets) / n, "symbols": counts["n_symbols"] / np.maximum(counts["word_chars"], 1), "repeats": share(again),
            "phrases": counts["n_repeat_words"] / n, "word_length": counts["word_chars"] / n, "common_words": share(common),
            "bars": share(words == known[-1]), "ending": np.isin(last, np.frombuffer(b".!?\"')", np.uint8)).astype(float)}


def votes(s: dict[str, np.ndarray]) -> np.ndarray:
    """One column per labeller: 0 bad, 1 abstains, 2 good."""
    pick = lambda bad, good: np.where(bad, BAD, np.where(good, GOOD, ABSTAIN))
    long_enough = s["n"] >= 20
    return np.stack([
        pick(s["symbols"] > 0.10, s["symbols"] < 0.02),
        pick(s["repeats"] > 0.20, s["repeats"] < 0.05),
        pick(s["phrases"] > 0.30, long_enough & (s["phrases"] < 0.10)),
        pick((s["word_length"] < 2) | (s["word_length"] > 14), (s["word_length"] > 3) & (s["word_length"] < 10)),
        pick(long_enough & (s["common_words"] < 0.03), s["common_words"] > 0.08),
        pick(s["bars"] > 0.10, s["bars"] < 0.02),
        pick(long_enough & (s["capitals"] > 0.40), s["capitals"] < 0.15),
        pick(long_enough & (s["exclamations"] > 0.25), s["exclamations"] < 0.05),
        pick(np.zeros(len(s["n"]), bool), s["ending"] > 0),
        pick(s["n"] == 0, s["n"] >= 10)], axis=1)


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray]:
    """Share of good documents and table [class, labeller, vote] of vote chances, from counted vote patterns.

    Bad votes are taken to be rare on good documents: pseudo-documents, a tenth of all, say so (``PRIOR``); they also settle
    which class is the good one, and an empty table gives them back."""
    m = patterns.shape[1]
    start = np.tile(PRIOR[:, None, :], (1, m, 1))
    table, share, hot = start, 0.8, np.eye(3)[patterns]
    strength = 0.1 * counts.sum() + 1
    for _ in range(rounds):
        post = posterior(patterns, share, table)
        weights = np.stack([(1 - post) * counts, post * counts])
        table = np.einsum("cp,pmv->cmv", weights, hot) + start * strength * np.array([0.05, 1.0])[:, None, None]
        table /= table.sum(axis=2, keepdims=True)
        share = (weights[1].sum() + 4) / (counts.sum() + 5)
    return share, table


def posterior(patterns: np.ndarray, share: float, table: np.ndarray) -> np.ndarray:
    """Chance that a document with these votes is good."""
    logs = np.log(table)
    m = np.arange(patterns.shape[1])
    good = np.log(share) + logs[1][m, patterns].sum(axis=1)
    bad = np.log1p(-share) + logs[0][m, patterns].sum(axis=1)
    return 1 / (1 + np.exp(np.clip(bad - good, -50, 50)))


def features(data: np.ndarray, offsets: np.ndarray, s: dict[str, np.ndarray]):
    """Hashed features as (row, bucket, value): shares of byte trigrams, and one bucket per statistic's bin."""
    rows = len(offsets) - 1
    size = np.maximum(np.diff(offsets) - 2, 1)
    d = data.astype(np.uint32)
    code = (d[:-2] * 0x10001 + d[1:-1] * 0x101 + d[2:]) * np.uint32(0x9E3779B1) >> np.uint32(20) if len(d) > 2 else np.zeros(0, np.uint32)
    row = np.searchsorted(offsets, np.arange(len(code)), side="right") - 1
    inside = np.arange(len(code)) + 2 < offsets[1:][row]
    names = [k for k in s if k not in ("n", "word_length")]
    bins = np.stack([np.minimum((s[k] * 20).astype(np.int64), 20) for k in names], axis=1)
    bucket = (bins * 7919 + np.arange(len(names)) * 104729) % BUCKETS
    return (np.concatenate([row[inside], np.repeat(np.arange(rows), len(names))]), np.concatenate([code[inside].astype(np.int64) % BUCKETS, bucket.ravel()]),
            np.concatenate([3.0 / np.sqrt(size[row[inside]] * 1.0) / np.sqrt(size[row[inside]]), np.full(rows * len(names), 1.0)]))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 200, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by accelerated gradient steps."""
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    v, c = w, b
    step = 4.0 / max(float(np.einsum("ij,ij->i", x, x).max(initial=1.0)) + 1, 1.0)
    for k in range(rounds):
        error = (1 / (1 + np.exp(-np.clip(x @ v + c, -30, 30))) - y).astype(np.float32)
        w1, b1 = (v - step * (x.T @ error / len(y) + penalty * v)).astype(np.float32), c - step * float(error.mean())
        v, c = (w1 + k / (k + 3) * (w1 - w)).astype(np.float32), b1 + k / (k + 3) * (b1 - b)
        w, b = w1, b1
    return w, b


def weak_label_scores(df: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD, carry: tuple = ()) -> DataFrame:
    """Score every row of (doc_id, text): doc_id, votes, posterior, score, kept and the columns of ``carry`` as in_<name>.

    Null and empty texts get the votes of an empty text and are scored like any other; repeated rows score alike; an empty
    table gives no rows. The fit depends on the documents alone: the sample is drawn by a hash of doc_id."""
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                     F.struct(*[F.col(c) for c in carry] or [F.lit(0).alias("none")]).alias("rest"))
    powers = 3 ** np.arange(len(LABELLERS))

    def parts(column):
        hasher = hashing.SpanHash()
        for i, data, offsets in hashing.blocks(column, FEATURE_BYTES):
            s = statistics(data, offsets, hasher)
            yield i, data, offsets, s, votes(s)

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3 ** len(LABELLERS), np.int64)
        for b in batches:
            for *_, v in parts(b.column(0)):
                total += np.bincount(v @ powers, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pattern", "n"])

    counted = docs.select("text").mapInArrow(patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    seen = np.array(sorted((r.pattern, r.n) for r in counted), np.int64).reshape(-1, 2)
    share, table = expectation_maximisation(seen[:, :1] // powers % 3, seen[:, 1].astype(float))
    everything = int(seen[:, 1].sum())

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, data, offsets, s, v in parts(b.column(0)):
                row, bucket, value = features(data, offsets, s)
                key, back = np.unique(row * BUCKETS + bucket, return_inverse=True)
                weight = np.bincount(back, value).astype(np.float32)
                ends = np.searchsorted(key, np.arange(len(offsets)) * BUCKETS)
                p = posterior(v, share, table)
                yield pa.RecordBatch.from_arrays([pa.array(p), pa.array([(key[a:z] % BUCKETS).astype(np.uint16).tobytes() for a, z in zip(ends, ends[1:])], pa.binary()),
                                                  pa.array([weight[a:z].tobytes() for a, z in zip(ends, ends[1:])], pa.binary())], names=["p", "at", "weight"])

    drawn = docs if everything <= sample else docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(everything)) < int(sample * 0.9))
    rows = drawn.select("text").mapInArrow(vectors, "p double, at binary, weight binary").limit(sample).collect()
    x = np.zeros((max(len(rows), 1), BUCKETS), np.float32)
    for k, r in enumerate(rows):
        x[k, np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["weight"], np.float32)
    w, bias = fit(x, np.array([r["p"] for r in rows] or [1.0]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, data, offsets, s, v in parts(b.column(1)):
                n = len(offsets) - 1
                row, bucket, value = features(data, offsets, s)
                z = np.bincount(row, w[bucket] * value, n) + bias
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, n), b.column(2).slice(i, n), pa.array(v @ powers), pa.array(posterior(v, share, table)),
                                                  pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["doc_id", "rest", "votes", "posterior", "score"])

    rest = docs.schema["rest"].dataType.simpleString()
    scored = docs.select("doc_id", "text", "rest").mapInArrow(score, f"doc_id long, rest {rest}, votes long, posterior double, score double")
    return scored.select("doc_id", "votes", "posterior", "score", (F.col("score") >= threshold).alias("kept"), *[F.col("rest")[c].alias(f"in_{c}") for c in carry])


def good_documents(docs: DataFrame) -> DataFrame:
    """The rows that the scorer keeps, with all their columns."""
    kept = weak_label_scores(docs, carry=tuple(docs.columns)).filter("kept")
    return kept.select(*[F.col(f"in_{c}").alias(c) for c in docs.columns])


def op6_weak_labels(spark, sf_dir):
    return weak_label_scores(documents(spark, sf_dir))
