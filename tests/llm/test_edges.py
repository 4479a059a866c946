"""Nulls, empty and long texts, repeated rows, empty tables and clashing extra columns for every operator and stage."""
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from atrium.llm import dedup, jaccard, lm, mixing, packing, pii, quality, repetition, secrets, sharding

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
LONG = " ".join(f"w{i * 7919 % 10007}" for i in range(40_000))
ROWS = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, LONG, "en", "a", len(LONG)), (5, LONG, "fr", "b", len(LONG)),
        (6, "one two", None, "b", 7), (6, "one two", None, "b", 7), (None, "one  two", "en", None, 8), (8, "naïve ünïcode ☃ text", "de", "a", 20),
        (9, "Just a plain clean sentence of more than ten ordinary words in it.", "en", "c", 66), (10, "x", "en", "c", 1)]
# Names that operators use inside or return.
CLASH = ["id", "norm", "rest", "bucket", "kept", "keep_id", "size", "shard", "slot", "node", "code", "take", "pos", "before", "piece", "tokens", "set_id",
         "component_id", "n_words", "score", "votes", "in_text", "row_id", "at", "dealt", "source_size", "base", "added"]
OPERATORS = {"shards": lambda d: sharding.kd_shards(d, shards=3), "dedup": dedup.content_sort, "mix": mixing.curriculum, "repetition": repetition.repetition_rules,
             "packing": lambda d: packing.packed(packing.token_pieces(d)), "quality": quality.weak_label_scores, "pii": pii.pii_spans, "join": jaccard.near_duplicates,
             "secrets": secrets.secret_spans, "lm": lm.backoff_scores}


def frame(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit(k) for k, c in enumerate(CLASH)})


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    got = OPERATORS[name](frame(spark, ROWS)).collect()
    ids = sorted((r["doc_id"] for r in got if name not in ("mix", "packing") or r.asDict().get("pass", 0) == 0 and r.asDict().get("piece", 0) == 0), key=str)
    assert ids == sorted((r[0] for r in ROWS), key=str)


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(spark, name):
    assert OPERATORS[name](frame(spark, [])).collect() == []


def test_odd_results(spark):
    df = frame(spark, ROWS)
    kept = {(r.doc_id, r.keep_id, r.group_size) for r in dedup.content_sort(df).filter("kept").collect()}
    assert kept == {(1, 1, 2), (3, 3, 1), (4, 4, 2), (6, 6, 3), (8, 8, 1), (9, 9, 1), (10, 10, 1)}
    found = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (6, 1, 6), (None, 1, None), (10, 1, 10)} <= found
    assert {c for d, _, c in found if d in (4, 5)} == {4}
    scores = {r.doc_id: r for r in lm.backoff_scores(df).collect()}
    assert scores[1].score_micro == scores[2].score_micro == 0 and scores[1].nats_per_word is None and scores[4].n_words == 40_000
    pieces = packing.token_pieces(df).filter("doc_id IN (1, 2)").collect()
    assert [(p.piece, p.start, p.length) for p in pieces] == [(0, 0, 1)] * 2


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    for rows in (ROWS, []):
        docs = frame(spark, rows)
        out = stage(spark, docs, None)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.dtypes == docs.dtypes
        out.collect()
