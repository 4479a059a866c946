"""Cutting-stock packing: exact round trip against the tokenizer, no padding, linear program against its bounds."""
import collections
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import DATA
from tokenizers import Tokenizer

from atrium.llm import cutting, queries


def check(rows, texts, length=2048):
    """Every id once, checksums of the very ids, gapless offsets, sequences of full length or a power of two."""
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    left = collections.Counter()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for doc, text in texts:
        left[doc] += 1
    encoded = {}
    for doc, text in texts:
        encoded[doc] = np.array([*coder.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
    assert set(by_doc) == set(left)
    for doc, pieces in by_doc.items():
        ids = encoded[doc]
        assert all(p.doc_tokens == len(ids) for p in pieces)
        covered = np.zeros(len(ids), int)
        for p in pieces:
            covered[p.start:p.start + p.length] += 1
            assert zlib.crc32(ids[p.start:p.start + p.length].tobytes()) == p.ids_crc32
        assert (covered == left[doc]).all()
    for places in by_sequence.values():
        places.sort()
        end = 0
        for offset, size in places:
            assert offset == end and size > 0
            end += size
        assert end <= length and end & (end - 1) == 0


def test_query(spark, duck):
    rows = queries.QUERIES["op12_column_generation"](spark, DATA).collect()
    texts = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    check(rows, texts)
    # most documents that fit into a sequence stay whole
    sizes = {r.doc_id: r.doc_tokens for r in rows}
    pieces = collections.Counter(r.doc_id for r in rows)
    short = [d for d, n in sizes.items() if n <= 2048]
    assert sum(pieces[d] == 1 for d in short) > 0.5 * len(short)


def test_odd_tables(spark):
    """Very long and empty texts, nulls, repeated rows, no rows."""
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choices(["alpha", "beta", "naïve", "☃", "x1", "\n"], k=n))
    tables = [[(1, "word " * 30_000), (2, ""), (None, "last"), (3, "last"), (3, "last")],
              [(k, text(rng.choice([0, 1, 5, 60, 700, 3000]))) for k in range(120)] + [(500, "same text here")] * 40]
    for table in tables:
        df = spark.createDataFrame(table, "doc_id long, text string").selectExpr("*", "1 AS class", "2 AS length", "'a' AS ids", "3 AS pos", "4 AS before")
        check(cutting.cut_and_packed(df).collect(), table)
    assert cutting.cut_and_packed(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_knapsack():
    rng = np.random.default_rng(0)
    sizes, values = np.array([3, 5, 7, 11]), rng.random(4)
    best, _ = cutting.knapsack(values, sizes, 24)
    for total in range(25):
        fits = [c for c in itertools.product(range(9), range(5), range(4), range(3)) if np.dot(c, sizes) == total]
        assert best[total] == pytest.approx(max((np.dot(c, values) for c in fits), default=-np.inf))


@pytest.mark.parametrize("seed", range(3))
def test_linear_program(seed):
    """Demands are met exactly; the cost is close to the tokens and not below the tokens."""
    rng = np.random.default_rng(seed)
    bounds = cutting.class_bounds(256)
    demand = rng.integers(0, 1000, len(bounds)) * (rng.random(len(bounds)) < 0.6)
    used = demand > 0
    columns, cost, amount = cutting.column_generation(demand[used], bounds[used], 256)
    table = np.array(columns)
    assert np.allclose(amount @ table, demand[used]) and (amount >= 0).all()
    assert all(t @ bounds[used] <= 256 and (c == 256 or t @ bounds[used] == c) for t, c in zip(table, cost))
    tokens = int(demand @ bounds)
    assert tokens - 1e-6 <= amount @ cost <= 1.02 * tokens


def test_plan_leaves_enough():
    rng = np.random.default_rng(1)
    bounds = cutting.class_bounds(2048)
    demand = rng.integers(0, 5000, len(bounds))
    plan = cutting.rounded_plan(demand, bounds, 2048)
    assert (plan.taken <= demand).all() and plan.taken.sum() > 0.9 * demand.sum()
