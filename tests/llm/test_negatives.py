"""Hard negatives against plain integer arithmetic: given table, odd rows, forced splits, signed lists, stopping."""
import random

import numpy as np
import pytest
from conftest import DATA

from atrium.llm import negatives, queries


def plain(table, every=100):
    rows = {}
    for vec_id, vector, label in table:
        if vec_id is None or label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        v = [int(np.floor(256 * float(x))) for x in vector]
        rows[vec_id] = min(rows.get(vec_id, (label, v)), (label, v))
    out = set()
    for a, (label, v) in rows.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, m) for i, (m, w) in rows.items() if i != a)
        for p, i, _ in [s for s in scored if s[2] == label][:5]:
            ok = [(n, j) for n, j, m in scored if m != label and 80 * -p <= 100 * -n <= 100 * -p][:5]
            out |= {(a, i, k, j, -p, -n) for k, (n, j) in enumerate(ok, 1)}
    return out


def result(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query(spark, duck):
    table = duck.execute("SELECT vec_id, embedding, label FROM embeddings").fetchall()
    got = result(queries.QUERIES["op11_threshold_negatives"](spark, DATA))
    assert got == plain(table) and got


@pytest.mark.parametrize("block,batch", [(7, 2), (50, 4096)])
def test_odd_rows(spark, monkeypatch, block, batch):
    """Few distinct components (many ties), zero and negative anchors, missing values, repeated ids, unequal lengths."""
    monkeypatch.setattr(negatives, "BLOCK_ROWS", block)
    monkeypatch.setattr(negatives, "BATCH_ANCHORS", batch)
    rng = random.Random(block)
    table = [(rng.choice([k, k, k // 2, 100 * (k % 9)]), [rng.choice([-1.5, 0.0, 0.01, 0.5, 1.0, 2.0]) for _ in range(rng.choice([3, 3, 3, 0, 5]))],
              rng.randrange(3)) for k in range(400)]
    table += [(600, [0.0, 0.0, 0.0], 1), (700, [-1.0, -2.0, 0.5], 2), (800, None, 1), (900, [1.0, None], 1), (901, [float("nan")], 1),
              (902, [float("inf")], 1), (903, [1.0], None), (None, [1.0, 1.0, 1.0], 1), (1000, [2.0, 2.0, 2.0], 77), (5, [1.0, 1.0, 1.0], 1), (5, [1.0, 1.0, 1.0], 1)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS block", "2 AS batch", "3 AS rank", "4 AS v")
    got = result(negatives.hard_negatives(df))
    assert got == plain(table) and got


def test_no_rows(spark):
    assert negatives.hard_negatives(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_reading_stops_early():
    """Where the best rows stand out, lists are left long before their end, and the result is that of a full scan."""
    rng = np.random.default_rng(3)
    v = rng.integers(-20, 20, (4000, 16))
    anchor = rng.integers(-300, 300, 16)
    v[:40] += anchor
    lists, ids, labels = negatives.Lists(v), np.arange(4000), np.zeros(4000, int)
    met = sum(len(fresh) for fresh, t in lists.depths(anchor) if t >= np.sort(v @ anchor)[-5])
    best = negatives.positives_of(lists, ids, labels, anchor, -1, 0, 5)
    order = np.lexsort((ids, -(v @ anchor)))[:5]
    assert best.ids.tolist() == ids[order].tolist() and met < 3000


def test_large_components_stay_integers():
    v = np.array([[1 << 30, 1], [1 << 30, 2], [-5, 1 << 30]], np.int64)
    lists = negatives.Lists(v)
    a = np.array([(1 << 30) + 1, 1], np.int64)
    assert lists.scores(np.arange(3), a).tolist() == [int(x) * int(a[0]) + int(y) for x, y in v]
