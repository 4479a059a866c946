"""The n-gram Jaccard join: a task that compares the first shingles of a bucket needs little more than the bucket itself."""
import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa

from atrium.llm import jaccard

BUCKETS, BUCKET = 8, 3


class Kernels:
    """Stands in for a table and keeps the kernels that a step hands over."""

    def __init__(self):
        self.kept = []

    def select(self, *a):
        return self

    groupBy = select

    def mapInArrow(self, f, schema):
        self.kept.append(f)
        return self

    applyInArrow = mapInArrow


def meet(table):
    step = Kernels()
    jaccard.plausible(step, BUCKETS)
    return step.kept[1](table)


def bucket(pieces, sets, tokens, seed=5):
    """Rows as the blocks of the input send them: sets, their counts, tokens in order, owners (some without)."""
    rng, low = np.random.default_rng(seed), (BUCKET << 61) + 1
    pool = rng.integers(low, low + (1 << 61) - 2, pieces * tokens, dtype=np.uint64)
    rows = defaultdict(list)
    for k in range(pieces):
        own = np.unique(rng.choice(pool, tokens))
        refs = rng.integers(0, sets, len(own)).astype(np.uint16)
        refs[rng.random(len(own)) < 0.1] = jaccard.SHARED
        ids = rng.integers(1, 1 << 63, sets, dtype=np.uint64)
        for name, v in zip(("ids", "hits", "tokens", "refs"), (ids, rng.integers(0, 3, sets).astype(np.uint32), own, refs)):
            rows[name].append(v)
    return rows


def table(rows):
    n = len(rows["ids"])
    return pa.table({"bucket": pa.array([BUCKET] * n, pa.int64()), **{c: pa.array([v.tobytes() for v in rows[c]], pa.binary()) for c in ("ids", "hits", "tokens", "refs")}})


def counted(rows):
    seen = defaultdict(set)
    total = defaultdict(int)
    for k, (ids, hits, tokens, refs) in enumerate(zip(rows["ids"], rows["hits"], rows["tokens"], rows["refs"])):
        for i, h in zip(ids.tolist(), hits.tolist()):
            total[i] += h
        for t, r in zip(tokens.tolist(), refs.tolist()):
            seen[t].add((k, None) if r == jaccard.SHARED else int(ids[r]))
    for owners in seen.values():
        if len(owners) > 1:
            for o in owners:
                if not isinstance(o, tuple):
                    total[o] += 1
    return {i: n for i, n in total.items() if n}


def result(out):
    ids, hits = (np.concatenate([np.frombuffer(v, kind) for v in out.column(c).to_pylist()]) for c, kind in (("ids", np.uint64), ("hits", np.int64)))
    return dict(zip(ids.tolist(), hits.tolist()))


def test_bucket_is_counted_whole_in_slices(spark, monkeypatch):
    rows = bucket(12, 20, 400)
    want = counted(rows)
    for size in (1, 7, 300, 1_000_000):
        monkeypatch.setattr(jaccard, "SLICE_SHINGLES", size)
        assert result(meet(table(rows))) == want


def test_empty_pieces_count(spark):
    rows = bucket(3, 5, 20)
    rows["tokens"][1], rows["refs"][1] = rows["tokens"][1][:0], rows["refs"][1][:0]
    assert result(meet(table(rows))) == counted(rows)


def test_memory_stays_near_the_bucket(spark):
    t = table(bucket(40, 1000, 50_000))
    tracemalloc.start()
    meet(t)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.5 * t.nbytes
