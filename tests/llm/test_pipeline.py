"""The whole pipeline against a step-by-step version in plain Python."""
import collections
import re

from conftest import DATA
from test_brute_force import WORD, linked_components

import __spark_entry__ as entry
import corpus_pipeline
from atrium.llm import mixing, packing, quality


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_run(spark, duck):
    rows = duck.execute("SELECT doc_id, coalesce(text, ''), source FROM documents ORDER BY doc_id").fetchall()
    kept = {r.doc_id for r in quality.weak_label_scores(spark.read.parquet(f"{DATA}/documents.parquet")).filter("kept").collect()}
    seen, left = set(), {}
    for d, t, s in rows:
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", t)
        if d in kept and norm not in seen:
            seen.add(norm)
            left[d] = (t, s)
    component = linked_components({d: t for d, (t, _) in left.items()})
    left = {d: v for d, v in left.items() if component[d][1] == d}
    words = {d: len(WORD.findall(t)) for d, (t, _) in left.items()}
    total = collections.Counter()
    for d, (_, s) in left.items():
        total[s] += words[d]
    got = corpus_pipeline.run(spark, DATA).collect()
    assert {r.doc_id for r in got} <= set(left)
    sequences = collections.Counter()
    for r in got:
        sequences[r.sequence_id] += r.length
    assert max(sequences.values()) <= 2048 and len(sequences) <= 1.03 * -(-sum(sequences.values()) // 2048) + 1
    # whole documents as often as they come; one document of a source may be cut, at the end of one of its words
    coder, got_ids, cut = packing.Tokens(), collections.Counter(), []
    for r in got:
        got_ids[r.doc_id] += r.length
    taken = collections.Counter()
    for d, n in got_ids.items():
        text, source = left[d]
        whole, rest = divmod(n, len(coder.encode(text)) // 4 + 1)
        taken[source] += whole * words[d]
        if rest:
            ends = [m.end() for m in WORD.finditer(text)]
            at = next(k for k, z in enumerate(ends, 1) if len(coder.encode(text[:z])) // 4 + 1 == rest)
            taken[source] += at
            cut.append(source)
    assert len(cut) == len(set(cut))
    names = sorted(total)
    weight, full = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, set()
    while True:  # share again what full sources leave
        rest = 1.5 * sum(total.values()) - sum(2 * total[s] for s in full)
        share = {s: 2 * total[s] if s in full else rest * weight[s] / sum(weight[t] for t in names if t not in full) for s in names}
        above = {s for s in names if share[s] > 2 * total[s] + 1e-6}
        if not above:
            break
        full |= above
    assert all(abs(taken[s] - share[s]) <= 2 for s in names), (taken, share)
    # every source is mixed in its target: documents left out belong to sources whose target is below their size
    short = {left[d][1] for d in left if d not in {r.doc_id for r in got}}
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(total))}
    assert all(weights[s] < 3 for s in short)


def test_cut_text_keeps_its_spacing(spark):
    text = "  one\n\n two\tthree  \r\nfour "
    rows = spark.createDataFrame([(text, n) for n in range(6)], "text string, n long")
    got = {r.n: r.t for r in rows.select("n", mixing.first_words(rows.text, rows.n).alias("t")).collect()}
    assert got == {0: "", 1: "  one", 2: "  one\n\n two", 3: "  one\n\n two\tthree", 4: "  one\n\n two\tthree  \r\nfour", 5: "  one\n\n two\tthree  \r\nfour"}
