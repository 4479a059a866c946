"""Conversation repair against a plain search over all cheapest edits, chunked and whole."""
import collections
import hashlib
import heapq
import random
import re
import zlib

import pytest
from conftest import DATA

from atrium.llm import queries, repair

SPACE = "\x20\t\n\x0b\x0c\r"
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}  # role initials that may follow


def cheapest(rows):
    """(cost, audit, repaired lines) by Dijkstra on (cost, audit) over (row, last initial); rows are (role, text, gone, truncated)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, k, last, lines = heapq.heappop(heap)
        if (k, last) in done:
            continue
        done.add((k, last))
        if k == len(rows) and last in ("", "a"):
            return cost, audit, lines
        give = "a" if last == "u" else "u"
        name = {"u": "user", "a": "assistant"}[give]
        heapq.heappush(heap, (cost + 2, audit + "I", k, give, (*lines, name + ":")))
        if k < len(rows):
            role, text, gone, cut = rows[k]
            heapq.heappush(heap, (cost + 3, audit + "D", k + 1, last, lines))
            if not gone:
                if role[:1] and role[:1] in NEXT[last]:
                    heapq.heappush(heap, (cost + cut, audit + "K", k + 1, role[:1], (*lines, f"{role}:{text}")))
                heapq.heappush(heap, (cost + 2 + cut, audit + "R", k + 1, give, (*lines, f"{name}:{text}")))


def plain(table):
    groups = collections.defaultdict(list)
    for conv, turn, role, text in table:
        rows = groups[conv]
        name = ":".join(" " if v is None else str(v) for v in (conv, turn))
        kind = zlib.crc32(name.encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        rows += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults, count = set(), [], collections.Counter()
        for _, role, text in rows:
            bare = text.rstrip(SPACE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            count[fault] += 1
            faults.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [t for t, _, _ in rows if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, lines = cheapest(faults)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count["blank"], count["duplicate"], count["truncated"], illegal, cost,
                     audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def result(df):
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}


def test_query(spark, duck):
    table = duck.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    assert result(queries.QUERIES["op13_auction_repair"](spark, DATA)) == plain(table)


@pytest.mark.parametrize("chunk", [1, 3, 1024])
def test_odd_conversations(spark, monkeypatch, chunk):
    """Unknown roles, nulls everywhere, equal rows, long conversations over several chunks and tasks."""
    monkeypatch.setattr(repair, "CHUNK", chunk)
    rng = random.Random(chunk)
    table = []
    for conv in [*range(60), None]:
        for k in range(rng.choice([0, 1, 2, 5, 9, 40]) if conv else 150):
            table.append((conv, rng.choice([k, k, k // 2, None]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "Über"]),
                          rng.choice(["A. ", "b", "", " \n", None, f"Text {k}.", f"ends {k}"])))
    table += [(7, 3, "user", "Same text.")] * 9
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS n", "2 AS first", "3 AS cost", "4 AS done")
    assert result(repair.repaired(df)) == plain(table)


def test_no_rows(spark):
    assert repair.repaired(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_auction_prices():
    """Prices are exact at every node, entry to exit costs agree with them, and the trace costs what the price says."""
    rng = random.Random(1)
    for _ in range(200):
        codes = "".join(rng.choices("suaoSUAOx", k=rng.randrange(1, 9)))
        m, prices = repair.transfer(codes), repair.converge(codes, repair.GOAL)
        for q in range(4):
            assert prices[0][q] == min(m[q][e] + repair.GOAL[e] for e in range(4))
            edits, end = repair.trace(codes, prices, q)
            assert repair._cost(edits, codes) + repair.GOAL[end] == prices[0][q] and repair._exit_state(edits, codes, q) == end


def test_long_conversation_is_fast():
    codes = "uU" * 100_000
    cost, edits = repair.whole(codes)
    assert cost == 300_000 and len(edits) >= len(codes)
