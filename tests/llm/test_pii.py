"""Personal data: base spans against the plain patterns, the query's columns by brute force, planted disguises, time on long texts."""
import hashlib
import random
import re
import time

import pytest
from conftest import DATA

from atrium.llm import pii, queries

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        twice = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(d))]
        return 16 <= len(d) <= 19 and sum(x - 9 * (x > 9) for x in twice) % 10 == 0
    return kind == "email" or 8 <= len(d) <= 15


def plain(text):
    return [(k, *m.span()) for k, p in PLAIN.items() for m in re.finditer(p, text) if passes(k, m.group())]


def test_base_spans():
    """Short texts of the characters that matter, in every order."""
    rng = random.Random(4)
    for _ in range(30_000):
        text = "".join(rng.choices("a1.@-+ 9_é0(2", k=rng.randrange(1, 24)))
        assert pii.base_spans(text) == plain(text), text
    for text in ("1.2.3.4.5.6.7.8", "0001.2.3.004", "256.1.1.1.1", "a@b.c@d.e", "x@y.z.@q.r", "4111 1111 1111 1111", "1." * 9 + "1"):
        assert pii.base_spans(text) == plain(text), text


def test_query(spark, duck):
    """Counts, hash and order of the base spans over the whole table; all spans hold the base ones and are sorted alike."""
    rows = queries.QUERIES["op7_deobfuscation"](spark, DATA).collect()
    texts = dict(duck.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        base = plain(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for k, *_ in base) for kind in PLAIN)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{z}" for k, a, z in base).encode()).hexdigest()
        spans = [(k, int(a), int(z)) for k, a, z in (s.split(":") for s in r.spans.split(",") if s)]
        assert set(base) <= set(spans) and spans == sorted(spans, key=lambda s: (list(PLAIN).index(s[0]), s[1]))
        assert spans == sorted({*base, *pii.added_spans(texts[r.doc_id], base)}, key=lambda s: (list(PLAIN).index(s[0]), s[1]))


def test_recall_of_planted_disguises():
    rng = random.Random(9)
    prose = "The garden was quiet and the gate stood open while we talked about the weather".split()
    words = "zero one two three four five six seven eight nine".split()
    found = clean = 0
    for k in range(400):
        name, host = rng.choice(["joe", "ann.lee", "info"]), rng.choice(["acme", "mail-hub", "north"])
        ip = [rng.randrange(256) for _ in range(4)]
        hidden = rng.choice([f"{name} at {host} dot com", f"{name} [at] {host} [dot] org", f"{name}@{host}.cоm", f"{name}(at){host}.net", "[.]".join(map(str, ip)),
                             " dot ".join(map(str, ip)), "+4420" + " ".join(rng.choices(words, k=8)), f"{name}＠{host}.com"])
        a, z = (" ".join(rng.choices(prose, k=8)) for _ in range(2))
        text = f"{a} {hidden} {z}"
        found += any(s < len(a) + 1 + len(hidden) and e > len(a) + 1 for _, s, e in pii.added_spans(text, pii.base_spans(text)))
        clean += not pii.added_spans(f"{a} {z}", [])
    assert found >= 0.9 * 400 and clean == 400


@pytest.mark.parametrize("text", ["a dot " * 170_000, "7" * 1_000_000, "x" * 1_000_000 + " @ a@b", "one " * 250_000, "1." * 500_000, "@" * 1_000_000,
                                  "a@" + "b." * 500_000, "1" + " " * 500_000 + "one x", "joe [at] acme dot com, " * 45_000, "jоe@acme.com " * 80_000])
def test_long_texts(text):
    """About a megabyte of what makes patterns start over: the time grows with the text."""
    began = time.process_time()
    pii.added_spans(text, pii.base_spans(text))
    assert time.process_time() - began < 20
