"""Secret scans: fixed patterns, and sliding-window Shannon entropy per character class with an allow-list."""
from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import documents

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
WINDOW = 20
# Character classes by what a candidate holds: (pattern of the whole candidate, least entropy in bits of some window).
CLASSES = ((re.compile(r"[0-9a-fA-F]+"), 3.0), (re.compile(r"[A-Za-z0-9]+"), 3.75), (re.compile(r"[A-Za-z0-9+/_=-]+"), 3.9))
# Candidates that are no secrets: digits or letters alone, UUIDs, words joined by separators, placeholders.
ALLOWED = re.compile(r"[0-9_=+/-]+|[A-Za-z_=+/-]+|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|(?:[A-Za-z]+[0-9]{0,4}[-_/+=]+)+(?:[A-Za-z]+[0-9]{0,4})?|"
                     r"(?i:.*(?:example|sample|dummy|placeholder|changeme|xxxxx).*)")
# Text in front of a candidate that says it is public: digests, inline images.
ALLOWED_BEFORE = re.compile(r"(?i)(?:sha(?:1|256|384|512)[-:= ]+|md5[-:= ]+|base64,)$")
# Links: the host and path parts of words and numbers are public, user information, other path parts and query values are not.
LINK_BEFORE = re.compile(r"(?i)https?://([^\s]*)$")
SLUG = re.compile(r"(?:(?:[A-Za-z]+[0-9]{0,4}|[0-9]+)[-_+]+)+(?:[A-Za-z]+[0-9]{0,4}|[0-9]+)?")
USER = re.compile(r"[^\s/?#]*@")


def window_entropy(text: str, size: int = WINDOW) -> tuple[np.ndarray, int]:
    """Entropy in bits of every window of ``size`` characters, from counts that change by one character in and one out."""
    size = min(size, len(text))
    term = [0.0] + [c * math.log2(c) for c in range(1, size + 1)]
    counts: dict[str, int] = {}
    total, out = 0.0, []
    for i, c in enumerate(text):
        n = counts.get(c, 0)
        total += term[n + 1] - term[n]
        counts[c] = n + 1
        if i >= size:
            old = text[i - size]
            n = counts[old]
            total += term[n - 1] - term[n]
            counts[old] = n - 1
        if i >= size - 1:
            out.append(math.log2(size) - total / size)
    return np.array(out), size


def candidates(text: str) -> Iterator[tuple[int, str]]:
    """Start and text of the strings to look at; those in a link are cut into its parts, the public ones left out."""
    for m in CANDIDATE.finditer(text):
        before = max(0, m.start() - 200)
        if ALLOWED_BEFORE.search(text, before, m.start()):
            continue
        first = m.start() + 2 * m.group().startswith("//")
        link = LINK_BEFORE.search(text, before, first)
        if not link:
            yield m.start(), m.group()
            continue
        query = re.search(r"[?#]", link[1])
        for k, part in enumerate(re.finditer(r"[^=]+" if query else r"[^/=]+", text[first:m.end()])):
            start = first + part.start()
            host = k == 0 and not re.search(r"[/?#]", link[1]) and not USER.match(text, start)
            if not host and (query or not SLUG.fullmatch(part.group())):
                yield start, part.group()


def entropy_spans(text: str) -> list[tuple[int, int]]:
    """Candidates of which some window is random for its class, cut to the windows that are, allow-list suppressed."""
    spans = []
    for start, value in candidates(text):
        value = value.rstrip("=")
        if len(value) < WINDOW or ALLOWED.fullmatch(value):
            continue
        limit = next((least for pattern, least in CLASSES if pattern.fullmatch(value)), None)
        if limit is None:
            continue
        bits, size = window_entropy(value)
        hot = np.flatnonzero(bits >= limit)
        if len(hot):
            spans.append((start + int(hot[0]), start + int(hot[-1]) + size))
    return spans


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= 16]


def suspects(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of a block that can hold a span: long runs of key characters (none crosses rows), or one of the words in either case."""
    rows = np.zeros(len(offsets) - 1, bool)
    letters = np.zeros(256, bool)
    letters[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_=-"]] = True
    inside = letters[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    begin[cut] |= inside[cut]
    end[cut - 1] |= inside[cut - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    hits = starts[ends - starts >= 16]
    raw = hashing.lower_ascii(data).tobytes()
    more = [m.start() for w in (*WORDS, b"akia") for m in re.finditer(re.escape(w), raw)]
    hits = np.concatenate([hits, np.array(more, np.int64)]).astype(np.int64)
    rows[np.searchsorted(offsets, hits, side="right") - 1] = True
    return rows


def secret_spans(df: DataFrame) -> DataFrame:
    """Secrets in (doc_id, text), one row per input row: doc_id, base and added (lists of kind, start, end, in code points).

    Base spans are the fixed patterns; added ones are random-looking strings outside base spans. Null text is empty. Whole
    texts are scanned; a run of any length is one candidate."""
    span = "array<struct<kind:string,start:long,end:long>>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            base: list = [[] for _ in range(b.num_rows)]
            added: list = [[] for _ in range(b.num_rows)]
            for i, data, offsets in hashing.blocks(b.column(1)):
                for k in np.flatnonzero(suspects(data, offsets)).tolist():
                    text = data[offsets[k]:offsets[k + 1]].tobytes().decode()
                    own = base_spans(text)
                    base[i + k] = [{"kind": n, "start": a, "end": z} for a, z, n in own]
                    added[i + k] = [{"kind": "entropy", "start": a, "end": z} for a, z in entropy_spans(text) if all(z <= s or a >= e for s, e, _ in own)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, kind), pa.array(added, kind)], names=["doc_id", "base", "added"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        scan, f"doc_id long, base {span}, added {span}")


def span_list(spans, kinds: tuple, by_start: bool):
    """Spans as kind:start:end, comma-joined, in order of start then kind, or of kind then start."""
    def key(s):
        rank = F.array_position(F.array(*[F.lit(k) for k in kinds]), s["kind"]).cast("int")
        order = (s["start"], rank) if by_start else (rank, s["start"])
        return F.struct(order[0].alias("a"), order[1].alias("b"), s["end"].alias("c"), s["kind"].alias("k"), s["start"].alias("s"))

    return F.array_join(F.transform(F.array_sort(F.transform(spans, key)), lambda s: F.concat_ws(":", s["k"], s["s"].cast("string"), s["c"].cast("string"))), ",")


def digest(spans_df: DataFrame, kinds: tuple, base_kinds: tuple, by_start: bool) -> DataFrame:
    """Counts by base kind, hash of the base spans and the list of all spans."""
    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return spans_df.select("doc_id", *[count(k) for k in base_kinds], F.sha2(span_list(F.col("base"), kinds, by_start), 256).alias("base_sha256"),
                           span_list(F.concat("base", "added"), kinds, by_start).alias("spans"))


def op9_entropy(spark, sf_dir):
    return digest(secret_spans(documents(spark, sf_dir)), KINDS, KINDS[:3], True)
