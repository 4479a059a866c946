"""Personal data behind disguises: transducers rewrite the text and keep, for every rewritten character, its source span.

Rewrites: look-alike and full-width characters, characters without width, spelled digits, and at / dot disguises. The
identifiers found in the rewritten text are mapped back to the source characters.
"""
from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents
from .secrets import digest

KINDS = ("email", "ip", "card", "phone")
# The plain rules are EMAIL [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ and IP [0-9]+(\.[0-9]+){3}; both are written so that a
# long run is read once: an address grows from its @ outwards, and a number starts where its run of digits does.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Look-alikes by the Latin letter they stand for (Cyrillic and Greek).
LOOKALIKES = {"a": "аα", "c": "сϲ", "d": "ԁ", "e": "е", "h": "һ", "i": "іι", "j": "јϳ", "k": "κ", "l": "ӏ", "m": "м", "n": "ո", "o": "оο",
              "p": "рρ", "q": "ԛ", "s": "ѕ", "t": "т", "u": "υ", "v": "ν", "w": "ԝ", "x": "хχ", "y": "уγ", "A": "АΑ", "B": "ВΒ", "C": "СϹ",
              "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ",
              "Y": "ҮΥ", "Z": "Ζ", "@": "﹫", ".": "․。｡", "-": "‐‑‒–−", " ": "  "}
# Spelled digits (English, German, French, Spanish).
DIGIT_WORDS = {"zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
               "null": 0, "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
               "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
               "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9}
# Last parts of host names by which an address in plain words (name at host dot com) is known: country codes, generic and reserved ones.
HOST_ENDS = frozenset((
    "ac ad ae af ag ai al am ao aq ar as at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bw by bz ca cc cd cf cg ch ci ck cl cm cn co cr cu cv cw cx "
    "cy cz de dj dk dm do dz ec ee eg er es et eu fi fj fk fm fo fr ga gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im in io iq "
    "ir is it je jm jo jp ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md me mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx my mz na "
    "nc ne nf ng ni nl no np nr nu nz om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si sk sl sm sn so sr ss st su sv sx sy "
    "sz tc td tf tg th tj tk tl tm tn to tr tt tv tw tz ua ug uk us uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw "
    "com org net edu gov mil int info biz name pro mobi aero coop museum jobs post tel travel cat asia arpa academy agency app apps art audio auto bank bar beer "
    "berlin best bike bio blog build business buzz cafe camp capital car cards care cars cash center chat church city cloud club codes coffee community company "
    "consulting contact cool courses credit data dating deals dental design dev digital direct directory doctor earth education email energy engineer engineering "
    "events exchange expert express family fan farm fashion film finance fit fitness fun fund fyi gallery game games garden gift global gmbh gold golf group guide guru "
    "health help homes host hosting hotel house icu inc ink institute international investments land law legal life link live loan lol london love ltd market "
    "marketing media men moe money movie network news ninja nyc one online page paris partners parts party photo photography photos pics pizza plus press "
    "productions promo pub radio red rent repair report rest restaurant review reviews rip rocks run sale school science services sexy shop shopping show site ski "
    "social software solar solutions space store stream studio style support surf systems tax team tech technology tips today tokyo tools top tours town toys trade "
    "training tube university vip video vision watch website wedding wien wiki win wine work works world wtf xxx xyz yoga zone "
    "example test invalid localhost onion local").split())
WIDTHLESS = "​‌‍⁠﻿­"

CHARACTER = {x: latin for latin, likes in LOOKALIKES.items() for x in likes} | {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | dict.fromkeys(WIDTHLESS, "")
ODD = re.compile("[" + "".join(map(re.escape, CHARACTER)) + "]")
_WORD = "(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + ")"
_DIGIT = rf"(?:{_WORD}(?![^\W_])|[0-9])"
_GAP = r"(?:[\s,;()-]+|(?<=[0-9]))"
_BRACKET_DOT = r"[\(\[\{<]\s*(?:\.|dot|punkt|point|punto)\s*[\)\]\}>]"
_SPOKEN_DOT = r"(?<![^\W\d_])(?:dot|punkt|point|punto)(?![^\W\d_])"
_STOP = rf"(?:[\s,;]*(?:{_BRACKET_DOT}|\.|{_SPOKEN_DOT})[\s,;]*)"
# Runs of digits, spelled or not, with gaps and stops between them.
SPELLED = re.compile(rf"(?<![^\W_])(?:(?:plus\s+|\+\s*))?{_DIGIT}(?:(?:{_GAP}|{_STOP}){_DIGIT})+", re.IGNORECASE)
TOKEN = re.compile(rf"(?P<word>{_WORD})(?![^\W_])|(?P<digit>[0-9]+)|(?P<plus>plus\b|\+)|(?P<stop>{_STOP})|(?P<gap>[\s,;()-]+)", re.IGNORECASE)
SPOKEN = re.compile(r"[^\W\d_]|[\(\[\{<]\s*\.")
WIDE = re.compile(r"[^\x20-]")
# A single digit word after a whole plain number that reads as an article or a start of prose (+1 848 555 1373 Un jour).
ARTICLES = ("uno", "one", "un", "oh")
PROSE = re.compile(r"\s+[^\W\d_]")
AT = r"(?:\s*[\(\[\{<]\s*(?:at|@)\s*[\)\]\}>]\s*|\s+at\s+|\s*@\s*)"
DOT = r"(?:\s*[\(\[\{<]\s*(?:dot|\.)\s*[\)\]\}>]\s*|\s+dot\s+|\.)"
_NAME = r"[A-Za-z0-9_%+-]+"
# A disguised address is read from its at sign: the name before it backwards, the host behind it forwards.
AT_SIGN = re.compile(r"[\(\[\{<]\s*(?:at|@)\s*[\)\]\}>]|(?<=\s)at(?=\s)|@", re.IGNORECASE)
_DOT_BACK = r"(?:\s*[\)\]\}>]\s*(?:tod|\.)\s*[\(\[\{<]\s*|\s+tod\s+|\.)"
NAME_BACK = re.compile(rf"{_NAME}(?:{_DOT_BACK}{_NAME})*", re.IGNORECASE)
WORDED_HOST = re.compile(rf"[A-Za-z0-9-]+(?:{DOT}[A-Za-z0-9-]+)+", re.IGNORECASE)
DOTS = re.compile(DOT, re.IGNORECASE)
SPACES = re.compile(r"\s*")
BRACKETED = re.compile(r"[\(\[\{<]\s*(?:at|@|dot|\.)\s*[\)\]\}>]|\sdot\s", re.IGNORECASE)


def luhn(digits: str) -> bool:
    d = [int(c) for c in digits[::-1]]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost addresses: an @ with a name before it, which begins behind the last address, and a host behind it."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        name = text[free:at]
        start = free + len(name.rstrip(LOCAL))
        host = HOST.match(text, at + 1) if start < at else None
        free = at + 1
        if host:
            out.append((start, host.end()))
            free = host.end()
        at = text.find("@", free)
    return out


def small_number(part: str) -> bool:
    return len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Undisguised identifiers: leftmost matches by kind, failing ones dropped."""
    out = [("email", *span) for span in emails(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(map(small_number, m.group().split(".")))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(d := digits(m.group())) <= 19 and luhn(d)]
    return out + ([("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m.group())) <= 15] if "+" in text else [])


class Rewritten:
    """A text in which stretches were replaced, with the source span of every character."""

    def __init__(self, text: str):
        self.text = text
        self.starts = list(range(len(text)))
        self.ends = list(range(1, len(text) + 1))

    def replace(self, edits: list[tuple[int, int, str]]):
        """Replace disjoint stretches (start, end, new) in rising order; each new character stands for its whole stretch."""
        parts, starts, ends, done = [], [], [], 0
        for a, z, new in edits:
            parts += [self.text[done:a], new]
            starts += self.starts[done:a] + [self.starts[a]] * len(new)
            ends += self.ends[done:a] + [self.ends[z - 1]] * len(new)
            done = z
        self.text = "".join([*parts, self.text[done:]])
        self.starts, self.ends = starts + self.starts[done:], ends + self.ends[done:]
        return self

    def source(self, a: int, z: int) -> tuple[int, int]:
        return self.starts[a], self.ends[z - 1]


def ip_ranges(tokens: list[tuple]) -> list[tuple[int, int]]:
    """Token ranges (first, end) of four groups of digits up to 255 with three stops, of which a digit or a stop is spelled or bracketed.

    Digits of a group may stand apart (one nine two); the outer groups take what lies nearest to their stop. A full stop
    with white space on one side only ends a sentence, unless the run has two spelled digits and seven in all."""
    groups, stops = [[]], []
    for at, (kind, _, _, s, _) in enumerate(tokens):
        if kind in ("word", "digit"):
            groups[-1].append(at)
        elif kind == "stop":
            stops.append(s)
            groups.append([])
    value = lambda part: "".join(tokens[t][4] for t in sorted(part))
    gap = lambda t, u: "".join(x[3] for x in tokens[min(t, u) + 1:max(t, u)])
    small = lambda part: part and int(value(part)[-4:]) <= 255 and not value(part)[:-4].strip("0")
    fits = lambda part: small(part) and (len(part) == 1 or len(value(part)) <= 3)
    loose = sum(x[0] == "word" for x in tokens) >= 2 and sum(len(x[4]) for x in tokens) >= 7

    def near(group, wide):
        part = group[:1]
        for t in group[1:]:
            alike = tokens[t][0] == tokens[part[-1]][0] and len(tokens[t][4]) == len(tokens[part[-1]][4]) == 1
            if not alike or not fits([*part, t]) or not wide and WIDE.search(gap(part[-1], t)):
                break
            part.append(t)
        return part

    out, i = [], 0
    while i + 4 <= len(groups):
        inner, between = groups[i + 1:i + 3], stops[i:i + 3]
        wide = any(WIDE.search(gap(t, u)) for g in inner for t, u in zip(g, g[1:]))
        head, tail = near(groups[i][::-1], wide), near(groups[i + 3], wide)
        all_four = loose and len(groups) == 4 and all(map(small, groups))
        if all_four:
            head, tail = groups[0], groups[3]
        clear = all(s.strip() != "." or s == "." or s[0] != "." and s[-1] != "." for s in between)
        marked = any(SPOKEN.search(s) for s in between) or any(tokens[t][0] == "word" for g in (head, *inner, tail) for t in g)
        if (all_four or all(fits(g) for g in (head, *inner, tail))) and marked and (clear or loose):
            out.append((min(head), tail[-1] + 1))
            i += 4
        else:
            i += 1
    return out


def number_ranges(tokens: list[tuple], first: int, end: int) -> list[tuple[int, int]]:
    """Token ranges within (first, end) that are a card or phone number: all of it, or else a part between wide gaps."""
    def passes(a, z):
        d = "".join(t[4] for t in tokens[a:z])
        spoken = any(k == "word" or k in ("plus", "stop") and SPOKEN.search(s) for k, _, _, s, _ in tokens[a:z])
        return spoken and (tokens[a][0] == "plus" and 8 <= len(d) <= 15 or 16 <= len(d) <= 19 and luhn(d))

    if first < end and passes(first, end):
        return [(first, end)]
    cuts = [first - 1, *[t for t in range(first, end) if tokens[t][0] == "gap" and WIDE.search(tokens[t][3])], end]
    return [(a + 1, z) for a, z in zip(cuts, cuts[1:]) if a + 1 < z and passes(a + 1, z)]


def without_article(run: str) -> str | None:
    """The run without a last word that may be an article, and the gap before it; None if it does not end so."""
    for word in ARTICLES:
        if run[-len(word):].lower() == word:
            front = run[:-len(word)]
            end = len(front)
            while end and (front[end - 1].isspace() or front[end - 1] in ",;-"):
                end -= 1
            return front[:end] if end < len(front) else None
    return None


def spelled_edits(text: str) -> list[tuple[int, int, str]]:
    """Spelled digits and disguised dots become plain where the stretch then passes the ip, card or phone rule.

    Other runs of seven digits or more, of which two or more are spelled, become plain digits too."""
    out = []
    for m in SPELLED.finditer(text):
        if not SPOKEN.search(m.group()):
            continue
        front = without_article(m.group()) if PROSE.match(text, m.end()) else None
        if front and not SPOKEN.search(front) and base_spans(front):
            continue
        tokens = []
        for t in TOKEN.finditer(m.group()):
            kind, s = t.lastgroup, t.group().lower()
            tokens.append((kind, t.start() + m.start(), t.end() + m.start(), s, str(DIGIT_WORDS[s]) if kind == "word" else s if kind == "digit" else ""))
        stops, whole = sum(k == "stop" for k, *_ in tokens), (0, len(tokens))
        number = number_ranges(tokens, *whole)
        if tokens[0][0] != "plus" and (number != [whole] or stops == 3):
            number = []
        ranges, done = [], 0
        for a, z in [*([] if number else ip_ranges(tokens)), (len(tokens), len(tokens))]:
            ranges += [(*r, tokens[0][0] == "plus" and stops == 3) for r in (number or number_ranges(tokens, done, a))]
            ranges += [(a, z, True)] * (a < z)
            done = z
        if not ranges:
            if sum(k == "word" for k, *_ in tokens) < 2 or sum(len(t[4]) for t in tokens) < 7:
                continue
            ranges = [(0, len(tokens), stops == 3)]
        for a, z, dotted in ranges:
            new = {"plus": "+", "stop": "." if dotted else "", "gap": ""}
            out += [(p, q, n) for k, p, q, s, d in tokens[a:z] if (n := d or new[k]) != s]
    return out


def host_end(name: str, host: str, plain: bool) -> int:
    """Length of the part of ``host`` that is a host name, 0 if none.

    In plain words the last part is a known ending, or two dots of the address are spoken; unknown parts behind a written full
    stop belong to the next sentence. With signs any last part of letters will do."""
    dots = list(DOTS.finditer(host))
    before = sum(m.group() != "." for m in DOTS.finditer(name))
    spoken = before + sum(m.group() != "." for m in dots)
    end = len(host)
    while dots:
        last = host[dots[-1].end():end].lower()
        word = 2 <= len(last) <= 63 and last.isalpha() or last.startswith("xn--")
        if word and (not plain or last in HOST_ENDS or dots[-1].group() != "." and spoken >= 2):
            return end
        spoken -= dots[-1].group() != "."
        end = dots.pop().start()
    return 0


def address_edits(text: str) -> list[tuple[int, int, str]]:
    """At and dot disguises of one address: the at or a dot of the host must be disguised, a bare ``at`` needs a disguised dot."""
    out, free, at = [], 0, 0
    while sign := AT_SIGN.search(text, at):
        before = text[free:sign.start()]
        stem = before.rstrip()
        back = NAME_BACK.match(stem[::-1])
        at = SPACES.match(text, sign.end()).end()
        host = WORDED_HOST.match(text, at) if back else None
        start = free + len(stem) - back.end() if back else 0
        if not host or start and text[start - 1] in LOCAL:
            free, at = sign.end(), sign.end()
            continue
        name, ends = text[start:free + len(stem)], free + len(stem)
        end = at + host_end(name, host.group(), not re.search(r"[\(\[\{<@]", text[start:host.end()]))
        if end == at or not BRACKETED.search(text, start, end) or sign.group().lower() == "at" and not BRACKETED.search(text, at, end):
            free = at
            continue
        out += [(start + t.start(), start + t.end(), ".") for t in DOTS.finditer(name)]
        out.append((ends, at, "@"))
        out += [(at + t.start(), at + t.end(), ".") for t in DOTS.finditer(text[at:end])]
        if text[end:end + 1] == ".":
            out.append((end, end + 1, " "))
            end += 1
        free = at = end
    return out


class Spans:
    """Spans by start, with the largest end so far: looks up whether any of them meets or holds a stretch."""

    def __init__(self, spans):
        self.starts, self.most = [], []
        for a, z in sorted(spans):
            self.add(a, z)

    def add(self, a: int, z: int):
        """Starts come in rising order."""
        self.starts.append(a)
        self.most.append(max(z, self.most[-1]) if self.most else z)

    def meets(self, a: int, z: int) -> bool:
        k = bisect_left(self.starts, z)
        return k > 0 and self.most[k - 1] > a

    def holds(self, a: int, z: int) -> bool:
        k = bisect_right(self.starts, a)
        return k > 0 and self.most[k - 1] >= z


def added_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Identifiers that only the rewritten text shows, as source spans that hold a rewritten stretch.

    A span that lies within a base span or an added one is dropped. One that overlaps base spans stays if it holds a whole
    one of its kind and more, or a rewritten stretch that no base span holds."""
    view, touched = Rewritten(text), []
    if ODD.search(text):
        view.replace([(m.start(), m.end(), CHARACTER[m.group()]) for m in ODD.finditer(text)])
        touched += [m.span() for m in ODD.finditer(text)]
    for edits in (spelled_edits, address_edits):
        found = edits(view.text)
        touched += [view.source(a, z) for a, z, _ in found]
        if found:
            view.replace(found)
    if not touched:
        return []
    found = [(k, *view.source(a, z)) for k, a, z in base_spans(view.text)]
    own = Spans((a, z) for _, a, z in base)
    bare, touched = Spans(s for s in touched if not own.holds(*s)), Spans(touched)
    of_kind = {k: [(a, z) for b, a, z in base if b == k] for k in KINDS}
    added = {k: Spans(()) for k in KINDS}
    out = []
    for kind, a, z in sorted(found, key=lambda s: (KINDS.index(s[0]), s[1])):
        if own.holds(a, z) or any(s.holds(a, z) for s in added.values()) or not touched.meets(a, z):
            continue
        k = bisect_left(of_kind[kind], (a, a))
        wider = k < len(of_kind[kind]) and of_kind[kind][k][1] <= z
        if not wider and own.meets(a, z) and not bare.meets(a, z):
            continue
        out.append((kind, a, z))
        added[kind].add(a, z)
    return out


def pii_spans(df: DataFrame) -> DataFrame:
    """Personal data in (doc_id, text), one row per input row: doc_id, base and added (lists of kind, start, end, in code points).

    Base spans are undisguised identifiers and stay as found; added ones are found behind disguises, do not lie
    within base spans (they may contain or overlap one) and hold at least one rewritten stretch. Null text is empty; whole texts are scanned."""
    span = "array<struct<kind:string,start:long,end:long>>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        rows = lambda spans: [{"kind": k, "start": a, "end": z} for k, a, z in spans]
        for b in batches:
            base, added = [], []
            for value in b.column(1):
                text = value.as_py() or ""
                own = base_spans(text)
                base.append(rows(own))
                disguised = BRACKETED.search(text) or SPELLED.search(text) or not text.isascii() and ODD.search(text)
                added.append(rows(added_spans(text, own)) if disguised else [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, kind), pa.array(added, kind)], names=["doc_id", "base", "added"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        scan, f"doc_id long, base {span}, added {span}")


def op7_deobfuscation(spark, sf_dir):
    return digest(pii_spans(documents(spark, sf_dir)), KINDS, KINDS, False)
