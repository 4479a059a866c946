"""Best-fit packing by sum of squares: documents as token pieces, pieces into sequences of fixed length.

A piece goes where the sum over residual gaps of (open bins with that gap)^2 becomes smallest. Pieces are dealt by a hash
into groups of about ``GROUP_PIECES``, each packed in one task; a group ends with a few open sequences.
"""
from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, saved

SEQUENCE = 2048
GROUP_PIECES = 50_000
CACHED_WORDS = 400_000
END_ID = 0
END_OF_TEXT = "<|endoftext|>"


class Tokens:
    """Token ids of texts with the vocabulary of ``byte_bpe_50k.json``, as little-endian unsigned 32-bit bytes.

    A space between two characters that are not white space always starts a token, so a text's ids are those of its
    space-separated stretches in turn, and those of a word are looked up. The rank file of the same vocabulary encodes new
    words; a text that contains the special token's string goes through the JSON file's own encoder."""

    def __init__(self):
        import base64

        import public_tokenizers as files
        import tiktoken
        with open(files.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._encode = tiktoken.Encoding("ranks", pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._json = files.path("byte_bpe_50k.json")
        self._special = None
        self._words: dict[str, bytes | None] = {}
        (self._line,) = self._encode("\n")

    def raw(self, text: str) -> bytes:
        return array("I", self._encode(text)).tobytes()

    def _learn(self, words: list[str]):
        """Note the ids of a space and each word (None: its ends are not clear of white space), in one call.

        A line feed between words is a token of its own, so the ids fall apart at it."""
        if len(self._words) >= CACHED_WORDS:
            self._words.clear()
        plain = []
        for w in words:
            if not w or w[0].isspace() or w[-1].isspace():
                self._words[w] = None
            elif "\n" in w:
                self._words[w] = self.raw(" " + w)
            else:
                plain.append(w)
        if plain:
            ids = np.array(self._encode("\n".join([" " + w for w in plain])), dtype="<u4")
            cuts = np.flatnonzero(ids == self._line).tolist()
            raw, a = ids.tobytes(), 0
            for w, z in zip(plain, [*cuts, len(ids)]):
                self._words[w] = raw[4 * a:4 * z]
                a = z + 1

    def encode(self, text: str) -> bytes:
        if END_OF_TEXT in text:
            if self._special is None:
                from tokenizers import Tokenizer
                self._special = Tokenizer.from_file(self._json)
            return array("I", self._special.encode(text, add_special_tokens=False).ids).tobytes()
        words = text.split(" ")
        known = self._words
        new = [w for w in words if w not in known]
        if new:
            self._learn(list(dict.fromkeys(new)))
            if any(w not in known for w in words):  # the store was emptied meanwhile
                return self.raw(text)
        found = [known[w] for w in words]
        if None in found:
            return self._mixed(words, found)
        found[0] = self.raw(words[0])  # no space before it
        return b"".join(found)

    def _mixed(self, words: list[str], found: list) -> bytes:
        """Words on both sides of an unclear boundary are encoded together."""
        out, held = [], 0
        for k in range(1, len(words) + 1):
            if k == len(words) or (words[k - 1][-1:].strip() and words[k][:1].strip()):
                alone = held and k == held + 1 and found[held] is not None
                out.append(found[held] if alone else self.raw((" " if held else "") + " ".join(words[held:k])))
                held = k
        return b"".join(out)


def token_pieces(df: DataFrame, length: int = SEQUENCE, ids: bool = False) -> DataFrame:
    """Pieces of the token ids of (doc_id, text), each document ended by id 0: doc_id, piece, start, length, ids_crc32
    and, if asked, the ids themselves as an array.

    Documents of at most ``length`` ids stay whole; of longer ones the first piece holds the remainder. Null text is empty
    and gives one piece with the end id alone; repeated rows are documents of their own."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Tokens()
        end = np.array([END_ID], dtype="<u4").tobytes()
        for b in batches:
            cols: list[list] = [[] for _ in range(6 if ids else 5)]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                raw = coder.encode(text.as_py() or "") + end
                n = len(raw) // 4
                first = n if n <= length else (n % length or length)
                bounds = [0, *range(first, n + 1, length)]
                for k, (a, z) in enumerate(zip(bounds, bounds[1:])):
                    part = raw[4 * a:4 * z]
                    values = (doc, k, a, z - a, zlib.crc32(part)) + ((np.frombuffer(part, "<u4").astype(np.int32),) if ids else ())
                    for c, v in zip(cols, values):
                        c.append(v)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names[:len(cols)])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, schema)


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every size, placed in turn where the sum of squared gap counts grows least (ties: least gap)."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap; full and unused bins are not open
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = 0
    for i, s in enumerate(sizes.tolist()):
        if s >= capacity:
            bins[i], used = used, used + 1
            continue
        here = count[s:capacity]
        growth = np.where(here > 0, 2 * (count[:capacity - s] - here) + 2, 1 << 60)
        if here[0]:
            growth[0] = 1 - 2 * here[0]  # an exact fit opens no new gap
        g = int(growth.argmin())
        if growth[g] <= 2 * count[capacity - s] + 1:
            gap = g + s
            b = stacks[gap].pop()
            count[gap] -= 1
        else:
            gap, b, used = capacity, used, used + 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > s:
            stacks[gap - s].append(b)
            count[gap - s] += 1
    return bins, offsets


def packed(pieces: DataFrame, length: int = SEQUENCE) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32, ...).

    Within a group pieces come by falling length, so that short ones close the gaps that long ones leave. Offsets are
    gapless from 0. A group is dealt by a hash of all of a piece's values; its size does not depend on the data's."""
    groups = max(1, -(-pieces.count() // GROUP_PIECES))
    schema = f"{pieces.schema.simpleString()[7:-1]}, sequence_id long, offset long".replace(":", " ")

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("ids_crc32", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])
        bins, offsets = sum_of_squares(table.column("length").to_numpy(), length)
        ids = bins + (np.int64(table.column("dealt")[0].as_py()) << np.int64(32))
        return table.drop_columns(["dealt"]).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets))

    dealt = pieces.withColumn("dealt", F.pmod(F.xxhash64("doc_id", "piece", "length", "ids_crc32"), F.lit(groups)))
    return dealt.groupBy("dealt").applyInArrow(place, schema)


def op5_sum_of_squares(spark, sf_dir):
    return packed(saved(token_pieces(documents(spark, sf_dir)), "pieces"))
