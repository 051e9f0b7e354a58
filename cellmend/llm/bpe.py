"""Operator 1: byte-pair encoding and decoding.

Text is cut into pieces by the byte-level pre-tokenizer's pattern. The merges of a piece are
applied from a priority queue of (merge rank, place) over a doubly linked list of symbols;
an entry whose pair has changed since it was queued is stale and skipped. Decoding
concatenates the vocabulary's byte strings.

Ids travel as BINARY, unsigned 32-bit little-endian: four bytes an id instead of an
array's object for each.

Null text encodes as empty, an empty text to no ids. Repeated rows are encoded alike; ties
of equal ranks are merged from the left. A text of any length takes O(n log n) time. Other
columns are kept; a column named like a new one is replaced.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellmend.llm.common import append_columns, texts, tokenizer_file

#: Pieces that a worker keeps encoded, in each of two generations.
CACHE = 150_000
#: Longer pieces are rare and not kept.
CACHED_CHARS = 48
#: The white space of the pattern, and letters below U+0300.
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def _ranges(points: list[int]) -> str:
    """A character class's body of sorted code points."""
    runs: list[list[int]] = []
    for p in points:
        if runs and p == runs[-1][1] + 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


def _pattern(letters: str, numbers: str) -> re.Pattern:
    return re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{letters}]+| ?[{numbers}]+| ?[^{SPACES}{letters}{numbers}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")


def _of_kind(kind: str, below: int) -> list[int]:
    return [p for p in range(below) if unicodedata.category(chr(p))[0] == kind]


@functools.cache
def _narrow() -> re.Pattern:
    """For texts whose characters are all below U+0250: a small, fast class."""
    return _pattern(_ranges(_of_kind("L", 0x250)), _ranges(_of_kind("N", 0x250)))


_WIDE_CHARACTER = re.compile("[^\x00-ɏ]")


@functools.cache
def _wide() -> re.Pattern:
    """For any text.

    The tokenizers library follows a later Unicode than Python's own tables. Code points
    that these don't know are asked of the library's pre-tokenizer, once.
    """
    import regex
    from tokenizers import pre_tokenizers

    letters, numbers = (_of_kind(k, 0x110000) for k in "LN")
    known, split = regex.compile(r"[\p{L}\p{N}]"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    for p in range(0x250, 0x110000):
        c = chr(p)
        if unicodedata.category(c) == "Cn" and known.match(c):
            if len(split(f"a{c}")) == 1:
                letters.append(p)
            elif len(split(f"1{c}")) == 1:
                numbers.append(p)
    return _pattern(_ranges(sorted(letters)), _ranges(sorted(numbers)))


def pieces(text: str) -> list[str]:
    return (_wide() if _WIDE_CHARACTER.search(text) else _narrow()).findall(text)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves; the others take the code points from 256 on.
    """
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, at = [], 256
    for b in range(256):
        out.append(chr(b if b in shown else at))
        at += b not in shown
    return out


class Vocabulary:
    """A byte-level BPE vocabulary, read from a tokenizer's JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        ids, of_byte = file["model"]["vocab"], byte_characters()
        byte_of = {c: b for b, c in enumerate(of_byte)}
        self.first = [ids[c] for c in of_byte]
        #: (left id, right id) as one number: (rank, merged id) as one number.
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(file["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[ids[a] << 32 | ids[b]] = rank << 32 | ids[a + b]
        self.special = {x["content"]: x["id"] for x in file.get("added_tokens", [])}
        self.strings = [b""] * (1 + max([*ids.values(), *self.special.values()]))
        for s, i in ids.items():
            self.strings[i] = bytes(map(byte_of.__getitem__, s))
        for s, i in self.special.items():
            self.strings[i] = s.encode()
        self.splits = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cache = Pieces(self.merge)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        symbols, find = [self.first[b] for b in piece], self.merges.get
        n = len(symbols)
        queue = [(found >> 32) << 32 | i for i in range(n - 1) if (found := find(symbols[i] << 32 | symbols[i + 1])) is not None]
        if not queue:
            return symbols
        heapq.heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            entry = pop(queue)
            i = entry & 0xFFFFFFFF
            j = after[i]
            if j >= n or symbols[i] < 0:
                continue
            found = find(symbols[i] << 32 | symbols[j])
            if found is None or found >> 32 != entry >> 32:
                continue  # stale: one of the two has been merged since
            symbols[i], symbols[j] = found & 0xFFFFFFFF, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (found := find(symbols[i] << 32 | symbols[k])) is not None:
                    push(queue, (found >> 32) << 32 | i)
            if (h := before[i]) >= 0 and (found := find(symbols[h] << 32 | symbols[i])) is not None:
                push(queue, (found >> 32) << 32 | h)
        return [s for s in symbols if s >= 0]

    def encode(self, text: str) -> bytes:
        """The ids of a text, 4 bytes each."""
        if self.splits is None or not self.splits.search(text):
            return b"".join(map(self.cache.__getitem__, pieces(text)))
        return b"".join(array("I", [self.special[part]]).tobytes() if part in self.special else b"".join(map(self.cache.__getitem__, pieces(part))) for part in self.splits.split(text))

    def decode(self, ids: bytes) -> str:
        numbers = array("I")
        numbers.frombytes(ids)
        return b"".join(map(self.strings.__getitem__, numbers)).decode("utf-8", "replace")


class Pieces(dict):
    """Encoded pieces, in two bounded generations: a full one replaces the older one."""

    def __init__(self, merge):
        super().__init__()
        self.merge, self.older = merge, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = array("I", self.merge(piece.encode())).tobytes()
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHE:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    """Read once in each Python worker, which Spark uses again for later tasks."""
    return Vocabulary(tokenizer_file(path))


def _encoder(path: str):
    v = vocabulary(path)
    return lambda text: [[v.encode(x) for x in texts(text)]]


def _decoder(path: str):
    v = vocabulary(path)
    return lambda ids: [[v.decode(x or b"") for x in ids.to_pylist()]]


def _round_trip(path: str):
    v = vocabulary(path)

    def work(text: pa.Array) -> list[list]:
        ids = [v.encode(x) for x in texts(text)]
        return [ids, [v.decode(x) for x in ids]]

    return work


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """df with the ids of its texts under the vocabulary of the file `path`, as BINARY."""
    return append_columns(df, [text_col], [T.StructField(ids_col, T.BinaryType())], _encoder, path)


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """df with the texts that its ids spell; null ids spell an empty text."""
    return append_columns(df, [ids_col], [T.StructField(text_col, T.StringType())], _decoder, path)


def round_trip(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """encode() and decode() in one pass over the rows."""
    return append_columns(df, [text_col], [T.StructField(ids_col, T.BinaryType()), T.StructField(decoded_col, T.StringType())], _round_trip, path)


def n_ids(ids_col: str) -> F.Column:
    return (F.octet_length(ids_col) / 4).cast("long")
