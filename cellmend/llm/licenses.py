"""Operator 6: license notices, exact phrases and short notices with typing errors.

Text is reduced to words (digits, small letters after A-Z are lower-cased, and everything
beyond ASCII). Exact phrases are places where their words stand consecutively. A fuzzy
notice of k allowed edits is split into k+1 seeds: by the pigeonhole principle an occurrence
has one of them unchanged. Seeds are searched exactly, and the regex library's bounded-error
matching verifies the window around each and gives the span and its edits.

Null text counts as empty: no words and no spans. Texts of any length are searched whole.
Repeated rows give equal results; extra columns are kept, those named like the new ones
are replaced. Of overlapping spans of one notice, all places of exact phrases are reported
and fuzzy ones once by their start.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass, field

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellmend.llm.common import append_columns, texts

#: The exact phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Short notices that are searched with errors, and their labels.
NOTICES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge", "mit"),
    ("licensed under the apache license", "apache"),
    ("gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("mozilla public license", "mpl"),
    ("creative commons attribution", "cc-by"),
    ("permission to use copy modify and or distribute this software", "isc"),
    ("this is free and unencumbered software", "unlicense"),
)
#: One edit is allowed for so many characters of a notice, four at most.
CHARS_AN_EDIT, MOST_EDITS = 10, 4

_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    """The maximal runs of word characters, A-Z lower-cased."""
    return text.encode().translate(_WORD).split()


@dataclass
class Notice:
    text: str
    label: str
    edits: int = field(init=False)
    seeds: list[tuple[int, bytes]] = field(init=False)

    def __post_init__(self):
        self.edits = min(MOST_EDITS, len(self.text) // CHARS_AN_EDIT)
        k = self.edits + 1
        cuts = [len(self.text) * i // k for i in range(k + 1)]
        self.seeds = [(a, self.text[a:b].encode()) for a, b in zip(cuts, cuts[1:], strict=False)]
        self.pattern = regex.compile(f"(?e)(?:{regex.escape(self.text)}){{e<={self.edits}}}".encode())

    def spans(self, joined: bytes) -> list[tuple[int, int, int]]:
        """(start, end, edits) of the occurrences in blank-joined words."""
        out: dict[int, tuple[int, int, int]] = {}
        tried = set()
        for offset, seed in self.seeds:
            at = joined.find(seed)
            while at >= 0:
                start = max(0, at - offset - self.edits)
                if start not in tried:
                    tried.add(start)
                    end = at - offset + len(self.text) + self.edits
                    if m := self.pattern.search(joined, start, min(len(joined), end)):
                        a, b, edits = *m.span(), sum(m.fuzzy_counts)
                        if a not in out or edits < out[a][2]:
                            out[a] = (a, b, edits)
                at = joined.find(seed, at + 1)
        best: list[tuple[int, int, int]] = []
        for s in sorted(out.values()):
            if best and s[0] < best[-1][1]:
                best[-1] = min(best[-1], s, key=lambda x: (x[2], x[0]))
            else:
                best.append(s)
        return best


def scan(text: str, phrases, notices: list[Notice]) -> tuple[int, list[dict], list[dict], float]:
    """The number of words; exact places; fuzzy spans; the best match's likeness (0 to 1)."""
    found = words(text)
    joined = b" " + b" ".join(found) + b" "
    places: list[int] | None = None

    def word_at(byte: int) -> int:
        nonlocal places
        if places is None:
            places, at = [], 1
            for w in found:
                places.append(at)
                at += len(w) + 1
        return max(0, bisect.bisect_right(places, byte) - 1)

    exact = []
    for phrase, label in phrases:
        key, n = b" " + phrase.encode() + b" ", len(phrase.split())
        at = joined.find(key)
        while at >= 0:
            start = word_at(at + 1)
            exact.append({"label": label, "start": start, "end": start + n, "edits": 0})
            at = joined.find(key, at + 1)
    fuzzy, score = [], float(bool(exact))
    for notice in notices:
        for a, b, edits in notice.spans(joined):
            fuzzy.append({"label": notice.label, "start": word_at(a + (joined[a : a + 1] == b" ")), "end": word_at(b - 1) + 1, "edits": edits})
            score = max(score, 1 - edits / len(notice.text))
    order = lambda x: (x["start"], x["end"], x["label"])
    return len(found), sorted(exact, key=order), sorted(fuzzy, key=order), score


def _scanner(phrases, notices):
    compiled = [Notice(*x) for x in notices]
    return lambda text: list(map(list, zip(*(scan(x, phrases, compiled) for x in texts(text)), strict=True))) or [[], [], [], []]


def scan_licenses(df: DataFrame, text_col: str = "text", phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """df with n_words, exact and fuzzy (arrays of label, start, end word and edits) and score."""
    span = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("start", "end", "edits"))]))
    fields = [T.StructField("n_words", T.LongType()), T.StructField("exact", span), T.StructField("fuzzy", span), T.StructField("score", T.DoubleType())]
    return append_columns(df, [text_col], fields, _scanner, tuple(phrases), tuple(notices))


def label_list(*spans: F.Column) -> F.Column:
    return F.array_join(F.array_sort(F.array_distinct(F.concat(*(F.transform(s, lambda x: x["label"]) for s in spans)))), ",")
