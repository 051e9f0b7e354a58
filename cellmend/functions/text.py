"""Text helpers: q-grams (M5), and the structure that a regular expression gives."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def qgrams(text: Column, q: int) -> Column:
    """The substrings of q characters; a text of at most q is its only one, null has none."""
    if q <= 0:
        raise ValueError(f"`q` must be positive, not {q}")
    parts = F.transform(F.sequence(F.lit(1), F.length(text) - q + 1), lambda i: F.substring(text, i, F.lit(q)))
    return F.when(text.isNull(), F.expr("cast(array() as array<string>)")).when(F.length(text) > q, parts).otherwise(F.array(text))


#: The tokens of the subset of regular expressions whose structure is used, longest first.
_SYMBOL = r"(?:\[(?:[A-Za-z0-9](?:-[A-Za-z0-9])?)+\]|[A-Za-z0-9])"
_TOKENS = re.compile(rf"(?P<range>{_SYMBOL}\{{(?:\d+(?:,\d*)?|,\d+)\}})|(?P<class>\[(?:[A-Za-z0-9](?:-[A-Za-z0-9])?)+\])|(?P<constant>(?:[A-Za-z0-9 _%-](?!\{{))+)|(?P<sign>[.*+?|])|(?P<skip>[\t\r\n]+)")


def structure(regex: str) -> list[tuple[str, str]]:
    """(kind, text) parts: "edge" for ^ and $, "range" for counted classes, "constant" for text.

    Other parts of the subset have no structure and are left out; what isn't in the subset
    raises ValueError.
    """
    body = regex.strip("\t\r\n")
    head, tail = body.startswith("^"), body.endswith("$")
    body = body[head : len(body) - tail]
    out, at = [("edge", "^")] if head else [], 0
    while at < len(body):
        m = _TOKENS.match(body, at)
        if m is None:
            raise ValueError(f"no structure in {regex!r} from {body[at:]!r}")
        if m.lastgroup in ("range", "constant"):
            out.append((m.lastgroup, m[0]))
        at = m.end()
    return [*out, ("edge", "$")] if tail else out


def restored(text: Column, regex: str) -> Column:
    """The text with the constants of the regular expression in place of as many characters or
    fewer; null where its ranges aren't found, or where the expression has no structure."""
    try:
        parts = structure(regex)
    except ValueError:
        return F.lit(None).cast("string")
    pattern = "".join(f"({t})" if kind == "range" else f".{{1,{len(t)}}}" if kind == "constant" else t for kind, t in parts)
    pieces, group = [], 0
    for kind, t in parts:
        if kind == "range":
            group += 1
            pieces.append(F.regexp_extract(text, pattern, group))
        elif kind == "constant":
            pieces.append(F.lit(t))
    return F.when(text.rlike(pattern), F.concat(*pieces)) if pieces else F.lit(None).cast("string")
