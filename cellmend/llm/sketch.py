"""Operator 9: threshold-scaled document sketches, in DataFrame functions only.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so its size
follows the document's, sketches of parts merge by union, and containment between very
unequal documents can be estimated. Shingles are five words, hashed without building their
strings. Texts with fewer than `LEAST` hashes below the fraction keep their `LEAST` smallest
ones, so short texts are kept whole. A sketch therefore holds all hashes up to a bound that it
tells itself: none if it is smaller than `LEAST` (the text is whole), else its largest hash or
the fraction's end, whichever is more. Two sketches are compared up to the lesser bound, so a
short text is looked for in a long one among the hashes that the long one has kept.

The next document in the order of ids comes by a window in each of many id ranges. Ranges
start at approximate quantiles, which are ids themselves; a range's first rows are copied
into the range before, so no row goes without its successor and no task gets all rows.

Null text counts as empty and has an empty sketch; a text of fewer than five words is one
shingle. Two empty sketches are alike (1), an empty one and another are not (0). Rows of
null id come first in the order; of rows that share an id, the order is by their text.
Extra columns are kept; those named like the new ones are replaced.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellmend.llm.common import col, others

WIDTH = 5
#: The kept part of the hash range is 1 / 2**SCALE_BITS; LEAST hashes are kept of any text.
SCALE_BITS, LEAST = 2, 64
_FIRST_BIT = -(1 << 63)
#: Rows of an id range, and the most ranges: their starts are kept on the driver.
RANGE_ROWS, MOST_RANGES = 1000, 10_000


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[\\x20\\x09-\\x0D]+", -1), lambda w: w != "")


def _ordered(hashes: Column) -> Column:
    """Hashes in the order of unsigned numbers, as signed ones whose first bit is flipped."""
    return F.array_sort(F.transform(hashes, lambda h: h.bitwiseXOR(F.lit(_FIRST_BIT))))


def _kept(ordered: Column, scale_bits: int, least: int) -> Column:
    """Of ascending hashes: those below the fraction, or the smallest ones."""
    end = F.lit(_FIRST_BIT + (1 << (64 - scale_bits)) - 1)
    below = F.filter(ordered, lambda h: h <= end)
    return F.when(F.size(below) >= least, below).otherwise(F.slice(ordered, 1, least))


def add_sketch(df: DataFrame, text_col: str = "text", out: str = "sketch", width: int = WIDTH, scale_bits: int = SCALE_BITS, least: int = LEAST) -> DataFrame:
    """df with the ascending array of the kept hashes of its texts."""
    made = uuid.uuid4().hex[:8]
    words, hashes = (f"__{x}_{made}" for x in ("words", "hashes"))
    w = F.col(words)
    shingles = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(width))))
    whole = F.when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))
    return (
        df.withColumn(words, _words(F.coalesce(col(text_col), F.lit(""))))
        .withColumn(hashes, _ordered(F.array_distinct(F.when(F.size(w) >= width, shingles).otherwise(whole))))
        .withColumn(out, _kept(F.col(hashes), scale_bits, least))
        .drop(words, hashes)
    )


def merged(a: Column, b: Column, scale_bits: int = SCALE_BITS, least: int = LEAST) -> Column:
    """The sketch of two texts' shingles together."""
    return _kept(F.array_sort(F.array_union(a, b)), scale_bits, least)


def _bound(sketch: Column, scale_bits: int, least: int) -> Column:
    """Up to where a sketch holds all hashes of its text."""
    end = F.lit(_FIRST_BIT + (1 << (64 - scale_bits)) - 1)
    return F.when(F.size(sketch) < least, F.lit((1 << 63) - 1)).otherwise(F.greatest(F.element_at(sketch, -1), end))


def _compared(a: Column, b: Column, scale_bits: int, least: int) -> tuple[Column, Column, Column]:
    """How many hashes a and b have up to the lesser bound, and how many they share."""
    bound = F.least(_bound(a, scale_bits, least), _bound(b, scale_bits, least))
    upto = lambda x: F.size(F.filter(x, lambda h: h <= bound))
    return upto(a), upto(b), F.size(F.array_intersect(a, b))


def containment(a: Column, b: Column, scale_bits: int = SCALE_BITS, least: int = LEAST) -> Column:
    """The estimated part of a's shingles that b has; 1 where a has none, 0 where only b has none,
    null where b has kept none of the part in which a's are."""
    n, _, shared = _compared(a, b, scale_bits, least)
    return F.when(F.size(a) == 0, 1.0).when(F.size(b) == 0, 0.0).when(n > 0, shared / n)


def likeness(a: Column, b: Column, scale_bits: int = SCALE_BITS, least: int = LEAST) -> Column:
    """The estimated Jaccard likeness of the shingles; 1 of two empty sketches."""
    n, m, shared = _compared(a, b, scale_bits, least)
    return F.when(n + m - shared > 0, shared / (n + m - shared)).otherwise(F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(0.0))


def text_form(sketch: Column) -> Column:
    """16 hexadecimal digits for each hash."""
    return F.lower(F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h.bitwiseXOR(F.lit(_FIRST_BIT))), 16, "0")), ""))


def _ranges(df: DataFrame, id_col: str) -> list[int]:
    """Ascending ids at which ranges of about RANGE_ROWS rows start."""
    n, least = df.agg(F.count("*"), F.min(col(id_col))).first()
    k = min(MOST_RANGES, n // RANGE_ROWS)
    if least is None or k < 2:
        return [] if least is None else [least]
    found = df.agg(F.percentile_approx(col(id_col), [i / k for i in range(1, k)], 10 * k)).first()[0]
    return sorted({least, *found})


def _range_of(id_: Column, starts: list[int]) -> Column:
    """The number of the last start up to the id, 0 of a null; looked up in two steps."""
    step = max(1, math.isqrt(len(starts)))
    groups = [starts[i : i + step] for i in range(0, len(starts), step)]
    number = lambda values: F.array(*map(F.lit, values))
    upto = lambda values: F.size(F.filter(values, lambda s: s <= id_))
    group = F.greatest(upto(number([g[0] for g in groups])) - 1, F.lit(0))
    inner = upto(F.get(F.array(*map(number, groups)), group))
    return F.coalesce(F.greatest(group * step + inner - 1, F.lit(0)), F.lit(0))


def with_next(df: DataFrame, id_col: str, text_col: str, carried: dict[str, str]) -> DataFrame:
    """df with the values of other columns in the next row, {new name: column}, by ascending
    id; after the last row comes the first."""
    starts = _ranges(df, id_col)
    if not starts:
        starts = [0]
    at, id_ = _range_of(col(id_col), starts), col(id_col)
    heads = F.array(*map(F.lit, starts))
    marked = df.withColumn("__range", at)
    here = lambda r, copy: F.struct(r.cast("int").alias("range"), F.lit(copy).alias("copy"))
    first = F.coalesce(id_ == F.get(heads, F.col("__range")), F.lit(False)) | id_.isNull()
    before = F.when(F.col("__range") == 0, F.lit(len(starts) - 1)).otherwise(F.col("__range") - 1)
    dealt = marked.withColumn("__place", F.explode(F.when(first, F.array(here(F.col("__range"), False), here(before, True))).otherwise(F.array(here(F.col("__range"), False)))))
    w = Window.partitionBy("__place.range").orderBy("__place.copy", id_.asc_nulls_first(), F.xxhash64(col(text_col)))
    return dealt.withColumns({new: F.lead(old).over(w) for new, old in carried.items()}).where("not __place.copy").drop("__range", "__place")


def compare_with_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited, sketch, edited_sketch, next_sketch): the edited text ends in the
    next document's beginning, in place of its own last quarter."""
    texts = add_sketch(df.select(col(id_col).alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text")))
    paired = with_next(texts, "id", "text", {"next_text": "text", "next_sketch": "sketch"})
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = paired.select("id", n.cast("long").alias("n_chars"), "sketch", "next_sketch", F.concat(F.col("text").substr(F.lit(1), n - quarter), F.col("next_text").substr(F.lit(1), quarter)).alias("edited"))
    return add_sketch(edited, "edited", "edited_sketch").select(F.col("id").alias(id_col), *(c for c in others(edited, "id")), "edited_sketch")
