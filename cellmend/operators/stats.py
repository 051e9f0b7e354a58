"""Column and frequency statistics (S1 to S8), each from one aggregation over all its columns."""

from __future__ import annotations

import itertools
import logging
import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmend.functions.names import col
from cellmend.sources.tables import CONTINUOUS

logger = logging.getLogger("cellmend")

#: Values whose quantiles one task merges, and that are listed on the driver.
EXACT_ROWS, LISTED = 1_000_000, 10_000
FREQ_FLAG = "__generated_freq_group_"
MOST_ATTRS = 64


def distinct_counts(df: DataFrame, columns: Iterable[str], approx: bool = False) -> dict[str, int]:
    """The number of distinct values (null is none) of each column."""
    names = list(columns)
    if not names:
        return {}
    if approx:
        row = df.agg(*(F.approx_count_distinct(col(c), 0.05) for c in names)).first()
        return dict(zip(names, row, strict=True))
    # One narrow pass: distinct (column, value) pairs, instead of an expansion for each column.
    pairs = df.select(F.explode(F.array(*(F.struct(F.lit(i).alias("c"), col(c).cast("string").alias("v")) for i, c in enumerate(names)))).alias("x")).where("x.v is not null")
    found = {r[0]: r[1] for r in pairs.select("x.c", "x.v").distinct().groupBy("c").count().collect()}
    return {c: found.get(i, 0) for i, c in enumerate(names)}


def extremes(df: DataFrame, columns: Iterable[str]) -> dict[str, tuple]:
    """The least and largest value of each column."""
    names = list(columns)
    if not names:
        return {}
    row = df.agg(*(f(col(c)) for c in names for f in (F.min, F.max))).first()
    return {c: (row[2 * i], row[2 * i + 1]) for i, c in enumerate(names)}


def quantiles(df: DataFrame, values: dict[str, Column], shares: list[float]) -> dict[str, list[float] | None]:
    """The exact quantiles of each column of numbers, interpolated between neighbours; None of no
    values.

    A table of up to EXACT_ROWS values is merged as it is. In a larger one each wanted rank is
    enclosed between two approximate quantiles, again and again among the values between them,
    until few enough are left to be listed: no task merges all values.
    """
    names = list(values)
    if not names:
        return {}
    plain = df.select(*(x.cast("double").alias(f"v{i}") for i, x in enumerate(values.values())))
    counts = plain.agg(*(F.count(f"v{i}") for i in range(len(names)))).first()
    if max(counts) <= EXACT_ROWS:
        row = plain.agg(*(F.percentile(f"v{i}", F.array(*map(F.lit, shares))).alias(f"q{i}") for i in range(len(names)))).first()
        return {c: (list(q) if q is not None else None) for c, q in zip(names, row, strict=True)}
    ranks = {i: sorted({r for s in shares for r in (math.floor(s * (n - 1)), math.ceil(s * (n - 1)))}) for i, n in enumerate(counts) if n}
    found = ranked(plain, {(f"v{i}", r): n for i, n in enumerate(counts) if n for r in ranks[i]})
    out: dict[str, list[float] | None] = {}
    for i, c in enumerate(names):
        at = lambda s, i=i: s * (counts[i] - 1)
        own = lambda r, i=i: found[f"v{i}", r]
        out[c] = [own(math.floor(at(s))) + (at(s) - math.floor(at(s))) * (own(math.ceil(at(s))) - own(math.floor(at(s)))) for s in shares] if counts[i] else None
    return out


def ranked(df: DataFrame, wanted: dict[tuple[str, int], int]) -> dict[tuple[str, int], float]:
    """The values of (column, rank from 0), each with its column's number of values."""
    found: dict[tuple[str, int], float] = {}
    #: Of each: the least and largest value that it can be, and the values below and between.
    open_ = {k: (None, None, 0, n) for k, n in wanted.items()}
    between = lambda c, low, high: F.lit(True) if low is None else (F.col(c) >= low) & (F.col(c) <= high)
    while open_:
        keys = list(open_)
        bounds = []
        for c, r in keys:
            low, high, below, inside = open_[c, r]
            share = (r - below) / max(1, inside - 1)
            inner = F.when(between(c, low, high), F.col(c))
            bounds.append(F.percentile_approx(inner, F.array(F.lit(max(0.0, share - 0.001)), F.lit(min(1.0, share + 0.001))), 2000))
        rows = df.agg(*(b.alias(f"b{j}") for j, b in enumerate(bounds))).first()
        # A float's quantile may be off by the sketch's error, so what is enclosed is counted.
        sides = [x for (c, r), (low, high) in zip(keys, rows, strict=True) for x in (F.count(F.when(F.col(c) < low, 1)), F.count(F.when(F.col(c) <= high, 1)))]
        told = df.agg(*(x.alias(f"n{j}") for j, x in enumerate(sides))).first()
        few: list[tuple[str, int]] = []
        for j, (c, r) in enumerate(keys):
            below, upto = told[2 * j], told[2 * j + 1]
            low, high = rows[j]
            if not below <= r < upto:
                few.append((c, r))  # missed: what was open before is listed
            elif low == high:
                found[c, r] = low
                del open_[c, r]
            else:
                shrunk = upto - below < open_[c, r][3]
                open_[c, r] = (low, high, below, upto - below)
                if upto - below <= LISTED or not shrunk:
                    few.append((c, r))
        for c, r in few:
            low, high, below, _ = open_.pop((c, r))
            at = below
            for value, n in df.where(between(c, low, high) & F.col(c).isNotNull()).groupBy(c).count().orderBy(c).toLocalIterator():
                at += n
                if at > r:
                    found[c, r] = value
                    break
    return found


def discretize(df: DataFrame, row_id: str, threshold: int, approx: bool = False) -> tuple[DataFrame, dict[str, int]]:
    """S3: the row id and the discrete columns, and all columns' numbers of distinct values.

    Continuous columns are cut into `threshold` equal ranges, of which the largest value has
    one of its own; where all values are equal the range is null. Others are kept if they have
    more than one and at most `threshold` values.
    """
    kinds = {c: kind for c, kind in df.dtypes if c != row_id}
    sizes = distinct_counts(df, kinds, approx)
    bounds = extremes(df, [c for c, kind in kinds.items() if kind in CONTINUOUS])
    kept = [col(row_id)]
    for c, kind in kinds.items():
        if kind in CONTINUOUS:
            low, high = bounds[c]
            if low is None:
                kept.append(F.lit(None).cast("int").alias(c))
            else:
                part = F.try_divide(col(c).cast("double") - F.lit(float(low)), F.lit(float(high) - float(low)))
                kept.append((part * threshold).cast("int").alias(c))
        elif 1 < sizes[c] <= threshold:
            kept.append(col(c))
        else:
            logger.warning("'%s' is left out: it has %d values", c, sizes[c])
    return df.select(*kept), sizes


def freq_stats(df: DataFrame, attr_sets: Iterable[Iterable[str]], ratio: float = 0.0) -> DataFrame:
    """Counts of the values of single attributes and pairs, by grouping sets.

    For each attribute there is a flag, 0 where the attribute is grouped by. Groups of at
    most `ratio` of the rows are left out.
    """
    sets = [list(dict.fromkeys(s)) for s in attr_sets]
    attrs = list(dict.fromkeys(a for s in sets for a in s))
    if len(attrs) > MOST_ATTRS:
        raise ValueError(f"At most {MOST_ATTRS} columns are counted at once, not {len(attrs)}")
    if any(len(s) > 2 for s in sets):
        raise ValueError("Sets have one or two columns, not " + "; ".join(",".join(s) for s in sets if len(s) > 2))
    flags = [F.grouping(col(a)).cast("int").alias(f"{FREQ_FLAG}{a}") for a in attrs]
    counted = df.groupingSets([[col(a) for a in s] for s in sets], *(col(a) for a in attrs)).agg(*flags, F.count("*").alias("cnt"))
    ordered = [x for a in attrs for x in (col(a), col(f"{FREQ_FLAG}{a}"))]
    if ratio > 0:
        counted = counted.where(F.col("cnt") > int(df.count() * ratio))
    return counted.select(*ordered, "cnt")


def long_counts(df: DataFrame, sets: list[tuple[str, ...]]) -> DataFrame:
    """(set, v0, v1, cnt): counts of single attributes' and pairs' values in long form, for any
    number of attributes: one scan, one shuffle, combined before it. v1 is null of singles."""
    text = lambda a: col(a).cast("string")
    rows = F.array(*(F.struct(F.lit(i).alias("set"), text(s[0]).alias("v0"), (text(s[1]) if len(s) > 1 else F.lit(None).cast("string")).alias("v1")) for i, s in enumerate(sets)))
    return df.select(F.explode(rows).alias("x")).groupBy("x.set", "x.v0", "x.v1").agg(F.count("*").alias("cnt"))


def candidate_pairs(df: DataFrame, targets: Iterable[str], sizes: dict[str, int], ratio: float, most: int) -> list[tuple[str, str]]:
    """(target, partner) pairs whose values co-occur in a small part of all combinations,
    at most `most` of a target if it has more partners than that."""
    attrs = [a for a in df.columns if a in sizes]
    pairs = [(y, x) for y in targets if y in attrs for x in attrs if x != y]
    crowded = [(y, x) for y, x in pairs if len(attrs) - 1 > most]
    if not crowded:
        return pairs
    unordered = sorted({tuple(sorted(p)) for p in crowded})
    counted = {r["set"]: r["count"] for r in long_counts(df, unordered).groupBy("set").count().collect()}
    share = {p: counted.get(i, 0) / max(1, sizes[p[0]] * sizes[p[1]]) for i, p in enumerate(unordered)}
    out = []
    for y, group in itertools.groupby(crowded, key=lambda p: p[0]):
        near = sorted((share[tuple(sorted(p))], p[1]) for p in group)
        out += [(y, x) for s, x in near if s < ratio][:most]
    return out


def _entropy(n: int, sums: tuple[float, int, int], domain: int) -> float:
    """H of one set: the sum over its groups, and a correction for those left out."""
    h, total, groups = sums
    if n > total:
        unseen = max(domain - groups, 1)
        average = max((n - total) / unseen, 1.0)
        h -= unseen * (average / n) * math.log2(average / n)
    return h


def entropy_sums(counts: DataFrame, n: int) -> dict[int, tuple[float, int, int]]:
    """Of each set of long counts: its entropy, the rows and the number of its groups."""
    p = F.col("cnt") / F.lit(n)
    rows = counts.groupBy("set").agg(F.sum(-p * F.log2(p)), F.sum("cnt"), F.count("*")).collect()
    return {r[0]: (r[1], r[2], r[3]) for r in rows}


def conditional_entropies(df: DataFrame, pairs: Iterable[tuple[str, str]], sizes: dict[str, int], ratio: float = 0.0) -> dict[str, list[tuple[str, float]]]:
    """{y: [(x, H(y|x)), ...]} ascending, from one job for all pairs.

    Groups of at most `ratio` of the rows are taken as unseen.
    """
    wanted = list(dict.fromkeys(pairs))
    if not wanted:
        return {}
    sets: list[tuple[str, ...]] = sorted({tuple(sorted(p)) for p in wanted})
    sets += [(a,) for a in sorted({x for _, x in wanted})]
    n = df.count()
    counts = long_counts(df, sets)
    if ratio > 0:
        counts = counts.where(F.col("cnt") > int(n * ratio))
    sums = entropy_sums(counts, max(n, 1))
    h = {s: _entropy(n, sums.get(i, (0.0, 0, 0)), math.prod(sizes[a] for a in s)) if n else 0.0 for i, s in enumerate(sets)}
    out: dict[str, list[tuple[str, float]]] = {}
    for y, x in wanted:
        out.setdefault(y, []).append((x, h[tuple(sorted((y, x)))] - h[(x,)]))
    return {y: sorted(v, key=lambda t: (t[1], t[0])) for y, v in out.items()}
