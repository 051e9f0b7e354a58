"""Repairs by rules (U1 to U5): structure, nearest clean values, functional dependencies."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmend.functions.costs import Levenshtein, UpdateCostFunction
from cellmend.functions.names import col
from cellmend.functions.text import restored
from cellmend.operators.domains import union_all, without_cells
from cellmend.session import cut, ship_package

UPDATES = ("attribute", "current_value", "repaired")


def by_regexes(cells: DataFrame, row_id: str, regexes: Iterable[tuple[str, str]]) -> tuple[DataFrame, DataFrame | None]:
    """The cells left, and the repairs by the (attribute, regular expression) rules."""
    found = [cells.where(F.col("attribute") == a).withColumn("repaired", restored(F.col("current_value"), r)).where("repaired is not null") for a, r in regexes]
    if not found:
        return cells, None
    repaired = union_all(found).select(col(row_id), *UPDATES).dropDuplicates([row_id, "attribute"])
    return without_cells(cells, repaired, row_id), repaired


#: Hashes in a batch of deletions.
HASHES = 1 << 20


def deletion_hashes(chars: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of what is left of texts of one length (rows of chars) without each row of rising
    places, and which of them count: of a run of equal characters the first ones go.

    A hash is a polynomial modulo 2^64 of an odd base, so what is left of a text adds up from
    its parts, each shifted by the number of characters that go after it.
    """
    n, most = chars.shape[1], places.shape[1]
    x = (chars.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    base, back = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64)
    power = np.array([pow(base, n - 1 - i, 1 << 64) for i in range(n)], np.uint64)
    rest = np.zeros((len(x), n + 1), np.uint64)  # at i: the sum from i on
    rest[:, :n] = np.cumsum((x * power)[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1]
    again = np.zeros(chars.shape, bool)
    again[:, 1:] = chars[:, 1:] == chars[:, :-1]
    out, counts = np.zeros((len(x), len(places)), np.uint64), np.ones((len(x), len(places)), bool)
    for k in range(most + 1):
        since = places[:, k - 1] + 1 if k else np.zeros(len(places), np.int64)
        until = places[:, k] if k < most else np.full(len(places), n)
        out += (rest[:, since] - rest[:, until]) * np.uint64(pow(back, most - k, 1 << 64))
        if k < most:
            counts &= ~again[:, until] | ((since == until) & bool(k))
    return out.view(np.int64), counts


def _without_characters(most: int):
    """Adds to batches of (a, s) the hashes of s without up to `most` characters."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("s").to_pylist()
            size = np.array([len(t) for t in texts], np.int64)
            for n in np.unique(size).tolist():
                rows = np.flatnonzero(size == n)
                for k in range(min(most, n) + 1):
                    chosen = combinations(range(n), k)
                    while part := list(islice(chosen, HASHES)):
                        places = np.array(part, np.int64).reshape(len(part), k)
                        step = max(1, HASHES // len(places))
                        for at in range(0, len(rows), step):
                            some = rows[at : at + step]
                            chars = np.frombuffer("".join(texts[i] for i in some).encode("utf-32-le"), np.uint32).reshape(len(some), n)
                            hashes, counts = deletion_hashes(chars, places)
                            ends = np.concatenate([[0], np.cumsum(counts.sum(axis=1))]).astype(np.int32)
                            columns = batch.take(pa.array(some))
                            yield pa.RecordBatch.from_arrays([columns.column("a"), columns.column("s"), pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes[counts]))], ["a", "s", "hashes"])

    return work


def _by_deletions(wrong: DataFrame, clean: DataFrame, most: int) -> DataFrame:
    """(a, w, value) of values that are alike without up to `most` characters of each, as all are
    that are within as many edits."""
    ship_package(clean.sparkSession)
    number = int(clean.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def hashed(df: DataFrame, c: str) -> DataFrame:
        # A set number of partitions, as few bytes make many hashes.
        spread = df.select("a", F.col(c).alias("s")).repartition(number)
        done = spread.mapInArrow(_without_characters(most), "a string, s string, hashes array<long>")
        return done.select("a", F.col("s").alias(c), F.explode("hashes").alias("h"))

    return hashed(wrong, "w").join(hashed(clean, "value"), ["a", "h"]).select("a", "w", "value").distinct()


def within_edits(wrong: DataFrame, clean: DataFrame, most: int) -> DataFrame:
    """(a, w, value) of wrong values (a, w) and clean ones (a, value) that may be within `most`
    edits: no pair within is lost, few others remain.

    A clean value is cut into most + 1 segments, of which edits leave one unchanged, moved by at
    most `most` places. So values meet by segment and length, never all with all. Where many
    values share a segment, as numbered names do, such meetings are more than the ways to take
    up to `most` characters out of the values; there values meet by what is then left of them.
    Meetings are counted before, by attribute and length.
    """
    cut_at = lambda n, i: F.floor(n * i / (most + 1)).cast("int")
    numbers = F.array(*map(F.lit, range(most + 1)))
    n = F.length("value")
    kept = clean.select("a", "value", n.alias("n"), F.posexplode(F.transform(numbers, lambda i: F.substring("value", cut_at(n, i) + 1, cut_at(n, i + 1) - cut_at(n, i)))).alias("i", "segment"))
    m = F.length("w")
    lengths = F.sequence(F.greatest(m - most, F.lit(0)), m + most)

    def pieces(size: Column, i: Column) -> Column:
        """The places of a wrong value at which segment i of a value of that size may stand."""
        wide = cut_at(size, i + 1) - cut_at(size, i)
        starts = F.sequence(F.greatest(cut_at(size, i) - most, F.lit(0)), cut_at(size, i) + most)
        return F.transform(F.filter(starts, lambda s: s + wide <= m), lambda s: F.struct(size.alias("n"), i.alias("i"), F.substring("w", s + 1, wide).alias("segment")))

    asked = F.array_distinct(F.flatten(F.flatten(F.transform(lengths, lambda size: F.transform(numbers, lambda i: pieces(size, i))))))
    looked = wrong.select("a", "w", F.inline(asked))
    key = ["a", "n", "i", "segment"]

    def ways(size: Column) -> Column:
        """The number of ways to take up to `most` of as many characters out."""
        total = term = F.lit(1.0)
        for k in range(most):
            term = term * F.greatest(size - k, F.lit(0)) / (k + 1)
            total = total + term
        return total

    meetings = looked.groupBy(*key).agg(F.count("*").alias("x")).join(kept.groupBy(*key).agg(F.count("*").alias("y")), key).groupBy("a", "n").agg(F.sum(F.col("x").cast("double") * F.col("y")).alias("meetings"))
    work = clean.select("a", n.alias("n"), ways(n).alias("ways")).union(wrong.select("a", F.explode(lengths).alias("n"), ways(m).alias("ways"))).groupBy("a", "n").agg(F.sum("ways").alias("ways"))
    crowded = cut(meetings.join(work, ["a", "n"]).where("meetings > ways").select("a", "n"))
    apart = looked.join(kept.join(crowded, ["a", "n"], "left_anti"), key).select("a", "w", "value")
    if crowded.isEmpty():
        return apart.distinct()
    reached = wrong.select("a", "w", F.explode(lengths).alias("n")).join(crowded, ["a", "n"], "left_semi").select("a", "w").distinct()
    return apart.union(_by_deletions(reached, clean.withColumn("n", n).join(crowded, ["a", "n"], "left_semi"), most)).distinct()


def _nearest_by_edits(wrong: DataFrame, clean: DataFrame, costs: UpdateCostFunction, most: int) -> DataFrame:
    """(a, w, cost, value) of each wrong value's clean ones of the least cost, up to `most` edits.

    Few edits are tried first: what is found within them needs no more.
    """
    found, edits, left = [], min(most, 1), wrong
    while True:
        priced = within_edits(left, clean, edits).withColumn("cost", costs.column(F.col("w"), F.col("value"))).where(F.col("cost") <= edits)
        if edits == most:
            return union_all([*found, priced])
        found.append(cut(priced))
        left = cut(left.join(found[-1].select("a", "w").distinct(), ["a", "w"], "left_anti"))
        if left.isEmpty():
            return union_all(found)
        edits = min(most, 2 * edits)


def by_nearest(base: DataFrame, cells: DataFrame, row_id: str, targets: Iterable[str], costs: UpdateCostFunction, threshold: float) -> tuple[DataFrame, DataFrame | None]:
    """The cells left, and repairs by the clean value of the least cost, if that is at most
    the threshold, the next value costs more, and there are two values at least.

    Distinct wrong values meet distinct clean values of their attribute, so copies of either
    cost nothing; the winners go back to the cells by value. For edit distances only values
    that share a part meet; a user's costs tell nothing of the kind, so there all do.
    """
    names = [t for t in targets if not costs.targets or t in costs.targets]
    if not names:
        return cells, None
    values = F.array(*(F.struct(F.lit(c).alias("a"), col(c).cast("string").alias("value")) for c in names))
    clean = base.select(F.inline(values)).where("value is not null").distinct()
    wrong = cells.where(F.col("attribute").isin(names) & F.col("current_value").isNotNull()).select(F.col("attribute").alias("a"), F.col("current_value").alias("w")).distinct()
    if isinstance(costs, Levenshtein) and threshold >= 0:
        clean = cut(clean)
        priced = _nearest_by_edits(cut(wrong), clean, costs, math.floor(threshold))
    else:
        priced = wrong.join(clean, "a").withColumn("cost", costs.column(F.col("w"), F.col("value"))).where(F.col("cost") <= threshold)
    # The values of the least cost, of which there must be one only.
    least = priced.groupBy("a", "w", "cost").agg(F.min("value").alias("value"), F.count("*").alias("ties")).groupBy("a", "w").agg(F.min(F.struct("cost", "ties", "value")).alias("x"))
    several = clean.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
    won = least.where("x.ties = 1").join(several, "a").select("a", "w", F.col("x.value").alias("repaired"))
    repaired = cells.join(won, (F.col("attribute") == F.col("a")) & (F.col("current_value") == F.col("w"))).select(col(row_id), *UPDATES)
    return without_cells(cells, repaired, row_id), repaired


def dependency_values(df: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y) where a value of x goes with one value of y only; null is no value."""
    known = df.where(col(x).isNotNull() & col(y).isNotNull())
    pairs = known.select(col(x).alias("__x"), col(y).alias("__y")).distinct()
    alone = pairs.groupBy("__x").agg(F.count("*").alias("__n"), F.first("__y").alias("__y")).where("__n = 1")
    return alone.select(F.col("__x").alias(x), F.col("__y").alias(y))


def by_dependency(df: DataFrame, x: str, y: str, values: DataFrame | None = None) -> DataFrame:
    """Df with null y replaced by the value that its x determines, if it does."""
    found = (values if values is not None else dependency_values(df, x, y)).select(col(x).alias("__x"), col(y).alias("__y"))
    joined = df.join(found, col(x) == F.col("__x"), "left")
    return joined.select(*(F.coalesce(col(y), F.col("__y")).alias(y) if c == y else col(c) for c in df.columns))
