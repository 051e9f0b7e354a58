"""Denial constraints: a small language (C1 to C6) and the plans that find violations.

A constraint is a conjunction of predicates that must not hold together, of one tuple and
constants or of two tuples. A violating tuple is one for which some tuple satisfies all
predicates. The generic plan, a semi join, compares each tuple with all of its key's, so the
shapes that have a linear plan are recognised (R1 to R4) before Catalyst sees them.
"""

from __future__ import annotations

import itertools
import logging
import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from operator import and_
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellmend.functions.names import col

logger = logging.getLogger("cellmend")

#: Columns that must differ together, up to which subsets are counted.
MOST_UNEQUAL = 4
#: Rows that are ordered in one task, and ranges of values into which more are cut at most.
PART_ROWS, CUTS = 100_000, 200

_PREDICATE = re.compile(r"\s*(EQ|IQ|LT|GT)\s*\((.*)\)\s*", re.S)
_REFERENCE = re.compile(r"\s*([A-Za-z][A-Za-z0-9]*)\s*\.\s*(.+?)\s*", re.S)
_TUPLE = re.compile(r"\s*([A-Za-z][A-Za-z0-9]*)\s*")
_DEPENDENCY = re.compile(r"\s*(\w[\w ]*?)\s*->\s*(\w[\w ]*?)\s*")


class ConstraintError(ValueError):
    """A constraint that isn't of the language."""


@dataclass(frozen=True)
class Predicate:
    """sign(left tuple's attribute, right tuple's attribute or constant)."""

    sign: str
    left: str
    right: str
    constant: bool = False

    @property
    def references(self) -> tuple[str, ...]:
        return (self.left,) if self.constant else (self.left, self.right)

    def holds(self, left: Column, right: Column) -> Column:
        """C4: equality and inequality take nulls as values; the orders don't hold of nulls."""
        if self.sign == "EQ":
            return left.eqNullSafe(right)
        if self.sign == "IQ":
            return ~left.eqNullSafe(right)
        return left < right if self.sign == "LT" else left > right


@dataclass(frozen=True)
class Constraint:
    """The predicates that must not hold together."""

    predicates: tuple[Predicate, ...]

    @property
    def references(self) -> list[str]:
        return list(dict.fromkeys(r for p in self.predicates for r in p.references))

    @property
    def one_tuple(self) -> bool:
        return all(p.constant for p in self.predicates)


def parse(text: str) -> Constraint:
    """A two-tuple form, a one-tuple form, or the short form X->Y."""
    parts = text.split("&")
    if len(parts) == 1 and (m := _DEPENDENCY.fullmatch(text)):
        return Constraint((Predicate("EQ", m[1], m[1]), Predicate("IQ", m[2], m[2])))
    names = [m[1] for p in parts if (m := _TUPLE.fullmatch(p))]
    predicates = parts[len(names) :]
    if not 1 <= len(names) <= 2 or len(set(names)) < len(names) or any(_TUPLE.fullmatch(p) for p in predicates):
        raise ConstraintError(f"Not a constraint: {text}")
    if len(predicates) < 2:
        raise ConstraintError(f"A constraint has two predicates or more, this one {len(predicates)}: {text}")
    return Constraint(tuple(_predicate(p, names, text) for p in predicates))


def _predicate(part: str, names: list[str], text: str) -> Predicate:
    m = _PREDICATE.fullmatch(part)
    sides = m[2].split(",", 1) if m else []
    left = _REFERENCE.fullmatch(sides[0]) if sides else None
    if m is None or len(sides) != 2 or left is None or left[1] != names[0]:
        raise ConstraintError(f"Not a predicate: {text}")
    right = _REFERENCE.fullmatch(sides[1])
    if len(names) == 2:
        if right is None or right[1] != names[1]:
            raise ConstraintError(f"Not a predicate: {text}")
        return Predicate(m[1], left[2], right[2])
    if right is not None and right[1] == names[0]:
        raise ConstraintError(f"A one-tuple constraint compares with constants only: {text}")
    return Predicate(m[1], left[2], sides[1].strip(), constant=True)


def read_file(path: str) -> list[str]:
    """A constraint in each line of a file, local or in any storage that Spark reads; none,
    with a warning, if there is no file."""
    if urlparse(path).scheme not in ("", "file"):
        text = "".join(r[0] for r in SparkSession.active().read.text(path, wholetext=True).collect())
    else:
        place = Path(urlparse(path).path if path.startswith("file:") else path)
        if not place.is_file():
            logger.warning("No constraint file at %s", path)
            return []
        text = place.read_text()
    return [x.strip() for x in text.splitlines() if x.strip()]


def split_inline(text: str) -> list[str]:
    """Constraints separated by semicolons."""
    return [x.strip() for x in text.split(";") if x.strip()]


def load(texts: Iterable[str], columns: Iterable[str], table: str = "input") -> list[Constraint]:
    """The constraints that parse and name columns of the table; others warn."""
    out, known = [], set(columns)
    for text in texts:
        try:
            constraint = parse(text)
        except ConstraintError as e:
            logger.warning("%s", e if "Not a constraint" in str(e) else f"Not a constraint: {text} ({e})")
            continue
        unknown = [r for r in constraint.references if r not in known]
        if unknown:
            logger.warning("'%s' has no such columns for a constraint: %s", table, ", ".join(unknown))
            continue
        out.append(constraint)
    return out


def functional_dependencies(constraints: Iterable[Constraint], targets: Iterable[str]) -> dict[str, list[str]]:
    """Y -> sorted [x] of the constraints that say that x determines y, for targets y."""
    out: dict[str, list[str]] = {}
    wanted = set(targets)
    for c in constraints:
        if c.one_tuple or len(c.predicates) != 2 or {p.sign for p in c.predicates} != {"EQ", "IQ"} or any(p.left != p.right for p in c.predicates):
            continue
        x, y = (next(p.left for p in c.predicates if p.sign == s) for s in ("EQ", "IQ"))
        if y in wanted and x not in out.get(y, []) and y not in out.get(x, []):
            out.setdefault(y, []).append(x)
    return {y: sorted(xs) for y, xs in out.items()}


def violating_rows(df: DataFrame, constraint: Constraint) -> DataFrame:
    """The rows of df that violate the constraint."""
    ps = constraint.predicates
    if constraint.one_tuple:  # R1
        return df.where(reduce(and_, (p.holds(col(p.left), F.expr(p.right)) for p in ps)))
    keys = [p for p in ps if p.sign == "EQ"]
    rest = [p for p in ps if p.sign != "EQ"]
    if not rest:
        return _matching(df, df, keys, [])
    if len(rest) == 1 and rest[0].sign in ("LT", "GT"):
        return _beyond_extreme(df, keys, rest[0])
    if len(rest) == 1 and keys and all(p.left == p.right for p in ps):
        return _unequal(df, [p.left for p in keys], rest[0].left)
    if all(p.sign == "IQ" for p in rest) and len(rest) <= MOST_UNEQUAL:
        return _apart(df, keys, rest)
    if len(rest) == 2 and all(p.sign in ("LT", "GT") for p in rest):
        return _dominated(df, keys, rest)
    return _matching(df, df, keys, rest)


def _keyed(df: DataFrame, names: list[str], prefix: str) -> list[Column]:
    return [col(n).alias(f"{prefix}{i}") for i, n in enumerate(names)]


def _same(names: list[str], prefix: str) -> Column:
    return reduce(and_, (col(n).eqNullSafe(F.col(f"{prefix}{i}")) for i, n in enumerate(names)), F.lit(True))


def _unequal(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """R2: the groups of the keys that hold more than one value, null being one.

    Linear: distinct pairs by a hash aggregation, combined before the shuffle and dealt by key
    and value, so that a hot key is spread; then a count of what is left.
    """
    pairs = df.select(*_keyed(df, keys, "__k"), col(value).alias("__v")).distinct()
    names = [f"__k{i}" for i in range(len(keys))]
    bad = pairs.groupBy(*names).agg(F.count("*").alias("__n")).where("__n > 1").select(*names)
    return df.join(bad, _same(keys, "__k"), "left_semi")


def _apart(df: DataFrame, keys: list[Predicate], unequal: list[Predicate]) -> DataFrame:
    """R2 of several columns: whether the key has a row that differs in all of them, null being
    a value, by inclusion and exclusion over counts of distinct right values.

    Linear: one count for each subset of the columns, instead of pairs of a key's rows.
    """
    names = list(dict.fromkeys(p.left for p in (*keys, *unequal)))
    k, v = range(len(keys)), range(len(unequal))
    rights = df.select(*_keyed(df, [p.right for p in keys], "__k"), *_keyed(df, [p.right for p in unequal], "__v")).distinct()
    lefts = df.select(*_keyed(df, names, "__l")).distinct()
    of = {n: F.col(f"__l{i}") for i, n in enumerate(names)}
    total = F.lit(0)
    for number, subset in enumerate(s for size in range(len(unequal) + 1) for s in itertools.combinations(v, size)):
        by = [*(f"__k{i}" for i in k), *(f"__v{i}" for i in subset)]
        n = f"__n{number}"
        if not by:
            lefts = lefts.withColumn(n, F.lit(rights.count()))
        else:
            counts = rights.groupBy(*by).agg(F.count("*").alias(n)).select(n, *(F.col(c).alias(f"__c{i}") for i, c in enumerate(by)))
            own = [*(of[keys[i].left] for i in k), *(of[unequal[i].left] for i in subset)]
            lefts = lefts.join(counts, reduce(and_, (x.eqNullSafe(F.col(f"__c{i}")) for i, x in enumerate(own))), "left").drop(*(f"__c{i}" for i in range(len(by))))
        total = total + (-1) ** len(subset) * F.coalesce(n, F.lit(0))
    bad = lefts.where(total > 0).select(*of.values())
    return df.join(bad, reduce(and_, (col(n).eqNullSafe(x) for n, x in of.items())), "left_semi")


def _beyond_extreme(df: DataFrame, keys: list[Predicate], order: Predicate) -> DataFrame:
    """Some right value is beyond the left one if the key's extreme is; without a key, the
    table's."""
    extreme = (F.max if order.sign == "LT" else F.min)(col(order.right)).alias("__extreme")
    if not keys:
        return df.where(order.holds(col(order.left), F.lit(df.agg(extreme).first()[0])))
    per_key = df.groupBy(*_keyed(df, [p.right for p in keys], "__k")).agg(extreme).where("__extreme is not null")
    return df.join(per_key, _same([p.left for p in keys], "__k") & order.holds(col(order.left), F.col("__extreme")), "left_semi")


def _cuts(points: DataFrame) -> list:
    """Ascending values of `__a` that cut the points into about CUTS parts of like size; none
    of few points."""
    n = points.count()
    if n <= PART_ROWS:
        return []
    parts = min(CUTS, n // PART_ROWS + 1)
    share = max(1, n // (100 * parts))  # about 100 sampled points of a part, at any size
    sample = [r[0] for r in points.where(F.pmod(F.xxhash64("__a", F.lit(1)), F.lit(share)) == 0).select("__a").distinct().orderBy("__a").collect()]
    return sorted(set(sample[len(sample) * i // parts] for i in range(1, parts))) if sample else []


def _dominated(df: DataFrame, keys: list[Predicate], orders: list[Predicate]) -> DataFrame:
    """Two orders. For each key and first value, the most favourable second value strictly
    beyond it, by a running extreme.

    Only one row for each key and first value is ordered. The values are cut into ranges: the
    extreme runs within each range, and what the ranges before have is carried into it. So
    neither a frequent key nor the absence of one puts all rows into one task.
    """
    first, second = orders
    names = [f"__k{i}" for i in range(len(keys))]
    lefts = df.select(*_keyed(df, [p.left for p in keys], "__k"), col(first.left).alias("__a"), col(second.left).alias("__b")).where("__a is not null and __b is not null").distinct()
    best, better = (F.max, F.greatest) if second.sign == "LT" else (F.min, F.least)
    rights = df.where(col(first.right).isNotNull() & col(second.right).isNotNull()).groupBy(*_keyed(df, [p.right for p in keys], "__k"), col(first.right).alias("__a")).agg(best(col(second.right)).alias("__best"))
    asked = lefts.select(*names, "__a").distinct().withColumn("__best", F.lit(None)).withColumn("__side", F.lit(0))
    points = asked.unionByName(rights.withColumn("__side", F.lit(1)))
    cuts = _cuts(points)
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("__a"))) if cuts else F.lit(0)
    points = points.withColumn("__part", part)
    down = first.sign == "LT"
    ordered = lambda c: F.col(c).desc() if down else F.col(c).asc()
    # Rights strictly beyond a left value come before it, lefts come first among equals.
    within = Window.partitionBy(*names, "__part").orderBy(ordered("__a"), "__side").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*names).orderBy(ordered("__part")).rowsBetween(Window.unboundedPreceding, -1)
    carried = points.groupBy(*names, "__part").agg(best("__best").alias("__own")).withColumn("__carried", best("__own").over(before))
    carried = carried.select(*(F.col(c).alias(f"{c}_c") for c in names), F.col("__part").alias("__part_c"), "__carried")
    found = points.withColumn("__run", best("__best").over(within)).where("__side = 0")
    same_part = reduce(and_, (F.col(c).eqNullSafe(F.col(f"{c}_c")) for c in names), F.col("__part") == F.col("__part_c"))
    found = found.join(carried, same_part).withColumn("__run", better("__run", "__carried")).where("__run is not null")
    found = found.select(*(F.col(c).alias(f"{c}_f") for c in names), F.col("__a").alias("__a_f"), "__run")
    same_value = reduce(and_, (F.col(c).eqNullSafe(F.col(f"{c}_f")) for c in names), F.col("__a") == F.col("__a_f"))
    bad = lefts.join(found, same_value).where(second.holds(F.col("__b"), F.col("__run"))).select(*names, "__a", "__b")
    return df.join(bad, _same([p.left for p in keys], "__k") & (col(first.left) == F.col("__a")) & (col(second.left) == F.col("__b")), "left_semi")


def _matching(left: DataFrame, right: DataFrame, keys: list[Predicate], rest: list[Predicate]) -> DataFrame:
    """Any other shape, as a null-safe semi join with the distinct right values."""
    names = list(dict.fromkeys(p.right for p in (*keys, *rest)))
    place = {n: F.col(f"__r{i}") for i, n in enumerate(names)}
    values = right.select(*_keyed(right, names, "__r")).distinct()
    return left.join(values, reduce(and_, (p.holds(col(p.left), place[p.right]) for p in (*keys, *rest))), "left_semi")
