"""Probable values of cells, and what follows from them."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmend.functions.names import col
from cellmend.operators.stats import long_counts


def cell_domains(discrete: DataFrame, cells: DataFrame, row_id: str, correlated: dict[str, list[str]], sizes: dict[str, int], continuous: Iterable[str] = (), alpha: float = 0.0, beta: float = 0.70, ratio: float = 0.0, chained: bool = True) -> DataFrame:
    """(row id, attribute, current_value, domain): candidate values by falling probability.

    A candidate's score is the sum, over the correlated attributes, of how often it goes with
    the row's value there, less one but at least 0.1; pairs at or below a threshold that alpha
    sets don't count. Scores are made probabilities, and those over beta are kept. With
    `chained`, candidates of earlier attributes are lost where a later one has none.

    All targets are computed in one plan: cells x attributes, joined to long pair counts.
    """
    skipped = set(continuous)
    pairs = [(y, x) for y, xs in correlated.items() if y not in skipped for x in xs]
    empty = F.expr("cast(array() as array<struct<n: string, prob: double>>)")
    base = cells.select(col(row_id), "attribute", "current_value")
    if not pairs:
        return base.withColumn("domain", empty)
    n = discrete.count()
    counts = long_counts(discrete, pairs)
    if ratio > 0:
        counts = counts.where(F.col("cnt") > int(n * ratio))
    tau = F.array(*(F.lit(int(alpha * (n // max(1, sizes[y] * sizes[x])))) for y, x in pairs))
    counts = counts.where("v0 is not null and v1 is not null").where(F.col("cnt") > F.get(tau, F.col("set")))
    weights = counts.select("set", F.col("v1").alias("given"), F.col("v0").alias("n"), F.greatest(F.col("cnt") - 1.0, F.lit(0.1)).alias("w"))
    sets = F.array(*(F.struct(F.lit(i).alias("set"), F.lit(y).alias("y"), F.lit(correlated[y].index(x)).alias("turn"), col(x).cast("string").alias("given")) for i, (y, x) in enumerate(pairs)))
    rows = base.join(discrete.select(col(row_id).alias("__id"), sets.alias("__sets")), col(row_id) == F.col("__id")).drop("__id")
    asked = rows.select(col(row_id), "attribute", "current_value", F.explode_outer(F.filter("__sets", lambda s: s["y"] == F.col("attribute"))).alias("s"))
    asked = asked.select(col(row_id), "attribute", "current_value", "s.set", "s.turn", "s.given")
    found = asked.join(weights, ["set", "given"], "left")
    keys = [col(row_id), F.col("attribute"), F.col("current_value")]
    if chained:
        # An attribute without candidates empties what came before it.
        entries = F.collect_list(F.struct("turn", "n", "w"))
        grouped = found.groupBy(*keys).agg(entries.alias("e"))
        gaps = F.transform(F.filter("e", lambda x: x["n"].isNull()), lambda x: x["turn"])
        cut = F.array_max(gaps)
        kept = F.filter("e", lambda x: x["n"].isNotNull() & (F.col("cut").isNull() | (x["turn"] > F.col("cut"))))
        found = grouped.withColumn("cut", cut).select(*keys, F.explode_outer(kept).alias("x")).select(*keys, "x.n", "x.w")
    scored = found.groupBy(*keys, "n").agg(F.sum(F.col("w") / F.lit(n)).alias("score"))
    listed = scored.groupBy(*keys).agg(F.sum("score").alias("total"), F.collect_list(F.when(F.col("n").isNotNull(), F.struct("n", "score"))).alias("found"))
    probable = F.transform("found", lambda x: F.struct(x["n"].alias("n"), (x["score"] / F.col("total")).alias("prob")))
    by_prob = lambda a, b: F.when(a["prob"] > b["prob"], -1).when(a["prob"] < b["prob"], 1).when(a["n"] < b["n"], -1).when(a["n"] > b["n"], 1).otherwise(0)
    return listed.select(*keys, F.array_sort(F.filter(probable, lambda x: x["prob"] > beta), by_prob).alias("domain"))


def weak_labels(domains: DataFrame, row_id: str) -> DataFrame:
    """The cells whose most probable value is the one they have."""
    return domains.where(F.get("domain", 0)["n"] == F.col("current_value")).select(col(row_id), "attribute")


def without_cells(cells: DataFrame, other: DataFrame, row_id: str) -> DataFrame:
    """The cells that aren't in the other frame."""
    gone = other.select(col(row_id).alias("__id"), F.col("attribute").alias("__attribute"))
    return cells.join(gone, (col(row_id) == F.col("__id")) & (F.col("attribute") == F.col("__attribute")), "left_anti")


def cells_by_row(cells: DataFrame, row_id: str) -> DataFrame:
    """(__id, __errors): the attributes of each row's cells."""
    return cells.groupBy(col(row_id).alias("__id")).agg(F.collect_set("attribute").alias("__errors"))


def repair_base(df: DataFrame, cells: DataFrame, row_id: str, targets: Iterable[str], dirty: str | None = None) -> DataFrame:
    """Df with its error cells of the targets set to null; with a column `dirty` that tells
    rows that have any, if it is named."""
    wanted = set(targets)
    joined = df.join(cells_by_row(cells, row_id), col(row_id) == F.col("__id"), "left")
    clear = lambda c: F.when(~F.coalesce(F.array_contains("__errors", c), F.lit(False)), col(c)).alias(c) if c in wanted else col(c)
    marks = [F.col("__errors").isNotNull().alias(dirty)] if dirty else []
    return joined.select(*(clear(c) for c in df.columns), *marks)


def split_rows(df: DataFrame, cells: DataFrame, row_id: str) -> tuple[DataFrame, DataFrame]:
    """The rows without error cells, and those with."""
    bad = cells.select(col(row_id).alias("__id")).distinct()
    same = col(row_id) == F.col("__id")
    return df.join(bad, same, "left_anti"), df.join(bad, same, "left_semi")


def of_columns(cells: DataFrame, columns: Iterable[str], negate: bool = False) -> DataFrame:
    """The cells of some columns, or of all others."""
    among = F.col("attribute").isin(list(columns))
    return cells.where(~among if negate else among)


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, frames)
