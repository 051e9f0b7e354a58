"""Helpers around a repair (M1 to M8): reshaping, profiling, applying updates."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmend.functions.names import col
from cellmend.functions.text import qgrams
from cellmend.sources.tables import INTEGRAL, need_columns

#: Bytes of a value, which a profile gives as the length of numbers.
FIXED_SIZE = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8}


def flatten(df: DataFrame, row_id: str) -> DataFrame:
    """M1: (row id, attribute, value) of each cell, nulls included, in one scan."""
    need_columns(df, row_id)
    cells = F.array(*(F.struct(F.lit(c).alias("attribute"), col(c).cast("string").alias("value")) for c in df.columns if c != row_id))
    return df.select(col(row_id), F.inline(cells))


def describe(df: DataFrame, num_bins: int = 8, approx: bool = True) -> DataFrame:
    """M2: a profile row of each column, from one aggregation.

    `hist` has the parts of the value range that equally frequent bins of a numeric column
    take; min, max and hist are null of text.
    """
    edges = F.array(*(F.lit(i / num_bins) for i in range(num_bins + 1)))
    rows = []
    aggs = []
    for i, (c, kind) in enumerate(df.dtypes):
        number = kind in FIXED_SIZE
        x = col(c)
        aggs += [(F.approx_count_distinct(x, 0.05) if approx else F.count_distinct(x)).alias(f"d{i}"), F.count_if(x.isNull()).alias(f"n{i}")]
        if number:
            aggs += [F.min(x).cast("string").alias(f"a{i}"), F.max(x).cast("string").alias(f"b{i}"), F.percentile_approx(x.cast("double"), edges).alias(f"h{i}")]
            width = F.try_divide(F.lit(1.0), F.get(f"h{i}", num_bins) - F.get(f"h{i}", 0))
            steps = F.transform(F.sequence(F.lit(0), F.lit(num_bins - 1)), lambda k: k)
            hist = _widths(f"h{i}", steps, width)
            sizes = (F.lit(FIXED_SIZE[kind]).cast("long"), F.lit(FIXED_SIZE[kind]).cast("long"))
        else:
            aggs += [F.ceil(F.avg(F.length(x.cast("string")))).cast("long").alias(f"l{i}"), F.max(F.length(x.cast("string"))).cast("long").alias(f"m{i}")]
            hist, sizes = F.lit(None).cast("array<double>"), (F.col(f"l{i}"), F.col(f"m{i}"))
        text = F.lit(None).cast("string")
        rows.append(F.struct(F.lit(c).alias("attrName"), F.col(f"d{i}").alias("distinctCnt"), (F.col(f"a{i}") if number else text).alias("min"), (F.col(f"b{i}") if number else text).alias("max"), F.col(f"n{i}").alias("nullCnt"), sizes[0].alias("avgLen"), sizes[1].alias("maxLen"), hist.alias("hist")))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def _widths(quantiles: str, steps, scale):
    return F.transform(steps, lambda k: (F.get(quantiles, k + 1) - F.get(quantiles, k)) * scale)


def apply_updates(updates: DataFrame, df: DataFrame, row_id: str) -> DataFrame:
    """M3: df with the (row id, attribute, repaired) updates; a null update sets null.

    Updates of numeric columns are cast, of integers after rounding. Two updates of one cell
    are an error, raised when the result is computed.
    """
    need_columns(updates, row_id, "attribute", "repaired", table="repair updates")
    known = F.map_from_entries(F.collect_list(F.struct("attribute", "repaired")))
    per_row = updates.where(F.col("attribute").isNotNull()).groupBy(col(row_id).alias("__id")).agg(known.alias("__new"))
    joined = df.join(per_row, col(row_id) == F.col("__id"), "left")

    def updated(c: str, kind: str):
        new = F.try_element_at("__new", F.lit(c))
        if kind in INTEGRAL:
            new = F.round(new.cast("double"))
        return F.when(F.coalesce(F.map_contains_key("__new", c), F.lit(False)), new.cast(kind)).otherwise(col(c)).alias(c)

    return joined.select(*(col(c) if c == row_id else updated(c, kind) for c, kind in df.dtypes))


def split_input(df: DataFrame, row_id: str, k: int, targets: Iterable[str] = (), q: int = 2, algorithm: str = "bisect-kmeans") -> DataFrame:
    """M4: (row id, k): the cluster of each row by the q-grams of its cells.

    `bisect-kmeans` is bisecting k-means, `kmeans++` is k-means.
    """
    if algorithm not in ("bisect-kmeans", "kmeans++"):
        raise ValueError(f"No clustering of the name {algorithm}")
    names = list(targets) or [c for c in df.columns if c != row_id]
    grams = df.select(col(row_id), F.concat(*(qgrams(col(c).cast("string"), q) for c in names)).alias("__grams"))
    features = CountVectorizer(inputCol="__grams", outputCol="__features").fit(grams).transform(grams).drop("__grams")
    learner = (BisectingKMeans if algorithm == "bisect-kmeans" else KMeans)(featuresCol="__features", predictionCol="k", k=k, seed=0)
    return learner.fit(features).transform(features).drop("__features")


def inject_null(df: DataFrame, targets: Iterable[str], ratio: float = 0.01, seed: int | None = None) -> DataFrame:
    """M6: df with about a `ratio` of the targets' cells null."""
    if not 0 < ratio <= 1:
        raise ValueError(f"`null_ratio` must be over 0 and at most 1, not {ratio}")
    names = list(targets)
    need_columns(df, *names)
    rand = lambda i: F.rand() if seed is None else F.rand(seed + i)
    return df.select(*(F.when(rand(i) > ratio, col(c)).alias(c) if c in names else col(c) for i, c in enumerate(df.columns)))


def histograms(df: DataFrame, targets: Iterable[str]) -> DataFrame:
    """M7: (attribute, histogram): the values of each text column and their counts.

    Counts of all columns come from one shuffle; a histogram is as long as its domain.
    """
    kinds = dict(df.dtypes)
    names = [c for c in targets if c in kinds and kinds[c] not in FIXED_SIZE]
    if not names:
        return df.sparkSession.createDataFrame([], "attribute string, histogram array<struct<value: string, cnt: bigint>>")
    cells = F.array(*(F.struct(F.lit(c).alias("attribute"), col(c).cast("string").alias("value")) for c in names))
    counts = df.select(F.inline(cells)).where("value is not null").groupBy("attribute", "value").agg(F.count("*").alias("cnt"))
    return counts.groupBy("attribute").agg(F.array_sort(F.collect_list(F.struct("value", "cnt"))).alias("histogram"))


def error_map(df: DataFrame, cells: DataFrame, row_id: str) -> DataFrame:
    """M8: (row id, error_map): a character of each column in order, * at error cells."""
    need_columns(cells, row_id, "attribute", table="error cells")
    per_row = cells.groupBy(col(row_id).alias("__id")).agg(F.collect_set("attribute").alias("__errors"))
    joined = df.select(col(row_id)).join(per_row, col(row_id) == F.col("__id"), "left")
    mark = lambda c: F.when(F.coalesce(F.array_contains("__errors", c), F.lit(False)), "*").otherwise("-")
    return joined.select(col(row_id), F.concat(*(mark(c) for c in df.columns if c != row_id)).alias("error_map"))
