"""Detection and repair of streams, an addition: with what was fitted on a batch before.

Row-wise detectors need no state, so on a stream they are one projection; fences of outliers
and domains are fitted on a batch first. Counts of errors by event-time windows are
aggregated with a watermark, so state is bounded.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmend.functions.names import col
from cellmend.operators import detectors as d
from cellmend.operators.models import FunctionalDepModel, PoorModel, TreeModel


def fitted_flags(batch: DataFrame, row_id: str, found: Iterable[d.ErrorDetector], continuous: Iterable[str], targets: Iterable[str]) -> list[d.Flag]:
    """The conditions of row-wise detectors, with their fences and values from a batch."""
    flags: list[d.Flag] = []
    for x in found:
        if isinstance(x, d.DomainValues) and x.autofill:
            x.setUp(row_id, batch, continuous, targets)
            fixed = d.DomainValues(x.attr, [r[0] for r in x.frequent().collect()], match=x.match)  # a discrete column's domain
            x = fixed
        own = x.setUp(row_id, batch, continuous, targets).flags()
        if own is None:
            raise ValueError(f"{x} needs other rows and can't run on a stream")
        flags += own
    return flags


def detect_stream(stream: DataFrame, row_id: str, flags: list[d.Flag], kept: Iterable[str] = ()) -> DataFrame:
    """(row id, kept columns, attribute) of the error cells of a stream."""
    names = F.array(*(F.when(condition, F.lit(attr)) for attr, condition in flags))
    return stream.select(col(row_id), *(col(c) for c in kept), F.explode(F.array_distinct(F.filter(names, lambda n: n.isNotNull()))).alias("attribute"))


def error_rates(stream: DataFrame, time_col: str, flags: list[d.Flag], window: str = "10 minutes", watermark: str = "30 minutes") -> DataFrame:
    """(window, rows, and the errors of each attribute) of a stream; rows later than the
    watermark are left out."""
    by_attr: dict[str, Column] = {}
    for attr, condition in flags:
        flag = F.coalesce(condition, F.lit(False))
        by_attr[attr] = by_attr[attr] | flag if attr in by_attr else flag
    counts = [F.count_if(condition).alias(f"errors_{attr}") for attr, condition in by_attr.items()]
    return stream.withWatermark(time_col, watermark).groupBy(F.window(time_col, window)).agg(F.count("*").alias("rows"), *counts)


def repair_stream(stream: DataFrame, fitted: dict[str, PoorModel | FunctionalDepModel | TreeModel]) -> DataFrame:
    """The stream with null cells filled by models that were fitted on a batch."""
    for y, model in fitted.items():
        stream = model.fill(stream, y)
    return stream
