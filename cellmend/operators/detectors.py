"""Error detectors (D1 to D11): each finds the cells (row id, attribute) that look wrong.

Detectors that judge a row by itself give conditions instead of plans, so any number of them
run in one scan that explodes the names of the attributes they flag (R7).
"""

from __future__ import annotations

import copy
import math
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable
from functools import reduce
from operator import or_
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellmend.functions.names import col
from cellmend.operators import stats
from cellmend.plans import constraints as dc
from cellmend.session import ship_package
from cellmend.sources.tables import need_columns

Flag = tuple[str, Column]


def no_cells(df: DataFrame, row_id: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], T.StructType([df.schema[row_id], T.StructField("attribute", T.StringType(), False), T.StructField("current_value", T.StringType())]))


def flagged(df: DataFrame, row_id: str, flags: list[Flag]) -> DataFrame:
    """(row id, attribute, current_value) of the conditions that hold, from one scan."""
    if not flags:
        return no_cells(df, row_id)
    by_attr: dict[str, Column] = {}
    for attr, condition in flags:
        by_attr[attr] = by_attr[attr] | condition if attr in by_attr else condition
    cells = F.array(*(F.when(flag, _cell(attr)) for attr, flag in by_attr.items()))
    # The filter comes first, so that the scan can use it.
    wrong = df.where(reduce(or_, by_attr.values()))
    return wrong.select(col(row_id), F.inline(F.filter(cells, lambda c: c.isNotNull())))


def _cell(attr: str) -> Column:
    return F.struct(F.lit(attr).alias("attribute"), col(attr).cast("string").alias("current_value"))


def cells_of(df: DataFrame, row_id: str, attrs: Iterable[str]) -> DataFrame:
    """(row id, attribute, current_value) of these columns of all rows."""
    return df.select(col(row_id), F.inline(F.array(*map(_cell, attrs))))


class ErrorDetector(ABC):
    """A detector. `setUp` tells it the table; `detect` gives its cells."""

    def __init__(self, targets: Iterable[str] = ()):
        self.targets = list(targets)
        self.row_id: str | None = None
        self.df: DataFrame | None = None
        self.continuous: list[str] = []

    def setUp(self, row_id: str, df: DataFrame, continuous_cols: Iterable[str], targets: Iterable[str]) -> ErrorDetector:  # noqa: N802
        self.row_id, self.df, self.continuous = row_id, df, list(continuous_cols)
        wanted = [c for c in targets if c != row_id]
        self._targets = [c for c in self.targets if c in wanted] if self.targets else wanted
        return self

    def __str__(self) -> str:
        return f"{type(self).__name__}({self._shown()})"

    def _shown(self) -> str:
        return ""

    def flags(self) -> list[Flag] | None:
        """Conditions on a single row, or None of a detector that needs other rows too."""
        return None

    def cells(self) -> DataFrame:
        """(row id, attribute, current_value): values come along, so that no join fetches them."""
        flags = self.flags()
        if flags is None:
            raise NotImplementedError
        return flagged(self.df, self.row_id, flags)

    def detect(self) -> DataFrame:
        """(row id, attribute)."""
        return self.cells().select(col(self.row_id), "attribute")


class NullErrorDetector(ErrorDetector):
    """Null cells."""

    def flags(self) -> list[Flag]:
        return [(c, col(c).isNull()) for c in self._targets]


class DomainValues(ErrorDetector):
    """Cells outside the given values, or (autofill) the values seen more than
    `min_count_thres` times; null is outside. Continuous columns are skipped.

    Values are compared whole. match="regex" searches for them as alternatives of one regular
    expression instead, anywhere in the cell.
    """

    def __init__(self, attr: str, values: Iterable[Any] = (), autofill: bool = False, min_count_thres: int = 12, match: str = "exact"):
        super().__init__([attr])
        self.attr, self.values, self.autofill, self.min_count_thres, self.match = attr, [str(v) for v in values], autofill, min_count_thres, match

    def _shown(self) -> str:
        return f'attr="{self.attr}",size={len(self.values)},autofill={self.autofill},min_count_thres={self.min_count_thres}'

    def _applies(self) -> bool:
        return self.attr in self._targets and self.attr not in self.continuous

    def flags(self) -> list[Flag] | None:
        if not self._applies():
            return []
        if self.autofill and self.match == "exact":
            return None
        values = [r[0] for r in self.frequent().collect()] if self.autofill else self.values
        text = col(self.attr).cast("string")
        known = (text.rlike("(" + "|".join(values) + ")") if self.match == "regex" else text.isin(values)) if values else F.lit(False)
        return [(self.attr, ~known | text.isNull())]

    def frequent(self) -> DataFrame:
        return self.df.where(col(self.attr).isNotNull()).groupBy(col(self.attr).cast("string").alias("__value")).count().where(F.col("count") > self.min_count_thres).select("__value")

    def cells(self) -> DataFrame:
        if self.flags() is not None:
            return super().cells()
        narrow = self.df.select(col(self.row_id), col(self.attr))
        outside = narrow.join(self.frequent(), col(self.attr).cast("string") == F.col("__value"), "left_anti")
        return cells_of(outside, self.row_id, [self.attr])


class RegExErrorDetector(ErrorDetector):
    """D3: cells in which the regular expression is found nowhere, and null cells."""

    def __init__(self, attr: str, regex: str):
        super().__init__([attr])
        self.attr, self.regex = attr, regex

    def _shown(self) -> str:
        return f'pattern="{self.regex}"'

    def flags(self) -> list[Flag]:
        if self.attr not in self._targets or not (self.regex or "").strip():
            return []
        return [(self.attr, ~col(self.attr).cast("string").rlike(self.regex) | col(self.attr).isNull())]


class ConstraintErrorDetector(ErrorDetector):
    """The referenced target cells of rows that violate a denial constraint."""

    def __init__(self, constraint_path: str = "", constraints: str = "", targets: Iterable[str] = ()):
        super().__init__(targets)
        if not constraint_path and not constraints:
            raise ValueError("Either `constraint_path` or `constraints` is needed")
        self.constraint_path, self.constraints = constraint_path, constraints

    def _shown(self) -> str:
        return ",".join(f'{k}="{v}"' for k, v in (("constraint_path", self.constraint_path), ("constraints", self.constraints)) if v)

    def parsed(self) -> list[dc.Constraint]:
        texts = (dc.read_file(self.constraint_path) if self.constraint_path else []) + dc.split_inline(self.constraints)
        return dc.load(texts, self.df.columns)

    def cells(self) -> DataFrame:
        found = []
        for c in self.parsed():
            attrs = [a for a in c.references if a in self._targets]
            if attrs:
                needed = self.df.select(*(col(n) for n in dict.fromkeys([self.row_id, *c.references, *_named(self.df, c)])))
                found.append(cells_of(dc.violating_rows(needed, c), self.row_id, attrs))
        if len(found) == 1:  # each row comes once
            return found[0]
        return reduce(DataFrame.union, found).distinct() if found else no_cells(self.df, self.row_id)


def _named(df: DataFrame, constraint: dc.Constraint) -> list[str]:
    """Columns that a constant's SQL text may name."""
    text = " ".join(p.right for p in constraint.predicates if p.constant)
    return [c for c in df.columns if c in text]


class GaussianOutlierErrorDetector(ErrorDetector):
    """Continuous cells beyond Tukey's fences, 1.5 interquartile ranges from the quartiles."""

    def __init__(self, approx_enabled: bool = False):
        super().__init__()
        self.approx_enabled = approx_enabled

    def _shown(self) -> str:
        return f"approx_enabled={self.approx_enabled}"

    def fences(self) -> dict[str, tuple[float, float]]:
        """Of each column, from one aggregation."""
        names = [c for c in self._targets if c in self.continuous]
        if not names:
            return {}
        if self.approx_enabled:
            row = self.df.agg(*(F.percentile_approx(col(c), F.array(F.lit(0.25), F.lit(0.75)), 1000).alias(f"q{i}") for i, c in enumerate(names))).first()
        else:
            row = stats.quantiles(self.df, {c: col(c) for c in names}, [0.25, 0.75]).values()
        out = {}
        for c, q in zip(names, row, strict=True):
            if q is not None and None not in q:
                out[c] = (q[0] - 1.5 * (q[1] - q[0]), q[1] + 1.5 * (q[1] - q[0]))
        return out

    def flags(self) -> list[Flag]:
        return [(c, (col(c) < low) | (col(c) > high)) for c, (low, high) in self.fences().items()]


class FittedOutlierErrorDetector(ErrorDetector):
    """Continuous cells that an estimator's `fit_predict` marks with -1, nulls being filled
    with the median.

    Up to `parallel_mode_threshold` rows are fitted together. Beyond, rows are dealt by a hash
    of their id into groups of at most about that size, and at least `num_parallelism`, each
    fitted by itself, which approximates the fit of the whole column.
    """

    def __init__(self, parallel_mode_threshold: int = 10000, num_parallelism: int | None = None):
        super().__init__()
        if num_parallelism is not None and num_parallelism <= 0:
            raise ValueError(f"`num_parallelism` must be positive, not {num_parallelism}")
        self.parallel_mode_threshold, self.num_parallelism = parallel_mode_threshold, num_parallelism

    @abstractmethod
    def _estimator(self) -> Any: ...

    def cells(self) -> DataFrame:
        names = [c for c in self._targets if c in self.continuous]
        if not names:
            return no_cells(self.df, self.row_id)
        ship_package(self.df.sparkSession)
        n = self.df.count()
        medians = [q and q[0] for q in stats.quantiles(self.df, {c: col(c) for c in names}, [0.5]).values()]
        groups = 1 if n <= self.parallel_mode_threshold else max(self.num_parallelism or 1, math.ceil(n / self.parallel_mode_threshold))
        values = F.array(*(F.struct(F.lit(c).alias("attribute"), F.coalesce(col(c).cast("double"), F.lit(m)).alias("value"), col(c).cast("string").alias("current_value")) for c, m in zip(names, medians, strict=True) if m is not None))
        cells = self.df.select(col(self.row_id).alias("__id"), F.inline(values)).withColumn("__group", F.pmod(F.xxhash64("__id"), F.lit(groups)))
        estimator = self._estimator()

        def fit(group: pd.DataFrame) -> pd.DataFrame:
            wrong = np.asarray(copy.deepcopy(estimator).fit_predict(group[["value"]].to_numpy())) < 0
            return group.loc[wrong, ["__id", "attribute", "current_value"]]

        schema = T.StructType([T.StructField("__id", self.df.schema[self.row_id].dataType), T.StructField("attribute", T.StringType()), T.StructField("current_value", T.StringType())])
        return cells.groupBy("attribute", "__group").applyInPandas(fit, schema).select(F.col("__id").alias(self.row_id), "attribute", "current_value")


#: The name under which users of fitted detectors know the base.
ScikitLearnBasedErrorDetector = FittedOutlierErrorDetector


class ScikitLearnBackedErrorDetector(FittedOutlierErrorDetector):
    """D6 with an estimator that the user makes."""

    def __init__(self, error_detector_cls: Callable[[], Any], parallel_mode_threshold: int = 10000, num_parallelism: int | None = None):
        super().__init__(parallel_mode_threshold, num_parallelism)
        if not callable(error_detector_cls):
            raise ValueError("`error_detector_cls` must be callable")
        if not hasattr(error_detector_cls(), "fit_predict"):
            raise ValueError("What `error_detector_cls` makes must have `fit_predict`")
        self.error_detector_cls = error_detector_cls

    def _estimator(self) -> Any:
        return self.error_detector_cls()


class LocalOutlierFactor:
    """The published local outlier factor, of one column: -1 where it is over 1.5."""

    def __init__(self, neighbours: int = 20):
        self.neighbours = neighbours

    def fit_predict(self, x: np.ndarray) -> np.ndarray:
        v = np.asarray(x, float).ravel()
        n = len(v)
        k = min(self.neighbours, n - 1)
        if k < 1:
            return np.ones(n, int)
        order = np.argsort(v, kind="stable")
        s = v[order]
        # In sorted order the k nearest are among k on either side.
        at = np.arange(n)[:, None] + np.concatenate([np.arange(-k, 0), np.arange(1, k + 1)])
        far = np.where((at < 0) | (at >= n), np.inf, np.abs(s[np.clip(at, 0, n - 1)] - s[:, None]))
        near = np.argsort(far, axis=1, kind="stable")[:, :k]
        who, distance = np.take_along_axis(np.clip(at, 0, n - 1), near, 1), np.take_along_axis(far, near, 1)
        reach = np.maximum(distance, distance[:, -1][who])
        density = 1 / (reach.mean(axis=1) + 1e-10)
        factor = density[who].mean(axis=1) / density
        out = np.ones(n, int)
        out[order[factor > 1.5]] = -1
        return out


class LOFOutlierErrorDetector(FittedOutlierErrorDetector):
    """D6 with the local outlier factor."""

    def _estimator(self) -> Any:
        return LocalOutlierFactor()


def default_detectors(columns: Iterable[str]) -> list[ErrorDetector]:
    """Nulls, and values seen at most four times."""
    return [NullErrorDetector(), *(DomainValues(c, autofill=True, min_count_thres=4) for c in columns)]


#: Frequent values that are taken into conditions; beyond, an anti join finds the others.
MOST_VALUES = 10_000


def _filled_domains(df: DataFrame, detectors: list[DomainValues]) -> dict[str, list[str]] | None:
    """The frequent values of each detector's column, from one count over all of them, or None
    of too many."""
    cells = F.array(*(F.struct(F.lit(d.attr).alias("a"), F.lit(d.min_count_thres).alias("least"), col(d.attr).cast("string").alias("v")) for d in detectors))
    counts = df.select(F.inline(cells)).where("v is not null").groupBy("a", "least", "v").count().where("count > least")
    rows = counts.select("a", "v").limit(MOST_VALUES + 1).collect()
    if len(rows) > MOST_VALUES:
        return None
    out: dict[str, list[str]] = {d.attr: [] for d in detectors}
    for r in rows:
        out[r["a"]].append(r["v"])
    return out


def detect_all(df: DataFrame, row_id: str, detectors: Iterable[ErrorDetector], continuous: Iterable[str], targets: Iterable[str]) -> DataFrame:
    """The distinct cells (row id, attribute, current_value) that any detector finds; all
    row-wise ones share one scan."""
    flags: list[Flag] = []
    plans: list[DataFrame] = []
    ready = [d.setUp(row_id, df, list(continuous), list(targets)) for d in detectors]
    filled = [d for d in ready if isinstance(d, DomainValues) and d.flags() is None]
    domains = _filled_domains(df, filled) if filled and len({d.attr for d in filled}) == len(filled) else None
    for d in ready:
        if domains is not None and d in filled:
            text = col(d.attr).cast("string")
            flags.append((d.attr, text.isNull() | ~text.isin(domains[d.attr]) if domains[d.attr] else F.lit(True)))
            continue
        own = d.flags()
        if own is None:
            plans.append(d.cells())
        else:
            flags += own
    if flags or not plans:  # one scan
        plans.insert(0, flagged(df, row_id, flags))
    return plans[0] if len(plans) == 1 else reduce(DataFrame.union, plans).distinct()


def given_cells(cells: DataFrame, row_id: str, columns: Iterable[str]) -> DataFrame:
    """Error cells of the user's, of existing or wanted columns only."""
    need_columns(cells, row_id, "attribute", table="error cells")
    return cells.select(col(row_id), "attribute").where(F.col("attribute").isin(list(columns))).distinct()


def cell_counts(cells: DataFrame, rows: int | None = None) -> DataFrame:
    """The number of error cells of each attribute, and of `rows` rows their ratio."""
    counted = cells.groupBy("attribute").agg(F.count("*").alias("n"))
    return counted if rows is None else counted.withColumn("ratio", F.col("n") / F.lit(rows))


def with_current_values(df: DataFrame, cells: DataFrame, row_id: str) -> DataFrame:
    """(row id, attribute, current_value) of the cells, values as text."""
    names = [c for c in df.columns if c != row_id]
    values = F.create_map(*(x for c in names for x in (F.lit(c), col(c).cast("string"))))
    joined = cells.join(df.select(col(row_id).alias("__id"), values.alias("__values")), col(row_id) == F.col("__id"))
    return joined.select(col(row_id), "attribute", F.try_element_at("__values", F.col("attribute")).alias("current_value"))
