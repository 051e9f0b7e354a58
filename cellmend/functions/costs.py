"""Update costs (F1 to F3): what it costs to change one value into another."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class UpdateCostFunction(ABC):
    """F1. A cost is null where either value is null or empty."""

    def __init__(self, targets: list[str] | None = None):
        self.targets = list(targets or [])

    @abstractmethod
    def cost(self, x: Column, y: Column) -> Column:
        """The cost of two non-null, non-empty strings, as a double."""

    def compute(self, x: Any, y: Any) -> float | None:
        """The cost of two Python values."""
        return self._compute(x, y) if x and y else None

    @abstractmethod
    def _compute(self, x: Any, y: Any) -> float | None: ...

    def column(self, x: Column, y: Column) -> Column:
        return F.when((x != "") & (y != ""), self.cost(x, y))

    def columns(self, x: Column, ys: Column) -> Column:
        """The costs of x and each of an array."""
        return F.transform(ys, lambda y: self.column(x, y))


class Levenshtein(UpdateCostFunction):
    """the edit distance."""

    def __str__(self) -> str:
        return "Levenshtein()"

    def cost(self, x: Column, y: Column) -> Column:
        return F.levenshtein(x, y).cast("double")

    def _compute(self, x: Any, y: Any) -> float:
        a, b = str(x), str(y)
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
        return float(row[-1])


class UserDefinedUpdateCostFunction(UpdateCostFunction):
    """a function of two values that returns a float; exceptions make null costs."""

    def __init__(self, f: Callable[[Any, Any], float], targets: list[str] | None = None):
        super().__init__(targets)
        self.f = f
        try:
            sound = isinstance(f("x", "y"), float)
        except Exception:  # whatever a user's function raises
            sound = False
        if not sound:
            raise ValueError("`f` must make a float of two values")

    def __str__(self) -> str:
        return "UserDefinedUpdateCostFunction()"

    def _compute(self, x: Any, y: Any) -> float | None:
        try:
            return float(self.f(x, y))
        except Exception:  # a cost that can't be told is null
            return None

    def cost(self, x: Column, y: Column) -> Column:
        compute = self._compute

        @F.pandas_udf("double")
        def of_pairs(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([compute(p, q) for p, q in zip(a, b, strict=True)], dtype=float)

        return of_pairs(x, y)

    def columns(self, x: Column, ys: Column) -> Column:
        compute = self._compute

        @F.pandas_udf("array<double>")
        def of_arrays(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([None if q is None else [compute(p, z) if p and z else None for z in q] for p, q in zip(a, b, strict=True)])

        return of_arrays(x, ys)
