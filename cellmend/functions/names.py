"""Names of columns that may hold blanks, dots or backquotes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """The column of this very name."""
    return F.col(quoted(name))
