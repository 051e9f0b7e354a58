"""Input tables: how they are named, and what they must be like."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmend.functions.names import col

CONTINUOUS = {"tinyint", "smallint", "int", "bigint", "float", "double"}
INTEGRAL = {"tinyint", "smallint", "int", "bigint"}
SUPPORTED = (*sorted(CONTINUOUS), "string")


def resolve(spark: SparkSession, table: str | DataFrame, db: str = "") -> DataFrame:
    """A DataFrame as it is, or the table or view of a name."""
    if isinstance(table, DataFrame):
        return table
    return spark.table(f"{db}.{table}" if db else table)


def need_columns(df: DataFrame, *names: str, table: str = "input") -> None:
    for name in names:
        if name not in df.columns:
            raise ValueError(f"'{table}' has no column '{name}'")


def continuous_columns(df: DataFrame, *without: str) -> list[str]:
    return [c for c, kind in df.dtypes if kind in CONTINUOUS and c not in without]


def check_input(df: DataFrame, row_id: str, table: str = "input") -> list[str]:
    """The continuous columns of a table that can be repaired.

    Types must be supported, there must be two columns besides the row id, and the row id
    must be unique, which a single aggregation over that column tells.
    """
    need_columns(df, row_id, table=table)
    unsupported = [f"{c}:{kind}" for c, kind in df.dtypes if kind not in SUPPORTED]
    if unsupported:
        raise ValueError(f"Columns of these types can't be repaired: {', '.join(unsupported)} (only {', '.join(SUPPORTED)})")
    if len(df.columns) < 3:
        raise ValueError(f"'{table}' needs two columns besides `{row_id}`")
    repeated = df.groupBy(col(row_id)).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*"), F.sum("n")).first()
    if repeated[0]:
        raise ValueError(f"Row ids must be unique, but {repeated[0]} values of '{row_id}' are in {repeated[1]} rows of '{table}'")
    return continuous_columns(df, row_id)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """I4: a CSV file with a header, of a given or an inferred schema."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def save_result(df: DataFrame, name: str) -> str:
    """Saves a table, under a name with the time if the name is taken; returns the name."""
    if df.sparkSession.catalog.tableExists(name):
        name = f"{name}_{time.strftime('%Y%m%d%H%M%S')}"
    df.write.saveAsTable(name)
    return name
