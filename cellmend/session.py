"""What a Spark session needs before Python functions of this package run on executors."""

from __future__ import annotations

import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once an application.

    Python workers import the functions that they run; where the package isn't installed
    with them, Spark's file server hands it out, to executors that join later too.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp("package")) / f"{here.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, Path(here.name) / p.relative_to(here))
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder of `spark.checkpoint.dir` and read from there.

    Only a session on one machine that names no folder gets a temporary one.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp("checkpoints"))
    return df.checkpoint(eager=True)
