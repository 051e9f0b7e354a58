"""The batch job (I7): repairs a catalog table into another.

spark-submit -m cellmend.cli --db DB --input TABLE --row-id COLUMN --output TABLE
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from cellmend.api import Mender
from cellmend.sources.tables import save_result


def main(args: list[str] | None = None) -> str:
    """Returns the name under which the repaired table was saved."""
    parser = argparse.ArgumentParser(prog="cellmend", description="Repairs a table.")
    parser.add_argument("--db", default="", help="database of the input table")
    parser.add_argument("--input", required=True, help="table to repair")
    parser.add_argument("--row-id", required=True, help="column of unique values")
    parser.add_argument("--output", required=True, help="table to write")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("cellmend").config("spark.sql.cbo.enabled", "true").config("spark.sql.statistics.histogram.enabled", "true").config("spark.sql.statistics.histogram.numBins", "254").config("spark.sql.adaptive.enabled", "true").getOrCreate()
    spark.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    model = Mender.getOrCreate().repair.setTableName(given.input).setRowId(given.row_id)
    if given.db:
        model.setDbName(given.db)
    name = save_result(model.run(repair_data=True), given.output)
    print(f"Saved the repaired table as {name}", file=sys.stderr)
    spark.catalog.clearCache()
    return name


if __name__ == "__main__":
    main()
