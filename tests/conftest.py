import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ["SPARK_TESTING"] = "1"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def people(spark):
    """Twenty rows with seven nulls, in the style of a census table."""
    rows = []
    for i in range(20):
        age = [None, "18-21", "22-30", "31-50", ">50"][1 + i % 4] if i not in (5, 12) else None
        sex = "Male" if i % 3 else "Female"
        relation = "Husband" if i % 5 else "Own-child"
        rows.append((i, age, relation, sex if i not in (3, 7, 12) else None, "LessThan50K" if i % 4 else "MoreThan50K" if i != 16 else None))
    return spark.createDataFrame(rows, "tid int, age string, relation string, sex string, income string")

