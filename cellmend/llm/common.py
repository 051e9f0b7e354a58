"""What the text operators share: column handling, Arrow batches, cut lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellmend.session import ship_package

#: Rows of an Arrow batch. Texts are long, so Spark's default of 10,000 rows would need
#: hundreds of megabytes in a Python worker.
BATCH_ROWS = 1000
#: Bytes of an Arrow batch, which bind before the rows where texts are very long.
BATCH_BYTES = 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by rows and bytes, whatever the length of the texts."""
    ship_package(spark)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows, "10000")) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def tokenizer_file(path: str) -> str:
    """The path itself where this machine has it, else the place of the public file of that name."""
    if os.path.exists(path):
        return path
    import public_tokenizers

    return public_tokenizers.path(os.path.basename(path))


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of `spark.checkpoint.dir`.

    Only where the session names none and runs on one machine a temporary one is set.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp("checkpoints"))
    return context.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in any storage that Spark writes to."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read from there."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, whose size the planner knows."""
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def keep_first(df: DataFrame, id_col: str, text_col: str, find: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The row of the smallest id of each group, null ids last; `find` takes a stored table of
    keys and texts (row, text) and gives the group of each key (row, group)."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    rows = stored(df.toDF(*names.values()).withColumn("row", F.monotonically_increasing_id()))
    found = find(rows.select("row", F.col(names[text_col]).alias("text"))).join(rows.select("row", F.col(names[id_col]).alias("id")), "row")
    stay = found.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"))
    gone = rows.select("row").join(stay.select(F.col("first.row").alias("row")), "row", "left_anti")  # fewer than those that stay
    return rows.join(stored(gone), "row", "left_anti").drop("row").toDF(*names)


def others(df: DataFrame, *names: str) -> list[str]:
    """The columns of df that don't clash, in any case of letters, with new columns `names`."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> F.Column:
    """The column of this very name, dots and blanks included."""
    return F.col(quoted(name))


def append_columns(df: DataFrame, inputs: list[str], fields: list[T.StructField], make: Callable[..., Callable[..., list]], *args) -> DataFrame:
    """df with new columns, computed over Arrow batches without any shuffle.

    `make(*args)` runs once in each task and returns a function that takes the input
    columns of a batch as Arrow arrays and returns an array or list for each field.
    Columns of df that clash with the new ones are replaced.
    """
    bounded_batches(df.sparkSession)
    kept = others(df, *(f.name for f in fields))
    places = {c: i for i, c in enumerate(kept)}
    extra = [c for c in inputs if c not in places]
    # Plain names on the way, as Spark looks the columns up by name without quotes.
    source = df.select(*(col(c).alias(f"__c{i}") for i, c in enumerate([*kept, *extra])))
    places |= {c: len(kept) + i for i, c in enumerate(extra)}
    at, n = [places[c] for c in inputs], len(kept)
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in source.schema.fields[:n]), *(T.StructField(f"__new{i}", f.dataType) for i, f in enumerate(fields))])
    types = [arrow_type(f.dataType) for f in fields]
    names = schema.names

    def run(batches: Iterable[pa.RecordBatch]):
        work = make(*args)
        for batch in batches:
            new = work(*(batch.column(i) for i in at))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *(x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(new, types, strict=True))], names=names)

    return source.mapInArrow(run, schema).toDF(*kept, *(f.name for f in fields))


def arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(arrow_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, arrow_type(f.dataType)) for f in kind.fields])
    return {"string": pa.string(), "binary": pa.binary(), "long": pa.int64(), "integer": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}[kind.typeName()]


def texts(column: pa.Array) -> list[str]:
    """The strings of a column, empty where null."""
    return [x or "" for x in column.to_pylist()]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
