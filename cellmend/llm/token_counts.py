"""Operator 4: token counts of the documents in flat token files.

A flat file is a stream of token ids in which an end-of-document id follows each document;
nothing says where documents start, and there is no index. It is read in byte ranges of
equal size, cut anywhere, so a file of any length is searched by many tasks. Each block is
searched for the separator with numpy, and gives a small summary and the places of its
separators. Documents that cross blocks are stitched by a prefix scan over the summaries: the
tokens and separators before a block, and the place of the last separator before it. The scan
has two levels, within chunks of blocks and over the chunks, so that a file of any length is
scanned without one task holding all its blocks.

Files are opened by their address with pyarrow's file systems (local and mounted folders,
hdfs, s3, gs); each task writes one of its own, whose name holds its attempt, and only the
files that a finished attempt reports are ever read, so a lost executor leaves no trace.

A file's end ends its last document, if it has tokens after the last separator. Empty
documents count zero tokens, empty files hold none. Null text is written as an empty
document; repeated rows are documents of their own. Rows of null id keep it. Ids that the
type can't hold, and files that end within a token, are errors.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellmend.llm.bpe import pieces, vocabulary
from cellmend.llm.common import bounded_batches, checkpoint_folder, checkpointed, col, texts

#: Tokens of a block, and blocks of a chunk of the scan.
BLOCK_TOKENS, CHUNK_BLOCKS = 1 << 20, 256
#: Bytes of files that a task searches.
TASK_BYTES = 64 << 20
DTYPE = "<u2"


def opened(address: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address, and the path in it."""
    address = re.sub(r"^file:/+", "/", address)
    return (fs.LocalFileSystem(), address) if address.startswith("/") else fs.FileSystem.from_uri(address)


def as_ids(ids: bytes, dtype: str) -> bytes:
    """Ids of four bytes each, as those of the file's type."""
    numbers = np.frombuffer(ids, "<u4")
    if len(numbers) and numbers.max() > np.iinfo(dtype).max:
        raise OverflowError(f"id {numbers.max()} doesn't fit {dtype}")
    return numbers.astype(dtype).tobytes()


def write_tokens(df: DataFrame, path: str, separator: int, id_col: str = "doc_id", text_col: str = "text", dtype: str = DTYPE, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The texts' flat files (file, length), and the manifest (file, seq, id).

    The vocabulary is read from the file `path`. Each partition makes one file in `folder`, or
    in a new one in the shared folder. The manifest has the documents' order only, nothing of
    where they are.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    bounded_batches(df.sparkSession)
    folder = folder or f"{checkpoint_folder(df.sparkSession)}/tokens-{uuid.uuid4().hex}"
    source = df.select(col(id_col).alias("id"), col(text_col).alias("text"))
    kind = source.schema["id"].dataType
    own = to_arrow_type(kind)
    schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("length", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("ids", T.ArrayType(kind))])
    arrow = pa.schema([("file", pa.string()), ("length", pa.int64()), ("seq", pa.int64()), ("ids", pa.list_(own))])
    end = as_ids(np.array([separator], "<u4").tobytes(), dtype)

    def run(batches):
        v, task = vocabulary(path), TaskContext.get()
        file = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}.bin"
        system, place = opened(file)
        system.create_dir(place.rpartition("/")[0], recursive=True)
        seq = length = 0
        with system.open_output_stream(place) as out:
            for batch in batches:
                for text in texts(batch.column(1)):
                    written = as_ids(b"".join(map(v.cache.__getitem__, pieces(text))), dtype) + end
                    out.write(written)
                    length += len(written)
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([None], pa.int64()), pa.array([seq]), pa.array([batch.column(0).to_pylist()], pa.list_(own))], schema=arrow)
                seq += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([length]), pa.array([None], pa.int64()), pa.array([None], pa.list_(own))], schema=arrow)

    written = checkpointed(source.mapInArrow(run, schema))
    manifest = written.where("ids is not null").select("file", "seq", F.posexplode("ids").alias("at", "id")).select("file", (F.col("seq") + F.col("at")).alias("seq"), "id")
    return written.where("length is not null").select("file", "length"), manifest


def token_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, length) of the files at `path`, of any length; their contents aren't read."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length")


def read_blocks(files: DataFrame, dtype: str = DTYPE) -> DataFrame:
    """(file, block, data) of files (file, length), in byte ranges."""
    bounded_batches(files.sparkSession)
    size = BLOCK_TOKENS * np.dtype(dtype).itemsize
    ranges = files.where("length > 0").select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) div {size}"))).alias("block"))
    total = files.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, min(-(-total // size), max(files.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))))

    def run(batches):
        for batch in batches:
            for file, length, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if length % np.dtype(dtype).itemsize:
                    raise ValueError(f"{file} ends within a token")
                system, place = opened(file)
                with system.open_input_file(place) as source:
                    data = source.read_at(min(size, length - block * size), block * size)
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block]), pa.array([data], pa.binary())], names=["file", "block", "data"])

    return ranges.repartition(tasks, "file", "block").mapInArrow(run, "file string, block long, data binary")


def count_tokens(files: DataFrame, separator: int, dtype: str = DTYPE) -> DataFrame:
    """(file, seq, start, n_tokens) of each document in flat files (file, length)."""
    return count_in_blocks(read_blocks(files, dtype), separator, dtype)


def count_in_blocks(blocks: DataFrame, separator: int, dtype: str = DTYPE) -> DataFrame:
    """(file, seq, start, n_tokens) of each document in blocks (file, block, data)."""
    bounded_batches(blocks.sparkSession)
    kind = blocks.schema["file"].dataType
    schema = T.StructType([T.StructField("file", kind), *(T.StructField(c, T.LongType()) for c in ("block", "n", "ends", "first", "last")), T.StructField("places", T.BinaryType())])

    def search(batches):
        for batch in batches:
            n, found = [], []
            for data in batch.column(2):
                tokens = np.frombuffer(data.as_buffer() or b"", dtype)
                n.append(len(tokens))
                found.append(np.flatnonzero(tokens == separator).astype("<i4"))
            ends = [len(x) for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(ends, pa.int64()), pa.array([int(x[0]) if len(x) else None for x in found], pa.int64()), pa.array([int(x[-1]) if len(x) else None for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], names=schema.names)

    scanned = checkpointed(blocks.select("file", "block", "data").mapInArrow(search, schema)).withColumn("chunk", F.floor(F.col("block") / CHUNK_BLOCKS))
    inner = Window.partitionBy("file", "chunk").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    local = scanned.withColumns({"at": F.coalesce(F.sum("n").over(inner), zero), "seq": F.coalesce(F.sum("ends").over(inner), zero)})
    local = local.withColumn("before", F.max(F.col("at") + F.col("last")).over(inner))
    chunks = local.groupBy("file", "chunk").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"), F.max(F.col("at") + F.col("last")).alias("last"))
    chunks = chunks.withColumns({"chunk_at": F.coalesce(F.sum("n").over(outer), zero), "chunk_seq": F.coalesce(F.sum("ends").over(outer), zero)})
    chunks = chunks.withColumn("chunk_before", F.max(F.col("chunk_at") + F.col("last")).over(outer))
    totals = chunks.groupBy("file").agg(F.sum("n").alias("n"), F.sum("ends").alias("seq"), F.max(F.col("chunk_at") + F.col("last")).alias("last"))
    placed = local.join(chunks.select("file", "chunk", "chunk_at", "chunk_seq", "chunk_before"), ["file", "chunk"])
    placed = placed.where("ends > 0").select("file", (F.col("chunk_at") + F.col("at")).alias("at"), (F.col("chunk_seq") + F.col("seq")).alias("seq"), F.coalesce(F.col("chunk_at") + F.col("before"), F.col("chunk_before"), F.lit(-1)).alias("before"), "places")
    out = T.StructType([T.StructField("file", kind), *(T.StructField(c, T.LongType()) for c in ("seq", "start", "n_tokens"))])

    def measure(batches):
        for batch in batches:
            files, rows = [], []
            for i, (at, seq, before, places) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 4)), strict=True)):
                ends = np.frombuffer(places, "<i4").astype(np.int64) + at
                starts = np.concatenate([[before], ends[:-1]]) + 1
                files += [i] * len(ends)
                rows.append(np.stack([seq + np.arange(len(ends)), starts, ends - starts]))
            table = np.concatenate(rows, axis=1) if rows else np.empty((3, 0), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(files, pa.int64())), *(pa.array(x) for x in table)], names=out.names)

    open_end = totals.select("file", "seq", (F.coalesce("last", F.lit(-1)) + 1).alias("start"), (F.col("n") - F.coalesce("last", F.lit(-1)) - 1).alias("n_tokens")).where("n_tokens > 0")
    return placed.mapInArrow(measure, out).union(open_end)
