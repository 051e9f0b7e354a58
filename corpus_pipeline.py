"""From raw documents to token ids: each stage works on all that the one before has kept.

Stages are written as Parquet and read again between one another. All but the last return
the columns of documents. A SQL oracle can't express the stages, so their results are tested
against brute-force versions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmend.llm import bpe, decontam, langid, line_dedup, near_copies
from cellmend.llm.common import checkpoint_folder, remove
from cellmend.llm.queries import BYTE_BPE, PIECES

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents whose language is less sure (of three languages or more) are rejected, as are those
#: without any letter.
LEAST_SCORE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is told; learns from labelled ones that aren't held out."""
    model = langid.train(docs, langid.vocabulary(PIECES))
    told = langid.predict(docs, model, out="__lang", score="__score")
    return told.where((F.col("__lang") != langid.UND) & (F.col("__score") >= LEAST_SCORE)).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines that at least three documents share out of all but one; no document goes."""
    done = line_dedup.drop_shared_lines(docs, out_col="__kept")
    return done.select("doc_id", F.col("__kept").alias("text"), "lang", "source", F.length("__kept").cast("long").alias("n_chars"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id in each group that shares 0.8 of its five-word shingles:
    operator 8 with wide fingerprints, whose links are verified."""
    return near_copies.drop_near_copies(docs).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that contain no benchmark item."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids, and digests that show that they decode to the texts."""
    done = bpe.round_trip(docs.select("doc_id", "text", "lang", "source"), BYTE_BPE)
    return done.select("doc_id", "lang", "source", bpe.n_ids("ids").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("BPE encoding", encode),
]

#: The stages learn and hash in ways that SQL has no functions for.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what they hand on is written to the shared folder, and removed
    once the next stage is written."""
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
