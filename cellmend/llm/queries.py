"""The queries that apply each operator of this subpackage to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmend.llm import bpe, chat, decontam, langid, licenses, line_dedup, pii, simhash, sketch, token_counts
from cellmend.llm.common import documents

#: The public tokenizers' files; executors look for them by name where they lie elsewhere.
BYTE_BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: The id that ends a document in flat token files.
END_OF_DOCUMENT = 50256


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and their decoding, as digests."""
    done = bpe.round_trip(documents(spark, sf_dir).select("doc_id", "text"), BYTE_BPE)
    return done.select("doc_id", bpe.n_ids("ids").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data and secrets: the base kinds' counts and all spans."""
    found = pii.find_pii(documents(spark, sf_dir).select("doc_id", "text"))
    counts = [pii.count_kind("base", k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.joined(F.array_sort(F.concat("base", "added"))).alias("spans"), pii.count_kind("added", "secret").alias("n_secret"), F.size("added").cast("long").alias("n_added"), (F.size("base") + F.size("added")).cast("long").alias("n_spans"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, by a model of the documents that aren't held out."""
    docs = documents(spark, sf_dir)
    model = langid.train(docs, langid.vocabulary(PIECES))
    done = langid.predict(docs.select("doc_id", "text"), model)
    return done.select("doc_id", (langid.remainder("doc_id") == 2).alias("held_out"), "lang_pred", "score")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, counted in the flat files of all documents."""
    files, manifest = token_counts.write_tokens(documents(spark, sf_dir), BYTE_BPE, END_OF_DOCUMENT)
    counted = token_counts.count_tokens(files, END_OF_DOCUMENT)
    number = F.regexp_extract("file", r"part-([0-9]+)-", 1).cast("int").alias("file")
    return manifest.join(counted, ["file", "seq"]).select(F.col("id").alias("doc_id"), number, "seq", "start", "n_tokens")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that at least three documents share."""
    done = line_dedup.drop_shared_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's license phrases and fuzzy notices."""
    done = licenses.scan_licenses(documents(spark, sf_dir).select("doc_id", "text"))
    starts = F.transform("exact", lambda x: x["start"])
    return done.select(
        "doc_id", "n_words", F.size("exact").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        licenses.label_list(F.col("exact")).alias("base_labels"), licenses.label_list(F.col("exact"), F.col("fuzzy")).alias("labels"), "score",
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item in every document that contains it."""
    return decontam.contained_items(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's SimHash of 3-word shingles and its component at radius 2."""
    found = simhash.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", simhash.hex_fingerprint("fingerprint").alias("fingerprint"), "component_id")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's sketch against those of its edited text and of the next document."""
    done = sketch.compare_with_edits(documents(spark, sf_dir).select("doc_id", "text"))
    own, edited, following = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return done.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), sketch.text_form(own).alias("fingerprint"), sketch.text_form(edited).alias("edited_fingerprint"),
        sketch.likeness(own, edited).alias("near_edited"), sketch.likeness(own, following).alias("near_next"), sketch.containment(own, edited).alias("contained_in_edited"),
    )


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one of control strings only, formatted and read back."""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    done = chat.read_conversations(chat.format_conversations(table.unionByName(own)))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_pii": op2_pii,
    "op3_language": op3_language,
    "op4_token_counts": op4_token_counts,
    "op5_line_dedup": op5_line_dedup,
    "op6_license_scan": op6_license_scan,
    "op7_decontamination": op7_decontamination,
    "op8_simhash": op8_simhash,
    "op9_fingerprints": op9_fingerprints,
    "op10_chat": op10_chat,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINES = f"""WITH l AS (SELECT doc_id, generate_subscripts(x, 1) AS n, unnest(x) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
k AS (SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), '{_UPPER}', '{_LOWER}') AS key FROM l),
s AS (SELECT key, max(doc_id) AS stays FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE stays <> doc_id) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE stays IS NULL OR stays = doc_id), '')) AS kept_sha256
FROM k LEFT JOIN s USING (key) GROUP BY doc_id"""
_WORDS = r"regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SHINGLES = "unnest(list_distinct(list_transform(range(1, len(x) - w + 2), lambda i: array_to_string(x[i:i + w - 1], ' '))))"
_LEAKS = f"""WITH i AS (SELECT item_id, x, least(5, len(x)) AS w FROM (SELECT item_id, {_WORDS} AS x FROM benchmark) WHERE len(x) > 0),
own AS (SELECT item_id, w, {_SHINGLES} AS s FROM i), size AS (SELECT item_id, count(*) AS n FROM own GROUP BY item_id),
d AS (SELECT doc_id, w, {_SHINGLES} AS s FROM (SELECT doc_id, {_WORDS} AS x FROM documents), (SELECT DISTINCT w FROM i)),
shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN own USING (w, s) GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n AS n_shingles, CAST(n_shared AS DOUBLE) / n AS containment FROM shared JOIN size USING (item_id) WHERE 10 * n_shared >= 8 * n"""


def _escaped_length(x: str) -> str:
    """The length of an escaped text: two more for each control string, one for each escape."""
    count = lambda c: f"(length({x}) - length(replace({x}, {c}, '')))"
    return " + ".join([f"length({x})", count(f"chr({ord(chat.ESCAPE)})"), *(f"2 * ({count(repr(c))} // {len(c)})" for c in chat.CONTROLS)])


_SAID = "</s>[INST] ok [/INST]"
_CHAT = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '{_SAID}'), (-1, 1, 'assistant', '{_SAID}'))),
o AS (SELECT *, {_escaped_length('text')} + {_escaped_length('role')} + length(role) - length(replace(role, chr(10), '')) + {len(chat.BEGIN) + len(chat.END) + 2} AS size FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
CAST(sum(size) AS BIGINT) AS formatted_chars FROM o GROUP BY conv_id"""

#: The other operators merge bytes, hash, fit or match in ways that SQL has no functions for.
ORACLE_SQL = {"op5_line_dedup": _LINES, "op7_decontamination": _LEAKS, "op10_chat": _CHAT}
