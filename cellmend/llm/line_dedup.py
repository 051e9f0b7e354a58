"""Operator 5: drop lines that many documents share, by a sharded minimal perfect hash.

Each document gives its distinct line keys as 128-bit hashes; texts are never shuffled by
line. All distinct hashes are sharded, and a shard becomes one row: a minimal perfect hash
(cascaded bit arrays, a key's slot being the rank of its bit) and a compact array of
fingerprints. Documents' hashes are dealt to the shards and probe them twice. The first time
they are counted: each copy of a shard adds up its own probes by slot, and the sums, a few
numbers for each slot that was met, make the shard's arrays of counts and largest ids. The
second time they probe these arrays: a fingerprint tells members from others, a count tells
what is shared, and the largest id tells who keeps it.

A shard that many probes meet is copied and its probes dealt over the copies by document, so
no line, however common, gathers in one task, and a copy's sums hold a common line once.

A key that qualifies stays only in the largest id that holds it. Null or empty text is one
empty line. A null id counts as one document, smaller than all others; rows of the same id
as one document. Ids are of any type that has an order; those that aren't integers are
numbered in it first. Keys shorter than `min_chars` are left alone. Extra columns are kept;
those named like the new ones are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellmend.llm.common import append_columns, bounded_batches, checkpointed, col, others, texts

STRIPPED = " \t\n\x0b\x0c\r"
#: Keys of a shard.
SHARD_KEYS = 50_000
#: Probes that a shard, or a copy of a hot one, meets.
SHARD_PROBES = 100_000
#: Hot shards, of two integers each, that are broadcast at most; more are joined.
MOST_BROADCAST = 100_000
#: Bits of a level for each key that is still without a slot.
GAMMA = 2


def line_hash(line: str, min_chars: int) -> bytes | None:
    """16 bytes of the line's key; None of a key that is too short."""
    key = line.strip(STRIPPED)
    return xxhash.xxh3_128_digest(key.encode().lower()) if len(key) >= min_chars else None


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Slots 0 to n-1 for n distinct pairs of unsigned 64-bit numbers.

    Each level sends the keys to bits; a bit that one key alone reaches is set and is that
    key's, the others go on to the next level.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, n = [], 0
        for bits in levels:
            self.ranks.append(np.cumsum(bits, dtype=np.int64) - 1 + n)
            n += int(bits.sum())

    @staticmethod
    def _place(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
        step = np.uint64((2 * level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        return (_mix(h1 + h2 * step + np.uint64(level)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        levels = []
        while len(h1):
            size = max(64, GAMMA * len(h1))
            at = cls._place(h1, h2, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = ~alone[at]
            h1, h2 = h1[left], h2[left]
        return cls(levels)

    def slots(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Of each pair; -1, or any slot, of pairs that weren't built in."""
        out, open_ = np.full(len(h1), -1, np.int64), np.arange(len(h1))
        for k, bits in enumerate(self.levels):
            at = self._place(h1[open_], h2[open_], k, len(bits))
            hit = bits[at]
            out[open_[hit]] = self.ranks[k][at[hit]]
            open_ = open_[~hit]
        return out

    def to_bytes(self) -> list[bytes]:
        return [np.uint32(len(b)).tobytes() + np.packbits(b).tobytes() for b in self.levels]

    @classmethod
    def from_bytes(cls, levels) -> PerfectHash:
        return cls([np.unpackbits(np.frombuffer(b, np.uint8, offset=4), count=int(np.frombuffer(b, np.uint32, 1)[0])).astype(bool) for b in levels])


def _unsigned(column) -> np.ndarray:
    return column.to_numpy(np.int64).view(np.uint64)


def line_hashes(df: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(id, h1, h2) of each document's distinct line keys."""
    bounded_batches(df.sparkSession)
    source = df.select(col(id_col).alias("id"), col(text_col).alias("text"))
    kind = source.schema["id"].dataType

    def run(batches):
        for batch in batches:
            at, found = [], []
            for i, text in enumerate(texts(batch.column(1))):
                own = {h for line in text.split("\n") if (h := line_hash(line, min_chars))}
                at += [i] * len(own)
                found += own
            h = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], names=["id", "h1", "h2"])

    return source.mapInArrow(run, T.StructType([T.StructField("id", kind), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())]))


def build_shards(hashes: DataFrame, shards: int) -> DataFrame:
    """A row for each shard of the distinct (h1, h2): its perfect hash and fingerprints."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        h1, h2 = _unsigned(rows["h1"]), _unsigned(rows["h2"])
        index = PerfectHash.build(h1, h2)
        prints = np.empty(len(h2), np.uint64)
        prints[index.slots(h1, h2)] = h2
        return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "levels": [index.to_bytes()], "prints": [prints.tobytes()]})

    sharded = hashes.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int"))
    return sharded.groupBy("shard").applyInPandas(build, "shard int, levels array<binary>, prints binary")


def _probed(rows: pd.DataFrame, shard: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Which rows' hashes are in the shard, and the slots of these."""
    row = shard.iloc[0]
    prints, h1, h2 = np.frombuffer(row["prints"], np.uint64), _unsigned(rows["h1"]), _unsigned(rows["h2"])
    slots = PerfectHash.from_bytes(row["levels"]).slots(h1, h2)
    member = (slots >= 0) & (prints[np.maximum(slots, 0)] == h2)
    return member, slots[member]


def _count(rows: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
    """One row of the slots that a copy's probes meet, their documents and the largest id of each."""
    if not len(shard) or not len(rows):
        return pd.DataFrame({"shard": pd.array([], "Int32"), **{k: pd.array([], object) for k in ("slots", "counts", "largest")}})
    member, slots = _probed(rows, shard)
    met = pd.DataFrame({"slot": slots, "id": rows["id"].to_numpy(np.int64)[member]}).drop_duplicates()
    by = met.groupby("slot")["id"].agg(["size", "max"])
    return pd.DataFrame({"shard": [shard["shard"].iloc[0]], "slots": [by.index.to_numpy(np.int64).tobytes()], "counts": [by["size"].to_numpy(np.int64).tobytes()], "largest": [by["max"].to_numpy(np.int64).tobytes()]})


def _add_up(parts: pd.DataFrame) -> pd.DataFrame:
    """A shard's arrays of counts and largest ids, over its slots, from its copies' sums."""
    slots, n, largest = (np.concatenate([np.frombuffer(x, np.int64) for x in parts[k]]) for k in ("slots", "counts", "largest"))
    size = int(slots.max()) + 1 if len(slots) else 0
    counts, most = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).min)
    np.add.at(counts, slots, n)
    np.maximum.at(most, slots, largest)
    return pd.DataFrame({"shard": [parts["shard"].iloc[0]], "counts": [counts.tobytes()], "largest": [most.tobytes()]})


def _numbered(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """df's texts with a number for each id, in the ids' order: an integer itself, the least one for null."""
    id_, least = col(id_col), F.lit(np.iinfo(np.int64).min)
    if df.schema[id_col].dataType.typeName() in ("long", "integer", "short", "byte"):
        return df.select(F.coalesce(id_.cast("long"), least).alias("id"), col(text_col).alias("text"))
    order = checkpointed(df.select(id_.alias("own")).where("own is not null").distinct().orderBy("own").withColumn("number", F.monotonically_increasing_id()))
    joined = df.select(id_.alias("own"), col(text_col).alias("text")).join(order, "own", "left")
    return joined.select(F.coalesce("number", least).alias("id"), "text", "own")


def shared_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(id, lost array<binary>): the hashes of the keys that each document loses."""
    numbered = _numbered(df, id_col, text_col)
    lines = checkpointed(line_hashes(numbered, "id", "text", min_chars))
    distinct = checkpointed(lines.select("h1", "h2").distinct())
    shards = 1 + max(distinct.count() // SHARD_KEYS, lines.count() // SHARD_PROBES)
    index = checkpointed(build_shards(distinct, shards))
    probes = lines.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int"))
    # A shard meets about SHARD_PROBES; those that a common line makes hot are few.
    loads = probes.groupBy("shard").agg(F.ceil(F.count("*") / SHARD_PROBES).cast("int").alias("copies"))
    hot = checkpointed(loads.where("copies > 2"))
    small = hot.count() <= MOST_BROADCAST
    copies = lambda x: x.join(F.broadcast(hot) if small else hot, "shard", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    dealt = copies(probes).withColumn("copy", F.pmod(F.xxhash64("id"), F.col("copies")).cast("int")).select("shard", "copy", "id", "h1", "h2").groupBy("shard", "copy")
    copied = lambda x: copies(x).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies").groupBy("shard", "copy")
    sums = dealt.cogroup(copied(index)).applyInPandas(_count, "shard int, slots binary, counts binary, largest binary")
    arrays = checkpointed(sums.groupBy("shard").applyInPandas(_add_up, "shard int, counts binary, largest binary"))

    def probe(rows: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        if not len(shard) or not len(rows):
            return pd.DataFrame({"id": pd.array([], "Int64"), "hash": pd.array([], object)})
        member, slots = _probed(rows, shard)
        counts, largest = (np.frombuffer(shard[k].iloc[0], np.int64)[slots] for k in ("counts", "largest"))
        rows = rows[member]
        lost = (counts >= min_docs) & (rows["id"].to_numpy(np.int64) != largest)
        pairs = np.stack([_unsigned(rows["h1"])[lost], _unsigned(rows["h2"])[lost]], axis=1)
        return pd.DataFrame({"id": rows["id"].to_numpy(np.int64)[lost], "hash": [p.tobytes() for p in pairs]})

    lost = dealt.cogroup(copied(index.join(arrays, "shard"))).applyInPandas(probe, "id long, hash binary").groupBy("id").agg(F.collect_set("hash").alias("lost"))
    if "own" in numbered.columns:
        return numbered.select("id", "own").distinct().join(lost, "id").select(F.col("own").alias("id"), "lost")
    return lost.select(F.when(F.col("id") != np.iinfo(np.int64).min, F.col("id")).alias("id"), "lost")


def _dropper(min_chars: int):
    def one(text: str, lost: list[bytes] | None) -> tuple[str, int, int]:
        lines = text.split("\n")
        gone = set(lost or ())
        kept = [x for x in lines if line_hash(x, min_chars) not in gone] if gone else lines
        return "\n".join(kept) if gone else text, len(lines), len(lines) - len(kept)

    return lambda text, lost: list(map(list, zip(*map(one, texts(text), lost.to_pylist()), strict=True))) or [[], [], []]


def drop_shared_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_col: str = "kept", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """df with its texts without the lines that many documents share, n_lines and n_dropped."""
    lost = shared_lines(df, id_col, text_col, min_chars, min_docs).select(F.col("id").alias("__id"), F.col("lost").alias("__lost"))
    joined = df.join(lost, col(id_col).eqNullSafe(F.col("__id")), "left").drop("__id")
    fields = [T.StructField(out_col, T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    return append_columns(joined, [text_col, "__lost"], fields, _dropper, min_chars).select(*(col(c) for c in others(df, out_col, "n_lines", "n_dropped")), out_col, "n_lines", "n_dropped")
