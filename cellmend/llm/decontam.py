"""Operator 7: benchmark items that documents contain, by size-partitioned MinHash.

An item is the set of its shingles, five words each. It is contained in a document that has
at least 0.8 of them. Items are partitioned by size (and by shingle width): those of
2^(c-1) to 2^c - 1 shingles make class c, whose items need max(1, c - 2) hits. An item of n
shingles may miss m = n - ceil(0.8 n), so its MinHash signature is its m + hits smallest
shingle hashes: whichever m are missing, the document holds as many of them as its class
needs. A document with fewer can't contain the item, however long it is, so the search is
exact for the shortest item in the longest document, where bands over whole documents'
signatures would miss it. Candidates are verified by exact shingle containment, on the words.

Documents' shingles are hashed with numpy and looked up in a bit table of all signatures,
and what is left in the classes' sorted signatures. These are built once, on the driver, in
blocks of bounded size. Documents are read once and never shuffled: a task keeps the batches
that hits fall into until they reach a bounded size, and then takes one block after another.
So a worker holds the bit table, a block and a bounded number of documents, however many
items there are. Items beyond `PASS_BYTES` of text are searched in a further pass.

Words are maximal runs of digits, letters A-Z and characters beyond ASCII, in lower case; an
item of fewer than five words is one shingle of its own width. Items and documents without
words match nothing. Null ids are carried as they are; repeated rows give repeated results.
Leaks are dropped where they are found, row by row, so ids play no part in it.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cellmend.llm.common import bounded_batches, col, texts
from cellmend.llm.licenses import _WORD, words

WIDTH, CONTAINED = 5, 0.8
#: Bytes of items' text in a block, the most that a task holds of the benchmark at once.
BLOCK_BYTES = 16 << 20
#: Bytes of items' text that are sent to the executors for one pass over the documents.
PASS_BYTES = 1 << 30
#: Bytes of documents that wait in a task for the blocks, where there are several.
WAITING_BYTES = 32 << 20
#: Bits of the table of signatures: so many for each hash, within these bounds as powers of two.
TABLE_SPARSE, TABLE_BITS = 64, (16, 24)
_RADIX = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The radix's powers, and their inverses modulo 2^64."""
    inverse = pow(_RADIX, -1, 1 << 64)
    out = []
    for r in (_RADIX, inverse):
        x = np.full(n, r, np.uint64)
        x[:1] = 1
        out.append(np.cumprod(x, dtype=np.uint64))
    return out[0], out[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class WordHashes:
    """Hashes of the words of many texts at once."""

    def __init__(self):
        self.powers = _powers(1 << 16)

    def __call__(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The start and the hash of each word in bytes that `_WORD` has translated."""
        if len(data) > len(self.powers[0]):
            self.powers = _powers(1 << (len(data) - 1).bit_length())
        solid = data != 32
        edge = np.flatnonzero(np.diff(solid, prepend=False, append=False))
        starts, ends = edge[::2], edge[1::2]
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[0][: len(data)], dtype=np.uint64, out=sums[1:])
        return starts, _mix((sums[ends] - sums[starts]) * self.powers[1][starts])


def shingle_hashes(word_hashes: np.ndarray, width: int) -> np.ndarray:
    """Of each run of `width` words, across the texts' bounds too."""
    n = len(word_hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + word_hashes[k : k + n]
    return _mix(out)


def hits_needed(n: int) -> int:
    """Of the signature of an item of n shingles, by the class of its size."""
    return max(1, n.bit_length() - 2)


class Block:
    """Items as a task looks them up: their words, and the signatures of each class of sizes."""

    def __init__(self, rows: list[tuple], width: int, contained: float):
        hashes, signatures = WordHashes(), defaultdict(list)
        self.keys: list = []
        self.words: list[bytes] = []
        self.contained = contained
        for key, text in rows:
            found = words((text or "").lower())
            if not found:
                continue
            w, joined = min(width, len(found)), b" ".join(found)
            own = np.unique(shingle_hashes(hashes(np.frombuffer(joined, np.uint8))[1], w))
            n, hits = len(own), hits_needed(len(own))
            signatures[w, hits].append((own[: n - needed(n, contained) + hits], len(self.keys)))
            self.keys.append(key)
            self.words.append(joined)
        #: (width, hits): the ascending hashes, and the item of each.
        self.classes = {}
        for kind, parts in signatures.items():
            keys, item = np.concatenate([h for h, _ in parts]), np.repeat([i for _, i in parts], [len(h) for h, _ in parts]).astype(np.int32)
            order = np.argsort(keys, kind="stable")
            self.classes[kind] = (keys[order], item[order])
        self.width = width

    def candidates(self, width: int, doc: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """(document, item) rows, from distinct rows of documents and shingle hashes."""
        out = [np.empty((0, 2), np.int64)]
        for (w, hits), (keys, item) in self.classes.items():
            if w != width:
                continue
            lo, hi = np.searchsorted(keys, hashes), np.searchsorted(keys, hashes, "right")
            n = hi - lo
            places = np.repeat(hi - np.cumsum(n), n) + np.arange(n.sum())
            found, times = np.unique(np.repeat(doc, n) * len(self.keys) + item[places], return_counts=True)
            found = found[times >= hits]
            out.append(np.stack(np.divmod(found, max(1, len(self.keys))), axis=1))
        return np.concatenate(out)

    def shingles(self, i: int) -> tuple[int, set]:
        found = self.words[i].split()
        w = min(self.width, len(found))
        return w, {tuple(found[k : k + w]) for k in range(len(found) - w + 1)}

    def verified(self, documents: list[bytes], candidates: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, shingles in common, shingles of the item) of contained items."""
        items: dict[int, tuple[int, set]] = {}
        for d in np.unique(candidates[:, 0]).tolist():
            found, own = documents[d].split(), {}
            for i in candidates[candidates[:, 0] == d, 1].tolist():
                if i not in items:
                    if len(items) >= 1000:
                        items.clear()
                    items[i] = self.shingles(i)
                w, shingles = items[i]
                if w not in own:
                    own[w] = set(zip(*(found[k:] for k in range(w)), strict=False))
                if (shared := len(shingles & own[w])) >= needed(len(shingles), self.contained):
                    yield d, i, shared, len(shingles)


def needed(n: int, contained: float) -> int:
    return math.ceil(round(contained * n, 9))


class Table:
    """One bit for some leading bits of each signature hash, for each width."""

    def __init__(self, signatures: Iterable[tuple[int, np.ndarray]]):
        by_width = defaultdict(list)
        for w, keys in signatures:
            by_width[w].append(keys)
        self.bits = {}
        for w, parts in by_width.items():
            size = min(max((TABLE_SPARSE * sum(map(len, parts))).bit_length(), TABLE_BITS[0]), TABLE_BITS[1])
            bits = np.zeros(1 << size, bool)
            for keys in parts:
                bits[(keys >> np.uint64(64 - size)).astype(np.int64)] = True
            self.bits[w] = (size, bits)

    def hits(self, hashes: WordHashes, documents: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By width: the documents' numbers and those of their shingle hashes that may be in a signature."""
        starts, hashed = hashes(np.frombuffer(b" ".join(documents), np.uint8))
        bounds, out = np.cumsum([0, *(len(x) + 1 for x in documents)]), {}
        for w, (size, bits) in self.bits.items():
            found = shingle_hashes(hashed, w)
            at = np.flatnonzero(bits[(found >> np.uint64(64 - size)).astype(np.int64)])
            doc = np.searchsorted(bounds, starts[at], "right") - 1
            pairs = np.unique(np.stack([doc.astype(np.uint64), found[at]], axis=1), axis=0)
            out[w] = (pairs[:, 0].astype(np.int64), pairs[:, 1])
        return out


class Search:
    """Finds the items of blocks, which are broadcast one by one, in batches of documents."""

    def __init__(self, table: Table, sent: list):
        self.table, self.sent, self.hashes = table, sent, WordHashes()
        self.waiting: list[tuple] = []
        self.bytes = 0

    def __call__(self, batches: Iterable[pa.RecordBatch], text_at: int) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
        """Each batch with (row, item's key, shingles in common, shingles of the item) of its leaks."""
        for batch in batches:
            raw = [x.lower().encode().translate(_WORD) for x in texts(batch.column(text_at))]
            hits = self.table.hits(self.hashes, raw)
            touched = np.unique(np.concatenate([np.empty(0, np.int64), *(d for d, _ in hits.values())]))
            self.waiting.append((batch, {int(d): raw[d] for d in touched}, hits))
            self.bytes += batch.nbytes + sum(len(raw[d]) for d in touched)
            if len(self.sent) == 1 or self.bytes > WAITING_BYTES:
                yield from self.flush()
        yield from self.flush()

    def flush(self) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
        found: list[list[tuple]] = [[] for _ in self.waiting]
        for sent in self.sent:
            block: Block = sent.value
            for rows, (_, documents, hits) in zip(found, self.waiting, strict=True):
                for w, (doc, hashes) in hits.items():
                    rows += ((d, block.keys[i], shared, n) for d, i, shared, n in block.verified(documents, block.candidates(w, doc, hashes)))
            if len(self.sent) > 1:
                vars(sent).pop("_value", None)  # read again from the worker's disk for the next batches
        yield from zip((batch for batch, *_ in self.waiting), map(sorted_rows, found), strict=True)
        self.waiting, self.bytes = [], 0


def sorted_rows(rows: list[tuple]) -> list[tuple]:
    return sorted(rows, key=lambda r: (r[0], str(r[1])))


def blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """The items, in lists of at most BLOCK_BYTES (or one item)."""
    block, size = [], 0
    for row in items.select(col(id_col), col(text_col)).toLocalIterator():
        n = len((row[1] or "").encode())
        if block and size + n > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append(tuple(row))
        size += n
    yield block


def searches(items: DataFrame, id_col: str, text_col: str, width: int, contained: float) -> Iterator:
    """For each pass over the documents: a function that makes a task's Search."""
    context = items.sparkSession.sparkContext
    sent, signatures, size = [], [], 0

    def ready():
        merged, parts = context.broadcast(Table(signatures)), list(sent)
        return lambda: Search(merged.value, parts)

    for rows in blocks(items, id_col, text_col):
        block = Block(rows, width, contained)
        sent.append(context.broadcast(block))
        signatures += [(w, keys) for (w, _), (keys, _) in block.classes.items()]
        size += BLOCK_BYTES
        if size >= PASS_BYTES:
            yield ready()
            sent, signatures, size = [], [], 0
    if sent:
        yield ready()


def contained_items(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, contained: float = CONTAINED) -> DataFrame:
    """(id, item id, n_shared, n_shingles, containment) of each document and item that it contains."""
    import pyspark.sql.pandas.types as spark_types

    bounded_batches(df.sparkSession)
    source = df.select(col(id_col).alias("id"), col(text_col).alias("text"))
    kind, item_kind = source.schema["id"].dataType, items.select(col(item_id_col)).schema[0].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField(item_id_col, item_kind), T.StructField("n_shared", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("containment", T.DoubleType())])
    arrow, out = spark_types.to_arrow_schema(schema), None
    for search in searches(items, item_id_col, item_text_col, width, contained):

        def run(batches, search=search):
            for batch, rows in search()(batches, 1):
                shared, total = [x[2] for x in rows], [x[3] for x in rows]
                yield pa.RecordBatch.from_pydict({id_col: batch.column(0).take(pa.array([x[0] for x in rows], pa.int64())), item_id_col: [x[1] for x in rows], "n_shared": pa.array(shared, pa.int64()), "n_shingles": pa.array(total, pa.int64()), "containment": pa.array([a / b for a, b in zip(shared, total, strict=True)], pa.float64())}, schema=arrow)

        part = source.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return out


def decontaminate(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, contained: float = CONTAINED) -> DataFrame:
    """df without the rows whose text contains an item, whatever their ids."""
    bounded_batches(df.sparkSession)
    out, names = df.toDF(*(f"c{i}" for i in range(len(df.columns)))), df.columns
    at, schema = names.index(text_col), out.schema
    for search in searches(items, item_id_col, item_text_col, width, contained):

        def run(batches, search=search):
            for batch, rows in search()(batches, at):
                leaks = {d for d, *_ in rows}
                yield batch.filter(pa.array([d not in leaks for d in range(batch.num_rows)], pa.bool_()))

        out = out.mapInArrow(run, schema)
    return out.toDF(*names)
