"""Operator 8 for a likeness of shingle sets: SimHash tiles, compared exactly, then verified.

A text is the set of its five-word shingles, as XXH64; equal sets are folded first. A set's
fingerprint has `64 * WORDS` bits, the majorities of as many bits that are mixed from each
hash. Sets of likeness 0.8 have an expected angle of 0.48, so 39 of 256 bits differ, with a
deviation of 5.7: the radius of 54 reaches all but a few in a thousand of the links that are
exactly at 0.8, and nearly all above it.

Sets of likeness 0.8 differ in size by a quarter at most, so tiles are cut from bands of
sizes, and pairs of tiles whose bands aren't neighbours are skipped. The others are compared
with numpy: blocks whose population counts differ beyond the radius are skipped, the rest go
through exclusive-or and bit counts, two words first. Tiles grow with the root of the number
of sets, so that a set is sent to few units where there are many.

A unit returns four spanning forests of the links, each the nearest one of what those before
have left: all links of a group of up to eight, and a few for each member of a larger one, never
its pairs. The first, and then what of the others is between its trees, are verified on the shingle
sets themselves, so texts of one group are connected by true likenesses of 0.8 only.

What forests and radius leave out is found exactly between the groups that result: under any
common order of shingles, two sets of likeness 0.8 share one of the first n - ceil(0.8 n) + 1 of
each. The order is that of the hashes, with shingles last that are frequent in some documents; it
is of no matter for the result. First shingles go out as packed numbers of eight bytes with their
text, and only those that several texts have come back as rows. Shingles that the same least and
largest group have are taken together: their texts are compared by bitmaps with numpy, pairs of one
group excepted, and only pairs that may have the likeness become rows and are verified. So a family
of texts that are alike, but not enough, makes no rows for its pairs, however many shingles they share.

Null text counts as empty; texts without words are copies of one another. A text of fewer than
five words is one shingle. Rows are told apart by a key of their own, so null and repeated ids
are rows like others.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellmend.llm.common import append_columns, bounded_batches, checkpointed, keep_first, stored, texts
from cellmend.llm.components import components
from cellmend.llm.simhash import shingle_hashes, unite

WIDTH, LIKENESS = 5, 0.8
#: Numbers of 64 bits in a fingerprint, and the bits in which linked ones differ at most.
WORDS, RADIUS = 4, 54
#: Forests of links that a unit returns.
FORESTS = 4
#: Members of a tile at least; more where there are many sets.
TILE = 4096
#: Pairs in a block of the comparison.
BLOCK = 1 << 18
#: Texts, about, that tell which shingles are frequent, and in how many of them these are.
LOOKED_AT, FREQUENT = 10_000, 4
#: First shingles that a task holds before it packs them, and those of a shard, about.
PACKED, SHARD = 1 << 20, 1 << 21
#: Members, about, that one call compares, and bytes of the bitmaps that it looks at at once.
MEMBERS, LOOK = 1 << 12, 1 << 23


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th number of 64 bits that follows from each hash; the hash itself at 0."""
    if not k:
        return h
    x = h + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def wide_fingerprint(hashes: np.ndarray) -> list[int]:
    """The majorities of the bits, as WORDS signed numbers; zeros of no hashes."""
    counts = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(hashes), 1 << 13):
        part = np.stack([_mixed(hashes[at : at + (1 << 13)], k) for k in range(WORDS)], axis=1)
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64).tolist()


def _sets():
    return lambda text: [[np.unique(shingle_hashes(x, WIDTH)).view(np.int64).tolist() for x in texts(text)]]


def add_shingles(df: DataFrame, text_col: str = "text", out: str = "shingles") -> DataFrame:
    """df with the distinct shingle hashes of its texts."""
    return append_columns(df, [text_col], [T.StructField(out, T.ArrayType(T.LongType()))], _sets)


def first_shingles(hashes: np.ndarray, frequent: np.ndarray, likeness: float) -> np.ndarray:
    """Those of a set of rising hashes one of which any set of the likeness has among its own."""
    late = np.zeros(len(hashes), bool)
    if len(frequent):
        late = frequent[np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)] == hashes
    return np.concatenate([hashes[~late], hashes[late]])[: first_number(len(hashes), likeness)]


def first_number(n: int, likeness: float) -> int:
    return n - math.ceil(likeness * n - 1e-9) + 1 if n else 0


def pack(hashes: np.ndarray, rows: np.ndarray, shards: int) -> list[tuple[int, int, bytes, bytes]]:
    """(shard, upper half of the rows, 32 bits of each hash, lower half of each row): the shard and
    the bits are the hash's last digits, of which shards is a power of two."""
    shard, upper = (hashes & np.uint64(shards - 1)).astype(np.int64), rows >> 32
    order = np.lexsort((shard, upper))
    shard, upper = shard[order], upper[order]
    bits = (hashes[order] >> np.uint64(shards.bit_length() - 1)).astype(np.uint32)
    lower = rows[order].view(np.uint64).astype(np.uint32)
    cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(upper) != 0)) + 1
    ends = zip([0, *cuts.tolist()], [*cuts.tolist(), len(order)], strict=True)
    return [(int(shard[i]), int(upper[i]), bits[i:k].tobytes(), lower[i:k].tobytes()) for i, k in ends if i < k]


def unpack_shared(shard: int, upper: np.ndarray, bits: list[bytes], lower: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(h, row) of a shard's hashes that several rows have."""
    h, rows = np.frombuffer(b"".join(bits), np.uint32), np.frombuffer(b"".join(lower), np.uint32).astype(np.int64)
    rows |= np.repeat(upper.astype(np.int64) << 32, [len(x) // 4 for x in lower])
    order = np.argsort(h, kind="stable")
    h, rows = h[order], rows[order]
    same = np.concatenate([[False], h[1:] == h[:-1], [False]])
    several = same[1:] | same[:-1]
    return h[several].astype(np.int64) | np.int64(shard << 32), rows[several]


def _shared_firsts(rows: DataFrame, total: int, likeness: float) -> DataFrame:
    """(h, row): what several rows (row, text) have among their first shingles, of about `total`
    ones. Some of the hashes may be of two shingles."""
    frequent = _frequent(rows)
    shards = 1 << max(6, (total // SHARD).bit_length())
    fields = pa.schema([("shard", pa.int64()), ("upper", pa.int64()), ("bits", pa.binary()), ("lower", pa.binary())])

    def run(batches):
        held, count = [], 0

        def packed():
            found = pack(np.concatenate([h for h, _ in held]), np.repeat(np.array([r for _, r in held], np.int64), [len(h) for h, _ in held]), shards)
            for at in range(0, len(found), 64):
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found[at : at + 64], strict=True), fields, strict=True)], schema=fields)

        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                held.append((first_shingles(np.unique(shingle_hashes(text, WIDTH)), frequent, likeness), row))
                if (count := count + len(held[-1][0])) >= PACKED:
                    yield from packed()
                    held, count = [], 0
        if count:
            yield from packed()

    def shared(part: pd.DataFrame) -> pd.DataFrame:
        h, of = unpack_shared(int(part["shard"].iloc[0]), part["upper"].to_numpy(), part["bits"].tolist(), part["lower"].tolist())
        return pd.DataFrame({"h": h, "row": of})

    bounded_batches(rows.sparkSession)
    firsts = rows.select("row", "text").mapInArrow(run, "shard long, upper long, bits binary, lower binary")
    return firsts.groupBy("shard").applyInPandas(shared, "h long, row long")


def bitmap(hashes: np.ndarray) -> bytes:
    """A set's bits, numbered by the hashes' last digits; twice as many as hashes, or more."""
    size = 1 << max(6, (2 * len(hashes)).bit_length())
    bits = np.zeros(size, bool)
    bits[(hashes & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def most_shared(a: bytes, b: bytes, n: int, m: int) -> int:
    """What sets of n and m shingles share at most: a bit of one that the other lacks stands for
    one that isn't shared at least."""
    return int(most_shared_of(*(np.frombuffer(x, np.uint64)[None] for x in (a, b)), np.array([n]), np.array([m]))[0])


def most_shared_of(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """most_shared of each row of bitmaps."""
    while x.shape[1] > y.shape[1]:
        x = x[:, : x.shape[1] // 2] | x[:, x.shape[1] // 2 :]
    while y.shape[1] > x.shape[1]:
        y = y[:, : y.shape[1] // 2] | y[:, y.shape[1] // 2 :]
    lacks = lambda p, q: np.bitwise_count(p & ~q).sum(axis=1, dtype=np.int64)
    return np.minimum(n - lacks(x, y), m - lacks(y, x))


def cross_pairs(key: np.ndarray, root: np.ndarray, most: int = 1 << 20):
    """Blocks of places (i, j): all pairs of one key and different roots, once each; rows are in the
    order of (key, root). A block has `most` pairs or those of one place."""
    new_key = np.concatenate([[True], key[1:] != key[:-1]])
    new_run = new_key | np.concatenate([[True], root[1:] != root[:-1]])
    ends = lambda new: np.append(np.flatnonzero(new)[1:], len(key))[np.cumsum(new) - 1]
    start = ends(new_run)
    number = ends(new_key) - start
    upto, at = np.cumsum(number), 0
    while at < len(key):
        before = upto[at] - number[at]
        to = max(at + 1, int(np.searchsorted(upto, before + most, "right")))
        i = np.repeat(np.arange(at, to), number[at:to])
        yield i, np.arange(len(i)) - np.repeat(upto[at:to] - number[at:to] - before, number[at:to]) + start[i]
        at = to


def may_be_alike(n: np.ndarray, bits: list[bytes], i: np.ndarray, j: np.ndarray, likeness: float) -> np.ndarray:
    """Which pairs of places may have the likeness, as sizes and bitmaps tell."""
    open_ = np.flatnonzero(np.minimum(n[i], n[j]) >= likeness * np.maximum(n[i], n[j]) - 1e-9)
    size = np.fromiter(map(len, bits), np.int64, len(bits))
    kinds, told = size[i[open_]] << 32 | size[j[open_]], []
    for kind in np.unique(kinds):
        of = open_[kinds == kind]
        step = max(1, LOOK // int(max(kind >> 32, kind & 0xFFFFFFFF)))
        for at in range(0, len(of), step):
            part = of[at : at + step]
            x, y = (np.frombuffer(b"".join(map(bits.__getitem__, p[part].tolist())), np.uint64).reshape(len(part), -1) for p in (i, j))
            a, b = n[i[part]], n[j[part]]
            told.append(part[(1 + likeness) * most_shared_of(x, y, a, b) >= likeness * (a + b) - 1e-9])
    return np.concatenate([*told, np.empty(0, np.int64)])


def _marks():
    def work(text):
        sets = [np.unique(shingle_hashes(x, WIDTH)) for x in texts(text)]
        return [[len(s) for s in sets], [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], [wide_fingerprint(s) for s in sets], [bitmap(s) for s in sets]]

    return work


def _frequent(rows: DataFrame) -> np.ndarray:
    """Rising hashes of shingles that some texts of the rows share; which they are is of no
    matter for what is found."""
    part = max(1, rows.count() // LOOKED_AT)
    some = add_shingles(rows.where(F.pmod(F.xxhash64("row"), F.lit(part)) == 0).select("text")).select(F.explode("shingles").alias("h"))
    found = some.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT).select("h").collect()  # a part of the looked-at texts' words
    return np.sort(np.array([r["h"] for r in found], np.int64).view(np.uint64))


def nearest_forest(n: int, u: np.ndarray, v: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Places of the links (u, v) of least total distance that connect nodes 0 to n-1 as all do."""
    weight = apart.astype(np.int64) * (len(u) + 1) + np.arange(len(u))  # no two alike
    label, kept, open_ = np.arange(n), [], np.arange(len(u))
    while len(open_):
        a, b = label[u[open_]], label[v[open_]]
        across = a != b
        open_, a, b = open_[across], a[across], b[across]
        least = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(least, a, weight[open_])
        np.minimum.at(least, b, weight[open_])
        chosen = open_[(weight[open_] == least[a]) | (weight[open_] == least[b])]
        kept.append(chosen)
        label = unite(label, u[chosen], v[chosen])
    return np.concatenate([*kept, np.empty(0, np.int64)])


def nearest_forests(n: int, u: np.ndarray, v: np.ndarray, apart: np.ndarray) -> list[np.ndarray]:
    """Places of the links of FORESTS forests, each the nearest one of what those before have left."""
    left, kept = np.arange(len(u)), []
    for _ in range(FORESTS):
        found = nearest_forest(n, u[left], v[left], apart[left])
        kept.append(left[found])
        left = np.delete(left, found)
    return kept


class Nearest:
    """The nearest forests of links that come in blocks."""

    def __init__(self, n: int):
        self.n, self.links = n, np.empty((3, 0), np.int64)
        #: The trees of the last forest, and the longest link of each: a longer one between two
        #: nodes of a tree is in no forest, as all of them connect these by nearer links.
        self.tree, self.longest = np.arange(n), np.zeros(n, np.int64)

    def news(self, u: np.ndarray, v: np.ndarray, apart: np.ndarray) -> np.ndarray:
        tree = self.tree[u]
        return (tree != self.tree[v]) | (apart < self.longest[tree])

    def add(self, u: np.ndarray, v: np.ndarray, apart: np.ndarray) -> None:
        new = self.news(u, v, apart)
        self.links = np.concatenate([self.links, np.stack([u[new], v[new], apart[new]])], axis=1)
        if self.links.shape[1] > max(BLOCK, 2 * FORESTS * self.n):
            forests = nearest_forests(self.n, *self.links)
            last = self.links[:, forests[-1]]
            self.links = self.links[:, np.concatenate(forests)]
            self.tree, self.longest = unite(np.arange(self.n), last[0], last[1]), np.zeros(self.n, np.int64)
            np.maximum.at(self.longest, self.tree[last[0]], last[2])

    def found(self) -> np.ndarray:
        """(node, node, number of the forest) rows."""
        parts = [np.stack([*self.links[:2, at], np.full(len(at), k)], axis=1) for k, at in enumerate(nearest_forests(self.n, *self.links))]
        return np.concatenate(parts)


def near_links(fps: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int = RADIUS, likeness: float = LIKENESS) -> np.ndarray:
    """(place, place, number of the forest) of the nearest links between members `left` and
    `right`, places in fps."""
    bits, nearest = fps.view(np.uint64), Nearest(len(fps))
    ones = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    left, right = (x[np.argsort(ones[x], kind="stable")] for x in (left, right))
    of_right = ones[right]
    columns = [np.ascontiguousarray(bits[right, k]) for k in range(bits.shape[1])]
    step = max(1, BLOCK // max(1, len(right)))
    for a in range(0, len(left), step):
        part = left[a : a + step]
        lo, hi = np.searchsorted(of_right, ones[part[0]] - radius), np.searchsorted(of_right, ones[part[-1]] + radius, "right")
        block = lambda words: sum(np.bitwise_count(bits[part, k][:, None] ^ columns[k][None, lo:hi]).astype(np.uint16) for k in words)
        apart = block(range(min(2, len(columns))))
        open_ = apart <= radius
        if (dense := 16 * np.count_nonzero(open_) > open_.size):
            apart += block(range(2, len(columns)))
            open_ = (apart <= radius) & nearest.news(part[:, None], right[None, lo:hi], apart)
        i, j = np.nonzero(open_)
        if not len(i):
            continue
        x, y = part[i], right[lo:hi][j]
        apart = apart[i, j].astype(np.int64) if dense else np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
        near = (x != y) & (apart <= radius) & (np.minimum(sizes[x], sizes[y]) >= likeness * np.maximum(sizes[x], sizes[y]) - 1e-9)
        nearest.add(x[near], y[near], apart[near])
    return nearest.found()


def tile_size(n: int) -> int:
    return max(TILE, 1 << math.ceil(math.log2(16 * math.sqrt(n + 1))))


def _candidates(nodes: DataFrame, radius: int, likeness: float) -> DataFrame:
    """(u, v, forest): nearest links between the nodes (node, n, fp), as fingerprints tell."""
    bounded_batches(nodes.sparkSession)
    banded = nodes.where("n > 0").withColumn("band", F.floor(F.log(F.col("n")) / math.log(1 / likeness) + 1e-9).cast("int"))
    held = {r["band"]: r["count"] for r in banded.groupBy("band").count().collect()}  # bands are as many as the logarithm of the longest text
    tile = tile_size(sum(held.values()))
    chunks = {b: -(-n // tile) for b, n in held.items()}
    of = F.create_map(*(F.lit(x) for b, n in chunks.items() for x in (b, n))) if chunks else F.create_map(F.lit(-1), F.lit(0))
    band, own = F.col("band"), F.col("chunk")
    number = lambda b: F.coalesce(F.try_element_at(of, b), F.lit(0))
    unit = lambda lb, li, rb, ri: F.struct(lb.alias("lb"), li.alias("li"), rb.alias("rb"), ri.alias("ri"))
    upto = lambda n, make: F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), make)).otherwise(F.array().cast("array<struct<lb:int,li:int,rb:int,ri:int>>"))
    units = F.concat(
        upto(number(band), lambda k: unit(band, F.least(own, k), band, F.greatest(own, k))),
        upto(number(band + 1), lambda k: unit(band, own, band + 1, k)),
        upto(number(band - 1), lambda k: unit(band - 1, k, band, own)),
    )
    dealt = banded.withColumn("chunk", F.pmod(F.xxhash64("node"), number(band)).cast("int"))
    dealt = dealt.select("node", "n", *(F.col("fp")[k].alias(f"w{k}") for k in range(WORDS)), "band", "chunk", F.explode(units).alias("unit"))
    dealt = dealt.select("unit.*", "node", "n", *(f"w{k}" for k in range(WORDS)), ((band == F.col("unit.lb")) & (own == F.col("unit.li"))).alias("left"), ((band == F.col("unit.rb")) & (own == F.col("unit.ri"))).alias("right"))

    def compare(members: pd.DataFrame) -> pd.DataFrame:
        fps = np.ascontiguousarray(members[[f"w{k}" for k in range(WORDS)]].to_numpy(np.int64))
        sides = [np.flatnonzero(members[s].to_numpy(bool)) for s in ("left", "right")]
        found, node = near_links(fps, members["n"].to_numpy(np.int64), *sides, radius, likeness), members["node"].to_numpy(np.int64)
        return pd.DataFrame({"u": node[found[:, 0]], "v": node[found[:, 1]], "forest": found[:, 2]})

    return dealt.groupBy("lb", "li", "rb", "ri").applyInPandas(compare, "u long, v long, forest long")


def _verified(pairs: DataFrame, rows: DataFrame, likeness: float) -> DataFrame:
    """The pairs whose shingle sets have the likeness."""
    # Only texts of linked rows are read on; a merge join, as their number grows with the rows.
    needed = stored(pairs.select(F.col("u").alias("row")).union(pairs.select("v")).distinct())
    sets = stored(add_shingles(rows.join(needed.hint("merge"), "row", "left_semi")).select("row", "shingles"))
    side = lambda end: sets.select(F.col("row").alias(end), F.col("shingles").alias(f"of_{end}"))
    shared = F.size(F.array_intersect("of_u", "of_v"))
    both = pairs.join(side("u"), "u").join(side("v"), "v").withColumn("shared", shared)
    return both.where((1 + likeness) * F.col("shared") >= likeness * (F.size("of_u") + F.size("of_v")) - 1e-9).select("u", "v")


def _between(hits: DataFrame, sets: DataFrame, likeness: float) -> DataFrame:
    """(u, v), u < v: all pairs of nodes of different roots that may have the likeness, as shared
    first shingles (h, node, root) and bitmaps (node, n, bits) tell."""
    of = Window.partitionBy("h")
    spread = hits.withColumn("a", F.min("root").over(of)).withColumn("b", F.max("root").over(of)).where("a <> b")
    # A family's shingles have few such ends, where its members meet once, not at each shingle.
    members = stored(spread.select("a", "b", "node", "root").distinct())
    held = members.groupBy("a", "b").agg(F.ceil(F.count("*") / TILE).cast("int").alias("cuts")).where("cuts > 1")
    parts = members.count() // MEMBERS + 1
    dealt = members.join(held, ["a", "b"], "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    dealt = dealt.withColumn("cut", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    unit = F.xxhash64("a", "b", F.least("cut", "k"), F.greatest("cut", "k"))  # units that clash only meet in vain
    dealt = dealt.select("node", "root", "cut", (F.col("cut") == F.col("k")).alias("own"), unit.alias("unit")).join(sets, "node")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        # A cut's own unit holds all its pairs, other units those of two cuts.
        group = group.sort_values(["unit", "root"], ignore_index=True)
        unit, root, node, n, cut, own = (group[c].to_numpy() for c in ("unit", "root", "node", "n", "cut", "own"))
        bits, found = group["bits"].tolist(), []
        for i, j in cross_pairs(unit, root):
            asked = (cut[i] != cut[j]) | own[i]
            i, j = i[asked], j[asked]
            near = may_be_alike(n, bits, i, j, likeness)
            found.append(np.stack([node[i[near]], node[j[near]]]))
        u, v = np.concatenate([*found, np.empty((2, 0), np.int64)], axis=1)
        return pd.DataFrame({"u": np.minimum(u, v), "v": np.maximum(u, v)})

    bounded_batches(hits.sparkSession)
    return dealt.withColumn("part", F.pmod("unit", F.lit(parts))).groupBy("part").applyInPandas(compare, "u long, v long").distinct()


def groups(rows: DataFrame, radius: int = RADIUS, likeness: float = LIKENESS) -> DataFrame:
    """(row, group) of rows (row, text), a stored table of distinct long keys; rows are of one group
    where links connect them."""
    fields = [T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("fp", T.ArrayType(T.LongType())), T.StructField("bits", T.BinaryType())]
    marks = stored(append_columns(rows.select("row", "text"), ["text"], fields, _marks).drop("text"))
    nodes = stored(marks.groupBy("digest").agg(F.min("row").alias("node"), F.min("n").alias("n"), F.min("fp").alias("fp")))
    pairs = stored(_candidates(nodes, radius, likeness).groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min("forest").alias("forest")))
    # The first forests connect nearly all; of the others only what is between their trees is left.
    first = stored(_verified(pairs.where("forest = 0"), rows, likeness))
    roots = stored(components(first))
    of = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"of_{end}"))
    across = stored(pairs.where("forest > 0").join(of("u"), "u", "left").join(of("v"), "v", "left").where("coalesce(of_u, u) <> coalesce(of_v, v)").select("u", "v"))
    linked = stored(components(first.union(_verified(across, rows, likeness))))
    # The exact way for links that are in no forest or beyond the radius.
    rooted = nodes.select("node").join(linked, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    total = int((1 - likeness) * (marks.agg(F.sum("n")).first()[0] or 0)) + 1
    hits = _shared_firsts(rows, total, likeness).withColumnRenamed("row", "node").join(rooted, "node")
    between = _between(hits, marks.select(F.col("row").alias("node"), "n", "bits"), likeness)
    done = pairs.where("forest = 0").select("u", "v").union(across)
    more = stored(_verified(stored(between.join(done, ["u", "v"], "left_anti")), rows, likeness))
    if not more.isEmpty():
        linked = components(linked.select(F.col("node").alias("u"), F.col("root").alias("v")).union(more))
    return marks.select("digest", "row").join(nodes.select("digest", "node"), "digest").join(linked, "node", "left").select("row", F.coalesce("root", "node").alias("group"))


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies: that of the smallest id, a null one only where the
    group has no other."""
    return keep_first(df, id_col, text_col, groups)
