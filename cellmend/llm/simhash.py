"""Operator 8: SimHash near-duplicates by tiled exact comparison.

A document's fingerprint has a bit set where over half of its shingles' XXH64 have it. Equal
fingerprints are folded first, so copies cost nothing further. Distinct fingerprints are
dealt into tiles by the population counts of their lanes (equal parts of the 64 bits). The
sum of the lanes' differences is at most the number of differing bits, so pairs of tiles
whose population counts differ by more than the radius are skipped, and no pair is lost.
The other pairs of tiles are compared with numpy: exclusive-or, then bit counts. Tiles over
`TILE` members are cut, and a unit of work holds one cut of each side, so that no task
holds an unbounded group. A unit returns a spanning forest of its links, not the links.

Null text counts as empty. A text without words has fingerprint zero and is linked like any
other. One with fewer words than a shingle is one shingle. Rows of null doc_id get a
component as others do, but are never its smallest id. Repeated rows share a component.
Extra columns are kept; those named like the new ones are replaced.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellmend.llm.common import append_columns, bounded_batches, checkpointed, col, keep_first, texts
from cellmend.llm.components import components

SEED = 42
#: Fingerprints in a cut of a tile.
TILE = 8192
#: Parts into which each cut is dealt where it is compared with other tiles' members, so that
#: units around full tiles aren't much larger than others.
SPREAD = 4
#: Full tiles, of a few numbers each, whose cuts are broadcast at most; more are joined.
MOST_BROADCAST = 2_000
#: Numbers in a block of the comparison.
BLOCK = 1 << 20


def word_spans(text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words, blank-joined, in lower case (A-Z), and each one's start and end."""
    words = text.encode().lower().split()
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    return b" ".join(words), ends - sizes, ends


def shingle_hashes(text: str, width: int) -> np.ndarray:
    joined, starts, ends = word_spans(text)
    n = len(starts)
    if n <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)] if n else [], np.uint64)
    cuts = map(slice, starts[: n - width + 1].tolist(), ends[width - 1 :].tolist())
    return np.fromiter(map(functools.partial(xxhash.xxh64_intdigest, seed=SEED), map(joined.__getitem__, cuts)), np.uint64, n - width + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """The majority of each bit; zero of no hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = np.ascontiguousarray(hashes[at : at + (1 << 15)]).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * counts > len(hashes)).tolist())


def _fingerprints(width: int):
    return lambda text: [np.array([fingerprint(shingle_hashes(x, width)) for x in texts(text)], np.uint64).view(np.int64).tolist()]


def add_fingerprints(df: DataFrame, text_col: str = "text", out: str = "fingerprint", width: int = 3) -> DataFrame:
    """df with the SimHash of its texts, as the signed long of the same 64 bits."""
    return append_columns(df, [text_col], [T.StructField(out, T.LongType())], _fingerprints, width)


def lanes_for(n: int) -> int:
    """So many lanes that a tile of evenly spread fingerprints has TILE members at most.

    Lanes of w bits have population counts of deviation sqrt(w)/2, about 3.54 times that
    many values in effect. The number changes the tiles' shape, never the result.
    """
    return next((k for k in (2, 4, 8) if n / (3.54 * (64 / k) ** 0.5 / 2) ** k <= TILE), 16)


def _signature(fp: str, lanes: int) -> F.Column:
    bits = 64 // lanes
    return F.array(*(F.bit_count(F.shiftrightunsigned(fp, bits * k).bitwiseAND(F.lit((1 << bits) - 1))) for k in range(lanes)))


def _near(lanes: int, radius: int) -> list[tuple[int, ...]]:
    """Differences of signatures up to the radius, one of each two opposite ones."""
    found = set()
    for places in itertools.combinations_with_replacement(range(lanes), radius):
        for steps in itertools.product((-1, 0, 1), repeat=radius):
            d = [0] * lanes
            for p, s in zip(places, steps, strict=True):
                d[p] += s
            if sum(map(abs, d)) <= radius and tuple(d) >= (0,) * lanes:
                found.add(tuple(d))
    return sorted(found)


def _code(lanes: int) -> list[int]:
    base = 64 // lanes + 1
    return [base**k for k in range(lanes)]


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (u, v) that connect the distinct fingerprints `fp` exactly as the links at up to
    `radius` differing bits do."""
    bounded_batches(fps.sparkSession)
    lanes = lanes_for(fps.count())
    base, weights = 64 // lanes + 1, _code(lanes)
    near = F.array(*(F.array(*map(F.lit, d)) for d in _near(lanes, radius)))
    coded = lambda counts: sum((F.get(counts, k).cast("decimal(38,0)" if lanes > 8 else "long") * F.lit(w) for k, w in enumerate(weights)), F.lit(0)).cast("string" if lanes > 8 else "long")
    around = lambda counts: F.transform(F.filter(F.transform(near, lambda d: F.zip_with(counts, d, lambda c, x: c - x)), lambda s: F.forall(s, lambda c: (c >= 0) & (c < base))), coded)
    tiles = fps.select("fp", _signature("fp", lanes).alias("counts")).select("fp", "counts", coded(F.col("counts")).alias("tile"))
    cuts = checkpointed(tiles.groupBy("tile").agg(F.first("counts").alias("counts"), F.ceil(F.count("*") / TILE).cast("int").alias("cuts")).where("cuts > 1"))
    # Joins by tile would gather a full tile in one task; what is joined is a row for each full tile.
    small = F.broadcast if cuts.count() <= MOST_BROADCAST else (lambda x: x)
    members = tiles.join(small(cuts.select("tile", "cuts")), "tile", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    dealt = lambda parts: F.pmod(F.xxhash64("fp"), parts).cast("int")
    of_tile = cuts.select(F.col("tile").alias("unit"), F.col("cuts").alias("left_cuts"))
    right = members.select("fp", dealt(F.col("cuts") * SPREAD).alias("j"), F.explode(around(F.col("counts"))).alias("unit")).join(small(of_tile), "unit", "left")
    right = right.select("unit", F.explode(F.sequence(F.lit(0), F.coalesce("left_cuts", F.lit(1)) - 1)).alias("i"), "j", "fp", F.lit(True).alias("right"))
    most = cuts.select(F.explode(around(F.col("counts"))).alias("unit"), "cuts").groupBy("unit").agg(F.max("cuts").alias("right_cuts"))
    left = members.select("fp", dealt(F.col("cuts")).alias("i"), F.col("tile").alias("unit")).join(small(most), "unit", "left")
    left = left.select("unit", "i", F.explode(F.sequence(F.lit(0), F.coalesce("right_cuts", F.lit(1)) * SPREAD - 1)).alias("j"), "fp", F.lit(False).alias("right"))

    def compare(unit: pd.DataFrame) -> pd.DataFrame:
        side = unit["right"].to_numpy(bool)
        fp = unit["fp"].to_numpy(np.int64)
        return pd.DataFrame(forest(fp[~side], fp[side], radius), columns=["u", "v"])

    return left.union(right).groupBy("unit", "i", "j").applyInPandas(compare, "u long, v long")


def forest(left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """(node, root) rows that connect the int64 numbers as the links between the sides do."""
    if not len(left) or not len(right):
        return np.empty((0, 2), np.int64)
    nodes = np.unique(np.concatenate([left, right]))
    order = lambda x: x[np.argsort(np.bitwise_count(x.view(np.uint64)), kind="stable")]
    left, right = order(left), order(right)
    bits_l, bits_r = (np.bitwise_count(x.view(np.uint64)).astype(np.int16) for x in (left, right))
    at_l, at_r = np.searchsorted(nodes, left), np.searchsorted(nodes, right)
    label, step = np.arange(len(nodes)), max(1, BLOCK // len(right))
    for a in range(0, len(left), step):
        b = min(a + step, len(left))
        lo, hi = np.searchsorted(bits_r, bits_l[a] - radius), np.searchsorted(bits_r, bits_l[b - 1] + radius, "right")
        i, j = np.nonzero(np.bitwise_count(left[a:b, None].view(np.uint64) ^ right[None, lo:hi].view(np.uint64)) <= radius)
        label = unite(label, at_l[a:b][i], at_r[lo:hi][j])
    out = label != np.arange(len(nodes))
    return np.stack([nodes[out], nodes[label[out]]], axis=1)


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merges the sets of a[k] and b[k]; labels are roots, the smallest of their sets."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(label, up := label[label]):
            label = up
        a, b = a[apart], b[apart]


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """(id, fingerprint, component_id) of each row; component_id is the smallest id that links reach."""
    marked = checkpointed(add_fingerprints(df.select(col(id_col).alias("id"), col(text_col).alias("text")), "text", "fp", width).select("id", "fp"))
    distinct = checkpointed(marked.groupBy("fp").agg(F.min("id").alias("least")))
    roots = checkpointed(components(links(distinct, radius)))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    heads = rooted.groupBy("root").agg(F.min("least").alias("head"))
    by_fp = rooted.join(heads, "root").select("fp", F.col("head").alias("component_id"))
    return marked.join(by_fp, "fp", "left").select(F.col("id").alias(id_col), F.col("fp").alias("fingerprint"), "component_id")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """One row of each component: that of the smallest id, a null one only where the component
    has no other."""
    find = lambda rows: near_duplicates(rows, "row", "text", width, radius).select("row", F.col("component_id").alias("group"))
    return keep_first(df, id_col, text_col, find)


def hex_fingerprint(fp: str) -> F.Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
