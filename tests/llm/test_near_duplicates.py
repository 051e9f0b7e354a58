import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from llm_rows import ROWS, write

from cellmend.llm import components, decontam, line_dedup, queries, simhash

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WHITE = " \t\n\x0b\x0c\r"

# Lines


def kept_lines(rows):
    hold = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            key = line.strip(WHITE).translate(AZ)
            if len(key) >= 20:
                hold[key].add(-1 if i is None else i)
    stays = {k: max(v) for k, v in hold.items() if len(v) >= 3}

    def keep(i, line):
        key = line.strip(WHITE).translate(AZ)
        return key not in stays or stays[key] == (-1 if i is None else i)

    return {i: ((t or "").split("\n"), [x for x in (t or "").split("\n") if keep(i, x)]) for i, t in rows}


def line_rows():
    rand = random.Random(1)
    lines = [f"A shared line, number {k} of them all" for k in range(12)] + ["short", "", "   ", "ÄÖÜ äöü a line of letters beyond ascii", "\x85 twenty code points of it \x85"]
    rows = [(i, "\n".join((rand.choice([str.upper, str.lower, lambda x: f"\t{x} \r"]))(rand.choice(lines)) for _ in range(rand.randint(0, 9)))) for i in range(100, 160)]
    return [*rows, *ROWS, (None, lines[0]), (500, "\n".join([lines[0]] * 5))]


@pytest.mark.parametrize("keys, probes, most", [(50_000, 100_000, 100_000), (3, 7, 100_000), (3, 7, 0)])
def test_op5(spark, tmp_path, monkeypatch, keys, probes, most):
    monkeypatch.setattr(line_dedup, "MOST_BROADCAST", most)
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", keys)
    monkeypatch.setattr(line_dedup, "SHARD_PROBES", probes)
    rows = [r for r in line_rows() if r != (None, ROWS[-1][1])]
    sf = write(spark, tmp_path, documents=(rows, "doc_id long, text string"))
    expected = kept_lines(rows)
    found = queries.op5_line_dedup(spark, sf).collect()
    assert len(found) == len(rows)
    for r in found:
        lines, kept = expected[r["doc_id"]]
        assert (r["n_lines"], r["n_dropped"], r["kept_sha256"]) == (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()), r
    assert sum(r["n_dropped"] for r in found) > 20


def test_lines_of_odd_tables(spark, odd, none):
    assert line_dedup.drop_shared_lines(none).count() == 0
    done = line_dedup.drop_shared_lines(odd, out_col="ids")
    assert done.count() == len(ROWS) and set(done.columns) == {"doc_id", "text", "Score", "a.b", "ids", "n_lines", "n_dropped"}


def test_lines_of_text_ids(spark):
    line = "A line of more than twenty letters"
    df = spark.createDataFrame([("b", line), ("x-1", line), ("a", line), ("x-0", "other\n" + line), (None, line)], "doc_id string, text string")
    done = {r["doc_id"]: (r["kept"], r["n_dropped"]) for r in line_dedup.drop_shared_lines(df).collect()}
    assert done == {"b": ("", 1), "x-1": (line, 0), "a": ("", 1), "x-0": ("other", 1), None: ("", 1)}


def test_perfect_hash():
    rand = np.random.default_rng(0)
    for n in (0, 1, 2, 1000, 20000):
        h1, h2 = rand.integers(0, 1 << 63, (2, n)).astype(np.uint64)
        h1[: n // 3] = 7  # equal first halves
        index = line_dedup.PerfectHash.from_bytes(line_dedup.PerfectHash.build(h1, h2).to_bytes())
        assert sorted(index.slots(h1, h2).tolist()) == list(range(n))


# Fingerprints


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius=2):
    nodes = sorted(fps)
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if bin(fps[a] ^ fps[b]).count("1") <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def copies():
    rand = random.Random(2)
    base = [f"w{rand.randrange(300)}" for _ in range(400)]
    rows = [*[r for r in ROWS if r[0] not in (11, None)], (11, ROWS[10][1])]
    for i in range(100, 180):
        words = list(base) if i % 3 else [f"w{rand.randrange(300)}" for _ in range(50)]
        for _ in range(rand.randint(0, 2) if i % 3 else 0):
            words[rand.randrange(len(words))] = f"x{rand.randrange(9)}"
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("tile", [8192, 2])
def test_op8(spark, tmp_path, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    monkeypatch.setattr(simhash, "lanes_for", lambda n: 4 if tile == 2 else 2)
    rows = copies()
    sf = write(spark, tmp_path, documents=(rows, "doc_id long, text string"))
    fps = {i: brute_fingerprint(t) for i, t in rows}
    expected = brute_components(fps)
    found = queries.op8_simhash(spark, sf).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (int(r["fingerprint"], 16), r["component_id"]) == (fps[r["doc_id"]], expected[r["doc_id"]])
    assert len(set(expected.values())) < len(rows)


@pytest.mark.parametrize("lanes", [2, 4, 8, 16])
def test_tiles_lose_no_link(spark, monkeypatch, lanes):
    monkeypatch.setattr(simhash, "lanes_for", lambda n: lanes)
    rand = random.Random(lanes)
    fps = [0, (1 << 64) - 1]
    for _ in range(12):
        x = rand.getrandbits(64)
        for _ in range(4):
            fps.append(x)
            for _ in range(rand.randint(1, 3)):
                x ^= 1 << rand.randrange(64)
    fps = sorted(set(np.array(fps, np.uint64).view(np.int64).tolist()))
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = {r["node"]: r["root"] for r in components.components(simhash.links(df)).collect()}
    unsigned = {f: f & (1 << 64) - 1 for f in fps}
    expected = brute_components({f: unsigned[f] for f in fps})
    assert {f: found.get(f, f) for f in fps} == expected


def test_copies_of_odd_tables(spark, odd, none):
    assert simhash.near_duplicates(none).count() == 0
    found = {r["doc_id"]: r for r in simhash.near_duplicates(odd).collect()}
    assert simhash.near_duplicates(odd).count() == len(ROWS)
    assert {found[i]["component_id"] for i in (1, 2, 3)} == {1} and found[7]["component_id"] == found[8]["component_id"] == 7
    assert found[None]["component_id"] is None
    left = simhash.drop_near_duplicates(odd)
    assert left.columns == odd.columns and {r["doc_id"] for r in left.collect()} >= {1, 4, 7, None} and not {r["doc_id"] for r in left.collect()} & {2, 3, 8}


def test_components(spark):
    rand = random.Random(9)
    chain = [(i, i + 1) for i in range(60)] + [(100, 100), (None, 3), (200, 201), (201, 200)] + [(300 + rand.randrange(20), 300 + rand.randrange(20)) for _ in range(15)]
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert {found[i] for i in range(61)} == {0} and found[201] == 200 and 100 not in found and None not in found
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# Benchmark items


def contained(rows, items):
    import re

    def shingles(text, width):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").lower())
        return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}, len(words)

    out = []
    for i, t in rows:
        for j, x in items:
            width = min(5, shingles(x, 1)[1])
            own = shingles(x, width)[0] if width else set()
            shared = len(own & shingles(t, width)[0]) if own else 0
            if own and 10 * shared >= 8 * len(own):
                out.append((str(i), j, shared, len(own)))
    return sorted(out)


@pytest.mark.parametrize("block, pass_, waiting", [(16 << 20, 1 << 30, 32 << 20), (60, 1 << 30, 32 << 20), (60, 300, 100)])
def test_op7(spark, tmp_path, monkeypatch, block, pass_, waiting):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    monkeypatch.setattr(decontam, "PASS_BYTES", pass_)
    monkeypatch.setattr(decontam, "WAITING_BYTES", waiting)
    rand = random.Random(7)
    items = [(j, " ".join(f"w{rand.randrange(40)}" for _ in range(rand.randint(1, 30)))) for j in range(20)] + [(90, ROWS[6][1].upper()), (91, None), (92, "!!"), (93, "word"), (94, "Lazy, dog!"), (95, items_text := "word word word word word end")]
    rows = list(ROWS)
    for i in range(100, 140):
        words = rand.choice(items)[1]
        words = (words or "").split()
        for _ in range(rand.randint(0, 3)):
            if words:
                words[rand.randrange(len(words))] = "changed"
        noise = [f"n{rand.randrange(50)}" for _ in range(rand.choice([0, 5, 3000]))]
        rows.append((i, " ".join([*noise, *words, *noise])))
    sf = write(spark, tmp_path, documents=(rows, "doc_id long, text string"), benchmark=(items, "item_id long, text string"))
    found = queries.op7_decontamination(spark, sf)
    assert sorted((str(r["doc_id"]), r["item_id"], r["n_shared"], r["n_shingles"]) for r in found.collect()) == contained(rows, items)
    assert items_text and found.count() > 20


def test_many_items_in_long_texts(spark, monkeypatch):
    """100,000 items in several blocks: the short ones that stand in long texts are found, edited ones too."""
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 4 << 20)
    rand = random.Random(11)
    sizes = [1, 2, 5, 6, 9, 12, 17, 33, 64, 130]
    items = [(j, " ".join(f"v{rand.randrange(10**6)}" for _ in range(sizes[j % 10]))) for j in range(100_000)]
    rows, planted = [], set()
    for i in range(60):
        j = rand.randrange(100_000)
        x = items[j][1].split()
        if len(x) > 60:
            x[rand.randrange(len(x))] = "edited"
        noise = [f"n{rand.randrange(10**6)}" for _ in range(rand.choice([0, 40, 20_000]))]
        at = rand.randint(0, len(noise))
        rows.append((i, " ".join([*noise[:at], *x, *noise[at:]])))
        planted.add((i, j))
    found = decontam.contained_items(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), spark.createDataFrame(items, "item_id long, text string"))
    own = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    assert planted <= own and all(set(items[j][1].split()) <= set(rows[i][1].split()) for i, j in own - planted)


def test_leaks_go(spark, odd, none):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog")], "item_id long, text string")
    left = decontam.decontaminate(odd, items)
    assert left.columns == odd.columns and {r["doc_id"] for r in left.collect()} == {i for i, _ in ROWS} - {7, 8, 11}
    assert decontam.decontaminate(none, items).count() == 0
    assert decontam.decontaminate(odd, items.limit(0)).count() == len(ROWS)
