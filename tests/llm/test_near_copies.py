import random

import numpy as np
import pytest
from llm_rows import ROWS

import corpus_pipeline
from cellmend.llm import decontam, near_copies, simhash


def brute_groups(texts):
    def shingles(text):
        words = (text or "").encode().lower().split()
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()

    sets, group = [shingles(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 10 * len(a & b) >= 8 * len(a | b):
                x, y = group[i], group[j]
                group = [min(x, y) if g in (x, y) else g for g in group]
    return group


def edited():
    """Texts of many lengths and their copies: edited, cut, and edited again."""
    rand = random.Random(4)
    boiler = " ".join(f"b{k}" for k in range(40))
    rows = []
    for i in range(40):
        words = [f"w{rand.randrange(200)}" for _ in range(rand.choice([5, 9, 20, 60, 300]))] + (boiler.split() if i % 4 == 0 else [])
        for k in range(rand.randint(1, 5)):
            rows.append((1000 - 10 * i - k, " ".join(words)))
            for _ in range(rand.randint(0, max(1, len(words) // 40))):
                words[rand.randrange(len(words))] = f"x{rand.randrange(99)}"
            words = words[rand.randint(0, len(words) // 20) :]
    return [*rows, *ROWS, ROWS[6], (None, ROWS[-1][1])]


def staying(rows):
    best = {}
    for (i, t), g in zip(rows, brute_groups([t for _, t in rows]), strict=True):
        best[g] = min(best.get(g, (True, 0)), (i is None, i or 0))
    return sorted(best.values())


@pytest.mark.parametrize("tile, block", [(4096, 1 << 18), (4, 64)])
def test_near_copies_go(spark, monkeypatch, tile, block):
    monkeypatch.setattr(near_copies, "TILE", tile)
    monkeypatch.setattr(near_copies, "BLOCK", block)
    monkeypatch.setattr(near_copies, "tile_size", lambda n: tile)
    rows = edited()
    df = spark.createDataFrame([(i, t, "en", "src", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    left = corpus_pipeline.drop_near_copies(spark, df, "")
    found = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in left.collect())
    assert left.columns == corpus_pipeline.COLUMNS and found == staying(rows)
    assert len(found) < len({t for _, t in rows}) - 30


def as_rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def left_by_brute(texts):
    return sorted({g for g in brute_groups(texts)})


@pytest.mark.parametrize("frequent", [2, 10**9])
def test_no_link_is_lost_beyond_the_radius(spark, monkeypatch, frequent):
    """Sets of few shingles that are four of five alike, of which fingerprints miss several."""
    monkeypatch.setattr(near_copies, "FREQUENT", frequent)
    rand = random.Random(6)
    texts = []
    for i in range(150):
        words = [f"w{rand.randrange(500)}" for _ in range(rand.choice([9, 9, 13, 14, 19]))]
        texts += [" ".join(words), " ".join(words[: -((len(words) - 4) // 5)])]
    left = near_copies.drop_near_copies(as_rows(spark, texts))
    assert sorted(r["doc_id"] for r in left.collect()) == left_by_brute(texts)


def test_no_link_is_lost_where_forests_fail(spark, monkeypatch):
    """Were no link in any forest, all would be found between the groups."""
    texts = [t for _, t in edited()]
    df, expected = as_rows(spark, texts), left_by_brute(texts)
    monkeypatch.setattr(near_copies, "_candidates", lambda nodes, *_: nodes.sparkSession.createDataFrame([], "u long, v long, forest long"))
    assert sorted(r["doc_id"] for r in near_copies.drop_near_copies(df).collect()) == expected


def rows_made(spark, run):
    """The most rows that a Generate, Python or join node of the queries within run() made."""
    store = spark._jsparkSession.sharedState().statusStore()
    before, out, most = store.executionsCount(), run(), 0
    for e in range(before, store.executionsCount()):
        listed = store.executionsList(e, 1).head()
        values, nodes = store.executionMetrics(listed.executionId()), store.planGraph(listed.executionId()).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            if any(w in node.name() for w in ("Generate", "Pandas", "Arrow", "Join")):
                of = node.metrics()
                for m in (of.apply(k) for k in range(of.size())):
                    if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return out, most


def test_a_family_that_is_not_alike_enough_makes_no_rows_for_its_pairs(spark):
    """Sixty edits of one text that share three of five shingles: at none of the shingles, nor in all."""
    rand = random.Random(7)
    base, texts = [f"w{k}" for k in range(300)], []
    for i in range(60):
        words = list(base)
        for k in rand.sample(range(300), 8):
            words[k] = f"x{i}x{k}"
        texts.append(" ".join(words))
    left, most = rows_made(spark, lambda: sorted(r["doc_id"] for r in near_copies.drop_near_copies(as_rows(spark, texts)).collect()))
    assert left == left_by_brute(texts) and len(left) > 55
    assert 0 < most <= 60 * (300 - 4)  # as many as all their shingles


@pytest.mark.parametrize("tile, members, look", [(4096, 1 << 12, 1 << 23), (4, 16, 64)])
def test_links_between_groups_in_cuts(spark, monkeypatch, tile, members, look):
    """All pairs meet where a family is cut, and blocks hold a pair each."""
    for name, value in (("TILE", tile), ("MEMBERS", members), ("LOOK", look), ("PACKED", members), ("SHARD", members)):
        monkeypatch.setattr(near_copies, name, value)
    monkeypatch.setattr(near_copies, "_candidates", lambda nodes, *_: nodes.sparkSession.createDataFrame([], "u long, v long, forest long"))
    rand, base = random.Random(3), [f"w{k}" for k in range(60)]
    texts = []
    for i in range(40):
        words = list(base)
        for k in rand.sample(range(60), rand.choice([1, 2, 2, 3])):
            words[k] = f"x{i}x{k}"
        texts.append(" ".join(words))
    left = near_copies.drop_near_copies(as_rows(spark, texts))
    expected = left_by_brute(texts)
    assert sorted(r["doc_id"] for r in left.collect()) == expected and 1 < len(expected) < 40


def test_packed_rows_come_back():
    rand = np.random.default_rng(1)
    h = rand.integers(0, 1 << 62, 500).astype(np.uint64)
    h[300:] = h[:200]
    rows = rand.choice([1, 5, 1 << 32, (3 << 33) + 7, (1 << 62) + (1 << 32) - 1, -9], 500).astype(np.int64)
    rows[300:] = rows[:200] ^ 2
    found, packed = set(), near_copies.pack(h, rows, 64)
    for shard in {p[0] for p in packed}:
        of = [p for p in packed if p[0] == shard]
        key, row = near_copies.unpack_shared(shard, np.array([p[1] for p in of]), [p[2] for p in of], [p[3] for p in of])
        for k in np.unique(key):
            found.add(tuple(sorted(row[key == k].tolist())))
    assert found == {tuple(sorted((int(rows[k]), int(rows[300 + k])))) for k in range(200)}


@pytest.mark.parametrize("most", [1, 7, 1 << 20])
def test_cross_pairs(most):
    rand = np.random.default_rng(8)
    for n in (0, 1, 30):
        key, root = rand.integers(0, 4, n), rand.integers(0, 5, n)
        order = np.lexsort((root, key))
        key, root = key[order], root[order]
        pairs = [x for i, j in near_copies.cross_pairs(key, root, most) for x in zip(i.tolist(), j.tolist(), strict=True)]
        assert sorted(pairs) == [(i, j) for i in range(n) for j in range(i + 1, n) if key[i] == key[j] and root[i] != root[j]]


def test_bitmaps_bound_what_is_shared():
    rand = np.random.default_rng(9)
    for _ in range(200):
        a, b = (np.unique(rand.integers(0, 1 << 62, int(rand.integers(1, 90))).astype(np.uint64)) for _ in range(2))
        a = np.union1d(a, b[: int(rand.integers(0, len(b) + 1))])
        shared = len(np.intersect1d(a, b))
        assert shared <= near_copies.most_shared(near_copies.bitmap(a), near_copies.bitmap(b), len(a), len(b)) <= shared + 40


def test_first_shingles_meet():
    """Any two sets of the likeness share a first one, whatever is frequent."""
    rand = np.random.default_rng(2)
    for likeness in (0.5, 0.8, 1.0):
        for _ in range(200):
            n = int(rand.integers(1, 60))
            shared = int(np.ceil(likeness * n))
            h = rand.permutation(200)[: 2 * n - shared].astype(np.uint64)
            a, b, frequent = np.sort(h[:n]), np.sort(h[n - shared :]), np.sort(rand.permutation(200)[:100]).astype(np.uint64)
            if len(a) and len(np.intersect1d(a, b)) >= likeness * len(np.union1d(a, b)):
                assert len(np.intersect1d(*(near_copies.first_shingles(x, frequent, likeness) for x in (a, b))))


def test_near_copies_of_odd_tables(spark, odd, none):
    assert near_copies.drop_near_copies(none).count() == 0
    left = near_copies.drop_near_copies(odd)
    assert left.columns == odd.columns and sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in left.collect()) == staying(ROWS)


@pytest.mark.parametrize("block", [1 << 18, 3])
def test_nearest_forest(monkeypatch, block):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    rand = np.random.default_rng(3)
    for n, m in ((1, 0), (5, 4), (40, 30), (40, 300)):
        u, v, d = rand.integers(0, n, m), rand.integers(0, n, m), rand.integers(0, 5, m)
        label, total = list(range(n)), 0
        for k in np.argsort(d, kind="stable"):
            x, y = label[u[k]], label[v[k]]
            if x != y:
                total += d[k]
                label = [x if g == y else g for g in label]
        kept = near_copies.nearest_forest(n, u, v, d)
        assert d[kept].sum() == total and len(set(kept.tolist())) == len(kept) == n - len(set(label))
        nearest = near_copies.Nearest(n)
        for a in range(0, m, 7):
            nearest.add(u[a : a + 7], v[a : a + 7], d[a : a + 7])
        at_once = [sorted(d[x].tolist()) for x in near_copies.nearest_forests(n, u, v, d)]
        of = {k: sorted(nearest.links[2, x].tolist()) for k, x in enumerate(near_copies.nearest_forests(n, *nearest.links))}
        assert [of[k] for k in range(near_copies.FORESTS)] == at_once


def test_recall_of_links_at_the_likeness():
    """Of pairs of sets of likeness 0.8 to 0.85 nearly all are within the radius; of 0.5 none."""
    rand = np.random.default_rng(5)
    near = {0.8: [], 0.5: []}
    for likeness, found in near.items():
        for _ in range(300):
            n = int(rand.integers(20, 400))
            shared = round(2 * n * likeness / (1 + likeness))
            h = rand.integers(0, 1 << 63, 2 * n - shared, dtype=np.int64).view(np.uint64) * np.uint64(3)
            a, b = (np.array(near_copies.wide_fingerprint(x)) for x in (h[:n], h[n - shared :]))
            found.append(int(np.bitwise_count((a ^ b).view(np.uint64)).sum()) <= near_copies.RADIUS)
    assert sum(near[0.8]) >= 0.97 * 300 and sum(near[0.5]) <= 0.05 * 300


def test_rows_of_null_and_repeated_ids(spark):
    leak, text, other = "one two three four five six", "a text of some words that is here again and again", "nothing like the rest of them in any way"
    rows = [(None, leak), (1, leak), (1, other), (5, text), (5, text), (None, text), (None, text), (None, "alone without an id"), (None, "alone without an id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(0, leak)], "item_id long, text string")
    clean = decontam.decontaminate(df, items)
    assert sorted(map(str, clean.collect())) == sorted(map(str, df.where(df["text"] != leak).collect()))
    expected = sorted([(1, other), (5, text), (-1, "alone without an id")])
    for drop in (simhash.drop_near_duplicates, near_copies.drop_near_copies):
        assert sorted((-1 if i is None else i, t) for i, t in drop(clean).collect()) == expected
