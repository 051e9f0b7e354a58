import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import pytest
import regex
from llm_rows import ROWS, write

from cellmend.llm import boosting, langid, licenses, pii, queries, sketch

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# Personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and any(int(p) > 255 for p in m[0].split("."))) or (kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits))) or (kind == "phone" and not 10 <= len(digits) <= 15):
                continue
            out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def pii_texts():
    rand = random.Random(3)
    parts = ["a", "@", ".", "1", "23", "255", "256", "4111111111111111", "4111 1111-1111 1111", "+", "+1 (419) 555-5573", "(", " ", "-", "x@y.z", "_", "é", "🙂", "\n", "0", "tel ", "mail4.example.com", "95.148.107.251", "000255.1.2.3", "%"]
    texts = ["".join(rand.choices(parts, k=rand.randint(0, 12))) for _ in range(400)]
    return [*texts, "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "+1+1234567890", "a" * 20000, "1." * 4000, "+1" + "(" * 5000, "a@" + "b." * 3000 + "c", "1 " * 4000, None, ""]


def test_op2(spark, tmp_path):
    texts = pii_texts()
    rows = [*enumerate(texts, 100), *ROWS]
    sf = write(spark, tmp_path, documents=(rows, "doc_id long, text string"))
    found = queries.op2_pii(spark, sf).collect()
    assert len(found) == len(rows)
    by_id = defaultdict(list)
    for i, t in rows:
        by_id[i].append(t or "")
    for r in found:
        spans = base_spans(by_id[r["doc_id"]][0])
        text = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest(), (by_id[r["doc_id"]], text, r["spans"])
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(s[3] == k for s in spans) for k in PATTERNS]
        assert set(filter(None, text.split(","))) <= set(r["spans"].split(","))


def pii_corpus():
    """Texts with cards, phones, addresses and secrets, and as many with numbers and long words only."""
    rand = random.Random(12)
    rows = []
    for i in range(400):
        card = "".join(rand.choices("0123456789", k=15))
        card += next(c for c in "0123456789" if luhn(card + c))
        card = card if i % 2 else " ".join(card[k : k + 4] for k in range(0, 16, 4))
        phone, ip = f"+1 ({rand.randrange(200, 999)}) 555-{rand.randrange(1000, 9999)}", ".".join(str(rand.randrange(256)) for _ in range(4))
        token = "".join(rand.choices("0123456789abcdef", k=40))
        rows.append((i, rand.choice([f"{rand.choice(['please pay by card', 'it is', 'pay', 'with'])} {card}{rand.choice([', thanks', ' now', ' or so'])}", f"call {phone} now", f"the host {ip} is up", f"mail x{i}.{i}@mail{i}.example.com please", f'set token = "{token}" here'])))
    for i in range(400, 700):
        rows.append((i, rand.choice([f"in the year {1000 + i} 10 01 12 it was {i}", f"Donaudampfschifffahrtsgesellschaft {i} and characteristically", "rows " + " ".join(str(rand.randrange(10**5)) for _ in range(9)), "nothing of the kind"])))
    return rows


def test_the_trees_add_what_the_base_patterns_miss(spark):
    rows = pii_corpus()
    token = "0a1b2c3d4e5f60718293a4b5c6d7e8f901234567"
    planted = {
        900: ("ref 2024 4111 1111 1111 1111 ok", "4111 1111 1111 1111", "card"), 901: ("pay 4111111111111111 4012888888881881 now", "4111111111111111", "card"),
        902: ("call +1 (826) 555-4081 190.137.223.204 now", "+1 (826) 555-4081", "phone"), 903: (f'set TOKEN = "{token}" here', token, "secret"),
        904: (f"the value {token} is alone", token, "secret"), 905: ('set token = "hunter2" here', "hunter2", "secret"),
    }
    df = spark.createDataFrame([*rows, *((i, t) for i, (t, _, _) in planted.items()), (950, "in the year 2024 10 01 12 it was 7"), (951, None), (952, "ref 2024 4111 1111 1111 1112 ok")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.find_pii(df).collect()}
    for i, (text, span, kind) in planted.items():
        assert (text.index(span), text.index(span) + len(span), kind) in [(x["s"], x["e"], pii.ALL_KINDS[x["k"]]) for x in found[i]["added"]], (i, found[i])
    assert not any(found[i]["added"] for i in (950, 951, 952))
    # Recall of what was planted in the corpus, and no span in the clean half.
    private = [i for i, t in rows if i < 400]
    assert sum(bool(found[i]["base"] or found[i]["added"]) for i in private) >= 0.98 * len(private)
    assert not any(found[i]["added"] for i in range(400, 700))
    redacted = {r["doc_id"]: r["redacted"] for r in pii.redact(df).collect()}
    assert redacted[900] == "ref 2024 [card] ok" and redacted[902] == "call [phone] [ip] now" and redacted[905] == 'set token = "[secret]" here' and redacted[951] == ""


def test_proposals_overlap(spark):
    df = spark.createDataFrame([(1, "ref 2024 4111 1111 1111 1112 or (826) 555-4081"), (2, "x (at) y.org, a@b.c, " + "7 " * 3000), (3, "secret_key: 'abc123def456ghi7'")], "doc_id long, text string")
    found = {r["id"]: [(x["s"], x["e"]) for x in r["proposed"]] for r in pii.found_spans(df, "doc_id", "text").collect()}
    assert (4, 28) not in found[1] and {(4, 23), (9, 28), (32, 46)} <= set(found[1])
    assert (0, 12) in found[2] and len(found[2]) < 10 * 3000
    assert (13, 29) in found[3]


def test_empty_pii(spark, none, odd):
    assert pii.find_pii(none).count() == 0
    assert pii.find_pii(odd).count() == len(ROWS)


def test_boosting_separates():
    cells = [boosting.Cell((a, b, c), 10, 9 if a > 2 and b == 1 else 1) for a in range(5) for b in range(3) for c in range(4)]
    model = boosting.boost(cells)
    model.calibrate(cells, 0.85)
    assert all((model(c.features) >= model.threshold) == (c.positive == 9) for c in cells)
    assert boosting.boost([boosting.Cell((0,), 5, 0)]) is None and boosting.boost([]) is None
    sure = boosting.boost([boosting.Cell((0,), 9, 9)])
    sure.calibrate([boosting.Cell((0,), 9, 9)], 0.8)
    assert sure((0,)) >= sure.threshold
    sure.calibrate([boosting.Cell((0,), 3, 3)], 0.8)
    assert sure.threshold == math.inf


# Language

LANGS = {"en": "the quick brown fox jumps over the lazy dog while it was raining there and nobody saw what happened with them", "de": "der schnelle braune fuchs springt über den faulen hund während es regnete und niemand sah was mit ihnen geschah", "fr": "le renard brun rapide saute par dessus le chien paresseux pendant que la pluie tombait et personne ne voyait rien"}


def lang_rows(n=150):
    rand = random.Random(5)
    rows = []
    for i in range(n):
        lang = rand.choice(sorted(LANGS))
        rows.append((i, " ".join(rand.choices(LANGS[lang].split(), k=12)), lang))
    return rows


def test_op3(spark, tmp_path):
    rows = lang_rows()
    extra = [(1000, None, "en"), (1001, "", None), (1002, "123 !!", "en"), (1003, "x" * 3000, None), (1004, "quick brown fox", None), (None, "der hund", None)]
    sf = write(spark, tmp_path, documents=([*rows, *extra], "doc_id long, text string, lang string"))
    found = {r["doc_id"]: r for r in queries.op3_language(spark, sf).collect()}
    assert all(found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in found if i is not None)
    held = [(found[i]["lang_pred"], lang) for i, _, lang in rows if found[i]["held_out"]]
    assert sum(a == b for a, b in held) >= 0.95 * len(held) and held
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert found[1004]["lang_pred"] == "en" and found[None]["lang_pred"] == "de" and found[1003]["lang_pred"] in LANGS
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_labels_of_held_out_rows_are_not_seen(spark):
    rows = [(i, t, lang if zlib.crc32(str(i).encode()) % 4 != 2 else "xx") for i, t, lang in lang_rows(80)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), langid.vocabulary(queries.PIECES))
    assert set(model.langs) <= set(LANGS)


def test_no_labels(spark, none, odd):
    from pyspark.sql import functions as F

    model = langid.train(odd.withColumn("lang", F.lit(None).cast("string")), ["▁", "a"])
    assert {r["lang_pred"] for r in langid.predict(odd, model).collect()} == {"und"}
    assert langid.predict(none, model).count() == 0


def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab", "bc"]
    model = langid.fit({"l": {"ab": 3, "abc": 2, "a": 1}}, pieces)
    p = dict(zip(pieces, model.p[2:, 0], strict=True))

    def total(text):
        if not text:
            return 1.0
        return sum((p.get(text[:k]) or (langid.UNKNOWN if k == 1 else 0)) * total(text[k:]) for k in range(1, len(text) + 1))

    for word in ("a", "ab", "abc", "cab", "bcabab"):
        assert model.log_likelihoods(model.index, [word])[0, 0] == pytest.approx(math.log(total("▁" + word)), rel=1e-5)
    assert model.p[:, 0].sum() == pytest.approx(1)


def test_words_and_pieces_of_any_length(monkeypatch):
    counts = {"l": {"abcabc": 3, "zz": 2, "ab" * 30: 4}, "m": {"cccb": 2, "bc" * 25: 1}}
    pieces = ["▁", "a", "b", "c", "ab", "abc", "▁abcabcabcabc"]
    long = langid.fit(counts, pieces)
    monkeypatch.setattr(langid, "LONGEST", 100)
    bulk = langid.fit(counts, pieces)
    assert long.p == pytest.approx(bulk.p, rel=1e-6) and long.longest == 13
    found = ["ab" * 30, "abcabcabcabcabc", "c" * 40]
    expected = bulk.log_likelihoods(bulk.index, found)
    monkeypatch.setattr(langid, "LONGEST", 3)
    assert long.log_likelihoods(long.index, found) == pytest.approx(expected, rel=1e-4)
    scores = long.log_likelihoods(long.index, ["ab" * 500, "x" * 1000])
    assert scores[0, 0] > scores[0, 1] > -1e5 and scores[1] == pytest.approx([math.log(long.p[2, k]) + 1000 * math.log(langid.UNKNOWN) for k in (0, 1)], rel=1e-4)
    assert max(map(len, langid.vocabulary(queries.PIECES))) > 7


def test_scorer_is_bounded(monkeypatch):
    monkeypatch.setattr(langid, "CACHE", 8)
    model = langid.fit({"l": {"ab": 3}, "m": {"b": 1}}, ["▁", "a", "b"])
    scorer = langid.Scorer(model)
    from collections import Counter

    for i in range(30):
        found = [f"w{chr(97 + (i * 7 + j) % 26)}{'b' * j}" for j in range(12)]
        expected = model.log_likelihoods(model.index, found).sum(axis=0)
        c = Counter(found)
        assert scorer.scores([c])[0] == pytest.approx(expected, rel=1e-4)
        assert len(scorer.newer) <= 8 and len(scorer.older) <= 8


# Licenses

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def license_base(text):
    words, places, labels = WORD.findall(text.translate(AZ)), [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), places, ",".join(sorted(labels))


def test_op6(spark, tmp_path):
    texts = ["MIT License", "the mit,license mit license", "Released under the M1T Licence.", "GNU General\nPublic License v3", "apache licence apache license", "general public license general public license", "émit license", "mitlicense", "Gnu Generl Publik License", "permission is hereby granted, free of charge", "nothing at all", "Mozila Public Licence 2.0"]
    rows = [*enumerate(texts, 100), *ROWS]
    sf = write(spark, tmp_path, documents=(rows, "doc_id long, text string"))
    by_id = {i: t or "" for i, t in rows}
    found = {r["doc_id"]: r for r in queries.op6_license_scan(spark, sf).collect()}
    for i, r in found.items():
        n, places, labels = license_base(by_id[i])
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (n, len(places), min(places, default=None), max(places, default=None), labels)
    assert found[102]["labels"] == "mit" and not found[102]["base_labels"] and 0 < found[102]["score"] < 1
    assert found[108]["labels"] == "gpl" and found[109]["labels"] == "mit" and found[111]["labels"] == "mpl"
    assert found[110]["labels"] == "" and found[110]["score"] == 0 and found[100]["score"] == 1


def test_seeds_lose_no_fuzzy_match():
    rand = random.Random(2)
    notice = licenses.Notice("gnu general public license", "gpl")
    pattern = regex.compile(f"(?:{notice.text}){{e<={notice.edits}}}")
    for _ in range(400):
        text = list(notice.text)
        for _ in range(rand.randint(0, 4)):
            k, how = rand.randrange(len(text)), rand.randrange(3)
            text[k : k + (how != 0)] = [rand.choice("abcxyz ")] * (how != 2)
        joined = "some words " + "".join(text) + " and more"
        assert bool(notice.spans(joined.encode())) == bool(pattern.search(joined)), joined


def test_spans_of_licenses(spark, none, odd):
    df = spark.createDataFrame([(1, "It is under the GNU Generall Public License here")], "doc_id long, text string")
    r = licenses.scan_licenses(df).first()
    assert [(x["label"], x["start"], x["end"], x["edits"]) for x in r["fuzzy"]] == [("gpl", 4, 8, 1)] and r["exact"] == []
    assert licenses.scan_licenses(none).count() == 0 and licenses.scan_licenses(odd).count() == len(ROWS)


# Sketches


def shingle_set(text):
    found = text.encode().lower().split()
    return {tuple(found[k : k + 5]) for k in range(max(1, len(found) - 4))} if found else set()


def jaccard(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b) if a or b else 1.0


def test_likeness_of_real_texts(spark):
    """Against exact Jaccard, on whole documents: short texts lose nothing, long ones little."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    done = sketch.compare_with_edits(docs).select("doc_id", "edited", sketch.likeness(F.col("sketch"), F.col("edited_sketch")).alias("near"))
    by_id, wrong = {r["doc_id"]: r["text"] or "" for r in docs.collect()}, []
    for r in done.collect():
        true = jaccard(by_id[r["doc_id"]], r["edited"])
        assert not (true >= 0.3 and r["near"] == 0)
        wrong.append(abs(true - r["near"]))
    assert sum(wrong) / len(wrong) < 0.03 and max(wrong) < 0.2


def test_short_text_in_a_long_one(spark):
    from pyspark.sql import functions as F

    rand = random.Random(8)
    rows = []
    for n in (5, 6, 10, 20, 60, 200):
        for _ in range(40):
            long = [f"w{rand.randrange(10**6)}" for _ in range(4000)]
            at = rand.randrange(3000)
            rows.append((n, " ".join(long[at : at + n]), " ".join(f"x{w}" for w in long[at : at + n]), " ".join(long)))
    df = spark.createDataFrame(rows, "n int, short string, other string, long string")
    for name in ("short", "other", "long"):
        df = sketch.add_sketch(df, name, f"s_{name}")
    found = df.groupBy("n").agg(F.min(sketch.containment(F.col("s_short"), F.col("s_long"))).alias("least"), F.max(sketch.containment(F.col("s_other"), F.col("s_long"))).alias("most"), F.count(sketch.containment(F.col("s_short"), F.col("s_long"))).alias("told")).collect()
    assert all((r["least"] is None or r["least"] == 1) and not r["most"] for r in found)
    assert all(r["told"] == 40 for r in found if r["n"] >= 60)


@pytest.mark.parametrize("range_rows", [1000, 3])
def test_op9(spark, tmp_path, monkeypatch, range_rows):
    monkeypatch.setattr(sketch, "RANGE_ROWS", range_rows)
    rand = random.Random(4)
    texts = [t for i, t in ROWS if i not in (11, None)] + [" ".join(rand.choices("a b c d e f g h i".split(), k=rand.randint(0, 200))) for _ in range(30)]
    rows = [(7 * i - 20, t) for i, t in enumerate(texts)]
    rand.shuffle(rows)
    sf = write(spark, tmp_path, documents=(rows, "doc_id long, text string"))
    found = {r["doc_id"]: r for r in queries.op9_fingerprints(spark, sf).collect()}
    ordered = sorted(rows)
    by_text = {}
    assert len(found) == len(rows)
    for (i, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        text, after, r = t or "", after or "", found[i]
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + after[:quarter]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert by_text.setdefault(edited, r["edited_fingerprint"]) == r["edited_fingerprint"]
        near, following = jaccard(text, edited), jaccard(text, after)
        for estimate, true, pair in ((r["near_edited"], near, (text, edited)), (r["near_next"], following, (text, after))):
            small = max(len(shingle_set(x)) for x in pair) < sketch.LEAST  # kept whole
            assert estimate == pytest.approx(true, abs=1e-9 if small else 0.2), (i, estimate, true)
        assert r["near_edited"] == 1 or r["fingerprint"] != r["edited_fingerprint"]


def test_sketches_estimate_containment_and_merge(spark):
    from pyspark.sql import functions as F

    rand = random.Random(6)
    words = [f"w{rand.randrange(10**6)}" for _ in range(8000)]
    df = spark.createDataFrame([(" ".join(words), " ".join(words[2000:4000]), " ".join(words[4004:]))], "a string, b string, c string")
    for name in "abc":
        df = sketch.add_sketch(df, name, f"s{name}")
    r = df.select(sketch.containment(F.col("sb"), F.col("sa")).alias("x"), sketch.containment(F.col("sa"), F.col("sb")).alias("y"), sketch.likeness(F.col("sb"), F.col("sc")).alias("z"), sketch.merged(F.col("sb"), F.col("sc")).alias("m"), F.array_sort(F.array_union("sb", "sc")).alias("u")).first()
    assert r["x"] == 1 and r["y"] == pytest.approx(0.25, abs=0.06) and r["z"] == 0 and r["m"] == r["u"]


def test_sketch_of_odd_rows(spark, odd, none):
    assert sketch.compare_with_edits(none).count() == 0
    found = sketch.compare_with_edits(odd)
    assert found.count() == len(ROWS)
    assert sketch.add_sketch(odd, out="ids").columns.count("ids") == 1
    alone = spark.createDataFrame([(None, "a b c d e f g h")], "doc_id long, text string")
    r = sketch.compare_with_edits(alone).first()
    assert r["edited"] == "a b c d e f " + "a b"
