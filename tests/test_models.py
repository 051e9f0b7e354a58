"""Booster, search, rebalancing, chained predictions and the quality of repairs on planted errors."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellmend.api import Mender
from cellmend.functions import costs
from cellmend.operators import booster, models, rules, stats
from cellmend.operators import detectors as d

PARAMS = {"learning_rate": 0.2, "max_depth": 4, "n_estimators": 30, "min_child": 3, "min_split_gain": 0.0, "reg_alpha": 0.0, "column_share": 1.0}


def test_quantiles_by_ranks(spark, monkeypatch):
    rand = random.Random(5)
    columns = {"a": [rand.gauss(0, 10) for _ in range(3000)], "b": [float(rand.randrange(7)) for _ in range(3000)], "c": [rand.choice([None, 1e9, rand.random()]) for _ in range(3000)], "e": [None] * 3000}
    df = spark.createDataFrame(list(zip(*columns.values(), strict=True)), "a double, b double, c double, e double")
    shares = [0.0, 0.25, 0.5, 0.99, 1.0]
    expected = {k: (np.quantile([x for x in v if x is not None], shares).tolist() if k != "e" else None) for k, v in columns.items()}
    whole = stats.quantiles(df, {c: F.col(c) for c in columns}, shares)
    monkeypatch.setattr(stats, "EXACT_ROWS", 10)
    monkeypatch.setattr(stats, "LISTED", 5)
    for found in (whole, stats.quantiles(df, {c: F.col(c) for c in columns}, shares)):
        assert found["e"] is None and all(found[c] == pytest.approx(expected[c]) for c in "abc")


@pytest.mark.parametrize("most", [0, 1, 2, 4])
def test_segments_lose_no_pair(spark, most):
    rand = random.Random(most)
    clean = sorted({"".join(rand.choices("ab", k=rand.randint(0, 9))) for _ in range(60)})
    wrong = sorted({"".join(rand.choices("abc", k=rand.randint(0, 9))) for _ in range(60)})
    frame = lambda xs, name: spark.createDataFrame([("t", x) for x in xs], f"a string, {name} string")
    found = rules.within_edits(frame(wrong, "w"), frame(clean, "value"), most).where(F.levenshtein("w", "value") <= most)
    everything = frame(wrong, "w").join(frame(clean, "value"), "a").where(F.levenshtein("w", "value") <= most)
    assert sorted(map(tuple, found.select("w", "value").collect())) == sorted(map(tuple, everything.select("w", "value").collect()))


def test_numbered_names_meet_few(spark):
    """Segments that all names share bring nothing together, and no pair is lost for it."""
    names = [f"Customer#{i:09d}" for i in range(4000)]
    frame = lambda xs, name: spark.createDataFrame([("t", x) for x in xs], f"a string, {name} string")
    wrong = frame([x + "x" for x in names[::8]], "w")
    for most, met in ((1, 500), (2, 500 * 400)):
        found = rules.within_edits(wrong, frame(names, "value"), most)
        near = F.levenshtein("w", "value") <= most
        assert found.count() <= met and found.where(near).count() == wrong.join(frame(names, "value"), "a").where(near).count()


@pytest.mark.parametrize("batch", [1 << 20, 5])
def test_deletions_lose_no_pair(spark, monkeypatch, batch):
    monkeypatch.setattr(rules, "HASHES", batch)
    rand = random.Random(3)
    some = lambda n: sorted({"".join(rand.choices("aab\U0001f600", k=rand.randint(0, 9))) for _ in range(n)})
    wrong, clean = some(50), some(70)
    frame = lambda xs, name: spark.createDataFrame([("t", x) for x in xs], f"a string, {name} string")
    for most in (0, 1, 2):
        near = F.levenshtein("w", "value") <= most
        found = rules._by_deletions(frame(wrong, "w"), frame(clean, "value"), most).where(near)
        everything = frame(wrong, "w").join(frame(clean, "value"), "a").where(near).select("a", "w", "value")
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, everything.collect()))


@pytest.mark.parametrize("threshold", [0.0, 1.5, 3.0])
def test_nearest_as_by_all_pairs(spark, threshold):
    """Few edits are tried first; ties at the least cost and values beyond the threshold stay."""
    rand = random.Random(8)
    names = [f"item-{rand.randrange(10**6):07d}" for _ in range(150)]
    rows = [(i, x if i % 3 else "".join(c for c in x if rand.random() > 0.15) + "xy"[: rand.randrange(3)]) for i, x in enumerate(rand.choices(names, k=300))]
    df = spark.createDataFrame(rows, "tid int, name string")
    cells = df.where("tid % 3 = 0").selectExpr("tid", "'name' attribute", "name current_value")
    cost, clean = costs.Levenshtein(), sorted({x for i, x in rows if i % 3})
    expected = []
    for i, w in rows:
        priced = sorted((cost.compute(w, v), v) for v in clean) if i % 3 == 0 else []
        if priced and priced[0][0] <= threshold and priced[1][0] > priced[0][0]:
            expected.append((i, "name", w, priced[0][1]))
    left, found = rules.by_nearest(df.where("tid % 3 <> 0"), cells, "tid", ["name"], cost, threshold)
    assert sorted(map(tuple, found.collect())) == expected and left.count() == 100 - len(expected)
    assert len(expected) >= (3 if threshold < 1 else 10)


def flowers(n=300, seed=1):
    """Three kinds that differ in four measures, with as much noise as such tables have."""
    rand = np.random.default_rng(seed)
    y = rand.integers(0, 3, n)
    centre = np.array([[5.0, 3.4, 1.5, 0.2], [5.9, 2.8, 4.3, 1.3], [6.6, 3.0, 5.6, 2.0]])
    return np.round(centre[y] + rand.normal(0, [0.4, 0.3, 0.3, 0.15], (n, 4)), 1), y


def test_boosted_classes_and_numbers():
    x, y = flowers()
    texts = np.empty((len(x), 0), object)
    columns = booster.Columns().fit(x[:200], texts[:200])
    bins = columns.transform(x, texts)
    kinds = booster.Booster(PARAMS, 3).fit(bins[:200], y[:200].astype(float), np.ones(200)).predict(bins[200:])
    assert np.mean(kinds.argmax(axis=1) == y[200:]) >= 0.95 and kinds.sum(axis=1) == pytest.approx(np.ones(100))
    two = booster.Booster(PARAMS, 2).fit(bins[:200], (y[:200] == 0).astype(float), np.ones(200)).predict(bins[200:])
    assert np.mean((two[:, 1] > 0.5) == (y[200:] == 0)) >= 0.97
    columns = booster.Columns().fit(x[:200, :3], y[:200, None].astype(str).astype(object))
    bins = columns.transform(x[:, :3], y[:, None].astype(str).astype(object))
    wide = booster.Booster(PARAMS).fit(bins[:200], x[:200, 3], np.ones(200)).predict(bins[200:])
    assert np.sqrt(np.mean((wide - x[200:, 3]) ** 2)) < 0.23


def test_nulls_and_unknown_values_have_bins():
    numbers, texts = np.array([[1.0], [np.nan], [3.0]]), np.array([["a"], [None], ["b"]], object)
    columns = booster.Columns().fit(numbers, texts)
    bins = columns.transform(np.array([[np.nan], [99.0]]), np.array([["zz"], [None]], object))
    assert bins[0, 0] == 0 and bins[1, 0] == 2 and bins[0, 1:].tolist() == [0, 0, 0, 1] and bins[1, 1:].tolist() == [1, 0, 0, 0]


def test_search_improves_and_ends(monkeypatch):
    x, y = flowers(150, 2)
    texts = np.empty((150, 0), object)
    bins, weak = booster.Columns().fit(x, texts).transform(x, texts), PARAMS | {"n_estimators": 1, "max_depth": 1, "learning_rate": 0.01}
    monkeypatch.setitem(booster.SPACE, "n_estimators", (5, 10))
    ones = np.ones(150)
    best, tried = booster.search(weak, 3, bins, y.astype(float), ones, 6, 3, 0, 50)
    assert tried == 6 and booster.validated(best, 3, bins, y.astype(float), ones, 3, 42) > booster.validated(weak, 3, bins, y.astype(float), ones, 3, 42)
    assert booster.search(weak, 3, bins, y.astype(float), ones, 50, 3, 0, 2)[1] < 50 and booster.search(weak, 3, bins, y.astype(float), ones, 50, 3, 1e-9, 50)[1] == 1


def test_rebalancing_fills_small_classes():
    x, _ = flowers(100, 3)
    y = np.array(["a"] * 60 + ["b"] * 30 + ["c"] * 10)
    texts = np.array([[k, "z"] for k in y], object)
    numbers, words, kinds = booster.rebalance(x, texts, y)
    assert dict(zip(*np.unique(kinds, return_counts=True), strict=True)) == {"a": 30, "b": 30, "c": 30}
    own = kinds == "c"
    assert (words[own, 0] == "c").all() and (numbers[own] >= x[90:].min(axis=0) - 1e-9).all() and (numbers[own] <= x[90:].max(axis=0) + 1e-9).all()
    assert len(np.unique(numbers[own], axis=0)) > 10


def test_counts_of_rebalanced_classes(spark):
    df = spark.range(100).selectExpr("id", "if(id < 10, 'a', if(id < 40, 'b', 'c')) y", "cast(id % 3 as string) z")
    found = models.fit_counting(df.drop("id"), ["y", "z"], {"y": ["z"], "z": ["y"]}, rebalance=True)
    assert {(r["y"], r["class"]): r["n"] for r in found.classes.collect()} == {("y", "a"): 30, ("y", "b"): 30, ("y", "c"): 30, ("z", "0"): 33, ("z", "1"): 33, ("z", "2"): 33}
    assert {round(r["s"], 6) for r in found.pairs.where("set = 0").groupBy("class").agg(F.sum("cnt").alias("s")).collect()} == {30.0}


STATES = ["AL", "AK", "AZ", "AR", "CA", "CO"]


def hospitals(n=600, seed=4):
    """Rows whose columns determine each other in part, and the same with planted errors."""
    rand = random.Random(seed)
    cities = {f"city{i}": (STATES[i % 6], f"9{i:02d}00") for i in range(30)}
    rows = []
    for i in range(n):
        city = rand.choice(sorted(cities))
        state, code = cities[city]
        measure = rand.choice(["heart", "lung", "knee"])
        rows.append([i, city, state, code, measure, f"{measure} {'care' if measure != 'knee' else 'work'}"])
    wrong, cells = [list(r) for r in rows], {}
    for i in rand.sample(range(n), n // 10):
        for c in rand.sample(range(1, 6), rand.choice([1, 1, 1, 2])):
            wrong[i][c] = rand.choice([None, f"{wrong[i][c][:1]}x{wrong[i][c][2:]}{i}"])
            cells[i, c] = rows[i][c]
    return rows, wrong, cells


def told(planted):
    """The planted cells that something in their row tells: not a city without its code, nor a
    measure without its kind."""
    return {(i, c): v for (i, c), v in planted.items() if c == 2 or (i, {1: 3, 3: 1, 4: 5, 5: 4}[c]) not in planted}


NAMES = ["tid", "city", "state", "code", "measure", "kind"]
SCHEMA = "tid int, " + ", ".join(f"{c} string" for c in NAMES[1:])


@pytest.mark.parametrize("engine, least", [("counting", 0.98), ("boosting", 0.88)])
def test_repair_quality_on_planted_errors(spark, engine, least):
    rows, wrong, planted = hospitals()
    df = spark.createDataFrame(wrong, SCHEMA)
    given = spark.createDataFrame([(i, NAMES[c]) for i, c in planted], "tid int, attribute string")
    model = Mender().repair.setInput(df).setRowId("tid").setErrorCells(given).setDiscreteThreshold(100).setParallelStatTrainingEnabled(True).option("model.engine", engine)
    found = {(r["tid"], NAMES.index(r["attribute"])): r["repaired"] for r in model.run().collect()}
    right = sum(found.get(k) == v for k, v in told(planted).items())
    assert right >= least * len(told(planted)) and set(found) <= set(planted)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0


def test_detected_and_repaired_end_to_end(spark):
    """Precision and recall of detection and repair together."""
    rows, wrong, planted = hospitals(seed=7)
    df = spark.createDataFrame(wrong, SCHEMA)
    model = Mender().repair.setInput(df).setRowId("tid").setDiscreteThreshold(100)
    model.setErrorDetectors([d.NullErrorDetector(), *(d.DomainValues(c, autofill=True, min_count_thres=3) for c in NAMES[1:])])
    found = {(r["tid"], NAMES.index(r["attribute"])): r["repaired"] for r in model.run().collect()}
    right = sum(found.get(k) == v for k, v in told(planted).items())
    assert right >= 0.95 * len(told(planted)) and len(set(found) & set(planted)) >= 0.95 * len(found)


def test_predictions_are_chained(spark):
    """b follows from a, and c from b alone: where both are lost, c needs the predicted b."""
    rand = random.Random(2)
    rows = []
    for i in range(400):
        a = rand.randrange(8)
        b = a // 2
        rows.append((i, f"a{a}", f"b{b}", f"c{b // 2 if rand.random() < 0.98 else rand.randrange(2)}"))
    lost = {i for i in range(0, 400, 9)}
    df = spark.createDataFrame([(i, a, None if i in lost else b, None if i in lost else c) for i, a, b, c in rows], "tid int, a string, b string, c string")
    for engine in ("counting", "boosting"):
        model = Mender().repair.setInput(df).setRowId("tid").setErrorDetectors([d.NullErrorDetector()]).option("model.engine", engine)
        found = {(r["tid"], r["attribute"]): r["repaired"] for r in model.run().collect()}
        assert set(found) == {(i, x) for i in lost for x in "bc"}
        assert all(found[i, "b"] == rows[i][2] and found[i, "c"] == f"c{int(rows[i][2][1:]) // 2}" for i in lost)


def test_training_rows_are_bounded_by_the_option(spark):
    df = spark.range(2000).selectExpr("cast(id as int) tid", "cast(id % 5 as double) a", "case when id % 50 = 3 then null else cast(id % 5 as double) end y")
    model = Mender().repair.setInput(df).setRowId("tid").setTargets(["y"]).setErrorDetectors([d.NullErrorDetector()]).option("model.max_training_row_num", "200")
    assert all(abs(float(r["repaired"]) - r["tid"] % 5) < 0.3 for r in model.run().collect())
