import math
from collections import Counter

import pytest
from helpers import cells

from cellmend.operators import domains, stats

ROWS = [(i, "ABCA"[i % 4], f"{i * i % 5} of {i % 2}") for i in range(30)]


def counted(*columns):
    return Counter(tuple(r[c] for c in columns) for r in ROWS)


@pytest.mark.parametrize("x, y", [("grade", "label"), ("a grade", "a label")])
def test_frequencies(spark, x, y):
    df = spark.createDataFrame(ROWS, ["row", x, y])
    expected = [(v, 0, None, 1, n) for (v,), n in counted(1).items()] + [(None, 1, v, 0, n) for (v,), n in counted(2).items()] + [(v, 0, w, 0, n) for (v, w), n in counted(1, 2).items()]
    assert cells(stats.freq_stats(df, [[x], [y], [x, y]])) == sorted(expected, key=repr)
    assert cells(stats.freq_stats(df, [[x], [y], [x, y]], 0.2)) == sorted((r for r in expected if r[-1] > 6), key=repr)
    with pytest.raises(ValueError, match=f"Sets have one or two columns, not row,{x},{y}"):
        stats.freq_stats(df, [["row", x, y]])


def test_long_counts_agree_with_grouping_sets(spark):
    df = spark.createDataFrame(ROWS, ["row", "x", "y"])
    long = {(r["set"], r["v0"], r["v1"]): r["cnt"] for r in stats.long_counts(df, [("x", "y"), ("x",)]).collect()}
    wide = {(0, r["x"], r["y"]) if r["__generated_freq_group_y"] == 0 else (1, r["x"], None): r["cnt"] for r in stats.freq_stats(df, [["x", "y"], ["x"]]).collect()}
    assert long == wide


def test_entropy_of_unseen_groups():
    h = lambda domain: stats._entropy(1000, (0.0, 0, 0), domain)
    assert h(8) == pytest.approx(3) and h(4) == pytest.approx(2) and h(2) == pytest.approx(1)


def test_conditional_entropies(spark):
    df = spark.createDataFrame(ROWS, ["row", "x", "y"])
    sizes = stats.distinct_counts(df, ["x", "y"])
    assert sizes == {"x": len(counted(1)), "y": len(counted(2))} == stats.distinct_counts(df, ["x", "y"], approx=True)
    h = lambda *columns: -sum(n / 30 * math.log2(n / 30) for n in counted(*columns).values())
    found = stats.conditional_entropies(df, [("x", "y"), ("y", "x")], sizes)
    assert found["x"][0][1] == pytest.approx(h(1, 2) - h(2), abs=1e-9) and found["y"][0][1] == pytest.approx(h(1, 2) - h(1), abs=1e-9)


def test_discretize(spark):
    df = spark.createDataFrame([(1, "a", 0.0, 5, None), (2, "b", 10.0, 5, None), (3, "a", 5.0, 5, None)], "tid int, x string, v double, same int, none double")
    out, sizes = stats.discretize(df, "tid", 4)
    assert cells(out) == [(1, "a", 0, None, None), (2, "b", 4, None, None), (3, "a", 2, None, None)]
    assert sizes == {"x": 2, "v": 3, "same": 1, "none": 0}
    assert stats.discretize(df, "tid", 1)[0].columns == ["tid", "v", "same", "none"]


def test_candidate_pairs(spark):
    df = spark.createDataFrame([(str(i % 2), str(i % 2), str(i % 7), str(i % 5)) for i in range(70)], ["a", "b", "c", "d"])
    sizes = stats.distinct_counts(df, df.columns)
    assert stats.candidate_pairs(df, ["a"], sizes, 0.9, 2) == [("a", "b")]
    assert stats.candidate_pairs(df, ["a"], sizes, 0.0, 3) == [("a", "b"), ("a", "c"), ("a", "d")]


def domain_input(spark):
    wrong = [(1, "x", "B"), (3, "y", "?"), (8, "y", ROWS[8][2])]
    return spark.createDataFrame(ROWS, ["tid", "x", "y"]), spark.createDataFrame(wrong, ["tid", "attribute", "current_value"])


def test_cell_domains(spark):
    """Candidates weigh one less than the rows in which they go with the partner's value, a tenth at
    least."""
    df, wrong = domain_input(spark)
    found = domains.cell_domains(df, wrong, "tid", {"x": ["y"], "y": ["x"]}, {"x": len(counted(1)), "y": len(counted(2))}, beta=0.05)
    for r in found.collect():
        own, other = (1, 2) if r["attribute"] == "x" else (2, 1)
        weights = {row[0]: max(n - 1.0, 0.1) for row, n in ((((k[0],), n) if k[1] == ROWS[r["tid"]][other] else ((None,), 0)) for k, n in counted(own, other).items()) if n}
        expected = {v: w / sum(weights.values()) for v, w in weights.items()}
        assert {x["n"]: x["prob"] for x in r["domain"]} == pytest.approx({v: q for v, q in expected.items() if q > 0.05})
    alone = spark.createDataFrame([(1, "x", ROWS[1][1])], ["tid", "attribute", "current_value"])
    most = domains.cell_domains(df, alone, "tid", {"x": ["y"]}, {"x": 3, "y": 9}, beta=0.05)
    best = max(most.first()["domain"], key=lambda x: x["prob"])["n"]
    assert cells(domains.weak_labels(most, "tid")) == ([(1, "x")] if best == ROWS[1][1] else [])


def test_domains_of_continuous_columns_are_empty(spark):
    df, wrong = domain_input(spark)
    found = domains.cell_domains(df, wrong, "tid", {"x": ["y"]}, {"x": 3, "y": 4}, continuous=["x"])
    assert all(r["domain"] == [] for r in found.collect()) and found.count() == 3


def test_a_gap_empties_earlier_candidates(spark):
    df = spark.createDataFrame([(1, "a", "p", None), (2, "a", "p", "s")], "tid int, x string, y string, z string")
    wrong = spark.createDataFrame([(1, "x", "a")], "tid int, attribute string, current_value string")
    sizes = {"x": 1, "y": 1, "z": 1}
    of = lambda **k: domains.cell_domains(df, wrong, "tid", {"x": ["y", "z"]}, sizes, beta=0.01, **k).first()["domain"]
    assert of() == [] and [x["n"] for x in of(chained=False)] == ["a"]


def test_base_and_split(spark):
    df = spark.createDataFrame([(1, 1, "a", 0.5), (2, 2, "b", 1.5), (3, 3, "c", 2.5)], "tid int, c0 int, c1 string, c2 double")
    wrong = spark.createDataFrame([(1, "c0"), (1, "c2"), (3, "c1"), (3, "other")], "tid int, attribute string")
    assert cells(domains.repair_base(df, wrong, "tid", ["c0", "c1", "c2"])) == [(1, None, "a", None), (2, 2, "b", 1.5), (3, 3, None, 2.5)]
    clean, dirty = domains.split_rows(df, wrong, "tid")
    assert cells(clean, "tid") == [(2,)] and cells(dirty, "tid") == [(1,), (3,)]
    assert cells(domains.of_columns(wrong, ["c0"], negate=True)) == [(1, "c2"), (3, "c1"), (3, "other")]
