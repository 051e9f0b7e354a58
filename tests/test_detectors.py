import numpy as np
import pytest
from helpers import cells

from cellmend.operators import detectors as d
from cellmend.sources.tables import check_input, continuous_columns


def found(df, detector, row_id="tid", targets=None):
    detector.setUp(row_id, df, continuous_columns(df, row_id), targets or [c for c in df.columns if c != row_id])
    return cells(detector.detect())


def test_nulls(spark, people):
    assert found(people, d.NullErrorDetector()) == sorted([(5, "age"), (12, "age"), (3, "sex"), (7, "sex"), (12, "sex"), (16, "income")], key=repr)
    assert found(people, d.NullErrorDetector(), targets=["age"]) == [(12, "age"), (5, "age")]


def test_domain_values(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "ba", 1.0), (3, None, 9.0), (4, "a+", 1.0)], "tid int, x string, v double")
    assert found(df, d.DomainValues("x", ["a"])) == [(2, "x"), (3, "x"), (4, "x")]
    assert found(df, d.DomainValues("x", ["a"], match="regex")) == [(3, "x")]
    assert found(df, d.DomainValues("x", [])) == [(1, "x"), (2, "x"), (3, "x"), (4, "x")]
    assert found(df, d.DomainValues("v", ["1.0"])) == []
    many = spark.createDataFrame([(i, "a" if i < 6 else "b" if i < 9 else None) for i in range(10)], "tid int, x string")
    assert found(many, d.DomainValues("x", autofill=True, min_count_thres=4)) == [(6, "x"), (7, "x"), (8, "x"), (9, "x")]


def test_regex_of_numbers(spark):
    df = spark.createDataFrame([(1, 12), (2, 123), (3, 1234), (4, 12345), (5, None)], "tid int, v int")
    assert found(df, d.RegExErrorDetector("v", "123.+")) == [(1, "v"), (2, "v"), (5, "v")]
    assert found(df, d.RegExErrorDetector("v", " ")) == []
    assert found(df, d.RegExErrorDetector("v", r"^\d{3}$")) == [(1, "v"), (3, "v"), (4, "v"), (5, "v")]


def test_dependency_violations(spark):
    rows = [("1", 1, "a"), ("2", 1, "a"), ("3", 1, None), ("4", 2, "b"), ("5", 2, "c"), ("6", 3, "d"), ("7", 4, "e"), ("8", 4, "e")]
    df = spark.createDataFrame(rows, "tid string, v1 int, v2 string")
    detector = d.ConstraintErrorDetector(constraints="t1&t2&EQ(t1.v1,t2.v1)&IQ(t1.v2,t2.v2)")
    assert found(df, detector) == sorted([(str(i), c) for i in range(1, 6) for c in ("v1", "v2")], key=repr)
    assert found(df, detector, targets=["v2", "v3"]) == [(str(i), "v2") for i in range(1, 6)]
    with pytest.raises(ValueError, match="is needed"):
        d.ConstraintErrorDetector()


def test_constraint_file(spark, tmp_path, people):
    path = tmp_path / "constraints.txt"
    path.write_text('t1&EQ(t1.sex,"Female")&EQ(t1.relation,"Husband")\n\nt1&EQ(t1.sex,"Male")&EQ(t1.relation,"Wife")\n')
    expected = [(r.tid, c) for r in people.collect() if r.sex == "Female" and r.relation == "Husband" for c in ("relation", "sex")]
    assert found(people, d.ConstraintErrorDetector(str(path))) == sorted(expected, key=repr)
    assert found(people, d.ConstraintErrorDetector(str(path) + ".missing")) == []


@pytest.mark.parametrize("approx", [False, True])
def test_outliers(spark, approx):
    df = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 1.0), (4, 1000.0), (5, None)], "tid int, v double")
    assert found(df, d.GaussianOutlierErrorDetector(approx)) == [(4, "v")]
    level = spark.createDataFrame([(i, 100.0 if i < 1000 else 0.0) for i in range(1001)], "tid int, v double")
    assert found(level, d.GaussianOutlierErrorDetector(approx)) == [(1000, "v")]


@pytest.mark.parametrize("threshold", [10000, 1000])
def test_local_outliers(spark, threshold):
    df = spark.range(3000).selectExpr("id", "id % 2 v1", "id % 3 v2").union(spark.createDataFrame([(1000000, 1, 1000), (1000001, 1000, 1), (1000002, None, None)], "id long, v1 long, v2 long"))
    assert found(df, d.LOFOutlierErrorDetector(threshold, 2), "id") == [(1000000, "v2"), (1000001, "v1")]


def test_fitted_by_the_user(spark):
    class Beyond:
        def fit_predict(self, x):
            return np.where(x.ravel() > 10, -1, 1)

    df = spark.createDataFrame([(1, 1.0), (2, 11.0), (3, None)], "tid int, v double")
    assert found(df, d.ScikitLearnBackedErrorDetector(Beyond)) == [(2, "v")]
    with pytest.raises(ValueError, match="callable"):
        d.ScikitLearnBackedErrorDetector(1)
    with pytest.raises(ValueError, match="fit_predict"):
        d.ScikitLearnBackedErrorDetector(dict)
    with pytest.raises(ValueError, match="positive"):
        d.LOFOutlierErrorDetector(num_parallelism=0)


@pytest.mark.parametrize("most", [10_000, 1])
def test_default_detectors(spark, people, monkeypatch, most):
    monkeypatch.setattr(d, "MOST_VALUES", most)
    columns = [c for c in people.columns if c != "tid"]
    expected = set()
    for c in columns:
        values = [r[c] for r in people.collect()]
        expected |= {(r["tid"], c) for r in people.collect() if r[c] is None or values.count(r[c]) <= 4}
    assert set(cells(d.detect_all(people, "tid", d.default_detectors(columns), [], columns), "tid", "attribute")) == expected


def test_row_wise_detectors_share_a_scan(spark, people):
    found = d.detect_all(people, "tid", [d.NullErrorDetector(), d.RegExErrorDetector("sex", "^Male$"), d.DomainValues("age", [">50"])], [], ["age", "sex"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate inline") == 1 and "Union" not in plan
    assert found.count() == found.distinct().count()


def test_odd_names(spark):
    df = spark.createDataFrame([(1, None, "a.b"), (2, "x", None)], "`t i d` int, `x x` string, `y.y` string")
    assert found(df, d.NullErrorDetector(), "t i d") == [(1, "x x"), (2, "y.y")]
    assert found(df, d.DomainValues("y.y", ["a.b"]), "t i d") == [(2, "y.y")]
    assert cells(d.with_current_values(df, d.flagged(df, "t i d", [("x x", d.col("x x").isNotNull())]), "t i d")) == [(2, "x x", "x")]


def test_input_checks(spark):
    df = spark.createDataFrame([(1, 2, "a"), (1, 3, "b")], "tid int, x int, y string")
    with pytest.raises(ValueError, match="Row ids must be unique"):
        check_input(df, "tid")
    assert check_input(df, "x") == ["tid"]
    with pytest.raises(ValueError, match="needs two columns besides"):
        check_input(df.select("x", "y"), "x")
    with pytest.raises(ValueError, match="can't be repaired: d:date"):
        check_input(df.selectExpr("x", "y", "current_date() as d"), "x")
    with pytest.raises(ValueError, match="has no column 'z'"):
        check_input(df, "z")
