import pytest
from helpers import cells

from cellmend.api import Mender
from cellmend.functions.costs import Levenshtein, UserDefinedUpdateCostFunction
from cellmend.operators import detectors as d
from cellmend.operators import models, rules


def model(df, row_id="tid"):
    return Mender().repair.setInput(df).setRowId(row_id)


def nulls(df):
    return model(df).setErrorDetectors([d.NullErrorDetector()])


def test_updates_and_table(spark, people):
    found = nulls(people).run()
    assert found.columns == ["tid", "attribute", "current_value", "repaired"]
    assert {(r["tid"], r["attribute"]) for r in found.collect()} == {(5, "age"), (12, "age"), (3, "sex"), (7, "sex"), (12, "sex"), (16, "income")}
    assert all(r["repaired"] for r in found.collect())
    whole = nulls(people).run(repair_data=True)
    assert whole.columns == people.columns and whole.count() == 20
    assert whole.where("age is null or sex is null or income is null").count() == 0
    given = {r["tid"]: r["age"] for r in people.collect()}
    assert all(r["age"] == given[r["tid"]] for r in whole.collect() if given[r["tid"]])


def test_probabilities(spark, people):
    pmf = nulls(people).run(compute_repair_candidate_prob=True)
    assert pmf.columns == ["tid", "attribute", "current_value", "pmf"]
    for r in pmf.collect():
        probs = [x["prob"] for x in r["pmf"]]
        assert probs == sorted(probs, reverse=True) and sum(probs) == pytest.approx(1)
    best = nulls(people).run(compute_repair_prob=True)
    assert best.columns == ["tid", "attribute", "current_value", "repaired", "prob"] and best.count() == 6
    few = nulls(people).option("repair.pmf.prob_top_k", "3").option("repair.pmf.prob_threshold", "0.2").run(compute_repair_candidate_prob=True)
    assert all(len(r["pmf"]) <= 3 and all(x["prob"] > 0.2 for x in r["pmf"]) for r in few.collect())


def test_scores_and_likelihood(spark, people):
    given = spark.createDataFrame([(i, "sex") for i in range(7)], "tid int, attribute string")
    scored = model(people).setErrorCells(given).setUpdateCostFunction(Levenshtein())
    found = scored.run(compute_repair_score=True)
    assert found.columns == ["tid", "attribute", "current_value", "repaired", "score"] and found.count() == 7
    best = scored.setRepairDelta(3).run(maximal_likelihood_repair=True)
    scores = sorted((r["score"] for r in found.collect()), reverse=True)
    assert best.count() == sum(s >= scores[2] for s in scores) and best.columns == found.columns[:4]
    whole = scored.run(maximal_likelihood_repair=True, repair_data=True)
    assert whole.count() == 20 and whole.columns == people.columns


def test_detection_only_and_clean_input(spark, people):
    assert model(people).run(detect_errors_only=True).columns == ["tid", "attribute", "current_value"]
    clean = people.na.drop()
    assert model(clean).setErrorDetectors([d.NullErrorDetector()]).run().count() == 0
    assert model(clean).setErrorDetectors([d.NullErrorDetector()]).run(repair_data=True).count() == clean.count()


def test_functional_dependencies(spark):
    towns = ["Bath", "York", "Bath", "York", "Ely", "Bath", "York"]
    county = {"Bath": "Somerset", "York": "Yorkshire"}
    df = spark.createDataFrame([(i, t, county.get(t) if i < 4 else None) for i, t in enumerate(towns)], "tid int, town string, county string")
    given = spark.createDataFrame([(i, "county") for i in (4, 5, 6)], "tid int, attribute string")
    found = model(df).setErrorCells(given).setErrorDetectors([d.NullErrorDetector(), d.ConstraintErrorDetector(constraints="town->county")]).setRepairByRules(True).option("model.rule.max_domain_size", "1000").run()
    assert cells(found) == [(i, "county", None, county.get(towns[i])) for i in (4, 5, 6)]
    mixed = spark.createDataFrame([(0, "Bath", "Somerset"), (1, "Newport", "Gwent"), (2, "Newport", "Shropshire"), (3, None, "Kent"), (4, "Ely", None)], "tid int, town string, county string")
    assert cells(rules.dependency_values(mixed, "town", "county")) == [("Bath", "Somerset")]


def nearest(spark):
    rows = [(0, "copper", 1200, "m"), (1, "silver", 44, "n"), (2, "coper", 1, "m"), (3, "sliver", 2, "n"), (4, "iron", 1290, "m"), (5, "gopper", 450, "n")]
    df = spark.createDataFrame(rows, "tid int, metal string, weight bigint, mark string")
    given = spark.createDataFrame([(2, "metal"), (3, "metal"), (4, "metal"), (5, "metal"), (4, "weight"), (5, "weight"), (5, "mark")], "tid int, attribute string")
    return model(df).setErrorCells(given).setRepairByRules(True).setUpdateCostFunction(Levenshtein(targets=["metal", "weight"])).option("model.rule.repair_by_nearest_values.disabled", "").option("model.rule.merge_threshold", "2.0")


def test_nearest_values(spark):
    # Iron is far from both metals; 1290 is near 1200, and 450 near 44 and nothing else.
    expected = [(2, "metal", "coper", "copper"), (3, "metal", "sliver", "silver"), (4, "weight", "1290", "1200"), (5, "metal", "gopper", "copper"), (5, "weight", "450", "44")]
    found = {(r[0], r[1]): r[3] for r in cells(nearest(spark).setTargets(["metal", "weight"]).run())}
    assert all(found[i, a] == new for i, a, _, new in expected)
    assert (5, "mark") in {(r[0], r[1]) for r in cells(nearest(spark).run())}
    with pytest.raises(ValueError, match="neither probabilities nor scores"):
        nearest(spark).run(compute_repair_prob=True)


def test_regex_rules(spark):
    df = spark.createDataFrame([(1, "32 patients", "a"), (2, "12 patixxts", "b"), (3, "45 patients", "a"), (4, "yy", "b")], "tid int, x string, y string")
    found = model(df).setErrorDetectors([d.RegExErrorDetector("x", "^[0-9]{1,3} patients$")]).setTargets(["x"]).setRepairByRules(True).option("model.rule.repair_by_regex.disabled", "").run()
    assert (2, "x", "12 patixxts", "12 patients") in cells(found)


@pytest.mark.parametrize("kind, limit", [("byte", 127), ("short", 300), ("int", 300), ("long", 300)])
def test_integers_are_rounded(spark, kind, limit):
    df = spark.createDataFrame([(i, i % 3, None if i == 5 else (i % 3) * 10) for i in range(12)], f"tid int, x {kind}, y {kind}")
    found = model(df).setErrorDetectors([d.NullErrorDetector()]).option("model.lgb.n_estimators", "10").run().collect()
    assert [(r["tid"], r["attribute"]) for r in found] == [(5, "y")] and abs(int(found[0]["repaired"]) - 20) <= 5


def test_regression_quality(spark):
    df = spark.range(300).selectExpr("cast(id as int) tid", "cast(id % 10 as double) a", "cast(id % 7 as double) b", "case when id % 11 = 0 then null else cast((id % 10) * 2 + (id % 7) as double) end y")
    found = model(df).setErrorDetectors([d.NullErrorDetector()]).setTargets(["y"]).run()
    error = found.join(spark.range(300).selectExpr("cast(id as int) tid", "(id % 10) * 2.0 + (id % 7) t"), "tid").selectExpr("sqrt(avg(pow(cast(repaired as double) - t, 2)))").first()[0]
    assert error < 1.0
    pmf = model(df).setErrorDetectors([d.NullErrorDetector()]).setTargets(["y"]).run(compute_repair_candidate_prob=True).collect()
    assert all(len(r["pmf"]) == 1 and r["pmf"][0]["prob"] == 1.0 for r in pmf)


def test_forest_and_rebalancing(spark, people):
    found = nulls(people).option("model.engine", "boosting").option("model.lgb.n_estimators", "5").setParallelStatTrainingEnabled(True).setTrainingDataRebalancingEnabled(True).run(compute_repair_prob=True)
    assert found.count() == 6 and found.where("repaired is null").count() == 0
    assert models.class_deviation(spark.range(6).selectExpr("if(id < 2, 'a', 'b') x"), "x") == 1.0


def test_searched_depth(spark):
    df = spark.range(60).selectExpr("cast(id as int) tid", "cast(id % 5 as string) a", "case when id % 7 = 3 then null else cast(id % 5 as double) end y")
    assert model(df).setErrorDetectors([d.NullErrorDetector()]).setTargets(["y"]).option("model.hp.max_evals", "2").option("model.lgb.n_estimators", "3").run().count() == 9


def test_costs():
    f = Levenshtein()
    assert f.compute("111", "123") == 2.0 and f.compute(1.11, "1.23") == 2.0
    assert f.compute(None, "a") is None and f.compute("", "a") is None and f.compute(0, 1) is None
    own = UserDefinedUpdateCostFunction(lambda x, y: 1 / (len(str(x)) - len(str(y))) if x != "x" else 1.0)
    assert own.compute("ab", "cd") is None and own.compute("abc", "d") == 0.5
    for bad in (lambda x, y: 1, lambda x: 1.0):
        with pytest.raises(ValueError, match="`f` must make a float of two values"):
            UserDefinedUpdateCostFunction(bad)


def test_weighting_applies_to_its_targets(spark, people):
    from cellmend.plans.repair import weighted_pmf

    pmf = spark.createDataFrame([(1, "a", "x", [("x", 0.5), ("yyyy", 0.5)]), (2, "b", "x", [("x", 0.5), ("yyyy", 0.5)]), (3, "a", None, [("x", 1.0)])], "tid int, attribute string, current_value string, pmf array<struct<class: string, prob: double>>")
    found = {r["tid"]: [round(x["prob"], 4) for x in r["pmf"]] for r in weighted_pmf(pmf, "tid", Levenshtein(targets=["a"]), 0.1).collect()}
    assert found == {1: [round(1 / (1 + 1 / 1.4), 4), round(1 / 1.4 / (1 + 1 / 1.4), 4)], 2: [0.5, 0.5], 3: [1.0]}


def test_arguments(spark, people):
    with pytest.raises(ValueError, match="needs `setInput` and `setRowId`"):
        Mender().repair.run()
    for call, kind in ((lambda m: m.setRowId(1), TypeError), (lambda m: m.setTargets("a"), TypeError), (lambda m: m.setDiscreteThreshold(1), ValueError), (lambda m: m.setRepairDelta(0), ValueError), (lambda m: m.option("no.such.key", "1"), ValueError), (lambda m: m.setErrorDetectors([1]), TypeError), (lambda m: m.setUpdateCostFunction(1), TypeError)):
        with pytest.raises(kind):
            call(model(people))
    with pytest.raises(ValueError, match="Error cells need `setRowId` first"):
        Mender().repair.setErrorCells("x")
    with pytest.raises(ValueError, match="one mode, not detect_errors_only and repair_data"):
        model(people).run(detect_errors_only=True, repair_data=True)
    with pytest.raises(ValueError, match="setRepairDelta"):
        model(people).run(maximal_likelihood_repair=True)
    with pytest.raises(ValueError, match="not of `targets` only"):
        model(people).setRepairDelta(1).setUpdateCostFunction(Levenshtein(targets=["age"])).run(maximal_likelihood_repair=True)
    with pytest.raises(ValueError, match="has none of the targets"):
        model(people).setTargets(["nothing"]).run()
    with pytest.raises(ValueError, match="must be in"):
        model(people).option("error.domain_threshold_beta", "7").run()
    with pytest.raises(ValueError, match="None of the columns with errors can be repaired"):
        model(spark.createDataFrame([(1, "a", None), (2, "a", None)], "tid int, x string, y string")).run()


def test_a_single_discrete_column(spark):
    df = spark.createDataFrame([(i, str(i), None if i == 3 else "ab"[i % 5 == 0]) for i in range(200)], "tid int, x string, y string")
    assert cells(nulls(df).run()) == [(3, "y", None, "a")]


def test_prediction_order():
    assert models.dependency_order(["a"], {"b": "a", "c": "b"}) == ["a", "b", "c"]
    assert set(models.dependency_order([], {"b": "c", "c": "b"})) == {"b", "c"}
    assert models.select_features("y", ["x", "y", "z", "w"], [("z", 0.1), ("w", 0.2), ("x", 0.3)], 1) == ["z", "w"]


def test_odd_names(spark):
    df = spark.createDataFrame([(i, str(i % 2), None if i == 3 else f"v{i % 2}") for i in range(12)], "`t i d` int, `x x` string, `y.y` string")
    assert cells(model(df, "t i d").setErrorDetectors([d.NullErrorDetector()]).run()) == [(3, "y.y", None, "v1")]


def test_streams(spark, tmp_path):
    from cellmend.streaming.detect import detect_stream, error_rates, fitted_flags, repair_stream

    batch = spark.createDataFrame([(i, "a" if i % 2 else "b", 1.0 + i % 3) for i in range(20)], "tid int, x string, v double")
    flags = fitted_flags(batch, "tid", [d.NullErrorDetector(), d.DomainValues("x", autofill=True, min_count_thres=4), d.GaussianOutlierErrorDetector()], ["v"], ["x", "v"])
    spark.createDataFrame([(1, "a", 1.0, 0), (2, "zzz", 2.0, 0), (3, None, 999.0, 700)], "tid int, x string, v double, t int").selectExpr("tid", "x", "v", "timestamp_seconds(t) ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("tid int, x string, v double, ts timestamp").parquet(str(tmp_path / "in"))

    def run(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        return cells(spark.table(name))

    assert run(detect_stream(stream, "tid", flags), "found") == [(2, "x"), (3, "v"), (3, "x")]
    counts = run(error_rates(stream, "ts", flags).select("rows", "errors_x", "errors_v"), "rates", "complete")
    assert counts == [(1, 1, 1), (2, 1, 0)]
    values = rules.dependency_values(spark.createDataFrame([(1, 999.0, "big")], "tid int, v double, x string"), "v", "x")
    fixed = run(repair_stream(stream, {"x": models.FunctionalDepModel("v", values)}).select("tid", "x"), "fixed")
    assert fixed == [(1, "a"), (2, "zzz"), (3, "big")]
