import pytest
from helpers import cells
from pyspark.sql import functions as F

from cellmend.api import Mender, RepairMisc
from cellmend.cli import main
from cellmend.functions.text import qgrams, restored, structure
from cellmend.operators import depgraph, misc


@pytest.fixture
def small(spark):
    df = spark.createDataFrame([(str(i), i * 100000, f"test-{i}") for i in range(1, 5)], "tid string, v1 int, v2 string")
    df.createOrReplaceTempView("small")
    return df


def helper(**options):
    return RepairMisc().options({"table_name": "small", "row_id": "tid", **options})


def test_flatten(small):
    found = helper().flatten()
    assert found.columns == ["tid", "attribute", "value"] and dict(found.dtypes)["value"] == "string"
    assert cells(found) == sorted([(str(i), c, v) for i in range(1, 5) for c, v in (("v1", str(i * 100000)), ("v2", f"test-{i}"))])


@pytest.mark.parametrize("q, expected", [(2, ["ab", "bc", "n", "op"]), (3, ["abc", "n", "op"])])
def test_qgrams(spark, q, expected):
    df = spark.createDataFrame([("abc",), ("n",), ("op",), (None,)], "x string")
    assert sorted(g for r in df.select(qgrams(F.col("x"), q).alias("g")).collect() for g in r["g"]) == expected
    with pytest.raises(ValueError, match="`q` must be positive, not 0"):
        qgrams(F.col("x"), 0)


def test_split(small):
    for algorithm in ("bisect-kmeans", "kmeans++"):
        found = helper(k="2", clustering_alg=algorithm).splitInputTable()
        assert found.columns == ["tid", "k"] and {r["k"] for r in found.collect()} == {0, 1}
    with pytest.raises(ValueError, match="No clustering of the name"):
        helper(k="2", clustering_alg="none").splitInputTable()
    with pytest.raises(ValueError, match="is an integer, not"):
        helper(k="x").splitInputTable()
    with pytest.raises(ValueError, match="has no column"):
        helper(k="2", target_attr_list="nowhere").splitInputTable()


def test_inject_null(small):
    assert {r["v1"] for r in helper(target_attr_list="v1", null_ratio="1.0").injectNull().collect()} == {None}
    with pytest.raises(ValueError, match="null_ratio"):
        helper(target_attr_list="v1", null_ratio="0.0").injectNull()
    twice = [cells(misc.inject_null(small, ["v2"], 0.5, seed=3)) for _ in range(2)]
    assert twice[0] == twice[1]


def test_describe(spark):
    spark.range(100).selectExpr("STRING(id)", "id % 9 v1", "DOUBLE(id % 17) v2").createOrReplaceTempView("small")
    rows = {r["attrName"]: r.asDict() for r in helper(num_bins="8").describe().collect()}
    assert rows["id"] == {"attrName": "id", "distinctCnt": rows["id"]["distinctCnt"], "min": None, "max": None, "nullCnt": 0, "avgLen": 2, "maxLen": 2, "hist": None}
    assert rows["v1"]["hist"] == [0.125] * 8 == rows["v2"]["hist"]
    assert (rows["v2"]["min"], rows["v2"]["max"], rows["v1"]["distinctCnt"], rows["v1"]["avgLen"]) == ("0.0", "16.0", 9, 8)


def test_histogram_and_error_map(spark):
    coats = ["red", "blue", "red", "red", "green", "blue"]
    df = spark.createDataFrame([(i, c, i * 7) for i, c in enumerate(coats)], "tid int, coat string, size bigint")
    df.createOrReplaceTempView("small")
    found = {r["attribute"]: {tuple(x) for x in r["histogram"]} for r in helper(targets="coat,size").toHistogram().collect()}
    assert found == {"coat": {(c, coats.count(c)) for c in coats}}
    assert helper(targets="size").toHistogram().collect() == []
    marks = [(0, "coat"), (2, "size"), (2, "size"), (5, "coat"), (5, "size")]
    wrong = spark.createDataFrame(marks, "tid int, attribute string")
    assert cells(misc.error_map(df, wrong, "tid")) == [(i, "".join("*" if (i, c) in marks else "-" for c in ("coat", "size"))) for i in range(6)]


def test_updates(spark):
    df = spark.createDataFrame([(7, 10, "oak", 0.5), (8, None, "elm", 1.5), (9, 30, "ash", None)], "tid int, age int, tree string, girth double")
    updates = spark.createDataFrame([(7, "age", "11.4"), (8, "age", "19.6"), (8, "tree", "yew"), (9, "tree", None), (9, "girth", "2.25")], "tid int, attribute string, repaired string")
    assert cells(misc.apply_updates(updates, df, "tid")) == [(7, 11, "oak", 0.5), (8, 20, "yew", 1.5), (9, 30, None, 2.25)]
    with pytest.raises(Exception, match="(?i)duplicat"):
        misc.apply_updates(updates.union(updates), df, "tid").collect()


def test_regex_structure(spark):
    assert structure("^[0-9]{1,3} patients$") == [("edge", "^"), ("range", "[0-9]{1,3}"), ("constant", " patients"), ("edge", "$")]
    cases = [("^[0-9]{1,3} patients$", [("32 patixxts", "32 patients"), ("619 paxienxs", "619 patients"), ("x2 patixxts", None), (None, None)]), ("^[0-9]{1,3}%", [("33x", "33%"), ("x2%", None)]), ("^[0-9]{2}-[0-9]{2}-[0-9]{2}-[0-9]{2}$", [("23.39.23.11", "23-39-23-11"), ("23.x9.2x.1x", None)]), ("^(no|structure)$", [("no", None)])]
    for regex, pairs in cases:
        df = spark.createDataFrame([(a, b) for a, b in pairs], "x string, y string")
        assert [r["z"] for r in df.select("y", restored(F.col("x"), regex).alias("z")).collect()] == [b for _, b in pairs]


def graph_input(spark):
    towns = {"Oslo": "no", "Bergen": "no", "Turku": "fi", "Malmo": "se"}
    return spark.createDataFrame([(i, town, towns[town], str(i % 2)) for i, town in enumerate(["Oslo", "Bergen", "Turku", "Malmo"] * 3)], "tid int, town string, land string, odd string")


def test_dependency_graph(spark, tmp_path):
    df = graph_input(spark)
    assert set(depgraph.dependent_pairs(df, ["town", "land"], 8, 1.0)) == {("town", "land")}
    text = depgraph.dependency_graph(df, ["tid", "town", "land", "odd"], 8, 100, 100, 100.0)
    assert text.count("subgraph") == 3 and text.startswith("digraph") and text.count("{") == text.count("}")
    drawn = depgraph.dependency_graph(df, ["town", "land"], edge_label=True)
    assert drawn.count(" -> ") - 1 == 4 and 'label="3 of 3"' in drawn and 'label="Malmo"' in drawn
    assert "more values" in depgraph.dependency_graph(df, ["town", "land"], max_attr_value_num=1)
    assert 'label="Ber..."' in depgraph.dependency_graph(df, ["town", "land"], max_attr_value_length=3)
    with pytest.raises(ValueError, match="needs two columns"):
        depgraph.dependency_graph(df, ["town"])
    noise = spark.range(64).selectExpr("cast(id % 8 as string) x", "cast(id div 8 as string) y")
    with pytest.raises(ValueError, match="depend on each other"):
        depgraph.dependency_graph(noise, ["x", "y"], threshold=0.1)
    df.createOrReplaceTempView("small")
    options = {"path": str(tmp_path / "d"), "filename_prefix": "g", "target_attr_list": "town,land,odd"}
    helper(**options).generateDepGraph()
    assert (tmp_path / "d" / "g.dot").read_text().startswith("digraph")
    with pytest.raises(ValueError, match="is there already"):
        helper(**options).generateDepGraph()
    helper(**options, overwrite="true").generateDepGraph()
    with pytest.raises(ValueError, match="image format must be"):
        helper(**options, image_format="bmp").generateDepGraph()


def test_required_options():
    with pytest.raises(ValueError, match="options are needed: table_name, row_id"):
        RepairMisc().flatten()
    assert Mender() is Mender.getOrCreate() and Mender.version() and Mender().repair is not Mender().repair


def test_batch_job(spark, people):
    people.write.mode("overwrite").saveAsTable("people_in")
    args = ["--input", "people_in", "--row-id", "tid", "--output", "people_out"]
    assert main(args) == "people_out"
    assert main(args).startswith("people_out_")
    out = spark.table("people_out")
    assert out.count() == 20 and out.where("age is null or sex is null or income is null").count() == 0
