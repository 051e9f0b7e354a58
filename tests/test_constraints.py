import pytest
from helpers import cells
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cellmend.plans import constraints as dc


def test_forms():
    two = dc.parse(" t1 & t2 & EQ( t1.x , t2.x ) & IQ(t1.y,t2.y) ")
    assert [(p.sign, p.left, p.right, p.constant) for p in two.predicates] == [("EQ", "x", "x", False), ("IQ", "y", "y", False)]
    one = dc.parse('t1&EQ(t1.sex,"Female")&LT(t1.age,5)')
    assert one.one_tuple and one.references == ["sex", "age"] and one.predicates[1].right == "5"
    assert dc.parse("x->y") == dc.parse("t1&t2&EQ(t1.x,t2.x)&IQ(t1.y,t2.y)")


@pytest.mark.parametrize("text", ["", "x", "t1&t2&EQ(t1.x,t2.x)", "t1&t2&XX(t1.x,t2.x)&EQ(t1.y,t2.y)", "t1&EQ(t1.a,t1.b)&EQ(t1.a,1)", "t1&t2&EQ(t1.x,5)&EQ(t1.y,t2.y)", "t1&t1&EQ(t1.x,t1.x)&EQ(t1.y,t1.y)"])
def test_not_of_the_language(text, caplog):
    with pytest.raises(dc.ConstraintError):
        dc.parse(text)
    assert dc.load([text], "xy") == []
    assert "Not a constraint" in caplog.text


def test_unknown_columns_warn(caplog):
    assert dc.load(["x->z"], "xy") == []
    assert "has no such columns" in caplog.text


def test_dependencies():
    found = dc.functional_dependencies(dc.load(["x->y", "z->y", "y->x", "t1&EQ(t1.x,1)&IQ(t1.y,2)", "t1&t2&EQ(t1.x,t2.z)&IQ(t1.y,t2.y)"], "xyz"), "xy")
    assert found == {"y": ["x", "z"]}


SHAPES = [
    "k->a",
    "t1&t2&EQ(t1.k,t2.k)&EQ(t1.a,t2.a)&IQ(t1.b,t2.b)",
    "t1&t2&EQ(t1.k,t2.k)&LT(t1.a,t2.a)",
    "t1&t2&EQ(t1.k,t2.k)&GT(t1.a,t2.b)",
    "t1&t2&EQ(t1.k,t2.k)&LT(t1.a,t2.a)&GT(t1.b,t2.b)",
    "t1&t2&EQ(t1.k,t2.k)&GT(t1.a,t2.b)&GT(t1.b,t2.a)",
    "t1&t2&EQ(t1.k,t2.k)&IQ(t1.a,t2.a)&IQ(t1.b,t2.b)",
    "t1&t2&EQ(t1.k,t2.a)&LT(t1.a,t2.b)&IQ(t1.b,t2.k)",
    "t1&t2&EQ(t1.k,t2.a)&IQ(t1.a,t2.b)&IQ(t1.b,t2.k)",
    "t1&t2&LT(t1.a,t2.a)&GT(t1.b,t2.b)",
    "t1&t2&GT(t1.a,t2.b)&GT(t1.b,t2.k)",
    "t1&t2&IQ(t1.a,t2.a)&IQ(t1.b,t2.b)",
    "t1&t2&IQ(t1.k,t2.k)&IQ(t1.a,t2.b)&IQ(t1.b,t2.b)",
    "t1&EQ(t1.k,1)&GT(t1.a,0)",
]
SIGNS = {"EQ": lambda x, y: x == y, "IQ": lambda x, y: x != y, "LT": lambda x, y: x is not None and y is not None and x < y, "GT": lambda x, y: x is not None and y is not None and x > y}
values = st.one_of(st.none(), st.integers(0, 3))


@pytest.mark.parametrize("rows_of_part", [100_000, 2])
@settings(max_examples=1, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=st.lists(st.tuples(values, values, values), max_size=14))
def test_rewrites_equal_the_definition(spark, rows_of_part, rows):
    dc.PART_ROWS = rows_of_part
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, k int, a int, b int").coalesce(1).cache()
    for text in SHAPES:
        constraint = dc.parse(text)
        at = {"k": 0, "a": 1, "b": 2}
        holds = lambda p, x, y: SIGNS[p.sign](x[at[p.left]], int(p.right) if p.constant else y[at[p.right]])
        expected = [(i,) for i, x in enumerate(rows) if any(all(holds(p, x, y) for p in constraint.predicates) for y in rows)]
        assert cells(dc.violating_rows(df, constraint).select("id")) == sorted(expected, key=repr), text
    df.unpersist()
    dc.PART_ROWS = 100_000


@pytest.mark.parametrize("text", [*SHAPES[:7], *SHAPES[9:12]])
def test_plans_without_quadratic_joins(spark, text):
    df = spark.range(10).selectExpr("id", "id % 3 k", "id % 2 a", "id % 5 b")
    plan = dc.violating_rows(df, dc.parse(text))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_keyless_orders_of_many_rows(spark, monkeypatch):
    """Ranges of values, with what is carried into them, against a sort."""
    import random

    monkeypatch.setattr(dc, "PART_ROWS", 50)
    rand = random.Random(3)
    rows = [(i, rand.randrange(300), rand.randrange(1000)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, a int, b int")
    found = {r["id"] for r in dc.violating_rows(df, dc.parse("t1&t2&LT(t1.a,t2.a)&GT(t1.b,t2.b)")).collect()}
    assert found == {i for i, a, b in rows if any(a < x and b > y for _, x, y in rows)}


def test_constraint_files(spark, tmp_path):
    (tmp_path / "c.txt").write_text("k->a\n\n k->b \n")
    assert dc.read_file(str(tmp_path / "c.txt")) == dc.read_file(f"file://{tmp_path}/c.txt") == ["k->a", "k->b"]
    assert dc.read_file(str(tmp_path / "none.txt")) == []
