"""A query for each operator over the test tables, and its SQL where SQL has one.

The tables have no errors, so the same CASE expressions in Spark and in the SQL put some in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmend.api import Mender
from cellmend.functions.costs import Levenshtein, UserDefinedUpdateCostFunction
from cellmend.functions.names import col
from cellmend.functions.text import qgrams, restored
from cellmend.operators import depgraph, domains, misc, models, rules, stats
from cellmend.operators import detectors as d
from cellmend.plans import constraints as dc
from cellmend.plans import repair as plans
from cellmend.sources.tables import check_input, continuous_columns

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: The tables with errors, as SELECT lists that Spark and the oracle share.
FRAMES = {
    "orders": ("orders", "o_orderkey, o_orderstatus, o_totalprice, CASE WHEN o_orderkey % 17 = 3 THEN NULL ELSE o_orderpriority END AS o_orderpriority"),
    "texts": ("orders", "o_orderkey, o_orderstatus, CAST(o_custkey % 7 AS STRING) AS custgroup, CASE WHEN o_orderkey % 17 = 3 THEN NULL ELSE o_orderpriority END AS o_orderpriority"),
    "whole": ("orders", "o_orderkey, o_orderstatus, CAST(o_custkey % 7 AS STRING) AS custgroup, o_orderpriority"),
    "customer": ("customer", "c_custkey, CASE WHEN c_custkey % 23 = 5 THEN replace(c_name, '#', '-') ELSE c_name END AS c_name, c_nationkey, c_acctbal, c_mktsegment"),
    "part": ("part", "p_partkey, CASE WHEN p_partkey % 23 = 5 THEN concat(p_brand, 'x') ELSE p_brand END AS p_brand, p_type, p_size, p_retailprice"),
    "prices": ("part", "p_partkey, p_brand, p_type, p_size, p_retailprice + (p_partkey % 13) * 10.0 AS p_retailprice"),
    "supplier": ("supplier JOIN nation ON s_nationkey = n_nationkey", "s_suppkey, s_nationkey, CASE WHEN s_suppkey % 23 = 5 THEN 'NATION_X' WHEN s_suppkey % 17 = 3 THEN NULL ELSE n_name END AS n_name"),
    "nations": ("supplier JOIN nation ON s_nationkey = n_nationkey", "s_suppkey, CAST(s_nationkey AS STRING) AS s_nationkey, CASE WHEN s_suppkey % 17 = 3 THEN NULL ELSE n_name END AS n_name"),
    "steps": ("events", "event_id, CASE WHEN event_id % 997 = 1 THEN value * 100 ELSE floor(value / 20) * 20 END AS value"),
    "misnamed": ("customer", "c_custkey, CASE WHEN c_custkey % 23 = 5 THEN concat('Customer#', lpad(CAST(c_custkey - 1 AS STRING), 9, '0'), 'x') ELSE c_name END AS c_name"),
    "events": ("events", "event_id, user_id, event_type, CASE WHEN event_id % 997 = 1 THEN value * 100 ELSE value END AS value"),
}
BRANDS = [f"Brand#{i}" for i in range(1, 21)]


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = FRAMES[name]
    tables = source.split(" ON ")[0].split(" JOIN ")
    df = spark.read.parquet(f"{sf_dir}/{tables[0]}.parquet")
    if len(tables) > 1:
        df = df.join(spark.read.parquet(f"{sf_dir}/{tables[1]}.parquet"), F.expr(source.split(" ON ")[1]))
    return df.selectExpr(*_split(columns))


def _split(columns: str) -> list[str]:
    """The items of a SELECT list."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(columns[start:i])
            start = i + 1
    return [*out, columns[start:]]


def table(name: str) -> str:
    """The same frame for the oracle."""
    source, columns = FRAMES[name]
    return f"(SELECT {columns.replace('AS STRING)', 'AS VARCHAR)')} FROM {source})"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def _detect(df: DataFrame, row_id: str, *detectors: d.ErrorDetector, targets: list[str] | None = None) -> DataFrame:
    return d.detect_all(df, row_id, detectors, continuous_columns(df, row_id), targets or [c for c in df.columns if c != row_id]).select(col(row_id), "attribute")


# Detection

NULL_ORDERS = f"SELECT o_orderkey, 'o_orderpriority' AS attribute FROM {table('orders')} WHERE o_orderpriority IS NULL"


@query("detect_null_orders", NULL_ORDERS)
def detect_null_orders(spark, sf):
    return _detect(frame(spark, sf, "orders"), "o_orderkey", d.NullErrorDetector())


@query("detect_domain_values_part", f"SELECT p_partkey, 'p_brand' AS attribute FROM {table('part')} WHERE p_brand IS NULL OR p_brand NOT IN ({', '.join(repr(b) for b in BRANDS)})")
def detect_domain_values_part(spark, sf):
    return _detect(frame(spark, sf, "part"), "p_partkey", d.DomainValues("p_brand", BRANDS))


AUTOFILL = f"SELECT p_partkey, 'p_brand' AS attribute FROM {table('part')} WHERE p_brand IS NULL OR p_brand NOT IN (SELECT p_brand FROM {table('part')} WHERE p_brand IS NOT NULL GROUP BY p_brand HAVING count(*) > 12)"


@query("detect_domain_autofill_part", AUTOFILL)
def detect_domain_autofill_part(spark, sf):
    return _detect(frame(spark, sf, "part"), "p_partkey", d.DomainValues("p_brand", autofill=True))


@query("detect_regex_customer", f"SELECT c_custkey, 'c_name' AS attribute FROM {table('customer')} WHERE c_name IS NULL OR NOT regexp_matches(c_name, '^Customer#[0-9]{{9}}$')")
def detect_regex_customer(spark, sf):
    return _detect(frame(spark, sf, "customer"), "c_custkey", d.RegExErrorDetector("c_name", "^Customer#[0-9]{9}$"))


OUTLIERS = f"WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM {table('events')}) SELECT event_id, 'value' AS attribute FROM {table('events')}, q WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)"


@query("detect_outlier_events", OUTLIERS)
def detect_outlier_events(spark, sf):
    return _detect(frame(spark, sf, "events"), "event_id", d.GaussianOutlierErrorDetector(), targets=["value"])


# Where values come in few steps, approximate quartiles are the exact ones.
@query("detect_outlier_approx_events", OUTLIERS.replace(table("events"), table("steps")).replace("quantile_cont", "quantile_disc"))
def detect_outlier_approx_events(spark, sf):
    return _detect(frame(spark, sf, "steps"), "event_id", d.GaussianOutlierErrorDetector(approx_enabled=True), targets=["value"])


@query("detect_lof_events")
def detect_lof_events(spark, sf):
    return _detect(frame(spark, sf, "events"), "event_id", d.LOFOutlierErrorDetector(), targets=["value"])


class FarFromMedian:
    """An estimator of a user's: -1 beyond ten median deviations."""

    def fit_predict(self, x):
        import numpy as np

        v = np.asarray(x, float).ravel()
        far = np.abs(v - np.median(v))
        return np.where(far > 10 * np.median(far), -1, 1)


FAR = f"WITH m AS (SELECT median(value) AS m FROM {table('events')}), f AS (SELECT median(abs(value - m)) AS f FROM {table('events')}, m) SELECT event_id, 'value' AS attribute FROM {table('events')}, m, f WHERE abs(value - m) > 10 * f"


@query("detect_fitted_events", FAR)
def detect_fitted_events(spark, sf):
    df = frame(spark, sf, "events")
    return _detect(df, "event_id", d.ScikitLearnBackedErrorDetector(FarFromMedian, parallel_mode_threshold=10**9), targets=["value"])


def _both(name: str, key: str, attrs: str, where: str) -> str:
    return " UNION ALL ".join(f"SELECT {key}, '{a}' AS attribute FROM {table(name)} l WHERE {where}" for a in attrs.split(","))


@query("detect_constraint_1tuple", _both("orders", "o_orderkey", "o_orderstatus,o_totalprice", "o_orderstatus = 'F' AND o_totalprice > 100000"))
def detect_constraint_1tuple(spark, sf):
    return _detect(frame(spark, sf, "orders"), "o_orderkey", d.ConstraintErrorDetector(constraints='t1&EQ(t1.o_orderstatus,"F")&GT(t1.o_totalprice,100000)'))


def _exists(name: str, where: str) -> str:
    return f"EXISTS (SELECT 1 FROM {table(name)} r WHERE {where})"


@query("detect_constraint_fd_supplier", _both("supplier", "s_suppkey", "s_nationkey,n_name", _exists("supplier", "l.s_nationkey IS NOT DISTINCT FROM r.s_nationkey AND l.n_name IS DISTINCT FROM r.n_name")))
def detect_constraint_fd_supplier(spark, sf):
    return _detect(frame(spark, sf, "supplier"), "s_suppkey", d.ConstraintErrorDetector(constraints="s_nationkey->n_name"))


@query("detect_constraint_order_part", _both("prices", "p_partkey", "p_brand,p_type,p_retailprice", _exists("prices", "l.p_brand = r.p_brand AND l.p_type = r.p_type AND l.p_retailprice < r.p_retailprice")))
def detect_constraint_order_part(spark, sf):
    text = "t1&t2&EQ(t1.p_brand,t2.p_brand)&EQ(t1.p_type,t2.p_type)&LT(t1.p_retailprice,t2.p_retailprice)"
    return _detect(frame(spark, sf, "prices"), "p_partkey", d.ConstraintErrorDetector(constraints=text))


@query("detect_constraint_dominated_part", _both("prices", "p_partkey", "p_brand,p_size,p_retailprice", _exists("prices", "l.p_brand = r.p_brand AND l.p_size < r.p_size AND l.p_retailprice > r.p_retailprice")))
def detect_constraint_dominated_part(spark, sf):
    text = "t1&t2&EQ(t1.p_brand,t2.p_brand)&LT(t1.p_size,t2.p_size)&GT(t1.p_retailprice,t2.p_retailprice)"
    return _detect(frame(spark, sf, "prices"), "p_partkey", d.ConstraintErrorDetector(constraints=text))


@query("detect_constraint_generic_part", _both("prices", "p_partkey", "p_size,p_brand,p_type", _exists("prices", "l.p_size = r.p_size AND l.p_brand <> r.p_brand AND l.p_type <> r.p_type")))
def detect_constraint_generic_part(spark, sf):
    text = "t1&t2&EQ(t1.p_size,t2.p_size)&IQ(t1.p_brand,t2.p_brand)&IQ(t1.p_type,t2.p_type)"
    return _detect(frame(spark, sf, "prices"), "p_partkey", d.ConstraintErrorDetector(constraints=text))


@query("detect_constraint_keyless_part", _both("prices", "p_partkey", "p_size,p_retailprice", _exists("prices", "l.p_size < r.p_size AND l.p_retailprice > r.p_retailprice + 0")))
def detect_constraint_keyless_part(spark, sf):
    return _detect(frame(spark, sf, "prices"), "p_partkey", d.ConstraintErrorDetector(constraints="t1&t2&LT(t1.p_size,t2.p_size)&GT(t1.p_retailprice,t2.p_retailprice)"))


@query("detect_default_part", f"{AUTOFILL.replace('> 12', '> 4')} UNION SELECT p_partkey, 'p_type' FROM {table('part')} WHERE p_type NOT IN (SELECT p_type FROM {table('part')} GROUP BY p_type HAVING count(*) > 4)")
def detect_default_part(spark, sf):
    df = frame(spark, sf, "part")
    return _detect(df, "p_partkey", *d.default_detectors([c for c in df.columns if c != "p_partkey"]))


UNION = f"{NULL_ORDERS} UNION SELECT o_orderkey, 'o_orderstatus' FROM {table('orders')} WHERE o_orderstatus NOT IN ('F', 'O') UNION SELECT o_orderkey, 'o_orderpriority' FROM {table('orders')} WHERE NOT regexp_matches(o_orderpriority, '^[1-4]-')"


@query("detect_multi_union", UNION)
def detect_multi_union(spark, sf):
    return _detect(frame(spark, sf, "orders"), "o_orderkey", d.NullErrorDetector(), d.DomainValues("o_orderstatus", ["F", "O"]), d.RegExErrorDetector("o_orderpriority", "^[1-4]-"))


GIVEN = f"SELECT o_orderkey, 'o_orderpriority' AS attribute FROM {table('whole')} WHERE o_orderkey % 17 = 3"


def _given(df: DataFrame) -> DataFrame:
    wrong = df.where("o_orderkey % 17 = 3").select("o_orderkey", F.lit("o_orderpriority").alias("attribute"))
    return wrong.union(wrong.select("o_orderkey", F.lit("no_such_column")))


@query("detect_given_cells", GIVEN)
def detect_given_cells(spark, sf):
    df = frame(spark, sf, "whole")
    return d.given_cells(_given(df), "o_orderkey", df.columns)


@query("error_counts", f"SELECT attribute, count(*) AS n FROM ({UNION}) GROUP BY attribute")
def error_counts(spark, sf):
    return d.cell_counts(detect_multi_union(spark, sf))


@query("error_ratios", f"SELECT attribute, count(*) AS n, round(count(*) / (SELECT count(*) FROM {table('orders')}), 6) AS ratio FROM ({UNION}) GROUP BY attribute")
def error_ratios(spark, sf):
    return d.cell_counts(detect_multi_union(spark, sf), frame(spark, sf, "orders").count()).withColumn("ratio", F.round("ratio", 6))


CURRENT = f"SELECT c.o_orderkey, c.attribute, CASE c.attribute WHEN 'o_orderpriority' THEN t.o_orderpriority ELSE t.o_orderstatus END AS current_value FROM ({UNION}) c JOIN {table('orders')} t ON c.o_orderkey = t.o_orderkey"


@query("cells_with_current_values", CURRENT)
def cells_with_current_values(spark, sf):
    return d.with_current_values(frame(spark, sf, "orders"), detect_multi_union(spark, sf), "o_orderkey")


@query("check_input_continuous", "SELECT unnest(['o_totalprice']) AS column_name")
def check_input_continuous(spark, sf):
    return spark.createDataFrame([(c,) for c in check_input(frame(spark, sf, "orders"), "o_orderkey")], "column_name string")


CONSTRAINT_TEXTS = ["t1&t2&EQ(t1.x,t2.x)&IQ(t1.y,t2.y)", "x->z", 't1&EQ(t1.x,"a")&GT(t1.y,5)', "t1&t2&EQ(t1.x,t2.x)", "nonsense"]


@query("parse_constraints", "SELECT * FROM (VALUES (0, 'EQ', 'x', 'x', false), (0, 'IQ', 'y', 'y', false), (1, 'EQ', 'x', 'x', false), (1, 'IQ', 'z', 'z', false), (2, 'EQ', 'x', '\"a\"', true), (2, 'GT', 'y', '5', true)) t(number, sign, lhs, rhs, constant)")
def parse_constraints(spark, sf):
    rows = [(i, p.sign, p.left, p.right, p.constant) for i, c in enumerate(dc.load(CONSTRAINT_TEXTS, "xyz")) for p in c.predicates]
    return spark.createDataFrame(rows, "number int, sign string, lhs string, rhs string, constant boolean")


@query("functional_dependencies", "SELECT * FROM (VALUES ('y', 'x'), ('z', 'x')) t(y, x)")
def functional_dependencies(spark, sf):
    found = dc.functional_dependencies(dc.load(CONSTRAINT_TEXTS, "xyz"), "xyz")
    return spark.createDataFrame([(y, x) for y, xs in found.items() for x in xs], "y string, x string")


# Statistics


@query("flatten_customer", " UNION ALL ".join(f"SELECT c_custkey, '{c}' AS attribute, CAST({c} AS VARCHAR) AS value FROM {table('customer')}" for c in ("c_name", "c_nationkey", "c_acctbal", "c_mktsegment")))
def flatten_customer(spark, sf):
    return misc.flatten(frame(spark, sf, "customer"), "c_custkey")


_PROFILE = "SELECT '{c}' AS attrName, count(DISTINCT {c}) AS distinctCnt, {low} AS min, {high} AS max, count(*) - count({c}) AS nullCnt, {avg} AS avgLen, {most} AS maxLen FROM " + table("part")
_LENGTH = {"avg": "CAST(ceil(avg(length({c}))) AS BIGINT)", "most": "max(length({c}))", "low": "CAST(NULL AS VARCHAR)", "high": "CAST(NULL AS VARCHAR)"}


def _profile(c: str, size: int | None) -> str:
    parts = {k: v.format(c=c) for k, v in _LENGTH.items()} if size is None else {"avg": f"CAST({size} AS BIGINT)", "most": f"CAST({size} AS BIGINT)", "low": f"CAST(min({c}) AS VARCHAR)", "high": f"CAST(max({c}) AS VARCHAR)"}
    return _PROFILE.format(c=c, **parts)


@query("describe_part", " UNION ALL ".join(_profile(c, s) for c, s in (("p_partkey", 8), ("p_brand", None), ("p_type", None), ("p_size", 4), ("p_retailprice", 8))))
def describe_part(spark, sf):
    return misc.describe(frame(spark, sf, "part"), approx=False).drop("hist")


@query("describe_part_histograms")
def describe_part_histograms(spark, sf):
    return misc.describe(frame(spark, sf, "part"))


@query("column_domains_orders", " UNION ALL ".join(f"SELECT '{c}' AS attribute, count(DISTINCT {c}) AS n FROM {table('texts')}" for c in ("o_orderstatus", "custgroup", "o_orderpriority")))
def column_domains_orders(spark, sf):
    found = stats.distinct_counts(frame(spark, sf, "texts"), ["o_orderstatus", "custgroup", "o_orderpriority"])
    return spark.createDataFrame(list(found.items()), "attribute string, n bigint")


@query("column_extremes_part", f"SELECT 'p_size' AS attribute, CAST(min(p_size) AS DOUBLE) AS low, CAST(max(p_size) AS DOUBLE) AS high FROM {table('part')} UNION ALL SELECT 'p_retailprice', min(p_retailprice), max(p_retailprice) FROM {table('part')}")
def column_extremes_part(spark, sf):
    found = stats.extremes(frame(spark, sf, "part"), ["p_size", "p_retailprice"])
    return spark.createDataFrame([(c, float(a), float(b)) for c, (a, b) in found.items()], "attribute string, low double, high double")


DISCRETE = f"WITH b AS (SELECT min(c_acctbal) AS low, max(c_acctbal) AS high, CAST(min(c_nationkey) AS DOUBLE) AS l2, CAST(max(c_nationkey) AS DOUBLE) AS h2 FROM {table('customer')}) SELECT c_custkey, CAST(trunc((c_nationkey - l2) / (h2 - l2) * 20) AS INTEGER) AS c_nationkey, CAST(trunc((c_acctbal - low) / (high - low) * 20) AS INTEGER) AS c_acctbal, c_mktsegment FROM {table('customer')}, b"


@query("discretize_customer", DISCRETE)
def discretize_customer(spark, sf):
    return stats.discretize(frame(spark, sf, "customer"), "c_custkey", 20)[0]


_FLAG = stats.FREQ_FLAG
FREQ = "SELECT o_orderstatus, CAST(grouping(o_orderstatus) AS INTEGER) AS {f}o_orderstatus, o_orderpriority, CAST(grouping(o_orderpriority) AS INTEGER) AS {f}o_orderpriority, custgroup, CAST(grouping(custgroup) AS INTEGER) AS {f}custgroup, count(*) AS cnt FROM {t} GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), (o_orderstatus, o_orderpriority), (custgroup, o_orderpriority)) {having}"
_SETS = [["o_orderstatus"], ["o_orderpriority"], ["o_orderstatus", "o_orderpriority"], ["custgroup", "o_orderpriority"]]


@query("freq_stats_orders", FREQ.format(f=_FLAG, t=table("texts"), having=""))
def freq_stats_orders(spark, sf):
    return stats.freq_stats(frame(spark, sf, "texts"), _SETS)


@query("freq_stats_filtered_orders", FREQ.format(f=_FLAG, t=table("texts"), having=f"HAVING count(*) > (SELECT CAST(trunc(count(*) * 0.05) AS BIGINT) FROM {table('texts')})"))
def freq_stats_filtered_orders(spark, sf):
    return stats.freq_stats(frame(spark, sf, "texts"), _SETS, 0.05)


_SHARE = """WITH o AS (SELECT o_orderstatus, o_orderpriority, CAST(trunc((o_totalprice - low) / (high - low) * 80) AS INTEGER) AS o_totalprice FROM {t}, (SELECT min(o_totalprice) AS low, max(o_totalprice) AS high FROM {t})),
s AS (SELECT * FROM ({pairs})) SELECT y, x FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY share, x) AS r FROM s WHERE share < 1) WHERE r = 1"""
_SHARES = " UNION ALL ".join(f"SELECT '{y}' AS y, '{x}' AS x, (SELECT count(*) FROM (SELECT DISTINCT {y}, {x} FROM o)) / ((SELECT count(DISTINCT {y}) FROM o) * (SELECT count(DISTINCT {x}) FROM o)) AS share" for y in ("o_orderstatus", "o_totalprice", "o_orderpriority") for x in ("o_orderstatus", "o_totalprice", "o_orderpriority") if x != y)


@query("pair_cooccurrence_orders", _SHARE.format(t=table("orders"), pairs=_SHARES))
def pair_cooccurrence_orders(spark, sf):
    df = stats.discretize(frame(spark, sf, "orders"), "o_orderkey", 80)[0]
    sizes = stats.distinct_counts(df, [c for c in df.columns if c != "o_orderkey"])
    pairs = stats.candidate_pairs(df, sizes, sizes, 1.0, 1)
    return spark.createDataFrame(pairs, "y string, x string")


_H = "(SELECT -sum(c / n * log2(c / n)) FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM {t} GROUP BY {g}), (SELECT CAST(count(*) AS DOUBLE) AS n FROM {t}))"


def _entropy_sql(y: str, x: str) -> str:
    both, one = (_H.format(t=table("texts"), g=g) for g in (f"{y}, {x}", x))
    return f"SELECT '{y}' AS y, '{x}' AS x, round({both} - {one}, 6) AS h"


_PAIRS = [("o_orderpriority", "o_orderstatus"), ("o_orderpriority", "custgroup"), ("o_orderstatus", "o_orderpriority")]


@query("conditional_entropy_orders", " UNION ALL ".join(_entropy_sql(y, x) for y, x in _PAIRS))
def conditional_entropy_orders(spark, sf):
    df = frame(spark, sf, "texts")
    found = stats.conditional_entropies(df, _PAIRS, stats.distinct_counts(df, ["o_orderstatus", "custgroup", "o_orderpriority"]))
    return spark.createDataFrame([(y, x, h) for y, xs in found.items() for x, h in xs], "y string, x string, h double").withColumn("h", F.round("h", 6))


def _domain_cells(spark, sf) -> tuple[DataFrame, DataFrame]:
    df = frame(spark, sf, "whole")
    return df, d.with_current_values(df, d.given_cells(_given(df), "o_orderkey", df.columns), "o_orderkey")


def _domains(spark, sf, beta: float) -> DataFrame:
    df, cells = _domain_cells(spark, sf)
    sizes = stats.distinct_counts(df, ["o_orderstatus", "custgroup", "o_orderpriority"])
    return domains.cell_domains(df, cells, "o_orderkey", {"o_orderpriority": ["o_orderstatus", "custgroup"]}, sizes, beta=beta)


def _weights(x: str) -> str:
    return f"SELECT {x} AS given, o_orderpriority AS n, greatest(count(*) - 1.0, 0.1) AS w FROM {table('whole')} GROUP BY {x}, o_orderpriority"


_SCORES = f"WITH c AS (SELECT * FROM {table('whole')} WHERE o_orderkey % 17 = 3), s AS (SELECT o_orderkey, o_orderpriority AS current_value, n, sum(CAST(w AS DOUBLE)) AS w FROM (SELECT c.o_orderkey, c.o_orderpriority, a.n, a.w FROM c JOIN ({_weights('o_orderstatus')}) a ON a.given = c.o_orderstatus UNION ALL SELECT c.o_orderkey, c.o_orderpriority, a.n, a.w FROM c JOIN ({_weights('custgroup')}) a ON a.given = c.custgroup) GROUP BY ALL), p AS (SELECT o_orderkey, current_value, n, w / sum(w) OVER (PARTITION BY o_orderkey) AS prob FROM s)"


@query("cell_domain_orders", f"{_SCORES} SELECT o_orderkey, 'o_orderpriority' AS attribute, current_value, n, round(prob, 6) AS prob FROM p WHERE prob > 0.2")
def cell_domain_orders(spark, sf):
    found = _domains(spark, sf, 0.2)
    return found.select("o_orderkey", "attribute", "current_value", F.explode("domain").alias("x")).select("o_orderkey", "attribute", "current_value", "x.n", F.round("x.prob", 6).alias("prob"))


@query("weak_label_orders", f"{_SCORES} SELECT o_orderkey, 'o_orderpriority' AS attribute FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY prob DESC, n) AS r FROM p WHERE prob > 0.01) WHERE r = 1 AND n = current_value")
def weak_label_orders(spark, sf):
    return domains.weak_labels(_domains(spark, sf, 0.01), "o_orderkey")


@query("repair_base_orders", f"SELECT * FROM {table('texts')}")
def repair_base_orders(spark, sf):
    df, cells = _domain_cells(spark, sf)
    return domains.repair_base(df, cells, "o_orderkey", ["o_orderpriority"])


@query("clean_rows_orders", f"SELECT * FROM {table('whole')} WHERE o_orderkey % 17 <> 3")
def clean_rows_orders(spark, sf):
    df, cells = _domain_cells(spark, sf)
    return domains.split_rows(df, cells, "o_orderkey")[0]


@query("dirty_rows_orders", f"SELECT * FROM {table('whole')} WHERE o_orderkey % 17 = 3")
def dirty_rows_orders(spark, sf):
    df, cells = _domain_cells(spark, sf)
    return domains.split_rows(df, cells, "o_orderkey")[1]


@query("cells_of_columns", f"SELECT * FROM ({UNION}) WHERE attribute NOT IN ('o_orderstatus')")
def cells_of_columns(spark, sf):
    return domains.of_columns(detect_multi_union(spark, sf), ["o_orderstatus"], negate=True)


# Rules

FD_MAP = f"SELECT s_nationkey, min(n_name) AS n_name FROM {table('nations')} WHERE n_name IS NOT NULL AND s_nationkey IS NOT NULL GROUP BY s_nationkey HAVING count(DISTINCT n_name) = 1"


@query("fd_map_supplier_nation", FD_MAP)
def fd_map_supplier_nation(spark, sf):
    return rules.dependency_values(frame(spark, sf, "nations"), "s_nationkey", "n_name")


@query("repair_fd_supplier", f"SELECT t.s_suppkey, 'n_name' AS attribute, CAST(NULL AS VARCHAR) AS current_value, m.n_name AS repaired FROM {table('nations')} t LEFT JOIN ({FD_MAP}) m ON t.s_nationkey = m.s_nationkey WHERE t.n_name IS NULL")
def repair_fd_supplier(spark, sf):
    df = frame(spark, sf, "nations")
    model = Mender().repair.setInput(df).setRowId("s_suppkey").setTargets(["n_name"]).setDiscreteThreshold(100)
    model.setErrorDetectors([d.NullErrorDetector(), d.ConstraintErrorDetector(constraints="s_nationkey->n_name")]).setRepairByRules(True)
    return model.run().where("current_value is null")


@query("repair_regex_customer", f"SELECT c_custkey, c_name AS current_value, CASE WHEN regexp_matches(c_name, '^.{{1,8}}.[0-9]{{9}}$') THEN concat('Customer', '-', regexp_extract(c_name, '([0-9]{{9}})$', 1)) END AS repaired FROM {table('customer')} WHERE c_custkey % 23 <> 5")
def repair_regex_customer(spark, sf):
    df = frame(spark, sf, "customer").where("c_custkey % 23 <> 5")
    return df.select("c_custkey", F.col("c_name").alias("current_value"), restored(F.col("c_name"), "^Customer-[0-9]{9}$").alias("repaired"))


NEAREST = f"WITH t AS (SELECT * FROM {table('part')}), v AS (SELECT DISTINCT p_brand AS v FROM t WHERE p_brand NOT LIKE '%x'), w AS (SELECT DISTINCT p_brand AS w FROM t WHERE p_brand LIKE '%x'), c AS (SELECT w, v, levenshtein(w, v) AS cost FROM w, v), b AS (SELECT w, min(cost) AS least, count(*) AS n FROM c GROUP BY w), f AS (SELECT c.w, min(v) AS repaired, count(*) AS ties FROM c JOIN b ON c.w = b.w AND c.cost = b.least WHERE least <= 2 AND n > 1 GROUP BY c.w) SELECT p_partkey, 'p_brand' AS attribute, p_brand AS current_value, repaired FROM t JOIN f ON t.p_brand = f.w WHERE ties = 1"


@query("repair_nearest_part", NEAREST)
def repair_nearest_part(spark, sf):
    df = frame(spark, sf, "part")
    wrong = df.where("p_brand like '%x'").select("p_partkey", F.lit("p_brand").alias("attribute"), F.col("p_brand").alias("current_value"))
    base = domains.repair_base(df, wrong, "p_partkey", ["p_brand"])
    return rules.by_nearest(base, wrong, "p_partkey", ["p_brand"], Levenshtein(targets=["p_brand"]), 2.0)[1]


@query("repair_by_regexes_customer", f"SELECT c_custkey, 'c_name' AS attribute, c_name AS current_value, concat('Customer-', right(c_name, 9)) AS repaired FROM {table('customer')} WHERE c_custkey % 23 <> 5")
def repair_by_regexes_customer(spark, sf):
    wrong = frame(spark, sf, "customer").where("c_custkey % 23 <> 5").select("c_custkey", F.lit("c_name").alias("attribute"), F.col("c_name").alias("current_value"))
    return rules.by_regexes(wrong, "c_custkey", [("c_name", "^Customer-[0-9]{9}$"), ("c_mktsegment", "^[0-9]$")])[1]


@query("prediction_order", "SELECT * FROM (VALUES (0, 'a'), (1, 'b'), (2, 'c'), (3, 'd')) t(place, y)")
def prediction_order(spark, sf):
    return spark.createDataFrame(list(enumerate(models.dependency_order(["a"], {"d": "c", "b": "a", "c": "b"}))), "place int, y string")


@query("selected_features_orders", f"WITH h AS ({' UNION ALL '.join(_entropy_sql(y, x) for y, x in _PAIRS[:2])}) SELECT x FROM h ORDER BY h LIMIT 2")
def selected_features_orders(spark, sf):
    df = frame(spark, sf, "texts")
    entropies = stats.conditional_entropies(df, _PAIRS[:2], stats.distinct_counts(df, ["o_orderstatus", "custgroup", "o_orderpriority"]))
    return spark.createDataFrame([(x,) for x in models.select_features("o_orderpriority", df.columns, entropies["o_orderpriority"], 1)], "x string")


_MISNAMED = f"WITH t AS (SELECT * FROM {table('misnamed')}), c AS (SELECT DISTINCT w.c_name AS w, v.c_name AS v, levenshtein(w.c_name, v.c_name) AS cost FROM t w, t v WHERE w.c_name LIKE '%x' AND v.c_name NOT LIKE '%x'), b AS (SELECT w, min(cost) AS least FROM c GROUP BY w HAVING least <= 2), f AS (SELECT c.w, min(c.v) AS v FROM c JOIN b ON c.w = b.w AND c.cost = b.least GROUP BY c.w HAVING count(*) = 1) SELECT c_custkey, 'c_name' AS attribute, c_name AS current_value, v AS repaired FROM t JOIN f ON t.c_name = f.w"


@query("repair_nearest_customer", _MISNAMED)
def repair_nearest_customer(spark, sf):
    df = frame(spark, sf, "misnamed")
    wrong = df.where("c_name like '%x'").select("c_custkey", F.lit("c_name").alias("attribute"), F.col("c_name").alias("current_value"))
    base = domains.repair_base(df, wrong, "c_custkey", ["c_name"])
    return rules.by_nearest(base, wrong, "c_custkey", ["c_name"], Levenshtein(), 2.0)[1]


# Models and repair

_COUNTED = """WITH t AS (SELECT * FROM {t}), k AS (SELECT * FROM t WHERE o_orderpriority IS NOT NULL),
classes AS (SELECT o_orderpriority AS class, CAST(count(*) AS DOUBLE) AS n FROM k GROUP BY 1),
base AS (SELECT class, ln((n + 1) / ((SELECT count(*) FROM k) + (SELECT count(*) FROM classes))) - ln(n + (SELECT count(DISTINCT o_orderstatus) FROM k)) - ln(n + (SELECT count(DISTINCT custgroup) FROM k)) AS b FROM classes),
a1 AS (SELECT o_orderstatus AS g, o_orderpriority AS class, count(*) AS c FROM k GROUP BY 1, 2), a2 AS (SELECT custgroup AS g, o_orderpriority AS class, count(*) AS c FROM k GROUP BY 1, 2),
s AS (SELECT w.o_orderkey, w.o_orderstatus, {current} AS current_value, base.class, b + ln(coalesce(a1.c, 0) + 1.0) + ln(coalesce(a2.c, 0) + 1.0) AS s FROM {cells} w CROSS JOIN base LEFT JOIN a1 ON a1.g = w.o_orderstatus AND a1.class = base.class LEFT JOIN a2 ON a2.g = w.custgroup AND a2.class = base.class),
e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY o_orderkey)) AS e FROM s),
p AS (SELECT o_orderkey, current_value, class, e / sum(e) OVER (PARTITION BY o_orderkey) AS prob FROM e)"""
_NULLS = _COUNTED.format(t=table("texts"), current="CAST(NULL AS VARCHAR)", cells="(SELECT * FROM t WHERE o_orderpriority IS NULL)")
_WRONG = _COUNTED.format(t=table("texts"), current="w.o_orderpriority", cells=f"(SELECT * FROM {table('whole')} WHERE o_orderkey % 17 = 3)")
_WEIGHED = _WRONG + ", v AS (SELECT o_orderkey, current_value, class, prob / (1 + 0.1 * levenshtein(current_value, class)) AS w FROM p), q AS (SELECT o_orderkey, current_value, class, w / sum(w) OVER (PARTITION BY o_orderkey) AS prob FROM v), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY prob DESC, class) AS r FROM q), z AS (SELECT a.o_orderkey, 'o_orderpriority' AS attribute, a.current_value, a.class AS repaired, ln(a.prob / o.prob) / (1 + levenshtein(a.current_value, a.class)) AS score FROM r a JOIN q o ON a.o_orderkey = o.o_orderkey AND o.class = a.current_value WHERE a.r = 1)"


def _null_model(spark, sf):
    return Mender().repair.setInput(frame(spark, sf, "texts")).setRowId("o_orderkey").setErrorDetectors([d.NullErrorDetector()])


def _given_model(spark, sf):
    df = frame(spark, sf, "whole")
    return Mender().repair.setInput(df).setRowId("o_orderkey").setErrorCells(_given(df)).setTargets(["o_orderpriority"])


def _exploded(pmf: DataFrame) -> DataFrame:
    return pmf.select("o_orderkey", "attribute", "current_value", F.explode("pmf").alias("x")).select("o_orderkey", "attribute", "current_value", "x.class", F.round("x.prob", 6).alias("prob"))


@query("repair_counting_orders", f"{_NULLS} SELECT o_orderkey, 'o_orderpriority' AS attribute, current_value, class AS repaired FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY prob DESC, class) AS r FROM p) WHERE r = 1")
def repair_counting_orders(spark, sf):
    return _null_model(spark, sf).run()


@query("repair_pmf_orders", f"{_NULLS} SELECT o_orderkey, 'o_orderpriority' AS attribute, current_value, class, round(prob, 6) AS prob FROM p")
def repair_pmf_orders(spark, sf):
    return _exploded(_null_model(spark, sf).run(compute_repair_candidate_prob=True))


@query("repair_prob_orders", f"{_NULLS} SELECT o_orderkey, 'o_orderpriority' AS attribute, current_value, class AS repaired, round(prob, 6) AS prob FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY prob DESC, class) AS r FROM p) WHERE r = 1")
def repair_prob_orders(spark, sf):
    return _null_model(spark, sf).run(compute_repair_prob=True).withColumn("prob", F.round("prob", 6))


@query("weighted_pmf_orders", f"{_WEIGHED} SELECT o_orderkey, 'o_orderpriority' AS attribute, current_value, class, round(prob, 6) AS prob FROM q")
def weighted_pmf_orders(spark, sf):
    return _exploded(_given_model(spark, sf).setUpdateCostFunction(Levenshtein()).run(compute_repair_candidate_prob=True))


@query("repair_score_orders", f"{_WEIGHED} SELECT o_orderkey, attribute, current_value, repaired, round(score, 6) AS score FROM z")
def repair_score_orders(spark, sf):
    return _given_model(spark, sf).setUpdateCostFunction(Levenshtein()).run(compute_repair_score=True).withColumn("score", F.round("score", 6))


@query("max_likelihood_repair_orders", f"{_WEIGHED} SELECT o_orderkey, attribute, current_value, repaired FROM z WHERE score >= (SELECT min(score) FROM (SELECT score FROM z ORDER BY score DESC LIMIT 100))")
def max_likelihood_repair_orders(spark, sf):
    scores = _given_model(spark, sf).setUpdateCostFunction(Levenshtein()).run(compute_repair_score=True)
    return plans.best_scored(scores, 100, scores.count())


@query("repair_user_cost_orders", f"{_WEIGHED.replace('levenshtein(current_value, class)', 'abs(length(current_value) - length(class))').replace('levenshtein(a.current_value, a.class)', 'abs(length(a.current_value) - length(a.class))')} SELECT o_orderkey, attribute, current_value, repaired, round(score, 6) AS score FROM z")
def repair_user_cost_orders(spark, sf):
    cost = UserDefinedUpdateCostFunction(lambda x, y: float(abs(len(str(x)) - len(str(y)))))
    return _given_model(spark, sf).setUpdateCostFunction(cost).run(compute_repair_score=True).withColumn("score", F.round("score", 6))


@query("repaired_table_orders", f"{_NULLS} SELECT t.o_orderkey, t.o_orderstatus, t.custgroup, coalesce(t.o_orderpriority, f.class) AS o_orderpriority FROM t LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY prob DESC, class) AS r FROM p) f ON t.o_orderkey = f.o_orderkey AND f.r = 1")
def repaired_table_orders(spark, sf):
    return _null_model(spark, sf).run(repair_data=True)


@query("repair_trees_part")
def repair_trees_part(spark, sf):
    df = frame(spark, sf, "part").withColumn("p_size", F.expr("case when p_partkey % 17 = 3 then null else p_size end"))
    return Mender().repair.setInput(df).setRowId("p_partkey").setTargets(["p_size"]).setErrorDetectors([d.NullErrorDetector()]).option("model.lgb.n_estimators", "5").run()


@query("repair_forest_orders")
def repair_forest_orders(spark, sf):
    return _null_model(spark, sf).option("model.engine", "boosting").option("model.lgb.n_estimators", "5").run()


@query("detect_errors_only_orders", f"SELECT o_orderkey, 'o_orderpriority' AS attribute, CAST(NULL AS VARCHAR) AS current_value FROM {table('texts')} WHERE o_orderpriority IS NULL")
def detect_errors_only_orders(spark, sf):
    return _null_model(spark, sf).run(detect_errors_only=True)


@query("class_deviation_orders", f"SELECT round(stddev_pop(n), 6) AS deviation FROM (SELECT count(*) AS n FROM {table('texts')} WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority)")
def class_deviation_orders(spark, sf):
    return spark.createDataFrame([(models.class_deviation(frame(spark, sf, "texts"), "o_orderpriority"),)], "deviation double").withColumn("deviation", F.round("deviation", 6))


@query("rebalance_orders", f"WITH c AS (SELECT 'o_orderstatus' AS y, o_orderstatus AS class, count(*) AS n FROM {table('texts')} WHERE o_orderstatus IS NOT NULL GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM {table('texts')} WHERE o_orderpriority IS NOT NULL GROUP BY 2) SELECT y, class, CAST(median(n) OVER (PARTITION BY y) AS DOUBLE) AS n FROM c")
def rebalance_orders(spark, sf):
    ys = ["o_orderstatus", "o_orderpriority"]
    table = frame(spark, sf, "texts").drop("o_orderkey")
    return models.fit_counting(table, ys, {y: ["custgroup"] for y in ys}, rebalance=True).classes.select("y", "class", "n")


@query("update_costs_part", f"SELECT p_partkey, CAST(levenshtein(p_brand, p_type) AS DOUBLE) AS cost FROM {table('part')}")
def update_costs_part(spark, sf):
    return frame(spark, sf, "part").select("p_partkey", Levenshtein().column(F.col("p_brand"), F.col("p_type")).alias("cost"))


# Helpers


@query("apply_updates_orders", f"SELECT o_orderkey, o_orderstatus, o_totalprice, CASE WHEN o_orderkey % 17 = 3 THEN 'fixed' ELSE o_orderpriority END AS o_orderpriority FROM {table('orders')}")
def apply_updates_orders(spark, sf):
    df = frame(spark, sf, "orders")
    updates = df.where("o_orderkey % 17 = 3").select("o_orderkey", F.lit("o_orderpriority").alias("attribute"), F.lit("fixed").alias("repaired"))
    return misc.apply_updates(updates, df, "o_orderkey")


@query("error_map_orders", f"SELECT o_orderkey, CASE WHEN o_orderpriority IS NULL THEN '--*' ELSE '---' END AS error_map FROM {table('orders')}")
def error_map_orders(spark, sf):
    return misc.error_map(frame(spark, sf, "orders"), detect_null_orders(spark, sf), "o_orderkey")


@query("histogram_events", f"SELECT 'event_type' AS attribute, event_type AS value, count(*) AS cnt FROM {table('events')} GROUP BY event_type")
def histogram_events(spark, sf):
    found = misc.histograms(frame(spark, sf, "events"), ["event_type", "value"])
    return found.select("attribute", F.inline("histogram"))


@query("qgram_part", "SELECT p_partkey, string_agg(substr(p_type, i, 2), ',' ORDER BY i) AS grams FROM part, range(1, 20) t(i) WHERE i < length(p_type) GROUP BY p_partkey")
def qgram_part(spark, sf):
    return frame(spark, sf, "part").select("p_partkey", F.array_join(qgrams(col("p_type"), 2), ",").alias("grams"))


# Random choices are seeded, so what SQL can tell of them are their properties.
@query("split_table_part", "SELECT count(*) AS n, count(DISTINCT p_partkey) AS ids, 3 AS parts FROM part")
def split_table_part(spark, sf):
    found = misc.split_input(frame(spark, sf, "part"), "p_partkey", 3, ["p_brand", "p_type"])
    return found.agg(F.count("*").alias("n"), F.count_distinct("p_partkey").alias("ids"), F.count_distinct("k").cast("int").alias("parts"))


@query("inject_null_orders", f"SELECT count(*) AS n, 0 AS changed, true AS near_ratio FROM {table('whole')}")
def inject_null_orders(spark, sf):
    df = frame(spark, sf, "whole")
    nulls = misc.inject_null(df, ["o_orderpriority"], 0.1, seed=7).select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("new"), F.col("o_orderstatus").alias("status"))
    joined = df.join(nulls, F.col("o_orderkey") == F.col("key"))
    changed = F.count_if(((F.col("new") != F.col("o_orderpriority")) | (F.col("status") != F.col("o_orderstatus"))))
    return joined.agg(F.count("*").alias("n"), changed.cast("int").alias("changed"), F.avg(F.col("new").isNull().cast("int")).between(0.05, 0.15).alias("near_ratio"))


@query("dep_graph_edges_supplier", f"SELECT n_name AS from_value, CAST(s_nationkey AS VARCHAR) AS to_value, count(*) AS cnt FROM {table('supplier')} WHERE n_name IS NOT NULL GROUP BY ALL")
def dep_graph_edges_supplier(spark, sf):
    found = depgraph.value_edges(frame(spark, sf, "supplier"), [("n_name", "s_nationkey")], 1000)
    return spark.createDataFrame([(a, b, n) for edges, _ in found.values() for a, ys in edges for b, n in ys], "from_value string, to_value string, cnt bigint")


@query("dep_graph_supplier", f"SELECT count(*) AS lines, count(DISTINCT s_nationkey) + count(DISTINCT n_name) AS nodes FROM (SELECT DISTINCT s_nationkey, n_name FROM {table('nations')} WHERE n_name IS NOT NULL)")
def dep_graph_supplier(spark, sf):
    """The drawing's lines and nodes."""
    text = depgraph.dependency_graph(frame(spark, sf, "nations"), ["s_nationkey", "n_name"], threshold=10.0)
    return spark.createDataFrame([(text.count("penwidth"), text.count("[label="))], "lines bigint, nodes bigint")
