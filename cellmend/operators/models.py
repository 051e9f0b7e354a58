"""Repair models (T1 to T12): how a null cell of a column is predicted.

The counting model is the default for discrete columns: the naive Bayes posterior over value
counts, computed by joins for all columns and cells at once, so training is one aggregation
and needs no row on the driver. Continuous columns are predicted by boosted trees, which can
also classify (option model.engine=boosting). They learn from a bounded sample of rows, each
target in a task of its own.
"""

from __future__ import annotations

import logging
import math
import pickle
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmend.functions import options as o
from cellmend.functions.names import col
from cellmend.operators import booster
from cellmend.operators.rules import by_dependency
from cellmend.operators.stats import long_counts
from cellmend.session import cut, ship_package
from cellmend.sources.tables import CONTINUOUS, INTEGRAL

logger = logging.getLogger("cellmend")
#: Counts of value pairs, of three values and a number each, that are broadcast at most.
MOST_BROADCAST = 200_000


@dataclass
class PoorModel:
    """One value for all, or null."""

    value: object = None

    def fill(self, df: DataFrame, y: str) -> DataFrame:
        return df.withColumn(y, F.coalesce(col(y), F.lit(self.value).cast(df.schema[y].dataType)))


@dataclass
class FunctionalDepModel:
    """The value that another column's determines; the values stay a DataFrame."""

    x: str
    values: DataFrame

    def fill(self, df: DataFrame, y: str) -> DataFrame:
        return by_dependency(df, self.x, y, self.values)


@dataclass
class CountingModel:
    """Posteriors of the classes of all `targets`, from smoothed counts of value pairs.

    `pairs` (set, given, class, cnt) and `classes` (y, class, n, base) are DataFrames; the
    number of classes is bounded by the threshold of discrete columns. Up to MOST_BROADCAST
    pairs are broadcast to the cells, so a frequent value doesn't gather them in one task.
    """

    targets: list[str]
    features: dict[str, list[str]]
    pairs: DataFrame
    classes: DataFrame
    smoothing: float
    small: bool = False

    def pmf(self, discrete: DataFrame, cells: DataFrame, row_id: str) -> DataFrame:
        """(row id, attribute, current_value, pmf): all classes by falling probability."""
        sets = [(y, x) for y in self.targets for x in self.features[y]]
        asked = F.array(*(F.struct(F.lit(i).alias("set"), F.lit(y).alias("y"), _known(x).alias("given")) for i, (y, x) in enumerate(sets)))
        keys = [col(row_id), F.col("attribute"), F.col("current_value")]
        wanted = cells.where(F.col("attribute").isin(self.targets)).select(*keys)
        rows = wanted.join(discrete.select(col(row_id).alias("__id"), (asked if sets else F.array()).alias("__sets")), col(row_id) == F.col("__id"))
        plain = F.create_map().cast("map<string,double>")
        if sets:
            own = F.filter("__sets", lambda s: s["y"] == F.col("attribute"))
            met = rows.select(*keys, F.explode(own).alias("s")).select(*keys, "s.set", "s.given").join(F.broadcast(self.pairs) if self.small else self.pairs, ["set", "given"])
            gain = F.ln((F.col("cnt") + self.smoothing) / F.lit(self.smoothing))
            gains = met.groupBy(*keys, "class").agg(F.sum(gain).alias("g")).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("class", "g"))).alias("__gains"))
            joined = wanted.join(gains.select(col(row_id).alias("__id"), F.col("attribute").alias("__a"), "__gains"), (col(row_id) == F.col("__id")) & (F.col("attribute") == F.col("__a")), "left")
        else:
            joined = wanted.withColumn("__gains", plain)
        listed = self.classes.groupBy("y").agg(F.array_sort(F.collect_list(F.struct("class", "base"))).alias("__classes"))
        scored = joined.join(listed, F.col("attribute") == F.col("y"))
        score = lambda c: c["base"] + F.coalesce(F.try_element_at("__gains", c["class"]), F.lit(0.0))
        logs = scored.select(*keys, F.transform("__classes", lambda c: F.struct(c["class"].alias("class"), score(c).alias("s"))).alias("__s"))
        top = logs.withColumn("__top", F.array_max(F.transform("__s", lambda c: c["s"])))
        odds = top.select(*keys, F.transform("__s", lambda c: F.struct(c["class"].alias("class"), F.exp(c["s"] - F.col("__top")).alias("p"))).alias("__p"))
        total = F.aggregate("__p", F.lit(0.0), lambda acc, c: acc + c["p"])
        normal = odds.withColumn("__total", total).select(*keys, F.transform("__p", lambda c: F.struct(c["class"].alias("class"), (c["p"] / F.col("__total")).alias("prob"))).alias("pmf"))
        return normal.withColumn("pmf", F.array_sort("pmf", falling("class", "prob")))


def falling(name: str, prob: str):
    """Order by falling probability, then by rising name."""
    return lambda a, b: F.when(a[prob] > b[prob], -1).when(a[prob] < b[prob], 1).when(a[name] < b[name], -1).when(a[name] > b[name], 1).otherwise(0)


def _known(x: str):
    """The value as text; null is a value of its own."""
    return F.coalesce(F.concat(F.lit("="), col(x).cast("string")), F.lit(""))


def fit_counting(discrete: DataFrame, targets: Iterable[str], features: dict[str, list[str]], smoothing: float = 1.0, rebalance: bool = False) -> CountingModel:
    """T7, T8 for all discrete targets: one aggregation over the rows whose target is known.

    T10: with `rebalance` the counts of each class are scaled to the median class size of its
    target, which is what sampling and repeating its rows would give on average.
    """
    ys = list(targets)
    sets = [(y, x) for y in ys for x in features[y]]
    text = discrete.select(*(col(y).cast("string").alias(f"__y{i}") for i, y in enumerate(ys)), *(_known(x).alias(f"__x{i}") for i, x in enumerate(discrete.columns)))
    at = {c: i for i, c in enumerate(discrete.columns)}
    named = [(f"__y{ys.index(y)}", f"__x{at[x]}") for y, x in sets] + [(f"__y{i}",) for i in range(len(ys))]
    counts = long_counts(text, named).where("v0 is not null")
    pairs = counts.where(F.col("set") < len(sets)).select("set", F.col("v1").alias("given"), F.col("v0").alias("class"), "cnt")
    singles = counts.where(F.col("set") >= len(sets)).select((F.col("set") - len(sets)).alias("t"), F.col("v0").alias("class"), F.col("cnt").alias("n"))
    owner = F.array(*(F.lit(ys.index(y)) for y, _ in sets)) if sets else F.array(F.lit(-1))
    if rebalance:
        middle = singles.groupBy("t").agg(F.percentile("n", F.lit(0.5)).alias("middle"))  # over classes
        scale = singles.join(middle, "t").select("t", "class", (F.col("middle") / F.col("n")).alias("scale"), "middle")
        pairs = pairs.withColumn("t", F.get(owner, F.col("set"))).join(scale.drop("middle"), ["t", "class"]).select("set", "given", "class", (F.col("cnt") * F.col("scale")).alias("cnt"))
        singles = scale.select("t", "class", F.col("middle").alias("n"))
    totals = singles.groupBy("t").agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    # The number of values of each feature, over the rows that a target counts.
    domains = pairs.select("set", "given").distinct().groupBy("set").agg(F.count("*").alias("d"))
    per_target = domains.select(F.get(owner, F.col("set")).alias("t"), "d").groupBy("t").agg(F.collect_list("d").alias("ds"))
    full = singles.join(totals, "t").join(per_target, "t", "left")
    a = smoothing
    unseen = F.aggregate(F.coalesce("ds", F.expr("cast(array() as array<bigint>)")), F.lit(0.0), lambda acc, d: acc + F.ln(F.lit(a) / (F.col("n") + d * a)))
    base = F.ln((F.col("n") + a) / (F.col("total") + F.col("k") * a)) + unseen
    classes = full.select(F.get(F.array(*map(F.lit, ys)), F.col("t").cast("int")).alias("y"), "class", "n", base.alias("base"))
    pairs, classes = cut(pairs), cut(classes)  # counted once, whatever the number of predictions
    return CountingModel(ys, features, pairs, classes, smoothing, pairs.count() <= MOST_BROADCAST)


def select_features(y: str, columns: Iterable[str], entropies: list[tuple[str, float]], most: int) -> list[str]:
    """T4: all other columns, or if they are more than `most` those of the least entropy, two at
    least."""
    names = [c for c in columns if c != y]
    if len(names) <= most or not entropies:
        return names
    return [x for x, _ in entropies if x in names][: max(2, most)]


def class_deviation(df: DataFrame, y: str) -> float:
    """The standard deviation of the class sizes."""
    return df.where(col(y).isNotNull()).groupBy(col(y)).count().agg(F.stddev_pop("count")).first()[0] or 0.0


@dataclass
class Fitted:
    """What a task returns of a target: the columns' bins, the trees and the classes."""

    columns: booster.Columns
    trees: booster.Booster
    classes: list[str]
    trials: int


def _matrix(rows: pd.Series, width: int, kind) -> np.ndarray:
    return np.array([list(r) for r in rows], kind).reshape(len(rows), width)


@dataclass
class TreeModel:
    """Boosted trees of one target."""

    y: str
    features: list[str]
    continuous: bool
    fitted: Fitted

    def predict(self, df: DataFrame) -> DataFrame:
        """df with `__prediction`, and of classes their probabilities `__pmf`."""
        numbers, texts = _inputs(df, self.features)
        width, kinds, fitted = _widths(df, self.features), self.fitted.classes, self.fitted
        n, t = width

        def bins(a: pd.Series, b: pd.Series) -> np.ndarray:
            return fitted.columns.transform(_matrix(a, n, float), _matrix(b, t, object))

        if self.continuous:

            @F.pandas_udf("double")
            def number(a: pd.Series, b: pd.Series) -> pd.Series:
                return pd.Series(fitted.trees.predict(bins(a, b)))

            return df.withColumn("__prediction", number(numbers, texts))

        @F.pandas_udf("array<double>")
        def probabilities(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series(list(fitted.trees.predict(bins(a, b))))

        names = F.array(*map(F.lit, kinds))
        done = df.withColumn("__p", probabilities(numbers, texts))
        pmf = F.array_sort(F.zip_with(names, "__p", lambda c, p: F.struct(c.alias("class"), p.alias("prob"))), falling("class", "prob"))
        return done.withColumn("__pmf", pmf).withColumn("__prediction", F.get("__pmf", 0)["class"]).drop("__p")

    def fill(self, df: DataFrame, y: str) -> DataFrame:
        kind = dict(df.dtypes)[y]
        value = F.round("__prediction") if kind in INTEGRAL else F.col("__prediction")
        done = self.predict(df)
        return done.select(*(F.coalesce(col(c), value.cast(kind)).alias(c) if c == y else col(c) for c in df.columns))


def _widths(df: DataFrame, features: list[str]) -> tuple[int, int]:
    kinds = dict(df.dtypes)
    n = sum(kinds[x] in CONTINUOUS for x in features)
    return n, len(features) - n


def _inputs(df: DataFrame, features: list[str]):
    """The numbers and the texts of the features, as two arrays."""
    kinds = dict(df.dtypes)
    numbers = [F.coalesce(col(x).cast("double"), F.lit(math.nan)) for x in features if kinds[x] in CONTINUOUS]
    texts = [col(x).cast("string") for x in features if kinds[x] not in CONTINUOUS]
    return (F.array(*numbers) if numbers else F.array().cast("array<double>")), (F.array(*texts) if texts else F.array().cast("array<string>"))


def _fit_one(rows: pd.DataFrame, width: tuple[int, int], continuous: bool, given: dict[str, str], rebalance: bool) -> Fitted:
    value = lambda option: option.value(given)
    rows = rows.sort_values("id", kind="stable")
    numbers, texts = _matrix(rows["numbers"], width[0], float), _matrix(rows["texts"], width[1], object)
    if continuous:
        kinds, y = [], rows["label"].to_numpy(float)
    else:
        if rebalance:
            numbers, texts, labels = booster.rebalance(numbers, texts, rows["label"].to_numpy(str))
        else:
            labels = rows["label"].to_numpy(str)
        found, y = np.unique(labels, return_inverse=True)
        kinds, y = [str(k) for k in found], y.astype(float)
    columns = booster.Columns(max(2, value(o.MAX_BIN)), value(o.SMALL_DOMAIN)).fit(numbers, texts)
    bins, weight = columns.transform(numbers, texts), np.ones(len(y))
    if kinds and value(o.CLASS_WEIGHT) == "balanced":
        sizes = np.bincount(y.astype(int))
        weight = (len(y) / (len(sizes) * sizes))[y.astype(int)]
    params = {"learning_rate": value(o.LEARNING_RATE), "max_depth": value(o.MAX_DEPTH) if value(o.MAX_DEPTH) > 0 else 8, "n_estimators": value(o.N_ESTIMATORS), "min_child": min(5, 1 + len(y) // 20), "min_split_gain": value(o.MIN_SPLIT_GAIN), "reg_alpha": value(o.REG_ALPHA), "column_share": 1.0}
    trials = 0
    if value(o.HP_MAX_EVALS) > 1 and len(y) >= 2 * value(o.N_SPLITS):
        params, trials = booster.search(params, len(kinds), bins, y, weight, value(o.HP_MAX_EVALS), value(o.N_SPLITS), value(o.HP_TIMEOUT), value(o.NO_PROGRESS))
    return Fitted(columns, booster.Booster(params, len(kinds)).fit(bins, y, weight), kinds, trials)


def fit_trees(df: DataFrame, row_id: str, targets: Iterable[str], features: dict[str, list[str]], continuous: Iterable[str], given: dict[str, str], parallel: bool, rebalance: bool) -> dict[str, TreeModel | PoorModel]:
    """A model of each target, from at most about MAX_TRAINING_ROWS of its known rows,
    chosen by a hash of their ids; all at once in as many tasks, or one after another."""
    ship_package(df.sparkSession)
    numeric, out = set(continuous), {}
    most = o.MAX_TRAINING_ROWS.value(given)
    names = list(targets)
    told = df.agg(*(f(col(y)).alias(f"{p}{i}") for i, y in enumerate(names) for p, f in (("a", F.min), ("b", F.max), ("n", F.count)))).first() if names else ()
    parts = []
    for i, y in enumerate(names):
        least, largest, n = told[3 * i : 3 * i + 3]
        if n == 0 or least == largest:
            out[y] = PoorModel(least)
            continue
        numbers, texts = _inputs(df, features[y])
        known = df.where(col(y).isNotNull())
        if n > most:
            known = known.where(F.pmod(F.xxhash64(col(row_id)), F.lit(1 << 30)) < int((1 << 30) * most / n))
        parts.append(known.select(F.lit(i).alias("target"), F.xxhash64(col(row_id)).alias("id"), numbers.alias("numbers"), texts.alias("texts"), col(y).cast("string").alias("label")))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        y = names[int(rows["target"].iloc[0])]
        fitted = _fit_one(rows, widths[y], y in numeric, given, rebalance)
        return pd.DataFrame({"target": [rows["target"].iloc[0]], "model": [pickle.dumps(fitted)]})

    widths = {y: _widths(df, features[y]) for y in names}
    jobs = [parts] if parallel else [[p] for p in parts]
    for job in jobs:
        if not job:
            continue
        rows = job[0]
        for p in job[1:]:
            rows = rows.unionByName(p)
        for r in rows.groupBy("target").applyInPandas(fit, "target int, model binary").collect():  # trees of each target
            y = names[r["target"]]
            out[y] = TreeModel(y, features[y], y in numeric, pickle.loads(r["model"]))
    return {y: out[y] for y in names}


def dependency_order(plain: Iterable[str], dependent: dict[str, str]) -> list[str]:
    """The targets without dependencies, then those whose determining column is done."""
    out, pending = list(plain), dict(dependent)
    while pending:
        ready = [y for y, x in pending.items() if x not in pending]
        if not ready:  # a cycle: none can wait for the others
            ready = [next(iter(pending))]
        for y in ready:
            out.append(y)
            del pending[y]
    return out
