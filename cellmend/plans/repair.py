"""Detection and repair as a whole: the error model and the repair model.

The builder's setters check their arguments; `run` validates the mode, detects error cells,
prunes them by weak labels, clears them, and repairs them by rules and models. Everything is
composed of DataFrames. Error cells, the rows that hold them and what is predicted of them are
written to the shared folder where more than one plan uses them; nothing is persisted, and the
table itself is never copied.
"""

from __future__ import annotations

import logging
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellmend.functions import options as o
from cellmend.functions.costs import UpdateCostFunction
from cellmend.functions.names import col
from cellmend.operators import detectors as d
from cellmend.operators import domains, misc, models, rules, stats
from cellmend.plans.constraints import functional_dependencies
from cellmend.session import cut
from cellmend.sources.tables import check_input, need_columns, resolve

logger = logging.getLogger("cellmend")


def _is_list_of(values, kind: type, name: str) -> list:
    if not isinstance(values, list) or not all(isinstance(v, kind) for v in values):
        raise TypeError(f"`{name}` must be a list of {kind.__name__}")
    return list(values)


def _is(value, kind, name: str):
    kinds = kind if isinstance(kind, tuple) else (kind,)
    if not isinstance(value, kinds) or (isinstance(value, bool) and bool not in kinds):
        raise TypeError(f"`{name}` must be of {' or '.join(k.__name__ for k in kinds)}, not {type(value).__name__}")
    return value


def weighted_pmf(pmf: DataFrame, row_id: str, costs: UpdateCostFunction, weight: float) -> DataFrame:
    """Probabilities divided by one plus the weighted cost of the change, renormalised."""
    classes = F.transform("pmf", lambda x: x["class"])
    priced = pmf.withColumn("__costs", costs.columns(F.col("current_value"), classes))
    scaled = F.zip_with("pmf", "__costs", lambda x, c: F.struct(x["class"].alias("class"), (x["prob"] / (1.0 + weight * F.coalesce(c, F.lit(0.0)))).alias("prob")))
    applies = F.col("__costs").isNotNull()
    if costs.targets:
        applies &= F.col("attribute").isin(costs.targets)
    done = priced.withColumn("pmf", F.when(applies, scaled).otherwise(F.col("pmf"))).drop("__costs")
    total = F.aggregate("pmf", F.lit(0.0), lambda acc, x: acc + x["prob"])
    return done.withColumn("__total", total).withColumn("pmf", F.transform("pmf", lambda x: F.struct(x["class"].alias("class"), (x["prob"] / F.col("__total")).alias("prob")))).drop("__total")


def finished_pmf(pmf: DataFrame, row_id: str, threshold: float = 0.0, top_k: int = 32) -> DataFrame:
    """(row id, attribute, current_value struct, pmf): the current value with its own
    probability, and the candidates over the threshold by falling probability."""
    own = F.coalesce(F.get(F.transform(F.filter("pmf", lambda x: x["class"] == F.col("current_value")), lambda x: x["prob"]), F.lit(0)), F.lit(0.0))
    ordered = F.array_sort("pmf", models.falling("class", "prob"))
    return pmf.select(col(row_id), "attribute", F.struct(F.col("current_value").alias("value"), own.alias("prob")).alias("current_value"), F.slice(F.filter(ordered, lambda x: x["prob"] > threshold), 1, top_k).alias("pmf"))


def most_probable(pmf: DataFrame, row_id: str) -> DataFrame:
    """P5: (row id, attribute, current_value, repaired, prob)."""
    best = F.get("pmf", 0)
    return pmf.select(col(row_id), "attribute", F.col("current_value.value").alias("current_value"), best["class"].alias("repaired"), best["prob"].alias("prob"))


def repair_scores(pmf: DataFrame, row_id: str, costs: UpdateCostFunction) -> DataFrame:
    """(row id, attribute, current_value, repaired, score): the log odds of the repair
    against the current value, over one plus the cost of the change."""
    flat = pmf.select(col(row_id), "attribute", "current_value.value", "current_value.prob", F.get("pmf", 0).alias("best"))
    priced = flat.withColumn("__cost", costs.column(F.coalesce("value", F.col("best.class")), F.col("best.class")))
    odds = F.ln(F.col("best.prob") / F.when(F.col("prob") > 0, F.col("prob")).otherwise(F.lit(1e-6)))
    return priced.select(col(row_id), "attribute", F.col("value").alias("current_value"), F.col("best.class").alias("repaired"), (odds / (1.0 + F.coalesce("__cost", F.lit(256.0)))).alias("score"))


def best_scored(scores: DataFrame, delta: int, cells: int) -> DataFrame:
    """The repairs whose score is at least the percentile that leaves `delta` of them."""
    share = min(1.0, 1.0 - delta / max(1, cells))
    found = stats.quantiles(scores, {"score": F.col("score")}, [max(0.0, share)])["score"]
    return scores.where(F.col("score") >= F.lit(found[0])).drop("score") if found is not None else scores.limit(0).drop("score")


class ErrorModel:
    """Error cells, and the statistics by which false alarms among them are told."""

    def __init__(self, df: DataFrame, row_id: str, continuous: list[str], targets: Iterable[str] = (), discrete_threshold: int = 80, detectors: Iterable[d.ErrorDetector] = (), cells: DataFrame | None = None, options: dict[str, str] | None = None):
        self.df, self.row_id, self.continuous = df, row_id, continuous
        self.targets = [c for c in df.columns if c != row_id and (not list(targets) or c in set(targets))]
        self.discrete_threshold, self.given, self.options = discrete_threshold, cells, options or {}
        self.detectors = list(detectors)

    def noisy_cells(self) -> DataFrame:
        """All flagged cells with their current values."""
        if self.given is not None:
            return d.with_current_values(self.df, d.given_cells(self.given, self.row_id, self.targets), self.row_id)
        found = self.detectors or d.default_detectors(self.targets)
        return d.detect_all(self.df, self.row_id, found, self.continuous, self.targets)

    def detect(self) -> tuple[DataFrame, list[str], dict[str, list[tuple[str, float]]], dict[str, int], DataFrame | None]:
        """(error cells, repairable columns, entropies, domain sizes, discretized table)."""
        value = lambda option: option.value(self.options)
        cells = cut(self.noisy_cells())
        noisy = sorted(r[0] for r in cells.select("attribute").distinct().collect())  # as many as columns
        if not noisy:
            return cells, [], {}, {}, None
        discrete, sizes = stats.discretize(self.df, self.row_id, self.discrete_threshold)
        usable = [c for c in noisy if c in discrete.columns]
        if not usable:
            return cells, [], {}, sizes, discrete
        kept_sizes = {c: sizes[c] for c in discrete.columns if c != self.row_id}
        pairs = stats.candidate_pairs(discrete, usable, kept_sizes, value(o.PAIR_FREQ_RATIO), value(o.MAX_PAIR_ATTRS))
        entropies = {y: [] for y in usable} | stats.conditional_entropies(discrete, pairs, kept_sizes, value(o.ATTR_FREQ_RATIO))
        if self.given is None:
            correlated = {y: [x for x, _ in xs[: value(o.MAX_DOMAIN_ATTRS)]] for y, xs in entropies.items()}
            found = domains.cell_domains(discrete, cells.where(F.col("attribute").isin(usable)), self.row_id, correlated, kept_sizes, self.continuous, value(o.DOMAIN_ALPHA), value(o.DOMAIN_BETA), value(o.ATTR_FREQ_RATIO))
            cells = cut(domains.without_cells(cells, domains.weak_labels(found, self.row_id), self.row_id))
        return cells, usable, entropies, sizes, discrete


class RepairModel:
    """The builder of a repair run."""

    def __init__(self) -> None:
        self.db_name = ""
        self.input: str | DataFrame | None = None
        self.row_id: str | None = None
        self.targets: list[str] = []
        self.error_cells: str | DataFrame | None = None
        self.error_detectors: list[d.ErrorDetector] = []
        self.discrete_threshold = 80
        self.parallel = False
        self.rebalancing = False
        self.by_rules = False
        self.repair_delta: int | None = None
        self.cf: UpdateCostFunction | None = None
        self.opts: dict[str, str] = {}

    # Setters; the names are those that users of such models know.

    def setDbName(self, db_name: str) -> RepairModel:  # noqa: N802
        if isinstance(self.input, DataFrame):
            raise ValueError("A DataFrame as input has no database")
        self.db_name = _is(db_name, str, "db_name")
        return self

    def setTableName(self, table_name: str) -> RepairModel:  # noqa: N802
        self.input = _is(table_name, str, "table_name")
        return self

    def setInput(self, input: str | DataFrame) -> RepairModel:  # noqa: N802, A002
        self.input = _is(input, (str, DataFrame), "input")
        if isinstance(input, DataFrame):
            self.db_name = ""
        return self

    def setRowId(self, row_id: str) -> RepairModel:  # noqa: N802
        self.row_id = _is(row_id, str, "row_id")
        return self

    def setTargets(self, targets: list[str]) -> RepairModel:  # noqa: N802
        self.targets = _is_list_of(targets, str, "targets")
        if not targets:
            raise ValueError("`targets` must name a column")
        return self

    def setErrorCells(self, error_cells: str | DataFrame) -> RepairModel:  # noqa: N802
        if self.row_id is None:
            raise ValueError("Error cells need `setRowId` first")
        _is(error_cells, (str, DataFrame), "error_cells")
        cells = resolve(SparkSession.active(), error_cells)
        if not {self.row_id, "attribute"} <= set(cells.columns):
            raise ValueError(f"Error cells need the columns `{self.row_id}` and `attribute`")
        self.error_cells = error_cells
        return self

    def setErrorDetectors(self, detectors: list[d.ErrorDetector]) -> RepairModel:  # noqa: N802
        self.error_detectors = _is_list_of(detectors, d.ErrorDetector, "detectors")
        return self

    def setDiscreteThreshold(self, thres: int) -> RepairModel:  # noqa: N802
        if _is(thres, int, "thres") < 2:
            raise ValueError(f"`thres` must be 2 or more, not {thres}")
        self.discrete_threshold = thres
        return self

    def setParallelStatTrainingEnabled(self, enabled: bool) -> RepairModel:  # noqa: N802
        self.parallel = _is(enabled, bool, "enabled")
        return self

    def setTrainingDataRebalancingEnabled(self, enabled: bool) -> RepairModel:  # noqa: N802
        self.rebalancing = _is(enabled, bool, "enabled")
        return self

    def setRepairByRules(self, enabled: bool) -> RepairModel:  # noqa: N802
        self.by_rules = _is(enabled, bool, "enabled")
        return self

    def setRepairDelta(self, delta: int) -> RepairModel:  # noqa: N802
        if _is(delta, int, "delta") <= 0:
            raise ValueError(f"The repair delta must be 1 or more, not {delta}")
        self.repair_delta = delta
        return self

    def setUpdateCostFunction(self, cf: UpdateCostFunction) -> RepairModel:  # noqa: N802
        self.cf = _is(cf, UpdateCostFunction, "cf")
        return self

    def option(self, key: str, value: str) -> RepairModel:
        _is(key, str, "key")
        _is(value, str, "value")
        if key not in o.KEYS:
            raise ValueError(f"There is no option '{key}'")
        self.opts[key] = value
        return self

    def _value(self, option: o.Option):
        return option.value(self.opts)

    @property
    def _nearest(self) -> bool:
        return self.by_rules and self.cf is not None and not self._value(o.NO_NEAREST_RULE)

    def run(self, detect_errors_only: bool = False, compute_repair_candidate_prob: bool = False, compute_repair_prob: bool = False, compute_repair_score: bool = False, repair_data: bool = False, maximal_likelihood_repair: bool = False) -> DataFrame:
        """Error cells, updates, probabilities, scores or the repaired table (P10)."""
        if self.input is None or self.row_id is None:
            raise ValueError("A run needs `setInput` and `setRowId` first")
        if maximal_likelihood_repair:
            if self.repair_delta is None:
                raise ValueError("Maximal likelihood needs `setRepairDelta`")
            if self.cf is None:
                raise ValueError("Maximal likelihood needs `setUpdateCostFunction`")
            if self.cf.targets:
                raise ValueError("Maximal likelihood needs costs of all columns, not of `targets` only")
        modes = {"detect_errors_only": detect_errors_only, "compute_repair_candidate_prob": compute_repair_candidate_prob, "compute_repair_prob": compute_repair_prob, "compute_repair_score": compute_repair_score, "repair_data": repair_data}
        chosen = [k for k, on in modes.items() if on]
        if len(chosen) > 1:
            raise ValueError("A run has one mode, not " + " and ".join(chosen))
        if self._nearest and (maximal_likelihood_repair or compute_repair_candidate_prob or compute_repair_prob or compute_repair_score):
            raise ValueError("Nearest values have neither probabilities nor scores")
        if compute_repair_score and self.cf is None:
            raise ValueError("Scores need `setUpdateCostFunction`")
        likely = maximal_likelihood_repair or compute_repair_score
        df = resolve(SparkSession.active(), self.input, self.db_name)
        name = self.input if isinstance(self.input, str) else "input"
        continuous = check_input(df, self.row_id, name)
        if likely and continuous:
            raise ValueError("Maximal likelihood is for discrete columns only")
        if self.targets and not set(self.targets) & set(df.columns):
            raise ValueError(f"{name} has none of the targets {', '.join(self.targets)}")
        return self._run(df, continuous, detect_errors_only, compute_repair_candidate_prob or compute_repair_prob, compute_repair_prob, compute_repair_score, repair_data, likely)

    def _run(self, df: DataFrame, continuous: list[str], detect_only: bool, with_pmf: bool, best_only: bool, scores_only: bool, whole: bool, likely: bool) -> DataFrame:
        row_id = self.row_id
        given = resolve(SparkSession.active(), self.error_cells) if self.error_cells is not None else None
        errors = ErrorModel(df, row_id, continuous, self.targets, self.discrete_threshold, self.error_detectors, given, self.opts)
        cells, targets, entropies, sizes, discrete = errors.detect()
        if detect_only:
            return cells
        n_cells = cells.count()
        if n_cells == 0:
            return df if whole else cells.withColumn("repaired", F.lit(None).cast("string")).limit(0)
        if not targets:
            raise ValueError("None of the columns with errors can be repaired: they need 2 to `setDiscreteThreshold` values, or numbers")
        cells = cut(domains.of_columns(cells, targets))
        n_cells = cells.count()
        base = domains.repair_base(df, cells, row_id, targets, "__dirty")
        by_rule = None
        if self.by_rules:
            cells, by_rule = self._by_rules(base, cells, targets)
            if by_rule is not None:
                by_rule = cut(by_rule)
                base = misc.apply_updates(by_rule, base, row_id)
        # The mark saves two joins by row id. Rows that rules have mended stay among the dirty
        # ones, where nothing is left to fill.
        clean, dirty = (base.where(F.col("__dirty") == x).drop("__dirty") for x in (False, True))
        base, dirty = base.drop("__dirty"), cut(dirty)
        pmf, filled = self._predicted(base, dirty, cells, targets, continuous, entropies, sizes, discrete)
        if with_pmf and not likely:
            done = finished_pmf(pmf(), row_id, self._value(o.PROB_THRESHOLD), self._value(o.PROB_TOP_K))
            numbers = [c for c in targets if c in continuous]
            if numbers:
                done = done.where(~F.col("attribute").isin(numbers)).unionByName(self._sure(filled(), cells, numbers))
            return most_probable(done, row_id) if best_only else done.withColumn("current_value", F.col("current_value.value"))
        if likely:
            scores = repair_scores(finished_pmf(pmf(), row_id, self._value(o.PROB_THRESHOLD), self._value(o.PROB_TOP_K)), row_id, self.cf)
            if scores_only:
                return scores
            best = best_scored(cut(scores), self.repair_delta, n_cells)
            if not whole:
                return best
            return misc.apply_updates(best, df, row_id)  # cells that aren't chosen keep their values
        if whole:
            return clean.unionByName(filled())
        flat = misc.flatten(filled(), row_id).select(col(row_id).alias("__id"), F.col("attribute").alias("__a"), F.col("value").alias("repaired"))
        joined = cells.join(flat, (col(row_id) == F.col("__id")) & (F.col("attribute") == F.col("__a"))).select(col(row_id), "attribute", "current_value", "repaired")
        changed = joined.where(F.col("repaired").isNull() | ~F.col("current_value").eqNullSafe(F.col("repaired")))
        return changed.union(by_rule.select(*changed.columns)) if by_rule is not None else changed

    def _sure(self, filled: DataFrame, cells: DataFrame, numbers: list[str]) -> DataFrame:
        """Predictions of continuous columns, as the only candidates."""
        flat = misc.flatten(filled, self.row_id).select(col(self.row_id).alias("__id"), F.col("attribute").alias("__a"), "value")
        found = cells.where(F.col("attribute").isin(numbers)).join(flat, (col(self.row_id) == F.col("__id")) & (F.col("attribute") == F.col("__a")))
        return found.select(col(self.row_id), "attribute", F.struct(F.col("current_value").alias("value"), F.lit(0.0).alias("prob")).alias("current_value"), F.array(F.struct(F.col("value").alias("class"), F.lit(1.0).alias("prob"))).alias("pmf"))

    def _by_rules(self, base: DataFrame, cells: DataFrame, targets: list[str]) -> tuple[DataFrame, DataFrame | None]:
        """U4: repairs by structure, then by nearest values."""
        found = []
        if not self._value(o.NO_REGEX_RULE):
            regexes = [(x.attr, x.regex) for x in self.error_detectors if isinstance(x, d.RegExErrorDetector)]
            cells, repaired = rules.by_regexes(cells, self.row_id, regexes)
            found += [repaired] if repaired is not None else []
        if self._nearest:
            cells, repaired = rules.by_nearest(base, cells, self.row_id, targets, self.cf, self._value(o.MERGE_THRESHOLD))
            found += [repaired] if repaired is not None else []
        return cells, reduce(DataFrame.unionByName, found) if found else None

    def _dependencies(self, df: DataFrame, targets: list[str], sizes: dict[str, int]) -> dict[str, str]:
        """The determining column of each target that a constraint gives one."""
        found = [x for x in self.error_detectors if isinstance(x, d.ConstraintErrorDetector)]
        if not self.by_rules or self._value(o.NO_FD_RULE) or len(found) != 1:
            return {}
        found[0].df = found[0].df or df
        most = self._value(o.MAX_RULE_DOMAIN)
        out = {}
        for y, xs in functional_dependencies(found[0].parsed(), targets).items():
            small = [x for x in xs if sizes.get(x, most) < most]
            if small:
                out[y] = small[0]
        return out

    def _predicted(self, base: DataFrame, dirty: DataFrame, cells: DataFrame, targets: list[str], continuous: list[str], entropies, sizes, discrete: DataFrame):
        """Functions that give the probabilities of all cells, and the dirty rows filled."""
        row_id = self.row_id
        dependent = self._dependencies(base, targets, sizes)
        numbers = [y for y in targets if y in continuous and y not in dependent]
        names = [y for y in targets if y not in continuous and y not in dependent]
        columns = [c for c in discrete.columns if c != row_id]
        features = {y: models.select_features(y, columns, entropies.get(y, []), self._value(o.MAX_TRAINING_COLUMNS)) for y in targets}
        counting = self._value(o.ENGINE) == "counting"
        cache: dict[str, object] = {}

        def tables() -> DataFrame:
            if "discrete" not in cache:
                cache["discrete"] = _binned(base, discrete, row_id, targets)
            return cache["discrete"]

        def counted() -> models.CountingModel:
            if "model" not in cache:
                cache["model"] = models.fit_counting(tables(), names, features, self._value(o.SMOOTHING), self.rebalancing)
            return cache["model"]

        def trees(ys: list[str]) -> dict:
            key = ",".join(ys)
            if key not in cache:
                cache[key] = models.fit_trees(base, row_id, ys, features, continuous, self.opts, self.parallel, self.rebalancing)
            return cache[key]

        def chained(rows: DataFrame, own: DataFrame, one) -> list[DataFrame]:
            """The probabilities of cells `own` of `rows` by target, each from the rows in which
            those before are filled with their best values."""
            parts = []
            for y in names:
                found = cut(one(y, rows, own.where(F.col("attribute") == y)))
                parts.append(found)
                best = found.select(col(row_id).alias("__id"), F.get("pmf", 0)["class"].alias("__best"))
                rows = cut(rows.join(best, col(row_id) == F.col("__id"), "left").select(*(F.coalesce(col(c), F.col("__best").cast(rows.schema[c].dataType)).alias(c) if c == y else col(c) for c in rows.columns)))
            return parts

        def of_trees(y: str, rows: DataFrame, own: DataFrame) -> DataFrame:
            model = trees(names)[y]
            met = own.join(rows.withColumnRenamed(row_id, "__id"), col(row_id) == F.col("__id"))
            if isinstance(model, models.PoorModel):
                value = F.lit(model.value).cast("string")
                pmf = F.when(value.isNotNull(), F.array(F.struct(value.alias("class"), F.lit(1.0).alias("prob")))).otherwise(F.array().cast("array<struct<class: string, prob: double>>"))
                return met.select(col(row_id), "attribute", "current_value", pmf.alias("pmf"))
            return model.predict(met).select(col(row_id), "attribute", "current_value", F.col("__pmf").alias("pmf"))

        def pmf_of(ys: list[str]) -> DataFrame | None:
            if not ys:
                return None
            if "pmf" not in cache:
                own = cells.where(F.col("attribute").isin(names)).select(col(row_id), "attribute", "current_value")
                if not counting:
                    cache["pmf"] = domains.union_all(chained(dirty, own, of_trees))
                elif len(names) == 1:
                    cache["pmf"] = counted().pmf(tables(), own, row_id)
                else:
                    # Rows of one error are predicted together; those of several, target by target.
                    several = own.groupBy(col(row_id)).agg(F.count("*").alias("n")).where("n > 1").select(col(row_id))
                    rows = tables().join(several, row_id, "left_semi")
                    first = counted().pmf(tables(), own.join(several, row_id, "left_anti"), row_id)
                    later = chained(rows, own.join(several, row_id, "left_semi"), lambda y, r, c: counted().pmf(r, c, row_id))
                    cache["pmf"] = domains.union_all([first, *later])
            return cache["pmf"]

        def statistical() -> DataFrame:
            out = dirty
            found = pmf_of(names) if names else None
            if found is not None:
                best = found.select(col(row_id), "attribute", F.get("pmf", 0)["class"].alias("repaired"))
                out = misc.apply_updates(best, out, row_id)
            for model_y, model in trees(numbers).items() if numbers else ():
                out = model.fill(out, model_y)
            return out

        def filled() -> DataFrame:
            out = statistical()
            for y in models.dependency_order([], dependent):
                out = rules.by_dependency(out, dependent[y], y, rules.dependency_values(base, dependent[y], y))
            return out

        def pmf() -> DataFrame:
            found = pmf_of(names)
            parts = [weighted_pmf(found, row_id, self.cf, self._value(o.COST_WEIGHT)) if self.cf is not None else found] if found is not None else []
            if dependent:
                flat = misc.flatten(filled(), row_id).select(col(row_id).alias("__id"), F.col("attribute").alias("__a"), "value")
                own = cells.where(F.col("attribute").isin(list(dependent))).join(flat, (col(row_id) == F.col("__id")) & (F.col("attribute") == F.col("__a")))
                sure = F.when(F.col("value").isNotNull(), F.array(F.struct(F.col("value").alias("class"), F.lit(1.0).alias("prob")))).otherwise(F.expr("cast(array() as array<struct<class: string, prob: double>>)"))
                parts.append(own.select(col(row_id), "attribute", "current_value", sure.alias("pmf")))
            if not parts:
                schema = T.StructType([base.schema[row_id], *T.StructType.fromDDL("attribute string, current_value string, pmf array<struct<class: string, prob: double>>").fields])
                return base.sparkSession.createDataFrame([], schema)
            return domains.union_all(parts)

        return pmf, filled


def _binned(base: DataFrame, discrete: DataFrame, row_id: str, targets: list[str]) -> DataFrame:
    """The discretized table with the cells null that are null in the base, and its rules'
    repairs: text columns are the base's, binned ones the table's."""
    bins = [c for c, kind in discrete.dtypes if c != row_id and dict(base.dtypes)[c] != "string"]
    texts = [c for c in discrete.columns if c != row_id and c not in bins]
    if not bins:
        return base.select(col(row_id), *(col(c) for c in texts))
    left = base.select(col(row_id), *(col(c) for c in texts), *(col(c).isNull().alias(f"__null_{i}") for i, c in enumerate(bins)))
    right = discrete.select(col(row_id).alias("__id"), *(col(c).alias(f"__bin_{i}") for i, c in enumerate(bins)))
    joined = left.join(right, col(row_id) == F.col("__id"))
    return joined.select(col(row_id), *(F.when(~F.col(f"__null_{bins.index(c)}"), F.col(f"__bin_{bins.index(c)}")).alias(c) if c in bins else col(c) for c in discrete.columns if c != row_id))
