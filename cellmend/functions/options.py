"""Options: textual values with a default, a type and a valid range."""

from __future__ import annotations

import logging
import os
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

logger = logging.getLogger("cellmend")


@dataclass(frozen=True)
class Option:
    """An option. `kind` makes the value of the text; `valid` tells good values."""

    key: str
    default: Any
    kind: type
    valid: Callable[[Any], bool] = lambda v: True
    says: str = ""

    def value(self, given: dict[str, str]) -> Any:
        """The given value; a bad one is an error in tests and the default otherwise."""
        if self.key not in given:
            return self.default
        text = given[self.key]
        try:
            value = self.kind(text)
        except ValueError:
            value, says = None, f"`{self.key}` is of {self.kind.__name__}, not '{text}'"
        else:
            if self.valid(value):
                return value
            says = f"`{self.key}` {self.says}, not {value}"
        if os.environ.get("SPARK_TESTING"):
            raise ValueError(says)
        logger.warning("%s; the default %s is used", says, self.default)
        return self.default


_ratio = lambda v: 0 <= v <= 1
_below_one = lambda v: 0 <= v < 1
_positive = lambda v: v > 0

ATTR_FREQ_RATIO = Option("error.attr_freq_ratio_threshold", 0.0, float, _ratio, "must be in [0.0, 1.0]")
PAIR_FREQ_RATIO = Option("error.pairwise_freq_ratio_threshold", 0.05, float, _ratio, "must be in [0.0, 1.0]")
MAX_PAIR_ATTRS = Option("error.max_attrs_to_compute_pairwise_stats", 3, int, lambda v: v >= 2, "must be greater than 1")
MAX_DOMAIN_ATTRS = Option("error.max_attrs_to_compute_domains", 2, int, lambda v: v >= 2, "must be greater than 1")
DOMAIN_ALPHA = Option("error.domain_threshold_alpha", 0.0, float, _below_one, "must be in [0.0, 1.0)")
DOMAIN_BETA = Option("error.domain_threshold_beta", 0.70, float, _below_one, "must be in [0.0, 1.0)")
ERROR_OPTIONS = (ATTR_FREQ_RATIO, PAIR_FREQ_RATIO, MAX_PAIR_ATTRS, MAX_DOMAIN_ATTRS, DOMAIN_ALPHA, DOMAIN_BETA)

MAX_TRAINING_ROWS = Option("model.max_training_row_num", 10000, int, lambda v: v >= 10, "must be greater than or equal to 10")
MAX_TRAINING_COLUMNS = Option("model.max_training_column_num", 65536, int, lambda v: v >= 2, "must be greater than 1")
SMALL_DOMAIN = Option("model.small_domain_threshold", 12, int, lambda v: v >= 3, "must be greater than 2")
NO_REGEX_RULE = Option("model.rule.repair_by_regex.disabled", True, bool)
NO_NEAREST_RULE = Option("model.rule.repair_by_nearest_values.disabled", True, bool)
MERGE_THRESHOLD = Option("model.rule.merge_threshold", 2.0, float)
NO_FD_RULE = Option("model.rule.repair_by_functional_deps.disabled", False, bool)
MAX_RULE_DOMAIN = Option("model.rule.max_domain_size", 1000, int, lambda v: v > 10, "must be greater than 10")
COST_WEIGHT = Option("repair.pmf.cost_weight", 0.1, float, _positive, "must be greater than 0")
PROB_THRESHOLD = Option("repair.pmf.prob_threshold", 0.0, float)
PROB_TOP_K = Option("repair.pmf.prob_top_k", 32, int, lambda v: v >= 3, "must be greater than 2")
#: This engine's own: how discrete columns are predicted, and the smoothing of counts.
ENGINE = Option("model.engine", "counting", str, lambda v: v in ("counting", "boosting"), "must be counting or boosting")
SMOOTHING = Option("model.counting.smoothing", 1.0, float, _positive, "must be greater than 0")

#: Of the boosted trees; what these don't have is taken and ignored.
LEARNING_RATE = Option("model.lgb.learning_rate", 0.1, float, _positive, "must be greater than 0")
MAX_DEPTH = Option("model.lgb.max_depth", 5, int)
MAX_BIN = Option("model.lgb.max_bin", 255, int)
MIN_SPLIT_GAIN = Option("model.lgb.min_split_gain", 0.0, float, lambda v: v >= 0, "must be greater than or equal to 0")
N_ESTIMATORS = Option("model.lgb.n_estimators", 30, int, _positive, "must be greater than 0")
CLASS_WEIGHT = Option("model.lgb.class_weight", "balanced", str)
N_SPLITS = Option("model.cv.n_splits", 3, int, lambda v: v >= 3, "must be greater than 2")
HP_TIMEOUT = Option("model.hp.timeout", 0, int)
HP_MAX_EVALS = Option("model.hp.max_evals", 1, int, _positive, "must be greater than 0")
REG_ALPHA = Option("model.lgb.reg_alpha", 0.0, float, lambda v: v >= 0, "must be greater than or equal to 0")
NO_PROGRESS = Option("model.hp.no_progress_loss", 50, int, _positive, "must be greater than 0")
IGNORED = (
    Option("model.lgb.boosting_type", "gbdt", str, lambda v: v in ("gbdt", "dart", "goss", "rf"), "must be in ['gbdt', 'dart', 'goss', 'rf']"),
    Option("model.lgb.importance_type", "gain", str, lambda v: v in ("split", "gain"), "must be in ['split', 'gain']"),
)
MODEL_OPTIONS = (
    MAX_TRAINING_ROWS, MAX_TRAINING_COLUMNS, SMALL_DOMAIN, NO_REGEX_RULE, NO_NEAREST_RULE, MERGE_THRESHOLD, NO_FD_RULE, MAX_RULE_DOMAIN, COST_WEIGHT, PROB_THRESHOLD, PROB_TOP_K, ENGINE, SMOOTHING,
    LEARNING_RATE, MAX_DEPTH, MAX_BIN, MIN_SPLIT_GAIN, N_ESTIMATORS, CLASS_WEIGHT, N_SPLITS, HP_TIMEOUT, HP_MAX_EVALS, REG_ALPHA, NO_PROGRESS, *IGNORED,
)
KEYS = {o.key for o in (*ERROR_OPTIONS, *MODEL_OPTIONS)}
