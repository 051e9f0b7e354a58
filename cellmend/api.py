"""The entry object (M11): repairs, helpers and the version."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cellmend.operators import depgraph, misc
from cellmend.plans.repair import RepairModel
from cellmend.sources.tables import need_columns, resolve

VERSION = "0.1.0"


class RepairMisc:
    """Helpers that take their settings as options (text)."""

    def __init__(self) -> None:
        self.opts: dict[str, str] = {}

    def option(self, key: str, value: str | DataFrame) -> RepairMisc:
        self.opts[str(key)] = value
        return self

    def options(self, options: dict[str, str]) -> RepairMisc:
        for k, v in options.items():
            self.option(k, v)
        return self

    def _need(self, *keys: str) -> list:
        missing = [k for k in keys if k not in self.opts]
        if missing:
            raise ValueError(f"These options are needed: {', '.join(missing)}")
        return [self.opts[k] for k in keys]

    def _number(self, key: str, default, kind: Callable = int):
        try:
            return kind(self.opts[key]) if key in self.opts else default
        except ValueError:
            raise ValueError(f"Option '{key}' is a number, not '{self.opts[key]}'") from None

    def _flag(self, key: str) -> bool:
        return str(self.opts.get(key, "")).lower() in ("true", "1", "yes")

    def _table(self, name: str | None = None) -> DataFrame:
        return resolve(SparkSession.active(), name if name is not None else self.opts["table_name"], "" if name is not None else self.opts.get("db_name", ""))

    def _targets(self, df: DataFrame, *without: str) -> list[str]:
        given = [t.strip() for t in self.opts.get("target_attr_list", "").split(",") if t.strip()]
        need_columns(df, *given)
        return given or [c for c in df.columns if c not in without]

    def repair(self) -> DataFrame:
        """M3: the table with repair updates applied."""
        updates, _, row_id = self._need("repair_updates", "table_name", "row_id")
        return misc.apply_updates(self._table(updates), self._table(), row_id)

    def describe(self) -> DataFrame:
        """M2: a profile of each column."""
        self._need("table_name")
        return misc.describe(self._table(), self._number("num_bins", 8))

    def flatten(self) -> DataFrame:
        """M1: a row for each cell."""
        _, row_id = self._need("table_name", "row_id")
        return misc.flatten(self._table(), row_id)

    def splitInputTable(self) -> DataFrame:  # noqa: N802
        """M4: clusters of similar rows."""
        _, row_id, k = self._need("table_name", "row_id", "k")
        if not str(k).isdigit():
            raise ValueError(f"Option 'k' is an integer, not '{k}'")
        df = self._table()
        return misc.split_input(df, row_id, int(k), self._targets(df, row_id), self._number("q", 2), self.opts.get("clustering_alg", "bisect-kmeans"))

    def injectNull(self) -> DataFrame:  # noqa: N802
        """M6: the table with some cells null."""
        self._need("table_name", "target_attr_list")
        df = self._table()
        return misc.inject_null(df, self._targets(df), self._number("null_ratio", 0.01, float), self._number("seed", None))

    def toHistogram(self) -> DataFrame:  # noqa: N802
        """M7: the values of text columns and their counts."""
        _, targets = self._need("table_name", "targets")
        names = [t.strip() for t in targets.split(",") if t.strip()]
        df = self._table()
        need_columns(df, *names)
        return misc.histograms(df, names)

    def toErrorMap(self) -> DataFrame:  # noqa: N802
        """M8: a line of marks for each row."""
        _, row_id, cells = self._need("table_name", "row_id", "error_cells")
        return misc.error_map(self._table(), self._table(cells), row_id)

    def generateDepGraph(self) -> None:  # noqa: N802
        """M9: a graph of dependent values, written to a folder."""
        path, _ = self._need("path", "table_name")
        df = self._table()
        text = depgraph.dependency_graph(df, self._targets(df), self._number("max_domain_size", 100), self._number("max_attr_value_num", 30), self._number("max_attr_value_length", 70), self._number("pairwise_attr_corr_threshold", 1.0, float), self._flag("edge_label"))
        depgraph.write_graph(text, path, self.opts.get("image_format", "svg"), self.opts.get("filename_prefix", "depgraph"), self._flag("overwrite"))


class Mender:
    """The one object of a session's repairs; each access makes a new builder."""

    _instance: Mender | None = None

    def __new__(cls) -> Mender:
        if cls._instance is None:
            cls._instance = super().__new__(cls)
        return cls._instance

    @staticmethod
    def getOrCreate() -> Mender:  # noqa: N802
        return Mender()

    @property
    def repair(self) -> RepairModel:
        return RepairModel()

    @property
    def misc(self) -> RepairMisc:
        return RepairMisc()

    @staticmethod
    def version() -> str:
        return VERSION


mender = Mender.getOrCreate()

