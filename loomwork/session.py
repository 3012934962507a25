"""Sessions: statements in, DataFrames out; transactions over versioned tables.

Reads see the newest committed versions, or within a transaction those of its
first touch with the session's own changes. A statement that fails changes
nothing. COMMIT makes the new versions of all changed tables at once, unless another
writer changed one of them since; then it changes none.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .errors import AnalysisFailure, EngineError
from .operators import dml, knn
from .plans import planner
from .plans.statements import Control, CreateTable, Delete, Insert, Nearest, Select, Update, parse
from .sources.external import parquet, widened
from .sources.store import Store, Version


@dataclass
class _Staged:
    base: int
    version: Version
    changed: bool = False


@dataclass
class Session:
    """A connection. root: the folder of the versioned tables; without one there are only registered tables."""

    spark: SparkSession
    root: str | None = None
    coerce_numeric: bool = False
    _views: dict[str, DataFrame] = field(default_factory=dict)
    _ties: dict[str, list[str]] = field(default_factory=dict)
    _staged: dict[str, _Staged] | None = None

    def __post_init__(self):
        self.store = Store(self.spark, self.root) if self.root else None

    # registered, read-only tables

    def register(self, name: str, df: DataFrame, order: list[str] | None = None) -> None:
        """A read-only table; order: columns that break ties of ORDER BY, a unique key as a rule."""
        self._views[name] = widened(df)
        self._ties[name] = order or []

    def register_parquet(self, name: str, path: str, order: list[str] | None = None) -> None:
        self._views[name] = parquet(self.spark, path)
        self._ties[name] = order or []

    # tables

    def tables(self) -> list[str]:
        staged = [t for t, s in (self._staged or {}).items() if s.changed]
        return sorted({*self._views, *(self.store.tables() if self.store else []), *staged})

    def table(self, name: str) -> DataFrame:
        """The table's rows; versioned ones with the hidden order column."""
        if name in self._views:
            return self._views[name]
        return self._need_store().read(name, self._version(name).version)

    def _need_store(self) -> Store:
        if self.store is None:
            raise AnalysisFailure("this session has no folder for tables")
        return self.store

    def _version(self, name: str) -> _Staged:
        if self._staged is not None and name in self._staged:
            return self._staged[name]
        if self.store is None:
            raise AnalysisFailure(f"table {name} not found")
        version = self.store.version(name)
        out = _Staged(version.number, version)
        if self._staged is not None:
            self._staged[name] = out
        return out

    # statements

    def sql(self, text: str) -> DataFrame:
        """Run a statement. Only SELECT gives rows; other statements give an empty DataFrame without columns."""
        statement = parse(text)
        if isinstance(statement, Select):
            return planner.select(self.table(statement.table), statement, self._ties.get(statement.table))
        if isinstance(statement, Nearest):
            return knn.nearest_statement(self.table(statement.table), statement, self._ties.get(statement.table))
        if isinstance(statement, Control):
            {"BEGIN": self.begin, "COMMIT": self.commit, "ROLLBACK": self.rollback}[statement.word]()
        elif isinstance(statement, CreateTable):
            self._create(statement)
        else:
            self._change(statement)
        return self.spark.createDataFrame([], T.StructType([]))

    def _create(self, statement: CreateTable) -> None:
        store, name = self._need_store(), statement.table
        if name in self.tables():
            raise AnalysisFailure(f"table {name} already exists")
        version = dml.create(statement, self.spark.conf.get("spark.sql.caseSensitive") == "true")
        if self._staged is None:
            store.commit({name: (version, -1)})
        else:
            self._staged[name] = _Staged(-1, version, True)

    def _change(self, statement: Insert | Update | Delete) -> None:
        if statement.table in self._views:
            raise AnalysisFailure(f"table {statement.table} is read-only")
        now = self._version(statement.table)
        store = self._need_store()
        if isinstance(statement, Insert):
            new = dml.insert(store, now.version, statement, self.coerce_numeric)
        elif isinstance(statement, Update):
            new = dml.update(store, now.version, statement, self.coerce_numeric)
        else:
            new = dml.delete(store, now.version, statement)
        self._put(statement.table, now, new)

    def append(self, table: str, rows: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """Add all rows of a DataFrame, with the same checks as INSERT, set by set.

        batch: a stream's name and the number of its batch, which is added once:
        if the table has that batch or a later one, nothing happens.
        """
        now = self._version(table)
        done = dict(now.version.streams)
        if batch and done.get(batch[0], -1) >= batch[1]:
            return
        new = dml.append(self._need_store(), table, now.version, rows)
        self._put(table, now, replace(new, streams=tuple((done | dict([batch])).items())) if batch else new)

    def compact(self, table: str) -> None:
        now = self._version(table)
        self._put(table, now, dml.compact(self._need_store(), table, now.version))

    def _put(self, table: str, now: _Staged, new: Version) -> None:
        if new is now.version:
            return
        if self._staged is None:
            self._need_store().commit({table: (new, now.base)})
        else:
            now.version, now.changed = new, True

    # transactions

    def begin(self) -> None:
        if self._staged is not None:
            raise EngineError("a transaction is open already")
        self._staged = {}

    def commit(self) -> None:
        if self._staged is None:
            raise EngineError("no transaction is open")
        staged, self._staged = self._staged, None
        changes = {name: (s.version, s.base) for name, s in staged.items() if s.changed}
        if changes:
            self._need_store().commit(changes)

    def rollback(self) -> None:
        if self._staged is None:
            raise EngineError("no transaction is open")
        self._staged = None
