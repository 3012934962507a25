"""Changes to versioned tables: each takes a version and gives the next one, not yet committed."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import AnalysisFailure, ConstraintFailure
from ..plans.planner import SEQ, field_of, holds, quoted
from ..plans.statements import CreateTable, Delete, Insert, Update
from ..sources.store import Store, Version
from ..types import check_storable, sql_type


def create(statement: CreateTable, case_sensitive: bool = False) -> Version:
    """The table's first version. Names that differ only in case need a session with spark.sql.caseSensitive."""
    names = [c.name for c in statement.columns]
    if len(set(names)) < len(names):
        raise AnalysisFailure("a column name is given twice")
    if not case_sensitive and len({n.lower() for n in names}) < len(names):
        raise AnalysisFailure("column names differ only in case, and spark.sql.caseSensitive is off")
    if SEQ in names:
        raise AnalysisFailure(f"column name {SEQ} is reserved")
    key = next((c.name for c in statement.columns if c.primary_key), None)
    return Version(-1, tuple((c.name, c.kind) for c in statement.columns), key)


def _no_null_key(key: str, value: object) -> None:
    if value is None:
        raise ConstraintFailure(f"primary key {key} cannot be NULL")


def insert(store: Store, version: Version, statement: Insert, coerce_numeric: bool = False) -> Version:
    """One row of literals. The key is looked up with a filter that Parquet's statistics can answer."""
    if len(statement.values) != len(version.columns):
        raise AnalysisFailure(f"{len(version.columns)} values expected, {len(statement.values)} given")
    row = [check_storable(n, k, v, coerce_numeric) for (n, k), v in zip(version.columns, statement.values)]
    if version.key:
        value = row[[n for n, _ in version.columns].index(version.key)]
        _no_null_key(version.key, value)
        if not store.read(statement.table, version).where(quoted(version.key) == F.lit(value)).isEmpty():
            raise ConstraintFailure(f"duplicate primary key {value!r}")
    df = store.spark.createDataFrame([(*row, version.next_seq)], version.schema()).coalesce(1)
    return replace(version, files=version.files + store.write(statement.table, df, version), next_seq=version.next_seq + 1)


def append(store: Store, table: str, version: Version, rows: DataFrame) -> Version:
    """All rows of a DataFrame with the table's columns, by name.

    Only the new keys are looked up in the table. The rows get increasing places
    in the order of insertion, with gaps between tasks.
    """
    names = [n for n, _ in version.columns]
    if sorted(rows.columns) != sorted(names):
        raise AnalysisFailure(f"columns {sorted(names)} expected, {sorted(rows.columns)} given")
    for name, kind in version.columns:
        if sql_type(field_of(rows, name)) != kind:
            raise AnalysisFailure(f"type mismatch: column {name} is {kind}")
    rows = rows.select(*[quoted(n).cast(version.schema()[n].dataType).alias(n) for n in names])
    if version.key:
        key = quoted(version.key)
        if not rows.where(key.isNull()).isEmpty():
            raise ConstraintFailure(f"primary key {version.key} cannot be NULL")
        twice = rows.groupBy(key).count().where("count > 1")
        known = store.read(table, version).join(rows.select(key), version.key, "left_semi") if version.files else None
        bad = next((r for d in (twice, known) if d is not None for r in d.take(1)), None)
        if bad is not None:
            raise ConstraintFailure(f"duplicate primary key {bad[version.key]!r}")
    numbered = rows.withColumn(SEQ, F.monotonically_increasing_id() + version.next_seq)
    files = store.write(table, numbered, version)
    last = store.read(table, version, files).agg(F.max(SEQ)).first()[0] if files else None
    return replace(version, files=version.files + files, next_seq=version.next_seq if last is None else last + 1)


def _rewritten(store: Store, table: str, version: Version, where: object, change) -> Version:
    """The version with change applied to all rows of those files that hold a matching row; other files are kept."""
    df = store.read(table, version)
    condition = holds(df, where)
    hit = store.files_with(table, version, condition)
    if not hit:
        return version
    rows = change(store.read(table, version, hit), condition)
    kept = tuple(f for f in version.files if f not in set(hit))
    return replace(version, files=kept + store.write(table, rows, version))


def update(store: Store, version: Version, statement: Update, coerce_numeric: bool = False) -> Version:
    kinds, table = version.kinds, statement.table
    for name in statement.changes:
        if name not in kinds:
            raise AnalysisFailure(f"column {name} not found")
    values = {n: check_storable(n, kinds[n], v, coerce_numeric) for n, v in statement.changes.items()}

    def change(rows: DataFrame, condition) -> DataFrame:
        schema = version.schema()
        new = {n: F.when(condition, F.lit(v).cast(schema[n].dataType)).otherwise(quoted(n)) for n, v in values.items()}
        return rows.withColumns(new)

    if version.key in values:
        df = store.read(table, version)
        matching = df.where(holds(df, statement.where))
        hit = matching.limit(1).count()
        if hit:
            value = values[version.key]
            _no_null_key(version.key, value)
            # the key's rows afterwards: the matching ones, and those that have it and don't match
            others = df.where(~holds(df, statement.where) & (quoted(version.key) == F.lit(value)))
            if matching.limit(2).count() > 1 or not others.isEmpty():
                raise ConstraintFailure(f"duplicate primary key {value!r}")
    return _rewritten(store, table, version, statement.where, change)


def delete(store: Store, version: Version, statement: Delete) -> Version:
    return _rewritten(store, statement.table, version, statement.where, lambda rows, condition: rows.where(~condition))


def compact(store: Store, table: str, version: Version, rows_per_file: int = 5_000_000) -> Version:
    """The same rows in few files with ranges of the key (or of the order of insertion) apart, so that lookups read few."""
    df = store.read(table, version)
    n = df.count()
    by = quoted(version.key) if version.key else quoted(SEQ)
    dealt = df.repartitionByRange(max(1, -(-n // rows_per_file)), by)
    return replace(version, files=store.write(table, dealt, version))


def key_violations(df: DataFrame, key: str) -> DataFrame:
    """Keys that stand more than once or are NULL, with the number of their rows."""
    return df.groupBy(quoted(key)).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | quoted(key).isNull())
