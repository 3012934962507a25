"""Statements onto DataFrames. Names and types are checked before anything runs."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import AnalysisFailure
from ..types import check_comparable, sql_type
from .statements import Both, Compare, Either, IsNull, Select

#: Hidden column with the order of insertion.
SEQ = "_seq"
OPS = {"=": Column.__eq__, "!=": Column.__ne__, "<": Column.__lt__, ">": Column.__gt__, "<=": Column.__le__, ">=": Column.__ge__}


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def visible(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != SEQ]


def field_of(df: DataFrame, name: str):
    """The column's type; column names are case-sensitive whatever the session's setting."""
    found = next((f for f in df.schema.fields if f.name == name and name != SEQ), None)
    if found is None:
        raise AnalysisFailure(f"column {name} not found")
    return found.dataType


def condition(df: DataFrame, where: object) -> Column:
    """The predicate as a column of three values: a comparison with NULL is NULL."""
    if isinstance(where, Both):
        return reduce(and_, (condition(df, p) for p in where.parts))
    if isinstance(where, Either):
        return reduce(or_, (condition(df, p) for p in where.parts))
    kind = field_of(df, where.column)
    if isinstance(where, IsNull):
        return quoted(where.column).isNotNull() if where.negated else quoted(where.column).isNull()
    assert isinstance(where, Compare)
    check_comparable(where.column, sql_type(kind), where.value)
    if where.value is None:
        return F.lit(None).cast("boolean")
    return OPS[where.op](quoted(where.column), F.lit(where.value))


def holds(df: DataFrame, where: object) -> Column:
    """The predicate as true or false; with none, true."""
    return F.lit(True) if where is None else F.coalesce(condition(df, where), F.lit(False))


def project(df: DataFrame, columns: tuple[str, ...] | None) -> DataFrame:
    names = visible(df) if columns is None else list(columns)
    for name in names:
        field_of(df, name)
    return df.select(*[quoted(n) for n in names])


def select(df: DataFrame, statement: Select, tie_break: list[str] | None = None) -> DataFrame:
    """SELECT over df.

    Ascending order has NULLs last and descending order has them first. Ties keep
    the order of insertion where df has it, else that of tie_break's columns.
    ORDER BY with LIMIT becomes one top-k operator, and filters and columns
    reach the Parquet scan.
    """
    if statement.where is not None:
        df_filter = condition(df, statement.where)
    names = visible(df) if statement.columns is None else list(statement.columns)
    for name in names:
        field_of(df, name)
    out = df if statement.where is None else df.where(df_filter)
    ties = [quoted(SEQ)] if SEQ in df.columns else [quoted(c) for c in tie_break or []]
    if statement.order is not None:
        name, down = statement.order
        field_of(df, name)
        if name not in names:
            raise AnalysisFailure(f"ORDER BY column {name} is not in the SELECT list")
        first = quoted(name).desc_nulls_first() if down else quoted(name).asc_nulls_last()
        out = out.orderBy(first, *ties)
    elif SEQ in df.columns and statement.limit is not None:
        out = out.orderBy(*ties)
    if statement.limit is not None:
        out = out.limit(statement.limit)
    return out.select(*[quoted(n) for n in names])
