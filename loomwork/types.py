"""The dialect's three types and the literals that fit them."""

from __future__ import annotations

from pyspark.sql import types as T

from .errors import AnalysisFailure

INT, TEXT, FLOAT = "INT", "TEXT", "FLOAT"
SPARK = {INT: T.LongType(), TEXT: T.StringType(), FLOAT: T.DoubleType()}
PYTHON = {int: INT, float: FLOAT, str: TEXT}


def sql_type(kind: T.DataType) -> str:
    """The dialect's type for a Spark type; narrower numbers count as the wide ones."""
    if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return INT
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return FLOAT
    if isinstance(kind, T.StringType):
        return TEXT
    raise AnalysisFailure(f"type {kind.simpleString()} has no counterpart in SQL here")


def check_comparable(column: str, kind: str, value: object) -> None:
    """Numbers compare with numbers and text with text; NULL compares with anything."""
    if value is not None and (kind == TEXT) != isinstance(value, str):
        raise AnalysisFailure(f"type mismatch: column {column} is {kind}, the value is {PYTHON[type(value)]}")


def check_storable(column: str, kind: str, value: object, coerce_numeric: bool = False) -> object:
    """The value as it is stored; a literal has to be of the column's own type unless coerce_numeric widens INT."""
    if value is None:
        return None
    given = PYTHON[type(value)]
    if given == INT and kind == FLOAT and coerce_numeric:
        return float(value)  # type: ignore[arg-type]
    if given != kind:
        raise AnalysisFailure(f"type mismatch: column {column} is {kind}, the value is {given}")
    return value
