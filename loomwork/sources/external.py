"""Read-only tables over Parquet files, with the dialect's types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDE = {T.IntegerType: "bigint", T.ShortType: "bigint", T.ByteType: "bigint", T.FloatType: "double"}


def widened(df: DataFrame) -> DataFrame:
    """Narrow numbers as BIGINT and DOUBLE; vectors of narrow floats as ARRAY<DOUBLE>; all else as it is."""

    def column(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if type(f.dataType) in WIDE:
            return c.cast(WIDE[type(f.dataType)]).alias(f.name)
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.FloatType):
            return c.cast("array<double>").alias(f.name)
        return c

    return df.select(*[column(f) for f in df.schema.fields])


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return widened(spark.read.parquet(path))
