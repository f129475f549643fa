"""Queries by name, with the SQL that DuckDB must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def presented(df: DataFrame) -> DataFrame:
    """Result columns in types that any client compares alike: money as double, dates as text, lists joined."""
    columns = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(field.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(field.dataType, T.ArrayType):
            c = F.array_join(c, ",")
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("long")
        columns.append(c.alias(field.name))
    return df.select(*columns)


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = lambda spark, sf_dir: presented(fn(spark, sf_dir))
        if sql is not None:
            ORACLES[key] = " ".join(sql.split("\n")).strip()
        return fn

    return register
