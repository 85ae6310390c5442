"""Register of queries: a Spark callable and, where SQL can say the same over whole tables, its SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendwarden.params import Params

from .sqltext import statement
from .views import tables

P = Params(as_of=dt.date(2001, 7, 31))
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
BODIES: dict[str, str] = {}  # the SQL without its view CTEs, for queries made of others


def flat(df: DataFrame) -> DataFrame:
    """Plain columns: money as double, whole numbers as bigint, lists as text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DecimalType, T.FloatType)):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), "|")
        elif isinstance(f.dataType, (T.StructType, T.MapType)):
            c = F.to_json(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def register(key: str, views: str, fn: Callable, sql: str | None = None, sql_views: str | None = None) -> None:
    """fn(t, P) over the named tables; sql uses the same tables with _v after their names."""
    names = tuple(views.split())

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return flat(fn(tables(spark, sf_dir, *names), P))

    if key in QUERIES:
        raise ValueError(key)
    QUERIES[key] = run
    if sql:
        BODIES[key] = sql
        wanted = names if sql_views is None else tuple(sql_views.split())
        from .views import BASE
        ORACLE[key] = statement(tuple(n for n in wanted if n not in BASE), sql)
