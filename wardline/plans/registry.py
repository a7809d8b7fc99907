"""Registration of queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from wardline.plans.oracle_sql import with_views
from wardline.plans.views import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Columns as types that compare the same everywhere: text, 64-bit numbers and booleans."""

    def convert(field: T.StructField) -> Column:
        c, t = F.col(f"`{field.name}`"), field.dataType
        if isinstance(t, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(t, T.DecimalType):
            c = c.cast("double")
        elif isinstance(t, T.DateType):
            c = c.cast("string")
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(t, T.ArrayType):
            c = F.array_join(c, ",")
        return c.alias(field.name)

    return df.select(*[convert(f) for f in df.schema.fields])


def query(name: str, oracle: str | None = None, views: tuple[str, ...] = (), recursive: bool = False):
    """Registers a function of :class:`Views`; ``oracle`` is SQL over the named oracle views."""

    def register(build: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, path: plain(build(Views(spark, path)))
        if oracle is not None:
            ORACLES[name] = with_views(views, oracle, recursive)
        return build

    return register
