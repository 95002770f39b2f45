"""Where the entries register, and how results are shown for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType, DateType, DecimalType, TimestampNTZType, TimestampType

from registry.feeds import Feeds
from registry.oracle_parts import with_parts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MICROS = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def present(df: DataFrame) -> DataFrame:
    """Dates and moments as text, decimals as doubles, booleans as 0/1: types any engine prints alike."""
    def shown(field):
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, DateType):
            column = column.cast("string")
        elif isinstance(field.dataType, (TimestampType, TimestampNTZType)):
            column = F.date_format(column, MICROS)
        elif isinstance(field.dataType, DecimalType):
            column = column.cast("double")
        elif isinstance(field.dataType, BooleanType):
            column = column.cast("int")
        return column.alias(field.name)

    return df.select(*[shown(field) for field in df.schema])


def entry(name: str, sql: str | None = None, extra: dict[str, str] | None = None):
    """Register a query over `Feeds`, with the SQL that must give the same rows."""
    def register(build: Callable[[Feeds], DataFrame]):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return present(build(Feeds(spark, sf_dir)))

        query.__name__, query.__doc__ = name, build.__doc__
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = with_parts(sql, extra)
        return build

    return register


def shown(table: str, dates: tuple = (), moments: tuple = (), decimals: tuple = (), where: str = "") -> str:
    """`SELECT *` of a table with the conversions `present` makes."""
    changes = [f"CAST({c} AS VARCHAR) AS {c}" for c in dates]
    changes += [f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f') AS {c}" for c in moments]
    changes += [f"CAST({c} AS DOUBLE) AS {c}" for c in decimals]
    star = f"* REPLACE ({', '.join(changes)})" if changes else "*"
    return f"SELECT {star} FROM {table} {where}"
