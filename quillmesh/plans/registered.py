"""Where queries register with their SQL, and what their definitions share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def instant(moment: str):
    return F.lit(moment).cast("timestamp_ntz").cast("timestamp")


def plain(column: str):
    return F.col(column).cast("timestamp_ntz")


def rule_sql(column: str, pattern: str) -> str:
    return "regexp_matches({}, '(?i){}')".format(column, pattern.replace("'", "''"))
