"""What the query modules share: the reference time, tables with each key once, and SQL of the same."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.filters import once
from palimpsest.runtime import table

AS_OF = datetime(2025, 6, 1, tzinfo=timezone.utc)
AS_OF_SQL = "TIMESTAMPTZ '2025-06-01 00:00:00+00'"
TENANT, HOT_TENANT = "usr_0000001", "usr_fleet_ops"
MEMORIES = "m AS (SELECT DISTINCT ON (id) * FROM memories)"
EDGES = "g AS (SELECT DISTINCT ON (uuid) * FROM graph_edges)"
FACTS = "f AS (SELECT DISTINCT ON (id) * FROM facts)"
MESSAGES = "s AS (SELECT DISTINCT ON (msg_id) * FROM stream_messages)"


def _once(spark: SparkSession, folder: str, name: str, key: str, conditions: tuple) -> DataFrame:
    """Rows of a table that meet the conditions, each key once. Redelivered rows repeat their content, so filters go first and reach
    the scan; behind an aggregation they would not."""
    rows = table(spark, folder, name)
    for c in conditions:
        rows = rows.where(c)
    return once(rows, key)


def memories(spark: SparkSession, folder: str, *conditions: Column | str) -> DataFrame:
    return _once(spark, folder, "memories", "id", conditions)


def edges(spark: SparkSession, folder: str, *conditions: Column | str) -> DataFrame:
    return _once(spark, folder, "graph_edges", "uuid", conditions)


def facts(spark: SparkSession, folder: str, *conditions: Column | str) -> DataFrame:
    return _once(spark, folder, "facts", "id", conditions)


def messages(spark: SparkSession, folder: str, *conditions: Column | str) -> DataFrame:
    return _once(spark, folder, "stream_messages", "msg_id", conditions)


def as_of() -> Column:
    return F.lit(AS_OF)


def r(column: Column | str, places: int = 6) -> Column:
    return F.round((F.col(column) if isinstance(column, str) else column).cast("double"), places)


class Registry:
    """Collects queries with their SQL under one name each."""

    def __init__(self):
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None):
        def keep(function):
            self.queries[function.__name__] = function
            if sql:
                self.sql[function.__name__] = sql
            return function

        return keep
