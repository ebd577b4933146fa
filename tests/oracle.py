"""Compare a query with its SQL: the same rows, as sorted columns of canonical values."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb


def canonical(value):
    if value is None:
        return None
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    if type(value).__name__ == "Decimal":
        return round(float(value), 6) + 0.0
    return value


def connect(folder: str):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return c


def rows_of_sql(connection, sql: str):
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(names), Counter(tuple(canonical(row[k]) for k in order) for row in cursor.fetchall())


def rows_of_spark(df):
    names = df.columns
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(names), Counter(tuple(canonical(row[k]) for k in order) for row in df.collect())


def difference(df, connection, sql: str) -> str:
    names, mine = rows_of_spark(df)
    theirs_names, theirs = rows_of_sql(connection, sql)
    if names != theirs_names:
        return f"columns {names} against {theirs_names}"
    if mine != theirs:
        return f"{sum(mine.values())} rows against {sum(theirs.values())}; only mine {list((mine - theirs).items())[:3]}; only SQL {list((theirs - mine).items())[:3]}"
    return ""
