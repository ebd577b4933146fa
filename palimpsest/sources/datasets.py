"""Declared datasets under a folder: a catalog of schemas, their rows, and links from rows to memories or entities.

The catalog and the links are logs of Parquet files: a change appends a row, and the last row of a key counts. Nothing is rewritten, so
writers do not disturb readers, and a reader sees a state by the log number alone. Dropping a dataset also deletes its files.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.sources import tabular as tb

_CATALOG = "user_id string, name string, columns string, key string, lsn long, op string"
_LINKS = "dataset string, row_pk string, kind string, target_id string, lsn long, op string"


class Datasets:
    """Datasets of all users under ``root``. Names are fit identifiers; errors are ``ValueError`` and ``KeyError``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _log(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/_{name}")
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).parquet(f"{self.root}/_{name}") if there else self.spark.createDataFrame([], schema)

    def _append(self, name: str, schema: str, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.root}/_{name}")

    def _entry(self, user: str, name: str):
        found = self.list(user).where(F.col("name") == name).first()
        if found is None:
            raise KeyError(f"{user} has no dataset {name!r}")
        return found

    def _path(self, user: str, name: str) -> str:
        return f"{self.root}/{user}/{name}"

    def create(self, user: str, name: str, columns: list[tuple[str, str, bool]], key: list[str]) -> None:
        """Enter a dataset with columns (name, type, nullable) and a key of columns that may not be null."""
        schema = tb.dataset_schema([(name, "text", False), *columns])
        solid = {f.name for f in schema.fields if not f.nullable}
        if not key or not set(key) <= solid - {name}:
            raise ValueError("the key must name columns that may not be null")
        if not self.list(user).where(F.col("name") == name).isEmpty():
            raise ValueError(f"{user} has a dataset {name!r} already")
        self._append("catalog", _CATALOG, [(user, name, json.dumps(columns), json.dumps(key), time.time_ns(), "create")])

    def drop(self, user: str, name: str) -> None:
        self._entry(user, name)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(user, name))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self._append("catalog", _CATALOG, [(user, name, None, None, time.time_ns(), "drop")])

    def list(self, user: str) -> DataFrame:
        """``(name, columns, key)`` of a user's datasets in order of name."""
        own = self._log("catalog", _CATALOG).where(F.col("user_id") == user)
        last = own.groupBy("name").agg(F.max_by(F.struct("columns", "key", "op"), "lsn").alias("r"))
        return last.where("r.op = 'create'").select("name", "r.columns", "r.key").orderBy("name")

    def insert(self, user: str, name: str, rows: DataFrame, column: str = "row") -> DataFrame:
        """Append JSON rows that fit the schema; returns those that do not, with their ``violations``."""
        entry = self._entry(user, name)
        checked = tb.validated(rows, tb.dataset_schema([tuple(c) for c in json.loads(entry["columns"])]), column)
        checked.where(F.size("violations") == 0).drop("violations").write.mode("append").parquet(self._path(user, name))
        return checked.where(F.size("violations") > 0)

    def read(self, user: str, name: str) -> DataFrame:
        """The rows of a dataset; none before the first insert."""
        schema = tb.dataset_schema([tuple(c) for c in json.loads(self._entry(user, name)["columns"])])
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(user, name))
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).parquet(self._path(user, name)) if there else self.spark.createDataFrame([], schema)

    def count(self, user: str, name: str) -> int:
        return self.read(user, name).count()

    def link(self, links: DataFrame, remove: bool = False) -> None:
        """Put (or remove) links ``(dataset, row_pk, kind, target_id)``; ``row_pk`` is the canonical JSON of the row's key."""
        op = "delete" if remove else "put"
        links.select("dataset", "row_pk", "kind", "target_id", F.lit(time.time_ns()).alias("lsn"), F.lit(op).alias("op")).write.mode("append").parquet(f"{self.root}/_links")

    def links(self, dataset: str) -> DataFrame:
        """The links of a dataset that stand."""
        keys = ["dataset", "row_pk", "kind", "target_id"]
        last = self._log("links", _LINKS).where(F.col("dataset") == dataset).groupBy(*keys).agg(F.max_by("op", "lsn").alias("op"))
        return last.where("op = 'put'").select(*keys)
