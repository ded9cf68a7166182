"""Publishing a set of tables so that readers see all of one version.

Layout of a published folder, on shared storage:

    versions/<id>/<table>/...   the tables of one version
    pointer/<number>/           table, version, rows and checksum; the highest
                                number with a ``_SUCCESS`` file counts

Every table is counted and summed up (hashes of whole rows) while it is written,
and again from the files. Only when both agree for all tables is the next
pointer written, as the last step, so a job that dies, a wrong file or a reader in
between never shows half of a version. The version before the last stays, for
readers that planned with it; older ones, and what a dead job left, go with the
next publication. One driver publishes to a folder at a time; any number read.

With a database, its views follow the pointer. Each view is switched at once, the
views one after another; who needs several tables of one version takes them from
``Publication.tables``.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from svcops.session import list_names, remove_under

POINTER = "name string, version string, rows bigint, checksum decimal(38,0)"


def figures(df: DataFrame) -> tuple[Column, Column]:
    """The number of rows and the sum of their hashes: equal for equal rows in
    any order, repeats included."""
    return (F.count(F.lit(1)).alias("rows"),
            F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(28,0)")), F.lit(0).cast("decimal(38,0)")).alias("checksum"))


class NotPublished(RuntimeError):
    """What was written differs from what was to be written."""


class Publication:
    """The published folder ``location``. ``schemas`` and ``csv`` (options that
    write and read alike): the tables are CSV, else Parquet."""

    def __init__(self, spark: SparkSession, location: str, database: str | None = None,
                 schemas: Mapping[str, T_.StructType] | None = None, csv: Mapping[str, str] | None = None):
        if (schemas is None) != (csv is None) or (csv is not None and database):
            raise ValueError("CSV takes schemas and options, and has no views")
        self.spark, self.location, self.database = spark, location.rstrip("/"), database
        self.schemas, self.csv = schemas, csv

    def _path(self, version: str, name: str) -> str:
        return f"{self.location}/versions/{version}/{name}"

    def _write(self, df: DataFrame, path: str) -> None:
        if self.csv is None:
            df.write.parquet(path)
        else:
            df.write.options(**{**self.csv, "emptyValue": '""'}).csv(path)

    def _read(self, name: str, path: str) -> DataFrame:
        if self.csv is None:
            return self.spark.read.parquet(path)
        return (self.spark.read.schema(self.schemas[name]).options(**{**self.csv, "emptyValue": "", "mode": "FAILFAST"}).csv(path))

    def _numbers(self) -> list[int]:
        """Complete pointers, the oldest first."""
        names = list_names(self.spark, f"{self.location}/pointer")
        return sorted(int(n) for n in names if n.isdigit() and "_SUCCESS" in list_names(self.spark, f"{self.location}/pointer/{n}"))

    def _pointer(self, number: int) -> dict[str, str]:
        rows = self.spark.read.schema(POINTER).parquet(f"{self.location}/pointer/{number}").collect()  # a row for each table
        return {r["name"]: r["version"] for r in rows}

    def tables(self) -> dict[str, DataFrame]:
        """The tables of the current version, none before the first publication."""
        numbers = self._numbers()
        current = self._pointer(numbers[-1]) if numbers else {}
        return {name: self._read(name, self._path(version, name)) for name, version in sorted(current.items())}

    def publish(self, tables: Mapping[str, DataFrame]) -> None:
        """Make ``tables`` the current version."""
        numbers = self._numbers()
        version = uuid.uuid4().hex
        listed = []
        for name, df in tables.items():
            seen = Observation()
            path = self._path(version, name)
            self._write(df.observe(seen, *figures(df)), path)
            back = self._read(name, path)
            found = back.agg(*figures(back)).first()
            if (seen.get["rows"], seen.get["checksum"]) != (found["rows"], found["checksum"]):
                raise NotPublished(f"{name}: {seen.get} written, {found.asDict()} read back")
            listed.append((name, version, found["rows"], found["checksum"]))
        number = numbers[-1] + 1 if numbers else 0
        # a pointer without _SUCCESS is one that a dead job left
        self.spark.createDataFrame(listed, POINTER).coalesce(1).write.mode("overwrite").parquet(f"{self.location}/pointer/{number}")
        self._views(dict.fromkeys(tables, version))
        self._tidy([*numbers[-1:], number])

    def _views(self, current: dict[str, str]) -> None:
        if not self.database:
            return
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {self.database} LOCATION '{self.location}/views'")
        for name, version in current.items():
            self.spark.sql(f"CREATE OR REPLACE VIEW {self.database}.{name} AS SELECT * FROM parquet.`{self._path(version, name)}`")
        for table in self.spark.catalog.listTables(self.database):
            if table.namespace and table.name not in current:
                self.spark.sql(f"DROP VIEW {self.database}.{table.name}")

    def _tidy(self, numbers: list[int]) -> None:
        """Remove all pointers but the given ones, and versions that these don't name."""
        named = {v for n in numbers for v in self._pointer(n).values()}
        for n in list_names(self.spark, f"{self.location}/pointer"):
            if n.isdigit() and int(n) not in numbers:
                remove_under(self.spark, self.location, f"pointer/{n}")
        for v in list_names(self.spark, f"{self.location}/versions"):
            if v not in named:
                remove_under(self.spark, self.location, f"versions/{v}")

    def withdraw(self) -> None:
        """Remove all versions, the pointers first, and the database."""
        for n in self._numbers()[::-1]:
            remove_under(self.spark, self.location, f"pointer/{n}")
        for v in list_names(self.spark, f"{self.location}/versions"):
            remove_under(self.spark, self.location, f"versions/{v}")
        if self.database and self.spark.catalog.databaseExists(self.database):
            self.spark.sql(f"DROP DATABASE {self.database} CASCADE")
