"""Stages that grow by files.

A stage holds what was made of a table's files, in *parts*: each part is a folder
made of some of the files. A manifest lists for every part its files with their
sizes and modification times. When files are added, only they are read, into a
new part; when a file changes or goes, the parts that hold it are made anew of
their other files. What a part holds must not depend on other parts: rows
cleaned one by one, or partial aggregates that the reader merges.

Layout of a stage's folder, on shared storage:

    data/part=<id>/...       a part
    manifest/<number>/       the list of parts after one refresh; the highest
                             number with a ``_SUCCESS`` file counts

A refresh writes the parts first and the manifest last, each a normal Spark
write, so one that dies leaves the former state. Parts of the last manifest but
one stay, for readers that planned before the refresh. One driver refreshes a
stage at a time; any number may read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from svcops.session import list_names, remove_under

#: A file's state: path, bytes, modification time.
File = tuple[str, int, int]

MANIFEST = "part string, file string, bytes bigint, modified bigint, others string"

#: A refresh that would leave more parts merges all into one.
MAX_PARTS = 32


class FileStage:
    """The stage in the folder ``base``. ``partition_by`` and ``sort`` lay out a
    part's files; ``merge`` makes one part of several (by default their rows)."""

    def __init__(self, spark: SparkSession, base: str, partition_by: tuple[str, ...] = (), sort: tuple[str, ...] = (),
                 merge: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.base = spark, base.rstrip("/")
        self.partition_by, self.sort, self.merge = partition_by, sort, merge or (lambda df: df)

    def _numbers(self) -> list[int]:
        """Complete manifests, the oldest first."""
        names = list_names(self.spark, f"{self.base}/manifest")
        return sorted(int(n) for n in names if n.isdigit() and "_SUCCESS" in list_names(self.spark, f"{self.base}/manifest/{n}"))

    def _manifest(self, number: int) -> dict[str, dict]:
        """part -> its files and the state of other inputs it was made with."""
        parts: dict[str, dict] = {}
        for r in self.spark.read.schema(MANIFEST).parquet(f"{self.base}/manifest/{number}").collect():
            part = parts.setdefault(r["part"], {"files": set(), "others": r["others"]})
            part["files"].add((r["file"], r["bytes"], r["modified"]))
        return parts

    def parts(self) -> dict[str, dict]:
        numbers = self._numbers()
        return self._manifest(numbers[-1]) if numbers else {}

    def refresh(self, files: tuple[File, ...], others: str, build: Callable[[tuple[str, ...]], DataFrame]) -> list[str]:
        """The paths of the parts that hold ``files``; ``build(paths)`` makes the
        missing ones. ``others`` stands for all other inputs: parts made with
        another state of them are made anew."""
        numbers = self._numbers()
        old = self._manifest(numbers[-1]) if numbers else {}
        now = set(files)
        kept = {p: x for p, x in old.items() if x["others"] == others and x["files"] <= now}
        new = sorted(now - {f for x in kept.values() for f in x["files"]})
        if new or kept != old or not numbers:
            if new:
                part = self._write(build(tuple(f[0] for f in new)))
                kept[part] = {"files": set(new), "others": others}
            if len(kept) > MAX_PARTS:
                part = self._write(self.merge(self.read(list(kept))))
                kept = {part: {"files": now, "others": others}}
            number = numbers[-1] + 1 if numbers else 0
            rows = [(p, *f, others) for p, x in kept.items() for f in sorted(x["files"])]
            self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.base}/manifest/{number}")
            self._tidy(number, {*kept, *old})
        return sorted(kept)

    def _write(self, df: DataFrame) -> str:
        part = uuid.uuid4().hex[:12]
        df = df.sortWithinPartitions(*self.partition_by, *self.sort) if self.sort else df
        df.write.partitionBy(*self.partition_by).parquet(f"{self.base}/data/part={part}")
        return part

    def _tidy(self, number: int, parts: set[str]) -> None:
        """Remove manifests before the last but one, and parts that the last two don't list."""
        for n in list_names(self.spark, f"{self.base}/manifest"):
            if n.isdigit() and int(n) < number - 1:
                remove_under(self.spark, self.base, f"manifest/{n}")
        for name in list_names(self.spark, f"{self.base}/data"):
            if name.startswith("part=") and name[5:] not in parts:
                remove_under(self.spark, self.base, f"data/{name}")

    def read(self, parts: list[str]) -> DataFrame:
        """The rows of the parts, of which there is at least one."""
        paths = [f"{self.base}/data/part={p}" for p in parts]
        return self.spark.read.option("basePath", f"{self.base}/data").parquet(*paths).drop("part")
