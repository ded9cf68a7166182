"""Raw and clean tables of one data directory, of files or of DataFrames.

Asking for a table builds a plan; a table that takes a shuffle to make (clean
transactions, customers and operations, the risk profile) is *staged* on first
use: written once as Parquet into the cluster-shared folder and read back by
every report. Tickets are a projection of their source and are never staged, so
column pruning reaches the source. A stage belongs to the version of its input
files (names, sizes, modification times): when they change, the next use writes
it anew and removes the old one; ``unstage`` removes all. The write is a normal
Spark job: task retries and the output committer make it survive executor
loss; a half-written folder is never registered.

Two stages grow by files instead (``sources.stages``): clean transactions, whose
rows are cleaned one by one, and the sums of tickets per customer, which merge.
After a new file they read that file only. With a ``stage_dir`` of one's own they
stay for the next session. What is joined by customer is staged as bucketed tables
(``sources.layouts``).
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from svcops.functions import columns as C
from svcops.functions import constants as K
from svcops.operators import clean as CL
from svcops.session import data_files, file_version, remove_path, scratch_path
from svcops.sources import fixtures as FX
from svcops.sources.layouts import drop_database
from svcops.sources.stages import FileStage

_LOCK = threading.Lock()
_STAGED: dict[tuple, tuple[tuple, str]] = {}  # key -> (input version, path)
_BUILDING: dict[tuple, threading.Lock] = {}
_GROWING: dict[tuple, tuple[str, tuple, list[str]]] = {}  # key -> (folder, input version, parts)

CLEAN_TABLES = ("transactions", "customers", "tickets", "operations")
YEAR_PARTITION = "invoice_year"
SOURCES = ("region", "nation", "customer", "part", "orders", "lineitem")


class Tables:
    """Accessor for raw and clean tables. ``years`` are the years that the year
    reports cover, ``months`` the number of months that the tickets span."""

    def __init__(self, spark: SparkSession, sf_dir: str, staged: bool = True,
                 raw_frames: dict[str, DataFrame] | None = None, files: dict[str, str] | None = None,
                 years: tuple[int, ...] = K.YEARS, months: int = K.MONTHS_IN_DATA, stage_dir: str | None = None):
        self.spark = spark
        self.stage_dir = stage_dir and stage_dir.rstrip("/")
        self.sf_dir = sf_dir.rstrip("/")
        self.files = dict(files or {})
        self.raw_frames = dict(raw_frames or {})
        self.staged = staged and not (self.raw_frames and not self.files)
        self.years = tuple(years)
        self.months = months

    @classmethod
    def from_frames(cls, spark: SparkSession, *, years=K.YEARS, months=K.MONTHS_IN_DATA,
                    **raw: DataFrame) -> Tables:
        """Tables over given raw DataFrames (``transactions=...``, ...), unstaged."""
        return cls(spark, "<frames>", staged=False, raw_frames=raw, years=years, months=months)

    @classmethod
    def from_files(cls, spark: SparkSession, *, years=K.YEARS, months=K.MONTHS_IN_DATA,
                   staged: bool = True, stage_dir: str | None = None, **paths: str) -> Tables:
        """Tables over one's own raw files: ``transactions=path, customers=path,
        tickets=path, operations=path``, a file or a folder of files, CSV with a
        header or Parquet (by the path's ending), read with the raw schemas of
        ``sources.io``. ``stage_dir``: a folder on shared storage in which the
        stages that grow by files stay after the session."""
        from svcops.sources.io import read_raw
        return cls(spark, "<files>", staged=staged, files=paths, years=years, months=months, stage_dir=stage_dir,
                   raw_frames={name: read_raw(spark, name, path) for name, path in paths.items()})

    # ------------------------------------------------------------------ staging
    def _version(self) -> tuple:
        paths = self.files.values() or [f"{self.sf_dir}/{t}.parquet" for t in SOURCES]
        return file_version(self.spark, paths)

    def raw_bytes(self, name: str) -> int:
        """Bytes of the files that the raw table has its rows from."""
        paths = [self.files[name]] if name in self.files else [f"{self.sf_dir}/{FX.ROWS_FROM[name]}.parquet"]
        return sum(size for path in paths for _, size, _ in data_files(self.spark, path))

    def stage_path(self, name: str, write) -> str:
        """A folder of the shared directory that ``write(path)`` filled from this
        version of the input; it is called once for each version. Unstaged tables
        get a folder of their own each time."""
        if not self.staged:
            path = scratch_path(self.spark, f"own-{name}")
            write(path)
            return path
        key = (self.spark.sparkContext.applicationId, self.sf_dir, tuple(sorted(self.files.items())), name)
        version = self._version()
        with _LOCK:
            building = _BUILDING.setdefault(key, threading.Lock())
        with building:  # other stages go on meanwhile
            old = _STAGED.get(key)
            if old and old[0] == version:
                return old[1]
            path = scratch_path(self.spark, f"stage-{name}")
            write(path)
            _STAGED[key] = (version, path)
        if old:
            self._discard(old[1])
        return path

    def _discard(self, path: str) -> None:
        drop_database(self.spark, path)
        remove_path(self.spark, path)

    def unstage(self) -> None:
        """Remove everything staged from this source in this session's work folder."""
        own = (self.spark.sparkContext.applicationId, self.sf_dir, tuple(sorted(self.files.items())))
        for key in [k for k in _STAGED if k[:3] == own]:
            self._discard(_STAGED.pop(key)[1])
        for key in [k for k in _GROWING if k[:3] == own]:
            base = _GROWING.pop(key)[0]
            if not self.stage_dir:
                remove_path(self.spark, base)

    def _stage(self, name: str, build, partition_by: tuple[str, ...] = (), sort: tuple[str, ...] = ()) -> DataFrame:
        if not self.staged:
            return build()

        def write(path: str) -> None:
            df = build()
            df = df.sortWithinPartitions(*partition_by, *sort) if sort else df
            df.write.partitionBy(*partition_by).parquet(path)

        return self.spark.read.parquet(self.stage_path(name, write))

    def _facts(self, name: str):
        """(its data files, the state of all other inputs, a builder of the raw
        table from some of the files) of a table made row by row of its files."""
        if name in self.files:
            from svcops.sources.io import read_raw
            path = self.files[name]
            return data_files(self.spark, path), "", lambda files: read_raw(self.spark, name, path, files)
        fact, dims = FX.FACTS[name]
        others = file_version(self.spark, [f"{self.sf_dir}/{t}.parquet" for t in dims])
        return (data_files(self.spark, f"{self.sf_dir}/{fact}.parquet"), repr(others),
                lambda files: FX.RAW_BUILDERS[f"{name}_raw"](self.spark, self.sf_dir, files))

    def _grown(self, stage: str, name: str, make, partition_by: tuple[str, ...] = (), sort: tuple[str, ...] = (), merge=None) -> DataFrame:
        """The stage of ``make(clean table)`` that grows by the table's files."""
        files, others, raw = self._facts(name)
        key = (self.spark.sparkContext.applicationId, self.sf_dir, tuple(sorted(self.files.items())), stage, self.stage_dir)
        with _LOCK:
            building = _BUILDING.setdefault(key, threading.Lock())

        def build(paths):
            return make(CL.CLEANERS[name](raw(paths)))

        others += build(()).schema.simpleString()  # parts with other columns are made anew
        version = (files, others)
        with building:
            old = _GROWING.get(key)
            base = old[0] if old else f"{self.stage_dir}/{stage}" if self.stage_dir else scratch_path(self.spark, f"stage-{stage}")
            grown = FileStage(self.spark, base, partition_by, sort, merge)
            parts = old[2] if old and old[1] == version else grown.refresh(files, others, build)
            _GROWING[key] = (base, version, parts)
        return grown.read(parts) if parts else build(())

    # ------------------------------------------------------------------ tables
    def raw(self, name: str) -> DataFrame:
        """``transactions``/``customers``/``tickets``/``operations`` raw table."""
        if name in self.raw_frames:
            return self.raw_frames[name]
        return FX.RAW_BUILDERS[f"{name}_raw"](self.spark, self.sf_dir)

    def clean(self, name: str) -> DataFrame:
        if name == "transactions" and self.staged:
            return self._transactions_staged().drop(YEAR_PARTITION)
        cleaned = CL.CLEANERS[name]
        if name == "tickets":
            return cleaned(self.raw(name))
        return self._stage(name, lambda: cleaned(self.raw(name)))

    def _transactions_staged(self) -> DataFrame:
        """Clean transactions by invoice year, sorted by date inside the files, so
        that a date range skips row groups."""
        return self._grown("transactions", "transactions", lambda t: t.withColumn(YEAR_PARTITION, F.year("invoice_date")),
                           (YEAR_PARTITION,), ("invoice_date",))

    def t_years(self, years) -> DataFrame:
        """Clean transactions of the given invoice years: partition pruning on
        the staged table, plus a pushable date-range filter."""
        cond = C.in_years("invoice_date", years)
        if self.staged:
            return (self._transactions_staged()
                    .where(F.col(YEAR_PARTITION).isin(*years) & cond).drop(YEAR_PARTITION))
        return self.t.where(cond)

    def step(self, name: str, upto: str) -> DataFrame:
        """The raw table after the cleaning steps up to and including ``upto``."""
        return CL.CLEANERS[name](self.raw(name), upto=upto)

    def derived(self, name: str, build) -> DataFrame:
        """A DataFrame several reports reuse (e.g. the risk profile), staged
        like the clean tables."""
        return self._stage(name, build)

    def summed(self, stage: str, name: str, make, merge) -> DataFrame:
        """Partial aggregates ``make(clean table)``, merged by ``merge``; staged
        tables keep them by file and aggregate new files only."""
        if not self.staged:
            return make(self.clean(name))
        return merge(self._grown(stage, name, make, merge=merge))

    # short names used throughout the jobs
    @property
    def t(self) -> DataFrame:
        return self.clean("transactions")

    @property
    def c(self) -> DataFrame:
        return self.clean("customers")

    @property
    def k(self) -> DataFrame:
        return self.clean("tickets")

    @property
    def o(self) -> DataFrame:
        return self.clean("operations")
