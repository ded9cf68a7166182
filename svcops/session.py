"""Session helpers: a configured SparkSession and the shared work folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "svcops", extra: dict | None = None) -> SparkSession:
    """Session for tests, the bench and local runs. On a cluster the caller's
    own session is used and only its existing settings apply. The work folder
    is never set here: ``shared_dir`` takes the one the session names."""
    cpus = os.environ.get("BENCH_CPUS", "*")
    builder = SparkSession.builder.master(master or f"local[{cpus}]").appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or 8)
    conf["spark.driver.memory"] = os.environ.get("SVCOPS_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster-shared folder named by ``spark.checkpoint.dir``.

    It is read from the session. Where it is unset, a local session (tests,
    the bench) gets a scratch folder; any other master is an error, because
    its executors could not see a folder of this machine.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not (named or context.getCheckpointDir()):
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="svcops-ckpt-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return (named or context.getCheckpointDir()).rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared folder."""
    return f"{shared_dir(spark)}/svcops/{name}-{uuid.uuid4().hex[:12]}"


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that what reads it
    again sees the same rows in the same partitions and a lost executor costs
    a reread. Spark removes it when the result is no longer used."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _path(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def file_version(spark: SparkSession, paths) -> tuple:
    """Names, sizes and modification times of the files at the paths: what a
    staged copy of them depends on. Works on any store that Spark reads."""
    out = []
    for p in paths:
        path, fs = _path(spark, p)
        if fs.exists(path):
            files = fs.listStatus(path) if fs.getFileStatus(path).isDirectory() else [fs.getFileStatus(path)]
            out += sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files)
    return tuple(out)


def data_files(spark: SparkSession, path: str) -> tuple:
    """``file_version`` of the data files at a path: no hidden ones, no markers."""
    return tuple(f for f in file_version(spark, [path]) if not f[0].rsplit("/", 1)[-1].startswith(("_", ".")))


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where there is no folder."""
    hadoop, fs = _path(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(hadoop)) if fs.exists(hadoop) else []


def remove_under(spark: SparkSession, base: str, name: str) -> None:
    """Delete one of a stage's own folders, given by its name under the stage's."""
    if not re.fullmatch(r"(manifest/\d+|data/part=[0-9a-f]+|pointer/\d+|versions/[0-9a-f]+)", name):
        raise ValueError(f"not a stage's folder: {name}")
    hadoop, fs = _path(spark, f"{base}/{name}")
    fs.delete(hadoop, True)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a work folder of our own under the shared folder."""
    if not path.startswith(f"{shared_dir(spark)}/svcops/"):
        raise ValueError(f"not a work folder: {path}")
    hadoop, fs = _path(spark, path)
    fs.delete(hadoop, True)
