"""Work files go to the folder the session names, and stages follow their input."""

import shutil
from pathlib import Path
from types import SimpleNamespace

import pytest

from svcops.session import remove_path, scratch_path, shared_dir
from svcops.sources.catalog import Tables


class _Context:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def _session(master, conf=None, folder=None):
    return SimpleNamespace(sparkContext=_Context(master, folder), conf=SimpleNamespace(get=lambda k, d: conf or d))


def test_shared_dir_is_the_sessions_checkpoint_dir(spark):
    assert scratch_path(spark, "x").startswith(shared_dir(spark) + "/svcops/x-")


@pytest.mark.parametrize("master", ["local[4]", "spark://host:7077", "yarn"])
def test_a_configured_folder_is_kept(master):
    s = _session(master, conf="hdfs://shared/dir/")
    assert shared_dir(s) == "hdfs://shared/dir" and s.sparkContext.folder == "hdfs://shared/dir/"
    assert shared_dir(_session(master, folder="hdfs://set/before")) == "hdfs://set/before"


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"])
def test_no_folder_is_an_error_on_a_cluster(master):
    with pytest.raises(RuntimeError):
        shared_dir(_session(master))


def test_only_work_folders_are_removed(spark, tmp_path):
    with pytest.raises(ValueError):
        remove_path(spark, str(tmp_path))


def test_staged_tables_live_in_shared_dir(spark, sf_dir):
    files = Tables(spark, sf_dir).c.inputFiles()
    assert files and all(shared_dir(spark).removeprefix("file:") in f for f in files)


def test_tickets_are_a_projection_of_the_source(spark, sf_dir):
    files = Tables(spark, sf_dir).k.inputFiles()
    assert files and all("orders.parquet" in f for f in files)


def copied(source, target):
    """The files alone: the test data's folder may be read-only."""
    target.mkdir()
    for file in Path(source).iterdir():
        shutil.copyfile(file, target / file.name)


def test_stage_follows_its_input(spark, sf_dir, tmp_path):
    """Another file in the same folder: the next use sees it, and the old stage goes."""
    data = tmp_path / "in"
    copied(sf_dir, data)
    T = Tables(spark, str(data))
    first = T.c.inputFiles()
    before = T.c.count()
    part = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey <= 50").toPandas()
    (data / "customer.parquet").unlink()
    part.to_parquet(data / "customer.parquet")
    again = Tables(spark, str(data))
    assert again.c.count() == len(part) < before and again.c.inputFiles() != first
    from svcops.session import file_version
    assert file_version(spark, [first[0].rsplit("/", 1)[0]]) == ()
    again.unstage()
    assert file_version(spark, [f.rsplit("/", 1)[0] for f in again.c.inputFiles()]) != ()
