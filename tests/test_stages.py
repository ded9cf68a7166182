"""Stages that grow by files read new files only and equal a full rebuild."""

import datetime as dt
import os

import pytest

from svcops.operators.experience import risk_profile
from svcops.session import data_files, list_names, scratch_path
from svcops.sources import catalog, stages
from svcops.sources.catalog import Tables
from svcops.sources.io import RAW_SCHEMAS


def ticket(i, customer, month, csat=None, days=3.0):
    return (str(i), str(customer), "LOC_01", dt.date(2010, month, 1 + i % 28), "billing", "Low", days, csat, "Resolved")


def line(i, customer, year, price=2.5):
    return (f"{i}", "s", "d", 1 + i % 5, dt.datetime(year, 1 + i % 12, 1), price, customer and f"{customer}.0", "France", 0.0)


def write(spark, name, rows, folder, file):
    """One Parquet file of the raw table in a folder."""
    path = scratch_path(spark, "one")
    spark.createDataFrame(rows, RAW_SCHEMAS[name]).coalesce(1).write.parquet(path)
    source = next(f[0] for f in data_files(spark, path)).removeprefix("file:")
    os.makedirs(folder, exist_ok=True)
    target = os.path.join(folder, file)
    with open(source, "rb") as a, open(target, "wb") as b:
        b.write(a.read())
    return target


def spoil(path):
    """Other bytes of the same length and time: whoever reads the file fails."""
    state = os.stat(path)
    with open(path, "r+b") as f:
        f.write(b"\0" * state.st_size)
    os.utime(path, ns=(state.st_atime_ns, state.st_mtime_ns))


@pytest.fixture
def inputs(spark, tmp_path):
    folders = {n: str(tmp_path / f"{n}.parquet") for n in RAW_SCHEMAS}
    write(spark, "customers", [(str(c), "Retail", 100.0 * c, "Online", "Europe", dt.date(2009, 1, 1)) for c in range(20)], folders["customers"], "a.parquet")
    write(spark, "operations", [], folders["operations"], "a.parquet")
    write(spark, "tickets", [ticket(i, i % 15, 1, 1.0 + i % 3) for i in range(60)], folders["tickets"], "jan.parquet")
    write(spark, "transactions", [line(i, i % 7 or None, 2010) for i in range(50)], folders["transactions"], "jan.parquet")
    return folders


def rows(df):
    return sorted(map(str, df.collect()))


def rebuilt(spark, folders):
    return Tables.from_files(spark, staged=False, **folders)


def check(T, spark, folders):
    assert rows(risk_profile(T)) == rows(risk_profile(rebuilt(spark, folders)))
    assert rows(T.t) == rows(rebuilt(spark, folders).t)


def forget():
    """What a new session doesn't have."""
    catalog._GROWING.clear()
    catalog._STAGED.clear()


@pytest.mark.parametrize("keep", [False, True])
def test_a_new_file_is_read_alone(spark, inputs, tmp_path, keep):
    stage_dir = str(tmp_path / "stages") if keep else None
    T = Tables.from_files(spark, stage_dir=stage_dir, **inputs)
    check(T, spark, inputs)
    more = [ticket(100 + i, i % 18, 2, 1.0) for i in range(40)], [line(100 + i, i % 9, 2011) for i in range(30)]
    write(spark, "tickets", more[0], inputs["tickets"], "feb.parquet")
    write(spark, "transactions", more[1], inputs["transactions"], "feb.parquet")
    want = rows(risk_profile(rebuilt(spark, inputs))), rows(rebuilt(spark, inputs).t)
    for name in ("tickets", "transactions"):
        spoil(f"{inputs[name]}/jan.parquet")
    if keep:
        forget()
    T = Tables.from_files(spark, stage_dir=stage_dir, **inputs)
    assert (rows(risk_profile(T)), rows(T.t)) == want
    with pytest.raises(Exception):
        rows(rebuilt(spark, inputs).t)
    T.unstage()


def test_changed_and_removed_files(spark, inputs):
    T = Tables.from_files(spark, **inputs)
    check(T, spark, inputs)
    write(spark, "tickets", [ticket(200 + i, i % 4, 3, 1.0) for i in range(20)], inputs["tickets"], "mar.parquet")
    check(T, spark, inputs)
    write(spark, "tickets", [ticket(200 + i, i % 5, 3, 2.0) for i in range(25)], inputs["tickets"], "mar.parquet")
    write(spark, "transactions", [line(i, 3, 2011) for i in range(10)], inputs["transactions"], "feb.parquet")
    check(T, spark, inputs)
    os.remove(f"{inputs['tickets']}/jan.parquet")
    os.remove(f"{inputs['transactions']}/jan.parquet")
    check(T, spark, inputs)
    os.remove(f"{inputs['tickets']}/mar.parquet")
    os.remove(f"{inputs['transactions']}/feb.parquet")
    for name in ("tickets", "transactions"):
        assert rows(T._facts(name)[2](())) == []
    assert T.t.count() == 0 and risk_profile(T).count() == 0


def test_many_parts_become_one(spark, inputs, monkeypatch):
    monkeypatch.setattr(stages, "MAX_PARTS", 2)
    T = Tables.from_files(spark, **inputs)
    for k in range(5):
        write(spark, "tickets", [ticket(1000 * k + i, i % 6, 4, 1.0 + k) for i in range(10)], inputs["tickets"], f"f{k}.parquet")
        write(spark, "transactions", [line(1000 * k + i, i, 2010 + k % 2) for i in range(10)], inputs["transactions"], f"f{k}.parquet")
        check(T, spark, inputs)
    base = next(v[0] for k, v in catalog._GROWING.items() if k[3] == "ticket_sums" and k[2] == tuple(sorted(inputs.items())))
    assert len(stages.FileStage(spark, base).parts()) <= 2
    assert len(list_names(spark, f"{base}/data")) <= 5 and len(list_names(spark, f"{base}/manifest")) == 2


def test_a_refresh_that_dies_leaves_the_former_state(spark, tmp_path):
    stage = stages.FileStage(spark, str(tmp_path / "s"))
    files = (("a", 1, 1),)
    stage.refresh(files, "", lambda paths: spark.range(3).toDF("x"))

    def broken(paths):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        stage.refresh((*files, ("b", 1, 1)), "", broken)
    (tmp_path / "s" / "manifest" / "1").mkdir()  # a manifest that was never completed
    again = stages.FileStage(spark, str(tmp_path / "s"))
    assert [x["files"] for x in again.parts().values()] == [set(files)]
    parts = again.refresh((*files, ("b", 1, 1)), "", lambda paths: spark.range(len(paths)).toDF("x"))
    assert len(parts) == 2 and again.read(parts).count() == 4
    assert again.refresh((*files, ("b", 1, 1)), "", broken) == parts
    assert again.refresh((*files, ("b", 1, 1)), "other", lambda paths: spark.range(7).toDF("x")) != parts
