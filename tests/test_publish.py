"""Published tables: all of one version or none, and nothing left behind."""

import threading

import pytest
from pyspark.sql import functions as F

from svcops.session import list_names, scratch_path
from svcops.sources import io, publish
from svcops.sources.catalog import Tables
from svcops.sources.layouts import database
from svcops.sources.publish import NotPublished, Publication
from tests.test_stages import inputs, rows, ticket, write  # noqa: F401


def made(spark, version, n=100):
    """Two tables that say which version they are of."""
    return {name: spark.range(n).select("id", F.lit(version).alias("version"), F.lit(None).cast("string").alias("none"))
            for name in ("a", "b")}


def seen(tables):
    return {r[0] for df in tables.values() for r in df.select("version").distinct().collect()}


@pytest.fixture
def place(spark):
    path = scratch_path(spark, "published")
    out = Publication(spark, path, database(path))
    yield out
    out.withdraw()


def test_a_failed_write_leaves_the_former_version(spark, place):
    assert place.tables() == {}
    place.publish(made(spark, 1))
    broken = made(spark, 2)
    broken["b"] = broken["b"].withColumn("id", F.when(F.col("id") == 99, F.raise_error(F.lit("lost"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):
        place.publish(broken)
    assert seen(place.tables()) == {1} and spark.table(f"{place.database}.a").select("version").first()[0] == 1
    place.publish(made(spark, 3))
    assert seen(place.tables()) == {3} and spark.table(f"{place.database}.b").select("version").first()[0] == 3
    assert len(list_names(spark, f"{place.location}/versions")) == 2  # what the failed one left is gone


def test_other_rows_in_the_files_are_not_published(spark, place, monkeypatch):
    place.publish(made(spark, 1))
    read = Publication._read
    for wrong in (lambda df: df.where("id < 99"), lambda df: df.withColumn("id", F.col("id") * 2), lambda df: df.union(df.limit(1))):
        monkeypatch.setattr(Publication, "_read", lambda self, name, path: wrong(read(self, name, path)))
        with pytest.raises(NotPublished):
            place.publish(made(spark, 2))
    monkeypatch.setattr(Publication, "_read", read)
    assert seen(place.tables()) == {1}


def test_readers_see_one_version(spark, place):
    """Tables taken while others are published; what was planned before stays readable."""
    place.publish(made(spark, 0))
    before, states, done = place.tables(), [], threading.Event()

    def reader():
        while not done.is_set():
            states.append(seen(place.tables()))

    other = threading.Thread(target=reader)
    other.start()
    try:
        place.publish(made(spark, 1))
    finally:
        done.set()
        other.join()
    assert states and all(len(s) == 1 for s in states) and set().union(*states) <= {0, 1}
    assert seen(before) == {0} and seen(place.tables()) == {1}


def test_a_table_that_is_gone_has_no_view(spark, place):
    place.publish(made(spark, 1))
    place.publish({"a": made(spark, 2)["a"]})
    assert [t.name for t in spark.catalog.listTables(place.database) if t.namespace] == ["a"] and list(place.tables()) == ["a"]
    place.withdraw()
    assert not spark.catalog.databaseExists(place.database) and place.tables() == {}
    assert list_names(spark, f"{place.location}/versions") == list_names(spark, f"{place.location}/pointer") == []


def test_figures_know_repeats_nulls_and_empty_tables(spark):
    def of(*values):
        df = spark.createDataFrame([(v,) for v in values], "x string")
        return tuple(df.agg(*publish.figures(df)).first())

    assert of("a", "b", None) == of(None, "b", "a") != of("a", "b", "b")
    assert of("a", "a") != of("b", "b") and of() == (0, 0)


def test_csv_and_clean_up(spark, inputs):  # noqa: F811
    write(spark, "customers", [("7", None, None, '"q", \\N', "", None)], inputs["customers"], "odd.parquet")
    T = Tables.from_files(spark, **inputs)
    assert rows(io.sink_csv(T)) == rows(T.c)
    assert {r["table"]: r["rows"] for r in io.sink_tables(T).collect()}["tickets"] == 60
    own = [d.name for d in spark.catalog.listDatabases()]
    path = scratch_path(spark, "again")
    out = io.published_csv(spark, path)
    io.publish_clean(T, out)
    write(spark, "tickets", [ticket(900, 1, 2)], inputs["tickets"], "feb.parquet")
    io.publish_clean(Tables.from_files(spark, **inputs), out)
    assert out.tables()["tickets"].count() == 61
    out.withdraw()
    T.unstage()
    left = [d.name for d in spark.catalog.listDatabases()]
    assert len(left) < len(own) and not set(left) - set(own)
