"""The weekly breach aggregation gives the same result on a stream."""

import datetime as dt
import time

import pytest

from svcops.session import scratch_path
from svcops.sources.catalog import Tables
from svcops.streaming.weekly import (late_tickets, read_ledger, start_weekly_breach_stream, start_weekly_ledger, weekly_breach_agg,
                                     weekly_breach_result, weekly_breach_stream)


def test_stream_equals_batch(spark, sf_dir):
    k = Tables(spark, sf_dir).k
    src = scratch_path(spark, "stream-src")
    k.write.parquet(src)
    stream = weekly_breach_stream(spark, src, k.schema, watermark="0 days")
    q = (stream.writeStream.outputMode("complete").format("memory")
         .queryName("weekly_breach_test").start())
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.table("weekly_breach_test")
    want = weekly_breach_agg(k)
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0


def _append(spark, src, schema, base):
    """Run the append stream until it has read all files, then stop it."""
    q = start_weekly_breach_stream(spark, src, schema, f"{base}/data", f"{base}/checkpoint", watermark="0 days")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.read.parquet(f"{base}/data")


def test_append_stream_restarts_where_it_stopped(spark, sf_dir):
    """Stopped and started again with the same paths, every week appears once
    and equals the batch result over all files."""
    k = Tables(spark, sf_dir).k
    src, base = scratch_path(spark, "stream-src-append"), scratch_path(spark, "stream-append")
    early = k.where("ticket_date < '1998-06-01'")
    early.write.parquet(src)
    first = _append(spark, src, k.schema, base).count()
    assert first > 0
    k.where("ticket_date >= '1998-06-01'").write.mode("append").parquet(src)
    got = _append(spark, src, k.schema, base)
    assert got.count() > first
    assert got.groupBy("week_start", "location_id").count().where("count > 1").count() == 0
    assert got.exceptAll(weekly_breach_agg(k)).count() == 0


@pytest.mark.parametrize("zone", ["Asia/Tokyo", "America/Los_Angeles"])
def test_weeks_do_not_depend_on_the_zone(spark, zone):
    rows = [("1", "LOC_01", dt.date(2000, 1, 3), 1), ("2", "LOC_01", dt.date(2000, 1, 2), 0), ("3", "LOC_01", dt.date(2000, 1, 9), 0)]
    schema = "ticket_id string, location_id string, ticket_date date, sla_breached int"
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        k = spark.createDataFrame(rows, schema)
        src = scratch_path(spark, "stream-zone")
        k.write.parquet(src)
        q = (weekly_breach_stream(spark, src, k.schema, watermark="0 days").writeStream.outputMode("complete")
             .format("memory").queryName(f"zone_{zone[:4]}").start())
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        want = [(dt.date(1999, 12, 27), "LOC_01", 1, 0, 0.0), (dt.date(2000, 1, 3), "LOC_01", 2, 1, 0.5)]
        assert sorted(map(tuple, spark.table(f"zone_{zone[:4]}").collect())) == want
        assert sorted(map(tuple, weekly_breach_agg(k).collect())) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


# ------------------------------------------------------------------ ledger

def _deliver(spark, k, src, base, **options):
    """Add a file and run the ledger until it has read it, then stop it."""
    k.coalesce(1).write.mode("append").parquet(src)
    q = start_weekly_ledger(spark, src, k.schema, f"{base}/ledger", f"{base}/checkpoint", **options)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return f"{base}/ledger"


def _same(spark, ledger, k):
    got, want = weekly_breach_result(spark, ledger), weekly_breach_agg(k)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_redelivered_and_late_files_give_the_batch_result(spark, sf_dir):
    k = Tables(spark, sf_dir).k
    src, base = scratch_path(spark, "ledger-src"), scratch_path(spark, "ledger")
    early, late = k.where("ticket_date < '1998-06-01' AND ticket_id % 3 > 0"), k.where("ticket_date < '1998-06-01' AND ticket_id % 3 = 0")
    rest = k.where("ticket_date >= '1998-06-01'")
    _same(spark, _deliver(spark, early, src, base, horizon="9000 days"), early)
    _same(spark, _deliver(spark, rest, src, base, horizon="9000 days"), early.union(rest))
    _deliver(spark, rest, src, base, horizon="9000 days")
    ledger = _deliver(spark, early.union(rest), src, base, horizon="9000 days")
    _same(spark, ledger, early.union(rest))
    assert late_tickets(spark, ledger).count() == 0
    _deliver(spark, late.union(early), src, base, horizon="9000 days")
    _same(spark, ledger, k)
    counted = late_tickets(spark, ledger)
    assert counted.agg({"late_tickets": "sum"}).first()[0] == late.count() > 0
    assert {tuple(r["batches"]) for r in counted.collect()} == {(read_ledger(spark, ledger).agg({"batch": "max"}).first()[0],)}


def test_a_repeated_batch_counts_once(spark):
    rows = [(str(i), "LOC_01", dt.date(2000, 1, 3 + i % 5), i % 2) for i in range(20)]
    k = spark.createDataFrame(rows, "ticket_id string, location_id string, ticket_date date, sla_breached int")
    src, base = scratch_path(spark, "ledger-src"), scratch_path(spark, "ledger")
    ledger = _deliver(spark, k, src, base)
    from svcops.session import _path
    commits = f"{base}/checkpoint/commits"
    from svcops.session import list_names
    for name in list_names(spark, commits):  # as if the driver was lost before the commit
        if name.isdigit():
            hadoop, fs = _path(spark, f"{commits}/{name}")
            fs.delete(hadoop, False)
    extra = spark.createDataFrame([("20", "LOC_02", dt.date(2000, 1, 4), 1)], k.schema)
    _deliver(spark, extra, src, base)
    _same(spark, ledger, k.union(extra))


def test_tickets_beyond_the_horizon_are_counted(spark):
    schema = "ticket_id string, location_id string, ticket_date date, sla_breached int"
    src, base = scratch_path(spark, "ledger-src"), scratch_path(spark, "ledger")
    new = spark.createDataFrame([("1", "LOC_01", dt.date(2001, 1, 3), 1)], schema)
    old = spark.createDataFrame([(str(i), "LOC_01", dt.date(1999, 1, 4), 0) for i in range(2, 9)], schema)
    next_ = spark.createDataFrame([("9", "LOC_01", dt.date(2001, 1, 4), 0)], schema)
    _deliver(spark, new, src, base, horizon="30 days")
    _deliver(spark, next_, src, base, horizon="30 days")
    ledger = _deliver(spark, old, src, base, horizon="30 days")
    for _ in range(100):  # the engine reports after the batch
        if late_tickets(spark, ledger).count():
            break
        time.sleep(0.1)
    assert [tuple(r)[:3] for r in late_tickets(spark, ledger).collect()] == [(None, None, 7)]
    _same(spark, ledger, new.union(next_))
