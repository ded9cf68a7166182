"""Weekly SLA breach rate per location, for batch and Structured Streaming.

The same aggregation runs on a static DataFrame and on a stream: tumbling
7-day windows starting on Mondays (the epoch is a Thursday, so the window
start is offset by 4 days). Weeks belong to the ticket's date, whatever the
session's time zone. A ticket that is delivered again counts once: its id is
kept as keyed state for as long as the watermark allows.

Two forms of the stream:

* *append*: a week is emitted once, when the watermark passes its end; later
  tickets for it are dropped by the engine (the usual late-data contract).
* *ledger*: each micro-batch writes the sums that its new tickets add to their
  weeks, with how many of them came after their week was closed. The sums of
  all batches are the batch result, whatever the order of arrival, and a week's
  rows are its history of corrections. Only tickets older than the long horizon
  of the id state are left out; the ledger has a row for their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from svcops.session import list_names

WEEK = "7 days"
MONDAY_OFFSET = "4 days"
#: How long the ledger remembers ticket ids, and for how long after its end a week counts as open.
HORIZON = "400 days"
GRACE_DAYS = 14


def _week_start(start: Column) -> Column:
    """Date of a window that was cut in UTC (an instant) or without a zone."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(start) / 86400).cast("int"))


def _rates(groups, start: Column) -> DataFrame:
    g = groups.agg(F.count("ticket_id").alias("tickets"), F.sum("sla_breached").alias("breaches"))
    return g.select(start.alias("week_start"), "location_id", "tickets", "breaches",
                    F.round(F.col("breaches") / F.col("tickets"), 3).alias("breach_rate"))


def weekly_breach_agg(tickets: DataFrame) -> DataFrame:
    """Batch: the date is windowed as ``timestamp_ntz``."""
    ts = F.col("ticket_date").cast("timestamp_ntz")
    return _rates(tickets.groupBy(F.window(ts, WEEK, WEEK, MONDAY_OFFSET).alias("w"), "location_id"),
                  F.to_date(F.col("w.start")))


def _tickets(spark: SparkSession, tickets_path: str, schema, watermark: str) -> DataFrame:
    """Each ticket id once. Event time is the date's midnight in UTC: watermarks
    take instants only."""
    event = F.timestamp_seconds(F.unix_date("ticket_date").cast("bigint") * 86400)
    return (spark.readStream.schema(schema).parquet(tickets_path)
            .withColumn("ticket_ts", event).withWatermark("ticket_ts", watermark)
            .dropDuplicatesWithinWatermark(["ticket_id"]))


def weekly_breach_stream(spark: SparkSession, tickets_path: str, schema,
                         watermark: str = "14 days") -> DataFrame:
    """Streaming version over Parquet files of clean tickets arriving in
    ``tickets_path``."""
    stream = _tickets(spark, tickets_path, schema, watermark)
    return _rates(stream.groupBy(F.window("ticket_ts", WEEK, WEEK, MONDAY_OFFSET).alias("w"), "location_id"),
                  _week_start(F.col("w.start")))


def start_weekly_breach_stream(spark: SparkSession, tickets_path: str, schema, data_path: str,
                               checkpoint_path: str, watermark: str = "14 days"):
    """Start the stream into the Parquet folder ``data_path``. Started again with
    the same two paths, on shared storage, it goes on after the last committed
    batch, and each week is written exactly once."""
    return (weekly_breach_stream(spark, tickets_path, schema, watermark)
            .writeStream.outputMode("append").format("parquet")
            .option("path", data_path).option("checkpointLocation", checkpoint_path)
            .start())


# ------------------------------------------------------------------ ledger

LEDGER = ("week_start date, location_id string, tickets bigint, breaches bigint, late_tickets bigint, "
          "last_date date, batch bigint")


def _complete(spark: SparkSession, ledger_path: str) -> list[int]:
    """Batches whose rows are completely written."""
    names = list_names(spark, ledger_path)
    return sorted(int(n[6:]) for n in names if n.startswith("batch=") and "_SUCCESS" in list_names(spark, f"{ledger_path}/{n}"))


def read_ledger(spark: SparkSession, ledger_path: str, before: int | None = None) -> DataFrame:
    """Rows of the complete batches, or of those before a batch."""
    paths = [f"{ledger_path}/batch={n}" for n in _complete(spark, ledger_path) if before is None or n < before]
    if not paths:
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).option("basePath", ledger_path).parquet(*paths)


def weekly_breach_result(spark: SparkSession, ledger_path: str) -> DataFrame:
    """The weeks as all batches so far make them: columns of ``weekly_breach_agg``."""
    sums = read_ledger(spark, ledger_path).groupBy("week_start", "location_id").agg(
        F.sum("tickets").alias("tickets"), F.sum("breaches").alias("breaches"))
    return sums.select("*", F.round(F.col("breaches") / F.col("tickets"), 3).alias("breach_rate"))


def late_tickets(spark: SparkSession, ledger_path: str) -> DataFrame:
    """``week_start, location_id, late_tickets, batches``: weeks that changed after
    they were closed. The row without a week counts tickets beyond the horizon,
    which are in no week's sums (a repeated one among them counts again)."""
    rows = read_ledger(spark, ledger_path).union(read_ledger(spark, f"{ledger_path}/expired"))
    return (rows.where("late_tickets > 0").groupBy("week_start", "location_id")
            .agg(F.sum("late_tickets").alias("late_tickets"), F.sort_array(F.collect_set("batch")).alias("batches")))


class _Expired(StreamingQueryListener):
    """Writes how many tickets of a batch were beyond the horizon. The engine
    tells it after the batch; a driver lost in between loses the number."""

    def __init__(self, spark: SparkSession, ledger_path: str):
        self.spark, self.path, self.run = spark, f"{ledger_path}/expired", None

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        dropped = sum(o.numRowsDroppedByWatermark for o in p.stateOperators)
        if str(p.runId) == self.run and dropped:
            row = self.spark.createDataFrame([(None, None, 0, 0, dropped, None, p.batchId)], LEDGER).drop("batch")
            row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch={p.batchId}")

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) == self.run:
            self.spark.streams.removeListener(self)


def start_weekly_ledger(spark: SparkSession, tickets_path: str, schema, ledger_path: str, checkpoint_path: str,
                        horizon: str = HORIZON, grace_days: int = GRACE_DAYS):
    """Start the ledger stream. A batch that is repeated after a failure writes
    the same folder again, so every ticket is counted exactly once. Whether a
    ticket is late is judged by the dates of the batches before its own."""
    def write(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        high = read_ledger(own, ledger_path, number).agg(F.max("last_date")).first()[0]
        week = F.trunc("ticket_date", "week")
        closed = F.lit(False) if high is None else F.date_add(week, 7 + grace_days) <= F.lit(high)
        sums = batch.groupBy(week.alias("week_start"), "location_id").agg(
            F.count("ticket_id").alias("tickets"), F.sum("sla_breached").cast("bigint").alias("breaches"),
            F.count_if(closed).alias("late_tickets"), F.max("ticket_date").alias("last_date"))
        sums.write.mode("overwrite").parquet(f"{ledger_path}/batch={number}")

    stream = _tickets(spark, tickets_path, schema, horizon)
    expired = _Expired(spark, ledger_path)
    spark.streams.addListener(expired)
    query = stream.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint_path).start()
    expired.run = str(query.runId)
    return query
