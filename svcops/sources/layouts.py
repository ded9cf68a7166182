"""Staged tables laid out for joins on customers.

A layout is a bucketed table: rows lie in files by the hash of the join key,
sorted by it. Two layouts of the same key and number of buckets join without an
exchange on either side, however often reports join them; the shuffle is paid
once, when the stage is written. There are two grains:

* ``by_customer``: tables with one row (or few) per customer id.
* ``tickets_and_customers``: whole tickets. A customer's tickets can be a large
  part of all, and a bucketed scan gives a bucket to one task. So an id with more than
  ``1 / SLICES`` of the tickets is cut into slices of about that size, the key is
  (customer, slice), and the customer's row is repeated for its slices. At most
  ``SLICES`` ids are cut, into at most twice as many slices, whatever the
  data, so the list of them is small enough to broadcast and the repeated rows
  are few. Tickets without a customer are cut the same way.

The tables belong to a database of the stage's own, whose location is the
stage's folder on the shared storage; both go with the stage.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Input bytes that one bucket stands for, and the least number of buckets.
BUCKET_BYTES = 128 << 20
LEAST_BUCKETS = 8
#: A slice of a customer's tickets holds about this part of all tickets.
SLICES = 1024
SLICE = "_slice"


def database(path: str) -> str:
    """The name of the database that belongs to a stage's folder."""
    return "svcops_" + path.rsplit("-", 1)[-1]


def create_database(spark: SparkSession, path: str) -> str:
    name = database(path)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name} LOCATION '{path}'")
    return name


def drop_database(spark: SparkSession, path: str) -> None:
    """Remove the stage's database with its tables, if it has one."""
    if spark.catalog.databaseExists(database(path)):
        spark.sql(f"DROP DATABASE {database(path)} CASCADE")


def save(df: DataFrame, table: str, keys: tuple[str, ...], buckets: int) -> None:
    """One file per bucket: the rows meet by the hash that numbers the buckets."""
    (df.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
     .mode("overwrite").saveAsTable(table))


def _buckets(T, name: str) -> int:
    return max(LEAST_BUCKETS, math.ceil(T.raw_bytes(name) / BUCKET_BYTES))


def laid_out(T, stage: str, tables: Callable[[], dict[str, DataFrame]], keys: tuple[str, ...], buckets: int) -> Callable[[str], DataFrame]:
    """``name -> table`` of the stage's bucketed tables."""
    def write(path: str) -> None:
        base = create_database(T.spark, path)
        for name, df in tables().items():
            save(df, f"{base}.{name}", keys, buckets)

    base = database(T.stage_path(stage, write))
    return lambda name: T.spark.table(f"{base}.{name}")


def by_customer(T, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """``build()`` without rows that have no customer id, laid out by the id."""
    def rows() -> DataFrame:
        return build().where(F.col("customer_id").isNotNull())

    if not T.staged:
        return rows()
    return laid_out(T, f"{name}_by_customer", lambda: {name: rows()}, ("customer_id",), _buckets(T, "customers"))(name)


def customers(T) -> DataFrame:
    """Clean customers with an id, laid out by it."""
    return by_customer(T, "customers", lambda: T.c)


def hot_customers(tickets: DataFrame, slices: int = SLICES) -> DataFrame:
    """``_hot, _n``: ids (null is one) with more than ``1 / slices`` of the
    tickets, at most ``slices`` rows, and the number of slices of each."""
    counts = tickets.groupBy(F.col("customer_id").alias("_hot")).agg(F.count(F.lit(1)).alias("_n"))
    total = tickets.agg(F.count(F.lit(1)).alias("_total")).scalar()
    return (counts.where(F.col("_n") * slices > total)
            .select("_hot", F.ceil(F.col("_n") * slices / total).cast("bigint").alias("_n")))


def sliced(tickets: DataFrame, customers: DataFrame, slices: int = SLICES) -> tuple[DataFrame, DataFrame]:
    """Both with ``_slice``: a ticket's one, and a customer's row for each of
    its slices. ``tickets`` must come from files row by row: a slice is dealt
    by the row's place in its partition, so that equal rows spread too."""
    hot = F.broadcast(hot_customers(tickets, slices))  # at most `slices` rows

    def counted(df: DataFrame) -> DataFrame:
        return df.join(hot, F.col("customer_id").eqNullSafe(F.col("_hot")), "left").withColumn("_n", F.coalesce("_n", F.lit(1)))

    cut = counted(tickets).withColumn(SLICE, F.pmod(F.monotonically_increasing_id(), F.col("_n")))
    repeated = counted(customers).withColumn(SLICE, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))
    return cut.drop("_hot", "_n"), repeated.drop("_hot", "_n")


def tickets_and_customers(T) -> tuple[DataFrame, DataFrame]:
    """Clean tickets and customers, to be joined on ``("customer_id", "_slice")``.
    They are written as one stage, so that both know the same slices."""
    def tables() -> dict[str, DataFrame]:
        tickets, listed = sliced(T.k, T.c.where(F.col("customer_id").isNotNull()))
        return {"tickets": tickets, "customers": listed}

    table = laid_out(T, "tickets_and_customers", tables, ("customer_id", SLICE), _buckets(T, "tickets"))
    return table("tickets"), table("customers")
