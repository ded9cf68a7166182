"""Raw input tables derived from the driver's TPC-H-style Parquet tables.

The analysed project reads four messy CSV extracts (transactions, customers,
service tickets, location operations). The test data has none of them, so
each raw table is derived here, deterministically, from the driver tables and
with the same kinds of defects (cancelled invoices, bad quantities and prices,
guest checkouts, label spellings, duplicates, missing values).

Join order is chosen for scale: ``orders`` meets ``customer`` and the tiny
``nation`` first, so the large ``lineitem`` side is shuffled only twice (by
order key, then by part key). Only ``nation`` / ``region`` are broadcast: the
TPC-H schema fixes them at 25 and 5 rows at every scale factor.

Both shuffles deal a number of partitions that grows with the files' bytes: the
stage of clean lines sorts a partition in memory, and adaptive execution would
make the partitions larger instead. As it splits no partitions of a fixed number,
a part's lines are dealt to ``PART_SLICES`` of them and its row is repeated for
each. The joins hash the smaller side's partition, so the lines are not sorted by key.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from svcops.functions import constants as K
from svcops.session import data_files

#: Input bytes that one partition of the lines stands for, and the least number of partitions.
TASK_BYTES = 8 << 20
LEAST_TASKS = 8
PART_SLICES = 4


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _country(nationkey, nation_name):
    return (F.when(nationkey <= 12, F.lit(K.UK))
            .when(nationkey == 13, F.lit(K.GERMANY))
            .when(nationkey == 14, F.lit(K.FRANCE))
            .when(nationkey == 15, F.lit("Netherlands"))
            .when(nationkey == 16, F.lit("EIRE"))
            .otherwise(nation_name))


def read_facts(spark: SparkSession, sf_dir: str, name: str, files: tuple[str, ...] | None) -> DataFrame:
    """A fact table, or only the given files of it."""
    if files is None:
        return read_table(spark, sf_dir, name)
    whole = read_table(spark, sf_dir, name)
    return spark.read.schema(whole.schema).parquet(*files) if files else whole.limit(0)


def line_tasks(spark: SparkSession, sf_dir: str, files: tuple[str, ...] | None = None) -> int:
    """The number of partitions for the joins of the lines (of the given files)."""
    base = sf_dir.rstrip("/")
    paths = [f"{base}/lineitem.parquet"] if files is None else files
    size = sum(f[1] for p in (*paths, f"{base}/orders.parquet", f"{base}/part.parquet") for f in data_files(spark, p))
    return max(LEAST_TASKS, math.ceil(size / TASK_BYTES))


def transactions_raw(spark: SparkSession, sf_dir: str, files: tuple[str, ...] | None = None) -> DataFrame:
    """One row per invoice line: ``invoice, stock_code, description, quantity,
    invoice_date, price, customer_id, country, revenue`` (revenue on raw rows,
    negatives kept). ``files``: of these files of lineitem only."""
    nation = F.broadcast(read_table(spark, sf_dir, "nation")
                         .select("n_nationkey", "n_name"))
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = (read_table(spark, sf_dir, "orders")
              .select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
              .join(cust, F.col("o_custkey") == F.col("c_custkey"))
              .join(nation, F.col("c_nationkey") == F.col("n_nationkey")))
    slices = F.sequence(F.lit(0).cast("bigint"), F.lit(PART_SLICES - 1).cast("bigint"))
    part = (read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
            .withColumn("p_slice", F.explode(slices)))
    line = read_facts(spark, sf_dir, "lineitem", files).select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity",
        F.pmod(F.col("l_orderkey").cast("bigint"), F.lit(PART_SLICES).cast("bigint")).alias("l_slice"))
    n = line_tasks(spark, sf_dir, files)
    sold = (line.repartition(n, "l_orderkey")
            .join(orders.repartition(n, "o_orderkey").hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey")))
    j = (sold.repartition(n, "l_partkey", "l_slice")
         .join(part.repartition(n, "p_partkey", "p_slice").hint("shuffle_hash"),
               (F.col("l_partkey") == F.col("p_partkey")) & (F.col("l_slice") == F.col("p_slice")))
         .coalesce(n))  # Spark shuffles into spark.sql.shuffle.partitions where that is more
    line_key = F.col("l_orderkey") + F.col("l_linenumber")
    okey = F.col("o_orderkey").cast("string")
    qty = F.col("l_quantity").cast("int")
    out = j.select(
        F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 25 == 0),
               F.concat(F.lit("C"), okey)).otherwise(okey).alias("invoice"),
        F.col("l_partkey").cast("string").alias("stock_code"),
        F.when(F.col("l_partkey") % 200 == 7, F.lit(None).cast("string"))
         .otherwise(F.col("p_name")).alias("description"),
        F.when(line_key % 97 == 0, -qty).otherwise(qty).alias("quantity"),
        F.col("o_orderdate").alias("invoice_date"),
        F.when(line_key % 101 == 0, F.lit(0.0))
         .otherwise(F.col("p_retailprice")).alias("price"),
        F.when(F.col("o_custkey") % 5 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.col("o_custkey").cast("string"), F.lit(".0")))
         .alias("customer_id"),
        _country(F.col("c_nationkey"), F.col("n_name")).alias("country"),
    )
    return out.withColumn("revenue", F.col("quantity") * F.col("price"))


def customers_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``customer_id, segment, clv, acquisition_channel, region,
    acquisition_date`` with six segment spellings, missing CLV and region, and
    every 50th customer duplicated."""
    nation = F.broadcast(read_table(spark, sf_dir, "nation")
                         .select("n_nationkey", "n_regionkey"))
    region = F.broadcast(read_table(spark, sf_dir, "region").select("r_regionkey", "r_name"))
    c = (read_table(spark, sf_dir, "customer")
         .select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
         .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
         .join(region, F.col("n_regionkey") == F.col("r_regionkey")))
    key = F.col("c_custkey")
    seg = F.col("c_mktsegment")
    channel = (F.when(key % 5 == 0, "Online").when(key % 5 == 1, "Referral")
               .when(key % 5 == 2, "Direct Sales").when(key % 5 == 3, "Trade Show")
               .otherwise("Partner"))
    base = c.select(
        key.cast("string").alias("customer_id"),
        F.when(seg == "AUTOMOBILE", "Retail")
         .when(seg == "BUILDING", F.when(key % 2 == 0, "retail").otherwise("RETAIL"))
         .when(seg == "FURNITURE", "corporate")
         .when(seg == "MACHINERY", "Corporate")
         .otherwise("Wholesale").alias("segment"),
        F.when(F.col("c_acctbal") < 0, F.lit(None).cast("double"))
         .otherwise(F.col("c_acctbal")).alias("clv"),
        channel.alias("acquisition_channel"),
        F.when(key % 20 == 3, F.lit(None).cast("string"))
         .otherwise(F.col("r_name")).alias("region"),
        F.date_add(F.lit("1994-01-01").cast("date"), (key % 365).cast("int"))
         .alias("acquisition_date"),
        key.alias("_key"),
    )
    dupes = base.where(F.col("_key") % 50 == 0)
    return base.unionByName(dupes).drop("_key")


# o_orderkey % 13 -> the 13 category spellings, in the order of the mapping
_CATEGORY_SPELLINGS = tuple(K.CATEGORY_MAP)


def tickets_raw(spark: SparkSession, sf_dir: str, files: tuple[str, ...] | None = None) -> DataFrame:
    """One service ticket per order: ``ticket_id, customer_id, location_id,
    ticket_date, issue_category, priority, resolution_days, csat_score,
    status``. ``files``: of these files of orders only."""
    o = read_facts(spark, sf_dir, "orders", files).select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
        "o_orderdate", "o_orderpriority")
    key = F.col("o_orderkey")
    category = F.element_at(F.array(*[F.lit(s) for s in _CATEGORY_SPELLINGS]),
                            (key % 13 + 1).cast("int"))
    days = F.when(key % 17 == 0, F.lit(None).cast("double")).otherwise(
        (F.floor(F.col("o_totalprice") / 42000 * 10) / 10).cast("double"))
    csat = (F.when(days.isNull() | (key % 6 == 0), F.lit(None))
            .when(days <= 1, 4 + key % 2)
            .when(days <= 2, 3 + key % 3)
            .when(days <= 5, 2 + key % 3)
            .otherwise(1 + key % 3)).cast("double")
    prio = F.col("o_orderpriority")
    status = F.col("o_orderstatus")
    return o.select(
        key.cast("string").alias("ticket_id"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.concat(F.lit("LOC_0"), (key % 8 + 1).cast("string")).alias("location_id"),
        F.col("o_orderdate").cast("date").alias("ticket_date"),
        category.alias("issue_category"),
        F.when(prio == "1-URGENT", "Critical").when(prio == "2-HIGH", "High")
         .when(prio == "3-MEDIUM", "Medium").otherwise("Low").alias("priority"),
        days.alias("resolution_days"),
        csat.alias("csat_score"),
        F.when(status == "F", "Resolved").when(status == "O", "Open")
         .when(status == "P", "Escalated").alias("status"),
    )


def operations_raw(spark: SparkSession, sf_dir: str,
                   years: tuple[int, ...] | None = None) -> DataFrame:
    """Location x quarter operations of all years, or of the given ones
    (partial aggregation of lineitem)."""
    li = read_table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_shipdate")
    if years is not None:
        li = li.where(F.year("l_shipdate").isin(*years))
    loc = (F.col("l_suppkey") % 8 + 1).cast("int")
    quarter = F.concat(F.year("l_shipdate").cast("string"), F.lit("-Q"),
                       F.quarter("l_shipdate").cast("string"))
    g = (li.groupBy(loc.alias("loc"), quarter.alias("quarter"))
         .agg(F.countDistinct("l_suppkey").alias("n_supp"),
              F.avg((F.col("l_quantity") <= 18 + 4 * loc).cast("int")).alias("rate"),
              F.avg("l_quantity").alias("avg_qty"),
              F.count(F.lit(1)).cast("int").alias("n")))
    lc = F.col("loc")
    q = F.col("quarter")
    first_year, second_year = K.YEARS[0], K.YEARS[-1]  # where the defects are
    return g.select(
        F.when((lc == 3) & (q == f"{first_year}-Q2"), F.lit(K.OLD_LOCATION_NAME))
         .otherwise(F.concat(F.lit("LOC_0"), lc.cast("string"))).alias("location_id"),
        q.alias("quarter"),
        F.when(lc.isin(1, 2), "UK").when(lc.isin(3, 7), "Germany")
         .when(lc.isin(4, 8), "France").when(lc == 5, "Netherlands")
         .otherwise("EIRE").alias("region"),
        F.when(lc == 8, F.lit(None).cast("double"))
         .otherwise(F.col("n_supp").cast("double")).alias("staff_count"),
        F.lit(2.0).alias("sla_target_days"),
        F.when(((lc == 7) & (q == f"{first_year}-Q1")) | ((lc == 5) & (q == f"{second_year}-Q3")),
               F.lit(None).cast("double"))
         .otherwise(F.round("rate", 2)).alias("sla_achievement_rate"),
        F.round(F.col("avg_qty") / 50, 2).alias("inventory_level"),
        F.col("n").alias("ticket_volume_handled"),
    )


#: Raw tables made row by row of one fact table, and the tables joined to it.
FACTS = {
    "transactions": ("lineitem", ("orders", "customer", "nation", "part")),
    "tickets": ("orders", ()),
}

#: The driver's table that a raw table has its rows from.
ROWS_FROM = {"transactions": "lineitem", "customers": "customer", "tickets": "orders", "operations": "orders"}

RAW_BUILDERS = {
    "transactions_raw": transactions_raw,
    "customers_raw": customers_raw,
    "tickets_raw": tickets_raw,
    "operations_raw": operations_raw,
}
