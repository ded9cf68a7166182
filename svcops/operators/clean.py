"""Cleaning rules for the four raw tables, one lazy step per rule.

Each ``step_*`` is ``DataFrame -> DataFrame`` and the ``clean_*`` functions
chain them in the order the analysis applies them (the order matters: counts
and imputations are taken after the previous step). No step triggers a job.

Imputation lookups (segment medians, location means, the global staff median)
are computed with ``groupBy`` (partial aggregation, no hot partition) and
joined back; only the medians of the three fixed segment labels are
force-broadcast, the planner's size check decides on the location means.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from svcops.functions import columns as C
from svcops.functions.frames import presented, with_scalars
from svcops.functions.ranks import percentiles
from svcops.functions import constants as K

# --------------------------------------------------------------------- transactions


def step_t_cancel(df: DataFrame) -> DataFrame:
    """Drop cancellation invoices (prefix ``C``)."""
    return df.where(~F.coalesce(F.col("invoice").startswith("C"), F.lit(False)))


def step_t_qty(df: DataFrame) -> DataFrame:
    return df.where(F.col("quantity") > 0)


def step_t_price(df: DataFrame) -> DataFrame:
    return df.where(F.col("price") > 0)


def step_t_guest(df: DataFrame) -> DataFrame:
    """Missing customer -> ``GUEST`` plus an ``is_guest`` flag."""
    filled = F.coalesce(F.col("customer_id"), F.lit(K.GUEST))
    return (df.withColumn("customer_id", filled)
              .withColumn("is_guest", F.col("customer_id") == K.GUEST))


def step_t_desc(df: DataFrame) -> DataFrame:
    return df.withColumn("description", F.coalesce(F.col("description"), F.lit(K.UNKNOWN)))


def step_t_revenue(df: DataFrame) -> DataFrame:
    return df.withColumn("revenue", F.col("quantity") * F.col("price"))


def step_t_types(df: DataFrame) -> DataFrame:
    """Timestamp type and the customer id as integer text (``'13085.0'`` ->
    ``'13085'``), so later joins are plain string equi-joins."""
    return (df.withColumn("invoice_date", F.col("invoice_date").cast("timestamp_ntz"))
              .withColumn("customer_id", C.norm_customer_id("customer_id")))


TRANSACTION_STEPS = (
    ("cl_t_cancel", step_t_cancel),
    ("cl_t_qty", step_t_qty),
    ("cl_t_price", step_t_price),
    ("cl_t_guest", step_t_guest),
    ("cl_t_desc", step_t_desc),
    ("cl_t_revenue", step_t_revenue),
    ("cl_t_types", step_t_types),
)

TRANSACTION_COLUMNS = ("invoice", "stock_code", "description", "quantity", "invoice_date",
                       "price", "customer_id", "country", "revenue", "is_guest")


def clean_transactions(raw: DataFrame, upto: str | None = None) -> DataFrame:
    df = raw
    for key, step in TRANSACTION_STEPS:
        df = step(df)
        if key == upto:
            return df
    return df.select(*TRANSACTION_COLUMNS)


# --------------------------------------------------------------------- customers


def step_c_dedupe(df: DataFrame) -> DataFrame:
    """Full-row duplicates (missing equals missing, like ``dropDuplicates``)."""
    return df.dropDuplicates()


def step_c_segment(df: DataFrame) -> DataFrame:
    return df.withColumn("segment", C.label_map("segment", K.SEGMENT_MAP))


def segment_medians(df: DataFrame) -> DataFrame:
    """Median CLV per mapped segment (exact, interpolated like pandas)."""
    return percentiles(df, "segment", "clv", (0.5,)).withColumnRenamed("p0", "median_clv")


def step_c_clv(df: DataFrame) -> DataFrame:
    """Missing CLV -> median of its own segment, flagged ``clv_imputed``."""
    med = F.broadcast(segment_medians(df))  # <= 3 rows: fixed segment labels
    return (df.join(med, "segment", "left")
              .withColumn("clv_imputed", F.col("clv").isNull())
              .withColumn("clv", F.coalesce(F.col("clv"), F.col("median_clv")))
              .drop("median_clv"))


def step_c_region(df: DataFrame) -> DataFrame:
    return df.withColumn("region", F.coalesce(F.col("region"), F.lit(K.UNKNOWN)))


def step_c_types(df: DataFrame) -> DataFrame:
    return (df.withColumn("customer_id", C.norm_customer_id("customer_id"))
              .withColumn("clv", F.round("clv", 2))
              .withColumn("acquisition_date", F.to_date("acquisition_date")))


CUSTOMER_STEPS = (
    ("cl_c_dedupe", step_c_dedupe),
    ("cl_c_segment", step_c_segment),
    ("cl_c_clv", step_c_clv),
    ("cl_c_region", step_c_region),
    ("cl_c_types", step_c_types),
)

CUSTOMER_COLUMNS = ("customer_id", "segment", "clv", "acquisition_channel", "region",
                    "acquisition_date", "clv_imputed")


def clean_customers(raw: DataFrame, upto: str | None = None) -> DataFrame:
    df = raw
    for key, step in CUSTOMER_STEPS:
        df = step(df)
        if key == upto:
            return df
    return df.select(*CUSTOMER_COLUMNS)


# --------------------------------------------------------------------- tickets


def step_k_category(df: DataFrame) -> DataFrame:
    return df.withColumn("issue_category", C.label_map("issue_category", K.CATEGORY_MAP))


def step_k_abandoned(df: DataFrame) -> DataFrame:
    return df.withColumn("is_abandoned", F.col("resolution_days").isNull())


def step_k_breach(df: DataFrame) -> DataFrame:
    """Recomputed breach flag: abandoned or slower than the 2-day target."""
    return df.withColumn("sla_breached", C.sla_breached("resolution_days"))


def step_k_responded(df: DataFrame) -> DataFrame:
    return df.withColumn("csat_responded", F.col("csat_score").isNotNull())


def step_k_types(df: DataFrame) -> DataFrame:
    return (df.withColumn("customer_id", C.norm_customer_id("customer_id"))
              .withColumn("ticket_date", F.to_date("ticket_date"))
              .withColumn("resolution_days", F.col("resolution_days").try_cast("double")))


TICKET_STEPS = (
    ("cl_k_category", step_k_category),
    ("cl_k_abandoned", step_k_abandoned),
    ("cl_k_breach", step_k_breach),
    ("cl_k_responded", step_k_responded),
    ("cl_k_types", step_k_types),
)

TICKET_COLUMNS = ("ticket_id", "customer_id", "location_id", "ticket_date", "issue_category",
                  "priority", "resolution_days", "sla_breached", "csat_score", "status",
                  "is_abandoned", "csat_responded")


def clean_tickets(raw: DataFrame, upto: str | None = None) -> DataFrame:
    df = raw
    for key, step in TICKET_STEPS:
        df = step(df)
        if key == upto:
            return df
    return df.select(*TICKET_COLUMNS)


# --------------------------------------------------------------------- operations


def step_o_location(df: DataFrame) -> DataFrame:
    loc = F.col("location_id")
    return df.withColumn("location_id", F.when(loc == K.OLD_LOCATION_NAME,
                                               F.lit(K.NEW_LOCATION_NAME)).otherwise(loc))


def step_o_sla(df: DataFrame) -> DataFrame:
    """Missing SLA rate -> mean of the same location; whole column to 2 dp."""
    means = df.groupBy("location_id").agg(F.avg("sla_achievement_rate").alias("_loc_mean"))
    rate = F.col("sla_achievement_rate")
    return (df.join(means, "location_id", "left")
              .withColumn("sla_imputed", rate.isNull())
              .withColumn("sla_achievement_rate",
                          F.round(F.coalesce(rate, F.col("_loc_mean")), 2))
              .drop("_loc_mean"))


def step_o_staff(df: DataFrame) -> DataFrame:
    """Missing staff count -> median over all rows, flagged ``staff_imputed``."""
    med = df.agg(F.median("staff_count").alias("_staff_median"))  # one row
    return (with_scalars(df, med)
              .withColumn("staff_imputed", F.col("staff_count").isNull())
              .withColumn("staff_count", F.coalesce(F.col("staff_count"),
                                                    F.col("_staff_median")))
              .drop("_staff_median"))


def step_o_status(df: DataFrame) -> DataFrame:
    return df.withColumn("sla_status", C.sla_status("sla_achievement_rate"))


OPERATION_STEPS = (
    ("cl_o_location", step_o_location),
    ("cl_o_sla", step_o_sla),
    ("cl_o_staff", step_o_staff),
    ("cl_o_status", step_o_status),
)

OPERATION_COLUMNS = ("location_id", "quarter", "region", "staff_count", "sla_target_days",
                     "sla_achievement_rate", "inventory_level", "ticket_volume_handled",
                     "sla_imputed", "staff_imputed", "sla_status")


def clean_operations(raw: DataFrame, upto: str | None = None) -> DataFrame:
    df = raw
    for key, step in OPERATION_STEPS:
        df = step(df)
        if key == upto:
            return df
    return df.select(*OPERATION_COLUMNS)


CLEANERS = {
    "transactions": clean_transactions,
    "customers": clean_customers,
    "tickets": clean_tickets,
    "operations": clean_operations,
}


# --------------------------------------------------------------------- registered jobs

def cl_c_medians(T) -> DataFrame:
    """Segment medians used for CLV imputation, 2 decimals."""
    df = CUSTOMER_STEPS[1][1](CUSTOMER_STEPS[0][1](T.raw("customers")))
    return (segment_medians(df)
            .select("segment", F.round("median_clv", 2).alias("median_clv"))
            .transform(presented, "segment"))


def cl_k_rates(T) -> DataFrame:
    """Breach count, breach % and response % after cleaning."""
    return T.k.agg(
        F.sum("sla_breached").alias("breached_tickets"),
        C.pct(F.avg("sla_breached")).alias("breach_rate_pct"),
        C.pct(F.avg(F.col("csat_responded").cast("int"))).alias("response_rate_pct"))


def cl_k_category(T) -> DataFrame:
    """Tickets with mapped categories, and two counts on every row: spellings
    the quality report lists as inconsistent, and labels that really change."""
    label = F.col("issue_category")
    counts = T.raw("tickets").agg(
        F.count_if(label.isin(*K.CATEGORY_INCONSISTENT)).alias("listed_labels"),
        F.count_if(~label.eqNullSafe(C.label_map("issue_category", K.CATEGORY_MAP))).alias("changed_labels"))
    return with_scalars(T.step("tickets", "cl_k_category"), counts)


def _step_job(table: str, key: str):
    def job(T) -> DataFrame:
        return T.step(table, key)
    job.__name__ = key
    return job


def _clean_job(table: str):
    def job(T) -> DataFrame:
        return T.clean(table)
    job.__name__ = f"clean_{table}"
    return job


QUERIES = {}
for _table, _steps in (("transactions", TRANSACTION_STEPS), ("customers", CUSTOMER_STEPS),
                       ("tickets", TICKET_STEPS), ("operations", OPERATION_STEPS)):
    for _key, _ in _steps:
        QUERIES[_key] = _step_job(_table, _key)
    QUERIES[f"clean_{_table}"] = _clean_job(_table)
QUERIES["cl_k_category"] = cl_k_category
QUERIES["cl_c_medians"] = cl_c_medians
QUERIES["cl_k_rates"] = cl_k_rates
