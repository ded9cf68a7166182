"""The eighteen reporting queries of the analysis' SQL file, as DataFrame jobs.

Scale notes
-----------
* Joins between the big tables (transactions or tickets with customers) are
  preceded by an aggregation to the join grain (customer x invoice, or
  customer x location), so the shuffle carries pre-aggregated rows, not lines.
  Sums per customer and the customers are staged by id (``sources.layouts``)
  and meet without a shuffle.
  The customer side grows with the data, so it is never force-broadcast;
  AQE turns the sort-merge join into a broadcast at run time only when the
  measured side is small enough (``autoBroadcastJoinThreshold``).
* No side that grows with locations is force-broadcast; the planner's size
  check decides.
* Every ``Window`` without a partition runs after aggregation to a handful of
  rows (countries, channels, months, segments), never over raw rows.
* Exact distinct counts are planned by Spark as aggregation on
  (group, value) first, so a hot group (e.g. the UK, half of all lines) is
  spread over the shuffle before the final count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from svcops.functions import columns as C
from svcops.functions.frames import presented, with_scalars
from svcops.functions import constants as K
from svcops.operators.experience import ticket_totals
from svcops.sources import layouts as L
from svcops.sources.catalog import Tables

def _all() -> Window:
    return Window.partitionBy()


def _known(t: DataFrame) -> DataFrame:
    return t.where(F.col("customer_id") != K.GUEST)


# ------------------------------------------------------------------ phase 1

def q1_1_breach_by_location(T: Tables) -> DataFrame:
    return (T.k.groupBy("location_id").agg(
        F.count("ticket_id").alias("total_tickets"),
        F.sum("sla_breached").alias("breached_tickets"),
        C.pct(F.avg("sla_breached")).alias("breach_rate_pct"),
        F.round(F.avg("csat_score"), 2).alias("avg_csat"),
        C.avg_round("resolution_days", 1).alias("avg_resolution_days"))
        .transform(presented, F.desc("breach_rate_pct"), "location_id"))


def q1_2_sla_trend(T: Tables) -> DataFrame:
    return (T.o.select(
        "location_id", "quarter", "region",
        C.pct(F.col("sla_achievement_rate")).alias("sla_achievement_pct"),
        "sla_status", "staff_count", "inventory_level", "ticket_volume_handled")
        .orderBy("location_id", "quarter"))


def q1_3_locations_below_70(T: Tables) -> DataFrame:
    return (T.o.groupBy("location_id", "region").agg(
        F.count("quarter").alias("quarters_tracked"),
        C.pct(F.avg("sla_achievement_rate")).alias("avg_sla_pct"),
        F.min(C.pct(F.col("sla_achievement_rate"))).alias("worst_quarter_pct"),
        F.sum(F.when(F.col("sla_status") == "Critical", 1).otherwise(0))
         .alias("critical_quarters"))
        .where(F.col("avg_sla_pct") < 70)
        .transform(presented, "avg_sla_pct", "location_id"))


def q1_4_monthly_tickets(T: Tables) -> DataFrame:
    return (T.k.groupBy(C.month_text("ticket_date").alias("month")).agg(
        F.count("ticket_id").alias("total_tickets"),
        F.sum("sla_breached").alias("breached"),
        C.pct(F.avg("sla_breached")).alias("breach_rate_pct"),
        F.round(F.avg("csat_score"), 2).alias("avg_csat"))
        .transform(presented, "month"))


def q1_5_category_priority(T: Tables) -> DataFrame:
    return (T.k.groupBy("issue_category", "priority").agg(
        F.count("ticket_id").alias("ticket_count"),
        C.avg_round("resolution_days", 1).alias("avg_resolution_days"),
        C.pct(F.avg("sla_breached")).alias("breach_rate_pct"),
        F.round(F.avg("csat_score"), 2).alias("avg_csat"))
        .transform(presented, "issue_category", C.priority_rank("priority"), "priority"))


# ------------------------------------------------------------------ phase 2

def customer_invoices(T: Tables) -> DataFrame:
    """Known-customer transactions pre-aggregated to (customer, invoice)."""
    return (_known(T.t).groupBy("customer_id", "invoice").agg(
        F.sum(C.exact("revenue")).alias("inv_revenue"),
        F.count(F.lit(1)).alias("inv_lines"),
        F.min("invoice_date").alias("inv_first"),
        F.max("invoice_date").alias("inv_last")))


def invoices_of_one_customer(T: Tables) -> DataFrame:
    """How many invoices of a customer name no other one."""
    return (_known(T.t).groupBy("invoice").agg(F.min("customer_id").alias("customer_id"), F.max("customer_id").alias("_other"))
            .where(F.col("customer_id") == F.col("_other")).groupBy("customer_id").agg(F.count(F.lit(1)).alias("own_orders")))


def customer_totals(T: Tables) -> DataFrame:
    """Known customers' transactions, one row per id, laid out by the id."""
    def build() -> DataFrame:
        sums = customer_invoices(T).groupBy("customer_id").agg(
            F.count(F.lit(1)).alias("orders"), F.sum("inv_revenue").alias("revenue"), F.sum("inv_lines").alias("lines"),
            F.min("inv_first").alias("first"), F.max("inv_last").alias("last"))
        own = invoices_of_one_customer(T)
        return sums.join(own, "customer_id", "left").withColumn("own_orders", F.coalesce("own_orders", F.lit(0)))

    return L.by_customer(T, "customer_totals", build)


def shared_invoices(T: Tables) -> DataFrame:
    """(customer, invoice) of invoices that name several customers: those that
    a customer has beside its own. Usually there are none."""
    def build() -> DataFrame:
        several = (_known(T.t).groupBy("invoice").agg(F.min("customer_id").alias("_a"), F.max("customer_id").alias("_b"))
                   .where(F.col("_a") != F.col("_b")).select(F.col("invoice").alias("_invoice")))
        pairs = _known(T.t).select("customer_id", "invoice").distinct()
        return pairs.join(several, F.col("invoice").eqNullSafe(F.col("_invoice")), "left_semi")

    return L.by_customer(T, "shared_invoices", build)


def q2_1_segment_revenue(T: Tables) -> DataFrame:
    """Sums per customer meet the segment, not invoices. A segment's orders are
    distinct invoices: those of one customer are counted with the customer, and
    only invoices that several customers share are compared by number."""
    listed = L.customers(T).groupBy("customer_id", "segment").agg(F.count(F.lit(1)).alias("_m"))
    shared = (shared_invoices(T).join(listed, "customer_id").groupBy("segment", "invoice").agg(F.lit(1))
              .select("segment", F.lit(1).cast("bigint").alias("_orders")))
    sums = customer_totals(T).join(listed, "customer_id").select(
        "segment", F.col("own_orders").alias("_orders"), F.lit(1).alias("_ids"),
        (F.col("revenue") * F.col("_m")).alias("_rev"), (F.col("lines") * F.col("_m")).alias("_lines"))
    g = sums.unionByName(shared, allowMissingColumns=True).groupBy("segment").agg(
        F.sum("_ids").alias("customer_count"), F.sum("_orders").alias("total_orders"),
        F.sum("_rev").alias("_rev"), F.sum("_lines").alias("_lines"))
    return (g.select(
        "segment", "customer_count", "total_orders",
        F.round(F.col("_rev").cast("double"), 2).alias("total_revenue"),
        C.round_ratio(F.col("_rev"), F.col("_lines"), 2).alias("avg_order_revenue"),
        C.round_ratio(F.col("_rev"), F.col("customer_count"), 2).alias("revenue_per_customer"))
        .transform(presented, F.desc("total_revenue"), "segment"))


def q2_2_top20_customers(T: Tables) -> DataFrame:
    j = customer_totals(T).join(L.customers(T).select("customer_id", "segment", "region", "clv"), "customer_id")
    return (j.select(
        "customer_id", "segment", "region", F.col("clv").alias("assigned_clv"),
        F.col("orders").alias("total_orders"),
        F.round(F.col("revenue").cast("double"), 2).alias("total_revenue"),
        C.round_ratio(F.col("revenue"), F.col("lines"), 2).alias("avg_order_value"),
        F.to_date("first").alias("first_order"),
        F.to_date("last").alias("last_order"))
        .orderBy(F.desc("total_revenue"), "customer_id")
        .limit(20))


def q2_3_country_revenue(T: Tables) -> DataFrame:
    # pre-aggregate to (country, customer, invoice): the two distinct counts
    # then expand invoice-grain rows instead of invoice lines
    inv = _known(T.t).groupBy("country", "customer_id", "invoice").agg(
        F.sum(C.exact("revenue")).alias("_inv"))
    g = inv.groupBy("country").agg(
        F.countDistinct("customer_id").alias("unique_customers"),
        F.countDistinct("invoice").alias("total_orders"),
        F.sum("_inv").cast("double").alias("_rev"))
    return (g.select(
        "country", "unique_customers", "total_orders",
        F.round("_rev", 2).alias("total_revenue"),
        C.pct(F.col("_rev") / F.sum("_rev").over(_all())).alias("revenue_share_pct"))
        .orderBy(F.desc("total_revenue"), "country")
        .limit(10))


def q2_4_channel_clv(T: Tables) -> DataFrame:
    g = T.c.groupBy("acquisition_channel").agg(
        F.count("customer_id").alias("customers_acquired"),
        F.avg("clv").alias("_avg"),
        C.avg_round("clv", 2).alias("avg_clv"),
        F.sum(C.money("clv")).alias("_sum"))
    return (g.select(
        "acquisition_channel", "customers_acquired", "avg_clv",
        F.col("_sum").cast("double").alias("total_clv"),
        C.pct(F.col("_avg") / F.sum("_avg").over(_all())).alias("clv_index"))
        .transform(presented, F.desc("avg_clv"), "acquisition_channel"))


def q2_5_mom_growth(T: Tables, years=None) -> DataFrame:
    g = (T.t_years(years or T.years)
         .groupBy(C.month_text("invoice_date").alias("month"))
         .agg(C.total("revenue").alias("_rev")))
    prev = F.lag("_rev").over(Window.orderBy("month"))
    return (g.select(
        "month", F.round("_rev", 2).alias("monthly_revenue"),
        F.round(C.ratio(F.col("_rev") - prev, prev) * 100, 1).alias("mom_growth_pct"))
        .transform(presented, "month"))


# ------------------------------------------------------------------ phase 3

def at_risk_customers(T: Tables) -> DataFrame:
    """Customers with >= 2 breaches and average CSAT < 2.5 (SQL HAVING form)."""
    return (ticket_totals(T)
        .select("customer_id", F.col("_b").alias("sla_breaches"),
                C.ratio(F.col("_cs").cast("double"), F.col("_cn")).alias("avg_csat"))
        .where((F.col("sla_breaches") >= K.CHURN_MIN_BREACHES)
               & (F.col("avg_csat") < K.CHURN_MAX_AVG_CSAT)))


def q3_1_clv_risk_segment(T: Tables) -> DataFrame:
    j = L.customers(T).join(at_risk_customers(T).select("customer_id"), "customer_id")
    g = j.groupBy("segment").agg(
        F.countDistinct("customer_id").alias("customers_at_risk"),
        F.sum(C.money("clv")).alias("_sum"),
        C.avg_round("clv", 2).alias("avg_clv_at_risk"))
    total = F.sum(F.col("_sum").cast("double")).over(_all())
    return (g.select(
        "segment", "customers_at_risk",
        F.col("_sum").cast("double").alias("clv_at_risk"),
        "avg_clv_at_risk",
        C.pct(F.col("_sum").cast("double") / total).alias("pct_of_total_risk"))
        .transform(presented, F.desc("clv_at_risk"), "segment"))


def q3_2_location_exposure(T: Tables) -> DataFrame:
    per = T.k.groupBy("customer_id", "location_id").agg(
        F.count("ticket_id").alias("_n"),
        F.sum("sla_breached").alias("_b"),
        F.sum("csat_score").alias("_cs"),
        F.count("csat_score").alias("_cn"))
    # an id listed twice counts its tickets twice, but is one customer
    ids = T.c.where(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("_m"), F.sum(C.money("clv")).alias("_clv"))
    ops = T.o.select("location_id", "region").distinct()
    j = per.join(ids, "customer_id").groupBy("location_id").agg(
        F.sum(F.col("_n") * F.col("_m")).alias("total_tickets"),
        F.sum(F.col("_b") * F.col("_m")).alias("breached_tickets"),
        F.sum(F.col("_cs") * F.col("_m")).alias("_cs"),
        F.sum(F.col("_cn") * F.col("_m")).alias("_cn"),
        F.count(F.lit(1)).alias("unique_customers_affected"),
        F.sum(F.col("_clv") * F.col("_n")).alias("_clv"))
    g = j.join(ops, "location_id")
    return (g.select(
        "location_id", "region", "total_tickets", "breached_tickets",
        C.pct(F.col("breached_tickets") / F.col("total_tickets")).alias("breach_rate_pct"),
        F.round(C.ratio(F.col("_cs"), F.col("_cn")), 2).alias("avg_csat"),
        "unique_customers_affected",
        F.col("_clv").cast("double").alias("total_clv_exposed"))
        .transform(presented, F.desc("breach_rate_pct"), "location_id"))


def scenario_rows(T: Tables) -> DataFrame:
    return T.spark.createDataFrame(
        [(name, rate) for name, rate in K.CHURN_SCENARIOS],
        "churn_scenario string, churn_rate string").select(
        "churn_scenario", F.col("churn_rate").cast("decimal(3,2)").alias("churn_rate"))


def q3_3_churn_cost(T: Tables) -> DataFrame:
    base = (L.customers(T).join(at_risk_customers(T).select("customer_id"), "customer_id")
            .agg(F.sum(C.money("clv")).alias("clv_at_risk")))
    return (with_scalars(scenario_rows(T), base)
            .select("churn_scenario",
                    F.round(F.col("clv_at_risk") * F.col("churn_rate"), 2)
                     .cast("double").alias("projected_clv_loss"),
                    "churn_rate")
            .transform(presented, "churn_rate").drop("churn_rate"))


def q3_4_quarter_share(T: Tables, years=None) -> DataFrame:
    g = (T.t_years(years or T.years)
         .groupBy(F.year("invoice_date").alias("year"),
                  F.quarter("invoice_date").alias("quarter"))
         .agg(C.total("revenue").alias("_rev")))
    return (g.select(
        "year", "quarter", F.round("_rev", 2).alias("quarterly_revenue"),
        C.pct(F.col("_rev") / F.sum("_rev").over(Window.partitionBy("year")))
         .alias("pct_of_annual_revenue"))
        .transform(presented, "year", "quarter"))


def q3_5_abandonment(T: Tables) -> DataFrame:
    ab = F.when(F.col("is_abandoned"), 1).otherwise(0)
    return (T.k.groupBy("location_id", "issue_category").agg(
        F.count("ticket_id").alias("total_tickets"),
        F.sum(ab).alias("abandoned_tickets"),
        C.pct(F.avg(ab)).alias("abandonment_rate_pct"))
        .where(F.col("abandonment_rate_pct") > 5)
        .transform(presented, F.desc("abandonment_rate_pct"), "location_id", "issue_category"))


# ------------------------------------------------------------------ phase 4

def q4_1_country_index(T: Tables) -> DataFrame:
    # distinct invoices per country = number of (country, invoice) groups,
    # so no count(distinct) is needed after this pre-aggregation
    inv = _known(T.t).groupBy("country", "invoice").agg(
        F.sum(C.exact("revenue")).alias("_rev"), F.count(F.lit(1)).alias("_n"))
    g = (inv.groupBy("country").agg(
        (F.sum("_rev").cast("double") / F.sum("_n")).alias("_avg"),
        C.round_ratio(F.sum("_rev"), F.sum("_n"), 2).alias("avg_order_value"),
        F.count(F.lit(1)).alias("order_count"))
        .where(F.col("order_count") > 50))
    return (g.select(
        "country", "avg_order_value",
        C.pct(F.col("_avg") / F.avg("_avg").over(_all())).alias("index_vs_avg"),
        "order_count")
        .transform(presented, F.desc("avg_order_value"), "country"))


def q4_2_response_rate(T: Tables) -> DataFrame:
    resp = F.col("csat_responded").cast("int")
    return (T.k.groupBy("issue_category").agg(
        F.count("ticket_id").alias("total_tickets"),
        F.sum(resp).alias("responses_received"),
        C.pct(F.avg(resp)).alias("response_rate_pct"),
        F.round(F.avg("csat_score"), 2).alias("avg_csat_where_responded"))
        .transform(presented, "response_rate_pct", "issue_category"))


def q4_3_repeat_bands(T: Tables) -> DataFrame:
    per = (customer_invoices(T).groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("order_count"),
        F.round(F.sum("inv_revenue").cast("double"), 2).alias("total_revenue")))
    return (per.groupBy(C.order_band("order_count").alias("order_frequency_band")).agg(
        F.count("customer_id").alias("customers"),
        C.avg_round("total_revenue", 2).alias("avg_revenue"),
        C.avg_round("order_count", 1).alias("avg_orders"))
        .transform(presented, "avg_orders", "order_frequency_band"))


QUERIES = {
    "q1_1_breach_by_location": q1_1_breach_by_location,
    "q1_2_sla_trend": q1_2_sla_trend,
    "q1_3_locations_below_70": q1_3_locations_below_70,
    "q1_4_monthly_tickets": q1_4_monthly_tickets,
    "q1_5_category_priority": q1_5_category_priority,
    "q2_1_segment_revenue": q2_1_segment_revenue,
    "q2_2_top20_customers": q2_2_top20_customers,
    "q2_3_country_revenue": q2_3_country_revenue,
    "q2_4_channel_clv": q2_4_channel_clv,
    "q2_5_mom_growth": q2_5_mom_growth,
    "q3_1_clv_risk_segment": q3_1_clv_risk_segment,
    "q3_2_location_exposure": q3_2_location_exposure,
    "q3_3_churn_cost": q3_3_churn_cost,
    "q3_4_quarter_share": q3_4_quarter_share,
    "q3_5_abandonment": q3_5_abandonment,
    "q4_1_country_index": q4_1_country_index,
    "q4_2_response_rate": q4_2_response_rate,
    "q4_3_repeat_bands": q4_3_repeat_bands,
}
