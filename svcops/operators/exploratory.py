"""Exploratory metrics: revenue, seasonality, geography, segments, tickets,
locations. Ranked results (top countries, worst/best location) use a key
as the final tie-breaker so they are deterministic; top-k runs as Spark's
TakeOrdered (per-partition top-k, then a merge), never a full sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from svcops.functions import columns as C
from svcops.functions.frames import presented, with_scalars
from svcops.functions import constants as K
from svcops.sources.catalog import Tables

def _all() -> Window:
    return Window.partitionBy()


def _known(T: Tables) -> DataFrame:
    return T.t.where(F.col("customer_id") != K.GUEST)


def eda_time_cols(T: Tables) -> DataFrame:
    return T.t.select("invoice", "stock_code", "invoice_date",
                      F.year("invoice_date").alias("year"),
                      F.month("invoice_date").alias("month"),
                      C.month_text("invoice_date").alias("month_str"))


def eda_known_only(T: Tables) -> DataFrame:
    return _known(T)


def eda_revenue_summary(T: Tables) -> DataFrame:
    # the lines are read once: per (invoice, customer), then invoices and ids
    per_invoice = T.t.groupBy("invoice", "customer_id").agg(
        F.sum(C.exact("revenue")).alias("_inv"), F.count(F.lit(1)).alias("_n"),
        F.sum(F.col("is_guest").cast("int")).alias("_g"))
    orders = per_invoice.groupBy("invoice").agg(F.sum("_inv").alias("_inv"), F.sum("_n").alias("_n"), F.sum("_g").alias("_g"))
    a = orders.agg(C.total("_inv").alias("_rev"), F.count(F.lit(1)).alias("total_orders"),
                   C.avg_round("_inv", 2).alias("avg_order_value"),
                   C.pct(F.sum("_g") / F.sum("_n")).alias("guest_pct"))
    ids = per_invoice.where(F.col("customer_id") != K.GUEST).groupBy("customer_id").agg(F.lit(1))
    return with_scalars(a, ids.agg(F.count(F.lit(1)).alias("total_customers"))).select(
        F.round("_rev", 2).alias("total_revenue"), "total_orders", "avg_order_value",
        "total_customers", "guest_pct")


def _monthly(T: Tables, years=None) -> DataFrame:
    return (T.t_years(years or T.years)
            .groupBy(C.month_text("invoice_date").alias("month_str"))
            .agg(C.total("revenue").alias("_rev")))


def eda_monthly_revenue(T: Tables) -> DataFrame:
    return (_monthly(T).select("month_str", F.round("_rev", 2).alias("revenue"))
            .transform(presented, "month_str"))


def eda_peak_premium(T: Tables) -> DataFrame:
    peak = F.substring("month_str", 6, 2).isin(*[f"{m:02d}" for m in K.PEAK_MONTHS])
    a = _monthly(T).agg(F.avg("_rev").alias("_avg"),
                        F.avg(F.when(peak, F.col("_rev"))).alias("_peak"),
                        C.avg_round("_rev", 2).alias("avg_monthly_revenue"),
                        C.avg_round(F.when(peak, F.col("_rev")), 2).alias("avg_peak_revenue"))
    return a.select("avg_monthly_revenue", "avg_peak_revenue",
                    F.round((F.col("_peak") / F.col("_avg") - 1) * 100, 1).alias("peak_premium_pct"))


def _top_countries(T: Tables, n: int) -> DataFrame:
    top = (_known(T).groupBy("country").agg(C.total("revenue").alias("_rev"))
           .orderBy(F.desc("_rev"), "country").limit(n))
    return top.select("country", F.round("_rev", 2).alias("revenue"),
                      C.pct(F.col("_rev") / F.sum("_rev").over(_all())).alias("revenue_pct"))


def eda_country_top8(T: Tables) -> DataFrame:
    return _top_countries(T, 8).transform(presented, F.desc("revenue"), "country")


def eda_uk_share(T: Tables) -> DataFrame:
    return _top_countries(T, 8).where(F.col("country") == K.UK).select("country", "revenue_pct")


def _segments(T: Tables) -> DataFrame:
    g = (T.c.where(F.col("segment").isNotNull()).groupBy("segment").agg(
        F.count("customer_id").alias("customer_count"),
        C.avg_round("clv", 2).alias("avg_clv"),
        F.sum(C.money("clv")).cast("double").alias("total_clv")))
    return g.select("*",
                    C.pct(F.col("customer_count") / F.sum("customer_count").over(_all()))
                     .alias("pct_customers"),
                    C.pct(F.col("total_clv") / F.sum("total_clv").over(_all())).alias("pct_total_clv"))


def eda_segment_summary(T: Tables) -> DataFrame:
    return _segments(T).transform(presented, "segment")


def eda_segment_multiple(T: Tables) -> DataFrame:
    s = T.c.where(F.col("segment").isNotNull()).groupBy("segment").agg(
        C.avg_round("clv", 2).alias("avg_clv"))
    a = s.agg(F.max(F.when(F.col("segment") == "Corporate", F.col("avg_clv"))).alias("corporate_avg_clv"),
              F.max(F.when(F.col("segment") == "Retail", F.col("avg_clv"))).alias("retail_avg_clv"))
    return a.withColumn("corporate_retail_multiple",
                        F.round(C.ratio(F.col("corporate_avg_clv"), F.col("retail_avg_clv")), 2))


def _categories(T: Tables) -> DataFrame:
    return (T.k.where(F.col("issue_category").isNotNull()).groupBy("issue_category").agg(
        F.count("ticket_id").alias("ticket_count"),
        C.avg_round("resolution_days", 2).alias("avg_resolution_days"),
        F.round(F.avg("sla_breached"), 2).alias("sla_breach_rate"),
        F.round(F.avg("csat_score"), 2).alias("avg_csat")))


def eda_category_summary(T: Tables) -> DataFrame:
    return _categories(T).transform(presented, F.desc("ticket_count"), "issue_category")


def eda_category_focus(T: Tables) -> DataFrame:
    return (_categories(T).where(F.col("issue_category").isin("Billing", "General Enquiry"))
            .select("issue_category", "avg_resolution_days", "avg_csat"))


def _tickets_by_month(T: Tables) -> DataFrame:
    return T.k.groupBy(F.month("ticket_date").alias("month")).agg(
        F.count("ticket_id").alias("ticket_count"))


def eda_tickets_by_month(T: Tables) -> DataFrame:
    m = F.col("month")
    return (_tickets_by_month(T).select(
        "month", "ticket_count",
        F.date_format(F.make_date(F.lit(2000), m, F.lit(1)), "MMM").alias("month_name"),
        F.when(m.isin(*K.PEAK_MONTHS), "Critical peak")
         .when(m == K.HIGH_VOLUME_MONTH, "High").otherwise("Normal").alias("volume_class"))
        .transform(presented, "month"))


def eda_ticket_peak(T: Tables) -> DataFrame:
    a = _tickets_by_month(T).agg(
        F.avg(F.when(F.col("month").isin(*K.PEAK_MONTHS), F.col("ticket_count"))).alias("_peak"),
        F.avg("ticket_count").alias("_avg"))
    return a.select(F.round("_peak", 2).alias("peak_month_avg"),
                    F.round("_avg", 2).alias("monthly_avg"),
                    F.round((F.col("_peak") / F.col("_avg") - 1) * 100, 1).alias("peak_premium_pct"))


def _locations(T: Tables) -> DataFrame:
    return (T.k.where(F.col("location_id").isNotNull()).groupBy("location_id").agg(
        F.count("ticket_id").alias("total_tickets"),
        F.round(F.avg("sla_breached"), 3).alias("sla_breach_rate"),
        F.round(F.avg("csat_score"), 3).alias("avg_csat")))


def eda_location_sla(T: Tables) -> DataFrame:
    return _locations(T).transform(presented, F.desc("sla_breach_rate"), "location_id")


def eda_location_rag(T: Tables) -> DataFrame:
    r, s = F.col("sla_breach_rate"), F.col("avg_csat")
    return (_locations(T).select(
        "location_id", "sla_breach_rate", "avg_csat",
        F.when(r > K.LOCATION_BREACH_DANGER_ABOVE, "danger")
         .when(r > K.LOCATION_BREACH_WARNING_ABOVE, "warning").otherwise("primary")
         .alias("breach_class"),
        F.when(s < K.LOCATION_CSAT_DANGER_BELOW, "danger")
         .when(s < K.LOCATION_CSAT_WARNING_BELOW, "warning").otherwise("primary")
         .alias("csat_class"),
        (r > K.BREACH_TARGET_RATE).alias("above_target"))
        .transform(presented, "location_id"))


def eda_location_extremes(T: Tables) -> DataFrame:
    """Worst = first and best = last location when sorted by breach rate
    descending, then location id."""
    rank = F.struct(-F.col("sla_breach_rate"), F.col("location_id"))
    row = F.struct("location_id", "sla_breach_rate", "avg_csat")
    a = _locations(T).agg(F.min_by(row, rank).alias("w"), F.max_by(row, rank).alias("b"))
    return a.select(F.col("w.location_id").alias("worst_location"),
                    F.col("w.sla_breach_rate").alias("worst_breach_rate"),
                    F.col("w.avg_csat").alias("worst_csat"),
                    F.col("b.location_id").alias("best_location"),
                    F.col("b.sla_breach_rate").alias("best_breach_rate"))


QUERIES = {
    "eda_time_cols": eda_time_cols,
    "eda_known_only": eda_known_only,
    "eda_revenue_summary": eda_revenue_summary,
    "eda_monthly_revenue": eda_monthly_revenue,
    "eda_peak_premium": eda_peak_premium,
    "eda_country_top8": eda_country_top8,
    "eda_uk_share": eda_uk_share,
    "eda_segment_summary": eda_segment_summary,
    "eda_segment_multiple": eda_segment_multiple,
    "eda_category_summary": eda_category_summary,
    "eda_category_focus": eda_category_focus,
    "eda_tickets_by_month": eda_tickets_by_month,
    "eda_ticket_peak": eda_ticket_peak,
    "eda_location_sla": eda_location_sla,
    "eda_location_rag": eda_location_rag,
    "eda_location_extremes": eda_location_extremes,
}
