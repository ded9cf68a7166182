"""Customer-experience jobs: service burden, resolution bands, churn risk.

The per-customer risk profile aggregates tickets to one row per customer
*before* meeting the customer table, which is also brought to one row per id;
an id listed twice counts as grouping the joined rows would count it.
"Hot" customers only add partial-aggregate rows per map task.
The profile is staged once and reused by the experience and implication
reports, as the original writes it to a file for the next notebook. Its sums of
tickets per customer are kept by input file: a new month of tickets is read
alone and its sums are merged with the former ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from svcops.functions import columns as C
from svcops.functions.frames import presented, with_scalars
from svcops.functions import constants as K
from svcops.sources import layouts as L
from svcops.sources.catalog import Tables


def ticket_customer(T: Tables) -> DataFrame:
    """Tickets left-joined to the customer attributes used downstream. Staged
    tables lie by (customer, slice of its tickets): neither side is shuffled,
    and a customer with many tickets is spread over tasks."""
    attributes = ("customer_id", "segment", "clv", "region")
    if not T.staged:
        return T.k.join(T.c.select(*attributes), "customer_id", "left")
    tickets, listed = L.tickets_and_customers(T)
    return tickets.join(listed.select(*attributes, L.SLICE), ["customer_id", L.SLICE], "left").drop(L.SLICE)


def customer_attributes(T: Tables) -> DataFrame:
    """One row per customer id: its attributes and how often it is listed."""
    return T.c.where(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(
        F.max("segment").alias("segment"), F.max("clv").alias("clv"),
        F.max("region").alias("region"), F.count(F.lit(1)).alias("_m"))


def _ticket_sums(tickets: DataFrame) -> DataFrame:
    """Sums of tickets per customer: exact, so they merge in any order."""
    return tickets.where(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(
        F.count("ticket_id").alias("_n"), F.sum("sla_breached").alias("_b"),
        F.sum(C.exact("csat_score")).alias("_cs"), F.count("csat_score").alias("_cn"),
        F.sum(C.exact("resolution_days")).alias("_ds"), F.count("resolution_days").alias("_dn"))


def _merged_sums(parts: DataFrame) -> DataFrame:
    return parts.groupBy("customer_id").agg(*[
        F.sum(c).cast(parts.schema[c].dataType).alias(c) for c in ("_n", "_b", "_cs", "_cn", "_ds", "_dn")])


def ticket_sums(T: Tables) -> DataFrame:
    return T.summed("ticket_sums", "tickets", _ticket_sums, _merged_sums)


def ticket_totals(T: Tables) -> DataFrame:
    """Ticket sums per customer, laid out by the id for joins with customers."""
    return L.by_customer(T, "ticket_totals", lambda: ticket_sums(T))


def _risk_profile(T: Tables) -> DataFrame:
    per = ticket_sums(T).withColumn(
        "avg_csat", C.ratio(F.col("_cs").cast("double"), F.col("_cn")))
    times = F.coalesce("_m", F.lit(1))  # an id listed twice meets its tickets twice
    prof = per.join(customer_attributes(T), "customer_id", "left").select(
        "customer_id", (F.col("_n") * times).alias("total_tickets"),
        (F.col("_b") * times).alias("sla_breaches"), "avg_csat", "segment", "clv", "region")
    churn = C.churn_risk("sla_breaches", "avg_csat")
    return (prof.withColumn("churn_risk", churn)
                .withColumn("risk_tier", C.risk_tier("churn_risk", "clv")))


def risk_profile(T: Tables) -> DataFrame:
    return T.derived("risk_profile", lambda: _risk_profile(T))


def at_risk(T: Tables) -> DataFrame:
    return risk_profile(T).where(F.col("churn_risk"))


# ------------------------------------------------------------------ registered jobs

def cx_ticket_customer(T: Tables) -> DataFrame:
    return ticket_customer(T)


def cx_match_coverage(T: Tables) -> DataFrame:
    """Tickets whose customer has a segment, of all tickets (counted per
    customer first, so the customer join is on unique keys)."""
    per = T.k.groupBy("customer_id").agg(F.count(F.lit(1)).alias("_n"))
    j = per.join(T.c.select("customer_id", "segment"), "customer_id", "left")
    matched = F.sum(F.when(F.col("segment").isNotNull(), F.col("_n")).otherwise(0))
    return j.agg(matched.alias("matched_tickets"), F.sum("_n").alias("total_tickets")).select(
        "matched_tickets", "total_tickets",
        C.pct(F.col("matched_tickets") / F.col("total_tickets")).alias("coverage_pct"))


def cx_res_band(T: Tables) -> DataFrame:
    return T.k.select("ticket_id", "resolution_days", C.res_band("resolution_days").alias("res_band"))


def tickets_per_customer(T: Tables) -> DataFrame:
    """Ticket sums per customer: the join grain for segment-level ticket
    statistics (a customer-unique join, so no hot join key)."""
    return T.k.groupBy("customer_id").agg(
        F.count("ticket_id").alias("_n"),
        F.sum("sla_breached").alias("_b"),
        F.sum("csat_score").alias("_cs"), F.count("csat_score").alias("_cn"),
        F.sum(C.exact("resolution_days")).alias("_ds"), F.count("resolution_days").alias("_dn"))


def _segment_burden(T: Tables) -> DataFrame:
    per = ticket_totals(T).join(L.customers(T).select("customer_id", "segment"), "customer_id")
    g = (per.where(F.col("segment").isNotNull()).groupBy("segment")
         .agg(*[F.sum(c).alias(c) for c in ("_n", "_b", "_cs", "_cn", "_ds", "_dn")]))
    return g.select(
        "segment", F.col("_n").alias("ticket_count"),
        F.round(F.col("_b") / F.col("_n"), 2).alias("sla_breach_rate"),
        F.round(C.ratio(F.col("_cs").cast("double"), F.col("_cn")), 2).alias("avg_csat"),
        C.round_ratio(F.col("_ds"), F.col("_dn"), 2).alias("avg_resolution"))


def cx_segment_burden(T: Tables) -> DataFrame:
    return _segment_burden(T).transform(presented, F.desc("ticket_count"), "segment")


def _clv_at_risk(T: Tables) -> DataFrame:
    return (at_risk(T).where(F.col("segment").isNotNull())
            .groupBy("segment").agg(
                F.count("customer_id").alias("customers_at_risk"),
                F.sum(C.money("clv")).cast("double").alias("clv_at_risk"),
                C.avg_round("clv", 2).alias("avg_clv_at_risk")))


def cx_segment_focus(T: Tables) -> DataFrame:
    focus = (_segment_burden(T).where(F.col("segment").isin("Corporate", "Wholesale"))
             .select("segment", "avg_resolution", "avg_csat",
                     (F.col("avg_csat") < K.NEUTRAL_CSAT).alias("csat_below_neutral")))
    risk = _clv_at_risk(T).select("segment", "customers_at_risk", "clv_at_risk")
    return focus.join(F.broadcast(risk), "segment", "left").transform(presented, "segment")


def _band_stats(T: Tables) -> DataFrame:
    return (T.k.groupBy(C.res_band("resolution_days").alias("res_band"))
            .agg(F.round(F.avg("csat_score"), 2).alias("avg_csat"),
                 F.count("ticket_id").alias("ticket_count")))


def cx_band_csat(T: Tables) -> DataFrame:
    """All five bands in fixed order, also those without tickets."""
    spine = T.spark.createDataFrame([(b, i + 1) for i, b in enumerate(K.RES_BAND_ORDER)],
                                    "res_band string, band_order int")
    return (spine.join(F.broadcast(_band_stats(T)), "res_band", "left")
            .select("res_band", "band_order", "avg_csat",
                    F.coalesce(F.col("ticket_count"), F.lit(0)).alias("ticket_count"))
            .transform(presented, "band_order"))


def cx_csat_drop(T: Tables) -> DataFrame:
    b = _band_stats(T)
    fast = F.max(F.when(F.col("res_band") == "0-1 days", F.col("avg_csat")))
    slow = F.max(F.when(F.col("res_band") == "5+ days", F.col("avg_csat")))
    return b.agg(fast.alias("fast_csat"), slow.alias("slow_csat")).select(
        "fast_csat", "slow_csat", F.round(F.col("fast_csat") - F.col("slow_csat"), 2).alias("csat_drop"))


def cx_risk_profile(T: Tables) -> DataFrame:
    return risk_profile(T)


def cx_risk_overview(T: Tables) -> DataFrame:
    return risk_profile(T).agg(
        F.count(F.lit(1)).alias("customers_with_tickets"),
        F.count_if("churn_risk").alias("customers_at_risk"),
        C.pct(F.count_if("churn_risk") / F.count(F.lit(1))).alias("at_risk_pct"))


def cx_risk_tiers(T: Tables) -> DataFrame:
    return (risk_profile(T).groupBy("risk_tier").agg(F.count(F.lit(1)).alias("customers"))
            .transform(presented, F.desc("customers"), "risk_tier"))


def cx_clv_at_risk(T: Tables) -> DataFrame:
    return _clv_at_risk(T).transform(presented, "segment")


def cx_clv_share(T: Tables) -> DataFrame:
    risk = at_risk(T).agg(F.sum(C.money("clv")).alias("_risk"))
    port = T.c.agg(F.sum(C.money("clv")).alias("_port"))
    return with_scalars(risk, port).select(
        F.col("_risk").cast("double").alias("total_clv_at_risk"),
        F.col("_port").cast("double").alias("portfolio_clv"),
        C.pct(F.col("_risk").cast("double") / F.col("_port").cast("double")).alias("pct_at_risk"),
        F.round(F.col("_risk") * F.lit(0.20).cast("decimal(3,2)"), 2).cast("double")
         .alias("loss_at_20pct"))


def cx_critical_top20(T: Tables) -> DataFrame:
    return (at_risk(T).where(F.col("risk_tier") == "Critical Risk")
            .select("customer_id", "segment", "region", F.round("clv", 2).alias("clv"),
                    "total_tickets", "sla_breaches", F.round("avg_csat", 2).alias("avg_csat"))
            .orderBy(F.desc("clv"), "customer_id")
            .limit(20))


def cx_response_by_category(T: Tables) -> DataFrame:
    g = (T.k.where(F.col("issue_category").isNotNull()).groupBy("issue_category").agg(
        F.count("ticket_id").alias("total_tickets"),
        F.round(F.avg(F.col("csat_responded").cast("int")), 3).alias("response_rate"),
        F.round(F.avg("csat_score"), 3).alias("avg_csat")))
    r = F.col("response_rate")
    cls = (F.when(r < K.RESPONSE_DANGER_BELOW, "danger")
           .when(r < K.RESPONSE_WARNING_BELOW, "warning").otherwise("primary"))
    return g.withColumn("rate_class", cls).transform(presented, "response_rate", "issue_category")


QUERIES = {
    "cx_ticket_customer": cx_ticket_customer,
    "cx_match_coverage": cx_match_coverage,
    "cx_res_band": cx_res_band,
    "cx_segment_burden": cx_segment_burden,
    "cx_segment_focus": cx_segment_focus,
    "cx_band_csat": cx_band_csat,
    "cx_csat_drop": cx_csat_drop,
    "cx_risk_profile": cx_risk_profile,
    "cx_risk_overview": cx_risk_overview,
    "cx_risk_tiers": cx_risk_tiers,
    "cx_clv_at_risk": cx_clv_at_risk,
    "cx_clv_share": cx_clv_share,
    "cx_critical_top20": cx_critical_top20,
    "cx_response_by_category": cx_response_by_category,
}
