"""Business-implication jobs: portfolio exposure, churn scenarios, Q4 risk,
segment exposure and the ranked action list.

Scalar KPIs are single-row aggregates attached as uncorrelated scalar
subqueries (evaluated once, no join); the scenario and action lists
are fixed label rows joined to computed figures. Money is summed as
DECIMAL(18,2), so totals are exact at any row count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from svcops.functions import columns as C
from svcops.functions.frames import presented, with_scalars
from svcops.functions import constants as K
from svcops.operators.experience import at_risk, tickets_per_customer
from svcops.sources.catalog import Tables

def _rate20():
    return F.lit("0.20").cast("decimal(3,2)")


def _portfolio_clv(T: Tables) -> DataFrame:
    return T.c.agg(F.sum(C.money("clv")).alias("total_clv"))


def _risk_clv(T: Tables) -> DataFrame:
    return at_risk(T).agg(F.sum(C.money("clv")).alias("clv_at_risk"),
                          F.count(F.lit(1)).alias("customers_at_risk"))


def bi_portfolio(T: Tables) -> DataFrame:
    rev = T.t.agg(F.round(C.total("revenue"), 2).alias("total_revenue"))
    return (with_scalars(with_scalars(_portfolio_clv(T), rev), _risk_clv(T)).select(
        F.col("total_clv").cast("double").alias("total_clv"),
        "total_revenue",
        F.col("clv_at_risk").cast("double").alias("clv_at_risk"),
        C.pct(F.col("clv_at_risk").cast("double") / F.col("total_clv").cast("double"))
         .alias("pct_at_risk"),
        "customers_at_risk"))


def bi_sla_cost(T: Tables) -> DataFrame:
    """CLV touched by breaches, counted once per breached ticket: tickets are
    summed per customer first, then weighted by the customer's CLV."""
    per = tickets_per_customer(T).join(T.c.select("customer_id", "clv"), "customer_id", "left")
    has_clv = F.col("clv").isNotNull()
    a = per.agg(
        C.pct(F.sum("_b") / F.sum("_n")).alias("breach_rate_pct"),
        F.sum("_n").alias("total_tickets"),
        F.sum("_b").alias("breached_tickets"),
        C.round_ratio(F.sum(C.money("clv") * F.col("_b")), F.sum(F.when(has_clv, F.col("_b"))), 2)
         .alias("avg_clv_per_breach"),
        F.sum(C.money("clv") * F.col("_b")).cast("double").alias("total_clv_touched"))
    return a.withColumn("monthly_breaches",
                        F.expr(f"breached_tickets div {int(T.months)}"))


def bi_churn_scenarios(T: Tables) -> DataFrame:
    sc = T.spark.createDataFrame(list(K.CHURN_SCENARIOS), "scenario string, rate string")
    base = with_scalars(_risk_clv(T), _portfolio_clv(T))
    loss = F.round(F.col("clv_at_risk") * F.col("rate").cast("decimal(3,2)"), 2)
    return (with_scalars(sc, base).select(
        "scenario",
        F.col("rate").cast("double").alias("churn_rate"),
        loss.cast("double").alias("clv_loss"),
        C.pct(loss.cast("double") / F.col("total_clv").cast("double")).alias("pct_of_portfolio"),
        F.round(loss.cast("double") / 12, 2).alias("monthly_loss"))
        .transform(presented, "churn_rate"))


def _quarterly(T: Tables) -> DataFrame:
    return (T.t_years(T.years).groupBy(F.year("invoice_date").alias("year"),
                                F.quarter("invoice_date").alias("quarter"))
            .agg(C.total("revenue").alias("_rev")))


def bi_quarterly_revenue(T: Tables) -> DataFrame:
    return (_quarterly(T).select("year", "quarter", F.round("_rev", 2).alias("revenue"))
            .transform(presented, "year", "quarter"))


def _q4(T: Tables) -> DataFrame:
    is_q4 = F.month("invoice_date").isin(*K.Q4_MONTHS)
    return T.t_years(T.years).agg(C.total(F.when(is_q4, F.col("revenue"))).alias("q4"),
                           C.total("revenue").alias("annual"))


def bi_q4_share(T: Tables) -> DataFrame:
    return _q4(T).select(
        F.round("q4", 2).alias("q4_revenue"),
        F.round("annual", 2).alias("annual_revenue"),
        C.pct(F.col("q4") / F.col("annual")).alias("q4_share_pct"),
        F.round(F.col("q4") * 0.05, 2).alias("q4_loss_5pct"))


def bi_q4_tickets(T: Tables) -> DataFrame:
    is_q4 = F.month("ticket_date").isin(*K.Q4_MONTHS)
    return T.k.agg(
        F.count_if(is_q4).alias("q4_tickets"),
        C.pct(F.count_if(is_q4) / F.count(F.lit(1))).alias("q4_ticket_share_pct"),
        C.pct(F.avg(F.when(is_q4, F.col("sla_breached")))).alias("q4_breach_rate_pct"))


def bi_avg_quarter(T: Tables) -> DataFrame:
    return (_quarterly(T).groupBy("quarter")
            .agg(C.avg_round("_rev", 2).alias("avg_quarter_revenue"))
            .transform(presented, "quarter"))


def bi_month_spine(T: Tables) -> DataFrame:
    """Tickets per calendar month 1..12, zero where a month has none."""
    spine = T.spark.range(1, 13).select(F.col("id").cast("int").alias("month"))
    counts = (T.k.groupBy(F.month("ticket_date").alias("month"))
              .agg(F.count("ticket_id").alias("_n")))
    return (spine.join(F.broadcast(counts), "month", "left")
            .select("month", F.coalesce(F.col("_n"), F.lit(0)).alias("ticket_count"))
            .transform(presented, "month"))


def _segment_exposure(T: Tables) -> DataFrame:
    risk = (at_risk(T).where(F.col("segment").isNotNull()).groupBy("segment").agg(
        F.count("customer_id").alias("customers_at_risk"),
        F.sum(C.money("clv")).alias("_risk"),
        C.avg_round("clv", 2).alias("avg_clv")))
    seg = (T.c.where(F.col("segment").isNotNull()).groupBy("segment")
           .agg(F.sum(C.money("clv")).alias("_seg")))
    return risk.join(F.broadcast(seg), "segment", "left").select(
        "segment", "customers_at_risk",
        F.col("_risk").cast("double").alias("clv_at_risk"), "avg_clv",
        C.pct(F.col("_risk").cast("double") / F.col("_seg").cast("double"))
         .alias("pct_segment_clv_at_risk"))


def bi_segment_exposure(T: Tables) -> DataFrame:
    return _segment_exposure(T).transform(presented, "segment")


def _corporate_case(T: Tables) -> DataFrame:
    e = _segment_exposure(T)
    corp = F.col("segment") == "Corporate"
    retail = F.col("segment") == "Retail"
    a = e.agg(F.max(F.when(corp, F.col("avg_clv"))).alias("corporate_avg_clv_at_risk"),
              F.max(F.when(retail, F.col("avg_clv"))).alias("retail_avg_clv_at_risk"),
              F.max(F.when(corp, F.col("clv_at_risk"))).alias("_corp_risk"),
              F.max(F.when(retail, F.col("clv_at_risk"))).alias("retail_clv_at_risk"))
    loss = F.round(F.col("_corp_risk").cast("decimal(18,2)") * _rate20(), 2).cast("double")
    return a.select(
        "corporate_avg_clv_at_risk", "retail_avg_clv_at_risk",
        F.round(C.ratio(F.col("corporate_avg_clv_at_risk"), F.col("retail_avg_clv_at_risk")), 2)
         .alias("corporate_retail_multiple"),
        loss.alias("corporate_loss_20pct"),
        "retail_clv_at_risk",
        (loss > F.col("retail_clv_at_risk")).alias("exceeds_retail_risk"))


def bi_corporate_case(T: Tables) -> DataFrame:
    return _corporate_case(T)


def bi_action_impact(T: Tables) -> DataFrame:
    figures = with_scalars(_corporate_case(T).select("corporate_loss_20pct"),
                           _q4(T).select(F.col("q4").alias("q4_revenue")))
    acts = T.spark.createDataFrame(list(K.ACTIONS),
                                   "priority int, action string, timeline string, owner string")
    p = F.col("priority")
    value = (F.when(p == 1, F.col("corporate_loss_20pct"))
             .when(p == 4, F.col("q4_revenue")))
    text = F.when(p == 1, F.concat(F.lit("GBP"), F.format_number("corporate_loss_20pct", 0),
                                   F.lit(" CLV protected at 20% churn prevention")))
    text = text.when(p == 4, F.concat(F.lit("Protects GBP"), F.format_number("q4_revenue", 0),
                                      F.lit(" Q4 revenue from service-driven churn")))
    for prio, fixed in K.ACTION_IMPACT_TEXT.items():
        text = text.when(p == prio, F.lit(fixed))
    return (with_scalars(acts, figures).select(
        "priority", "action", "timeline", "owner", text.alias("financial_impact"),
        F.round(value, 2).alias("impact_gbp"))
        .transform(presented, "priority"))


def bi_five_numbers(T: Tables) -> DataFrame:
    breach = T.k.agg(C.pct(F.avg("sla_breached")).alias("breach_rate_pct"))
    q4 = _q4(T).select(C.pct(F.col("q4") / F.col("annual")).alias("q4_share_pct"))
    base = with_scalars(_risk_clv(T), _portfolio_clv(T))
    return with_scalars(with_scalars(base, breach), q4).select(
        F.col("clv_at_risk").cast("double").alias("clv_at_risk"),
        C.pct(F.col("clv_at_risk").cast("double") / F.col("total_clv").cast("double"))
         .alias("clv_at_risk_pct"),
        "breach_rate_pct", "q4_share_pct",
        F.round(F.col("clv_at_risk") * _rate20(), 2).cast("double").alias("loss_at_20pct"))


QUERIES = {
    "bi_portfolio": bi_portfolio,
    "bi_sla_cost": bi_sla_cost,
    "bi_churn_scenarios": bi_churn_scenarios,
    "bi_quarterly_revenue": bi_quarterly_revenue,
    "bi_q4_share": bi_q4_share,
    "bi_q4_tickets": bi_q4_tickets,
    "bi_avg_quarter": bi_avg_quarter,
    "bi_month_spine": bi_month_spine,
    "bi_segment_exposure": bi_segment_exposure,
    "bi_corporate_case": bi_corporate_case,
    "bi_action_impact": bi_action_impact,
    "bi_five_numbers": bi_five_numbers,
}
