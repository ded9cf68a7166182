"""Dashboard datasets: headline KPIs, CSAT by category, segment risk share.

Staged tables answer every ``segment`` / ``location`` filter from the cells of
``operators.cube``. Unstaged ones push the filters into the scans (``where``
before any aggregation); with a segment, tickets and transaction lines are
summed per customer before the semi-join on the segment's ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from svcops.functions import columns as C
from svcops.functions.frames import presented, with_scalars
from svcops.functions import constants as K
from svcops.operators import cube
from svcops.operators.experience import at_risk
from svcops.sources.catalog import Tables


def _segment_ids(T: Tables, segment: str) -> DataFrame:
    return T.c.where(F.col("segment") == segment).select("customer_id").distinct()


def _service(T: Tables, segment: str | None, location: str | None, *by: str) -> DataFrame:
    """Ticket sums per ``by``. With a segment, tickets are summed per customer
    first, so the join carries one row per customer, however many tickets."""
    k = T.k if location is None else T.k.where(F.col("location_id") == location)
    sums = [F.sum("sla_breached").alias("_b"), F.sum("csat_score").alias("_cs"),
            F.count("csat_score").alias("_cn"), F.count("ticket_id").alias("_n"),
            F.count("sla_breached").alias("_bn")]
    if segment is not None:
        per = k.where(F.col("customer_id").isNotNull()).groupBy("customer_id", *by).agg(*sums)
        k = per.join(_segment_ids(T, segment), "customer_id", "left_semi")
        sums = [F.sum(c).alias(c) for c in ("_b", "_cs", "_cn", "_n", "_bn")]
    return k.groupBy(*by).agg(*sums)


def dash_kpis(T: Tables, segment: str | None = None, location: str | None = None) -> DataFrame:
    if T.staged:
        return cube.kpis(T, segment, location)
    rev, risk = T.t, at_risk(T)
    if segment is None:
        rev = rev.agg(F.round(C.total("revenue"), 2).alias("total_revenue"))
    else:  # guests are in no segment: their lines never reach the shuffle
        per = (rev.where(F.col("customer_id") != K.GUEST).groupBy("customer_id")
               .agg(F.sum(C.exact("revenue")).alias("_rev")))
        rev = (per.join(_segment_ids(T, segment), "customer_id", "left_semi")
               .agg(F.round(F.sum("_rev").cast("double"), 2).alias("total_revenue")))
        risk = risk.where(F.col("segment") == segment)
    if location is not None:
        ids = T.k.where(F.col("location_id") == location).select("customer_id").distinct()
        risk = risk.join(ids, "customer_id", "left_semi")
    svc = _service(T, segment, location).select(
        C.pct(C.ratio(F.col("_b"), F.col("_bn"))).alias("breach_rate_pct"),
        F.round(C.ratio(F.col("_cs"), F.col("_cn")), 2).alias("avg_csat"))
    clv = risk.agg(F.sum(C.money("clv")).cast("double").alias("clv_at_risk"))
    return with_scalars(with_scalars(rev, svc), clv)


def dash_kpis_corporate(T: Tables) -> DataFrame:
    """The headline figures filtered to one segment."""
    return dash_kpis(T, segment="Corporate")


def dash_csat_by_category(T: Tables, segment: str | None = None,
                          location: str | None = None) -> DataFrame:
    sums = (cube.csat_by_category(T, segment, location) if T.staged
            else _service(T, segment, location, "issue_category"))
    return (sums.where(F.col("issue_category").isNotNull())
            .select("issue_category", F.round(C.ratio(F.col("_cs"), F.col("_cn")), 2).alias("avg_csat"),
                    F.col("_n").alias("ticket_count"))
            .transform(presented, F.asc_nulls_last("avg_csat"), "issue_category"))


def dash_segment_risk_share(T: Tables) -> DataFrame:
    g = (at_risk(T).where(F.col("segment").isNotNull()).groupBy("segment")
         .agg(F.sum(C.money("clv")).cast("double").alias("clv_at_risk")))
    return (g.withColumn("share_pct",
                         C.pct(F.col("clv_at_risk") / F.sum("clv_at_risk").over(Window.partitionBy())))
            .transform(presented, F.desc("clv_at_risk"), "segment"))


def weekly_breach(T: Tables) -> DataFrame:
    """Weekly (Monday-start) breach rate per location: the batch form of
    :func:`svcops.streaming.weekly.weekly_breach_stream`."""
    from svcops.streaming.weekly import weekly_breach_agg
    return weekly_breach_agg(T.k)


QUERIES = {
    "dash_kpis": dash_kpis,
    "dash_kpis_corporate": dash_kpis_corporate,
    "dash_csat_by_category": dash_csat_by_category,
    "dash_segment_risk_share": dash_segment_risk_share,
    "weekly_breach": weekly_breach,
}
