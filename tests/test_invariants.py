"""Invariants of the reports on the driver data."""

from pyspark.sql import functions as F

from svcops.operators import experience as X
from svcops.operators import exploratory as E
from svcops.operators import quality as Q
from svcops.operators import service_queries as SQ
from svcops.sources.catalog import Tables


def test_shares_sum_to_100(spark, sf_dir):
    T = Tables(spark, sf_dir)
    for df, col in ((E.eda_country_top8(T), "revenue_pct"),
                    (E.eda_segment_summary(T), "pct_customers"),
                    (SQ.q3_1_clv_risk_segment(T), "pct_of_total_risk")):
        total = df.agg(F.sum(col)).first()[0]
        assert abs(total - 100) <= 0.05 * df.count() + 1e-9


def test_year_shares_sum_to_100(spark, sf_dir):
    T = Tables(spark, sf_dir)
    for r in SQ.q3_4_quarter_share(T).groupBy("year").agg(F.sum("pct_of_annual_revenue")).collect():
        assert abs(r[1] - 100) <= 0.2


def test_bands_partition_customers(spark, sf_dir):
    T = Tables(spark, sf_dir)
    banded = SQ.q4_3_repeat_bands(T).agg(F.sum("customers")).first()[0]
    known = T.t.where(F.col("customer_id") != "GUEST").select("customer_id").distinct().count()
    assert banded == known
    bands = X.cx_band_csat(T).agg(F.sum("ticket_count")).first()[0]
    assert bands == T.k.count()


def test_report_identities(spark, sf_dir):
    T = Tables(spark, sf_dir)
    rep = {(r["table"], r["metric"]): r for r in Q.dq_report(T).collect()}
    t = rep[("transactions", "total rows")]
    removed = sum(rep[("transactions", m)]["before"] for m in (
        "cancellation invoices removed", "zero/negative quantity rows", "zero/negative price rows"))
    assert t["change"] == removed == t["before"] - t["after"]
    assert t["after"] == T.t.count()
    c = rep[("customers", "total rows")]
    assert c["change"] == rep[("customers", "duplicate rows")]["before"]
    assert c["after"] == T.c.count()
    assert rep[("tickets", "total rows")]["change"] == 0


def test_clean_customer_ids_unique(spark, sf_dir):
    T = Tables(spark, sf_dir)
    assert T.c.select("customer_id").distinct().count() == T.c.count()
    prof = X.risk_profile(T)
    assert prof.select("customer_id").distinct().count() == prof.count()
