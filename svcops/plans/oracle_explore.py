"""DuckDB oracle text for the exploratory and market-context jobs."""

from __future__ import annotations

from svcops.functions import constants as K
from svcops.plans.oracle_text import avg_r, tot

Y = ", ".join(str(y) for y in K.YEARS)

_PEAK_REV = "CASE WHEN month_str LIKE '%-11' OR month_str LIKE '%-12' THEN rev END"
_BILLING_DAYS = "CASE WHEN issue_category = 'Billing' THEN resolution_days END"
_REFUND_DAYS = "CASE WHEN issue_category = 'Refund' THEN resolution_days END"

_MONTHLY = f"""
, monthly AS (SELECT strftime(invoice_date, '%Y-%m') AS month_str, {tot('revenue')} AS rev
              FROM transactions WHERE year(invoice_date) IN ({Y}) GROUP BY 1)"""


def _top(n: int) -> str:
    return f"""
, top AS (SELECT country, rev FROM (SELECT country, {tot('revenue')} AS rev FROM transactions
                                    WHERE customer_id != 'GUEST' GROUP BY country)
          ORDER BY rev DESC, country LIMIT {n})"""


_SEG = f"""
, seg AS (SELECT segment, count(customer_id) AS customer_count, {avg_r('clv', 2)} AS avg_clv,
                 CAST(sum(CAST(clv AS DECIMAL(18,2))) AS DOUBLE) AS total_clv
          FROM customers WHERE segment IS NOT NULL GROUP BY segment)"""
_CAT = f"""
, cat AS (SELECT issue_category, count(ticket_id) AS ticket_count,
                 {avg_r('resolution_days', 2)} AS avg_resolution_days,
                 round(avg(sla_breached), 2) AS sla_breach_rate, round(avg(csat_score), 2) AS avg_csat
          FROM tickets WHERE issue_category IS NOT NULL GROUP BY issue_category)"""
_TBM = """
, tbm AS (SELECT CAST(month(ticket_date) AS INTEGER) AS month, count(ticket_id) AS ticket_count
          FROM tickets GROUP BY 1)"""
_LOC = """
, loc AS (SELECT location_id, count(ticket_id) AS total_tickets,
                 round(avg(sla_breached), 3) AS sla_breach_rate, round(avg(csat_score), 3) AS avg_csat
          FROM tickets WHERE location_id IS NOT NULL GROUP BY location_id)"""
_INT = f"""
, im AS (SELECT round(avg(csat_score), 2) AS avg_csat,
                {avg_r('resolution_days', 2)} AS avg_resolution_days,
                round(avg(sla_breached) * 100, 1) AS sla_breach_rate,
                round(avg(CAST(csat_responded AS INTEGER)) * 100, 1) AS csat_response_rate,
                {avg_r(_BILLING_DAYS, 2)} AS billing_resolution,
                {avg_r(_REFUND_DAYS, 2)} AS refund_resolution
         FROM tickets),
tm AS (SELECT {tot("CASE WHEN country = 'United Kingdom' THEN revenue END")} / {tot('revenue')} * 100 AS uk,
              {tot("CASE WHEN country = 'Germany' THEN revenue END")} / {tot('revenue')} * 100 AS de,
              {tot("CASE WHEN country = 'France' THEN revenue END")} / {tot('revenue')} * 100 AS fr
       FROM transactions),
m AS (SELECT im.*, round(tm.uk, 1) AS uk_revenue_pct, tm.de, tm.fr FROM im, tm)"""

_BENCH = " UNION ALL ".join(
    f"SELECT '{c}' AS issue_category, CAST({i} AS DOUBLE) AS industry_avg, "
    f"CAST({b} AS DOUBLE) AS best_practice, {n} AS list_order"
    for n, (c, i, b) in enumerate(K.RESOLUTION_BENCHMARKS))
_RGAP = f"""
, bench AS ({_BENCH}),
own AS (SELECT issue_category, {avg_r('resolution_days', 2)} AS internal_days
        FROM tickets GROUP BY issue_category),
rgap AS (SELECT b.issue_category, o.internal_days, b.industry_avg, b.best_practice,
                round(o.internal_days - b.industry_avg, 2) AS gap_vs_industry,
                round(o.internal_days - b.best_practice, 2) AS gap_vs_best_practice, b.list_order
         FROM bench b LEFT JOIN own o ON b.issue_category = o.issue_category)"""
_CSAT_ROWS = " UNION ALL ".join(
    [f"SELECT '{K.OWN_BUSINESS}' AS name, CAST(NULL AS DOUBLE) AS benchmark"]
    + [f"SELECT '{n}', CAST({s} AS DOUBLE)" for n, s in K.CSAT_BENCHMARKS])
_GEO_ROWS = " UNION ALL ".join(
    f"SELECT '{g}' AS country_group, CAST({p} AS DOUBLE) AS benchmark_pct, {i} AS list_order"
    for i, (g, p) in enumerate(K.GEO_MIX_BENCHMARK))
_SC_ROWS = " UNION ALL ".join(
    f"SELECT '{n}' AS metric, CAST({i} AS DOUBLE) AS industry_avg, CAST({b} AS DOUBLE) AS best_practice, "
    f"{str(lo).lower()} AS lower_is_better, {k} AS list_order"
    for k, (n, i, b, lo) in enumerate(K.SCORECARD_BENCHMARKS))

_EXP_ROWS = " UNION ALL ".join(
    f"SELECT '{e}' AS expectation, {g} AS german_pct, {u} AS eu_pct, {i} AS list_order"
    for i, (e, g, u) in enumerate(K.EXPECTATIONS))

SQL = {
    "eda_time_cols": """SELECT invoice, stock_code, invoice_date,
       CAST(year(invoice_date) AS INTEGER) AS year, CAST(month(invoice_date) AS INTEGER) AS month,
       strftime(invoice_date, '%Y-%m') AS month_str FROM transactions""",
    "eda_known_only": "SELECT * FROM transactions WHERE customer_id != 'GUEST'",
    "eda_revenue_summary": f"""
SELECT round(sum(inv), 2) AS total_revenue, count(*) AS total_orders,
       {avg_r('inv', 2)} AS avg_order_value,
       (SELECT count(DISTINCT customer_id) FROM transactions WHERE customer_id != 'GUEST') AS total_customers,
       (SELECT round(avg(CAST(is_guest AS INTEGER)) * 100, 1) FROM transactions) AS guest_pct
FROM (SELECT invoice, {tot('revenue')} AS inv FROM transactions GROUP BY invoice)""",
    "eda_monthly_revenue": _MONTHLY + """
SELECT month_str, round(rev, 2) AS revenue FROM monthly ORDER BY month_str""",
    "eda_peak_premium": _MONTHLY + f"""
SELECT {avg_r('rev', 2)} AS avg_monthly_revenue,
       {avg_r(_PEAK_REV, 2)} AS avg_peak_revenue,
       round((avg(rev) FILTER (WHERE month_str LIKE '%-11' OR month_str LIKE '%-12') / avg(rev) - 1) * 100, 1)
         AS peak_premium_pct
FROM monthly""",
    "eda_country_top8": _top(8) + """
SELECT country, round(rev, 2) AS revenue, round(rev / sum(rev) OVER () * 100, 1) AS revenue_pct
FROM top ORDER BY revenue DESC""",
    "eda_uk_share": _top(8) + """
SELECT country, revenue_pct FROM (SELECT country, round(rev / sum(rev) OVER () * 100, 1) AS revenue_pct
                                  FROM top) WHERE country = 'United Kingdom'""",
    "eda_segment_summary": _SEG + """
SELECT *, round(customer_count / sum(customer_count) OVER () * 100, 1) AS pct_customers,
       round(total_clv / sum(total_clv) OVER () * 100, 1) AS pct_total_clv FROM seg""",
    "eda_segment_multiple": _SEG + """
SELECT corporate_avg_clv, retail_avg_clv,
       round(corporate_avg_clv / nullif(retail_avg_clv, 0), 2) AS corporate_retail_multiple
FROM (SELECT max(CASE WHEN segment = 'Corporate' THEN avg_clv END) AS corporate_avg_clv,
             max(CASE WHEN segment = 'Retail' THEN avg_clv END) AS retail_avg_clv FROM seg)""",
    "eda_category_summary": _CAT + "\nSELECT * FROM cat ORDER BY ticket_count DESC",
    "eda_category_focus": _CAT + """
SELECT issue_category, avg_resolution_days, avg_csat FROM cat
WHERE issue_category IN ('Billing', 'General Enquiry')""",
    "eda_tickets_by_month": _TBM + """
SELECT month, ticket_count, strftime(make_date(2000, month, 1), '%b') AS month_name,
       CASE WHEN month IN (11, 12) THEN 'Critical peak' WHEN month = 10 THEN 'High'
            ELSE 'Normal' END AS volume_class
FROM tbm ORDER BY month""",
    "eda_ticket_peak": _TBM + """
SELECT round(avg(ticket_count) FILTER (WHERE month IN (11, 12)), 2) AS peak_month_avg,
       round(avg(ticket_count), 2) AS monthly_avg,
       round((avg(ticket_count) FILTER (WHERE month IN (11, 12)) / avg(ticket_count) - 1) * 100, 1)
         AS peak_premium_pct
FROM tbm""",
    "eda_location_sla": _LOC + "\nSELECT * FROM loc ORDER BY sla_breach_rate DESC",
    "eda_location_rag": _LOC + """
SELECT location_id, sla_breach_rate, avg_csat,
       CASE WHEN sla_breach_rate > 0.90 THEN 'danger' WHEN sla_breach_rate > 0.80 THEN 'warning'
            ELSE 'primary' END AS breach_class,
       CASE WHEN avg_csat < 2.5 THEN 'danger' WHEN avg_csat < 3.0 THEN 'warning'
            ELSE 'primary' END AS csat_class,
       sla_breach_rate > 0.30 AS above_target
FROM loc ORDER BY location_id""",
    "eda_location_extremes": _LOC + """
, w AS (SELECT * FROM loc ORDER BY sla_breach_rate DESC, location_id LIMIT 1),
b AS (SELECT * FROM loc ORDER BY sla_breach_rate ASC, location_id DESC LIMIT 1)
SELECT w.location_id AS worst_location, w.sla_breach_rate AS worst_breach_rate,
       w.avg_csat AS worst_csat, b.location_id AS best_location,
       b.sla_breach_rate AS best_breach_rate
FROM w, b""",

    "mk_internal": _INT + """
SELECT metric, value FROM (SELECT avg_csat, avg_resolution_days, sla_breach_rate, csat_response_rate,
                                  billing_resolution, refund_resolution, uk_revenue_pct FROM m)
UNPIVOT INCLUDE NULLS (value FOR metric IN (avg_csat, avg_resolution_days, sla_breach_rate,
                                            csat_response_rate, billing_resolution,
                                            refund_resolution, uk_revenue_pct))""",
    "mk_csat_gap": _INT + f"""
, rows_ AS ({_CSAT_ROWS})
SELECT name, coalesce(benchmark, m.avg_csat) AS score,
       round(coalesce(benchmark, m.avg_csat) - m.avg_csat, 2) AS gap,
       CASE WHEN name = '{K.OWN_BUSINESS}' THEN 'INTERNAL'
            WHEN round(coalesce(benchmark, m.avg_csat) - m.avg_csat, 2) > 0 THEN 'GAP'
            ELSE 'ABOVE' END AS status
FROM rows_, m""",
    "mk_resolution_gap": _RGAP + """
SELECT issue_category, internal_days, industry_avg, best_practice, gap_vs_industry,
       gap_vs_best_practice FROM rgap ORDER BY list_order""",
    "mk_resolution_worst": _RGAP + f"""
SELECT (SELECT issue_category FROM rgap ORDER BY gap_vs_industry DESC, list_order LIMIT 1)
         AS worst_category,
       max(gap_vs_industry) AS worst_gap_vs_industry,
       round(max(CASE WHEN issue_category = 'Billing' THEN internal_days END)
             / {K.BILLING_INDUSTRY_DAYS}, 1) AS billing_multiple,
       min(gap_vs_industry) > 0 AS all_above_industry
FROM rgap""",
    "mk_expectations": _INT + f"""
, ex AS ({_EXP_ROWS})
SELECT expectation, german_pct, eu_pct, german_pct - eu_pct AS difference_pts, avg_resolution_days,
       avg_resolution_days <= {K.RESPONSE_EXPECTATION_DAYS} AS meets_24h_expectation
FROM ex, m ORDER BY list_order""",
    "mk_country_top6": _top(6) + """
SELECT country, round(rev, 2) AS revenue, round(rev / sum(rev) OVER () * 100, 1) AS share_pct
FROM top ORDER BY revenue DESC""",
    "mk_geo_mix": _INT + f"""
, own AS (SELECT 'UK' AS g, uk_revenue_pct AS own_pct FROM m
          UNION ALL SELECT 'Germany', round(de, 1) FROM m
          UNION ALL SELECT 'France', round(fr, 1) FROM m
          UNION ALL SELECT 'Other', round(100 - uk_revenue_pct - de - fr, 1) FROM m),
geo AS ({_GEO_ROWS})
SELECT geo.country_group, own.own_pct, geo.benchmark_pct,
       round(own.own_pct - geo.benchmark_pct, 1) AS gap_pts
FROM geo LEFT JOIN own ON geo.country_group = own.g ORDER BY geo.list_order""",
    "mk_scorecard": _INT + f"""
, sc AS ({_SC_ROWS}),
v AS (SELECT sc.*, CASE metric WHEN 'CSAT Score' THEN avg_csat
                               WHEN 'Avg Resolution Days' THEN avg_resolution_days
                               WHEN 'Billing Resolution' THEN billing_resolution
                               WHEN 'SLA Breach Rate' THEN sla_breach_rate
                               WHEN 'CSAT Response Rate' THEN csat_response_rate
                               WHEN 'UK Revenue Share' THEN uk_revenue_pct END AS ours
      FROM sc, m)
SELECT metric, ours, industry_avg, best_practice,
       CASE WHEN (CASE WHEN lower_is_better THEN (ours - industry_avg) / industry_avg
                       ELSE (industry_avg - ours) / industry_avg END) > {K.SCORECARD_CRITICAL_SHORTFALL}
            THEN 'CRITICAL'
            WHEN (CASE WHEN lower_is_better THEN (ours - industry_avg) / industry_avg
                       ELSE (industry_avg - ours) / industry_avg END) > 0 THEN 'AT RISK'
            ELSE 'OK' END AS status
FROM v ORDER BY list_order""",
}
