"""DuckDB oracle text for the customer-experience and business-implication
reports (pandas semantics: null group keys dropped, NaN skipped)."""

from __future__ import annotations

from svcops.functions import constants as K
from svcops.plans.oracle_text import avg_r, tot

Y = ", ".join(str(y) for y in K.YEARS)

_TC = """
, tc AS (SELECT k.*, c.segment, c.clv, c.region
         FROM tickets k LEFT JOIN customers c ON k.customer_id = c.customer_id)"""
_BAND = """CASE WHEN resolution_days IS NULL THEN 'Abandoned' WHEN resolution_days <= 1 THEN '0-1 days'
     WHEN resolution_days <= 2 THEN '1-2 days' WHEN resolution_days <= 5 THEN '2-5 days'
     ELSE '5+ days' END"""
_BURDEN = _TC + f"""
, burden AS (SELECT segment, count(ticket_id) AS ticket_count,
       round(avg(sla_breached), 2) AS sla_breach_rate, round(avg(csat_score), 2) AS avg_csat,
       {avg_r('resolution_days', 2)} AS avg_resolution
  FROM tc WHERE segment IS NOT NULL GROUP BY segment)"""
_CAR = f"""
, car AS (SELECT segment, count(customer_id) AS customers_at_risk,
       CAST(sum(CAST(clv AS DECIMAL(18,2))) AS DOUBLE) AS clv_at_risk,
       {avg_r('clv', 2)} AS avg_clv_at_risk
  FROM risk_profile WHERE churn_risk AND segment IS NOT NULL GROUP BY segment)"""
_BANDS = f"""
, bands AS (SELECT {_BAND} AS res_band, round(avg(csat_score), 2) AS avg_csat,
       count(ticket_id) AS ticket_count FROM tickets GROUP BY 1)"""
_RISK = """
, rk AS (SELECT sum(CAST(clv AS DECIMAL(18,2))) AS clv_at_risk, count(*) AS customers_at_risk
         FROM risk_profile WHERE churn_risk),
pf AS (SELECT sum(CAST(clv AS DECIMAL(18,2))) AS total_clv FROM customers)"""
_Q4 = f"""
, q4 AS (SELECT {tot("CASE WHEN month(invoice_date) IN (10, 11, 12) THEN revenue END")} AS q4,
                {tot('revenue')} AS annual
         FROM transactions WHERE year(invoice_date) IN ({Y}))"""
_QTR = f"""
, qtr AS (SELECT CAST(year(invoice_date) AS INTEGER) AS year,
                 CAST(quarter(invoice_date) AS INTEGER) AS quarter, {tot('revenue')} AS rev
          FROM transactions WHERE year(invoice_date) IN ({Y}) GROUP BY 1, 2)"""
_EXPO = f"""
, expo AS (SELECT r.segment, r.customers_at_risk, CAST(r.risk AS DOUBLE) AS clv_at_risk, r.avg_clv,
       round(CAST(r.risk AS DOUBLE) / CAST(s.seg AS DOUBLE) * 100, 1) AS pct_segment_clv_at_risk
  FROM (SELECT segment, count(customer_id) AS customers_at_risk,
               sum(CAST(clv AS DECIMAL(18,2))) AS risk, {avg_r('clv', 2)} AS avg_clv
        FROM risk_profile WHERE churn_risk AND segment IS NOT NULL GROUP BY segment) r
  LEFT JOIN (SELECT segment, sum(CAST(clv AS DECIMAL(18,2))) AS seg FROM customers
             WHERE segment IS NOT NULL GROUP BY segment) s ON r.segment = s.segment)"""
_CORP = _EXPO + """
, corp AS (SELECT corporate_avg_clv_at_risk, retail_avg_clv_at_risk,
       round(corporate_avg_clv_at_risk / nullif(retail_avg_clv_at_risk, 0), 2) AS corporate_retail_multiple,
       CAST(round(CAST(corp_risk AS DECIMAL(18,2)) * CAST(0.20 AS DECIMAL(3,2)), 2) AS DOUBLE)
         AS corporate_loss_20pct,
       retail_clv_at_risk
  FROM (SELECT max(CASE WHEN segment = 'Corporate' THEN avg_clv END) AS corporate_avg_clv_at_risk,
               max(CASE WHEN segment = 'Retail' THEN avg_clv END) AS retail_avg_clv_at_risk,
               max(CASE WHEN segment = 'Corporate' THEN clv_at_risk END) AS corp_risk,
               max(CASE WHEN segment = 'Retail' THEN clv_at_risk END) AS retail_clv_at_risk
        FROM expo))"""

_ACTIONS = " UNION ALL ".join(
    f"SELECT {p} AS priority, '{a}' AS action, '{t}' AS timeline, '{o}' AS owner"
    for p, a, t, o in K.ACTIONS)
_IMPACT = " ".join(f"WHEN priority = {p} THEN '{txt}'" for p, txt in K.ACTION_IMPACT_TEXT.items())
_SCEN = " UNION ALL ".join(
    f"SELECT '{n}' AS scenario, CAST({r} AS DECIMAL(3,2)) AS rate" for n, r in K.CHURN_SCENARIOS)

SQL = {
    "cx_ticket_customer": """SELECT k.*, c.segment, c.clv, c.region
FROM tickets k LEFT JOIN customers c ON k.customer_id = c.customer_id""",
    "cx_match_coverage": _TC + """
SELECT count(segment) AS matched_tickets, count(*) AS total_tickets,
       round(count(segment) / count(*) * 100, 1) AS coverage_pct FROM tc""",
    "cx_res_band": f"SELECT ticket_id, resolution_days, {_BAND} AS res_band FROM tickets",
    "cx_segment_burden": _BURDEN + "\nSELECT * FROM burden ORDER BY ticket_count DESC",
    "cx_segment_focus": _BURDEN + _CAR + """
SELECT b.segment, b.avg_resolution, b.avg_csat, b.avg_csat < 3.0 AS csat_below_neutral,
       r.customers_at_risk, r.clv_at_risk
FROM burden b LEFT JOIN car r ON b.segment = r.segment
WHERE b.segment IN ('Corporate', 'Wholesale')""",
    "cx_band_csat": _BANDS + """
, spine AS (SELECT * FROM (VALUES ('0-1 days', 1), ('1-2 days', 2), ('2-5 days', 3), ('5+ days', 4),
                                  ('Abandoned', 5)) v(res_band, band_order))
SELECT s.res_band, s.band_order, b.avg_csat, coalesce(b.ticket_count, 0) AS ticket_count
FROM spine s LEFT JOIN bands b ON s.res_band = b.res_band ORDER BY band_order""",
    "cx_csat_drop": _BANDS + """
SELECT fast_csat, slow_csat, round(fast_csat - slow_csat, 2) AS csat_drop
FROM (SELECT max(CASE WHEN res_band = '0-1 days' THEN avg_csat END) AS fast_csat,
             max(CASE WHEN res_band = '5+ days' THEN avg_csat END) AS slow_csat FROM bands)""",
    "cx_risk_profile": "SELECT * FROM risk_profile",
    "cx_risk_overview": """SELECT count(*) AS customers_with_tickets,
       count(*) FILTER (WHERE churn_risk) AS customers_at_risk,
       round(count(*) FILTER (WHERE churn_risk) / count(*) * 100, 1) AS at_risk_pct
FROM risk_profile""",
    "cx_risk_tiers": "SELECT risk_tier, count(*) AS customers FROM risk_profile GROUP BY risk_tier",
    "cx_clv_at_risk": _CAR + "\nSELECT * FROM car ORDER BY segment",
    "cx_clv_share": _RISK + """
SELECT CAST(clv_at_risk AS DOUBLE) AS total_clv_at_risk, CAST(total_clv AS DOUBLE) AS portfolio_clv,
       round(CAST(clv_at_risk AS DOUBLE) / CAST(total_clv AS DOUBLE) * 100, 1) AS pct_at_risk,
       CAST(round(clv_at_risk * CAST(0.20 AS DECIMAL(3,2)), 2) AS DOUBLE) AS loss_at_20pct
FROM rk, pf""",
    "cx_critical_top20": """SELECT customer_id, segment, region, round(clv, 2) AS clv, total_tickets,
       sla_breaches, round(avg_csat, 2) AS avg_csat
FROM risk_profile WHERE churn_risk AND risk_tier = 'Critical Risk'
ORDER BY clv DESC, customer_id LIMIT 20""",
    "cx_response_by_category": """SELECT *, CASE WHEN response_rate < 0.78 THEN 'danger'
            WHEN response_rate < 0.84 THEN 'warning' ELSE 'primary' END AS rate_class
FROM (SELECT issue_category, count(ticket_id) AS total_tickets,
             round(avg(CAST(csat_responded AS INTEGER)), 3) AS response_rate,
             round(avg(csat_score), 3) AS avg_csat
      FROM tickets WHERE issue_category IS NOT NULL GROUP BY issue_category)
ORDER BY response_rate""",

    "bi_portfolio": _RISK + f"""
SELECT CAST(total_clv AS DOUBLE) AS total_clv,
       (SELECT round({tot('revenue')}, 2) FROM transactions) AS total_revenue,
       CAST(clv_at_risk AS DOUBLE) AS clv_at_risk,
       round(CAST(clv_at_risk AS DOUBLE) / CAST(total_clv AS DOUBLE) * 100, 1) AS pct_at_risk,
       customers_at_risk
FROM pf, rk""",
    "bi_sla_cost": _TC + f"""
SELECT round(avg(sla_breached) * 100, 1) AS breach_rate_pct, count(*) AS total_tickets,
       CAST(sum(sla_breached) AS BIGINT) AS breached_tickets,
       {avg_r('CASE WHEN sla_breached = 1 THEN clv END', 2)} AS avg_clv_per_breach,
       CAST(sum(CASE WHEN sla_breached = 1 THEN CAST(clv AS DECIMAL(18,2)) END) AS DOUBLE)
         AS total_clv_touched,
       CAST(sum(sla_breached) // 24 AS BIGINT) AS monthly_breaches
FROM tc""",
    "bi_churn_scenarios": _RISK + f"""
, sc AS ({_SCEN})
SELECT scenario, CAST(rate AS DOUBLE) AS churn_rate,
       CAST(round(clv_at_risk * rate, 2) AS DOUBLE) AS clv_loss,
       round(CAST(round(clv_at_risk * rate, 2) AS DOUBLE) / CAST(total_clv AS DOUBLE) * 100, 1)
         AS pct_of_portfolio,
       round(CAST(round(clv_at_risk * rate, 2) AS DOUBLE) / 12, 2) AS monthly_loss
FROM rk, pf, sc ORDER BY churn_rate""",
    "bi_quarterly_revenue": _QTR + """
SELECT year, quarter, round(rev, 2) AS revenue FROM qtr ORDER BY year, quarter""",
    "bi_q4_share": _Q4 + """
SELECT round(q4, 2) AS q4_revenue, round(annual, 2) AS annual_revenue,
       round(q4 / annual * 100, 1) AS q4_share_pct, round(q4 * CAST(0.05 AS DOUBLE), 2) AS q4_loss_5pct
FROM q4""",
    "bi_q4_tickets": """
SELECT count(*) FILTER (WHERE month(ticket_date) IN (10, 11, 12)) AS q4_tickets,
       round(count(*) FILTER (WHERE month(ticket_date) IN (10, 11, 12)) / count(*) * 100, 1)
         AS q4_ticket_share_pct,
       round(avg(sla_breached) FILTER (WHERE month(ticket_date) IN (10, 11, 12)) * 100, 1)
         AS q4_breach_rate_pct
FROM tickets""",
    "bi_avg_quarter": _QTR + f"""
SELECT quarter, {avg_r('rev', 2)} AS avg_quarter_revenue FROM qtr GROUP BY quarter ORDER BY quarter""",
    "bi_month_spine": """
SELECT CAST(s.m AS INTEGER) AS month, coalesce(c.n, 0) AS ticket_count
FROM range(1, 13) s(m)
LEFT JOIN (SELECT month(ticket_date) AS month, count(ticket_id) AS n FROM tickets GROUP BY 1) c
  ON s.m = c.month ORDER BY month""",
    "bi_segment_exposure": _EXPO + "\nSELECT * FROM expo ORDER BY segment",
    "bi_corporate_case": _CORP + """
SELECT *, corporate_loss_20pct > retail_clv_at_risk AS exceeds_retail_risk FROM corp""",
    "bi_action_impact": _CORP + _Q4 + f"""
, acts AS ({_ACTIONS})
SELECT priority, action, timeline, owner,
       CASE WHEN priority = 1 THEN 'GBP' || format('{{:,.0f}}', corporate_loss_20pct)
                                   || ' CLV protected at 20% churn prevention'
            WHEN priority = 4 THEN 'Protects GBP' || format('{{:,.0f}}', q4)
                                   || ' Q4 revenue from service-driven churn'
            {_IMPACT} END AS financial_impact,
       round(CASE WHEN priority = 1 THEN corporate_loss_20pct WHEN priority = 4 THEN q4 END, 2)
         AS impact_gbp
FROM acts, corp, q4 ORDER BY priority""",
    "bi_five_numbers": _RISK + _Q4 + """
SELECT CAST(clv_at_risk AS DOUBLE) AS clv_at_risk,
       round(CAST(clv_at_risk AS DOUBLE) / CAST(total_clv AS DOUBLE) * 100, 1) AS clv_at_risk_pct,
       (SELECT round(avg(sla_breached) * 100, 1) FROM tickets) AS breach_rate_pct,
       round(q4 / annual * 100, 1) AS q4_share_pct,
       CAST(round(clv_at_risk * CAST(0.20 AS DECIMAL(3,2)), 2) AS DOUBLE) AS loss_at_20pct
FROM rk, pf, q4""",
}
