"""DuckDB oracle text for the cleaning steps, clean tables and quality report."""

from __future__ import annotations

from svcops.functions import constants as K
from svcops.plans.oracle_prelude import _CATEGORY_CASE

_SEG = ", ".join(f"'{s}'" for s in K.SEGMENT_INCONSISTENT)
_CAT = ", ".join(f"'{s}'" for s in K.CATEGORY_INCONSISTENT)
_A = K.DQ_ACTIONS

_T1 = "SELECT * FROM transactions_raw WHERE NOT coalesce(starts_with(invoice, 'C'), false)"
_T2 = _T1 + " AND quantity > 0"
_T3 = _T2 + " AND price > 0"
_T4 = f"""SELECT invoice, stock_code, description, quantity, invoice_date, price,
       coalesce(customer_id, 'GUEST') AS customer_id, country, revenue,
       coalesce(customer_id, 'GUEST') = 'GUEST' AS is_guest FROM ({_T3})"""
_T5 = f"""SELECT * REPLACE (coalesce(description, 'Unknown') AS description) FROM ({_T4})"""
_T6 = f"""SELECT * REPLACE (quantity * price AS revenue) FROM ({_T5})"""

_K1 = f"""SELECT ticket_id, customer_id, location_id, ticket_date,
       CASE issue_category {_CATEGORY_CASE} END AS issue_category,
       priority, resolution_days, csat_score, status FROM tickets_raw"""
_K2 = f"SELECT *, resolution_days IS NULL AS is_abandoned FROM ({_K1})"
_K3 = f"""SELECT *, CAST(CASE WHEN resolution_days IS NULL THEN 1 WHEN resolution_days > 2 THEN 1
                      ELSE 0 END AS INTEGER) AS sla_breached FROM ({_K2})"""
_K4 = f"SELECT *, csat_score IS NOT NULL AS csat_responded FROM ({_K3})"

_C3 = """SELECT customer_id, segment,
       coalesce(clv, CASE WHEN segment IS NOT NULL THEN median(clv) OVER (PARTITION BY segment) END) AS clv,
       acquisition_channel, region, acquisition_date, clv IS NULL AS clv_imputed
FROM customers_m"""
_C4 = f"SELECT * REPLACE (coalesce(region, 'Unknown') AS region) FROM ({_C3})"

_O2 = """SELECT location_id, quarter, region, staff_count, sla_target_days,
       round(coalesce(sla_achievement_rate,
                      avg(sla_achievement_rate) OVER (PARTITION BY location_id)), 2) AS sla_achievement_rate,
       inventory_level, ticket_volume_handled, sla_achievement_rate IS NULL AS sla_imputed
FROM operations_l"""
_O3 = f"""SELECT * REPLACE (coalesce(staff_count, median(staff_count) OVER ()) AS staff_count),
       staff_count IS NULL AS staff_imputed FROM ({_O2})"""

_DQ = f"""
, tx AS (
  SELECT count(*) FILTER (WHERE is_c) AS cancel,
         count(*) FILTER (WHERE NOT is_c AND quantity <= 0) AS qty,
         count(*) FILTER (WHERE NOT is_c AND q_ok AND price <= 0) AS price,
         count(*) FILTER (WHERE kept AND customer_id IS NULL) AS guest,
         count(*) FILTER (WHERE kept AND description IS NULL) AS "desc",
         count(*) AS n, count(*) FILTER (WHERE kept) AS kept
  FROM (SELECT *, is_c2 AS is_c, NOT is_c2 AND q_ok AND coalesce(price > 0, false) AS kept
        FROM (SELECT *, coalesce(starts_with(invoice, 'C'), false) AS is_c2,
                     coalesce(quantity > 0, false) AS q_ok FROM transactions_raw))
),
cu AS (
  SELECT (SELECT count(*) FROM customers_raw) AS n, count(*) AS kept,
         count(*) FILTER (WHERE segment IN ({_SEG})) AS segment,
         count(*) FILTER (WHERE clv IS NULL) AS clv,
         count(*) FILTER (WHERE region IS NULL) AS region
  FROM customers_d
),
ti AS (
  SELECT count(*) FILTER (WHERE issue_category IN ({_CAT})) AS category,
         count(*) FILTER (WHERE resolution_days IS NULL) AS abandoned,
         count(*) FILTER (WHERE csat_score IS NULL) AS csat, count(*) AS n
  FROM tickets_raw
),
op AS (
  SELECT count(*) FILTER (WHERE location_id = 'Location_03') AS location,
         count(*) FILTER (WHERE sla_achievement_rate IS NULL) AS sla,
         count(*) FILTER (WHERE staff_count IS NULL) AS staff,
         median(staff_count) AS staff_median, count(*) AS n
  FROM operations_raw
),
rep AS (
  SELECT 1 AS step, 'transactions' AS "table", 'cancellation invoices removed' AS metric, cancel AS before, 0 AS after, '{_A["cancel"]}' AS action_taken FROM tx
  UNION ALL SELECT 2, 'transactions', 'zero/negative quantity rows', qty, 0, '{_A["qty"]}' FROM tx
  UNION ALL SELECT 3, 'transactions', 'zero/negative price rows', price, 0, '{_A["price"]}' FROM tx
  UNION ALL SELECT 4, 'transactions', 'missing customer_id', guest, 0, '{_A["guest"]}' FROM tx
  UNION ALL SELECT 5, 'transactions', 'missing description', "desc", 0, '{_A["desc"]}' FROM tx
  UNION ALL SELECT 6, 'transactions', 'total rows', n, kept, 'Removed ' || format('{{:,}}', n - kept) || ' invalid rows' FROM tx
  UNION ALL SELECT 7, 'customers', 'duplicate rows', n - kept, 0, '{_A["dupes"]}' FROM cu
  UNION ALL SELECT 8, 'customers', 'inconsistent segment labels', segment, 0, '{_A["segment"]}' FROM cu
  UNION ALL SELECT 9, 'customers', 'missing CLV values', clv, 0, '{_A["clv"]}' FROM cu
  UNION ALL SELECT 10, 'customers', 'missing region', region, 0, '{_A["region"]}' FROM cu
  UNION ALL SELECT 11, 'customers', 'total rows', n, kept, 'Removed ' || CAST(n - kept AS VARCHAR) || ' duplicate rows' FROM cu
  UNION ALL SELECT 12, 'tickets', 'inconsistent category names', category, 0, '{_A["category"]}' FROM ti
  UNION ALL SELECT 13, 'tickets', 'missing resolution time (abandoned)', abandoned, 0, '{_A["abandoned"]}' FROM ti
  UNION ALL SELECT 14, 'tickets', 'missing CSAT (non-respondents)', csat, csat, '{_A["csat"]}' FROM ti
  UNION ALL SELECT 15, 'tickets', 'total rows', n, n, '{_A["tickets_total"]}' FROM ti
  UNION ALL SELECT 16, 'operations', 'inconsistent location name', location, 0, '{_A["location"].replace("'", "''")}' FROM op
  UNION ALL SELECT 17, 'operations', 'missing SLA achievement rate', sla, 0, '{_A["sla"]}' FROM op
  UNION ALL SELECT 18, 'operations', 'missing staff count', staff, 0, 'Imputed with median (' || CAST(staff_median AS VARCHAR) || ') — LOC_08 onboarding gap' FROM op
  UNION ALL SELECT 19, 'operations', 'total rows', n, n, '{_A["ops_total"]}' FROM op
)"""

SQL = {
    "cl_t_cancel": _T1,
    "cl_t_qty": _T2,
    "cl_t_price": _T3,
    "cl_t_guest": _T4,
    "cl_t_desc": _T5,
    "cl_t_revenue": _T6,
    "cl_t_types": "SELECT * FROM transactions",
    "clean_transactions": "SELECT * FROM transactions",
    "cl_c_dedupe": "SELECT * FROM customers_d",
    "cl_c_segment": "SELECT * FROM customers_m",
    "cl_c_clv": _C3,
    "cl_c_region": _C4,
    "cl_c_types": "SELECT * FROM customers",
    "clean_customers": "SELECT * FROM customers",
    "cl_c_medians": """SELECT segment, round(median(clv), 2) AS median_clv FROM customers_m
WHERE segment IS NOT NULL GROUP BY segment ORDER BY segment""",
    "cl_k_category": f"""SELECT *,
       (SELECT count(*) FILTER (WHERE issue_category IN ({_CAT})) FROM tickets_raw) AS listed_labels,
       (SELECT count(*) FILTER (WHERE issue_category IS DISTINCT FROM CASE issue_category {_CATEGORY_CASE} END)
        FROM tickets_raw) AS changed_labels
FROM ({_K1})""",
    "cl_k_abandoned": _K2,
    "cl_k_breach": _K3,
    "cl_k_responded": _K4,
    "cl_k_types": "SELECT * FROM tickets",
    "clean_tickets": "SELECT * FROM tickets",
    "cl_k_rates": """SELECT CAST(sum(sla_breached) AS BIGINT) AS breached_tickets,
       round(avg(sla_breached) * 100, 1) AS breach_rate_pct,
       round(avg(CAST(csat_responded AS INTEGER)) * 100, 1) AS response_rate_pct FROM tickets""",
    "cl_o_location": "SELECT * FROM operations_l",
    "cl_o_sla": _O2,
    "cl_o_staff": _O3,
    "cl_o_status": "SELECT * FROM operations",
    "clean_operations": "SELECT * FROM operations",
    "dq_report": _DQ + """
SELECT step, "table", metric, CAST(before AS BIGINT) AS before, CAST(after AS BIGINT) AS after,
       CAST(before - after AS BIGINT) AS change, action_taken FROM rep ORDER BY step""",
    "dq_rows_removed": _DQ + """
SELECT "table", CAST(before AS BIGINT) AS rows_before, CAST(after AS BIGINT) AS rows_after,
       CAST(before - after AS BIGINT) AS rows_removed FROM rep WHERE metric = 'total rows'""",
}
