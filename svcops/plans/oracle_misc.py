"""DuckDB oracle text for profiling, sources/sinks and dashboard datasets."""

from __future__ import annotations

from svcops.plans.oracle_text import avg_r, tot

RAW_COLUMNS = {
    "transactions_raw": ("invoice", "stock_code", "description", "quantity", "invoice_date",
                         "price", "customer_id", "country", "revenue"),
    "customers_raw": ("customer_id", "segment", "clv", "acquisition_channel", "region",
                      "acquisition_date"),
    "tickets_raw": ("ticket_id", "customer_id", "location_id", "ticket_date", "issue_category",
                    "priority", "resolution_days", "csat_score", "status"),
    "operations_raw": ("location_id", "quarter", "region", "staff_count", "sla_target_days",
                       "sla_achievement_rate", "inventory_level", "ticket_volume_handled"),
}
CLEAN_COLUMNS = {
    "transactions": ("invoice", "stock_code", "description", "quantity", "invoice_date", "price",
                     "customer_id", "country", "revenue", "is_guest"),
    "customers": ("customer_id", "segment", "clv", "acquisition_channel", "region",
                  "acquisition_date", "clv_imputed"),
    "tickets": ("ticket_id", "customer_id", "location_id", "ticket_date", "issue_category",
                "priority", "resolution_days", "sla_breached", "csat_score", "status",
                "is_abandoned", "csat_responded"),
    "operations": ("location_id", "quarter", "region", "staff_count", "sla_target_days",
                   "sla_achievement_rate", "inventory_level", "ticket_volume_handled",
                   "sla_imputed", "staff_imputed", "sla_status"),
}


def _nulls(tables: dict) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM {t}"
        for t, cols in tables.items() for c in cols)


_DESCRIBE_STATS = ("count", "mean", "std", "min", "25%", "50%", "75%", "max")


def _describe() -> str:
    parts = []
    for i, s in enumerate(_DESCRIBE_STATS):
        if s in ("25%", "50%", "75%"):
            j = ("25%", "50%", "75%").index(s) + 1
            q, p = f"qq[{j}]", f"pq[{j}]"
        else:
            q, p = f"q_{s}", f"p_{s}"
        parts.append(f"SELECT {i} AS stat_order, '{s}' AS stat, round(CAST({q} AS DOUBLE), 2) AS quantity, "
                     f"round(CAST({p} AS DOUBLE), 2) AS price FROM d")
    return f"""
, d AS (SELECT count(quantity) AS q_count, {avg_r("quantity", 2)} AS q_mean, stddev_samp(quantity) AS q_std,
               min(quantity) AS q_min, max(quantity) AS q_max,
               quantile_cont(CAST(quantity AS DOUBLE), [0.25, 0.5, 0.75]) AS qq,
               count(price) AS p_count, {avg_r("price", 2)} AS p_mean, stddev_samp(price) AS p_std,
               min(price) AS p_min, max(price) AS p_max,
               quantile_cont(price, [0.25, 0.5, 0.75]) AS pq
        FROM transactions_raw)
""" + "\nUNION ALL ".join(parts)


def _vc(source: str, table: str, column: str) -> str:
    return (f"SELECT '{source}' AS source, '{column}' AS \"column\", CAST({column} AS VARCHAR) AS value, "
            f"count(*) AS count FROM {table} WHERE {column} IS NOT NULL GROUP BY {column}")


SQL = {
    "prof_shape": """SELECT count(*) AS "rows", 9 AS "columns", min(invoice_date) AS min_date,
       max(invoice_date) AS max_date, count(DISTINCT customer_id) AS distinct_customers,
       count(DISTINCT country) AS distinct_countries,
       count(*) FILTER (WHERE coalesce(starts_with(invoice, 'C'), false)) AS cancellations
FROM transactions_raw""",
    "prof_nulls": _nulls(RAW_COLUMNS),
    "prof_nulls_after": f""", per_col AS ({_nulls(CLEAN_COLUMNS)})
SELECT * FROM per_col
UNION ALL SELECT "table", 'TOTAL', CAST(sum(nulls) AS BIGINT) FROM per_col GROUP BY "table\"""",
    "prof_top_values": """SELECT country, count(*) AS count FROM transactions_raw
WHERE country IS NOT NULL GROUP BY country ORDER BY count DESC, country LIMIT 10""",
    "prof_value_counts": "\nUNION ALL ".join([
        _vc("customers_raw", "customers_raw", "segment"),
        _vc("customers", "customers", "segment"),
        _vc("tickets_raw", "tickets_raw", "issue_category"),
        _vc("tickets", "tickets", "issue_category"),
        _vc("operations_raw", "operations_raw", "location_id"),
        _vc("operations", "operations", "location_id"),
        _vc("operations", "operations", "sla_status"),
        _vc("customer_risk_profile", "risk_profile", "risk_tier")]),
    "prof_describe": _describe(),
    "prof_sign_counts": """SELECT count(*) FILTER (WHERE quantity < 0) AS negative_quantity,
       count(*) FILTER (WHERE price = 0) AS zero_price,
       count(*) FILTER (WHERE price < 0) AS negative_price,
       count(*) FILTER (WHERE price <= 0) AS nonpositive_price,
       count(*) FILTER (WHERE coalesce(starts_with(invoice, 'C'), false)) AS cancellations
FROM transactions_raw""",
    "prof_duplicates": """SELECT 'customers_raw' AS "table",
       CAST((SELECT count(*) FROM customers_raw) - (SELECT count(*) FROM customers_d) AS BIGINT)
         AS duplicate_rows""",
    "prof_preview": "SELECT * FROM customers ORDER BY customer_id LIMIT 5",
    "prof_preview_transactions": """SELECT * FROM transactions_raw
ORDER BY invoice, stock_code, description NULLS FIRST, quantity, invoice_date, price, customer_id NULLS FIRST LIMIT 10""",
    "prof_preview_customers": """SELECT * FROM customers_raw
ORDER BY customer_id, segment, clv NULLS FIRST, acquisition_channel, region NULLS FIRST LIMIT 5""",
    "prof_preview_tickets": "SELECT * FROM tickets_raw ORDER BY ticket_id LIMIT 5",
    "prof_preview_operations": "SELECT * FROM operations_raw ORDER BY location_id, quarter LIMIT 5",
    "prof_row_counts": "\nUNION ALL ".join(
        f"SELECT '{t}' AS \"table\", count(*) AS \"rows\" FROM {t}" for t in CLEAN_COLUMNS),

    "src_sheets_union": "SELECT * FROM transactions_raw",
    "src_csv": "SELECT * FROM tickets_raw",
    "sink_csv": "SELECT * FROM customers",
    "sink_tables": "\nUNION ALL ".join(
        f"SELECT '{t}' AS \"table\", count(*) AS \"rows\" FROM {t}" for t in CLEAN_COLUMNS),
    "src_rename_snake": "SELECT * FROM transactions_raw",
    "src_revenue": """SELECT invoice, stock_code, quantity, price, quantity * price AS revenue
FROM transactions_raw""",
    "src_customer_spine": """SELECT DISTINCT CAST(TRY_CAST(customer_id AS DECIMAL(20,0)) AS BIGINT) AS customer_id
FROM transactions_raw WHERE customer_id IS NOT NULL""",

    "dash_kpis": f"""SELECT (SELECT round({tot('revenue')}, 2) FROM transactions) AS total_revenue,
       (SELECT round(avg(sla_breached) * 100, 1) FROM tickets) AS breach_rate_pct,
       (SELECT round(avg(csat_score), 2) FROM tickets) AS avg_csat,
       (SELECT CAST(sum(CAST(clv AS DECIMAL(18,2))) AS DOUBLE) FROM risk_profile WHERE churn_risk)
         AS clv_at_risk""",
    "dash_kpis_corporate": f"""
, ids AS (SELECT customer_id FROM customers WHERE segment = 'Corporate')
SELECT (SELECT round({tot('revenue')}, 2) FROM transactions WHERE customer_id IN (FROM ids)) AS total_revenue,
       (SELECT round(avg(sla_breached) * 100, 1) FROM tickets WHERE customer_id IN (FROM ids)) AS breach_rate_pct,
       (SELECT round(avg(csat_score), 2) FROM tickets WHERE customer_id IN (FROM ids)) AS avg_csat,
       (SELECT CAST(sum(CAST(clv AS DECIMAL(18,2))) AS DOUBLE) FROM risk_profile
        WHERE churn_risk AND segment = 'Corporate') AS clv_at_risk""",
    "dash_csat_by_category": """SELECT issue_category, round(avg(csat_score), 2) AS avg_csat,
       count(ticket_id) AS ticket_count
FROM tickets WHERE issue_category IS NOT NULL GROUP BY issue_category ORDER BY avg_csat""",
    "dash_segment_risk_share": """SELECT segment, clv_at_risk,
       round(clv_at_risk / sum(clv_at_risk) OVER () * 100, 1) AS share_pct
FROM (SELECT segment, CAST(sum(CAST(clv AS DECIMAL(18,2))) AS DOUBLE) AS clv_at_risk
      FROM risk_profile WHERE churn_risk AND segment IS NOT NULL GROUP BY segment)""",
    "dash_cube": f"""
, members AS (SELECT DISTINCT customer_id, segment FROM customers WHERE customer_id IS NOT NULL AND segment IS NOT NULL)
, seen AS (SELECT CAST(NULL AS VARCHAR) AS segment, true AS all_segments, customer_id, location_id, issue_category, ticket_id,
                    sla_breached, csat_score FROM tickets
             UNION ALL SELECT l.segment, false, k.customer_id, location_id, issue_category, ticket_id, sla_breached, csat_score
             FROM tickets k JOIN members l ON k.customer_id = l.customer_id)
, figures AS (SELECT segment, location_id, issue_category, all_segments, GROUPING(location_id) = 1 AS all_locations,
                 GROUPING(issue_category) = 1 AS all_categories, count(ticket_id) AS ticket_count,
                 round(avg(sla_breached) * 100, 1) AS breach_rate_pct, round(avg(csat_score), 2) AS avg_csat
          FROM seen GROUP BY GROUPING SETS ((segment, all_segments, location_id, issue_category),
               (segment, all_segments, location_id), (segment, all_segments, issue_category), (segment, all_segments)))
, earned AS (SELECT CAST(NULL AS VARCHAR) AS segment, true AS all_segments, round({tot('revenue')}, 2) AS total_revenue FROM transactions
          UNION ALL SELECT l.segment, false, round({tot('revenue')}, 2)
          FROM transactions t JOIN members l ON t.customer_id = l.customer_id GROUP BY l.segment)
, threatened AS (SELECT customer_id, segment, CAST(clv AS DECIMAL(18,2)) AS clv FROM risk_profile WHERE churn_risk)
, located AS (SELECT r.segment, p.location_id, false AS all_locations, clv FROM threatened r
             JOIN (SELECT DISTINCT customer_id, location_id FROM tickets) p ON r.customer_id = p.customer_id
             UNION ALL SELECT segment, NULL, true, clv FROM threatened)
, exposed AS (SELECT segment, location_id, GROUPING(segment) = 1 AS all_segments, all_locations, CAST(sum(clv) AS DOUBLE) AS clv_at_risk
             FROM located GROUP BY GROUPING SETS ((segment, location_id, all_locations), (location_id, all_locations)))
, cells AS (SELECT segment, location_id, issue_category, all_segments, all_locations, all_categories, ticket_count,
                   breach_rate_pct, avg_csat, CAST(NULL AS DOUBLE) AS total_revenue, CAST(NULL AS DOUBLE) AS clv_at_risk FROM figures
            UNION ALL SELECT segment, NULL, NULL, all_segments, true, true, NULL, NULL, NULL, total_revenue, NULL FROM earned
            UNION ALL SELECT segment, location_id, NULL, all_segments, all_locations, true, NULL, NULL, NULL, NULL, clv_at_risk
            FROM exposed WHERE all_segments OR segment IS NOT NULL)
SELECT segment, location_id, issue_category, all_segments, all_locations, all_categories, max(ticket_count) AS ticket_count,
       max(breach_rate_pct) AS breach_rate_pct, max(avg_csat) AS avg_csat, max(total_revenue) AS total_revenue,
       max(clv_at_risk) AS clv_at_risk
FROM cells GROUP BY ALL""",
    "weekly_breach": """SELECT CAST(date_trunc('week', ticket_date) AS DATE) AS week_start, location_id,
       count(ticket_id) AS tickets, CAST(sum(sla_breached) AS BIGINT) AS breaches,
       round(sum(sla_breached) / count(ticket_id), 3) AS breach_rate
FROM tickets GROUP BY 1, 2""",
}
