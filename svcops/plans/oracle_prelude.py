"""DuckDB text of the raw and clean tables, written independently of the
Spark jobs, used as the correctness oracle.

``PRELUDE`` is a ``WITH`` list over the driver views (region, nation,
customer, part, orders, lineitem); an oracle query is ``PRELUDE`` followed by
optional extra CTEs (starting with a comma) and a final SELECT.
"""

from __future__ import annotations

from svcops.functions import constants as K

_Y1, _Y2 = K.YEARS[0], K.YEARS[-1]

_CATEGORY_LIST = ", ".join(f"'{s}'" for s in K.CATEGORY_MAP)
_CATEGORY_CASE = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in K.CATEGORY_MAP.items())
_SEGMENT_CASE = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in K.SEGMENT_MAP.items())


def _id(x: str) -> str:
    """Integer text of an id that is a whole number; other ids as they are."""
    n = f"TRY_CAST({x} AS DECIMAL(38,10))"
    return f"CASE WHEN {n} = floor({n}) THEN CAST(CAST({n} AS DECIMAL(38,0)) AS VARCHAR) ELSE {x} END"


RAW = f"""
transactions_raw0 AS (
  SELECT
    CASE WHEN o.o_orderstatus = 'P' AND o.o_orderkey % 25 = 0
         THEN 'C' || CAST(o.o_orderkey AS VARCHAR) ELSE CAST(o.o_orderkey AS VARCHAR) END AS invoice,
    CAST(l.l_partkey AS VARCHAR) AS stock_code,
    CASE WHEN l.l_partkey % 200 = 7 THEN NULL ELSE p.p_name END AS description,
    CASE WHEN (l.l_orderkey + l.l_linenumber) % 97 = 0 THEN -CAST(l.l_quantity AS INTEGER)
         ELSE CAST(l.l_quantity AS INTEGER) END AS quantity,
    o.o_orderdate AS invoice_date,
    CASE WHEN (l.l_orderkey + l.l_linenumber) % 101 = 0 THEN 0.0 ELSE p.p_retailprice END AS price,
    CASE WHEN o.o_custkey % 5 = 0 THEN NULL ELSE CAST(o.o_custkey AS VARCHAR) || '.0' END AS customer_id,
    CASE WHEN c.c_nationkey <= 12 THEN 'United Kingdom' WHEN c.c_nationkey = 13 THEN 'Germany'
         WHEN c.c_nationkey = 14 THEN 'France' WHEN c.c_nationkey = 15 THEN 'Netherlands'
         WHEN c.c_nationkey = 16 THEN 'EIRE' ELSE n.n_name END AS country
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
),
transactions_raw AS (
  SELECT *, quantity * price AS revenue FROM transactions_raw0
),
customers_base AS (
  SELECT
    CAST(c.c_custkey AS VARCHAR) AS customer_id,
    CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 'Retail'
         WHEN 'BUILDING' THEN CASE WHEN c.c_custkey % 2 = 0 THEN 'retail' ELSE 'RETAIL' END
         WHEN 'FURNITURE' THEN 'corporate' WHEN 'MACHINERY' THEN 'Corporate'
         ELSE 'Wholesale' END AS segment,
    CASE WHEN c.c_acctbal < 0 THEN NULL ELSE c.c_acctbal END AS clv,
    CASE c.c_custkey % 5 WHEN 0 THEN 'Online' WHEN 1 THEN 'Referral' WHEN 2 THEN 'Direct Sales'
         WHEN 3 THEN 'Trade Show' ELSE 'Partner' END AS acquisition_channel,
    CASE WHEN c.c_custkey % 20 = 3 THEN NULL ELSE r.r_name END AS region,
    DATE '1994-01-01' + CAST(c.c_custkey % 365 AS INTEGER) AS acquisition_date,
    c.c_custkey AS k
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
),
customers_raw AS (
  SELECT customer_id, segment, clv, acquisition_channel, region, acquisition_date FROM customers_base
  UNION ALL
  SELECT customer_id, segment, clv, acquisition_channel, region, acquisition_date
  FROM customers_base WHERE k % 50 = 0
),
tickets_days AS (
  SELECT o.*,
    CASE WHEN o.o_orderkey % 17 = 0 THEN NULL
         ELSE CAST(floor(o.o_totalprice / 42000 * 10) / 10 AS DOUBLE) END AS days
  FROM orders o
),
tickets_raw AS (
  SELECT
    CAST(o_orderkey AS VARCHAR) AS ticket_id,
    CAST(o_custkey AS VARCHAR) AS customer_id,
    'LOC_0' || CAST(o_orderkey % 8 + 1 AS VARCHAR) AS location_id,
    CAST(o_orderdate AS DATE) AS ticket_date,
    [{_CATEGORY_LIST}][o_orderkey % 13 + 1] AS issue_category,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Critical' WHEN '2-HIGH' THEN 'High'
         WHEN '3-MEDIUM' THEN 'Medium' ELSE 'Low' END AS priority,
    days AS resolution_days,
    CAST(CASE WHEN days IS NULL OR o_orderkey % 6 = 0 THEN NULL
              WHEN days <= 1 THEN 4 + o_orderkey % 2
              WHEN days <= 2 THEN 3 + o_orderkey % 3
              WHEN days <= 5 THEN 2 + o_orderkey % 3
              ELSE 1 + o_orderkey % 3 END AS DOUBLE) AS csat_score,
    CASE o_orderstatus WHEN 'F' THEN 'Resolved' WHEN 'O' THEN 'Open'
         WHEN 'P' THEN 'Escalated' END AS status
  FROM tickets_days
),
ops_agg AS (
  SELECT CAST(l_suppkey % 8 + 1 AS INTEGER) AS loc,
         CAST(year(l_shipdate) AS VARCHAR) || '-Q' || CAST(quarter(l_shipdate) AS VARCHAR) AS quarter,
         count(DISTINCT l_suppkey) AS n_supp,
         avg(CAST(l_quantity <= 18 + 4 * CAST(l_suppkey % 8 + 1 AS INTEGER) AS INTEGER)) AS rate,
         avg(l_quantity) AS avg_qty,
         count(*) AS n
  FROM lineitem
  GROUP BY 1, 2
),
operations_raw AS (
  SELECT
    CASE WHEN loc = 3 AND quarter = '{_Y1}-Q2' THEN 'Location_03' ELSE 'LOC_0' || CAST(loc AS VARCHAR) END AS location_id,
    quarter,
    CASE WHEN loc IN (1, 2) THEN 'UK' WHEN loc IN (3, 7) THEN 'Germany' WHEN loc IN (4, 8) THEN 'France'
         WHEN loc = 5 THEN 'Netherlands' ELSE 'EIRE' END AS region,
    CASE WHEN loc = 8 THEN NULL ELSE CAST(n_supp AS DOUBLE) END AS staff_count,
    2.0::DOUBLE AS sla_target_days,
    CASE WHEN (loc = 7 AND quarter = '{_Y1}-Q1') OR (loc = 5 AND quarter = '{_Y2}-Q3') THEN NULL
         ELSE round(rate, 2) END AS sla_achievement_rate,
    round(avg_qty / 50, 2) AS inventory_level,
    CAST(n AS INTEGER) AS ticket_volume_handled
  FROM ops_agg
)"""

CLEAN = f"""
transactions AS (
  SELECT invoice, stock_code, coalesce(description, 'Unknown') AS description, quantity,
         CAST(invoice_date AS TIMESTAMP) AS invoice_date, price,
         {_id("coalesce(customer_id, 'GUEST')")} AS customer_id,
         country, quantity * price AS revenue,
         coalesce(customer_id, 'GUEST') = 'GUEST' AS is_guest
  FROM transactions_raw
  WHERE NOT coalesce(starts_with(invoice, 'C'), false) AND quantity > 0 AND price > 0
),
customers_d AS (
  SELECT DISTINCT * FROM customers_raw
),
customers_m AS (
  SELECT customer_id, CASE segment {_SEGMENT_CASE} END AS segment, clv, acquisition_channel,
         region, acquisition_date
  FROM customers_d
),
customers AS (
  SELECT {_id("customer_id")} AS customer_id, segment,
         round(coalesce(clv, CASE WHEN segment IS NOT NULL
                                  THEN median(clv) OVER (PARTITION BY segment) END), 2) AS clv,
         acquisition_channel, coalesce(region, 'Unknown') AS region,
         CAST(acquisition_date AS DATE) AS acquisition_date,
         clv IS NULL AS clv_imputed
  FROM customers_m
),
tickets AS (
  SELECT ticket_id, {_id("customer_id")} AS customer_id, location_id, ticket_date,
         CASE issue_category {_CATEGORY_CASE} END AS issue_category,
         priority, resolution_days,
         CAST(CASE WHEN resolution_days IS NULL THEN 1 WHEN resolution_days > 2 THEN 1 ELSE 0 END
              AS INTEGER) AS sla_breached,
         csat_score, status,
         resolution_days IS NULL AS is_abandoned,
         csat_score IS NOT NULL AS csat_responded
  FROM tickets_raw
),
operations_l AS (
  SELECT CASE WHEN location_id = 'Location_03' THEN 'LOC_03' ELSE location_id END AS location_id,
         quarter, region, staff_count, sla_target_days, sla_achievement_rate, inventory_level,
         ticket_volume_handled
  FROM operations_raw
),
operations_i AS (
  SELECT location_id, quarter, region,
         coalesce(staff_count, median(staff_count) OVER ()) AS staff_count,
         sla_target_days,
         round(coalesce(sla_achievement_rate,
                        avg(sla_achievement_rate) OVER (PARTITION BY location_id)), 2)
           AS sla_achievement_rate,
         inventory_level, ticket_volume_handled,
         sla_achievement_rate IS NULL AS sla_imputed,
         staff_count IS NULL AS staff_imputed
  FROM operations_l
),
operations AS (
  SELECT *, CASE WHEN sla_achievement_rate < 0.50 THEN 'Critical'
                 WHEN sla_achievement_rate < 0.70 THEN 'At Risk' ELSE 'Compliant' END AS sla_status
  FROM operations_i
),
risk AS (
  SELECT k.customer_id,
         count(*) AS total_tickets,
         CAST(sum(k.sla_breached) AS BIGINT) AS sla_breaches,
         avg(k.csat_score) AS avg_csat,
         max(c.segment) AS segment, max(c.clv) AS clv, max(c.region) AS region
  FROM tickets k LEFT JOIN customers c ON k.customer_id = c.customer_id
  WHERE k.customer_id IS NOT NULL
  GROUP BY k.customer_id
),
risk_profile AS (
  SELECT *, coalesce(sla_breaches >= 2 AND avg_csat < 2.5, false) AS churn_risk,
         CASE WHEN NOT coalesce(sla_breaches >= 2 AND avg_csat < 2.5, false) THEN 'Low Risk'
              WHEN clv >= 2000 THEN 'Critical Risk' ELSE 'High Risk' END AS risk_tier
  FROM risk
)"""

PRELUDE = "WITH " + RAW.strip() + ",\n" + CLEAN.strip()


def oracle(body: str) -> str:
    """Full oracle text: the prelude, then ``body`` (a SELECT, or extra CTEs
    beginning with a comma followed by a SELECT)."""
    from svcops.plans.oracle_text import spark_rounding
    body = body.strip()
    text = PRELUDE + body if body.startswith(",") else PRELUDE + "\n" + body
    return spark_rounding(text)
