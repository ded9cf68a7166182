"""Column expressions shared by the jobs (all built-in, codegen-friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from svcops.functions import constants as K


def norm_customer_id(col: Column | str) -> Column:
    """Integer text of a customer id: ``'13085.0'`` and ``'13085'`` both become
    ``'13085'``; a non-numeric id (``'GUEST'``) is kept as it is.

    Only whole numbers are changed (``'13085.5'`` is no other customer's id).
    All cleaners normalise, so joins on ids are plain string equi-joins."""
    c = (F.col(col) if isinstance(col, str) else col).cast("string")
    n = c.try_cast("decimal(38,10)")
    return F.when(n == F.floor(n), F.floor(n).cast("string")).otherwise(c)


def label_map(col: Column | str, mapping: dict[str, str]) -> Column:
    """Dictionary lookup; a missing key gives NULL (like ``Series.map``)."""
    c = F.col(col) if isinstance(col, str) else col
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.create_map(*pairs)[c]


def pct(col: Column, digits: int = 1) -> Column:
    """``ROUND(x * 100, digits)``."""
    return F.round(col * 100, digits)


def ratio(num: Column, den: Column) -> Column:
    """Division that gives NULL on a zero denominator (ANSI-safe)."""
    return F.try_divide(num, den)


def res_band(days: Column | str) -> Column:
    d = F.col(days) if isinstance(days, str) else days
    return (F.when(d.isNull(), "Abandoned")
            .when(d <= 1, "0-1 days")
            .when(d <= 2, "1-2 days")
            .when(d <= 5, "2-5 days")
            .otherwise("5+ days"))


def sla_status(rate: Column | str) -> Column:
    r = F.col(rate) if isinstance(rate, str) else rate
    return (F.when(r < K.SLA_STATUS_CRITICAL_BELOW, "Critical")
            .when(r < K.SLA_STATUS_AT_RISK_BELOW, "At Risk")
            .otherwise("Compliant"))


def sla_breached(days: Column | str) -> Column:
    """1 when abandoned (no resolution) or slower than the SLA target."""
    d = F.col(days) if isinstance(days, str) else days
    return (F.when(d.isNull(), 1).when(d > K.SLA_TARGET_DAYS, 1)
            .otherwise(0).cast("int"))


def churn_risk(breaches: Column | str, avg_csat: Column | str) -> Column:
    b = F.col(breaches) if isinstance(breaches, str) else breaches
    a = F.col(avg_csat) if isinstance(avg_csat, str) else avg_csat
    return F.coalesce((b >= K.CHURN_MIN_BREACHES) & (a < K.CHURN_MAX_AVG_CSAT),
                      F.lit(False))


def risk_tier(churn: Column | str, clv: Column | str) -> Column:
    c = F.col(churn) if isinstance(churn, str) else churn
    v = F.col(clv) if isinstance(clv, str) else clv
    return (F.when(~c, "Low Risk")
            .when(v >= K.CRITICAL_TIER_MIN_CLV, "Critical Risk")
            .otherwise("High Risk"))


def priority_rank(priority: Column | str) -> Column:
    p = F.col(priority) if isinstance(priority, str) else priority
    expr = F.when(p == K.PRIORITY_ORDER[0], 1)
    for i, name in enumerate(K.PRIORITY_ORDER[1:], start=2):
        expr = expr.when(p == name, i)
    return expr.otherwise(len(K.PRIORITY_ORDER) + 1)


def order_band(n_orders: Column | str) -> Column:
    n = F.col(n_orders) if isinstance(n_orders, str) else n_orders
    return (F.when(n == 1, K.ORDER_BANDS[0])
            .when(n <= 3, K.ORDER_BANDS[1])
            .when(n <= 10, K.ORDER_BANDS[2])
            .otherwise(K.ORDER_BANDS[3]))


def month_text(ts: Column | str) -> Column:
    t = F.col(ts) if isinstance(ts, str) else ts
    return F.date_format(t, "yyyy-MM")


def money(col: Column | str) -> Column:
    """Exact money arithmetic: sums of DECIMAL(18,2) hash equal across engines."""
    c = F.col(col) if isinstance(col, str) else col
    return c.cast("decimal(18,2)")


def in_years(ts: Column | str, years) -> Column:
    """``year(ts) IN years`` written as half-open date ranges, so Parquet
    row-group statistics can skip data (a function of the column cannot be
    pushed down)."""
    t = F.col(ts) if isinstance(ts, str) else ts
    cond = None
    for y in sorted(set(int(v) for v in years)):
        r = (t >= F.lit(f"{y}-01-01").cast("timestamp_ntz")) & (
            t < F.lit(f"{y + 1}-01-01").cast("timestamp_ntz"))
        cond = r if cond is None else (cond | r)
    return cond if cond is not None else F.lit(False)


#: Decimals kept of a value in exact arithmetic; a DOUBLE's shortest decimal
#: form is used, and what lies beyond the tenth decimal is rounded off.
EXACT_SCALE = 10


def exact(col: Column | str) -> Column:
    """A number as an exact DECIMAL with its own decimals (up to ten)."""
    c = F.col(col) if isinstance(col, str) else col
    return c.cast(f"decimal(28,{EXACT_SCALE})")


def total(col: Column | str) -> Column:
    """Exact sum as DOUBLE: the same whatever the order of summation."""
    return F.sum(exact(col)).cast("double")


def round_ratio(total: Column, count: Column, digits: int) -> Column:
    """``total / count`` rounded half-up to ``digits`` once, from an exact
    DECIMAL total: an exact tie such as 0.705 always rounds the same way."""
    return F.round(F.try_divide(total.cast(f"decimal(27,{EXACT_SCALE})"), count), digits).cast("double")


def avg_round(col: Column | str, digits: int) -> Column:
    """Exact mean, rounded half-up to ``digits`` (nulls skipped, like ``avg``)."""
    d = exact(col)
    return round_ratio(F.sum(d), F.count(d), digits)
