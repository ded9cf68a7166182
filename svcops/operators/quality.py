"""Data-quality report: before/after counts of every cleaning decision.

Each table is scanned once: exclusive flags reproduce the sequential counts
of the step-by-step cleaning (a cancelled row is not counted again as a bad
quantity), so one conditional aggregate per table yields all its report rows.
No per-step action, no driver loop; the four one-row aggregates are turned
into report rows with ``inline`` and unioned.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from svcops.functions import constants as K
from svcops.functions.frames import presented
from svcops.operators import clean as CL


def _row(step: int, table: str, metric: str, before: Column, after: Column,
         action: Column | str) -> Column:
    action_col = action if isinstance(action, Column) else F.lit(action)
    return F.struct(F.lit(step).alias("step"), F.lit(table).alias("table"),
                    F.lit(metric).alias("metric"),
                    before.cast("bigint").alias("before"),
                    after.cast("bigint").alias("after"),
                    action_col.alias("action_taken"))


def _count_if(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def _line_flags() -> tuple[Column, Column, Column]:
    """Cancelled, positive quantity, positive price."""
    return (F.coalesce(F.col("invoice").startswith("C"), F.lit(False)),
            F.coalesce(F.col("quantity") > 0, F.lit(False)),
            F.coalesce(F.col("price") > 0, F.lit(False)))


def _transactions(raw: DataFrame) -> DataFrame:
    cancel, qty_ok, price_ok = _line_flags()
    kept = ~cancel & qty_ok & price_ok
    a = raw.agg(
        _count_if(cancel).alias("cancel"),
        _count_if(~cancel & (F.col("quantity") <= 0)).alias("qty"),
        _count_if(~cancel & qty_ok & (F.col("price") <= 0)).alias("price"),
        _count_if(kept & F.col("customer_id").isNull()).alias("guest"),
        _count_if(kept & F.col("description").isNull()).alias("desc"),
        F.count(F.lit(1)).alias("n"),
        _count_if(kept).alias("kept"))
    zero = F.lit(0)
    removed = F.col("n") - F.col("kept")
    rows = [
        _row(1, "transactions", "cancellation invoices removed", F.col("cancel"), zero,
             K.DQ_ACTIONS["cancel"]),
        _row(2, "transactions", "zero/negative quantity rows", F.col("qty"), zero,
             K.DQ_ACTIONS["qty"]),
        _row(3, "transactions", "zero/negative price rows", F.col("price"), zero,
             K.DQ_ACTIONS["price"]),
        _row(4, "transactions", "missing customer_id", F.col("guest"), zero, K.DQ_ACTIONS["guest"]),
        _row(5, "transactions", "missing description", F.col("desc"), zero, K.DQ_ACTIONS["desc"]),
        _row(6, "transactions", "total rows", F.col("n"), F.col("kept"),
             F.concat(F.lit("Removed "), F.format_number(removed, 0), F.lit(" invalid rows"))),
    ]
    return a.select(F.inline(F.array(*rows)))


def _customers(raw: DataFrame) -> DataFrame:
    distinct = raw.groupBy(*raw.columns).agg(F.count(F.lit(1)).alias("_copies"))
    a = distinct.agg(
        F.sum("_copies").alias("n"),
        F.count(F.lit(1)).alias("kept"),
        _count_if(F.col("segment").isin(*K.SEGMENT_INCONSISTENT)).alias("segment"),
        _count_if(F.col("clv").isNull()).alias("clv"),
        _count_if(F.col("region").isNull()).alias("region"))
    zero = F.lit(0)
    removed = F.col("n") - F.col("kept")
    rows = [
        _row(7, "customers", "duplicate rows", removed, zero, K.DQ_ACTIONS["dupes"]),
        _row(8, "customers", "inconsistent segment labels", F.col("segment"), zero,
             K.DQ_ACTIONS["segment"]),
        _row(9, "customers", "missing CLV values", F.col("clv"), zero, K.DQ_ACTIONS["clv"]),
        _row(10, "customers", "missing region", F.col("region"), zero, K.DQ_ACTIONS["region"]),
        _row(11, "customers", "total rows", F.col("n"), F.col("kept"),
             F.concat(F.lit("Removed "), removed.cast("string"), F.lit(" duplicate rows"))),
    ]
    return a.select(F.inline(F.array(*rows)))


def _tickets(raw: DataFrame) -> DataFrame:
    a = raw.agg(
        _count_if(F.col("issue_category").isin(*K.CATEGORY_INCONSISTENT)).alias("category"),
        _count_if(F.col("resolution_days").isNull()).alias("abandoned"),
        _count_if(F.col("csat_score").isNull()).alias("csat"),
        F.count(F.lit(1)).alias("n"))
    zero = F.lit(0)
    rows = [
        _row(12, "tickets", "inconsistent category names", F.col("category"), zero,
             K.DQ_ACTIONS["category"]),
        _row(13, "tickets", "missing resolution time (abandoned)", F.col("abandoned"), zero,
             K.DQ_ACTIONS["abandoned"]),
        _row(14, "tickets", "missing CSAT (non-respondents)", F.col("csat"), F.col("csat"),
             K.DQ_ACTIONS["csat"]),
        _row(15, "tickets", "total rows", F.col("n"), F.col("n"), K.DQ_ACTIONS["tickets_total"]),
    ]
    return a.select(F.inline(F.array(*rows)))


def _operations(raw: DataFrame) -> DataFrame:
    a = raw.agg(
        _count_if(F.col("location_id") == K.OLD_LOCATION_NAME).alias("location"),
        _count_if(F.col("sla_achievement_rate").isNull()).alias("sla"),
        _count_if(F.col("staff_count").isNull()).alias("staff"),
        F.median("staff_count").alias("staff_median"),
        F.count(F.lit(1)).alias("n"))
    zero = F.lit(0)
    rows = [
        _row(16, "operations", "inconsistent location name", F.col("location"), zero,
             K.DQ_ACTIONS["location"]),
        _row(17, "operations", "missing SLA achievement rate", F.col("sla"), zero,
             K.DQ_ACTIONS["sla"]),
        _row(18, "operations", "missing staff count", F.col("staff"), zero,
             F.concat(F.lit("Imputed with median ("), F.col("staff_median").cast("string"),
                      F.lit(") — LOC_08 onboarding gap"))),
        _row(19, "operations", "total rows", F.col("n"), F.col("n"), K.DQ_ACTIONS["ops_total"]),
    ]
    return a.select(F.inline(F.array(*rows)))


def _rejected(T) -> list[DataFrame]:
    """A row for each of one's own files that had lines which can't be read."""
    if not T.files:
        return []
    from svcops.sources.io import rejected_lines
    counts = rejected_lines(T).groupBy("table").agg(F.count(F.lit(1)).alias("n"))
    step = F.lit(20) + F.array_position(F.array(*[F.lit(t) for t in CL.CLEANERS]), F.col("table")).cast("int") - 1
    return [counts.select(step.alias("step"), "table", F.lit("unreadable lines").alias("metric"), F.col("n").alias("before"),
                          F.lit(0).cast("bigint").alias("after"), F.lit("Set apart in rejected_lines").alias("action_taken"))]


def dq_report(T) -> DataFrame:
    """19 rows: step, table, metric, before, after, change, action_taken.
    ``change`` is numeric for every row (the original leaves most as text).
    One's own files with unreadable lines have a row each after them."""
    parts = [_transactions(T.raw("transactions")), _customers(T.raw("customers")),
             _tickets(T.raw("tickets")), _operations(T.raw("operations")), *_rejected(T)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return (out.withColumn("change", F.col("before") - F.col("after"))
               .select("step", "table", "metric", "before", "after", "change", "action_taken")
               .transform(presented, "step"))


def dq_rows_removed(T) -> DataFrame:
    """Rows before and after cleaning, from the two counts of each table alone."""
    cancel, qty_ok, price_ok = _line_flags()
    n = F.count(F.lit(1))
    customers = T.raw("customers")
    copies = customers.groupBy(*customers.columns).agg(n.alias("_copies"))
    counts = {
        "transactions": T.raw("transactions").agg(n.alias("before"), F.count_if(~cancel & qty_ok & price_ok).alias("after")),
        "customers": copies.agg(F.sum("_copies").alias("before"), n.alias("after")),
        "tickets": T.raw("tickets").agg(n.alias("before"), n.alias("after")),
        "operations": T.raw("operations").agg(n.alias("before"), n.alias("after")),
    }
    rows = [df.select(F.lit(name).alias("table"), F.col("before").alias("rows_before"), F.col("after").alias("rows_after"),
                      (F.col("before") - F.col("after")).alias("rows_removed")) for name, df in counts.items()]
    return reduce(DataFrame.unionByName, rows)


QUERIES = {"dq_report": dq_report, "dq_rows_removed": dq_rows_removed}
