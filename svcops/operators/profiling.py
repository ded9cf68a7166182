"""Profiling: shape, null counts, value counts, describe, duplicates.

Every profile is one aggregate pass per table (``count_if`` per column, all
statistics in one ``agg``), reshaped with ``unpivot`` / ``inline``; exact
quartiles come from distributed selection (``functions.ranks``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from svcops.functions import columns as C
from svcops.functions.frames import presented, with_scalars
from svcops.functions.ranks import column_percentiles
from svcops.operators.experience import risk_profile
from svcops.sources.catalog import CLEAN_TABLES, Tables


def prof_shape(T: Tables) -> DataFrame:
    raw = T.raw("transactions")
    return raw.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(raw.columns)).alias("columns"),
        F.min("invoice_date").alias("min_date"),
        F.max("invoice_date").alias("max_date"),
        F.count_distinct("customer_id").alias("distinct_customers"),
        F.count_distinct("country").alias("distinct_countries"),
        F.count_if(F.coalesce(F.col("invoice").startswith("C"), F.lit(False))).alias("cancellations"))


def null_counts(df: DataFrame, table: str) -> DataFrame:
    """Long form ``(table, column, nulls)`` from one aggregate pass."""
    cols = df.columns
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return (wide.unpivot([], cols, "column", "nulls")
            .select(F.lit(table).alias("table"), "column", "nulls"))


def _union(parts):
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def prof_nulls(T: Tables) -> DataFrame:
    return _union([null_counts(T.raw(t), f"{t}_raw") for t in CLEAN_TABLES])


def prof_nulls_after(T: Tables) -> DataFrame:
    per_col = _union([null_counts(T.clean(t), t) for t in CLEAN_TABLES])
    totals = per_col.groupBy("table").agg(F.sum("nulls").alias("nulls")).select(
        "table", F.lit("TOTAL").alias("column"), "nulls")
    return per_col.unionByName(totals)


def prof_top_values(T: Tables, n: int = 10) -> DataFrame:
    return (T.raw("transactions").where(F.col("country").isNotNull())
            .groupBy("country").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), "country").limit(n))


def value_counts(df: DataFrame, source: str, column: str) -> DataFrame:
    return (df.where(F.col(column).isNotNull()).groupBy(column)
            .agg(F.count(F.lit(1)).alias("count"))
            .select(F.lit(source).alias("source"), F.lit(column).alias("column"),
                    F.col(column).cast("string").alias("value"), "count"))


def prof_value_counts(T: Tables) -> DataFrame:
    return _union([
        value_counts(T.raw("customers"), "customers_raw", "segment"),
        value_counts(T.c, "customers", "segment"),
        value_counts(T.raw("tickets"), "tickets_raw", "issue_category"),
        value_counts(T.k, "tickets", "issue_category"),
        value_counts(T.raw("operations"), "operations_raw", "location_id"),
        value_counts(T.o, "operations", "location_id"),
        value_counts(T.o, "operations", "sla_status"),
        value_counts(risk_profile(T), "customer_risk_profile", "risk_tier"),
    ])


_STATS = ("count", "mean", "std", "min", "25%", "50%", "75%", "max")


def prof_describe(T: Tables) -> DataFrame:
    """``describe()`` of quantity and price on the raw lines, 2 decimals."""
    raw = T.raw("transactions")
    quartiles = column_percentiles(raw, ("quantity", "price"), (0.25, 0.5, 0.75))
    aggs = []
    for c in ("quantity", "price"):
        aggs += [F.count(c).cast("double").alias(f"{c}_count"), C.avg_round(c, 2).alias(f"{c}_mean"),
                 F.stddev_samp(c).alias(f"{c}_std"), F.min(c).cast("double").alias(f"{c}_min"),
                 F.max(c).cast("double").alias(f"{c}_max")]
    wide = with_scalars(raw.agg(*aggs), quartiles)

    def stat(c: str, s: str):
        if s in ("25%", "50%", "75%"):
            return F.col(f"{c}_q")[("25%", "50%", "75%").index(s)]
        return F.col(f"{c}_{s}")

    rows = [F.struct(F.lit(i).alias("stat_order"), F.lit(s).alias("stat"),
                     F.round(stat("quantity", s), 2).alias("quantity"),
                     F.round(stat("price", s), 2).alias("price"))
            for i, s in enumerate(_STATS)]
    return wide.select(F.inline(F.array(*rows))).transform(presented, "stat_order")


def prof_sign_counts(T: Tables) -> DataFrame:
    raw = T.raw("transactions")
    return raw.agg(
        F.count_if(F.col("quantity") < 0).alias("negative_quantity"),
        F.count_if(F.col("price") == 0).alias("zero_price"),
        F.count_if(F.col("price") < 0).alias("negative_price"),
        F.count_if(F.col("price") <= 0).alias("nonpositive_price"),
        F.count_if(F.coalesce(F.col("invoice").startswith("C"), F.lit(False))).alias("cancellations"))


def prof_duplicates(T: Tables) -> DataFrame:
    raw = T.raw("customers")
    copies = raw.groupBy(*raw.columns).agg(F.count(F.lit(1)).alias("_n"))
    return copies.agg(F.lit("customers_raw").alias("table"),
                      F.sum(F.col("_n") - 1).alias("duplicate_rows"))


def prof_preview(T: Tables, n: int = 5) -> DataFrame:
    """First ``n`` clean customers by id (an explicit order: Spark has no file order)."""
    return T.c.orderBy("customer_id").limit(n)


def prof_preview_transactions(T: Tables, n: int = 10) -> DataFrame:
    raw = T.raw("transactions")
    return raw.orderBy("invoice", "stock_code", *raw.columns).limit(n)


def prof_preview_customers(T: Tables, n: int = 5) -> DataFrame:
    raw = T.raw("customers")
    return raw.orderBy(*raw.columns).limit(n)


def prof_preview_tickets(T: Tables, n: int = 5) -> DataFrame:
    return T.raw("tickets").orderBy("ticket_id").limit(n)


def prof_preview_operations(T: Tables, n: int = 5) -> DataFrame:
    return T.raw("operations").orderBy("location_id", "quarter").limit(n)


def prof_row_counts(T: Tables) -> DataFrame:
    return _union([T.clean(t).agg(F.count(F.lit(1)).alias("rows"))
                   .select(F.lit(t).alias("table"), "rows") for t in CLEAN_TABLES])


QUERIES = {
    "prof_shape": prof_shape,
    "prof_nulls": prof_nulls,
    "prof_nulls_after": prof_nulls_after,
    "prof_top_values": prof_top_values,
    "prof_value_counts": prof_value_counts,
    "prof_describe": prof_describe,
    "prof_sign_counts": prof_sign_counts,
    "prof_duplicates": prof_duplicates,
    "prof_preview": prof_preview,
    "prof_preview_transactions": prof_preview_transactions,
    "prof_preview_customers": prof_preview_customers,
    "prof_preview_tickets": prof_preview_tickets,
    "prof_preview_operations": prof_preview_operations,
    "prof_row_counts": prof_row_counts,
}
