"""The dashboard's cube: every filter pair of (segment, location) and every
category is a cell, so a filtered figure is a lookup and no scan.

Cells come from two partial aggregates that staged tables keep by input file
(a new month of tickets is read alone): ticket sums by (customer, location,
category) and revenue by customer. They meet the customers' segments once; the
joined sums are brought to (segment, location, category), which is as small as
the three label sets, and only that table is expanded by grouping sets.

A customer counts once in each of the segments it is listed with; tickets and
lines without a customer or of guests count in the cells of all segments alone.
``clv_at_risk`` of a location is that of the at-risk customers with a ticket
there, each counted once, so locations don't add up to the cell of all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from svcops.functions import columns as C
from svcops.functions import constants as K
from svcops.functions.frames import presented
from svcops.operators.experience import at_risk
from svcops.sources.catalog import Tables

LABELS = ("segment", "location_id", "issue_category")
ALL = ("all_segments", "all_locations", "all_categories")
SUMS = ("_n", "_b", "_bn", "_cs", "_cn")
MEASURES = (*SUMS, "_rev", "_clv")


def _ticket_cells(tickets: DataFrame) -> DataFrame:
    return tickets.groupBy("customer_id", "location_id", "issue_category").agg(
        F.count("ticket_id").alias("_n"), F.sum("sla_breached").alias("_b"), F.count("sla_breached").alias("_bn"),
        F.sum(C.exact("csat_score")).alias("_cs"), F.count("csat_score").alias("_cn"))


def _revenue(lines: DataFrame) -> DataFrame:
    return lines.groupBy("customer_id").agg(F.sum(C.exact("revenue")).alias("_rev"))


def _added(df: DataFrame, keys: tuple[str, ...], sums: tuple[str, ...]) -> DataFrame:
    """Sums of partial sums, in the partial sums' own types."""
    return df.groupBy(*keys).agg(*[F.sum(c).cast(df.schema[c].dataType).alias(c) for c in sums])


def ticket_cells(T: Tables) -> DataFrame:
    return T.summed("ticket_cells", "tickets", _ticket_cells,
                    lambda parts: _added(parts, ("customer_id", "location_id", "issue_category"), SUMS))


def customer_revenue(T: Tables) -> DataFrame:
    return T.summed("customer_revenue", "transactions", _revenue, lambda parts: _added(parts, ("customer_id",), ("_rev",)))


def _segments(T: Tables) -> DataFrame:
    return T.c.where(F.col("customer_id").isNotNull() & F.col("segment").isNotNull()).select("customer_id", "segment").distinct()


def _by_segment(T: Tables, df: DataFrame, keys: tuple[str, ...], sums: tuple[str, ...]) -> DataFrame:
    """Sums of rows with a customer by segment and ``keys``, then those of all rows by ``keys``."""
    own = _added(df.join(_segments(T), "customer_id"), ("segment", *keys), sums)
    every = _added(df, keys, sums).withColumn("segment", F.lit(None).cast("string"))
    return own.withColumn("all_segments", F.lit(False)).unionByName(every.withColumn("all_segments", F.lit(True)))


def _service(T: Tables) -> DataFrame:
    base = _by_segment(T, ticket_cells(T), ("location_id", "issue_category"), SUMS)
    own = ["segment", "all_segments"]
    sets = [[*own, "location_id", "issue_category"], [*own, "location_id"], [*own, "issue_category"], own]
    return base.groupingSets(sets, *own, "location_id", "issue_category").agg(
        (F.grouping("location_id") == 1).alias("all_locations"), (F.grouping("issue_category") == 1).alias("all_categories"),
        *[F.sum(c).alias(c) for c in SUMS])


def _risk(T: Tables) -> DataFrame:
    """CLV at risk by (segment, location): once over the customers, once over
    their distinct locations."""
    risk = at_risk(T).select("customer_id", "segment", C.money("clv").alias("_clv"))
    places = ticket_cells(T).where(F.col("customer_id").isNotNull()).select("customer_id", "location_id").distinct()
    nowhere = F.lit(None).cast("string")
    base = _added(risk.join(places, "customer_id").withColumn("all_locations", F.lit(False))
                  .unionByName(risk.withColumn("location_id", nowhere).withColumn("all_locations", F.lit(True))),
                  ("segment", "location_id", "all_locations"), ("_clv",))
    own = ["location_id", "all_locations"]
    cells = base.groupingSets([["segment", *own], own], "segment", *own).agg(
        (F.grouping("segment") == 1).alias("all_segments"), F.sum("_clv").alias("_clv"))
    return cells.where(F.col("all_segments") | F.col("segment").isNotNull())


def _cube(T: Tables) -> DataFrame:
    nothing = F.lit(None).cast("string")
    revenue = _by_segment(T, customer_revenue(T).where(F.col("customer_id") != K.GUEST), (), ("_rev",)).where(~F.col("all_segments"))
    every = customer_revenue(T).agg(F.sum("_rev").alias("_rev")).select(nothing.alias("segment"), F.lit(True).alias("all_segments"), "_rev")
    revenue = (revenue.unionByName(every).withColumns({"location_id": nothing, "all_locations": F.lit(True)}))
    parts = [df if "issue_category" in df.columns else df.withColumns({"issue_category": nothing, "all_categories": F.lit(True)})
             for df in (_service(T), _risk(T), revenue)]
    cells = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    # a cell has at most one row of each part
    return cells.groupBy(*LABELS, *ALL).agg(*[F.max(c).alias(c) for c in MEASURES])


def cube(T: Tables) -> DataFrame:
    """The cells, staged. A label is null in the cells of all its values, which
    the ``all_*`` columns mark."""
    return T.derived("dashboard_cube", lambda: _cube(T).transform(presented, *LABELS))


def _is(label: str, every: str, value: str | None) -> Column:
    return F.col(every) if value is None else ~F.col(every) & (F.col(label) == value)


def kpis(T: Tables, segment: str | None, location: str | None) -> DataFrame:
    """The headline figures of one filter pair, from at most two cells; a cell
    that isn't there gives nulls, as empty tables do."""
    own = cube(T).where(_is("segment", "all_segments", segment) & F.col("all_categories"))
    place = _is("location_id", "all_locations", location)
    one = own.agg(F.max(F.when(F.col("all_locations"), F.col("_rev"))).alias("_rev"),
                  *[F.max(F.when(place, F.col(c))).alias(c) for c in (*SUMS, "_clv")])
    return one.select(
        F.round(F.col("_rev").cast("double"), 2).alias("total_revenue"),
        C.pct(C.ratio(F.col("_b"), F.col("_bn"))).alias("breach_rate_pct"),
        F.round(C.ratio(F.col("_cs").cast("double"), F.col("_cn")), 2).alias("avg_csat"),
        F.col("_clv").cast("double").alias("clv_at_risk"))


def csat_by_category(T: Tables, segment: str | None, location: str | None) -> DataFrame:
    """``issue_category, _cs, _cn, _n`` of one filter pair."""
    return cube(T).where(_is("segment", "all_segments", segment) & _is("location_id", "all_locations", location)
                         & ~F.col("all_categories")).select("issue_category", F.col("_cs").cast("double").alias("_cs"), "_cn", "_n")


def dash_cube(T: Tables) -> DataFrame:
    """Every cell with its figures: what a dashboard loads to filter by itself."""
    return cube(T).select(
        *LABELS, *ALL, F.col("_n").alias("ticket_count"),
        C.pct(C.ratio(F.col("_b"), F.col("_bn"))).alias("breach_rate_pct"),
        F.round(C.ratio(F.col("_cs").cast("double"), F.col("_cn")), 2).alias("avg_csat"),
        F.round(F.col("_rev").cast("double"), 2).alias("total_revenue"),
        F.col("_clv").cast("double").alias("clv_at_risk"))


QUERIES = {"dash_cube": dash_cube}
