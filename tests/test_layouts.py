"""Tables laid out by customer: joins without an exchange, hot customers in slices."""

import pytest
from pyspark.sql import functions as F

from svcops.operators import experience as E
from svcops.operators import service_queries as Q
from svcops.plans.registry import queries
from svcops.session import data_files
from svcops.sources import catalog, layouts
from svcops.sources.catalog import Tables
from tests.test_plans import _plan
from tests.test_plans import no_broadcast  # noqa: F401
from tests.test_stages import inputs, line, rows, ticket, write  # noqa: F401

JOINS = {
    "q2_1_segment_revenue": lambda T: Q.customer_totals(T).join(layouts.customers(T), "customer_id"),
    "q2_2_top20_customers": Q.q2_2_top20_customers,
    "q3_1_clv_risk_segment": lambda T: layouts.customers(T).join(Q.at_risk_customers(T), "customer_id"),
    "cx_ticket_customer": E.cx_ticket_customer,
    "cx_segment_burden": lambda T: E.ticket_totals(T).join(layouts.customers(T), "customer_id"),
}


@pytest.mark.parametrize("key", sorted(JOINS))
def test_joins_exchange_neither_side(spark, sf_dir, no_broadcast, key):  # noqa: F811
    plan = _plan(JOINS[key](Tables(spark, sf_dir)))
    assert "SortMergeJoin" in plan and "Exchange" not in plan


@pytest.mark.parametrize("key", ["cx_segment_burden", "q3_1_clv_risk_segment"])
def test_whole_reports_exchange_segments_only(spark, sf_dir, no_broadcast, key):  # noqa: F811
    exchanges = [x for x in _plan(queries()[key](spark, sf_dir)).splitlines() if "Exchange hashpartitioning" in x]
    assert exchanges and all("hashpartitioning(segment" in x for x in exchanges)


def test_a_hot_customer_is_cut_into_slices(spark, inputs, monkeypatch):  # noqa: F811
    """Half of the tickets, and repeats of one row, of one customer; a fifth without one."""
    monkeypatch.setattr(layouts.hot_customers, "__defaults__", (16,))
    monkeypatch.setattr(layouts.sliced, "__defaults__", (16,))
    hot = [ticket(500, 3, 2)] * 400 + [ticket(1000 + i, 3, 3) for i in range(100)]
    write(spark, "tickets", hot + [ticket(2000 + i, "", 1) for i in range(200)], inputs["tickets"], "hot.parquet")
    write(spark, "customers", [("3", "Corporate", 7.0, "Online", "Asia", None)], inputs["customers"], "twice.parquet")
    T, plain = Tables.from_files(spark, **inputs), Tables.from_files(spark, staged=False, **inputs)
    want = plain.k.join(plain.c.select("customer_id", "segment", "clv", "region"), "customer_id", "left")
    assert rows(E.cx_ticket_customer(T).select(*want.columns)) == rows(want)
    assert rows(E.cx_segment_burden(T)) == rows(E.cx_segment_burden(plain))
    tickets, listed = layouts.tickets_and_customers(T)
    sizes = {tuple(r): n for *r, n in tickets.groupBy("customer_id", layouts.SLICE).count().collect()}
    total = tickets.count()
    assert len([k for k in sizes if k[0] == "3"]) >= 8 and max(sizes.values()) <= 2 * total / 16
    assert listed.where("customer_id = '3'").count() == 2 * len([k for k in sizes if k[0] == "3"])
    assert layouts.hot_customers(plain.k).count() <= 16
    T.unstage()


def test_empty_tickets_have_no_hot_customer(spark, inputs):  # noqa: F811
    T = Tables.from_files(spark, staged=False, **inputs)
    assert layouts.hot_customers(T.k.limit(0)).count() == 0
    cut, listed = layouts.sliced(T.k.limit(0), T.c)
    assert cut.count() == 0 and listed.count() == T.c.count()


def test_orders_that_customers_share(spark, inputs):  # noqa: F811
    """An invoice of two customers is one order of a segment and one of each of two segments."""
    write(spark, "customers", [(str(c), "Corporate", 5.0, "Online", "Asia", None) for c in (31, 32)], inputs["customers"], "more.parquet")
    shared = [("900", *line(i, c, 2010)[1:]) for i, c in enumerate((1, 2, 31))] + [("901", *line(i, c, 2010)[1:]) for i, c in enumerate((31, 32))]
    write(spark, "transactions", shared, inputs["transactions"], "shared.parquet")
    for staged in (True, False):
        T = Tables.from_files(spark, staged=staged, **inputs)
        got = {r["segment"]: (r["customer_count"], r["total_orders"], r["total_revenue"]) for r in Q.q2_1_segment_revenue(T).collect()}
        known = T.t.where("customer_id != 'GUEST'").join(T.c.select("customer_id", "segment"), "customer_id")
        want = {r["segment"]: (r["a"], r["b"], r["c"]) for r in known.groupBy("segment").agg(
            F.countDistinct("customer_id").alias("a"), F.countDistinct("invoice").alias("b"), F.round(F.sum("revenue"), 2).alias("c")).collect()}
        assert got == want and got["Corporate"][:2] == (2, 2)
        T.unstage()


def test_nothing_is_left_in_the_catalog(spark, inputs):  # noqa: F811
    """Databases go with their stages: with a new version of the input, and at the end."""
    def own(T):
        return {layouts.database(p) for k, (_, p) in catalog._STAGED.items() if k[2] == tuple(sorted(inputs.items()))}

    T = Tables.from_files(spark, **inputs)
    E.cx_ticket_customer(T).count()
    layouts.customers(T).count()
    first = [n for n in own(T) if spark.catalog.databaseExists(n)]
    assert len(first) == 2
    write(spark, "tickets", [ticket(700, 2, 5)], inputs["tickets"], "more.parquet")
    assert E.cx_ticket_customer(Tables.from_files(spark, **inputs)).count() == 61
    second = [n for n in own(T) if spark.catalog.databaseExists(n)]
    paths = [p for k, (_, p) in catalog._STAGED.items() if k[2] == tuple(sorted(inputs.items()))]
    assert len(second) == 2 and sum(spark.catalog.databaseExists(n) for n in first) == 1
    T.unstage()
    assert not any(spark.catalog.databaseExists(n) for n in first + second)
    assert all(data_files(spark, p) == () for p in paths)


def test_saved_tables_are_dropped(spark, inputs):  # noqa: F811
    T = Tables.from_files(spark, **inputs)
    before = {d.name for d in spark.catalog.listDatabases()}
    from svcops.sources.io import sink_tables
    assert {r["table"]: r["rows"] for r in sink_tables(T).collect()}["tickets"] == 60
    assert {d.name for d in spark.catalog.listDatabases()} > before
    T.unstage()
    assert {d.name for d in spark.catalog.listDatabases()} <= before
