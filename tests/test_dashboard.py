"""Dashboard filters: a segment or location filter equals the same KPI
computed on the pre-filtered tables, and the cube's cells equal the direct form."""

import os

from pyspark.sql import functions as F

from svcops.operators import cube
from svcops.operators import dashboard as DB
from svcops.operators.experience import at_risk
from svcops.sources.catalog import Tables
from tests.test_stages import inputs, rows, spoil, ticket, write  # noqa: F401


def test_segment_filter(spark, sf_dir):
    T = Tables(spark, sf_dir)
    got = DB.dash_kpis(T, segment="Corporate").first()
    ids = T.c.where(F.col("segment") == "Corporate").select("customer_id")
    k = T.k.join(ids, "customer_id", "left_semi")
    t = T.t.join(ids, "customer_id", "left_semi")
    assert got["total_revenue"] == t.agg(F.round(F.sum("revenue"), 2)).first()[0]
    assert got["avg_csat"] == k.agg(F.round(F.avg("csat_score"), 2)).first()[0]
    want_clv = (at_risk(T).where(F.col("segment") == "Corporate")
                .agg(F.sum(F.col("clv").cast("decimal(18,2)")).cast("double")).first()[0])
    assert got["clv_at_risk"] == want_clv


def test_location_filter(spark, sf_dir):
    T = Tables(spark, sf_dir)
    got = DB.dash_kpis(T, location="LOC_03").first()
    k = T.k.where(F.col("location_id") == "LOC_03")
    assert got["breach_rate_pct"] == k.agg(F.round(F.avg("sla_breached") * 100, 1)).first()[0]
    cats = DB.dash_csat_by_category(T, location="LOC_03").collect()
    assert sum(r["ticket_count"] for r in cats) == k.where(F.col("issue_category").isNotNull()).count()
    vals = [r["avg_csat"] for r in cats]
    assert vals == sorted(vals)


def same_figures(T, small, *pairs):
    for pair in pairs:
        assert rows(DB.dash_kpis(T, *pair)) == rows(DB.dash_kpis(small, *pair)), pair
        assert rows(DB.dash_csat_by_category(T, *pair)) == rows(DB.dash_csat_by_category(small, *pair)), pair


def test_filter_pairs_equal_the_direct_form(spark, sf_dir):
    T = Tables(spark, sf_dir)
    held = {n: T.raw(n).cache() for n in ("transactions", "customers", "tickets", "operations")}
    same_figures(T, Tables.from_frames(spark, **held), ("Corporate", "LOC_03"), ("nobody", "nowhere"))
    for df in held.values():
        df.unpersist()


def test_cells_of_awkward_rows(spark, inputs):  # noqa: F811
    """A customer of two segments, one without, at-risk customers in several
    places, tickets without place, category or customer, guests' lines."""
    two = [("3", "Corporate", 7.0, "Online", "Asia", None), ("50", None, 9.0, "Online", "Asia", None)]
    write(spark, "customers", two, inputs["customers"], "two.parquet")
    late = [("a%d" % i, c, place, None, kind, "Low", days, 1.0, "Resolved")
            for i, (c, place, kind, days) in enumerate([
                (c, place, kind, days) for c in ("3", "4", "50", None, "99") for place in ("LOC_02", None)
                for kind in ("billing", None) for days in (9.0, None)])]
    write(spark, "tickets", late, inputs["tickets"], "late.parquet")
    T, plain = Tables.from_files(spark, **inputs), Tables.from_files(spark, staged=False, **inputs)
    same_figures(T, plain, (None, "LOC_02"), ("Corporate", "LOC_02"), ("Corporate", None))
    assert rows(cube.dash_cube(T)) == rows(cube.dash_cube(plain))


def test_a_new_month_is_read_alone(spark, inputs):  # noqa: F811
    T = Tables.from_files(spark, **inputs)
    before = rows(cube.dash_cube(T))
    spoil(os.path.join(inputs["tickets"], "jan.parquet"))
    write(spark, "tickets", [ticket(900 + i, i % 4, 2, 2.0) for i in range(20)], inputs["tickets"], "feb.parquet")
    cells = cube.ticket_cells(T)
    assert cells.agg(F.sum("_n")).first()[0] == 80 and rows(cube.dash_cube(T)) != before


def test_a_lookup_reads_the_cells_alone(spark, sf_dir):
    T = Tables(spark, sf_dir)
    cells = set(cube.cube(T).inputFiles())
    assert cells and set(DB.dash_kpis(T, "Corporate", "LOC_03").inputFiles()) == cells
