"""Rules with literal expected rows, independent of the constants module."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from svcops.functions import ranks
from svcops.functions.ranks import column_percentiles, percentiles
from svcops.operators import clean as CL
from svcops.operators import experience as X
from svcops.operators import exploratory as E
from svcops.operators import service_queries as SQ
from svcops.session import scratch_path
from svcops.sources import io
from svcops.sources.catalog import Tables
from tests.test_edges import customers, tickets, transactions

D = dt.date(2000, 1, 3)


# ------------------------------------------------------------------ exact means

def test_means_keep_the_values_decimals(spark):
    T = Tables.from_frames(spark, tickets=tickets(spark, [("1", "a", "L", 0.25, 4.0), ("2", "a", "L", 0.25, 4.0)]))
    assert E.eda_category_summary(T).first()["avg_resolution_days"] == 0.25
    assert SQ.q1_1_breach_by_location(T).first()["avg_resolution_days"] == 0.3


def test_sub_cent_prices_are_rounded_once(spark):
    rows = [("1", 1, 0.004, "7"), ("1", 1, 0.004, "7"), ("2", 1, 0.004, "7")]
    T = Tables.from_frames(spark, transactions=transactions(spark, rows), customers=customers(spark, [("7", "Retail", 10.0)]))
    r = SQ.q2_2_top20_customers(T).first()
    assert (r["total_revenue"], r["avg_order_value"], r["total_orders"]) == (0.01, 0.0, 2)
    assert E.eda_revenue_summary(T).first()["total_revenue"] == 0.01


def test_totals_do_not_depend_on_the_order(spark):
    rows = [(str(i), 1, p, "7") for i, p in enumerate([1e7, 0.1, 0.2, 0.3, 1e7] * 40)]
    got = set()
    for order in (rows, rows[::-1], sorted(rows, key=lambda r: r[2])):
        T = Tables.from_frames(spark, transactions=transactions(spark, order))
        got.add(SQ.q2_3_country_revenue(T).first()["total_revenue"])
    assert got == {800000024.0}


# ------------------------------------------------------------------ ids

@pytest.mark.parametrize("text, want", [("13085", "13085"), ("13085.0", "13085"), ("13085.50", "13085.50"), ("GUEST", "GUEST"), ("007", "7"), (None, None)])
def test_ids_in_every_cleaner(spark, text, want):
    frames = dict(transactions=transactions(spark, [("1", 1, 1.0, text)]), customers=customers(spark, [(text, "Retail", 1.0)]),
                  tickets=tickets(spark, [("1", text, "L", 1.0, 4.0)]))
    T = Tables.from_frames(spark, **frames)
    assert T.c.first()["customer_id"] == T.k.first()["customer_id"] == want
    assert T.t.first()["customer_id"] == (want or "GUEST")


def test_ids_in_two_forms_join(spark):
    T = Tables.from_frames(spark, customers=customers(spark, [("13085", "Retail", 100.0)]),
                           tickets=tickets(spark, [("1", "13085.0", "L", 9.0, 1.0), ("2", "13085", "L", 9.0, 2.0)]))
    assert [tuple(r) for r in SQ.q3_1_clv_risk_segment(T).collect()] == [("Retail", 1, 100.0, 100.0, 100.0)]


def test_ids_listed_twice(spark):
    T = Tables.from_frames(
        spark, customers=customers(spark, [("1", "Retail", 10.0), ("1", "Retail", 20.0)]),
        tickets=tickets(spark, [("1", "1", "LOC_01", 9.0, 1.0), ("2", "1", "LOC_01", 9.0, 2.0), ("3", None, "LOC_01", 9.0, 1.0)]),
        operations=spark.createDataFrame([("LOC_01", "1999-Q1", "UK", 1.0, 2.0, 0.5, 1.0, 3)], io.OPERATIONS_RAW_SCHEMA))
    r = SQ.q3_2_location_exposure(T).first()
    assert (r["unique_customers_affected"], r["total_tickets"], r["total_clv_exposed"]) == (1, 4, 60.0)
    profile = X.cx_risk_profile(T).collect()
    assert [(p["customer_id"], p["total_tickets"], p["sla_breaches"], p["clv"], p["churn_risk"]) for p in profile] == [("1", 4, 4, 20.0, True)]


# ------------------------------------------------------------------ labels, bands, tiers

def test_segment_and_category_labels(spark):
    names = ["Retail", "retail", "RETAIL", "Corporate", "corporate", "Wholesale", "Other"]
    got = CL.step_c_segment(customers(spark, [(str(i), n, 1.0) for i, n in enumerate(names)])).collect()
    assert [r["segment"] for r in got] == ["Retail"] * 3 + ["Corporate"] * 2 + ["Wholesale", None]
    T = Tables.from_frames(spark, tickets=tickets(spark, [("1", "a", "L", 1.0, 4.0, "Billing"), ("2", "a", "L", 1.0, 4.0, "Nope")]))
    got = {r["ticket_id"]: (r["issue_category"], r["changed_labels"]) for r in CL.cl_k_category(T).collect()}
    assert got == {"1": ("Billing", 1), "2": (None, 1)}


def test_risk_tiers(spark):
    rows = [("0", "Retail", 1999.99), ("1", "Retail", 2000.0), ("2", "no such segment", None)] + [("9", "Corporate", 5000.0)]
    bad = [(f"{c}-{n}", c, "L", 9.0, 1.0) for c in ("0", "1", "2") for n in (1, 2)]
    T = Tables.from_frames(spark, customers=customers(spark, rows), tickets=tickets(spark, [*bad, ("x", "9", "L", 9.0, 1.0)]))
    got = {r["customer_id"]: r["risk_tier"] for r in X.cx_risk_profile(T).collect()}
    assert got == {"0": "High Risk", "1": "Critical Risk", "2": "High Risk", "9": "Low Risk"}


def test_churn_scenarios(spark):
    rows = [("1", "c", "L", 9.0, 1.0), ("2", "c", "L", 9.0, 1.0)]
    T = Tables.from_frames(spark, customers=customers(spark, [("c", "Retail", 1000.0)]), tickets=tickets(spark, rows))
    assert [tuple(r) for r in SQ.q3_3_churn_cost(T).collect()] == [
        ("10% churn", 100.0), ("20% churn", 200.0), ("30% churn", 300.0), ("50% churn", 500.0)]


# ------------------------------------------------------------------ operations

def test_operations_cleaning(spark):
    raw = [("Location_03", "1999-Q2", "Germany", 4.0, 2.0, 0.40, 1.0, 5), ("LOC_03", "1999-Q3", "Germany", None, 2.0, None, 1.0, 5),
           ("LOC_03", "1999-Q4", "Germany", 6.0, 2.0, 0.605, 1.0, 5), ("LOC_08", "2000-Q1", "France", 10.0, 2.0, 0.70, 1.0, 5)]
    T = Tables.from_frames(spark, operations=spark.createDataFrame(raw, io.OPERATIONS_RAW_SCHEMA))
    got = {r["quarter"]: r for r in T.o.collect()}
    assert {q: (r["location_id"], r["staff_count"], r["sla_achievement_rate"], r["sla_status"]) for q, r in got.items()} == {
        "1999-Q2": ("LOC_03", 4.0, 0.4, "Critical"), "1999-Q3": ("LOC_03", 6.0, 0.5, "At Risk"),
        "1999-Q4": ("LOC_03", 6.0, 0.61, "At Risk"), "2000-Q1": ("LOC_08", 10.0, 0.7, "Compliant")}
    assert got["1999-Q3"]["sla_imputed"] and got["1999-Q3"]["staff_imputed"]


def test_operations_cover_all_years(spark, sf_dir):
    T = Tables(spark, sf_dir)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert T.raw("operations").agg({"ticket_volume_handled": "sum"}).first()[0] == lines


# ------------------------------------------------------------------ percentiles

def test_percentiles_of_many_values(spark):
    """Millions of distinct values in one group, and small groups beside it."""
    n = 2_000_001
    big = spark.range(n).selectExpr("'a' AS g", "CAST(id * 0.5 AS DOUBLE) AS v")
    rest = spark.createDataFrame([("b", 1.0), ("b", 2.0), ("b", None), (None, 5.0), ("c", 7.0)], "g string, v double")
    got = {r["g"]: tuple(r)[1:] for r in percentiles(big.union(rest), "g", "v", (0.25, 0.5, 1.0)).collect()}
    assert got == {"a": (250000.0, 500000.0, 1000000.0), "b": (1.25, 1.5, 2.0), "c": (7.0, 7.0, 7.0)}


@pytest.mark.parametrize("shape", ["spread", "few", "skewed", "ties", "signs"])
def test_percentiles_equal_pandas(spark, shape, monkeypatch):
    """Also where the sketches are coarse against the number of rows."""
    rng = np.random.default_rng(5)
    n = 60_000
    values = {"spread": rng.normal(size=n), "few": rng.integers(0, 4, n) * 1.5, "skewed": np.exp(rng.normal(0, 9, n)),
              "ties": np.where(rng.random(n) < 0.9, 7.0, rng.random(n)), "signs": rng.integers(-2, 3, n) * 10.0 ** rng.integers(-300, 300, n)}[shape]
    monkeypatch.setattr(ranks, "ACCURACY", 500)
    monkeypatch.setattr(ranks, "MARGIN", 5 / 500)
    monkeypatch.setattr(ranks, "GRID", 40)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", "c"], n, p=[0.9, 0.0999, 0.0001]), "v": values})
    shares = (0.0, 0.001, 0.25, 0.5, 0.75, 0.9999, 1.0)
    df = spark.createDataFrame(pdf).repartition(7)
    got = {r["g"]: list(r)[1:] for r in percentiles(df, "g", "v", shares).collect()}
    for g, own in pdf.groupby("g"):
        want = own["v"].quantile(shares, interpolation="lower"), own["v"].quantile(shares, interpolation="higher")
        assert all(a <= x <= b for x, a, b in zip(got[g], *want)), g
        assert np.allclose(got[g], own["v"].quantile(shares), rtol=1e-9)
    both = column_percentiles(df, ("v",), shares).first()
    assert np.allclose(both["v_q"], pdf["v"].quantile(shares), rtol=1e-9)


def test_percentiles_run_nothing_while_planned(spark):
    """No job, checkpoint or range partitioning; the last shuffle holds a few values."""
    df = spark.range(200_000).selectExpr("CAST(id % 2 AS STRING) AS g", "CAST(id AS DOUBLE) AS v", "CAST(-id AS DOUBLE) AS w")
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    one, two = percentiles(df, "g", "v", (0.5,)), column_percentiles(df, ("v", "w"), (0.25, 0.5))
    assert len(tracker.getJobIdsForGroup(None)) == before
    for x in (one, two):
        plan = x._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning" not in plan and "Scan ExistingRDD" not in plan
    assert {r["g"]: r["p0"] for r in one.collect()} == {"0": 99_999.0, "1": 100_000.0}
    row = two.first()
    assert row["v_q"] == [49_999.75, 99_999.5] and row["w_q"] == [-149_999.25, -99_999.5]


def test_percentiles_of_values_that_are_no_numbers(spark):
    """NaN is the largest value, a third of the rows here; infinities stay what they are."""
    df = spark.range(9_001).selectExpr("'a' AS g", "CASE WHEN id % 3 = 0 THEN double('NaN') WHEN id = 1 THEN double('-Infinity') "
                                       "ELSE CAST(id AS DOUBLE) END AS v")
    low, mid, high = percentiles(df, "g", "v", (0.0, 0.5, 0.9)).first()[1:]
    order = sorted(i for i in range(9_001) if i % 3)
    assert (low, mid) == (float("-inf"), float(order[4_500])) and np.isnan(high)


def test_percentiles_of_nothing(spark):
    df = spark.createDataFrame([(None, 1.0), ("a", None)], "g string, v double")
    assert percentiles(df, "g", "v", (0.5,)).count() == 0
    assert column_percentiles(df.where("false"), ("v",), (0.5,)).count() == 0


# ------------------------------------------------------------------ files

AWKWARD = ['say "hi", ok', "two\nlines", " lead", "trail ", "", None, "comma, here", '"', "\\N-ish", "é"]


def test_csv_round_trip(spark):
    rows = [(str(i), "1", text, 1, dt.datetime(1999, 3, 1, 10, 0), 1.5, None, "UK", 1.5) for i, text in enumerate(AWKWARD)]
    df = spark.createDataFrame(rows, io.TRANSACTIONS_RAW_SCHEMA)
    path = scratch_path(spark, "csv")
    io.write_csv(df, path, io.NULL_TEXT)
    back = io.read_csv(spark, path, io.TRANSACTIONS_RAW_SCHEMA, io.NULL_TEXT, multi_line=True)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_ordinary_csv(spark, tmp_path):
    (tmp_path / "tickets.csv").write_text(
        "ticket_id,customer_id,location_id,ticket_date,issue_category,priority,resolution_days,csat_score,status\n"
        '1,13085.0,LOC_01,2000-01-03,"Billing",High,0.25,,"say ""hi"", ok"\n2,,LOC_01,2000-01-04,Billing,Low,,5,\n')
    T = Tables.from_files(spark, tickets=str(tmp_path / "tickets.csv"))
    got = sorted(T.k.collect())
    assert [(r["ticket_id"], r["customer_id"], r["resolution_days"], r["csat_score"], r["status"]) for r in got] == [
        ("1", "13085", 0.25, None, 'say "hi", ok'), ("2", None, None, 5.0, None)]


def test_sheets_lose_no_line(spark):
    raw = transactions(spark, [("1", 1, 1.0, "7", dt.datetime(1997, 5, 1)), ("2", 1, 1.0, "7", dt.datetime(1998, 1, 1)),
                               ("3", 1, 1.0, None, None), ("4", -1, 1.0, "7", dt.datetime(1999, 1, 1))])
    path = scratch_path(spark, "raw") + ".parquet"
    raw.write.parquet(path)
    T = Tables.from_files(spark, transactions=path)
    assert sorted(map(str, io.src_sheets_union(T).collect())) == sorted(map(str, raw.collect()))


def test_unstaged_tables_share_no_folder(spark):
    for n in ("1", "2"):
        T = Tables.from_frames(spark, tickets=tickets(spark, [(n, "a", "L", 1.0, 4.0)]))
        assert [r["ticket_id"] for r in io.src_csv(T).collect()] == [n]


def test_own_files_years_and_outputs(spark):
    """A whole run over one's own files: other years, staged once, three outputs."""
    base = scratch_path(spark, "own")
    t = transactions(spark, [("1", 2, 5.0, "7", dt.datetime(2010, 11, 1)), ("2", 1, 5.0, "7", dt.datetime(2011, 2, 1))])
    k = tickets(spark, [("1", "7", "LOC_01", 9.0, 1.0), ("2", "7.0", "LOC_01", 9.0, 1.0)])
    c = customers(spark, [("7", "Corporate", 5000.0)])
    o = spark.createDataFrame([("LOC_01", "2010-Q1", "UK", 1.0, 2.0, 0.5, 1.0, 3)], io.OPERATIONS_RAW_SCHEMA)
    for name, df in dict(transactions=t, tickets=k, customers=c, operations=o).items():
        df.write.parquet(f"{base}/{name}.parquet")
    T = Tables.from_files(spark, years=(2010, 2011), months=2, **{n: f"{base}/{n}.parquet" for n in ("transactions", "tickets", "customers", "operations")})
    assert [tuple(r) for r in E.eda_monthly_revenue(T).collect()] == [("2010-11", 10.0), ("2011-02", 5.0)]
    from svcops.operators.implications import bi_sla_cost
    assert bi_sla_cost(T).first()["monthly_breaches"] == 1
    assert T.c.inputFiles() == T.c.inputFiles()
    io.write_outputs(T, f"{base}/out")
    critical = spark.read.option("header", True).csv(f"{base}/out/critical_risk_customers").collect()
    assert [(r["customer_id"], r["clv"]) for r in critical] == [("7", "5000.0")]
    assert spark.read.option("header", True).csv(f"{base}/out/data_quality_report").count() == 19
    T.unstage()
