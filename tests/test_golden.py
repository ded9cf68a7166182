"""Replay of a whole operations table, written out by hand: eight locations by
eight quarters, with the defects that cleaning repairs, and the expected rows."""

import pytest
from pyspark.sql import functions as F

from svcops.operators import clean as CL
from svcops.operators.service_queries import q1_2_sla_trend, q1_3_locations_below_70
from svcops.sources.catalog import Tables
from svcops.sources.io import OPERATIONS_RAW_SCHEMA

QUARTERS = [f"{y}-Q{q}" for y in (2010, 2011) for q in (1, 2, 3, 4)]

# location -> (region, staff, rate by quarter)
ROWS = {
    "LOC_01": ("UK", 10.0, [0.90, 0.91, 0.92, 0.93, 0.94, 0.95, 0.96, 0.97]),
    "LOC_02": ("UK", 14.0, [0.70, 0.70, 0.71, 0.72, 0.70, 0.74, 0.75, 0.76]),
    "LOC_03": ("Germany", 8.0, [0.42, 0.45, 0.48, 0.49, 0.50, 0.52, 0.55, 0.57]),
    "LOC_04": ("France", 12.0, [0.80, 0.81, 0.82, 0.83, 0.84, 0.85, 0.86, 0.87]),
    "LOC_05": ("Netherlands", 16.0, [0.85, 0.86, 0.87, 0.85, 0.86, 0.87, None, 0.86]),
    "LOC_06": ("EIRE", 6.0, [0.88, 0.88, 0.88, 0.88, 0.88, 0.88, 0.88, 0.88]),
    "LOC_07": ("Germany", 18.0, [None, 0.49, 0.55, 0.56, 0.57, 0.58, 0.52, 0.53]),
    "LOC_08": ("France", None, [0.75, 0.76, 0.77, 0.78, 0.79, 0.80, 0.81, 0.82]),
}


@pytest.fixture(scope="module")
def raw(spark):
    rows = [("Location_03" if (loc, q) == ("LOC_03", "2010-Q2") else loc, q, region, staff, 2.0, rate, 0.5, 100 + i)
            for loc, (region, staff, rates) in ROWS.items() for i, (q, rate) in enumerate(zip(QUARTERS, rates))]
    return spark.createDataFrame(rows, OPERATIONS_RAW_SCHEMA)


def test_operations_replay(raw):
    got = {(r["location_id"], r["quarter"]): r for r in CL.clean_operations(raw).collect()}
    assert len(got) == 64
    for loc, (region, staff, rates) in ROWS.items():
        for i, (q, rate) in enumerate(zip(QUARTERS, rates)):
            r = got[loc, q]
            # LOC_07's mean is 3.80 / 7 = 0.543, LOC_05's 6.02 / 7 = 0.86; the median of 56 staff counts is 12
            filled = {"LOC_07": 0.54, "LOC_05": 0.86}[loc] if rate is None else rate
            assert (r["region"], r["staff_count"], r["sla_achievement_rate"]) == (region, 12.0 if staff is None else staff, filled)
            assert (r["sla_imputed"], r["staff_imputed"]) == (rate is None, staff is None)
            assert (r["inventory_level"], r["ticket_volume_handled"]) == (0.5, 100 + i)


def test_operations_status(raw):
    status = {r["sla_status"]: r["count"] for r in CL.clean_operations(raw).groupBy("sla_status").count().collect()}
    assert status == {"Compliant": 48, "At Risk": 11, "Critical": 5}


def test_locations_below_70(spark, raw):
    rows = sorted(map(tuple, q1_3_locations_below_70(Tables.from_frames(spark, operations=raw)).collect()))
    assert rows == [("LOC_03", "Germany", 8, 49.8, 42.0, 4), ("LOC_07", "Germany", 8, 54.3, 49.0, 1)]


def test_trend_keeps_all_rows_in_order(spark, raw):
    got = q1_2_sla_trend(Tables.from_frames(spark, operations=raw))
    keys = [(r["location_id"], r["quarter"]) for r in got.collect()]
    assert keys == sorted(keys) and len(keys) == 64
    assert got.where(F.col("location_id") == "LOC_06").agg(F.max("sla_achievement_pct")).first()[0] == 88.0
