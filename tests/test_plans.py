"""Plan properties that the scale design relies on."""

import pytest

from svcops.operators.dashboard import dash_kpis
from svcops.operators.experience import _risk_profile, cx_match_coverage
from svcops.plans.registry import queries
from svcops.sources.catalog import Tables

PLAN_KEYS = sorted(k for k in queries() if not k.startswith(("src_", "sink_")))


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", PLAN_KEYS)
def test_no_pairing_joins(spark, sf_dir, key):
    plan = _plan(queries()[key](spark, sf_dir))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


#: Hash exchanges of a report when no side is small enough to broadcast.
EXCHANGES = {"cx_risk_profile": 0, "q1_1_breach_by_location": 1, "q2_2_top20_customers": 3, "q2_4_channel_clv": 1,
             "q4_3_repeat_bands": 3, "weekly_breach": 1}


@pytest.mark.parametrize("key", sorted(EXCHANGES))
def test_exchanges(spark, sf_dir, no_broadcast, key):
    plan = _plan(queries()[key](spark, sf_dir))
    assert plan.count("Exchange hashpartitioning") <= EXCHANGES[key]


def test_lines_are_summed_before_they_meet_a_key(spark, sf_dir, no_broadcast):
    """Every exchange below a join on customers carries sums, made map-side."""
    T = Tables(spark, sf_dir)
    for df in (_risk_profile(T), dash_kpis(T, segment="Corporate", location="LOC_01"), cx_match_coverage(T)):
        lines = _plan(df).splitlines()
        for i, line in enumerate(lines):
            if "Exchange hashpartitioning(customer_id" in line:
                below = [x for x in lines[i + 1: i + 6] if "InputAdapter" not in x]
                if "partial_" not in below[0] and "functions=[]" not in below[0]:  # a side of customers
                    assert not any("orders.parquet" in x or "stage-transactions" in x for x in below), below


def test_guests_stay_out_of_the_filtered_dashboard(spark, sf_dir):
    plan = _plan(dash_kpis(Tables(spark, sf_dir), segment="Corporate"))
    assert "NOT (customer_id" in plan and "GUEST" in plan


def test_no_percentile_buffers(spark, sf_dir):
    for key in ("cl_c_medians", "cl_c_clv", "prof_describe"):
        plan = _plan(queries()[key](spark, sf_dir)).lower()
        assert "percentile" not in plan and "median(" not in plan


def test_no_forced_broadcast_of_locations(spark, sf_dir, no_broadcast):
    plan = _plan(queries()["q3_2_location_exposure"](spark, sf_dir))
    assert "BroadcastExchange" not in plan


def test_year_reports_prune_partitions(spark, sf_dir):
    p = _plan(queries()["q3_4_quarter_share"](spark, sf_dir))
    part = p[p.index("PartitionFilters: ["):]
    assert "invoice_year" in part[:part.index("]")]
    pushed = p[p.index("PushedFilters: ["):]
    assert pushed[len("PushedFilters: ["):].startswith("Or(And(GreaterThanOrEqual(invoice_date")
