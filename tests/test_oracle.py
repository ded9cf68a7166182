"""Every registered query against its DuckDB oracle on the driver data."""

import pytest

from svcops.plans import check
from svcops.plans.registry import oracle_sql, queries

KEYS = sorted(queries())


@pytest.fixture(scope="module")
def con(sf_dir):
    return check.duckdb_connection(sf_dir)


def test_every_key_has_an_oracle():
    assert set(oracle_sql()) == set(queries())


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, sf_dir, con, key):
    r = check.compare_one(spark, con, sf_dir, key, queries()[key], oracle_sql()[key])
    assert r["status"] == "ok", r
