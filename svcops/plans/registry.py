"""Registry: query key -> job, and key -> DuckDB oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from svcops.plans import oracle_clean, oracle_explore, oracle_misc, oracle_reports
from svcops.plans import oracle_sql as oracle_sqlset
from svcops.plans.oracle_prelude import oracle
from svcops.sources.catalog import Tables

JobFn = Callable[[Tables], DataFrame]


def _jobs() -> dict[str, JobFn]:
    from svcops.operators import (clean, cube, dashboard, experience, exploratory, implications,
                                  market, profiling, quality, service_queries)
    from svcops.sources import io
    jobs: dict[str, JobFn] = {}
    for module in (io, profiling, clean, quality, service_queries, experience, implications,
                   exploratory, market, dashboard, cube):
        jobs.update(module.QUERIES)
    return jobs


def _oracles() -> dict[str, str]:
    texts: dict[str, str] = {}
    for module in (oracle_clean, oracle_sqlset, oracle_reports, oracle_explore, oracle_misc):
        texts.update(module.SQL)
    return texts


def _bind(fn: JobFn) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(Tables(spark, sf_dir))
    run.__name__ = getattr(fn, "__name__", "job")
    run.__doc__ = fn.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _bind(f) for k, f in _jobs().items()}


def oracle_sql() -> dict[str, str]:
    jobs = _jobs()
    return {k: oracle(v) for k, v in _oracles().items() if k in jobs}
