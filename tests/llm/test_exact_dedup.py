import hashlib
import random
import re

from svcops.llm import exact_dedup as X
from tests.llm.helpers import awkward, clashing, documents


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    out = []
    for (i, _), n in zip(rows, norm):
        ids = [k for (k, _), m in zip(rows, norm) if m == n]
        known = [k for k in ids if k is not None]
        keep = min(known) if known else None
        keep = keep if len(ids) > 1 else i
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    rows = awkward(random.Random(1))
    got = X.exact_groups(clashing(documents(spark, rows))).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_equal_prefix_and_length_are_told_apart(spark):
    rows = [(1, "a" * 400 + "b"), (2, "a" * 400 + "c"), (3, "a" * 400 + "b")]
    got = {r["doc_id"]: r["keep_id"] for r in X.exact_groups(documents(spark, rows)).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_stage_keeps_columns_and_first_rows(spark):
    docs = clashing(documents(spark, awkward(random.Random(1))))
    out = X.exact_dedup(docs)
    assert out.columns == docs.columns
    kept = {r["doc_id"] for r in out.collect()}
    assert {1, 3, 7} <= kept and not kept & {2, 4, 6, 12, None}


def test_empty_table(spark):
    docs = documents(spark, [])
    assert X.exact_groups(docs).count() == 0 and X.exact_dedup(docs).count() == 0


def test_no_python_on_the_path(spark):
    plan = X.exact_groups(documents(spark, [(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
