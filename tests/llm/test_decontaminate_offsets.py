import random

import pytest

from svcops.llm import decontaminate as D
from tests.llm.helpers import documents, prose
from tests.llm.test_decontaminate import bench, distance, edited


@pytest.mark.parametrize("size", [64, 70, 80])
def test_excerpts_at_every_offset(spark, size):
    rng = random.Random(11)
    item = D.plain(prose(rng, 45))[:233]
    docs = [(a, "#" * 20 + item[a: a + size] + "#" * 20) for a in range(len(item) - size + 1)]
    docs += [(1000 + a, "#" * 20 + item[a: a + 50] + "#" * 20) for a in range(0, 180, 9)]
    got = {r["doc_id"]: r for r in D.leaks(documents(spark, docs), bench(spark, [(1, item), (2, prose(rng, 40))])).collect()}
    assert sorted(got) == list(range(len(item) - size + 1))
    assert all(r["n_segments"] == len(item) - 63 and r["item_id"] == 1 for r in got.values())
    kept = D.drop_leaks(documents(spark, docs), bench(spark, [(1, item)])).collect()
    assert all(r["doc_id"] >= 1000 for r in kept) and len(kept) == 20


def test_edited_excerpts_equal_brute_force(spark):
    """Every window of 64 characters, without the module's step."""
    rng = random.Random(12)
    items = [(k, D.plain(prose(rng, 24))[:120]) for k in range(2)]
    docs = []
    for i in range(40):
        _, item = items[i % 2]
        a = rng.randrange(0, len(item) - 64)
        docs.append((i, prose(rng, 4) + " " + edited(rng, item[a: a + rng.randrange(64, 80)], rng.randrange(0, 9)) + " " + prose(rng, 4)))
    want = {}
    for i, t in docs:
        for k, item in items:
            n = [x for a in range(len(item) - 63) if (x := distance(item[a: a + 64], D.plain(t))) <= 5]
            if n:
                want[i, k] = (len(n), sum(n))
    got = {(r["doc_id"], r["item_id"]): (r["n_found"], r["edits"]) for r in D.leaks(documents(spark, docs), bench(spark, items)).collect()}
    assert got == want and 10 < len(want) < 40
