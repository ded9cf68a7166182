import random

import numpy as np
import pytest

from svcops.llm import decontaminate as D
from tests.llm.helpers import clashing, documents, prose


def distance(pattern, text):
    """Fewest edits of the pattern against any stretch of the text."""
    row = np.zeros(len(text) + 1, int)
    for i, c in enumerate(pattern, 1):
        new = np.empty_like(row)
        new[0] = i
        for j, t in enumerate(text, 1):
            new[j] = min(row[j - 1] + (c != t), row[j] + 1, new[j - 1] + 1)
        row = new
    return row.min()


def edited(rng, text, n):
    text = list(text)
    for _ in range(n):
        k = rng.randrange(len(text))
        text[k: k + 1] = rng.choice([["#"], [], [text[k], "~"]])
    return "".join(text)


def bench(spark, items):
    return spark.createDataFrame(items, "item_id bigint, text string")


def test_equals_brute_force(spark):
    rng = random.Random(8)
    items = [(k, prose(rng, n)) for k, n in enumerate((3, 9, 12, 30))]
    docs = []
    for i in range(40):
        text = prose(rng, rng.randrange(0, 25))
        for k, item in rng.sample(items, rng.randrange(0, 3)):
            a = rng.randrange(0, len(item) // 2)
            text += " " + edited(rng, item[a:] if rng.random() < 0.3 else item, rng.randrange(0, 8)) + " " + prose(rng, 5)
        docs.append((i, text))
    got = {(r["doc_id"], r["item_id"]) for r in D.leaks(documents(spark, docs), bench(spark, items)).collect()}
    want = set()
    for k, item in items:
        p = D.plain(item)
        last = max(len(p) - D.SEGMENT, 0)
        for a in {*range(0, last, D.STRIDE), last}:
            s = p[a: a + D.SEGMENT]
            if len(s) >= D.Q:
                want |= {(i, k) for i, t in docs if distance(s, D.plain(t)) <= D.budget(len(s), D.Q, D.ERROR_SHARE)}
    assert got == want and len(want) > 10


def test_planted_and_clean(spark):
    rng = random.Random(9)
    items = [(k, prose(rng, 40)) for k in range(10)]
    item = items[3][1]
    half = item[: len(item) // 2 + 40]
    docs = [(1, prose(rng, 100) + item + prose(rng, 100)), (2, item.upper().replace(" ", "\n  ")), (3, prose(rng, 30) + " " + half),
            (4, edited(rng, item, 4)), (5, prose(rng, 500)), (6, None), (7, ""), (8, item[:40]), (None, item), (1, item)]
    got = D.leaks(clashing(documents(spark, docs)), bench(spark, items)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(map(str, [1, 1, 2, 3, 4, None])) and {r["item_id"] for r in got} == {3}
    exact = next(r for r in got if r["doc_id"] == 2)
    assert exact["edits"] == 0 and exact["n_found"] == exact["n_segments"]
    kept = D.drop_leaks(clashing(documents(spark, docs)), bench(spark, items))
    assert sorted(r["doc_id"] for r in kept.collect()) == [5, 6, 7, 8]


@pytest.mark.parametrize("items", [[], [(1, None), (2, ""), (3, "short")]])
def test_nothing_to_find(spark, items):
    docs = documents(spark, [(1, "short text"), (2, None)])
    assert D.leaks(docs, bench(spark, items)).count() == 0 and D.drop_leaks(docs, bench(spark, items)).count() == 2
    assert D.leaks(documents(spark, []), bench(spark, [(1, "x" * 100)])).count() == 0


def test_blocks_find_the_same(spark, monkeypatch):
    rng = random.Random(10)
    items = [(k, prose(rng, 30)) for k in range(12)]
    docs = documents(spark, [(k, prose(rng, 20) + t) for k, t in items])
    whole = sorted(map(tuple, D.leaks(docs, bench(spark, items)).collect()))
    monkeypatch.setattr(D.blocks, "__defaults__", ("item_id", "text", 500))
    assert len(D.blocks(bench(spark, items))) > 3
    assert sorted(map(tuple, D.leaks(docs, bench(spark, items)).collect())) == whole and len(whole) == 12
