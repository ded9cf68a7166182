import hashlib
import random

import numpy as np
import pytest

from svcops.llm import repeats as R
from svcops.llm.run_index import RunIndex
from tests.llm.helpers import awkward, clashing, documents, prose


def brute(rows, length=50):
    last, first = 1 << 62, {}
    texts = [(last if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        for p in range(len(b) - length + 1):
            first[b[p: p + length]] = min(first.get(b[p: p + length], last), i)
    out = []
    for (i, b), (own, _) in zip(texts, rows):
        gone = np.zeros(len(b) + 1, int)
        for p in range(len(b) - length + 1):
            if first[b[p: p + length]] < i:
                gone[p] += 1
                gone[p + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        spans = int((gone[1:] & ~gone[:-1]).sum()) + bool(len(gone) and gone[0])
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((own, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def repetitive(rng, n=120):
    """Texts made of shared passages, cut and edited, some of a single letter."""
    pool = [prose(rng, rng.randrange(5, 40)) for _ in range(12)] + ["é" * 70, "ab" * 60, "x" * 130]
    rows = []
    for i in rng.sample(range(10 * n), n):
        parts = []
        for _ in range(rng.randrange(0, 6)):
            t = rng.choice(pool)
            a = rng.randrange(len(t))
            t = t[a:] if rng.random() < 0.4 else t
            if rng.random() < 0.4 and t:
                k = rng.randrange(len(t))
                t = t[:k] + "#" + t[k + 1:]
            parts.append(t if rng.random() < 0.8 else prose(rng, 20))
        rows.append((i, " ".join(parts)))
    return rows


def removed(docs, **more):
    got = R.remove_repeats(docs, **more)
    return sorted((tuple(r)[:5] for r in got.collect()), key=str)


@pytest.mark.parametrize("hot", [R.HOT, 3])
@pytest.mark.parametrize("size", [R.BLOCK_BYTES, 4000])
def test_equals_brute_force(spark, monkeypatch, hot, size):
    """One block or many; all contexts through the index, or hot anchors by windows."""
    monkeypatch.setattr(R, "HOT", hot)
    rows = repetitive(random.Random(13))
    want = brute(rows)
    assert sum(r[2] > 0 for r in want) > 50
    assert removed(clashing(documents(spark, rows)), block_bytes=size, bucket_bytes=2 * size) == want


def test_awkward_rows(spark):
    rng = random.Random(14)
    rows = awkward(rng)
    rows = [(i, t if t is None or len(t) < 5000 else t[:3000]) for i, t in rows] + [(20, "x" * 49), (21, "x" * 50), (0, "x" * 50 + "y")]
    assert removed(documents(spark, rows)) == brute(rows)
    assert removed(documents(spark, [])) == [] and removed(documents(spark, [(1, None)])) == brute([(1, None)])


def test_text_longer_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(R, "PIECE", 500)
    rng = random.Random(15)
    long = prose(rng, 1500)
    rows = [(1, long), (2, prose(rng, 30) + long[2000:5000] + prose(rng, 10)), (3, long[:60])]
    assert removed(documents(spark, rows), block_bytes=1000, bucket_bytes=1000) == brute(rows)


def test_remaining_bytes(spark):
    rng = random.Random(16)
    t = prose(rng, 30)
    got = {r["doc_id"]: bytes(r["kept"]) for r in R.remove_repeats(documents(spark, [(1, t), (2, "a " + t + " b")]), with_text=True).collect()}
    assert got == {1: t.encode(), 2: b"a  b"}


def test_run_index_equals_brute_force():
    rng = random.Random(17)
    for _ in range(60):
        depth, letters = rng.choice([1, 2, 3, 5, 8, 20]), bytes(rng.sample(range(256), rng.choice([1, 2, 3, 40, 200])))
        pool = [bytes(rng.choice(letters) for _ in range(depth + rng.randrange(25))) for _ in range(rng.randrange(1, 6))]
        texts = []
        for _ in range(rng.randrange(1, 40)):
            t = rng.choice(pool)
            a = rng.randrange(len(t) - depth + 1)
            texts.append(t[a: a + depth + rng.randrange(25)] + (bytes([rng.choice(letters)]) if rng.random() < 0.3 else b""))
        owner, first = [rng.randrange(12) for _ in texts], {}
        for t, o in zip(texts, owner):
            for j in range(len(t) - depth + 1):
                first[t[j: j + depth]] = min(first.get(t[j: j + depth], 99), o)
        want = [sum(1 << j for j in range(len(t) - depth + 1) if first[t[j: j + depth]] < o) for t, o in zip(texts, owner)]
        off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        assert RunIndex(np.frombuffer(b"".join(texts), np.uint8), off, np.array(owner), depth).marks().tolist() == want
