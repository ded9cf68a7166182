"""What keeps the removal of repeats in proportion to its input."""

import random

import numpy as np
import pyarrow as pa
import pytest

from svcops.llm import repeats as R
from tests.llm.helpers import documents, prose
from tests.llm.test_repeats import brute, removed, repetitive


def test_every_bucket_answers_once(spark):
    """No round asks or answers anew what a round before it has dealt out."""
    rows = repetitive(random.Random(21), 40)
    got = R.remove_repeats(documents(spark, rows))
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert [plan.count(f"{name}(") for name in ("_tell_keys", "_tell_contexts", "_tell_marks")] == [1, 1, 1]


def test_open_contexts_are_sent_without_anchors(monkeypatch):
    """The buckets name the places of open contexts, so their bytes need no new search for anchors."""
    rng = random.Random(22)
    stem = prose(rng, 30)[:80]
    texts = [(i, stem + prose(rng, 5)) for i in range(4)]
    table = pa.table({"block": pa.array([0] * 4, pa.int32()), "id": [i for i, _ in texts], "size": pa.array([len(t) for _, t in texts], pa.int32()),
                      "text": [t for _, t in texts]})
    keys = R._tell_keys(R._ask_keys(1)(table))
    contexts = R._tell_contexts(R._ask_contexts(1)(table, keys))
    monkeypatch.setattr(R, "anchors", lambda *_: pytest.fail("anchors once more"))
    asked = R._ask_marks(1)(table, contexts)
    sizes = np.frombuffer(asked.column("a")[0].as_py(), np.uint8)
    data = asked.column("c")[0].as_py()
    assert len(sizes) > 4 and len(data) == int(sizes.sum())
    off = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    whole = [t.encode() for _, t in texts]
    assert all(any(data[a:b] in t for t in whole) for a, b in zip(off[:-1].tolist(), off[1:].tolist()))


def test_index_with_anchors_as_digits():
    """Equal windows of contexts that share a bucket, whatever their anchors; over 64 anchors need two digits."""
    rng = random.Random(23)
    for kinds, letters in ((3, b"ab"), (150, b"abc\xff\xc3"), (5, bytes(range(256)))):
        pool = [bytes(rng.choice(letters) for _ in range(R.K)) for _ in range(kinds)]
        sides = [bytes(rng.choice(letters) for _ in range(18)) for _ in range(4)]
        texts, left = [], []
        for _ in range(400):
            before, after = rng.choice(sides)[rng.randrange(19):], rng.choice(sides)[: rng.randrange(19)]
            if len(before) + len(after) < R.LENGTH - R.K:
                before = rng.choice(sides)
            left.append(len(before))
            texts.append(before + rng.choice(pool) + after)
        owner, first = [rng.randrange(40) for _ in texts], {}

        def windows(t, at):
            return [(t[j: j + R.LENGTH], at - j) for j in range(len(t) - R.LENGTH + 1)]

        for t, at, o in zip(texts, left, owner):
            for w in windows(t, at):
                first[w] = min(first.get(w, 99), o)
        want = [sum(1 << j for j, w in enumerate(windows(t, at)) if first[w] < o) for t, at, o in zip(texts, left, owner)]
        index = R._index(np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts]), np.array(left), np.array(owner))
        assert index.marks().tolist() == want
        assert any(want) and len(index.run) < sum(map(len, texts))


def test_neighbouring_texts(spark):
    """What goes at the end of one text and at the beginning of the next are two spans."""
    rng = random.Random(24)
    a, b = prose(rng, 20), prose(rng, 20)
    rows = [(1, a + b), (2, prose(rng, 20) + a), (3, b + prose(rng, 20)), (4, a), (5, b), (6, ""), (7, a[:60])]
    assert removed(documents(spark, rows)) == brute(rows)


@pytest.mark.parametrize("piece", [60, 100, 1000])
def test_pieces_share_windows(spark, monkeypatch, piece):
    monkeypatch.setattr(R, "PIECE", piece)
    rng = random.Random(piece)
    texts = [prose(rng, 60), "ab" * 200, "x" * 300]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    place, grams = R.anchors(raw, off)
    monkeypatch.setattr(R, "PIECE", 1 << 20)
    want, whole = R.anchors(raw, off)
    assert place.tolist() == want.tolist() and (grams[place] == whole[place]).all()
    assert all(((place >= s) & (place <= s + R.LENGTH - R.K)).any() for a, b in zip(off[:-1], off[1:]) for s in range(a, b - R.LENGTH + 1))
