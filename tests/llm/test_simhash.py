import random

import numpy as np
import pytest
import xxhash

from svcops.llm import simhash as S
from svcops.llm.components import components
from tests.llm.helpers import awkward, clashing, documents, prose


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i: i + 3]) for i in range(max(len(words) - 2, 1))]
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(nodes, linked):
    """Smallest reachable node of each, by plain union-find."""
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


def brute(rows):
    fp = {i: slow_fingerprint(t) for i, t in rows}
    ids = sorted(fp)
    links = [(a, b) for a in ids for b in ids if a < b and bin(fp[a] ^ fp[b]).count("1") <= 3]
    root = grouped(ids, links)
    return sorted((i, f"{fp[i]:016x}", root[i]) for i in ids)


def near_copies(rng, n):
    base = prose(rng, 400).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(len(w))] = prose(rng, 1)
        out.append(" ".join(w))
    return out


def test_every_pair_within_the_radius_collides():
    masks = [m & (2**64 - 1) for m in S.covering_masks(3)]
    assert len(masks) == 15
    rng = random.Random(4)
    for _ in range(5000):
        bits = rng.sample(range(64), rng.randrange(0, 4))
        assert any(not m & sum(1 << b for b in bits) for m in masks)


def test_fingerprints_equal_spark_hash(spark):
    from pyspark.sql import functions as F
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] & (2**64 - 1) == xxhash.xxh64(b"a b c", seed=42).intdigest()


@pytest.mark.parametrize("cell", [S.CELL, 4])
def test_equals_brute_force(spark, cell):
    rng = random.Random(5)
    rows = [(i, t) for i, t in enumerate(near_copies(rng, 60) + near_copies(rng, 5) + [prose(rng, 30) for _ in range(30)])]
    rows += [(1000 + i, t) for i, t in awkward(rng) if i is not None and i != 7 and i != 10]
    got = S.near_duplicates(clashing(documents(spark, rows)), cell=cell).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_large_cells_keep_the_connection():
    rng = np.random.default_rng(3)
    fp = np.unique(np.array([sum(1 << int(b) for b in rng.choice(12, 3)) for _ in range(300)], np.uint64))
    a, b = S._links(fp, np.zeros(len(fp), int), 3)
    plain = [(int(x), int(y)) for i, x in enumerate(fp) for y in fp[i + 1:] if bin(int(x ^ y)).count("1") <= 3]
    assert grouped(fp.tolist(), plain) == grouped(fp.tolist(), list(zip(a.tolist(), b.tolist())))


def test_stage(spark):
    rng = random.Random(6)
    rows = list(enumerate(near_copies(rng, 20) + [prose(rng, 50) for _ in range(10)]))
    docs = clashing(documents(spark, rows))
    out = S.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == sorted({x[2] for x in brute(rows)})


def test_nulls_repeats_and_empty_table(spark):
    docs = documents(spark, [(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (4, None), (5, "")])
    got = sorted(((r["doc_id"], r["component_id"]) for r in S.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, 3), (3, 3), (3, 3), (4, 4), (5, 4)], key=str)
    assert S.near_duplicates(documents(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(400 + i, 401 + i) for i in range(60)] + [(5, None)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in components(df, "a", "b").collect()}
    plain = [e for e in edges if e[1] is not None]
    want = {n: r for n, r in grouped({x for e in plain for x in e}, plain).items() if n != r}
    assert got == want
