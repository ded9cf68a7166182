import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from svcops.llm import grouping as G
from svcops.llm import packing as P
from svcops.llm.queries import BYTE_TOKENIZER
from svcops.llm.tokens import SETTLED, ByteTokens
from tests.llm.helpers import awkward, clashing, documents, prose


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE_TOKENIZER)


def test_ids_are_the_librarys(library):
    rng = random.Random(1)
    letters = [*" \t\n\r.,;:!?'sabzéÀ×÷ \u0085　​中😀١5²ªº<|>_\x1c­-", "'s", "<|endoftext|>", " the", "n't"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(20))) for _ in range(3000)] + ["x" * 9000, "ab" * 9000, " \n" * 900]
    for plain in (False, True):
        library.encode_special_tokens = plain
        model = ByteTokens(BYTE_TOKENIZER, plain)
        assert model.fast is not None
        for t in texts:
            assert model.ids(t).tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_settled_characters_have_the_same_classes(library):
    import re

    own = re.compile(f"[{SETTLED}]")
    model = ByteTokens(BYTE_TOKENIZER, True)
    library.encode_special_tokens = True
    for c in (chr(i) for i in range(0x10000) if not 0xD800 <= i < 0xE000):
        if own.match(c):
            text = f"a{c}b {c}1{c} {c}."
            assert model.fast.encode_ordinary(text) == library.encode(text, add_special_tokens=False).ids, hex(ord(c))


def check(rows, docs, library, capacity=P.CAPACITY):
    """Pieces are the documents, cut as stated; sequences are full of them without gaps."""
    library.encode_special_tokens = False
    want = Counter()
    for doc, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids + [P.END_ID]
        n = -(-len(ids) // capacity)
        ends = [len(ids) - (n - 1 - k) * capacity for k in range(n)]
        for k, (a, b) in enumerate(zip([0, *ends[:-1]], ends)):
            want[doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_pieces_and_places(spark, library):
    rng = random.Random(2)
    docs = awkward(rng) + [(100 + i, prose(rng, rng.randrange(0, 400))) for i in range(150)]
    rows = P.pack(clashing(documents(spark, docs)), BYTE_TOKENIZER).collect()
    used = check(rows, docs, library)
    assert used <= 1.01 * sum(r["length"] for r in rows) / P.CAPACITY + 1


def test_small_capacity_hot_lengths_and_groups(spark, library, monkeypatch):
    """A third of the rows have no text; ranks are counted in many groups."""
    rng = random.Random(3)
    docs = [(None if i % 3 == 0 else i, None if i % 3 == 0 else prose(rng, rng.randrange(0, 30))) for i in range(600)]
    monkeypatch.setattr(P.ranked, "__defaults__", (16,))
    rows = P.pack(documents(spark, docs).repartition(7), BYTE_TOKENIZER, capacity=32).collect()
    check(rows, docs, library, 32)


def test_empty_table(spark):
    assert P.pack(documents(spark, []), BYTE_TOKENIZER).count() == 0


def fewest(items, capacity):
    """Brute force: fewest bins for a few items."""
    best = len(items)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= items[i] and rooms[k] not in rooms[:k]:
                go(i + 1, rooms[:k] + [rooms[k] - items[i]] + rooms[k + 1:])
        go(i + 1, [*rooms, capacity - items[i]])

    items = sorted(items, reverse=True)
    go(0, [])
    return best


def test_genetic_algorithm_equals_brute_force(spark):
    rng = random.Random(4)
    for capacity in (10, 20, 30):
        items = [rng.randrange(1, capacity * 2 // 3) for _ in range(12)]
        bins = G.packed(spark, dict(Counter(items)), capacity, islands=2, epochs=2)
        assert G.contents(bins) == Counter(items) and max(map(sum, bins)) <= capacity
        assert sum(bins.values()) == fewest(items, capacity)


@pytest.mark.parametrize("seed", range(6))
def test_steps_keep_all_documents(seed):
    rng = random.Random(seed)
    items = Counter({rng.randrange(1, 101): rng.randrange(1, 10 ** rng.randrange(1, 6)) for _ in range(40)})
    a, b = (G.best_fit({}, items, 100, G.disturbed(rng)) for _ in range(2))
    for _ in range(20):
        a, b = G.crossover(a, b, 100, rng), G.mutation(a, 100, rng)
        for g in (a, b):
            assert G.contents(g) == items and max(map(sum, g)) <= 100 and min(g.values()) > 0
    best = G.evolve([a, b], 100, 0, rng)
    assert all(G.contents(g) == items for g in best) and G.cost(best[0]) <= min(G.cost(a), G.cost(b))


def test_many_documents_are_few_kinds(spark):
    """A billion documents of 1,000 lengths: the genome has some thousand entries."""
    rng = random.Random(5)
    counts = {size: rng.randrange(10 ** 6) for size in range(1, 1001)}
    bins = G.packed(spark, counts, 1024, islands=2, epochs=1)
    assert G.contents(bins) == Counter(counts) and len(bins) < 10_000
    assert sum(bins.values()) <= 1.01 * sum(s * n for s, n in counts.items()) / 1024


def test_crossover_beats_or_equals_best_fit(spark):
    rng = random.Random(7)
    items = Counter(rng.randrange(150, 520) for _ in range(400))
    plain = sum(G.best_fit({}, items, 1024).values())
    assert sum(G.packed(spark, dict(items), 1024, islands=4, epochs=3).values()) < plain
