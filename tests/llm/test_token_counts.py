import random

import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from svcops.llm import token_counts as T
from svcops.llm.queries import TOKENIZER
from tests.llm.helpers import awkward, clashing, documents


def exact(vocabulary, byte_fallback):
    out = tokenizers.Tokenizer(tokenizers.models.Unigram(vocabulary, unk_id=0, byte_fallback=byte_fallback))
    out.pre_tokenizer = tokenizers.pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return lambda t: len(out.encode(t, add_special_tokens=False).ids)


VOCABULARY = T.read_vocabulary(TOKENIZER)
LARGE, LARGE_EXACT = T.Counter(VOCABULARY), exact(VOCABULARY, True)
TIES = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("aab", -3.0), ("▁a", -2.0), ("ba", -2.0), ("bab", -2.5)]
SMALL, SMALL_EXACT = T.Counter(TIES), exact(TIES, False)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab the\n▁éß😀\t梦<0x>unk/s", max_size=60))
def test_large_vocabulary(text):
    assert LARGE.text(text) == LARGE_EXACT(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aabb xy\n▁", max_size=40))
def test_ties_and_fused_unknowns(text):
    assert SMALL.text(text) == SMALL_EXACT(text)


def test_cache_may_overflow(monkeypatch):
    monkeypatch.setattr(T, "CACHE", 3)
    counter = T.Counter(VOCABULARY)
    text = "one two three four five six seven one two\nthree"
    assert counter.text(text) == LARGE_EXACT(text) and len(counter.first) <= 3


def test_whole_table(spark):
    rows = awkward(random.Random(11))
    got = sorted(map(tuple, T.token_counts(clashing(documents(spark, rows)), VOCABULARY).collect()), key=str)
    want = [(i, LARGE_EXACT(t) if t else 0, len((t or "").encode().split()), len(t or "")) for i, t in rows]
    assert got == sorted(want, key=str)
    assert T.token_counts(documents(spark, []), VOCABULARY).count() == 0


@pytest.mark.parametrize("vocabulary", [[], [("a", -1.0)]])
def test_poor_vocabularies(vocabulary):
    counter = T.Counter(vocabulary)
    assert counter.text("") == counter.text(None) == 0 and counter.text("zz") == 1
