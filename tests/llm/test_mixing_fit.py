"""The mixing classifier is fitted in tasks, from words hashed once."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from svcops.llm import mixing as M
from svcops.llm.softmax import quasi_newton
from tests.llm.helpers import documents
from tests.llm.test_mixing import corpus, labelled


def training(spark, rows):
    return spark.createDataFrame(rows, "label string, buckets array<int>").repartition(3)


def test_gradient_is_the_sum_over_all_rows(spark):
    rng = np.random.default_rng(5)
    rows = [("abc"[i % 3], sorted(rng.choice(M.BUCKETS, rng.integers(0, 9), replace=False).tolist())) for i in range(60)]
    w, b, share = rng.normal(size=(M.BUCKETS, 3)), rng.normal(size=3), [0.1, 0.2, 0.3]
    value, g, own = M._gradient(training(spark, rows), w, b, share, ["a", "b", "c"])
    want, want_g, want_own = 0.0, np.zeros_like(w), np.zeros(3)
    for label, at in rows:
        x = np.zeros(M.BUCKETS)
        x[at] = len(at) ** -0.5 if at else 0
        e, y = np.exp(x @ w + b), "abc".index(label)
        want -= share[y] * np.log(e[y] / e.sum())
        r = share[y] * (e / e.sum() - np.eye(3)[y])
        want_g, want_own = want_g + np.outer(x, r), want_own + r
    assert np.isclose(value, want) and np.allclose(g, want_g) and np.allclose(own, want_own)


def test_quasi_newton_finds_the_lasso():
    """Against plain proximal gradient."""
    rng = np.random.default_rng(6)
    a, y, l1 = rng.normal(size=(80, 20)), rng.normal(size=80), np.full(20, 12.0)
    l1[0] = 0
    got = quasi_newton(lambda x: (((a @ x - y) ** 2).sum() / 2, a.T @ (a @ x - y)), np.zeros(20), l1, 200, tolerance=1e-12)
    x, step = np.zeros(20), 1 / np.linalg.norm(a, 2) ** 2
    for _ in range(5000):
        x = x - step * (a.T @ (a @ x - y))
        x = np.sign(x) * np.maximum(np.abs(x) - step * l1, 0)
    assert np.allclose(got, x, atol=1e-5) and 0 < (got == 0).sum() < 19


@pytest.mark.parametrize("extra", ["", None, " \n"])
def test_labelled_texts_without_words(spark, extra):
    rows, labels = corpus(random.Random(21), 90)
    docs = documents(spark, [*rows, (901, extra), (903, extra), (905, extra), (907, extra)])
    out, _ = M.mixed_rates(docs, labelled(spark, [*labels, *((i, int(i % 4 == 1), 0) for i in (901, 903, 905, 907))]))
    assert out.count() == 94 and out.where(F.isnan("p_good") | F.isnan("rate")).isEmpty()


def test_each_text_is_hashed_once(spark, monkeypatch):
    made = []
    hashed_words = M.hashed_words
    monkeypatch.setattr(M, "hashed_words", lambda *a: made.append(1) or hashed_words(*a))
    rows, labels = corpus(random.Random(22), 60)
    M.mixed_rates(documents(spark, rows), labelled(spark, labels))
    assert len(made) == 1
