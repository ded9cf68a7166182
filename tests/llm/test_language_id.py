import random
import zlib

import numpy as np

from svcops.llm import language_id as L
from svcops.llm.common import read
from tests.llm.helpers import clashing, documents

SF = "/root/testdata/sf0.01"


def corpus(rng):
    words = {"en": ["the", "thing", "with", "tion"], "fr": ["eau", "était", "que", "où"], "de": ["sch", "über", "und", "heit"]}
    return [(i, " ".join(rng.choice(words[x]) for _ in range(rng.randrange(3, 20))) + rng.choice([".", "!!", " 12"]), x)
            for i, x in enumerate(rng.choices(sorted(words), k=200))]


def slow_grams(text):
    low = "".join(c if c.isalpha() else " " for c in text.lower())
    low = " " + " ".join(low.split()) + " " if low.strip() else ""
    out = []
    for n in L.ORDERS:
        for k in range(len(low) - n + 1):
            g = low[k: k + n]
            if g.strip():
                out.append((n, g))
    return out


def test_grams_equal_plain_ones():
    texts = ["Hé, Ça va?", "", "  a1b  ", "İx", "12", "x"]
    bucket, off = L.grams(texts)
    for t, a, b in zip(texts, off[:-1], off[1:]):
        plain = slow_grams(t)
        assert len(plain) == b - a and len(set(plain)) == len(set(bucket[a:b].tolist()))
    one, _ = L.grams(["abc abc"])
    again, _ = L.grams(["zzz", "abc abc"])
    assert sorted(one.tolist()) == sorted(again[-len(one):].tolist())


def test_equals_plain_naive_bayes(spark):
    rows = corpus(random.Random(2))
    got = {r["doc_id"]: r for r in L.identify(clashing(documents(spark, rows))).collect()}
    learn = [(t, x) for i, t, x in rows if zlib.crc32(str(i).encode()) % 5]
    langs = sorted({x for _, x in learn})
    count = {x: np.ones(L.BUCKETS) for x in langs}
    for t, x in learn:
        np.add.at(count[x], L.grams([t])[0], 1)
    prior = {x: np.log(sum(y == x for _, y in learn) / len(learn)) for x in langs}
    for i, t, _ in rows:
        z = np.array([np.log(count[x] / count[x].sum())[L.grams([t])[0]].sum() + prior[x] for x in langs])
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got[i]["lang_pred"] == langs[int(p.argmax())] and abs(got[i]["score"] - p.max()) < 1e-3
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_held_out_accuracy(spark):
    docs = read(spark, SF, "documents")
    got = L.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 100 and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)


def test_awkward_rows(spark):
    rows = corpus(random.Random(2)) + [(900, None, "en"), (901, "", "fr"), (902, "12 !!", "de"), (None, "the thing", "xx"), (903, "the", None)]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.identify(documents(spark, rows)).collect()}
    assert [got[k] for k in (900, 901, 902)] == [("und", 0.0)] * 3
    assert got[None][0] in ("de", "en", "fr") and got[903][0] == "en"
    docs = clashing(documents(spark, rows))
    kept = L.accepted(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in kept.collect()} == {900, 901, 902}


def test_nothing_to_learn(spark):
    got = L.identify(documents(spark, [(1, "abc"), (2, None)])).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)] * 2
    assert L.identify(documents(spark, [])).count() == 0
