import random
import zlib

import numpy as np

from svcops.llm import quality_rules as Q
from svcops.llm.common import read
from tests.llm.helpers import awkward, clashing, documents

SF = "/root/testdata/sf0.01"


def arrays(texts):
    raw = "".join(texts).encode()
    off = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]).astype(np.int64)
    return np.frombuffer(raw, np.uint8), off


def test_statistics_of_a_text():
    x = dict(zip(Q.STATS, Q.statistics(*arrays(["The cat sat. The cat!!\nTHE MAN | 12%\nThe cat sat. The cat!!"]))[0]))
    assert np.isclose(x["log_words"], np.log1p(14)) and x["longest_word"] == 5
    assert np.isclose(x["caps_words"], 2 / 14) and np.isclose(x["bare_words"], 2 / 14)
    assert np.isclose(x["repeated_lines"], 1 / 3) and np.isclose(x["top_word"], 4 / 14)
    assert np.isclose(x["distinct_words"], 8 / 14) and np.isclose(x["lines_per_word"], 3 / 14)


def test_statistics_do_not_depend_on_the_neighbours():
    texts = ["a b c", "", "x\n", "\n\n", "ÜÜ !! 12", "q" * 300, "same same same"]
    together = Q.statistics(*arrays(texts))
    for t, row in zip(texts, together):
        assert np.allclose(Q.statistics(*arrays([t]))[0], row)
    assert not together[1].any() and not together[3].any()


def test_held_out_labels(spark):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    out = Q.quality(docs, labels)
    rows = out.collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    got = [(r["score"], r["quality"]) for r in out.where("held_out").join(labels, "doc_id").collect()]
    good, bad = [s for s, q in got if q == 1], [s for s, q in got if q == 0]
    assert sum((a > b) + (a == b) / 2 for a in good for b in bad) > 0.97 * len(good) * len(bad)


def test_held_out_labels_are_not_used(spark):
    from pyspark.sql import functions as F

    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r["doc_id"]: r["score"] for r in Q.quality(docs, labels).collect()} == {r["doc_id"]: r["score"] for r in Q.quality(docs, turned).collect()}


def test_rules_as_column_equal_rules_as_arrays(spark):
    rng = np.random.default_rng(1)
    x = rng.random((500, len(Q.STATS)))
    y = (x[:, 3] > 0.5) & (x[:, 7] <= 0.6)
    rules = Q.fit_rules(x, y.astype(int))
    z = Q.covered(rules.rules, x) @ np.array(rules.weights) + rules.bias
    df = spark.createDataFrame([[float(v) for v in r] for r in x], [*Q.STATS])
    got = [r[0] for r in df.select(rules.column()).collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-z))) and ((np.array(got) >= 0.5) == y).mean() > 0.95
    assert len(rules.rules) < 200


def test_awkward_rows(spark):
    rows = awkward(random.Random(23))
    labels = spark.createDataFrame([(1, 1), (2, 1), (None, 0), (8, None), (9, 0), (7, 1), (7, 0)], "doc_id bigint, quality int")
    got = Q.quality(clashing(documents(spark, rows)), labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (3, 4, 5, 12)}) == 1
    none = labels.where("doc_id > 100")
    assert {r["score"] for r in Q.quality(documents(spark, rows), none).collect()} == {0.5}
    assert Q.quality(documents(spark, []), none).count() == 0
