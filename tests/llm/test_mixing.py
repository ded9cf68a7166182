import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from svcops.llm import mixing as M
from svcops.llm.common import read
from tests.llm.helpers import clashing, documents

SF = "/root/testdata/sf0.01"


def corpus(rng, n=300):
    kinds = {"good": ("the", "thing", "of", "was"), "poor": ("###", "$$$", "!!", "%%"), "toxic": ("scum", "idiot", "trash", "the")}
    rows, labels = [], []
    for i in range(n):
        kind = rng.choices(list(kinds), [6, 3, 1])[0]
        rows.append((i, " ".join(rng.choice(kinds[kind]) + rng.choice(["", "er"]) for _ in range(rng.randrange(20, 60)))))
        if i % 2:
            labels.append((i, int(kind != "poor"), int(kind == "toxic")))
    return rows, labels


def labelled(spark, labels):
    return spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_totals_meet_the_targets(spark):
    rows, labels = corpus(random.Random(18))
    targets = {"good": 0.5, "poor": 0.3, "toxic": 0.2}
    out, mixer = M.mixed_rates(clashing(documents(spark, rows)), labelled(spark, labels), targets)
    got = out.collect()
    assert len(got) == len(rows) and all(r["rate"] >= 0 for r in got)
    tokens = sum(r["tokens"] for r in got)
    assert tokens == sum(len(t.split()) for _, t in rows)
    for k, share in targets.items():
        assert abs(sum(r["rate"] * r["tokens"] * r[f"p_{k}"] for r in got) / tokens - share) < 1e-3
    assert len(mixer.steps) < M.MAX_PASSES
    assert all(abs(sum(r[f"p_{k}"] for k in targets) - 1) < 1e-9 for r in got)


def test_rates_solve_the_least_squares(spark):
    """Against plain projected gradient in one process."""
    rows, labels = corpus(random.Random(19))
    targets = {"good": 0.9, "poor": 0.09, "toxic": 0.01}
    got = M.mixed_rates(documents(spark, rows), labelled(spark, labels), targets)[0].collect()
    t = np.array([r["tokens"] for r in got], float)
    p = np.array([[r[f"p_{k}"] for k in sorted(targets)] for r in got])
    r, target = np.ones(len(t)), np.array([targets[k] for k in sorted(targets)]) * t.sum()
    for _ in range(M.MAX_PASSES):
        total = (r * t) @ p
        if np.abs(total - target).max() < M.TOLERANCE * t.sum():
            break
        r = np.maximum(0, r - p @ (np.linalg.pinv((p * (t * (r > 0))[:, None]).T @ p) @ (total - target)))
    assert np.allclose(r, [x["rate"] for x in got], atol=1e-6)


def test_posteriors_tell_labels_apart(spark):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    out, _ = M.mixed_rates(docs, labels)
    got = out.join(labels.select("doc_id", M.label_domain().alias("domain")), "doc_id").collect()
    right = sum(max(M.TARGETS, key=lambda k: r[f"p_{k}"]) == r["domain"] for r in got)
    assert right > 0.9 * len(got)


def test_stage(spark):
    rows, labels = corpus(random.Random(20))
    docs = clashing(documents(spark, [*rows, (901, None), (None, "the thing"), (5, "the of"), (902, "")]))
    out = M.mix(docs, labelled(spark, [*labels, (None, 1, 0), (7, None, None), (9999, 1, 1)]))
    assert out.columns == [*docs.columns, "mix_rate"]
    got = out.collect()
    assert {901, None, 902} <= {r["doc_id"] for r in got} and all(r["mix_rate"] > 0 for r in got)
    again = M.mix(docs.withColumn("mix_rate", F.lit("old")), labelled(spark, labels))
    assert again.columns == out.columns and dict(again.dtypes)["mix_rate"] == "double"


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "a b"), (2, "c")]])
def test_without_labels(spark, rows):
    out, _ = M.mixed_rates(documents(spark, rows), labelled(spark, []))
    got = out.collect()
    assert len(got) == len(rows) and all(abs(r["p_good"] - 1 / 3) < 1e-9 for r in got)
    assert M.mix(documents(spark, rows), labelled(spark, [])).count() == len(rows)


def test_unreached_targets_are_told(spark, monkeypatch):
    """Documents of one kind can't make up a mixture of three."""
    monkeypatch.setattr(M, "MAX_PASSES", 5)
    docs = documents(spark, [(i, "the same text of every document") for i in range(20)])
    with pytest.warns(UserWarning, match="misses its targets"):
        out, mixer = M.mixed_rates(docs, labelled(spark, []), {"good": 0.9, "poor": 0.1, "toxic": 0.0})
    assert mixer.deviation > M.TOLERANCE and out.count() == 20
