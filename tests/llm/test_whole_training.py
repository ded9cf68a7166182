"""Models are learned from every row they may use, also from tables of many rows."""

import numpy as np
from pyspark.sql import functions as F

from svcops.llm import language_id as L
from svcops.llm import mixing as M


def test_language_model_counts_all_rows(spark):
    n = 11_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("ab").alias("text"), F.lit("en").alias("lang"))
    langs, matrix, _ = L.train(docs, F.lit(True))
    want = np.ones(L.BUCKETS)
    np.add.at(want, L.grams(["ab"])[0], n)
    assert langs == ["en"] and np.allclose(matrix[0], np.log(want / want.sum()), atol=1e-5)


def test_usual_is_the_median_of_all_rows(spark):
    """Against NumPy over the scores of all rows."""
    docs = spark.range(11_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the "), F.col("id").cast("string"), F.lit(" "),
                                      F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("text"), F.lit("en").alias("lang"))
    model = L.train(docs, F.lit(True))
    _, _, mean, _ = L.scorer(spark, model)(docs.select("text").toArrow()["text"].combine_chunks())
    middle, spread, _ = L.usual(docs, model, F.lit(True))["en"]
    assert abs(middle - np.median(mean)) < 1e-9 and abs(spread - 1.4826 * np.median(np.abs(mean - np.median(mean)))) < 1e-9


def test_mixing_learns_from_all_labels(spark):
    """Every word is in two rows only: a part of the rows would not tell of most words."""
    word = F.concat(F.lit("w"), F.pmod("id", F.lit(6000)).cast("string"))
    docs = spark.range(12_000).select(F.col("id").alias("doc_id"), word.alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    mixer = M.train(docs, labels, M.label_domain(), ["good", "poor"])
    rows = M.membership(docs, mixer).select("doc_id", (F.col("p")[0] > 0.5).cast("int").alias("good"))
    right = rows.where(F.col("good") == F.col("doc_id") % 2).count()
    assert right > 0.9 * 12_000
