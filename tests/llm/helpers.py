"""Small inputs that every operator must handle."""

from __future__ import annotations

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

#: Extra columns whose names operators use inside.
CLASHING = ("id", "size", "fp", "block", "label", "keep_id", "component_id", "tokens", "score", "prefix", "t", "p", "held_out",
            "__fp", "__digest", "__id", "__key", "__docs", "__only_id", "only_id", "marked_id", "marked_key", "first_key", "row", "tie", "at", "n")


def documents(spark, rows):
    """``documents`` from (doc_id, text) or (doc_id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, "src0", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def clashing(docs):
    """``docs`` with extra columns, all null."""
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit(None).cast("string").alias(c) for c in CLASHING])


def prose(rng: random.Random, n_words: int, syllables=("the", "on", "er", "tion", "in", "re", "ing", "st", "ha", "wh", "ly", "ed")) -> str:
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(n_words))


def awkward(rng: random.Random):
    """Null and empty texts, ties, copies, white space, letters from elsewhere, a very long text and word."""
    a, b = prose(rng, 60), prose(rng, 40)
    return [(1, a), (2, a), (3, None), (4, ""), (5, " \t\n"), (6, a.replace(" ", "\n")), (7, b), (7, b), (8, "äöü " * 5), (9, "123 456"),
            (10, prose(rng, 20_000)), (11, "x" * 50_000), (None, b), (12, None), (13, "😀 ok"), (14, a.upper()), (15, "one"), (16, "one two")]
