"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, every run of characters that aren't letters becomes one
space, and the 1- to 3-grams of code points are hashed into ``BUCKETS``
buckets. Training counts grams per language in Spark (partial counts per task,
then a sum per language and bucket); the log-probability matrix, languages by
buckets, is broadcast: its size is bounded by ``MAX_LANGUAGES * BUCKETS``
floats, and more languages raise an error. Scoring adds up the matrix columns
of a text's grams, a batch of texts at a time.

Training reads every row it may learn from, and so does the measure of what is
usual in a language; only counts and medians leave the tasks.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
so is every text when nothing could be learned. Otherwise the score is the
posterior probability of the predicted language; ties go to the language that
sorts first. Rows with a null id or null language are never learned from.

The posterior only compares the known languages, and is near 1 for long texts in
none of them. ``accepted`` therefore also asks for a mean log-probability per
gram not far below that of the rows learned from: at most ``FAR`` times their
spread, a text's own sampling error added. Texts of a few words are seldom
refused.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from svcops.functions.ranks import percentiles
from svcops.llm.common import chunks, fold, mixed, sums, utf8
from svcops.session import settled

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
MAX_LANGUAGES = 256
#: Bytes of text whose grams a task holds at a time: their arrays take about 200 times as much.
GRAM_BYTES = 1 << 18
UNKNOWN = "und"
#: Spreads that a text's mean log-probability may lie below the language's median.
FAR = 3.5
#: The spread is at least this share of one gram's standard deviation, as subjects and styles differ.
LEAST_SPREAD = 0.26

_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point, whether it is a letter; made once in a process."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all grams, and the offsets of each text's grams. A gram of
    spaces alone doesn't count; none crosses from one text into the next."""
    low = [" " + t.lower() + " " if t else "" for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "replace"), np.uint32)
    off = np.concatenate([[0], np.cumsum([len(t) for t in low])]).astype(np.int64)
    letter = letters()[codes]
    keep = letter.copy()
    keep[:-1] |= letter[1:]  # one space before a word
    keep[off[1:][sums(letter.astype(np.uint8), off) > 0] - 1] = True  # and one after the last
    off = np.concatenate([[0], np.cumsum(keep)])[off]
    codes = np.where(letter, codes, 32)[keep].astype(np.uint64)
    room = np.repeat(off[1:], np.diff(off)) - np.arange(len(codes))  # code points left in the text
    found, owner = [], []
    for n in ORDERS:
        m = max(len(codes) - n + 1, 0)
        h = np.full(m, n, np.uint64)
        blank = np.ones(m, bool)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + codes[k: m + k]
            blank &= codes[k: m + k] == 32
        at = np.flatnonzero((room[:m] >= n) & ~blank)
        found.append((mixed(h[at]) & np.uint64(BUCKETS - 1)).astype(np.int64))
        owner.append(at)
    at = np.concatenate(owner)
    order = np.argsort(at, kind="stable")
    return np.concatenate(found)[order], np.searchsorted(at[order], off)


def _texts(column, i: int, j: int) -> list[str]:
    return [t or "" for t in column[i:j].to_pylist()]


def train(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang",
          id_col: str = "doc_id") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log-probability matrix (languages x buckets) and log priors."""
    known = docs.where(learn & F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull())
    known = known.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return [], np.zeros((0, BUCKETS), np.float32), np.zeros(0)
    langs = sorted(sizes)

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            off, _ = utf8(batch.column("text"))
            names = np.array(batch.column("lang").to_pylist(), object)
            for i, j in chunks(off, GRAM_BYTES):
                bucket, goff = grams(_texts(batch.column("text"), i, j))
                own = np.repeat(names[i:j], np.diff(goff))
                for x in set(names[i:j]):
                    total[x] = total.get(x, 0) + np.bincount(bucket[own == x], minlength=BUCKETS)
        for x, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "bucket", "n"])

    counted = known.mapInArrow(count, "lang string, bucket int, n bigint")
    table = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # at most languages x buckets rows
    matrix = np.ones((len(langs), BUCKETS))
    row = np.searchsorted(np.array(langs, object), np.array(table["lang"].to_pylist(), object)) if table.num_rows else []
    np.add.at(matrix, (np.asarray(row, np.int64), np.asarray(table["bucket"].to_numpy(), np.int64)), table["n"].to_numpy())
    matrix = np.log(matrix / matrix.sum(axis=1, keepdims=True))
    prior = np.log(np.array([sizes[x] for x in langs], float) / sum(sizes.values()))
    return langs, matrix.astype(np.float32), prior


def usual(docs: DataFrame, model, learn: Column, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang") -> dict[str, tuple[float, float, float]]:
    """For each language the median of its rows' mean log-probability of a gram,
    the spread between rows (1.4826 times the median deviation) and the standard
    deviation of one gram. Rows that the model gives to another language don't count."""
    langs, matrix, _ = model
    if not langs:
        return {}
    score = scorer(docs.sparkSession, model)
    known = docs.where(learn & F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            label, _, mean, _ = score(batch.column("text"))
            good = label == np.array(batch.column("lang").to_pylist(), object)
            yield pa.RecordBatch.from_arrays([pa.array(label[good].tolist(), pa.string()), pa.array(mean[good])], ["lang", "mean"])

    means = settled(known.where(F.col("lang").isNotNull()).mapInArrow(run, "lang string, mean double"))
    middles = {r["lang"]: r["p0"] for r in percentiles(means, "lang", "mean", (0.5,)).collect()}  # a row a language
    middle = F.coalesce(*[F.when(F.col("lang") == x, F.lit(m)) for x, m in sorted(middles.items())], F.lit(None).cast("double"))
    off = means.select("lang", F.abs(F.col("mean") - middle).alias("off"))
    spreads = {r["lang"]: r["p0"] for r in percentiles(off, "lang", "off", (0.5,)).collect()}
    out = {}
    for x, row in zip(langs, matrix.astype(np.float64), strict=True):
        p = np.exp(row)
        entropy = (p * row).sum()
        out[x] = (middles.get(x, float(entropy)), 1.4826 * spreads.get(x, 0.0), float(np.sqrt((p * (row - entropy) ** 2).sum())))
    return out


def scorer(spark, model):
    """A function from an Arrow text column to (labels, scores, mean
    log-probability of a gram, grams); the model is broadcast."""
    langs, matrix, prior = model
    sent = spark.sparkContext.broadcast((langs, np.ascontiguousarray(matrix), prior))

    def score(column) -> tuple[np.ndarray, ...]:
        langs, matrix, prior = sent.value
        off, _ = utf8(column)
        label, value = np.full(len(off) - 1, len(langs)), np.zeros(len(off) - 1)
        mean, size = np.zeros(len(off) - 1), np.zeros(len(off) - 1, np.int64)
        for i, j in chunks(off, GRAM_BYTES) if langs else []:
            bucket, goff = grams(_texts(column, i, j))
            like = np.stack([sums(m[bucket].astype(np.float64), goff) for m in matrix], axis=1) + prior
            p = 1 / np.exp(like - like.max(axis=1, keepdims=True)).sum(axis=1)
            some = goff[1:] > goff[:-1]
            label[i:j], value[i:j] = np.where(some, like.argmax(axis=1), len(langs)), np.where(some, p, 0)
            best = like.argmax(axis=1)
            size[i:j] = np.diff(goff)
            mean[i:j] = (like[np.arange(len(best)), best] - prior[best]) / np.maximum(size[i:j], 1)
        return np.array([*langs, UNKNOWN], object)[label], value, mean, size

    return score


def predict(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", **more: Column) -> DataFrame:
    """``doc_id, [more], lang_pred, score`` for every row."""
    score = scorer(docs.sparkSession, model)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), *[c.alias(k) for k, c in more.items()],
                       F.col(f"`{text_col}`").cast("string").alias("text"))
    names = ["doc_id", *more, "lang_pred", "score"]

    def run(batches):
        for batch in batches:
            label, value, _, _ = score(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(label.tolist(), pa.string()), pa.array(value)], names)

    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{head}, lang_pred string, score double")


def learned(docs: DataFrame, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"):
    """The model learned from the rows outside fold 0."""
    return train(docs, fold(f"`{id_col}`", folds) != 0, text_col, lang_col, id_col)


def identify(docs: DataFrame, folds: int = 5, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang") -> DataFrame:
    """Learn from the rows outside fold 0 and predict all: ``doc_id, held_out, lang_pred, score``."""
    model = learned(docs, folds, id_col, text_col, lang_col)
    return predict(docs, model, id_col, text_col, held_out=fold(f"`{id_col}`", folds) <= 0)


def distance(known: dict[str, tuple[float, float, float]], label: np.ndarray, mean: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many spreads each text lies below the median of its language; the
    grams of a text overlap, so about a third of them are independent."""
    middle, spread, one = np.array([known.get(x, (0.0, 0.0, 1.0)) for x in label], float).reshape(-1, 3).T
    return (middle - mean) / np.maximum(np.maximum(spread, LEAST_SPREAD * one) + one / np.sqrt(np.maximum(size / 3, 1)), 1e-9)


def accepted(docs: DataFrame, min_score: float = 0.5, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang") -> DataFrame:
    """``docs`` without the rows whose text is in no known language: it is
    ``und``, no language has ``min_score`` of the posterior, or the text is too
    unlike the rows of its language. One pass, no shuffle."""
    model = learned(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    score = scorer(docs.sparkSession, model)
    known = usual(docs, model, fold(f"`{id_col}`", 5) != 0, id_col, text_col, lang_col)

    def run(batches):
        for batch in batches:
            label, value, mean, size = score(batch.column(text_col))
            yield batch.filter(pa.array((label != UNKNOWN) & (value >= min_score) & (distance(known, label, mean, size) <= FAR)))

    return docs.mapInArrow(run, docs.schema)
