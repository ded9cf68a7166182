"""Quality scores from a sparse ensemble of rules.

Each text gives the statistics in ``STATS``. Small decision trees, grown on
resampled training rows, are cut into rules: every path from a root to a node
is a conjunction of comparisons. A logistic regression with an L1 penalty
weighs the rules and drops most; the rest is compiled into one Spark column
expression over the statistics.

Training takes about ``SAMPLE`` labelled rows, chosen by a hash of the id, to
the driver as statistics; everything else is computed row by row.

Defined results: null and empty texts have all statistics 0 and are scored by
the rules like any other; rows with a null id or null label are never learned
from; without labelled rows every score is 0.5; a row labelled twice counts
twice.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from svcops.llm.common import chunks, fold, mixed, sums, utf8, word_hashes, words

SAMPLE = 12000
TREES = 60
DEPTH = 3
BINS = 32

#: Statistics of a text, in the order of ``statistics``.
STATS = (
    "log_words", "word_bytes", "longest_word", "upper_share", "caps_words", "digit_share", "mark_share", "bang_share",
    "bar_share", "bare_words", "marked_words", "wide_share", "distinct_words", "same_as_last", "repeated_pairs",
    "top_word", "lines_per_word", "repeated_lines", "sentence_words", "short_words", "title_words", "odd_ends",
)


def _is(*chars) -> np.ndarray:
    table = np.zeros(256, bool)
    for c in chars:
        table[list(c.encode() if isinstance(c, str) else c)] = True
    return table


_UPPER, _LOWER, _DIGIT = _is(range(65, 91)), _is(range(97, 123)), _is(range(48, 58))
_PLAIN_MARKS = _is(".,;:?!'\"()-")
_MARK = _is(range(33, 127)) & ~(_UPPER | _LOWER | _DIGIT | _PLAIN_MARKS)
_WIDE = _is(range(128, 256))
_LETTER = _UPPER | _LOWER | _WIDE


def _distinct(key: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each owner: how many distinct keys, and how often the commonest occurs."""
    if not len(key):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    head = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])]))
    size = np.diff(np.concatenate([head, [len(key)]]))
    top = np.zeros(n, np.int64)
    np.maximum.at(top, owner[head], size)
    return np.bincount(owner[head], minlength=n), top


def statistics(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of ``STATS`` for each text."""
    n = len(off) - 1
    starts, ends, woff = words(raw, off)
    count = np.diff(woff)
    owner = np.repeat(np.arange(n), count)
    size = ends - starts

    def bytes_of(table):
        return sums(table[raw].astype(np.uint8), off)

    def in_words(table):
        return np.add.reduceat(table[raw].astype(np.uint8), starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)

    def share(a, b):
        return a / np.maximum(b, 1)

    def words_where(mask):
        return share(np.bincount(owner[mask], minlength=n), count)

    upper, letter, mark = in_words(_UPPER), in_words(_LETTER), in_words(_MARK)
    h = word_hashes(raw, starts, ends)
    kinds, top = _distinct(h, owner, n)
    together = owner[1:] == owner[:-1]
    pair = mixed(h[:-1] * np.uint64(3) + h[1:])[together]
    pair_kinds, _ = _distinct(pair, owner[1:][together], n)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, owner, size)
    # lines: runs of bytes between line feeds
    text = np.repeat(np.arange(n), np.diff(off))
    cut = np.concatenate([np.flatnonzero(raw == 10), off[1:][off[1:] > off[:-1]]])
    cut = np.unique(cut)
    begin = np.concatenate([[0], cut[:-1]]).astype(np.int64) if len(cut) else cut
    begin = begin + (raw[np.minimum(begin, max(len(raw) - 1, 0))] == 10) * (begin < cut) if len(cut) else begin
    full = begin < cut
    line_owner = text[begin[full]]
    lines = np.bincount(line_owner, minlength=n)
    line_kinds, _ = _distinct(word_hashes(raw, begin[full], cut[full]), line_owner, n)
    ends_sentence = _is(".?!")
    sentences = bytes_of(ends_sentence)
    last = raw[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    first = raw[starts] if len(starts) else last
    total = np.diff(off)
    letters = bytes_of(_LETTER)
    columns = (
        np.log1p(count), share(sums(size.astype(np.int64), woff), count), longest, share(bytes_of(_UPPER), letters),
        words_where((upper >= 2) & (upper + in_words(_WIDE) >= letter)), share(bytes_of(_DIGIT), total), share(bytes_of(_MARK), total),
        share(bytes_of(_is("!")), total), share(bytes_of(_is("|")), total), words_where(letter == 0), words_where((mark > 0) & (letter > 0)),
        share(bytes_of(_WIDE), letters), share(kinds, count), share(np.bincount(owner[1:][together & (h[1:] == h[:-1])], minlength=n), count),
        share(np.maximum(count - 1, 0) - pair_kinds, count), share(top, count), share(lines, count), share(lines - line_kinds, lines),
        share(count, sentences + 1), words_where(size <= 3), words_where(_UPPER[first]), words_where(_MARK[last] | (last == 33)),
    )
    out = np.stack([np.asarray(c, float) for c in columns], axis=1)
    out[count == 0] = 0
    return out


def text_statistics(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """``rows`` with the column ``text_col`` replaced by the columns ``STATS``."""
    others = [c for c in rows.columns if c != text_col]

    def run(batches):
        for batch in batches:
            off, raw = utf8(batch.column(text_col))
            x = [statistics(raw[off[i]: off[j]], off[i: j + 1] - off[i]) for i, j in chunks(off)]
            x = np.concatenate(x) if x else np.zeros((0, len(STATS)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), *map(pa.array, np.ascontiguousarray(x.T))], [*others, *STATS])

    head = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in others)
    return rows.mapInArrow(run, head + ", ".join(f"{s} double" for s in STATS))


#: (statistic, True for "at most" and False for "above", threshold)
Condition = tuple[int, bool, float]


@dataclass
class Rules:
    """Rules with a weight, and the bias of the logistic score."""

    rules: list[tuple[Condition, ...]]
    weights: list[float]
    bias: float

    def column(self) -> Column:
        """The score as an expression over the columns ``STATS``."""
        z = F.lit(float(self.bias))
        for rule, w in zip(self.rules, self.weights, strict=True):
            hit = F.lit(True)
            for stat, below, limit in rule:
                c = F.col(STATS[stat])
                hit = hit & ((c <= limit) if below else (c > limit))
            z = z + F.when(hit, float(w)).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _tree_rules(x: np.ndarray, edges: list[np.ndarray], y: np.ndarray, rng: np.random.Generator) -> list[tuple[Condition, ...]]:
    """Rules of one tree; ``x`` holds bin numbers. Splits maximise the drop in squared error."""
    rules = []
    features = rng.choice(x.shape[1], size=max(2, x.shape[1] // 2), replace=False)

    def grow(at: np.ndarray, path: tuple[Condition, ...]):
        if path:
            rules.append(path)
        if len(path) >= DEPTH or len(at) < 40 or y[at].min() == y[at].max():
            return
        best = (1e-9, -1, 0)
        total, n = y[at].sum(), len(at)
        for f in features:
            size = np.cumsum(np.bincount(x[at, f], minlength=BINS))[:-1]
            hits = np.cumsum(np.bincount(x[at, f], weights=y[at], minlength=BINS))[:-1]
            ok = (size >= 10) & (size <= n - 10)
            gain = np.where(ok, hits**2 / np.maximum(size, 1) + (total - hits) ** 2 / np.maximum(n - size, 1) - total**2 / n, 0)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], f, k)
        _, f, k = best
        if f < 0 or k >= len(edges[f]):
            return
        low = x[at, f] <= k
        grow(at[low], (*path, (int(f), True, float(edges[f][k]))))
        grow(at[~low], (*path, (int(f), False, float(edges[f][k]))))

    grow(rng.integers(0, len(y), len(y)), ())
    return rules


def covered(rules: list[tuple[Condition, ...]], x: np.ndarray) -> np.ndarray:
    """Which rules hold for which rows."""
    out = np.ones((len(x), len(rules)), bool)
    for k, rule in enumerate(rules):
        for stat, below, limit in rule:
            out[:, k] &= (x[:, stat] <= limit) if below else (x[:, stat] > limit)
    return out


def fit_rules(x: np.ndarray, y: np.ndarray, l1: float = 1e-3, rounds: int = 400, seed: int = 7) -> Rules:
    """Trees, their rules and lasso logistic weights for 0/1 labels."""
    if not len(y):
        return Rules([], [], 0.0)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    rng, y = np.random.default_rng(seed), y.astype(float)
    rules = sorted({r for _ in range(TREES) for r in _tree_rules(binned, edges, y, rng)})
    a = covered(rules, x).astype(np.float32)
    if len(rules):  # of rules that hold for the same rows, one
        _, first = np.unique(np.packbits(a.astype(bool), axis=0), axis=1, return_index=True)
        rules, a = [rules[i] for i in sorted(first)], a[:, sorted(first)]
    w, b = np.zeros(len(rules)), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    step = 4 * len(y) / (np.linalg.norm(a, 2) ** 2 + len(y)) if len(rules) else 1.0
    w_old, b_old, t = w, b, 1.0
    for _ in range(rounds):
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        pull = (t - 1) / t_new
        wy, by = w + pull * (w - w_old), b + pull * (b - b_old)
        r = (1 / (1 + np.exp(-(a @ wy + by))) - y) / len(y)
        w_old, b_old, t = w, b, t_new
        w = wy - step * (a.T @ r)
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        b = by - step * r.sum()
    kept = np.flatnonzero(w)
    return Rules([rules[i] for i in kept], [float(w[i]) for i in kept], float(b))


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", sample: int = SAMPLE) -> Rules:
    """Rules learned from the labels of the ids that ``learn`` (over column ``id``) allows."""
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    known = known.where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & learn)
    share = min(1.0, sample / max(known.count(), 1))
    known = known.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1_000_000)) < share * 1_000_000)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = text_statistics(texts.join(F.broadcast(known), "id").select("label", "text"))  # about ``sample`` ids
    got = rows.toArrow()
    x = np.stack([got[s].to_numpy() for s in STATS], axis=1) if got.num_rows else np.zeros((0, len(STATS)))
    y = got["label"].to_numpy()
    order = np.lexsort((*x.T, y))  # not as rows happen to arrive
    return fit_rules(x[order], y[order])


def quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, id_col: str = "doc_id",
            text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row; fold ``held`` is never learned from."""
    rules = train(docs, labels, fold("id", folds) != held, id_col, text_col, label_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), (fold(f"`{id_col}`", folds) == held).alias("held_out"),
                       F.col(f"`{text_col}`").cast("string").alias("text"))
    scored = text_statistics(rows).select("doc_id", "held_out", rules.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
