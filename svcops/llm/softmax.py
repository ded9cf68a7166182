"""Sparse softmax regression over hashed word n-grams, fitted on a bounded sample.

The sample's features arrive as (row offsets, bucket numbers): each row's
distinct buckets, all with the value 1 / sqrt(their number). Fitting is
accelerated proximal gradient (an L1 term sets most weights to zero), then one
temperature fitted on rows kept apart. ``quasi_newton`` serves fits whose loss
is added up elsewhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from svcops.llm.common import chunks, mixed, sums, utf8, word_hashes, words


def lowered(raw: np.ndarray) -> np.ndarray:
    """ASCII letters in lower case."""
    return np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)


def ngram_buckets(raw: np.ndarray, off: np.ndarray, orders: tuple[int, ...], buckets: int):
    """Distinct buckets of each row's word n-grams: (offsets, buckets, words per row)."""
    starts, ends, woff = words(raw, off)
    h = word_hashes(raw, starts, ends)
    rows = np.repeat(np.arange(len(off) - 1), np.diff(woff))
    keys = []
    for n in orders:
        m = max(len(h) - n + 1, 0)
        g = h[:m].copy()
        for k in range(1, n):
            g = mixed(g * np.uint64(31) + h[k: k + m])
        inside = rows[:m] == rows[n - 1:] if n > 1 else slice(None)
        keys.append((rows[:m][inside] * buckets) + (mixed(g + np.uint64(n))[inside] & np.uint64(buckets - 1)).astype(np.int64))
    key = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return np.searchsorted(key, np.arange(len(off)) * buckets), key % buckets, np.diff(woff)


def features(rows: DataFrame, orders: tuple[int, ...], buckets: int) -> DataFrame:
    """``label, buckets`` for rows of ``label, text``."""
    kind = rows.schema["label"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            off, raw = utf8(batch.column("text"))
            raw = lowered(raw)
            for i, j in chunks(off):
                goff, bucket, _ = ngram_buckets(raw[off[i]: off[j]], off[i: j + 1] - off[i], orders, buckets)
                lists = pa.ListArray.from_arrays(pa.array(goff.astype(np.int32)), pa.array(bucket.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("label").slice(i, j - i), lists], ["label", "buckets"])

    return rows.select("label", "text").mapInArrow(run, f"label {kind}, buckets array<int>")


def logits(weights: np.ndarray, bias: np.ndarray, off: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    scale = 1 / np.sqrt(np.maximum(np.diff(off), 1))
    return sums(weights[bucket], off) * scale[:, None] + bias


def class_logits(columns: np.ndarray, bias: np.ndarray, off: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """``logits`` from weights laid out by class, faster for few classes."""
    scale = 1 / np.sqrt(np.maximum(np.diff(off), 1))
    return np.column_stack([sums(c.take(bucket), off) for c in columns]) * scale[:, None] + bias


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def fit(off: np.ndarray, bucket: np.ndarray, y: np.ndarray, k: int, buckets: int, l1: float = 2e-5, rounds: int = 150,
        share: np.ndarray | None = None):
    """Weights (buckets x k) and bias; every class has the same total weight, or its ``share``."""
    n = len(y)
    scale = 1 / np.sqrt(np.maximum(np.diff(off), 1))
    weight = 1 / np.maximum(np.bincount(y, minlength=k), 1)[y]
    if share is not None:
        weight = weight * share[y]
    weight /= weight.sum()
    entry = np.repeat(np.arange(n), np.diff(off))
    truth = np.eye(k)[y]
    w, b = np.zeros((buckets, k)), np.zeros(k)
    w_old, b_old, t, step = w, b, 1.0, 1 / (0.5 * 2)  # row vectors have length 1, with the bias sqrt(2)
    for _ in range(rounds):
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        pull = (t - 1) / t_new
        wy, by = w + pull * (w - w_old), b + pull * (b - b_old)
        p = softmax(logits(wy, by, off, bucket))
        r = (p - truth) * weight[:, None]
        rs = r * scale[:, None]
        g = np.stack([np.bincount(bucket, weights=rs[entry, c], minlength=buckets) for c in range(k)], axis=1)
        w_old, b_old, t = w, b, t_new
        w = wy - step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        b = by - step * r.sum(axis=0)
    return w, b


def quasi_newton(loss, x: np.ndarray, l1: np.ndarray, rounds: int, memory: int = 10, tolerance: float = 1e-6) -> np.ndarray:
    """The minimum of ``loss(x)[0] + sum(l1 * abs(x))`` near ``x`` by OWL-QN (Andrew
    and Gao 2007): L-BFGS on the gradient that the L1 term leaves, each step kept to one
    orthant. ``loss`` gives a value and its gradient and is called once a try."""

    def whole(x):
        value, g = loss(x)
        kept = np.where(x != 0, g + np.sign(x) * l1, np.sign(g) * np.maximum(np.abs(g) - l1, 0))
        return value + l1 @ np.abs(x), g, kept

    value, g, kept = whole(x)
    first, values, past = value, [value], []
    for n in range(rounds):
        if np.linalg.norm(kept) <= max(tolerance * value, 1e-8):
            break
        d, used = -kept, []
        for s, y in reversed(past):
            used.append(s @ d / (s @ y))
            d -= used[-1] * y
        if past:
            d *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        for (s, y), a in zip(past, reversed(used)):
            d += (a - y @ d / (s @ y)) * s
        d[d * kept >= 0] = 0
        slope, orthant = kept @ d, np.where(x != 0, np.sign(x), -np.sign(kept))
        step = 0.5 / np.linalg.norm(g) if n == 0 else 1.0
        for _ in range(20):  # until the strong Wolfe conditions hold
            new = x + step * d
            new[np.sign(new) != orthant] = 0
            new_value, new_g, new_kept = whole(new)
            if new_value > value + 1e-4 * step * slope or new_kept @ d > -0.9 * slope:
                step *= 0.1 if n == 0 else 0.5
            elif new_kept @ d < 0.9 * slope:
                step *= 2.1
            else:
                break
        else:
            break
        past = [*past, (new - x, new_g - g)][-memory:] if (new - x) @ (new_g - g) > 0 else past
        x, value, g, kept = new, new_value, new_g, new_kept
        if max(values) - value <= tolerance * abs(first):
            break
        values = [*values, value][-20:]
    return x


#: Divisors of the logits to choose from.
TEMPERATURES = np.geomspace(0.02, 50, 80)


def held_out_loss(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The weighted log loss of the labels at each of ``TEMPERATURES``."""
    return np.array([-(weight * np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-12))).sum() for t in TEMPERATURES])


def temperature(z: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> float:
    """The divisor of the logits that makes the held-out labels likeliest."""
    if not len(y):
        return 1.0
    weight = np.ones(len(y)) if weight is None else weight
    return float(TEMPERATURES[int(np.argmin(held_out_loss(z, y, weight)))])
