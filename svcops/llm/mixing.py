"""Mixing to target weights by soft membership and projected-gradient least squares.

A softmax classifier over hashed words, trained on all rows of the labelled
table (Spark's logistic regression, four fifths of the rows, and a temperature
from the others), gives every document a posterior over the domains. Document d
then counts for ``tokens(d) * posterior(d, k)`` tokens in domain k, and rates
r(d) >= 0 are fitted so that the rated totals match the target share of all
tokens in every domain, as near to the rates' start (1 for all) as gradient
steps leave them:

    r <- max(0, r - p(d) . g),   g = G^-1 (sum_d r(d) tokens(d) p(d) - target)

with G the sum of tokens(d) p(d) p(d)^T over the documents whose rate is above
0. This is projected gradient descent for least squares in the metric of G,
rates scaled by token counts: without the projection one step would reach the
targets. A pass over a narrow table adds up the totals in tasks; between
passes the driver holds one vector per pass, a number for each domain, and a
document's rate is those vectors replayed, so no rate is stored.

Bounds: at most ``MAX_DOMAINS`` domains, ``FIT_ROUNDS`` rounds of training,
``MAX_PASSES`` passes. Domains without target weight get 0; weights
are scaled to sum to 1.

Defined results: null and empty texts have 0 tokens, the classifier's prior
and a rate like any other; without labelled rows all domains are equally
likely; targets that no rates reach end in the nearest rates found and a warning;
labelled rows of a null label are ignored; a document labelled twice
with different domains counts for both.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from svcops.llm.common import chunks, shared, utf8
from svcops.llm.softmax import TEMPERATURES, class_logits, held_out_loss, lowered, ngram_buckets, quasi_newton, softmax
from svcops.session import settled

BUCKETS = 1 << 16
#: Weight of the classifier's L1 term and its rounds.
FIT_L1 = 2e-5
FIT_ROUNDS = 50
#: Buckets of words in a partition of the training rows, so that a round's sums (a
#: number for each bucket and domain) are few beside what they are made of.
FIT_ENTRIES = 1 << 21
#: Buckets whose sums are added up together.
SUMMED = 1 << 12
#: Bytes of text, and buckets of texts, that a task turns into arrays at a time.
TEXT_AT_ONCE = 1 << 18
ENTRIES_AT_ONCE = 1 << 16
MAX_DOMAINS = 32
MAX_PASSES = 40
TOLERANCE = 1e-4
#: Shares of the tokens that the mixture should have, by domain of the labels table.
TARGETS = {"good": 0.88, "poor": 0.08, "toxic": 0.04}


def label_domain() -> Column:
    """The labels table's domain: toxic rows first, then by quality."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")


@dataclass
class Mixer:
    """Classifier and the gradient vectors of the passes so far."""

    domains: list[str]
    weights: np.ndarray
    bias: np.ndarray
    steps: list[np.ndarray] = field(default_factory=list)
    deviation: float = 0.0

    def posterior(self, off: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Domain posteriors of texts given by their distinct buckets."""
        p, columns = [np.zeros((0, len(self.domains)))], np.ascontiguousarray(self.weights.T)
        for i, j in chunks(off, ENTRIES_AT_ONCE):
            p.append(softmax(class_logits(columns, self.bias, off[i: j + 1] - off[i], bucket[off[i]: off[j]])))
        return np.concatenate(p)

    def rates(self, p: np.ndarray) -> np.ndarray:
        return replayed(self.steps, p)


def replayed(steps: list[np.ndarray], p: np.ndarray) -> np.ndarray:
    """The rates of posteriors ``p`` after the given passes."""
    r = np.ones(len(p))
    for g in steps:
        r = np.maximum(0, r - p @ g)
    return r


def hashed(off: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, buckets, tokens) of texts: each one's distinct buckets and number of words."""
    ends, found, tokens = [np.zeros(1, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, j in chunks(off, TEXT_AT_ONCE):
        part, bucket, n = ngram_buckets(lowered(raw[off[i]: off[j]]), off[i: j + 1] - off[i], (1,), BUCKETS)
        ends.append(part[1:] + ends[-1][-1])
        found.append(bucket)
        tokens.append(n)
    return np.concatenate(ends), np.concatenate(found), np.concatenate(tokens)


def hashed_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, tokens, buckets`` of every document: all that training and posteriors need of a text."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            off, bucket, tokens = hashed(*utf8(batch.column("text")))
            lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(bucket.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(tokens), lists], ["doc_id", "tokens", "buckets"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, tokens bigint, buckets array<int>")


def _lists(batch) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, buckets) of a batch of ``hashed_words``."""
    lists = batch.column("buckets")
    return np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64), lists.flatten().to_numpy()


def train(docs: DataFrame, labels: DataFrame, domain: Column, domains: list[str], id_col: str = "doc_id",
          text_col: str = "text", label_id: str = "doc_id") -> Mixer:
    """The classifier, fitted on four fifths of the labelled ids, its temperature on
    the others."""
    return _trained(hashed_words(docs, id_col, text_col), labels, domain, domains, label_id)


def _trained(words: DataFrame, labels: DataFrame, domain: Column, domains: list[str], label_id: str = "doc_id") -> Mixer:
    """``train`` on ``hashed_words``: the labels are joined to them, so texts aren't shuffled."""
    if len(domains) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} domains")
    k = len(domains)
    known = labels.select(F.col(f"`{label_id}`").alias("id"), domain.alias("label")).where(
        F.col("id").isNotNull() & F.col("label").isin(domains)).distinct()
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if not sizes:
        return Mixer(domains, np.zeros((BUCKETS, k)), np.zeros(k))
    held = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(5)) == 0
    rows = settled(words.withColumnRenamed("doc_id", "id").join(known, "id").select("label", held.alias("held"), "buckets"))
    counts = {(r["label"], r["held"]): r["count"] for r in rows.groupBy("label", "held").count().collect()}
    w, b = _fitted(rows.where("not held"), {x: n for (x, h), n in counts.items() if not h}, domains)
    t = _temperature(rows.where("held"), {x: n for (x, h), n in counts.items() if h}, domains, w, b)
    prior = np.log(np.array([max(sizes.get(x, 0), 0.5) for x in domains], float) / sum(sizes.values()))
    return Mixer(domains, w / t, b / t + prior)  # classes were balanced in training


def _fitted(rows: DataFrame, counts: dict[str, int], domains: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Weights (buckets x domains) and bias from all ``rows``, whose domains have
    the same total weight. Domains without a row, or a single one, get zeros.

    The objective is L1-regularised multinomial regression on centred columns, each
    divided by its standard deviation, with the L1 term on the undivided weights."""
    w, b = np.zeros((BUCKETS, len(domains))), np.zeros(len(domains))
    present = [x for x in domains if counts.get(x)]
    k = len(present)
    if k < 2:
        return w, b
    share = {x: 1 / counts[x] / k for x in present}
    value = F.size("buckets") ** -0.5
    weight = F.coalesce(*[F.when(F.col("label") == x, F.lit(share[x])) for x in present])
    found = (rows.select(F.explode("buckets").alias("bucket"), weight.alias("weight"), value.alias("value")).groupBy("bucket")
             .agg(F.count("*"), F.sum(F.col("weight") * F.col("value")), F.sum(F.col("weight") * F.col("value") ** 2)).toArrow())
    at, n, first, second = (c.to_numpy() for c in found.columns)
    mean, inverse = np.zeros(BUCKETS), np.zeros(BUCKETS)
    variance = (second - first ** 2) / (1 - sum(share[x] ** 2 * counts[x] for x in present))
    mean[at], inverse[at] = first, np.where(variance > 0, 1 / np.sqrt(np.where(variance > 0, variance, 1)), 0)
    # joined and in few partitions: a round sends a vector of all buckets from each
    rows = rows.coalesce(max(-(-int(n.sum()) // FIT_ENTRIES), rows.sparkSession.sparkContext.defaultParallelism))

    def split(x):
        scaled, own = x[: BUCKETS * k].reshape(BUCKETS, k) * inverse[:, None], x[BUCKETS * k:]
        return scaled, own - mean @ scaled

    def loss(x):
        value, g, own = _gradient(rows, *split(x), [share[y] for y in present], present)
        return value, np.concatenate([((g - mean[:, None] * own) * inverse[:, None]).reshape(-1), own])

    l1 = np.concatenate([np.repeat(FIT_L1 * inverse, k), np.zeros(k)])
    at = [domains.index(x) for x in present]
    w[:, at], b[at] = split(quasi_newton(loss, np.zeros(len(l1)), l1, FIT_ROUNDS))
    return w, b


def _gradient(rows: DataFrame, w: np.ndarray, b: np.ndarray, share: list[float], present: list[str]) -> tuple[float, np.ndarray, np.ndarray]:
    """The weighted log loss of all ``rows`` and its gradients by weights and bias.
    A task sums its rows, the tasks' sums are added by block of buckets, and the driver
    gets one number for each bucket and domain but the last, whose sums are the others'."""
    k = len(b)
    sent = rows.sparkSession.sparkContext.broadcast((np.ascontiguousarray(w.T), b, np.array(share), {x: i for i, x in enumerate(present)}))

    def run(batches):
        w, b, share, index = sent.value
        g, rest = np.zeros((k - 1, BUCKETS)), np.zeros(k)  # rest: loss, then the bias
        for batch in batches:
            offsets, buckets = _lists(batch)
            labels = np.array([index[x] for x in batch.column("label").to_pylist()], np.int64)
            for i, j in chunks(offsets, ENTRIES_AT_ONCE):
                off, bucket, y = offsets[i: j + 1] - offsets[i], buckets[offsets[i]: offsets[j]], labels[i:j]
                z = class_logits(w, b, off, bucket)
                z -= z.max(axis=1, keepdims=True)
                e = np.exp(z)
                total, each = e.sum(axis=1), np.arange(len(y))
                rest[0] += share[y] @ (np.log(total) - z[each, y])
                r = e / total[:, None]
                r[each, y] -= 1
                r *= share[y][:, None]
                rest[1:] += r[:, :-1].sum(axis=0)
                n = np.diff(off)
                r *= np.maximum(n, 1)[:, None] ** -0.5
                for c in range(k - 1):
                    g[c] += np.bincount(bucket, np.repeat(r[:, c], n), BUCKETS)
        blocks = [*g.reshape(-1, SUMMED), rest]
        yield pa.RecordBatch.from_arrays([pa.array([*range(len(blocks))], pa.int32()), pa.array(blocks)], ["block", "x"])

    def add(table):
        x = table.column("x").combine_chunks()
        return pa.table({"block": table.column("block")[:1], "x": [x.flatten().to_numpy().reshape(len(x), -1).sum(axis=0)]})

    schema = "block int, x array<double>"
    found = rows.select("label", "buckets").mapInArrow(run, schema).groupBy("block").applyInArrow(add, schema).toArrow()
    sent.destroy()
    blocks = dict(zip(found["block"].to_pylist(), (x.values.to_numpy() for x in found["x"])))
    rest = blocks.pop(max(blocks))
    g = np.concatenate([blocks[i] for i in sorted(blocks)]).reshape(k - 1, BUCKETS).T
    return rest[0], np.column_stack([g, -g.sum(axis=1)]), np.append(rest[1:], -rest[1:].sum())


def _temperature(rows: DataFrame, counts: dict[str, int], domains: list[str], w: np.ndarray, b: np.ndarray) -> float:
    """The divisor of the logits that makes the labels of all ``rows`` likeliest;
    the loss of each try is added up in tasks."""
    if not counts:
        return 1.0
    sent = rows.sparkSession.sparkContext.broadcast((np.ascontiguousarray(w.T), b, domains, [1 / max(counts.get(x, 0), 1) for x in domains]))

    def run(batches):
        w, b, domains, share = sent.value
        for batch in batches:
            off, bucket = _lists(batch)
            y = np.array([domains.index(x) for x in batch.column("label").to_pylist()], np.int64)
            loss = held_out_loss(class_logits(w, b, off, bucket), y, np.array(share)[y])
            yield pa.RecordBatch.from_arrays([pa.array([*range(len(loss))], pa.int32()), pa.array(loss)], ["i", "x"])

    found = dict(rows.select("label", "buckets").mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x")).collect())
    return float(TEMPERATURES[min(found, key=lambda i: (found[i], i))])


def membership(docs: DataFrame, mixer: Mixer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, tokens, p`` (posteriors in the order of the mixer's domains)."""
    return _members(hashed_words(docs, id_col, text_col), mixer)


def _members(words: DataFrame, mixer: Mixer) -> DataFrame:
    """``membership`` from ``hashed_words``."""
    get = shared(words.sparkSession, mixer)

    def run(batches):
        mixer = get()
        k = len(mixer.domains)
        for batch in batches:
            p = mixer.posterior(*_lists(batch))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * k), pa.array(p.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tokens"), lists], ["doc_id", "tokens", "p"])

    return words.mapInArrow(run, f"doc_id {words.schema['doc_id'].dataType.simpleString()}, tokens bigint, p array<double>")


def _matrix(batch) -> np.ndarray:
    return batch.column("p").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _totals(members: DataFrame, mixer: Mixer) -> tuple[np.ndarray, np.ndarray, float]:
    """Rated token totals of the domains, G, and all tokens; sums are made in tasks."""
    k, steps = len(mixer.domains), list(mixer.steps)

    def run(batches):
        total, gram, tokens = np.zeros(k), np.zeros((k, k)), 0
        for batch in batches:
            p, t = _matrix(batch), batch.column("tokens").to_numpy()
            rate = replayed(steps, p)
            total += (rate * t) @ p
            gram += (p * (t * (rate > 0))[:, None]).T @ p
            tokens += int(t.sum())
        x = np.concatenate([total, gram.reshape(-1), [tokens]])
        yield pa.RecordBatch.from_arrays([pa.array([*range(len(x))], pa.int32()), pa.array(x)], ["i", "x"])

    found = dict(members.select("tokens", "p").mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x")).collect())
    x = np.array([found.get(i, 0.0) for i in range(k * (k + 1) + 1)])
    return x[:k], x[k:-1].reshape(k, k), x[-1]


def fit_rates(members: DataFrame, mixer: Mixer, targets: dict[str, float]) -> Mixer:
    """Gradient passes until every domain's total is within ``TOLERANCE`` of
    all tokens. ``mixer.deviation`` is what the totals are off at the end, as a
    share of all tokens; targets that aren't reached in ``MAX_PASSES``, or that no
    rates reach, give a warning."""
    share = np.array([max(targets.get(x, 0.0), 0.0) for x in mixer.domains])
    share /= share.sum() or 1
    for n in range(MAX_PASSES + 1):
        total, gram, tokens = _totals(members, mixer)
        mixer.deviation = float(np.abs(total - share * tokens).max() / max(tokens, 1))
        if mixer.deviation < TOLERANCE:
            break
        if n == MAX_PASSES:
            warnings.warn(f"the mixture misses its targets by {mixer.deviation:.3g} of all tokens", stacklevel=2)
            break
        mixer.steps.append(np.linalg.pinv(gram, rcond=1e-10, hermitian=True) @ (total - share * tokens))
    return mixer


def mixed_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, domain: Column | None = None,
                id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Mixer]:
    """``doc_id, tokens, p_<domain>..., rate`` for every document, and the mixer."""
    targets = TARGETS if targets is None else targets
    words = settled(hashed_words(docs, id_col, text_col))  # a text is hashed once for training and posteriors
    mixer = _trained(words, labels, label_domain() if domain is None else domain, sorted(targets))
    members = settled(_members(words, mixer))
    mixer = fit_rates(members, mixer, targets)
    steps = list(mixer.steps)
    names = ["doc_id", "tokens", *(f"p_{x}" for x in mixer.domains), "rate"]

    def run(batches):
        for batch in batches:
            p = _matrix(batch)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tokens"), *map(pa.array, np.ascontiguousarray(p.T)),
                                              pa.array(replayed(steps, p))], names)

    kind = members.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, tokens bigint, " + ", ".join(f"`{x}` double" for x in names[2:])
    return members.mapInArrow(run, schema), mixer


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, domain: Column | None = None,
        id_col: str = "doc_id", text_col: str = "text", rate_col: str = "mix_rate") -> DataFrame:
    """``docs`` with each row's rate; rows of rate 0 go. The rate is the
    expected number of times the mixture takes the row. A column that already
    has the name ``rate_col`` is replaced. Texts are read twice, never shuffled."""
    _, mixer = mixed_rates(docs, labels, targets, domain, id_col, text_col)
    docs = docs.drop(rate_col)
    get = shared(docs.sparkSession, mixer)

    def run(batches):
        mixer = get()
        for batch in batches:
            off, bucket, _ = hashed(*utf8(batch.column(text_col)))
            rate = mixer.rates(mixer.posterior(off, bucket))
            out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(rate)], [*batch.schema.names, rate_col])
            yield out.filter(pa.array(rate > 0))

    return docs.mapInArrow(run, docs.select("*", F.lit(0.0).alias(rate_col)).schema)
