"""Alignment of the tokens that two tokenizers make of the same texts.

A (byte-level BPE) encodes a space and the text, B (SentencePiece) the text, to
which it adds the space. Tokens are byte ranges. *Pointer jumping*: every token
points to the token that reaches farthest to the right among those that overlap
it; doubling the pointers, for all tokens of a chunk of documents at once, ends
at the last token of each connected group, which labels the group. A group ends
where tokens of both end at the same byte.

All A-B pairs of token occurrences of a group are links. A document's distinct
pairs of ids, with how often each occurs, are kept packed in one cell of a
written table, so texts are encoded once and links are never shuffled. How many
documents hold a pair is counted in each task before the shuffle. The commonest
pairs, at most ``HOT``, are then looked up from a broadcast; any others meet
the documents' links in a join, in which no pair is frequent.

Defined results: a null or empty text, and one that either tokenizer does not
give back byte by byte, has no tokens, zeros and an empty ``groups_sha256``;
rows of equal or null ids count as documents of their own; texts are encoded
whole; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from svcops.llm.common import chunks, shared, sums, utf8
from svcops.llm.tokens import ByteTokens
from svcops.session import scratch_path, settled

SPACE = "▁"
#: Links that a task expands at a time.
LINKS = 1 << 21
#: Pairs whose counts are broadcast; also pairs that a task counts before it hands them on.
HOT = 3_000_000
_SEPARATORS = (",", "|", ";", "")


class PieceTokens:
    """SentencePiece ids and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = {i: bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace(SPACE, " ").encode()
                      for i in range(m.get_piece_size())}

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int64) for x in self.model.encode(texts, num_threads=1)]


def groups(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Group numbers, in order, of A's and of B's tokens, and how many there are.
    Both sequences cover the same bytes; tokens are given by their ends."""
    n = len(end_a)
    if not n or not len(end_b):
        return np.zeros(n, np.int64), np.zeros(len(end_b), np.int64), 0
    over_a = np.searchsorted(end_b, end_a, "left")  # B's token at the last byte of each of A's
    over_b = np.searchsorted(end_a, end_b, "left")
    own = np.arange(n, n + len(end_b))
    # of tokens that end together B's is the last
    pointer = np.concatenate([over_a + n, np.where(end_a[over_b] > end_b, over_b, own)])
    while True:
        farther = pointer[pointer]
        if np.array_equal(farther, pointer):
            break
        pointer = farther
    last = np.flatnonzero(pointer[n:] == own) + n
    label = np.searchsorted(last, pointer)
    return label[:n], label[n:], len(last)


class Aligner:
    """Aligns chunks of texts; loaded once a task."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteTokens(a_path, plain=True), PieceTokens(b_path)
        self.raw_a, self.raw_b = ([x.bytes.get(i, b"") for i in range(max(x.bytes) + 2)] for x in (self.a, self.b))
        self.size_a, self.size_b = (np.array([len(v) for v in raw], np.int64) for raw in (self.raw_a, self.raw_b))
        self.shift = np.int64(pair_bits(b_path))
        self.text = [f"{i}{s}" for i in range(max(len(self.size_a), len(self.size_b))) for s in _SEPARATORS]

    def encoded(self, texts: list[str]):
        """(A's ids, B's ids) of each text, empty where it isn't given back whole."""
        nothing = np.zeros(0, np.int64)
        own = [i for i, t in enumerate(texts) if t]
        out = [(nothing, nothing)] * len(texts)
        for i, b in zip(own, self.b.ids([texts[i] for i in own]), strict=True):
            raw = b" " + texts[i].encode()
            a = self.a.ids(" " + texts[i]).astype(np.int64)
            if all(b"".join(map(table.__getitem__, ids.tolist())) == raw for table, ids in ((self.raw_a, a), (self.raw_b, b))):
                out[i] = a, b
        return out

    def align(self, texts: list[str]):
        """For each text: tokens of A, of B, groups, links, digest of the groups,
        distinct pairs (ascending) and how often each is linked."""
        encoded = self.encoded(texts)
        a, b = (np.concatenate([*(e[k] for e in encoded), np.zeros(0, np.int64)]) for k in (0, 1))
        off_a, off_b = (np.cumsum([0] + [len(e[k]) for e in encoded]) for k in (0, 1))
        in_a, in_b, n = groups(np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b]))
        each_a, each_b = np.bincount(in_a, minlength=n), np.bincount(in_b, minlength=n)
        at_a, at_b = np.cumsum(each_a) - each_a, np.cumsum(each_b) - each_b
        doc = np.searchsorted(off_a, at_a, "right") - 1  # of each group
        off_g = np.searchsorted(doc, np.arange(len(texts) + 1))
        links = sums(each_a * each_b, off_g)
        keys, times = self._links(a, b, each_a, each_b, at_a, at_b, doc)
        cut = np.searchsorted(keys >> np.int64(32), np.arange(len(texts) + 1))
        digest = self._digests(a, b, in_a, in_b, off_a, off_b, at_a + each_a - 1, at_b + each_b - 1, off_g)
        pairs = keys & np.int64((1 << 32) - 1)
        return [(len(x), len(y), int(g), int(k), h, pairs[i:j], times[i:j])
                for (x, y), g, k, h, i, j in zip(encoded, np.diff(off_g), links, digest, cut[:-1], cut[1:], strict=True)]

    def _links(self, a, b, each_a, each_b, at_a, at_b, doc):
        """Distinct (document, pair) keys and how often each is linked."""
        size = each_a * each_b
        keys, times = [], []
        for g in np.flatnonzero(size > LINKS):  # a very large group: distinct ids first
            ia, ca = np.unique(a[at_a[g]: at_a[g] + each_a[g]], return_counts=True)
            ib, cb = np.unique(b[at_b[g]: at_b[g] + each_b[g]], return_counts=True)
            keys.append(((doc[g] << np.int64(32)) + (ia << self.shift)[:, None] + ib[None, :]).ravel())
            times.append((ca[:, None] * cb[None, :]).ravel())
        small = np.flatnonzero(size <= LINKS)
        upto = np.cumsum(size[small])
        i = 0
        while i < len(small):
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + LINKS, "right")))
            g = np.repeat(small[i:j], size[small[i:j]])
            rank = np.arange(len(g)) - np.repeat(np.cumsum(size[small[i:j]]) - size[small[i:j]], size[small[i:j]])
            key = (doc[g] << np.int64(32)) + (a[at_a[g] + rank // each_b[g]] << self.shift) + b[at_b[g] + rank % each_b[g]]
            key, n = np.unique(key, return_counts=True)
            keys.append(key)
            times.append(n)
            i = j
        return added(keys, times)

    def _digests(self, a, b, in_a, in_b, off_a, off_b, last_a, last_b, off_g):
        """SHA-256 of ``a1,a2|b1;a3|b2,b3`` for each document, empty without tokens."""
        mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        mark_a[last_a], mark_b[last_b] = 1, 2
        mark_b[last_b[off_g[1:][np.diff(off_g) > 0] - 1]] = 3
        order = np.argsort(np.concatenate([2 * in_a, 2 * in_b + 1]), kind="stable")
        word = np.concatenate([4 * a + mark_a, 4 * b + mark_b])[order].tolist()
        off = (off_a + off_b).tolist()
        text = self.text
        return [hashlib.sha256("".join([text[w] for w in word[i:j]]).encode()).hexdigest() if j > i else ""
                for i, j in zip(off[:-1], off[1:], strict=True)]


def added(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their values."""
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(keys) == 1:
        return keys[0], values[0]
    key, value = np.concatenate(keys), np.concatenate(values)
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    head = np.flatnonzero(np.diff(key, prepend=-1))
    return key[head], np.add.reduceat(value, head) if len(head) else value


def pair_bits(b_path: str) -> int:
    """A pair is ``a << bits | b``."""
    import sentencepiece

    return max(1, (sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size() - 1).bit_length())


def _unpacked(column) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, numbers) of a column of ascending numbers, packed as differences."""
    off, raw = utf8(column)
    off //= 4
    value = np.frombuffer(raw.tobytes(), "<u4").astype(np.int64)
    run = np.concatenate([[0], np.cumsum(value)])
    return off, run[1:] - np.repeat(run[off[:-1]], np.diff(off))


def _packed(pairs: np.ndarray) -> bytes:
    return np.diff(pairs, prepend=0).astype("<u4").tobytes()


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: ``row`` (unique), ``doc_id, n_a, n_b, n_groups,
    n_links, groups_sha256, pairs, times`` and ``bits``, written to the shared
    folder; ``pairs`` and ``times`` are read by ``links`` and ``pair_counts``."""
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]

    def run(batches):
        aligner = Aligner(a_path, b_path)
        if len(aligner.size_a) << int(aligner.shift) > 1 << 32:
            raise ValueError("vocabularies too large: a pair of ids must fit into 32 bits")
        for batch in batches:
            off, _ = utf8(batch.column("text"))
            for i, j in chunks(off):
                part = batch.slice(i, j - i)
                found = aligner.align([t or "" for t in part.column("text").to_pylist()])
                n_a, n_b, n, links, digest, pairs, times = (list(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_a, n_b, n, links)), pa.array(digest, pa.string()),
                     pa.array([_packed(x) for x in pairs], pa.binary()), pa.array([x.astype("<u4").tobytes() for x in times], pa.binary())],
                    names)

    path = scratch_path(docs.sparkSession, "aligned")
    schema = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs binary, times binary"
    out = rows.mapInArrow(run, schema).select(F.monotonically_increasing_id().alias("row"), "*", F.lit(pair_bits(b_path)).alias("bits"))
    out.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, a, b, documents, best``: how many documents link each pair of ids,
    and whether no other B id is linked to A's id in more."""
    def run(batches):
        keys, counts, waiting = [], [], 0
        for batch in batches:
            _, pairs = _unpacked(batch.column("pairs"))
            key, n = np.unique(pairs, return_counts=True)
            keys.append(key)
            counts.append(n)
            waiting += len(key)
            if waiting > HOT:
                key, n = added(keys, counts)
                keys, counts, waiting = ([], [], 0) if len(key) > HOT // 2 else ([key], [n], len(key))
                if not keys:
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["pair", "n"])
        key, n = added(keys, counts)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["pair", "n"])

    own = aligned.select("bits").first()
    bits = own["bits"] if own else 1
    counts = aligned.select("pairs").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("documents"))
    counts = counts.select("pair", F.expr(f"int(shiftright(pair, {bits}))").alias("a"), F.expr(f"int(pair & {(1 << bits) - 1}L)").alias("b"),
                           "documents")
    most = F.max("documents").over(Window.partitionBy("a"))  # at most B's vocabulary
    return settled(counts.withColumn("best", F.col("documents") == most))


class Counts:
    """Counts of some pairs, sorted by pair."""

    def __init__(self, pairs: np.ndarray, documents: np.ndarray, best: np.ndarray):
        order = np.argsort(pairs)
        self.pairs, self.documents, self.best = pairs[order], documents[order], best[order]

    def of(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known, documents, best) of each pair."""
        if not len(self.pairs):
            return np.zeros(len(pairs), bool), np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        known = self.pairs[at] == pairs
        return known, np.where(known, self.documents[at], 0), known & self.best[at]


def commonest(counts: DataFrame, most: int) -> tuple[Counts, DataFrame | None]:
    """At most ``most`` of the commonest pairs, and a table of the others, if any."""
    step = F.floor(F.log2("documents") * 4)
    steps = sorted(((r["step"], r["n"]) for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
    total, least = 0, 1 << 20
    for s, n in steps:
        if total + n > most:
            break
        total, least = total + n, s
    hot = counts.where(step >= least).select("pair", "documents", "best").toArrow()
    known = Counts(*(hot.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("pair", "documents", "best")))
    return known, None if steps == [] or least == steps[-1][0] else counts.where(step < least)


def links(aligned: DataFrame, without: Counts | None = None) -> DataFrame:
    """``row, pair, times``: the distinct links of every document, but for the pairs in ``without``."""
    get = shared(aligned.sparkSession, without) if without else None

    def run(batches):
        known = get() if get else None
        for batch in batches:
            off, pairs = _unpacked(batch.column("pairs"))
            times = np.frombuffer(utf8(batch.column("times"))[1].tobytes(), "<u4").astype(np.int64)
            row = np.repeat(batch.column("row").to_numpy(), np.diff(off))
            if known:
                open_ = ~known.of(pairs)[0]
                row, pairs, times = row[open_], pairs[open_], times[open_]
            for i in range(0, len(row), LINKS):
                yield pa.RecordBatch.from_arrays([pa.array(x[i: i + LINKS]) for x in (row, pairs, times)], ["row", "pair", "times"])

    return aligned.select("row", "pairs", "times").mapInArrow(run, "row bigint, pair bigint, times bigint")


def digest(aligned: DataFrame, hot: int = HOT) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``
    of every document."""
    counts = pair_counts(aligned)
    known, others = commonest(counts, hot)
    get = shared(aligned.sparkSession, known)
    plain = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def run(batches):
        known = get()
        for batch in batches:
            off, pairs = _unpacked(batch.column("pairs"))
            times = np.frombuffer(utf8(batch.column("times"))[1].tobytes(), "<u4").astype(np.int64)
            _, documents, best = known.of(pairs)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in plain), pa.array(sums(times * best, off)), pa.array(sums(times * documents, off))],
                [*plain, "n_best", "count_sum"])

    schema = "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint"
    out = aligned.select(*plain, "pairs", "times").mapInArrow(run, schema)
    if others is not None:
        rest = links(aligned, known).join(others.select("pair", "documents", "best"), "pair").groupBy("row").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("documents")).alias("more_sum"))
        more = [(F.col(c) + F.coalesce(F.col(m), F.lit(0))).alias(c) for c, m in (("n_best", "more_best"), ("count_sum", "more_sum"))]
        out = out.join(rest, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *more, "groups_sha256")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
