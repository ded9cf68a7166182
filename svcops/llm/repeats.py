"""Removal of repeated passages: every byte covered by a string of ``LENGTH``
bytes that also starts in a document with a smaller id.

Texts are dealt by a hash of the id to blocks of about ``BLOCK_BYTES``. Blocks
and buckets exchange packed arrays in rounds, each a shuffle:

1. Anchors. In every window of ``LENGTH`` bytes the k-gram of the smallest hash is
   an anchor, so equal windows have equal anchors at equal places. Blocks send
   the 32-bit keys of their anchors to buckets by hash; a bucket answers which
   keys occur in one document only (most; they are done), in several, or in
   more than ``HOT`` places.
2. Contexts. The context of an anchor is all bytes of windows around it. Blocks
   send a 64-bit hash of each context of a repeated anchor with the smallest id
   that has it; of hot anchors they send the windows themselves, as hashes, so
   that no bucket gets all contexts of a hot passage. A bucket answers which
   contexts have an equal in a smaller document (all their windows go), which
   are alone with their anchor, and which must be looked into, with the anchors'
   places, so that blocks needn't search for anchors again.
3. Index. For those, the document of the smallest id sends the bytes. Each
   bucket builds a run-length Burrows-Wheeler index of them, in which an anchor
   is a few symbols, and streams them through it (``run_index``): the answer is a
   mask of the windows that start in a smaller document.
4. Blocks unite the windows to spans and cut them out.

A block or a bucket holds a bounded number of bytes, whatever the corpus; a
hot key has one row per block. Equal windows decided by 64-bit hashes (steps 2)
are compared within one anchor only. A message is a row of packed arrays for each
block and bucket, so there are blocks x buckets rows a round; they are packed and
unpacked all at once, and each bucket answers a round once.

Defined results: null text counts as empty; a text shorter than ``LENGTH`` bytes
loses nothing; rows that share an id don't remove bytes from each other; rows of
a null id count as larger than all others, and equal among themselves; a text
longer than a block is a block of its own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from svcops.llm.common import chunks, mixed, powers, utf8
from svcops.llm.run_index import RunIndex, sorted_order

LENGTH = 50
K = 32
BLOCK_BYTES = 6_000_000
BUCKET_BYTES = 12_000_000
HOT = 3000
#: Bytes hashed at a time, so that their arrays stay in a core's cache.
PIECE = 1 << 15
_LAST = np.int64(np.iinfo(np.int64).max)  # stands for a null id


def kgram_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k-gram."""
    base = int(powers(2)[1])
    parts, h, width = {}, raw.astype(np.uint64) + np.uint64(1), 1
    while width <= k:
        parts[width] = h
        if 2 * width <= k:
            h = h[:-width] * np.uint64(pow(base, width, 1 << 64)) + h[width:]
        width *= 2
    width //= 2
    h, done = parts[width], width
    while done < k:
        width = 1 << ((k - done).bit_length() - 1)
        n = len(raw) - done - width + 1
        h = h[:n] * np.uint64(pow(base, width, 1 << 64)) + parts[width][done: done + n]
        done += width
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    return h


def sliding(a: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (minimum or maximum) of each ``width`` neighbours."""
    n = 1
    while 2 * n <= width:
        a = best(a[:-n], a[n:])
        n *= 2
    return best(a[: len(a) - (width - n)], a[width - n:]) if n < width else a


def anchors(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors of all texts, ascending, and the hashes of all k-grams."""
    w = LENGTH - K + 1
    places, grams = [np.zeros(0, np.int64)], np.empty(len(raw), np.uint64)
    past = -1  # the last anchor so far
    # texts one after another in pieces that overlap by a window
    for a, b in _pieces(off):
        h = kgram_hashes(raw[a:b], K)
        grams[a: a + len(h)] = h
        value = (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        least = np.zeros(len(value) + w - 1, np.uint32)
        own = least[w - 1: len(value)]  # by the window's start
        own[:] = sliding(value, w, np.minimum)
        ends = off[np.searchsorted(off, a, "right"): np.searchsorted(off, b + LENGTH, "left")]
        over = (ends[:, None] - np.arange(1, LENGTH)).ravel() - a  # windows that cross a text's end
        own[over[(over >= 0) & (over < len(own))]] = 0
        at = np.flatnonzero(sliding(least, w, np.maximum) == value)
        at = at[np.searchsorted(at, past + 1 - a):]  # neighbouring pieces share some
        if len(at):
            places.append(at + a)
            past = int(at[-1]) + a
    return np.concatenate(places), grams


def _pieces(off: np.ndarray):
    n, at = int(off[-1]), 0
    while at + LENGTH <= n:
        yield at, min(at + PIECE + LENGTH - 1, n)
        at += PIECE


def _changes(*sorted_: np.ndarray) -> np.ndarray:
    """Where groups of equal rows of the sorted columns begin."""
    new = np.zeros(len(sorted_[0]), bool)
    new[:1] = True
    for a in sorted_:
        new[1:] |= a[1:] != a[:-1]
    return new


def _keyed_order(key: np.ndarray, h: np.ndarray) -> np.ndarray:
    """An order by (key, hash); equal rows are in any order."""
    order = np.argsort(h)
    return order[sorted_order(key[order])[0]]


class Texts:
    """The texts of a block in the order of their ids."""

    def __init__(self, table: pa.Table):
        ids = table.column("id").combine_chunks()
        number = ids.fill_null(int(_LAST)).to_numpy().astype(np.int64)
        rows = np.lexsort((table.column("size").to_numpy(), number))
        self.table = table.take(pa.array(rows))
        self.ids = number[rows]
        self.off, self.raw = utf8(self.table.column("text"))

    def around(self, place: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Beginnings and ends of the contexts of anchors."""
        return np.maximum(self.off[doc], place - (LENGTH - K)), np.minimum(self.off[doc + 1], place + LENGTH)


class Block(Texts):
    """And their anchors."""

    def __init__(self, table: pa.Table, buckets: int):
        super().__init__(table)
        self.place, self.grams = anchors(self.raw, self.off)
        h = self.grams[self.place]
        self.doc = np.repeat(np.arange(len(self.ids)), np.diff(np.searchsorted(self.place, self.off)))
        self.begin, self.end = self.around(self.place, self.doc)
        # distinct keys in the order of (bucket, key), and each anchor's key
        whole = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64) << 32 | (h & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self.order, whole = sorted_order(whole)
        new = _changes(whole)
        self.keys, self.first = whole[new], np.flatnonzero(new)
        self.key = np.empty(len(whole), np.int64)
        self.key[self.order] = np.cumsum(new) - 1
        self.buckets = buckets

    def key_counts(self) -> np.ndarray:
        """Of each key: up to 127 occurrences, plus 128 if several documents have it."""
        n = np.diff(self.first, append=len(self.order))
        least, most = (self.ids[self.doc[self.order[at]]] for at in (self.first, self.first + n - 1))
        several = least != most
        return (np.minimum(n, 127) + 128 * several).astype(np.uint8)

    def contexts(self, state: np.ndarray):
        """Distinct contexts of the repeated anchors: their keys, hashes, smallest
        ids and first anchors, sorted by (bucket, key, hash); then the repeated anchors
        and each one's context."""
        at = np.flatnonzero(state[self.key] == 1)
        h = self.hashes(self.begin[at], self.end[at])
        order = _keyed_order(self.key[at], h)
        at, h = at[order], h[order]
        new = _changes(self.key[at], h)
        start = np.flatnonzero(new)
        first = np.minimum.reduceat(at, start) if len(at) else at  # texts are in the order of ids
        return self.key[first], h[start], self.ids[self.doc[first]], first, at, np.cumsum(new) - 1

    def windows(self, state: np.ndarray):
        """Distinct windows around hot anchors, sorted by (bucket, hash): buckets, hashes, smallest
        ids; then all their starts and each one's window."""
        hot = np.flatnonzero(state[self.key] == 2)
        start = self.starts(self.begin[hot], self.end[hot])
        h = self.hashes(start, start + LENGTH)
        order = np.argsort(h)
        start, h = start[order], h[order]
        new = _changes(h)
        first = np.flatnonzero(new)
        least = np.minimum.reduceat(start, first) if len(h) else start
        h = h[first]
        bucket = ((h >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int64)
        return bucket, h, self.ids[np.searchsorted(self.off, least, "right") - 1], start, np.cumsum(new) - 1

    def starts(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The starts of all windows of the contexts, ascending."""
        some = np.zeros(len(self.raw), bool)
        last = end - LENGTH - begin
        for j in range(LENGTH - K + 1):
            some[begin[last >= j] + j] = True
        return np.flatnonzero(some)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges from a window's to a context's length: three k-grams cover one."""
        h = self.grams[start] * np.uint64(0x9E3779B97F4A7C15)
        h += self.grams[start + (LENGTH - K)] * np.uint64(0xC2B2AE3D27D4EB4F)
        h += self.grams[end - K] * np.uint64(0x165667B19E3779F9)
        return mixed(h + (end - start).astype(np.uint64))


def _values(table: pa.Table, column: str, kind) -> tuple[np.ndarray, np.ndarray]:
    """A binary column's arrays joined, and the offsets of each row's part."""
    off, raw = utf8(table.column(column).cast(pa.binary()))
    kind = np.dtype(kind)
    return np.frombuffer(raw.tobytes(), kind), off // kind.itemsize


def _binary(values: np.ndarray, off: np.ndarray) -> pa.ChunkedArray:
    """The array of each part of ``values`` as bytes."""
    raw = np.ascontiguousarray(values).view(np.uint8)
    off = np.asarray(off, np.int64) * values.itemsize
    parts = []
    for i, j in chunks(off, 1 << 30):
        own = off[i: j + 1]
        buffers = [None, pa.py_buffer((own - own[0]).astype(np.int32)), pa.py_buffer(raw[own[0]: own[-1]])]
        parts.append(pa.Array.from_buffers(pa.binary(), j - i, buffers))
    return pa.chunked_array(parts, pa.binary())


def _answers(told: pa.Table, round_: int, which: str, kind) -> np.ndarray:
    """One value for each entry that the block asked for in a round, from the buckets' answers."""
    own = told.filter(pc.equal(told.column("round"), round_))
    return _values(own.sort_by("bucket"), which, kind)[0]


_ASK = "bucket int, block int, a binary, b binary, c binary, d binary, e binary, f binary"
_TELL = "block int, round int, bucket int, x binary, y binary, z binary"
_ASK_ARROW = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), *((c, pa.binary()) for c in "abcdef")])
_TELL_ARROW = pa.schema([("block", pa.int32()), ("round", pa.int32()), ("bucket", pa.int32()), *((c, pa.binary()) for c in "xyz")])


def _ask(block: int, buckets: int, *columns: tuple[np.ndarray, np.ndarray]) -> pa.Table:
    """A row for each bucket that is asked something; columns are arrays with their
    offsets by bucket."""
    some = np.zeros(buckets, bool)
    for _, cut in columns:
        some |= np.diff(cut) > 0
    at = np.flatnonzero(some)
    parts = [_binary(x, np.append(cut[at], cut[-1])) for x, cut in columns]  # buckets that aren't asked have nothing between
    parts += [pa.nulls(len(at), pa.binary())] * (6 - len(columns))
    return pa.table([pa.array(at, pa.int32()), pa.array(np.full(len(at), block), pa.int32()), *parts], schema=_ASK_ARROW)


def _cut(bucket_of: np.ndarray, buckets: int) -> np.ndarray:
    """Offsets by bucket of sorted bucket numbers."""
    return np.searchsorted(bucket_of, np.arange(buckets + 1))


def _tell(table: pa.Table, round_: int, *columns: tuple[np.ndarray, np.ndarray]) -> pa.Table:
    """A row for each row of ``table``; columns are arrays with their offsets by row."""
    n = table.num_rows
    parts = [_binary(x, off) for x, off in columns]
    parts += [pa.nulls(n, pa.binary())] * (3 - len(columns))
    return pa.table([table.column("block"), pa.array(np.full(n, round_), pa.int32()), table.column("bucket"), *parts], schema=_TELL_ARROW)


def _block_number(table: pa.Table) -> int:
    return table.column("block")[0].as_py()


# --- round 1: anchors

def _ask_keys(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        block = Block(table, buckets)
        cut = _cut(block.keys >> 32, buckets)
        return _ask(_block_number(table), buckets, ((block.keys & 0xFFFFFFFF).astype(np.uint32), cut), (block.key_counts(), cut))

    return run


def _tell_keys(table: pa.Table) -> pa.Table:
    key, off = _values(table, "a", np.uint32)
    n, _ = _values(table, "b", np.uint8)
    state = np.empty(len(key), np.uint8)
    order, key = sorted_order(key.astype(np.int64))
    start = np.flatnonzero(_changes(key))
    if len(key):
        n = n[order]
        blocks = np.diff(start, append=len(key))
        several = np.maximum.reduceat(n, start) >= 128
        total = np.add.reduceat(n & 127, start, dtype=np.int64)
        state[order] = np.repeat(np.where((blocks > 1) | several, np.where(total > HOT, 2, 1), 0).astype(np.uint8), blocks)
    return _tell(table, 1, (state, off))


# --- round 2: contexts

def _key_states(told: pa.Table) -> np.ndarray:
    return _answers(told, 1, "x", np.uint8)


def _ask_contexts(buckets: int):
    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        block = Block(texts, buckets)
        state = _key_states(told)
        key, h, least, first, *_ = block.contexts(state)
        whole = block.keys[key]
        cut = _cut(whole >> 32, buckets)
        bucket, window, window_least, *_ = block.windows(state)
        window_cut = _cut(bucket, buckets)
        return _ask(_block_number(texts), buckets, ((whole & 0xFFFFFFFF).astype(np.uint32), cut), (h, cut), (least, cut),
                    (window, window_cut), (window_least, window_cut), (block.place[first].astype(np.int32), cut))

    return run


ALONE, GONE, OPEN = 0, 1, 2


def _tell_contexts(table: pa.Table) -> pa.Table:
    key, off = _values(table, "a", np.uint32)
    h, _ = _values(table, "b", np.uint64)
    least, _ = _values(table, "c", np.int64)
    state = np.empty(len(key), np.uint8)
    if len(key):
        order = _keyed_order(key.astype(np.int64), h)
        k, x, least = key[order], h[order], least[order]
        start = np.flatnonzero(_changes(k, x))
        smallest = np.minimum.reduceat(least, start)
        anchor = _changes(k[start])
        several = np.diff(np.flatnonzero(anchor), append=len(start)) > 1
        others = several[np.cumsum(anchor) - 1]
        n = np.diff(start, append=len(k))
        state[order] = np.where(least > np.repeat(smallest, n), GONE, np.repeat(np.where(others, OPEN, ALONE), n))
    window, window_off = _values(table, "d", np.uint64)
    first, _ = _values(table, "e", np.int64)
    gone = np.empty(len(window), np.uint8)
    if len(window):
        order = np.argsort(window)
        first = first[order]
        start = np.flatnonzero(_changes(window[order]))
        gone[order] = first > np.repeat(np.minimum.reduceat(first, start), np.diff(start, append=len(first)))
    place, _ = _values(table, "f", np.int32)
    open_ = np.flatnonzero(state == OPEN)
    return _tell(table, 2, (state, off), (gone, window_off), (place[open_], np.searchsorted(open_, off)))


# --- round 3: the index

def _ask_marks(buckets: int):
    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        block = Texts(texts)
        told = told.filter(pc.equal(told.column("round"), 2)).sort_by("bucket")
        place, cut = _values(told, "z", np.int32)  # of the contexts that are open
        doc = np.searchsorted(block.off, place, "right") - 1
        begin, end = block.around(place.astype(np.int64), doc)
        size = end - begin
        off = np.concatenate([[0], np.cumsum(size)])
        data = block.raw[np.repeat(begin - off[:-1], size) + np.arange(off[-1])]
        bucket = np.repeat(told.column("bucket").to_numpy(), np.diff(cut))
        cut = _cut(bucket, buckets)
        return _ask(_block_number(texts), buckets, (size.astype(np.uint8), cut), (block.ids[doc], cut), (data, off[cut]),
                    ((place - begin).astype(np.uint8), cut))

    return run


def _tell_marks(table: pa.Table) -> pa.Table:
    size, off = _values(table, "a", np.uint8)
    owner, _ = _values(table, "b", np.int64)
    data, _ = _values(table, "c", np.uint8)
    left, _ = _values(table, "d", np.uint8)
    marks = _index(data, size.astype(np.int64), left.astype(np.int64), owner).marks()
    return _tell(table, 3, (marks.astype(np.uint32), off))


#: Digits that stand for an anchor in the index have this base.
BASE = 64


def _index(data: np.ndarray, size: np.ndarray, left: np.ndarray, owner: np.ndarray) -> RunIndex:
    """The index of the contexts, each with its anchor's ``K`` bytes, which every window of
    it contains, written as the digits of their rank among all anchors here. Digits are
    symbols beyond all bytes, so equal windows have equal bytes and the other way round."""
    off = np.concatenate([[0], np.cumsum(size)])
    at = (off[:-1] + left)[:, None]
    grams = data[at + np.arange(K)].view(np.uint64)
    order = np.lexsort(grams.T)
    new = _changes(*grams[order].T)
    rank = np.empty(len(size), np.int64)
    rank[order] = np.cumsum(new) - 1
    digits = 1
    while BASE ** digits < len(size):
        digits += 1
    symbols = data.astype(np.uint16)
    symbols[at + np.arange(digits)] = 256 + rank[:, None] // BASE ** np.arange(digits)[::-1] % BASE
    keep = np.ones(len(data), bool)
    keep[at + np.arange(digits, K)] = False
    short = size - (K - digits)
    return RunIndex(symbols[keep], np.concatenate([[0], np.cumsum(short)]), owner, LENGTH - (K - digits))


# --- the result

def _spans(block: Block, told: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts, beginnings and ends of what goes, ascending."""
    state = _key_states(told)
    key, _, _, first, at, own = block.contexts(state)
    kind = _answers(told, 2, "x", np.uint8)
    mask = np.zeros(len(key), np.uint32)
    mask[kind == OPEN] = _answers(told, 3, "x", np.uint32)
    begin = block.begin[at]
    windows = block.end[at] - begin - LENGTH + 1
    later = (kind[own] == GONE) | (block.ids[block.doc[at]] > block.ids[block.doc[first[own]]])
    bits = np.where(later, (np.uint32(1) << windows.astype(np.uint32)) - np.uint32(1), mask[own])
    some = np.zeros(len(block.raw), bool)  # by the window's start
    begin, bits = begin[bits > 0], bits[bits > 0]
    for j in range(LENGTH - K + 1):
        some[begin[(bits >> np.uint32(j) & np.uint32(1)).astype(bool)] + j] = True
    _, _, least, start, which = block.windows(state)
    gone = _answers(told, 2, "y", np.uint8).astype(bool)
    doc = np.searchsorted(block.off, start, "right") - 1
    some[start[gone[which] | (block.ids[doc] > least[which])]] = True
    start = np.flatnonzero(some)
    doc = np.searchsorted(block.off, start, "right") - 1
    apart = (start[1:] > start[:-1] + LENGTH) | (doc[1:] > doc[:-1])
    edge = np.ones(min(len(start), 1), bool)
    head = np.concatenate([edge, apart])
    return doc[head], start[head], start[np.concatenate([apart, edge])] + LENGTH


_RESULT = [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string")]


def _result(buckets: int, with_text: bool):
    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        block = Block(texts, buckets)
        doc, start, end = _spans(block, told)
        edge = np.zeros(len(block.raw) + 1, np.int8)
        edge[start] = 1
        edge[end] -= 1  # a text may begin with what goes where the one before ends with it
        rest = block.raw[np.cumsum(edge[:-1], dtype=np.int8) == 0]
        removed = np.zeros(len(block.ids), np.int64)
        np.add.at(removed, doc, end - start)
        spans = np.bincount(doc, minlength=len(block.ids))
        off = block.off - np.concatenate([[0], np.cumsum(removed)])
        parts = [rest[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        digest = [hashlib.sha256(x).hexdigest() for x in parts]
        columns = [block.table.column("id").cast(pa.int64()), pa.array(np.diff(block.off), pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest)]
        names = [c for c, _ in _RESULT]
        return pa.table([*columns, _binary(rest, off)], [*names, "kept"]) if with_text else pa.table(columns, names)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False,
                   block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row, and with
    ``with_text`` the remaining bytes ``kept``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("size", F.octet_length("text"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    blocks, buckets = total // block_bytes + 1, total // bucket_bytes + 1
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    block = F.pmod(F.xxhash64("id", "size"), F.lit(blocks)).cast("int")
    texts = rows.select(block.alias("block"), "id", "size", "text").repartition(parts, "block")

    def told_by(asked: DataFrame, answer) -> DataFrame:
        # dealt by block at once: later rounds read this exchange again instead of asking again
        return asked.repartition(parts, "bucket").groupBy("bucket").applyInArrow(answer, _TELL).repartition(parts, "block")

    def with_answers(told: DataFrame, step, schema: str) -> DataFrame:
        return texts.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(step, schema)

    keys = told_by(texts.groupBy("block").applyInArrow(_ask_keys(buckets), _ASK), _tell_keys)
    contexts = told_by(with_answers(keys, _ask_contexts(buckets), _ASK), _tell_contexts)
    marks = told_by(with_answers(contexts, _ask_marks(buckets), _ASK), _tell_marks)
    schema = ", ".join(f"{c} {t}" for c, t in _RESULT) + (", kept binary" if with_text else "")
    return with_answers(keys.union(contexts).union(marks), _result(buckets, with_text), schema)
