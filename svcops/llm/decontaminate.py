"""Benchmark decontamination by q-gram lemma filtering.

Benchmark items and documents are lower-cased and their white space is
collapsed. Every run of ``SEGMENT`` characters of an item, one at each position, is
a segment (a shorter item is one segment), so an excerpt of ``SEGMENT`` characters
or more counts as a leak wherever it starts in the item; shorter ones of a longer
item needn't be found. A segment of m characters occurs in a document if some stretch of
the document is within e = floor(``ERROR_SHARE`` * m) edits of it. By the q-gram
lemma such a stretch shares at least m - q + 1 - e*q q-grams with the segment,
all on e + 1 neighbouring diagonals (document position minus segment position).
The item's q-grams are indexed once by position in the item; hits are counted in
overlapping bands of 2(e + 1) diagonals of the item, and the segments that reach
the bound there are kept. Those that occur unchanged are compared directly. Of the
others up to ``TOGETHER`` neighbouring ones are aligned at once: what they have in
common is no dearer than any of them, so if its banded alignment exceeds the
budget all are out (items that share a stem with the document end here); the rest
is aligned one by one. Hits are counted in parts of the text that hold a bounded
number of them.

The benchmark is read in blocks of bounded size, each a broadcast index, built
one after another, and every block meets all documents; documents are never
shuffled.

Defined results: a null or empty item, or one of fewer than q characters,
matches nothing; a null or empty document has no match; repeated rows of items and
of documents each give rows of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from svcops.llm.common import chunks, mixed, shared, utf8
from svcops.session import settled

Q = 8
SEGMENT = 64
#: Characters between the starts of segments; more than 1 would miss excerpts.
STRIDE = 1
ERROR_SHARE = 0.08
#: Characters of benchmark text in one broadcast index.
BLOCK_CHARS = 2_000_000
#: Neighbouring segments whose common part is aligned first.
TOGETHER = 24
#: Hits of q-grams that are counted at a time, about.
HITS = 1 << 20
_BITMAP = 1 << 22
_NOTHING = np.uint32(0xFFFFFFFF)


def plain(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def qgrams(c: np.ndarray, q: int) -> np.ndarray:
    """Hash of each run of q characters."""
    if len(c) < q:
        return np.zeros(0, np.uint64)
    h, width = c.astype(np.uint64), 1
    base = pow(0x100000001B3, 1)
    while width < q:
        step = min(width, q - width)
        h = h[:-step] * np.uint64(pow(base, step, 1 << 64)) + (h[step:] if step == width else _tail(c, step, len(h) - step, width))
        width += step
    return mixed(h)


def _tail(c: np.ndarray, step: int, n: int, width: int) -> np.ndarray:
    """Polynomial of the ``step`` characters that follow the first ``width``."""
    t = np.zeros(n, np.uint64)
    for k in range(step):
        t = t * np.uint64(0x100000001B3) + c[width + k: width + k + n].astype(np.uint64)
    return t


def budget(m: int, q: int, share: float) -> int:
    """Most edits allowed for m characters: the share of m, but so many that
    the lemma's bound stays positive."""
    return max(0, min(int(share * m), (m - q) // q))


class Index:
    """Items (id, text, how often the table has it) of one block and their q-grams."""

    def __init__(self, items: list[tuple], q: int = Q, segment: int = SEGMENT, share: float = ERROR_SHARE):
        self.q, self.ids = q, [x[0] for x in items]
        self.copies = np.array([x[2] for x in items], np.int64)
        text = [codes(plain(x[1])) for x in items]
        length = np.array([len(t) for t in text], np.int64)
        self.start = np.cumsum(length) - length  # of each item in self.text
        self.text = np.concatenate([*text, np.zeros(0, np.uint32)])
        self.size = np.minimum(length, segment)  # of the item's segments
        self.edits = np.array([budget(int(m), q, share) for m in self.size], np.int64)
        self.least = self.size - q + 1 - self.edits * q
        self.last = length - self.size  # where the last segment starts
        self.count = np.where(length < q, 0, self.last // STRIDE + 1 + (self.last % STRIDE > 0)).astype(np.int32)
        grams = [qgrams(t, q) for t in text]
        gram = np.concatenate([*grams, np.zeros(0, np.uint64)])
        order = np.argsort(gram, kind="stable")
        n = np.array([len(g) for g in grams], np.int64)
        self.gram = gram[order]
        self.item = np.repeat(np.arange(len(text), dtype=np.int32), n)[order]
        self.pos = _ranks(n).astype(np.int32)[order]
        _, repeats = np.unique(self.gram, return_counts=True)
        self.repeats = np.repeat(repeats, repeats).astype(np.int32)  # at each entry, how often its gram occurs
        self.bitmap = np.zeros(_BITMAP, bool)
        self.bitmap[gram & np.uint64(_BITMAP - 1)] = True

    def bands(self, c: np.ndarray, doc: np.ndarray, off: np.ndarray):
        """Candidates (document, item, start of the segment, first diagonal of
        the band), diagonals counted from the document's start; and the hits
        among them (document, item, position in the item, place in the document).
        Parts of the text overlap by more than a segment's occurrence, so each is
        whole in one of them; what two parts find is the same."""
        h = qgrams(c, self.q)
        at = np.flatnonzero(self.bitmap[h & np.uint64(_BITMAP - 1)])
        h, own = h[at], doc[at]
        lo = np.searchsorted(self.gram, h, "left")
        n = np.where((lo < len(self.gram)) & (at + self.q <= off[1:][own]), self.repeats[np.minimum(lo, len(self.gram) - 1)], 0).astype(np.int64)
        n[n > 0] *= self.gram[lo[n > 0]] == h[n > 0]
        at, own, lo, n = (x[n > 0] for x in (at, own, lo, n))
        overlap = int(self.size.max() + 2 * self.edits.max()) + 2 * self.q + 2
        upto = np.cumsum(n)
        found, i = [], 0
        while i < len(at):
            j = int(np.searchsorted(upto, upto[i] - n[i] + HITS, "right"))
            j = max(j, int(np.searchsorted(at, at[i] + 2 * overlap)))
            found.append(self._bands(at[i:j], own[i:j], lo[i:j], n[i:j], off))
            if j >= len(at):
                break
            i = max(i + 1, int(np.searchsorted(at, at[j] - overlap)))
        if len(found) == 1:
            return found[0]
        empty = np.zeros((4, 0), np.int64)
        return tuple(tuple(np.unique(np.concatenate([empty, *(np.stack(f[k]) for f in found)], axis=1), axis=1)) for k in (0, 1))

    def _bands(self, at: np.ndarray, own: np.ndarray, lo: np.ndarray, n: np.ndarray, off: np.ndarray):
        """``bands`` of the q-grams at the places ``at`` of the text, each with ``n``
        entries of the index from ``lo`` on."""
        entry = np.repeat(lo, n) + _ranks(n)
        place = np.repeat(at - off[:-1][own], n)
        own, item, pos = np.repeat(own, n), self.item[entry].astype(np.int64), self.pos[entry].astype(np.int64)
        width = self.edits[item] + 1
        pad = int(self.size.max() + self.last.max()) + 1
        band = (place - pos) // width + pad  # positive
        room = int(np.diff(off).max(initial=0)) + 2 * pad
        key = (own * len(self.size) + item) * room + band
        # most hits stand alone: a count by hash leaves few to sort
        slot = [(mixed((key - k).view(np.uint64)) >> np.uint64(44)).astype(np.int64) for k in (0, 1)]
        count = np.bincount(slot[0], minlength=1 << 20) + np.bincount(slot[1], minlength=1 << 20)
        hit = [np.flatnonzero(count[slot[k]] >= self.least[item]) for k in (0, 1)]
        key, hit = np.concatenate([key[hit[0]], key[hit[1]] - 1]), np.concatenate(hit)
        order = np.lexsort((pos[hit], key))
        key, hit = key[order], hit[order]
        own, item, pos, place = own[hit], item[hit], pos[hit], place[hit]
        # hits i .. i + least - 1 of a band lie in the segments that start from lo to hi
        i = np.arange(len(key))
        end = i + self.least[item] - 1
        i = i[end < len(key)]
        end = end[end < len(key)]
        together = key[i] == key[end]
        i, end = i[together], end[together]
        lo = np.maximum(pos[end] - (self.size - self.q)[item[i]], 0)
        hi = np.minimum(pos[i], self.last[item[i]])
        good = lo <= hi
        i, lo, hi = i[good], lo[good], hi[good]
        if len(i) > 1:  # both grow inside a band: each segment once
            lo[1:] = np.where(key[i[1:]] == key[i[:-1]], np.maximum(lo[1:], hi[:-1] + 1), lo[1:])
        n = np.maximum(hi - lo + 1, 0)
        which, a = np.repeat(i, n), np.repeat(lo, n) + _ranks(n)
        some = (a % STRIDE == 0) | (a == self.last[item[which]])
        which, a = which[some], a[some]
        first = (key[which] % room - pad) * (self.edits[item[which]] + 1)
        kept = np.isin(key, key[i])
        return (own[which], item[which], a, first), (own[kept], item[kept], pos[kept], place[kept])

    def same(self, c: np.ndarray, off: np.ndarray, doc: np.ndarray, item: np.ndarray, pos: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether the segment that starts at each hit stands in the document unchanged."""
        size = self.size[item]
        good = (pos <= self.last[item]) & (off[:-1][doc] + place + size <= off[1:][doc])
        good &= (pos % STRIDE == 0) | (pos == self.last[item])
        at = np.flatnonzero(good)
        x, y = (off[:-1][doc] + place)[at], (self.start[item] + pos)[at]
        for k in range(int(size.max(initial=0))):
            if not len(at):
                break
            equal = (k >= size[at]) | (c[np.minimum(x + k, len(c) - 1)] == self.text[np.minimum(y + k, len(self.text) - 1)])
            good[at[~equal]] = False
            at, x, y = at[equal], x[equal], y[equal]
        return good

    def align(self, c: np.ndarray, off: np.ndarray, doc: np.ndarray, item: np.ndarray, a: np.ndarray, first: np.ndarray,
              size: np.ndarray | None = None):
        """Fewest edits of each candidate's segment (or of ``size`` characters from
        ``a`` on) against any stretch of the document that starts on the band's
        diagonals, and where that ends."""
        edits = np.zeros(len(item), np.int64)
        end = np.zeros(len(item), np.int64)
        padded = np.concatenate([c, [_NOTHING]])
        for e in np.unique(self.edits[item]):
            own = np.flatnonzero(self.edits[item] == e)
            for part in np.array_split(own, max(1, len(own) // 4096 + 1)):
                edits[part], end[part] = self._align(padded, off, doc[part], item[part], a[part], first[part] + a[part] - e, 2 * (e + 1) + 2 * e,
                                                     self.size[item[part]] if size is None else size[part])
        return edits, end

    def possible(self, c: np.ndarray, off: np.ndarray, doc: np.ndarray, item: np.ndarray, a: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Which candidates may keep the budget: up to ``TOGETHER`` neighbours of a
        band are judged by the part that all of them contain."""
        if not len(a):
            return np.zeros(0, bool)
        key = np.stack([doc, item, first, a // TOGETHER])
        order = np.lexsort(np.vstack([a, key[::-1]]))
        sorted_ = key[:, order]
        head = np.concatenate([[True], (sorted_[:, 1:] != sorted_[:, :-1]).any(axis=0)])
        group = np.empty(len(a), np.int64)
        group[order] = np.cumsum(head) - 1
        at = order[head]
        lowest, highest = a[at], a[order[np.append(np.flatnonzero(head)[1:], len(a)) - 1]]
        edits, _ = self.align(c, off, doc[at], item[at], highest, first[at], self.size[item[at]] - (highest - lowest))
        return (edits <= self.edits[item[at]])[group]

    def _align(self, c, off, doc, item, a, first, width, size):
        start, stop = off[:-1][doc][:, None], off[1:][doc][:, None]
        k = np.arange(width, dtype=np.int16)
        row = np.zeros((len(item), width), np.int16)
        best = np.zeros((len(item), width), np.int16)
        for i in range(1, int(size.max(initial=0)) + 1):
            at = start + first[:, None] + k + i - 1
            there = np.where((at >= start) & (at < stop), c[np.clip(at, 0, len(c) - 1)], _NOTHING - np.uint32(1))
            new = row + (there != self.text[np.minimum(self.start[item] + a + i - 1, len(self.text) - 1)][:, None])
            new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + np.int16(1))
            row = np.minimum.accumulate(new - k, axis=1) + k
            done = size == i
            best[done] = row[done]
        at = best.argmin(axis=1)
        return best[np.arange(len(item)), at], first + size + at

    def matches(self, texts: list[str]):
        """(document, item, segments found, edits in them, end of the first) for each leak."""
        c = codes("".join(texts))
        off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        if not len(c) or not len(self.gram):
            return []
        doc = np.repeat(np.arange(len(texts)), np.diff(off))
        (doc, item, a, first), hits = self.bands(c, doc, off)
        most = len(self.text) + 1
        equal = self.same(c, off, *hits)
        d, n, pos, place = (x[equal] for x in hits)
        exact = (d * len(self.size) + n) * most + pos
        key = (doc * len(self.size) + item) * most + a
        open_ = np.flatnonzero(~np.isin(key, exact))
        open_ = open_[self.possible(c, off, doc[open_], item[open_], a[open_], first[open_])]
        key = key[open_]
        edits, end = self.align(c, off, doc[open_], item[open_], a[open_], first[open_])
        good = edits <= self.edits[item[open_]]
        key = np.concatenate([exact, key[good]])
        edits, end = np.concatenate([np.zeros(len(exact), np.int64), edits[good]]), np.concatenate([place + self.size[n], end[good]])
        order = np.lexsort((end, edits, key))  # the best place of each segment first
        order = order[np.diff(key[order], prepend=-1) != 0]
        key, edits, end = key[order] // most, edits[order], end[order]
        head = np.flatnonzero(np.diff(key, prepend=-1))
        if not len(head):
            return []
        found = np.diff(np.append(head, len(key)))
        return list(zip((key[head] // len(self.size)).tolist(), (key[head] % len(self.size)).tolist(), found.tolist(),
                        np.add.reduceat(edits, head).tolist(), np.minimum.reduceat(end, head).tolist(), strict=True))


def _ranks(n: np.ndarray) -> np.ndarray:
    """0..n[i]-1 for each i, one after another."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


class Blocks:
    """The benchmark's indexes, each built when its turn comes; items are dealt to
    blocks by a hash, so each holds about ``limit`` characters. Equal rows are one
    item with a number of copies."""

    def __init__(self, bench: DataFrame, id_col: str, text_col: str, limit: int):
        items = bench.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
        self.items = settled(items.where(F.length("text") > 0).groupBy("id", "text").agg(F.count("*").alias("copies")))
        self.n = -(-(self.items.agg(F.sum(F.length("text"))).first()[0] or 0) // limit)

    def __len__(self) -> int:
        return self.n

    def __iter__(self):
        block = F.pmod(F.xxhash64("id", "text"), F.lit(max(self.n, 1)))
        for i in range(self.n):
            rows = (tuple(r) for r in self.items.where(block == i).collect())
            yield Index(sorted(rows, key=lambda x: (x[0] is not None, x)))


def blocks(bench: DataFrame, id_col: str = "item_id", text_col: str = "text", limit: int = BLOCK_CHARS) -> Blocks:
    return Blocks(bench, id_col, text_col, limit)


def _scan(index: Index, column):
    """Leaks of one Arrow text column, rows numbered from its start."""
    off, _ = utf8(column)
    for i, j in chunks(off):
        for d, *rest in index.matches([plain(t) for t in column[i:j].to_pylist()]):
            yield (i + d, *rest)


def leaks(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, n_segments, n_found, edits, end_pos``: one row for
    each document and benchmark item that share a segment; ``end_pos`` is where
    the first ends in the lower-cased text with collapsed white space."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kinds = rows.schema["doc_id"].dataType.simpleString(), bench.schema[item_col].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, n_segments int, n_found int, edits int, end_pos bigint"
    out = docs.sparkSession.createDataFrame([], schema)
    for index in blocks(bench, item_col, item_text_col):
        get = shared(docs.sparkSession, index)

        def run(batches, get=get):
            index = get()
            for batch in batches:
                found = list(_scan(index, batch.column("text")))
                found = [x for x in found for _ in range(index.copies[x[1]])]
                d, n, hits, edits, end = (list(x) for x in zip(*found, strict=True)) if found else ([],) * 5
                ids = pa.array([index.ids[i] for i in n])
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array(d, pa.int64())), ids, pa.array(index.count[n]),
                         pa.array(hits, pa.int32()), pa.array(edits, pa.int32()), pa.array(end, pa.int64())],
                        ["doc_id", "item_id", "n_segments", "n_found", "edits", "end_pos"])

        out = out.union(rows.mapInArrow(run, schema))
    return out


def drop_leaks(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that share a segment with any item; no shuffle."""
    parts = blocks(bench, item_col, item_text_col)
    for i, index in enumerate(parts):
        get = shared(docs.sparkSession, index)

        def run(batches, get=get):
            index = get()
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[x[0] for x in _scan(index, batch.column(text_col))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
        if i + 1 < len(parts):  # a task holds one index at a time
            docs = settled(docs)
    return docs
