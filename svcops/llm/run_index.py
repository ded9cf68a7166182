"""A run-length index of many short texts, for one bounded bucket.

The texts, each with an owner number, are written one after another, each with
an end mark. Their Burrows-Wheeler transform is kept as runs: first row, and where
the last-to-first mapping leads from it; with the run of each row that is all an LF-step
needs, from the row of a suffix to the row of the suffix one symbol longer. Sampled
are, for every text, the row of its last window (the suffix of ``depth`` symbols) and, for
every range of rows that share their first ``depth`` symbols, the smallest owner
in it. A range's end is where matches end, so the samples are run ends of the
matching statistics.

``marks`` streams every text from its last window to its first: the window's
matching statistic against the texts of smaller owners reaches ``depth`` exactly
if its row lies in a range whose smallest owner is smaller.
"""

from __future__ import annotations

import numpy as np


def sorted_order(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of numbers from 0 on, and the numbers in that order."""
    bits = max(len(values) - 1, 0).bit_length()
    if int(values.max(initial=0)).bit_length() + bits < 64:  # a number with its place is one integer
        both = values << bits | np.arange(len(values))
        both.sort()
        return both & ((1 << bits) - 1), both >> bits
    order = np.argsort(values, kind="stable")
    return order, values[order]


def _ranks(key: np.ndarray) -> np.ndarray:
    """Dense ranks of the keys."""
    order, key = sorted_order(key)
    out = np.empty(len(key), np.int32)
    out[order] = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]), dtype=np.int32)
    return out


def _next(rank: np.ndarray, room: np.ndarray, step: int) -> np.ndarray:
    """For each suffix, 1 + the rank of what follows its first ``step`` symbols; 0 beyond the end."""
    out = np.zeros(len(rank), np.int32)
    if step < len(rank):
        out[: len(rank) - step] = rank[step:] + 1
    out[room <= step] = 0
    return out


class RunIndex:
    """Texts ``data[off[i]:off[i+1]]`` of small whole numbers with owners, none shorter than ``depth``."""

    def __init__(self, data: np.ndarray, off: np.ndarray, owner: np.ndarray, depth: int):
        size = np.diff(off)
        texts, n = len(size), len(data) + len(size)
        self.count, self.depth, self.owner = size - depth + 1, depth, owner
        ends = off[1:] + np.arange(texts)  # of the end marks
        letters = np.bincount(data, minlength=1) > 0
        letters = (np.cumsum(letters) * letters).astype(np.int16)
        symbol = np.zeros(n, np.int16)
        inside = np.ones(n, bool)
        inside[ends] = False
        symbol[inside] = letters[data]
        text = np.repeat(np.arange(texts, dtype=np.int32), size + 1)
        room = np.repeat(ends + 1, size + 1) - np.arange(n)  # symbols up to and with the end mark

        bits = max(1, int(letters.max()).bit_length())
        step = min(max(1, (63 - n.bit_length()) // bits), depth)
        key = np.zeros(n, np.int64)
        for k in range(step):
            key <<= bits
            key[: n - k] |= np.where(room[: n - k] > k, symbol[k:], 0)
        rank, same, longest = _ranks(key), None, int(size.max(initial=0)) + 1
        width = (n + 1).bit_length()
        while True:
            if step <= depth <= 2 * step:  # equal first ``depth`` symbols
                same = rank, _next(rank, room, depth - step)
            key = rank.astype(np.int64) << width | _next(rank, room, step)
            if 2 * step >= longest:
                break
            rank = _ranks(key)
            step *= 2
        order, _ = sorted_order(key)  # equal suffixes: in the order of their texts
        if same is None:
            same = rank, rank
        row = np.empty(n, np.int64)
        row[order] = np.arange(n)
        before = np.concatenate([symbol[-1:], symbol[:-1]])  # a text's first symbol has an end mark before it
        bwt = before[order]
        starts = np.concatenate([[True], bwt[1:] != bwt[:-1]])
        self.run_start, self.run = np.flatnonzero(starts), np.cumsum(starts, dtype=np.int32) - 1
        run_symbol = bwt[self.run_start]
        length = np.diff(np.concatenate([self.run_start, [n]]))
        by_symbol, _ = sorted_order(run_symbol.astype(np.int64))
        self.run_target = np.empty(len(length), np.int64)  # where LF leads from the run's first row
        self.run_target[by_symbol] = np.cumsum(length[by_symbol]) - length[by_symbol]
        a, b = same[0][order], same[1][order]
        starts = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        self.match = np.cumsum(starts, dtype=np.int32) - 1
        self.match_owner = np.minimum.reduceat(owner[text[order]], np.flatnonzero(starts))
        self.last_row = row[ends - depth]

    def lf(self, row: np.ndarray) -> np.ndarray:
        """Row of the suffix one symbol longer."""
        run = self.run[row]
        return self.run_target[run] + row - self.run_start[run]

    def marks(self) -> np.ndarray:
        """For each text a mask: bit j is set if the window that starts at its
        symbol j also occurs in a text of a smaller owner."""
        out = np.zeros(len(self.owner), np.uint64)
        at = np.arange(len(self.owner))
        row = self.last_row.copy()
        left = self.count - 1  # the window's number
        while len(at):
            hit = self.match_owner[self.match[row]] < self.owner[at]
            out[at[hit]] |= np.uint64(1) << left[hit].astype(np.uint64)
            more = left > 0
            at, row, left = at[more], self.lf(row[more]), left[more] - 1
        return out
