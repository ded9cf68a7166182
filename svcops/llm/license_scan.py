"""License scans with a trained paragraph classifier.

A paragraph is a window of ``WINDOW`` words of one line, windows overlapping by
half. A line goes on in the next one where the words on both sides of a single
line feed are neighbours in a notice, so a wrapped notice is one line. A softmax regression over sparse word n-grams tells the licence families
and ``unknown`` apart; it is trained on the families' notices (cut and set in
other text in many ways) against paragraphs from a bounded sample of the
documents, and its probabilities are calibrated on examples kept apart. A
family's paragraph is confirmed by comparison with the family's notices: most
of the shorter one's word pairs must occur in the other.

What a paragraph shares with a notice, or a whole notice of at most
``LEAST_PAIRS`` words in it, is a *mention*. A second softmax regression of the
same kind reads each mention with ``CONTEXT`` words of its line on both sides; it
is trained on notices in other text, and for its own unknown class on notices
that are denied, compared or listed by the dozen (``not under the MIT License``).
A short notice counts only if this classifier names its family with at least
``LEAST_SCORE``; a longer one does not count if it is unknown here. ``All rights
reserved`` that goes on in a public licence is a mention of that licence.

Every word pair of every text is looked up among the notices' pairs first; a
paragraph with fewer than ``LEAST_PAIRS`` of them, and without a whole notice of
fewer pairs (``all rights reserved``, ``mit license``), could not be confirmed and
is ``unknown`` without classification.

Words are lower-cased runs of ASCII letters, digits and non-ASCII characters.

Defined results: null and empty texts have no licence; a text with several
families has a row for each; copies each give rows; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from svcops.llm.common import chunks, mixed, shared, utf8, word_hashes, words
from svcops.llm.softmax import fit, logits, ngram_buckets, softmax, temperature

WINDOW = 24
LEAST_PAIRS = 3
LEAST_SIMILARITY = 0.7
LEAST_SCORE = 0.5
CONTEXT = 5
BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: About so many documents give paragraphs of the unknown class, at most so many paragraphs in all.
SAMPLE_DOCS = 1500
SAMPLE_PARAGRAPHS = 3000
UNKNOWN = "unknown"

# Customary notices of public licences.
NOTICES = {
    "AGPL-3.0": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0.", "Creative Commons Zero v1.0 Universal public domain dedication."],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
        "SPDX-License-Identifier: GPL-2.0",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
        "SPDX-License-Identifier: GPL-3.0",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "LGPL-3.0": [
        "Licensed under the GNU Lesser General Public License, version 3.",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "SPDX-License-Identifier: MIT",
    ],
    "MPL-2.0": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ],
    "Proprietary": ["All rights reserved. No part of this work may be reproduced without written permission."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
# Titles and short forms of the same licences.
for _family, _titles in {
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPL-3.0"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache-2.0", "Apache 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause"],
    "CC-BY-4.0": ["CC BY 4.0"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0"],
    "CC0-1.0": ["CC0 1.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GPL-2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GPL-3.0"],
    "ISC": ["ISC License"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPL-3.0"],
    "MIT": ["MIT License", "MIT Licence", "License: MIT", "Licence: MIT"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "MPL-2.0"],
    "Proprietary": ["All rights reserved."],
    "Unlicense": ["The Unlicense"],
}.items():
    NOTICES[_family] += _titles

# Words that take a licence's name without granting it, before and after it.
BEFORE = ("not", "not under the", "is not", "was not", "are not", "isn t", "never", "no longer", "no longer under the", "not released under the",
          "not licensed under the", "not covered by the", "neither under the", "nor", "nor the", "without the", "rather than the", "instead of the",
          "unlike the", "compared with the", "differs from the", "incompatible with the", "a comparison of the", "a survey of the",
          "surveys", "the history of the", "an article about the", "critics of the", "what is the")
AFTER = ("does not apply", "was rejected", "is not used here", "would be wrong", "was considered", "is compared with")

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[c for c in range(128) if not chr(c).isalnum() and c != 10]] = 32


def folded(text: str) -> np.ndarray:
    return _FOLD[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]


def word_list(text: str) -> list[str]:
    return folded(text).tobytes().decode("utf-8", "replace").split()


def pairs(found: list[str]) -> set[tuple[str, str]]:
    return set(zip(found, found[1:], strict=False))


class Paragraphs:
    """Candidate windows of a batch of folded texts."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, known: np.ndarray | None, short: dict[int, np.ndarray] | None = None):
        starts, ends, woff = words(raw, off)
        doc = np.repeat(np.arange(len(off) - 1), np.diff(woff))
        line = np.concatenate([[0], np.cumsum(raw == 10)])[starts]
        h = word_hashes(raw, starts, ends) if known is not None else None
        pair = np.isin(gram_hashes(h, 2), known) if known is not None else False
        feeds = np.diff(line)
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (feeds > 1) | (feeds == 1) & ~np.bool_(pair)]) if len(starts) else np.zeros(0, bool)
        head = np.flatnonzero(new)
        size = np.diff(np.concatenate([head, [len(starts)]])).astype(np.int64)
        number = np.cumsum(new) - 1  # of the line
        place = np.arange(len(starts)) - head[number] if len(starts) else np.zeros(0, np.int64)
        if known is None:  # every window
            at = np.arange(len(starts))
            n, weight = np.full(len(at), 2), np.ones(len(at), np.int64)
        else:  # pairs of notices count one, a whole short notice as many as are needed
            at = [np.flatnonzero(pair & ~new[1:])]
            n, weight = [np.full(len(at[0]), 2)], [np.ones(len(at[0]), np.int64)]
            for k, grams in (short or {}).items():
                whole = np.flatnonzero(np.isin(gram_hashes(h, k), grams))
                whole = whole[number[whole] == number[whole + k - 1]]
                at.append(whole)
                n.append(np.full(len(whole), k))
                weight.append(np.full(len(whole), LEAST_PAIRS))
            at, n, weight = np.concatenate(at), np.concatenate(n), np.concatenate(weight)
        half = WINDOW // 2
        k = place[at] // half
        k = np.minimum(k, np.maximum(-(-size[number[at]] // half) - 2, 0))  # the last window is not a part of the one before
        key = np.concatenate([number[at] * (1 << 40) + k, (number[at] * (1 << 40) + k - 1)[k > 0]])
        inside = np.concatenate([np.ones(len(at), bool), (place[at][k > 0] - (k[k > 0] - 1) * half) <= WINDOW - n[k > 0]])
        key, own = np.unique(key[inside], return_inverse=True)
        hits = np.bincount(own, np.concatenate([weight, weight[k > 0]])[inside], len(key))
        key = key[hits >= (LEAST_PAIRS if known is not None else 1)]
        number, k = key >> 40, key & ((1 << 40) - 1)
        self.first = head[number] + k * half
        self.last = np.minimum(self.first + WINDOW, head[number] + size[number])  # one past
        self.line = head[number], head[number] + size[number]  # the line's words
        self.doc, self.starts, self.ends, self.raw = doc[self.first] if len(key) else key, starts, ends, raw

    def texts(self) -> tuple[np.ndarray, np.ndarray]:
        """The windows one after another: (bytes, offsets)."""
        return self.between(self.first, self.last)

    def between(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts from word ``first`` up to before word ``last``, one after another."""
        a = self.starts[first] if len(first) else np.zeros(0, np.int64)
        b = self.ends[last - 1] if len(first) else a
        off = np.concatenate([[0], np.cumsum(b - a)]).astype(np.int64)
        data = [self.raw[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        return (np.concatenate(data) if data else np.zeros(0, np.uint8)), off


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words."""
    m = max(len(h) - n + 1, 0)
    out = h[:m]
    for k in range(1, n):
        out = out * np.uint64(31) + h[k: m + k]
    return mixed(out)


def _hashed(texts: list[str], n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    out = [np.zeros(0, np.uint64)]
    for t in texts:
        raw = folded(t)
        starts, ends, _ = words(raw, np.array([0, len(raw)]))
        out.append(gram_hashes(word_hashes(raw, starts, ends), n))
    return np.unique(np.concatenate(out))


def _short(notice: str) -> bool:
    return 0 < len(word_list(notice)) <= LEAST_PAIRS


class Scanner:
    """The trained classifiers, of paragraphs and of mentions, with the notices they compare with."""

    def __init__(self, families: list[str], paragraphs: tuple[np.ndarray, np.ndarray], mentions: tuple[np.ndarray, np.ndarray],
                 notices: dict[str, list[str]]):
        self.families, self.models = families, {"paragraph": paragraphs, "mention": mentions}  # the last class is unknown
        self.notices = {k: [pairs(word_list(t)) for t in v if not _short(t)] for k, v in notices.items()}
        self.titles: dict[tuple[str, ...], set[str]] = {}  # short notices: their families
        for family in families:
            for t in filter(_short, notices[family]):
                self.titles.setdefault(tuple(word_list(t)), set()).add(family)
        own = [t for v in notices.values() for t in v]
        self.known = _hashed(own, 2)
        self.short = {n: _hashed([t for t in own if _short(t) and len(word_list(t)) == n], n) for n in range(1, LEAST_PAIRS + 1)}

    def probabilities(self, model: str, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        goff, bucket, _ = ngram_buckets(raw, off, ORDERS, BUCKETS)
        return softmax(logits(*self.models[model], goff, bucket))

    def compared(self, family: str, found: list[str]) -> tuple[float, int, int]:
        """Similarity to the nearest of the family's longer notices, and the
        words from the first to before the last that are shared with it."""
        own, best = pairs(found), (0.0, 0, 0)
        for notice in self.notices[family]:
            both = own & notice
            near = len(both) / max(min(len(own), len(notice)), 1)
            if len(both) >= LEAST_PAIRS and near > best[0]:
                at = [k for k, pair in enumerate(zip(found, found[1:], strict=False)) if pair in both]
                best = near, at[0], at[-1] + 2
        return best

    def named(self, found: list[str]) -> list[tuple[str, int, int]]:
        """Families with a whole short notice among the words, and its place."""
        return [(family, k, k + n) for n in self.short for k in range(len(found) - n + 1)
                for family in sorted(self.titles.get(tuple(found[k: k + n]), ()))]

    def scan(self, raw: np.ndarray, off: np.ndarray):
        """(document, family, score, similarity) of each confirmed paragraph."""
        found = Paragraphs(raw, off, self.known, self.short)
        text, toff = found.texts()
        if len(toff) == 1:
            return
        p = self.probabilities("paragraph", text, toff)
        best = p.argmax(axis=1)
        sure = (best < len(self.families)) & (p.max(axis=1) >= LEAST_SCORE)
        mentions = []  # paragraph, family, first word, one past the last, similarity if it is a longer notice
        for i in range(len(best)):
            own = text[toff[i]: toff[i + 1]].tobytes().decode("utf-8", "replace").split()
            mentions += [(i, family, a, b, 0.0) for family, a, b in self.named(own)]
            if sure[i]:
                family = self.families[best[i]]
                near, a, b = self.compared(family, own)
                if near >= LEAST_SIMILARITY:
                    mentions.append((i, family, a, b, near))
        if not mentions:
            return
        i, _, a, b, _ = zip(*mentions, strict=True)
        i = np.array(i)
        first = np.maximum(found.first[i] + np.array(a) - CONTEXT, found.line[0][i])
        last = np.minimum(found.first[i] + np.array(b) + CONTEXT, found.line[1][i])
        q = self.probabilities("mention", *found.between(first, last))
        out: dict[tuple[int, str], tuple[float, float]] = {}
        for (i, family, _, _, near), own in zip(mentions, q, strict=True):
            k = self.families.index(family)
            if near and own.argmax() < len(self.families):
                new = float(p[i, k]), near
            elif not near and own.argmax() == k and own[k] >= LEAST_SCORE:
                new = float(own[k]), 1.0
            else:
                continue
            out[i, family] = tuple(map(max, out.get((i, family), new), new))
        for (i, family), (score, near) in sorted(out.items()):
            yield int(found.doc[i]), family, score, near


def background(docs: DataFrame, id_col: str, text_col: str, known: np.ndarray, short: dict[int, np.ndarray],
               sample_docs: int, sample_paragraphs: int) -> list[str]:
    """Paragraphs of a sample of documents that hold few of the notices' pairs and no short notice."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    n = rows.count()
    share = min(1.0, sample_docs / max(n, 1))

    def run(batches):
        for batch in batches:
            off, raw = utf8(batch.column("text"))
            for i, j in chunks(off):
                text, toff = Paragraphs(_FOLD[raw[off[i]: off[j]]], off[i: j + 1] - off[i], None).texts()
                text = text.tobytes()
                out = [text[a:b].decode("utf-8", "replace") for a, b in zip(toff[:-1].tolist(), toff[1:].tolist(), strict=True)]
                out = [x for x in out if np.isin(_hashed([x], 2), known).sum() < LEAST_PAIRS
                       and not any(np.isin(_hashed([x], n), grams).any() for n, grams in short.items() if len(grams))]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["text"])

    some = rows.where(F.pmod(F.xxhash64("id", F.lit(6)), F.lit(1_000_000)) < share * 1_000_000)
    some = some.select("text").mapInArrow(run, "text string").distinct()
    return sorted(r["text"] for r in some.orderBy(F.xxhash64("text"), "text").limit(sample_paragraphs).collect())


def examples(notices: dict[str, list[str]], plain: list[str], seed: int = 6) -> tuple[list[str], list[int]]:
    """Training paragraphs: each notice whole, cut, thinned, and set between
    words of plain paragraphs; then the plain paragraphs as the last class."""
    rng = np.random.default_rng(seed)
    filler = [x.split() for x in plain] or [["text"]]
    texts, y = [], []
    for k, family in enumerate(sorted(notices)):
        for notice in notices[family]:
            own = word_list(notice)
            for turn in range(30):
                w = list(own)
                if turn % 3 == 1 and len(w) > 10:
                    a = int(rng.integers(0, len(w) // 2))
                    w = w[a: a + max(8, len(w) // 2)]
                if turn % 3 == 2:
                    w = [x for x in w if rng.random() > 0.05]
                other = filler[int(rng.integers(0, len(filler)))]
                a = int(rng.integers(0, max(1, WINDOW - len(w)))) if turn % 2 else 0
                texts.append(" ".join([*other[:a], *w, *other[a: a + int(rng.integers(0, 6))]] if turn % 2 else w))
                y.append(k)
    return texts + plain, y + [len(notices)] * len(plain)


def mention_examples(notices: dict[str, list[str]], plain: list[str], seed: int = 7) -> tuple[list[str], list[int]]:
    """Training mentions: notices, or twelve words of them, between other words;
    a short notice before the beginning of another family's longer one, with that
    family's label; for the last class notices that are denied, compared, or three
    in a list."""
    rng = np.random.default_rng(seed)
    filler = [x.split() for x in plain] or [["text"]]
    families = sorted(notices)
    own = {f: [word_list(t) for t in notices[f]] for f in families}
    titles = [(f, min(own[f], key=len)) for f in families]
    loose = sorted({w for phrase in (*BEFORE, *AFTER) for w in phrase.split()})
    texts, y = [], []

    def other(most: int) -> list[str]:
        words = filler[int(rng.integers(0, len(filler)))]
        a = int(rng.integers(0, max(1, len(words) - most)))
        return words[a: a + int(rng.integers(0, most + 1))]

    def one(choices):
        return choices[int(rng.integers(0, len(choices)))]

    def add(label: int, *parts: list[str]) -> None:
        texts.append(" ".join(x for part in parts for x in part))
        y.append(label)

    for k, family in enumerate(families):
        for words in own[family]:
            for turn in range(24):
                w = words
                if len(w) > 12 and turn % 2:
                    a = int(rng.integers(0, len(w) - 8))
                    w = w[a: a + 12]
                add(k, other(CONTEXT) if turn else [], w, other(CONTEXT) if turn else [])
                if turn % 2:  # single words of denials further off deny nothing
                    add(k, [one(loose) for _ in range(int(rng.integers(1, CONTEXT)))], other(1) or ["text"], w, other(CONTEXT))
                if turn % 2:
                    add(len(families), other(2), one(BEFORE).split(), w, other(CONTEXT))
                if turn % 6 == 1:
                    add(len(families), other(CONTEXT), w, one(AFTER).split())
            if len(words) <= LEAST_PAIRS:
                for m, goes_on in enumerate(families):
                    for longer in own[goes_on] if goes_on != family else []:
                        if len(longer) > CONTEXT:
                            add(m, other(CONTEXT), words, longer[:CONTEXT])
    for _ in range(20 * len(families) if len(families) > 2 else 0):
        listed = [w for n in rng.choice(len(titles), 3, replace=False) for w in [*titles[n][1], *([one(("and", "or"))] if rng.random() < 0.5 else [])]]
        add(len(families), other(CONTEXT), listed, other(2))
    return texts, y


def fitted(texts: list[str], y: list[int], k: int, unknown: float = 1.0, rounds: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of ``k`` classes, calibrated on a fifth of the examples.
    The last class has ``unknown`` times the weight of another one."""
    share = np.ones(k)
    share[-1] = unknown
    raw = [folded(t) for t in texts]
    y = np.array(y)

    def pick(at):
        off = np.concatenate([[0], np.cumsum([len(raw[i]) for i in at])]).astype(np.int64)
        goff, bucket, _ = ngram_buckets(np.concatenate([raw[i] for i in at]), off, ORDERS, BUCKETS)
        return goff, bucket, y[at]

    held = np.arange(len(y)) % 5 == 0
    w, b = fit(*pick(np.flatnonzero(~held)), k, BUCKETS, rounds=rounds, share=share)
    goff, bucket, truth = pick(np.flatnonzero(held))
    t = temperature(logits(w, b, goff, bucket), truth, (share / np.maximum(np.bincount(truth, minlength=k), 1))[truth])
    return w / t, b / t


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: dict[str, list[str]] | None = None,
          sample_docs: int = SAMPLE_DOCS, sample_paragraphs: int = SAMPLE_PARAGRAPHS) -> Scanner:
    """``sample_docs``, ``sample_paragraphs``: bounds of the sample of unlabelled
    text that the classifiers learn the unknown class and other words from."""
    notices = NOTICES if notices is None else notices
    families = sorted(notices)
    k = len(families) + 1
    blank = np.zeros((BUCKETS, k)), np.zeros(k)
    empty = Scanner(families, blank, blank, notices)
    plain = background(docs, id_col, text_col, empty.known, empty.short, sample_docs, sample_paragraphs)
    # each family's notices meet as much weight of their own denials
    mentions = fitted(*mention_examples(notices, plain), k, unknown=len(families), rounds=300)
    return Scanner(families, fitted(*examples(notices, plain), k), mentions, notices)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: dict[str, list[str]] | None = None) -> DataFrame:
    """``doc_id, family, n_paragraphs, score, similarity`` for each document and
    family with a confirmed paragraph; score and similarity are the best ones."""
    get = shared(docs.sparkSession, train(docs, id_col, text_col, notices))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches):
        scanner = get()
        for batch in batches:
            off, raw = utf8(batch.column("text"))
            found: dict[tuple[int, str], list] = {}
            for i, j in chunks(off):
                for d, family, score, near in scanner.scan(_FOLD[raw[off[i]: off[j]]], off[i: j + 1] - off[i]):
                    own = found.setdefault((i + d, family), [0, 0.0, 0.0])
                    own[:] = own[0] + 1, max(own[1], score), max(own[2], near)
            if found:
                keys = sorted(found)
                n, score, near = zip(*(found[k] for k in keys), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array([d for d, _ in keys])), pa.array([f for _, f in keys]),
                     pa.array(n, pa.int64()), pa.array(score), pa.array(near)], ["doc_id", "family", "n_paragraphs", "score", "similarity"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, family string, n_paragraphs bigint, score double, similarity double")
