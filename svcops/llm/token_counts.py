"""Token counts of a unigram tokenizer, without making the tokens.

The vocabulary is a list of (piece, score). Spaces become U+2581, one is put in
front of a text that doesn't start with one, and every U+2581 begins a word, so
words are tokenized alone. In a word an Aho-Corasick automaton lists all pieces
that end at each character; dynamic programming carries the best score and its
number of pieces. The tokenizer's rules: a character that is no piece by itself
may be unknown, at 10 below the lowest score; of paths with equal scores the
one whose last piece starts earliest wins; an unknown character counts as many
tokens as it has UTF-8 bytes (byte fallback), or runs of unknown characters
count one token where the vocabulary has no byte pieces.

Most words repeat, so a task keeps the counts of up to ``CACHE`` words.

Defined results: null and empty texts have no tokens; a text is never cut,
however long its words; rows with equal ids each give a row.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE = 600_000
LONGEST_CACHED = 48
SPACE = "▁"
UNKNOWN_PENALTY = 10.0

Vocabulary = list[tuple[str, float]]


def read_vocabulary(path: str) -> Vocabulary:
    """Pieces and scores of a SentencePiece model file, in the order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    """Counts pieces on the best path."""

    def __init__(self, vocabulary: Vocabulary):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), float(score)))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        have = {p for p, _ in vocabulary}
        self.bytes = all(f"<0x{b:02X}>" in have for b in range(256))
        # a line feed that is in no piece stands alone on every path
        self.alone = not any("\n" in p for p in have)
        self.inner: dict[str, int] = {}
        self.first: dict[str, int] = {}

    def path(self, word: str) -> int:
        """Tokens of the best path through one word. The automaton lists the
        matches by their ends, the longest first, so a strict comparison keeps
        the one that starts earliest."""
        n, unknown, nothing = len(word), self.unknown, -float("inf")
        best, count, known = [0.0] * (n + 1), [0] * (n + 1), [True] * (n + 1)
        at, top, pieces, single = 1, nothing, 0, False

        def settle():
            nonlocal top, pieces
            if not single and best[at - 1] + unknown > top:
                top, known[at] = best[at - 1] + unknown, False
                size = len(word[at - 1].encode("utf-8", "surrogatepass")) if self.bytes else known[at - 1]
                pieces = count[at - 1] + size
            best[at], count[at] = top, pieces

        for end, (size, score) in self.automaton.iter(word) if len(self.automaton) else ():
            while at <= end:
                if single:
                    best[at], count[at] = top, pieces
                else:
                    settle()
                at, top, single = at + 1, nothing, False
            value = best[at - size] + score
            if value > top:
                top, pieces = value, count[at - size] + 1
            if size == 1:
                single = True
        while at <= n:
            settle()
            at, top, single = at + 1, nothing, False
        return count[n]

    def part(self, text: str, first: bool) -> int:
        """Tokens of a word's part between line feeds."""
        cache = self.first if first else self.inner
        n = cache.get(text)
        if n is None:
            n = self.path(SPACE + text if first else text)
            if len(text) <= LONGEST_CACHED:
                if len(cache) >= CACHE:
                    cache.clear()
                cache[text] = n
        return n

    def word(self, text: str) -> int:
        """Tokens of a word given without its leading U+2581."""
        n = self.first.get(text)
        if n is not None:
            return n
        if "\n" not in text or not (self.alone and self.bytes):
            return self.part(text, True)
        head, *rest = text.split("\n")
        return self.part(head, True) + sum(1 + (self.part(x, False) if x else 0) for x in rest)

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        words = text.replace(" ", SPACE).split(SPACE)
        return sum(map(self.word, words if words[0] else words[1:]))


def token_counts(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_words, n_chars`` for every row; words as split by ASCII white space."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches):
        counter = Counter(sent.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([counter.text(t) for t in texts], pa.int64()),
                 pa.array([len((t or "").encode("utf-8", "surrogatepass").split()) for t in texts], pa.int64()),
                 pa.array([len(t or "") for t in texts], pa.int64())], ["doc_id", "n_tokens", "n_words", "n_chars"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, n_words bigint, n_chars bigint")
