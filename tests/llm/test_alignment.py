import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from svcops.llm import alignment as A
from svcops.llm.queries import BYTE_TOKENIZER, TOKENIZER
from svcops.llm.tokens import byte_letters
from tests.llm.helpers import awkward, clashing, documents, prose


def brute(docs):
    """Plain alignment of every document, with loops over tokens."""
    byte, piece = Tokenizer.from_file(BYTE_TOKENIZER), sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)
    byte.encode_special_tokens = True
    letters = byte_letters()
    found, pair_docs = [], Counter()
    for doc, text in docs:
        groups = []
        if text:
            a = [(i, bytes(letters[c] for c in byte.id_to_token(i))) for i in byte.encode(" " + text, add_special_tokens=False).ids]
            b = []
            for i in piece.encode(text):
                p = piece.id_to_piece(i)
                b.append((i, bytes([int(p[3:5], 16)]) if piece.is_byte(i) else p.replace("▁", " ").encode()))
            whole = (" " + text).encode()
            if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b):
                i = j = end_a = end_b = 0
                ga, gb = [], []
                while i < len(a) or j < len(b):
                    if end_a <= end_b:
                        end_a += len(a[i][1])
                        ga.append(a[i][0])
                        i += 1
                    else:
                        end_b += len(b[j][1])
                        gb.append(b[j][0])
                        j += 1
                    if end_a == end_b:
                        groups.append((ga, gb))
                        ga, gb = [], []
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        pair_docs.update(set(links))
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        found.append((doc, groups, links, hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    most = {}
    for (x, _), n in pair_docs.items():
        most[x] = max(most.get(x, 0), n)
    return Counter((doc, sum(len(g) for g, _ in groups), sum(len(g) for _, g in groups), len(groups), len(links),
                    sum(pair_docs[p] == most[p[0]] for p in links), sum(pair_docs[p] for p in links), h)
                   for doc, groups, links, h in found), pair_docs


def corpus():
    rng = random.Random(31)
    odd = [*" \t\n.,'sabzéÀ 　​中文字😀١5²º<|>_▁", "<|endoftext|>", "</s>", "  ", " the", "n't", "\u0000", "Ⅷ", "ﬁ", "é"]
    docs = awkward(rng) + [(100 + i, prose(rng, rng.randrange(0, 60))) for i in range(40)]
    docs += [(200 + i, "".join(rng.choice(odd) for _ in range(rng.randrange(1, 40)))) for i in range(150)]
    return docs + [(400, " "), (401, "▁"), (402, "ab" * 3000), (403, "".join(rng.choice("abcdefghij0123") for _ in range(5000)))]


def rows(df):
    return Counter((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in df.collect())


@pytest.fixture(scope="module")
def expected():
    return brute(corpus())


def test_equals_brute_force(spark, expected):
    aligned = A.align(clashing(documents(spark, corpus())).repartition(5), BYTE_TOKENIZER, TOKENIZER)
    assert rows(A.digest(aligned)) == expected[0]
    counts = {(r["a"], r["b"]): r["documents"] for r in A.pair_counts(aligned).collect()}
    assert counts == dict(expected[1])
    assert len({r[0] for r in aligned.select("row").collect()}) == len(corpus())


@pytest.mark.parametrize("hot", [0, 40])
def test_rare_pairs_meet_in_a_join(spark, expected, hot):
    aligned = A.align(documents(spark, corpus()), BYTE_TOKENIZER, TOKENIZER)
    known, others = A.commonest(A.pair_counts(aligned), hot)
    assert others is not None and len(known.pairs) <= hot
    assert rows(A.digest(aligned, hot)) == expected[0]


def test_small_steps(spark, expected, monkeypatch):
    """Large groups by distinct ids, few links at a time, small chunks."""
    aligner = A.Aligner(BYTE_TOKENIZER, TOKENIZER)
    texts = [t or "" for _, t in corpus()]
    want = [tuple(map(str, x[:5])) + (x[5].tolist(), x[6].tolist()) for x in aligner.align(texts)]
    monkeypatch.setattr(A, "LINKS", 3)
    got = [tuple(map(str, x[:5])) + (x[5].tolist(), x[6].tolist()) for t in texts for x in aligner.align([t])]
    assert got == want


def test_pointer_jumping_on_random_tokens():
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randrange(1, 40)
        ends = [sorted({*rng.sample(range(1, n + 1), rng.randrange(0, n)), n}) for _ in range(2)]
        a, b, count = A.groups(*(np.array(e) for e in ends))
        both = sorted(set(ends[0]) & set(ends[1]))
        assert count == len(both)
        assert a.tolist() == [sum(x < e for x in both) for e in ends[0]] and b.tolist() == [sum(x < e for x in both) for e in ends[1]]


def test_empty_table(spark):
    assert A.digest(A.align(documents(spark, []), BYTE_TOKENIZER, TOKENIZER)).count() == 0
    only = A.digest(A.align(documents(spark, [(1, None), (2, "")]), BYTE_TOKENIZER, TOKENIZER))
    assert rows(only) == Counter([(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")])
