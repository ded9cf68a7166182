import random
from collections import Counter

from svcops.llm import exact_dedup as X
from svcops.llm import simhash as S
from tests.llm.helpers import clashing, documents, prose
from tests.llm.test_exact_dedup import brute

RNG = random.Random(31)
TEXT = [prose(RNG, 60) for _ in range(12)]
#: Null ids with a copy of a known row, unique texts and copies among themselves; repeated ids with other texts; identical rows.
ROWS = [(1, TEXT[0]), (None, TEXT[0]), (None, TEXT[1]), (None, TEXT[2]), (None, TEXT[3]), (None, TEXT[3]), (2, TEXT[4]), (2, TEXT[5]),
        (3, TEXT[5]), (2, TEXT[0]), (4, TEXT[6]), (4, TEXT[6]), (5, TEXT[7]), (5, TEXT[8])]
WANT = Counter([(1, TEXT[0]), (None, TEXT[1]), (None, TEXT[2]), (None, TEXT[3]), (2, TEXT[4]), (2, TEXT[5]), (4, TEXT[6]), (5, TEXT[7]), (5, TEXT[8])])


def test_groups_by_text(spark):
    got = X.exact_groups(clashing(documents(spark, ROWS))).collect()
    assert sorted(map(tuple, got), key=str) == brute(ROWS)


def test_one_row_of_each_text_stays(spark):
    docs = clashing(documents(spark, ROWS))
    for stage in (X.exact_dedup, S.drop_near_duplicates):
        out = stage(docs)
        assert out.columns == docs.columns
        assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == WANT, stage
