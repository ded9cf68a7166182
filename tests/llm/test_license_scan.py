import random

from svcops.llm import license_scan as L
from svcops.llm.common import read
from tests.llm.helpers import awkward, clashing, documents, prose

# Licence sentences of the driver's documents and the families they name.
SENTENCES = {
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "Released under the MIT License.": "MIT",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "All rights reserved.": "Proprietary",
}


def test_driver_documents(spark):
    """Exactly the documents that hold one of the sentences, with its family."""
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    got = {(r["doc_id"], r["family"]) for r in L.scan(docs).collect()}
    want = {(r["doc_id"], f) for r in docs.collect() for s, f in SENTENCES.items() if s in r["text"]}
    assert got == want and {f for _, f in want} == set(SENTENCES.values())


def test_every_family_is_found_and_told_apart(spark):
    rng = random.Random(21)
    rows, want = [(i, prose(rng, 80) + ".\n" + prose(rng, 30)) for i in range(150)], set()
    at = 200
    for family, notices in L.NOTICES.items():
        for notice in notices:
            rows.append((at, prose(rng, 50) + "\n" + rng.choice([notice, notice.upper(), prose(rng, 6) + " " + notice]) + "\n" + prose(rng, 20)))
            want.add((at, family))
            at += 1
    got = {(r["doc_id"], r["family"]) for r in L.scan(documents(spark, rows)).collect()}
    assert {x for x in got if x[0] < 200} == set()
    assert len(want - got) <= 0.1 * len(want), want - got


def test_awkward_rows(spark):
    rng = random.Random(22)
    mit = "Released under the MIT License."
    long = prose(rng, 5000) + "\n" + mit + "\n" + prose(rng, 5000)
    rows = [(i, t) for i, t in awkward(rng) if i != 16] + [(30, mit), (30, mit), (31, long), (32, mit + "\nLicensed under CC BY 4.0.\n" + mit), (33, "the MIT of license released")]
    got = sorted((r["doc_id"], r["family"], r["n_paragraphs"]) for r in L.scan(clashing(documents(spark, rows))).collect())
    assert got == [(30, "MIT", 1), (30, "MIT", 1), (31, "MIT", 1), (32, "CC-BY-4.0", 1), (32, "MIT", 2)]
    assert L.scan(documents(spark, [])).count() == 0
