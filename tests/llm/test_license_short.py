import random

from svcops.llm import license_scan as L
from tests.llm.helpers import documents, prose


def test_short_and_wrapped_notices(spark):
    rng = random.Random(23)
    cases = {"All rights reserved.": "Proprietary", "MIT License": "MIT", "Licence: MIT": "MIT", "Apache License\nVersion 2.0": "Apache-2.0",
             "All rights\r\nreserved": "Proprietary", "# Released under the MIT\n# License": "MIT", "MIT\n\nLicense": None, "all the rights are reserved": None,
             "GNU General Public License,\nversion 3": "GPL-3.0", "MIT License\nAll rights reserved.": {"MIT", "Proprietary"}}
    rows = [(i, prose(rng, 80) + ".\n" + prose(rng, 30)) for i in range(100)]
    want = set()
    for i, (text, family) in enumerate(cases.items(), 200):
        rows += [(i, text), (i + 100, prose(rng, 40) + "\n\n" + text + "\n\n" + prose(rng, 40)), (i + 200, prose(rng, 70) + " " + text + " " + prose(rng, 20))]
        for f in family if isinstance(family, set) else {family} - {None}:
            want |= {(i, f), (i + 100, f), (i + 200, f)}
    got = {(r["doc_id"], r["family"]) for r in L.scan(documents(spark, rows)).collect()}
    assert got == want, (got - want, want - got)


def test_notice_of_one_word(spark):
    rows = [(i, prose(random.Random(i), 60)) for i in range(50)] + [(90, "wtfpl"), (91, "other")]
    got = [(r["doc_id"], r["family"]) for r in L.scan(documents(spark, rows), notices={"WTFPL": ["WTFPL"], "MIT": L.NOTICES["MIT"]}).collect()]
    assert got == [(90, "WTFPL")]
