"""Names of licences that grant nothing, and notices that go on in another licence."""

import random

from svcops.llm import license_scan as L
from tests.llm.helpers import documents, prose

DENIED = ["this is not under the MIT License", "the paper surveys gpl 3 0 and apache 2 0 mpl 2 0", "unlike the MIT License it asks for more",
          "we are no longer under the Apache License, Version 2.0"]
BSD = "Copyright 2020 Acme. All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"


def test_denied_compared_and_listed(spark):
    rng = random.Random(31)
    rows, want = [(i, prose(rng, 80) + ".\n" + prose(rng, 30)) for i in range(100)], set()
    for i, text in enumerate(DENIED):
        rows += [(200 + i, text), (300 + i, prose(rng, 40) + "\n" + text + ".\n" + prose(rng, 40)), (400 + i, prose(rng, 19) + " " + text + " " + prose(rng, 30))]
    for i, text in enumerate([BSD, prose(rng, 30) + "\n" + BSD + "\n" + prose(rng, 30)], 500):
        rows.append((i, text))
        want.add((i, "BSD-3-Clause"))
    for i, text in enumerate(["Acme 2020. All rights reserved.", "not a word of it is true. All rights reserved."], 600):
        rows.append((i, text))
        want.add((i, "Proprietary"))
    got = {(r["doc_id"], r["family"]) for r in L.scan(documents(spark, rows)).collect()}
    assert got == want, (got - want, want - got)


def test_untrained_classifiers_name_nothing():
    k = len(L.NOTICES) + 1
    blank = L.np.zeros((L.BUCKETS, k)), L.np.zeros(k)
    raw = L.folded("MIT License\nReleased under the MIT License.\nAll rights reserved.")
    assert list(L.Scanner(sorted(L.NOTICES), blank, blank, L.NOTICES).scan(raw, L.np.array([0, len(raw)]))) == []
