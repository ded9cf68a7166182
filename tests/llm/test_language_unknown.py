import random

from svcops.llm import language_id as L
from svcops.llm.common import read
from tests.llm.helpers import documents

FINNISH = ("talo vesi kissa koira järvi metsä puu lapsi äiti isä hyvä päivä yö kaupunki katu koulu kirja pöytä tuoli ikkuna ovi minä "
           "sinä hän olemme ovat kanssa mutta että kuin").split()


def test_texts_in_no_known_language_go(spark):
    """Unlearned scripts, an unlearned Latin language and letter noise go; all clean ones stay, also those not learned from."""
    rng = random.Random(41)

    def noise(letters, n):
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(n))

    strange = [noise(x, n) for n in (30, 200) for x in ("αβγδεζηθικλμνοπρστυφχψω", "абвгдежзиклмнопрстуфхцчшэюя", [chr(0x4E00 + i) for i in range(2000)],
                                                        "abcdefghijklmnopqrstuvwxyz")]
    strange += [" ".join(rng.choice(FINNISH) for _ in range(n)) for n in (30, 200)]
    clean = read(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang", "source", "n_chars")
    docs = clean.unionByName(documents(spark, [(10**9 + i, t) for i, t in enumerate(strange)]))
    kept = sorted(r["doc_id"] for r in L.accepted(docs).select("doc_id").collect())
    assert kept == sorted(r["doc_id"] for r in clean.select("doc_id").collect())
