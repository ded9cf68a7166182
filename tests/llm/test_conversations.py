import hashlib
import heapq
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from svcops.llm import conversations as C
from svcops.llm.common import read
from tests.llm.helpers import clashing

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
SPACES = " \t\n\x0b\x0c\r"


def best(rows):
    """Cheapest edits of (role, text, fault) rows by Dijkstra over whole edit strings."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return cost, audit, out
        step = "a" if state == "u" else "u"
        name = {"u": "user", "a": "assistant"}[step]
        heapq.heappush(heap, (cost + 5, audit + "I", i, step, (*out, (name, ""))))
        if i < len(rows):
            role, text, found = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, out))
            if found not in ("blank", "duplicate"):
                more = 5 * (found == "truncated")
                heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, step, (*out, (name, text))))
                if role[:1] == step or (role[:1] == "s" and state == ""):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[:1], (*out, (role, text))))


def brute(table):
    conversations = {}
    for conv, turn, role, text in table:
        own = conversations.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = text.translate(str.maketrans("", "", ".!?"))
        if kind == 4:
            role = "user"
        own += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = Counter()
    for conv, rows in conversations.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults = []
        for k, (_, role, text) in enumerate(rows):
            last = text.strip(SPACES)[-1:]
            again = any(r[1:] == (role, text) for r in rows[:k])
            faults.append("blank" if not last else "duplicate" if again else "" if last in ".!?" else "truncated")
        cost, audit, kept = best([(r[1], r[2], f) for r, f in zip(rows, faults)])
        turns = [r[0] for r in rows if r[0] is not None]
        wrong = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        text = "\n".join(f"{r}:{t}" for r, t in kept)
        out[conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            wrong, cost, audit, hashlib.sha256(text.encode()).hexdigest()] += 1
    return out


def results(df):
    return Counter(tuple(r[c] for c in ("conv_id", *C.NAMES, "cost", "audit", "repaired_sha256")) for r in df.collect())


def table(rng, conversations, longest):
    rows = []
    for conv in conversations:
        size, turn = rng.randrange(1, longest), 0
        for k in range(size):
            role = rng.choice(["system", "user", "assistant"]) if rng.random() < 0.3 else ["user", "assistant"][k % 2]
            role = rng.choice([None, "", "tool", " user"]) if rng.random() < 0.05 else role
            text = rng.choice(["Yes.", "no", "Why?", "  ", None, "", "ok! \n", "é.", "a.b"]) if rng.random() < 0.5 else f"Text {conv} {k}."
            rows.append((conv, None if rng.random() < 0.05 else turn, role, text))
            turn += rng.choice([1, 1, 1, 0, 2])
    return rows


def test_equals_brute_force(spark):
    rows = table(random.Random(1), [*range(300), None], 12)
    df = clashing(spark.createDataFrame(rows, SCHEMA)).repartition(5)
    assert results(C.digest(df)) == brute(rows)


@pytest.mark.parametrize("rows_limit,piece", [(3, 2), (5, 4), (0, 1), (8, 7)])
def test_pieces_equal_brute_force(spark, monkeypatch, rows_limit, piece):
    """Nearly all conversations count as large and are cut into small pieces."""
    rows = table(random.Random(2), [*range(60), None], 30)
    monkeypatch.setattr(C, "ROWS", rows_limit)
    monkeypatch.setattr(C, "PIECE", piece)
    assert results(C.digest(spark.createDataFrame(rows, SCHEMA).repartition(3))) == brute(rows)


def test_large_ids_by_join(spark, monkeypatch):
    rows = table(random.Random(3), [*range(10), None], 12)
    monkeypatch.setattr(C, "ROWS", 4)
    monkeypatch.setattr(C, "IDS", 0)
    assert results(C.digest(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_hot_conversation(spark):
    """Half of the rows in one conversation, a third of them identical and without a turn."""
    rng = random.Random(4)
    rows = [(7, k, ["user", "assistant"][k % 2], f"Text {k}.") for k in range(3000)] + [(7, None, "user", "Same text.")] * 3000
    rows += table(rng, range(100, 200), 8)
    got = {r["conv_id"]: r for r in C.digest(spark.createDataFrame(rows, SCHEMA).repartition(8)).collect()}
    whole = [r for r in C.damaged(spark.createDataFrame(rows[:6000], SCHEMA)).collect()]
    whole.sort(key=lambda r: (r["turn"] is not None, r["turn"] or 0, r["role"], r["text"]))
    faults, cost, audit, kept = C._whole([r["role"] for r in whole], [r["text"] for r in whole])
    assert (got[7]["cost"], got[7]["audit"]) == (cost, audit) and got[7]["duplicate"] == faults.count("duplicate") > 1000
    assert got[7]["repaired_sha256"] == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
    assert len(got) == 101


def test_search_equals_dijkstra():
    rng = random.Random(5)
    for _ in range(3000):
        codes = "".join(rng.choice("suaoSUAOx" + "ua" * 4) for _ in range(rng.randrange(0, 14)))
        rows = [(c.lower() if c != "x" else "u", "", "blank" if c == "x" else "truncated" if c.isupper() else "") for c in codes]
        assert C.cheapest(codes, C.START, C.DONE, True) == best(rows)[:2], codes


def test_repaired_rows(spark, monkeypatch):
    rows = table(random.Random(6), range(40), 20)
    df = spark.createDataFrame(rows, SCHEMA)

    def texts():
        out = {}
        for r in C.repaired(C.damaged(df)).orderBy("conv_id", "place", "part").collect():
            out.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
        return out

    whole = texts()
    for own in whole.values():
        initials = "".join(r[:1] for r, _ in own).removeprefix("s")
        assert initials == "ua" * (len(initials) // 2)
    monkeypatch.setattr(C, "ROWS", 3)
    monkeypatch.setattr(C, "PIECE", 5)
    assert texts() == whole


def test_driver_conversations(spark):
    df = read(spark, "/root/testdata/sf0.001", "conversations")
    assert results(C.digest(df)) == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_nothing_left_and_empty_table(spark):
    assert C.digest(spark.createDataFrame([], SCHEMA)).count() == 0
    conv = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    row = C.digest(spark.createDataFrame([(conv, 0, "user", "Hello.")], SCHEMA)).first()
    assert tuple(row) == (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_long_text(spark):
    rows = [(1, 0, "user", "word " * 400_000 + "end."), (1, 1, "assistant", "x" * 3_000_000 + "!")]
    got = results(C.digest(spark.createDataFrame(rows, SCHEMA)))
    assert got == brute(rows)
    assert C.damaged(spark.createDataFrame(rows, SCHEMA)).select(F.length("text")).count() <= 4
