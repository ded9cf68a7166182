"""Repair of conversations: faults, the cheapest edits, the repaired text.

A conversation is its rows in the order of ``turn`` (nulls first), then role,
then text. Each row has at most one fault, the first that applies: *blank* (no
visible character), *duplicate* (role and text seen earlier), *truncated* (the
last visible character is none of ``.!?``). Edits, in ASCII order: D deletes a row
(2), I inserts one without text (5), K keeps one (0), R gives one the role user or
assistant (1); blank and duplicate rows must go, a truncated row that stays adds
5. The repaired roles' initials must read ``(s?(ua)+)?``.

*Iterative-deepening A\\**: depth-first search that tries the edits in ASCII order
under a cost bound, which grows to the least cost that exceeded it. A table
keeps, for each state, the largest remaining cost with which it failed. The
lower bound of the remaining cost is exact in a simpler problem in which a
system row may stand among the first rows anywhere. The first accepting path of
the first sufficient bound is the cheapest one and of those the ASCII-least.

A conversation of more than ``ROWS`` rows or ``BYTES`` bytes is cut into pieces of up
to ``PIECE`` rows, sorted and spread over tasks by range. A piece is searched for
each state before it and after it; the pieces' costs (sixteen numbers a piece)
decide which states the cheapest path passes, and the edits are joined back to
the rows by their places. Only the digest of one conversation's text is taken
in one stream, since SHA-256 has no parts.

Defined results: null roles and texts count as one space; a null ``conv_id`` is a
conversation like any other; rows of one turn are ordered by role and text;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import pairwise

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from svcops.session import settled

ROWS = 2_000
BYTES = 16 << 20
PIECE = 2_000
#: Most large conversations whose ids are broadcast; more are joined.
IDS = 100_000
_NEVER = 1 << 60

#: States: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
_KEEP = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
DONE = (START, ASSISTANT)
_SPACES = " \t\n\x0b\x0c\r"


# ------------------------------------------------------------------ rows as letters

def fault(text: str, again: bool) -> str:
    visible = text.strip(_SPACES)
    return "blank" if not visible else "duplicate" if again else "" if visible[-1] in ".!?" else "truncated"


def letter(role: str, found: str) -> str:
    """What the search sees of a row: ``x`` must go; s, u, a, or o for another
    role; a capital is truncated."""
    if found in ("blank", "duplicate"):
        return "x"
    own = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return own.upper() if found else own


# ------------------------------------------------------------------ the search

def lower_bounds(rows: str, goals: tuple[int, ...], trailing: bool) -> list[tuple]:
    """For each place in the rows, the least remaining cost of each state in the
    simpler problem, where START and SYSTEM are one."""
    p = 0 if START in goals or SYSTEM in goals else _NEVER
    u = 0 if USER in goals else _NEVER
    a = 0 if ASSISTANT in goals else _NEVER
    if trailing:
        u, a = min(u, 5 + a), min(a, 5 + u)
        p = min(p, 5 + u)
    out = [(p, p, u, a)]
    for code in reversed(rows):
        if code == "x":
            p, u, a = p + 2, u + 2, a + 2
        else:
            more, own = (5, code.lower()) if code.isupper() else (0, code)
            to_user, to_assistant = u + more + (own != "u"), a + more + (own != "a")
            p = min(p + 2, to_user, p + more if own == "s" else _NEVER)
            u, a = min(u + 2, to_assistant), min(a + 2, to_user)
        u, a = min(u, 5 + a), min(a, 5 + u)
        p = min(p, 5 + u)
        out.append((p, p, u, a))
    return out[::-1]


def _steps(rows: str, i: int, state: int, trailing: bool):
    """(edit, cost, place, state) of each edit, in ASCII order."""
    if i < len(rows):
        yield "D", 2, i + 1, state
    if i < len(rows) or trailing:
        yield "I", 5, i, _NEXT[state]
    if i < len(rows) and rows[i] != "x":
        more, own = (5, rows[i].lower()) if rows[i].isupper() else (0, rows[i])
        if (own, state) in _KEEP:
            yield "K", more, i + 1, _KEEP[own, state]
        yield "R", 1 + more, i + 1, _NEXT[state]


@lru_cache(maxsize=50_000)
def cheapest(rows: str, entry: int, goals: tuple[int, ...], trailing: bool) -> tuple[int, str] | None:
    """(cost, edits) from the state ``entry`` to one of the ``goals``; without
    ``trailing`` nothing is inserted after the last row."""
    least = lower_bounds(rows, goals, trailing)
    bound = least[0][entry]
    while bound < _NEVER:
        failed: dict[tuple[int, int], int] = {}
        further, edits = _NEVER, []
        stack = [(0, entry, 0, _steps(rows, 0, entry, trailing))]
        while stack:
            i, state, spent, steps = stack[-1]
            if i == len(rows) and state in goals:
                return spent, "".join(edits)
            for edit, cost, j, to in steps:
                total = spent + cost
                if total + least[j][to] > bound:
                    further = min(further, total + least[j][to])
                elif failed.get((j, to), -1) < bound - total:
                    edits.append(edit)
                    stack.append((j, to, total, _steps(rows, j, to, trailing)))
                    break
            else:
                failed[i, state] = bound - spent
                stack.pop()
                if edits:
                    edits.pop()
        bound = further
    return None


def replay(rows: str, edits: str, entry: int):
    """(row or None, role or None): the row that an edit takes, if it stays its
    new role or "" for its own; deleted rows have None."""
    i, state = 0, entry
    for edit in edits:
        if edit == "D":
            yield i, None
        elif edit == "K":
            state = _KEEP[rows[i].lower(), state]
            yield i, ""
        else:
            state = _NEXT[state]
            yield (None if edit == "I" else i), ROLE[state]
        i += edit != "I"


# ------------------------------------------------------------------ small conversations

FACTS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint"
NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal")


def _facts(turns: list, roles: list[str], faults: list[str]) -> tuple:
    known = [t for t in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal(roles)


def illegal(roles: list[str]) -> int:
    return sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in pairwise(roles))


def _groups(batches):
    """(conv_id, turns, roles, texts) of consecutive rows of one conversation."""
    now, columns = None, ([], [], [])
    for batch in batches:
        for conv, *row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True):
            if columns[0] and conv != now:
                yield now, *columns
                columns = ([], [], [])
            now = conv
            for column, value in zip(columns, row, strict=True):
                column.append(value)
    if columns[0]:
        yield now, *columns


def _whole(roles: list[str], texts: list[str]):
    """(faults, cost, edits, repaired rows) of one conversation."""
    seen: set = set()
    faults = []
    for row in zip(roles, texts, strict=True):
        faults.append(fault(row[1], row in seen))
        seen.add(row)
    codes = "".join(map(letter, roles, faults))
    cost, edits = cheapest(codes, START, DONE, True)
    rows = [(role or roles[i], texts[i]) if i is not None else (role, "") for i, role in replay(codes, edits, START) if role is not None]
    return faults, cost, edits, rows


def _batches(rows, schema: pa.Schema, size: int = 2_000):
    part = []
    for row in rows:
        part.append(row)
        if len(part) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema)], schema.names)
            part = []
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema)], schema.names)


def _arrow(schema: str, spark) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def _small(rows: DataFrame, results: bool) -> DataFrame:
    """Whole conversations in one task each: their results, or their repaired rows."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = (f"conv_id {kind}, {FACTS}, cost bigint, audit string, repaired_sha256 string" if results
              else f"conv_id {kind}, place bigint, part int, role string, text string")
    arrow = _arrow(schema, rows.sparkSession)

    def found(batches):
        for conv, turns, roles, texts in _groups(batches):
            faults, cost, edits, kept = _whole(roles, texts)
            if results:
                text = "\n".join(f"{r}:{t}" for r, t in kept)
                yield conv, *_facts(turns, roles, faults), cost, edits, hashlib.sha256(text.encode()).hexdigest()
            else:
                for i, (r, t) in enumerate(kept):
                    yield conv, i, 0, r, t

    placed = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return placed.mapInArrow(lambda batches: _batches(found(batches), arrow), schema)


# ------------------------------------------------------------------ large conversations

class Large:
    """Conversations too large for one task: the pieces of their rows, the
    states chosen between them and their edits, each settled."""

    def __init__(self, rows: DataFrame):
        numbered = settled(rows.withColumn("tie", F.monotonically_increasing_id()))
        known = F.col("turn").isNotNull()
        # a copy is any row but the first of its role and text; both sides of the join are unique
        first = numbered.groupBy("conv_id", "role", F.sha2("text", 256).alias("digest")).agg(
            F.min(F.struct(known.alias("known"), "turn", "tie")).alias("first"))
        first = first.select(F.col("first.tie").alias("tie"), F.lit(True).alias("fresh"))
        order = ["conv_id", known, "turn", "role", "text", "tie"]
        sorted_ = numbered.join(first, "tie", "left").repartitionByRange(*order).sortWithinPartitions(*order)
        self.rows = settled(sorted_.select("conv_id", "turn", "role", "text", F.col("fresh").isNull().alias("again"),
                                           F.monotonically_increasing_id().alias("at")))
        self.kind = rows.schema["conv_id"].dataType.simpleString()
        self.pieces = settled(self._pieces())
        chosen = self.pieces.drop("rows").groupBy("conv_id").applyInPandas(
            _choose, f"conv_id {self.kind}, at bigint, entry int, goal int, {FACTS}, cost bigint")
        self.chosen = settled(chosen)

    def _pieces(self) -> DataFrame:
        """Runs of rows of one conversation in one partition, ``PIECE`` at most."""
        schema = (f"conv_id {self.kind}, at bigint, rows string, costs array<bigint>, ranks array<int>, ends array<bigint>, first string, last string, "
                  "first_turn bigint, last_turn bigint, least_turn bigint, turns bigint, " + FACTS)
        arrow = _arrow(schema, self.rows.sparkSession)

        def runs(batches):
            """At most ``PIECE`` rows at a time; texts are read, not kept."""
            now, part = None, []
            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "at", "turn", "role", "text", "again")), strict=True):
                    if part and (row[0] != now or len(part) == PIECE):
                        yield part
                        part = []
                    now = row[0]
                    part.append((*row[:4], fault(row[4], row[5])))
            if part:
                yield part

        def found(batches):
            for part in runs(batches):
                conv, at, turns, roles, faults = zip(*part, strict=True)
                codes = "".join(map(letter, roles, faults))
                table = [[cheapest(codes, s, (e,), False) for e in range(4)] for s in range(4)]
                costs = [_NEVER if x is None else x[0] for line in table for x in line]
                # of the exits of equal total cost the one with the ASCII-least edits comes first
                ranks = [sorted(x[1] for x in line if x).index(x[1]) if x else 4 for line in table for x in line]
                ends = [cheapest(codes, s, DONE, True)[0] for s in range(4)]
                known = [t for t in turns if t is not None]
                yield (conv[0], at[0], codes, costs, ranks, ends, roles[0][:1], roles[-1][:1], turns[0], turns[-1],
                       min(known, default=None), len(set(known)), *_facts(list(turns), list(roles), list(faults)))

        return self.rows.mapInArrow(lambda batches: _batches(found(batches), arrow, 20), schema)

    def edits(self) -> DataFrame:
        """``conv_id, at, audit, edits`` of each piece; an edit is the row's place,
        the roles inserted before and after it, and its own new role ("" for its
        own, null if it goes)."""
        schema = (f"conv_id {self.kind}, at bigint, audit string, "
                  "edits array<struct<at:bigint,before:array<string>,role:string,after:array<string>>>")
        arrow = _arrow(schema, self.rows.sparkSession)

        def found(batches):
            for batch in batches:
                for conv, at, codes, entry, goal in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "at", "rows", "entry", "goal")), strict=True):
                    _, audit = cheapest(codes, entry, DONE, True) if goal < 0 else cheapest(codes, entry, (goal,), False)
                    out, waiting = [], []
                    for i, role in replay(codes, audit, entry):
                        if i is None:
                            waiting.append(role)
                        else:
                            out.append({"at": at + i, "before": waiting, "role": role, "after": []})
                            waiting = []
                    out[-1]["after"] = waiting
                    yield conv, at, audit, out

        own = self.pieces.select("at", "rows").join(self.chosen.select("conv_id", "at", "entry", "goal"), "at")
        return own.mapInArrow(lambda batches: _batches(found(batches), arrow, 20), schema)

    def repaired(self) -> DataFrame:
        """``conv_id, place, part, role, text`` in the order of (place, part)."""
        edit = self.edits().select(F.explode("edits").alias("e")).select(
            F.col("e.at").alias("at"), F.col("e.before").alias("before"), F.col("e.role").alias("new"), F.col("e.after").alias("after"))

        def empty(roles: str):
            return F.transform(roles, lambda r: F.struct(r.alias("role"), F.lit("").alias("text")))

        own = F.struct(F.when(F.col("new") == "", F.col("role")).otherwise(F.col("new")).alias("role"), "text")
        lines = F.concat(empty("before"), F.when(F.col("new").isNotNull(), F.array(own)).otherwise(F.array()), empty("after"))
        return self.rows.drop("turn", "again").join(edit, "at").select("conv_id", F.col("at").alias("place"), F.posexplode(lines).alias("part", "line")).select(
            "conv_id", "place", "part", "line.role", "line.text")

    def results(self) -> DataFrame:
        schema = f"conv_id {self.kind}, repaired_sha256 string"
        arrow = _arrow(schema, self.rows.sparkSession)

        def digests(batches):
            now, sha, begun = None, None, False
            for batch in batches:
                for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                    if begun and conv != now:
                        yield now, sha.hexdigest()
                        begun = False
                    sha = sha if begun else hashlib.sha256()
                    sha.update(f"{chr(10) if begun else ''}{role}:{text}".encode())
                    now, begun = conv, True
            if begun:
                yield now, sha.hexdigest()

        hashed = self.repaired().repartition("conv_id").sortWithinPartitions("conv_id", "place", "part").select(
            "conv_id", "role", "text").mapInArrow(lambda batches: _batches(digests(batches), arrow), schema)
        audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "audit"))), lambda x: x["audit"]), "")
        audits = self.edits().groupBy("conv_id").agg(audit.alias("audit"))
        out = self.chosen.where("cost IS NOT NULL").select("conv_id", *NAMES, "cost")
        for more in (audits, hashed):
            name = more.columns[1]
            other = more.withColumnRenamed("conv_id", "own_id")
            out = out.join(other, F.col("conv_id").eqNullSafe(F.col("own_id")), "left").drop("own_id")
            if name == "repaired_sha256":
                out = out.fillna(hashlib.sha256().hexdigest(), [name])
        return out


def _choose(pieces: pd.DataFrame) -> pd.DataFrame:
    """The states between the pieces of one conversation on its cheapest path,
    of equal ones the ASCII-least; the conversation's facts in its first row."""
    pieces = pieces.sort_values("at").reset_index(drop=True)
    n = len(pieces)
    rest = [None] * n  # least cost from each state before the piece
    rest[-1] = [int(x) for x in pieces["ends"][n - 1]]
    for k in range(n - 2, -1, -1):
        costs = pieces["costs"][k]
        rest[k] = [min(int(costs[4 * s + e]) + rest[k + 1][e] for e in range(4)) for s in range(4)]
    state, entries, goals = START, [], []
    for k in range(n):
        entries.append(state)
        if k == n - 1:
            goals.append(-1)
            break
        costs, ranks = pieces["costs"][k], pieces["ranks"][k]
        state = min(range(4), key=lambda e: (int(costs[4 * state + e]) + rest[k + 1][e], int(ranks[4 * state + e])))
        goals.append(state)
    joints = [(pieces[a][k], pieces[b][k + 1]) for a, b in (("last", "first"), ("last_turn", "first_turn")) for k in range(n - 1)]
    seams, turns = joints[:n - 1], joints[n - 1:]
    same = sum(not pd.isna(a) and a == b for a, b in turns)
    known = int(pieces["turns"].sum())
    least = pieces["least_turn"].min()
    facts = {c: int(pieces[c].sum()) for c in ("blank", "duplicate", "truncated")}
    facts["gaps"] = int(pieces["last_turn"].max() - least + 1 - (known - same)) if known else 0
    facts["illegal"] = int(pieces["illegal"].sum()) + sum(a + b not in ("su", "ua", "au") for a, b in seams)
    out = pd.DataFrame({"conv_id": pieces["conv_id"], "at": pieces["at"], "entry": entries, "goal": goals})
    for c in NAMES:
        out[c] = [facts[c]] + [0] * (n - 1)
    out["cost"] = pd.array([rest[0][START]] + [None] * (n - 1), dtype="Int64")
    return out


# ------------------------------------------------------------------ all conversations

def _plain(rows: DataFrame) -> DataFrame:
    def text(c: str):
        return F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)

    return rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), text("role"), text("text"))


def _parts(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(rows of small conversations, rows of large ones if there are any)."""
    rows = _plain(rows)
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    large = settled(sizes.where((F.col("n") > ROWS) | (F.col("bytes") > BYTES)).select(F.col("conv_id").alias("large_id")))
    count = large.count()
    if not count:
        return rows, None
    large = F.broadcast(large) if count <= IDS else large
    same = F.col("conv_id").eqNullSafe(F.col("large_id"))
    return rows.join(large, same, "left_anti"), rows.join(large, same, "left_semi")


def repair(rows: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256`` of every conversation."""
    small, large = _parts(rows)
    out = _small(small, results=True)
    return out if large is None else out.unionByName(Large(large).results())


def repaired(rows: DataFrame) -> DataFrame:
    """``conv_id, place, part, role, text``: the repaired conversations' rows,
    in the order of (place, part)."""
    small, large = _parts(rows)
    out = _small(small, results=False)
    return out if large is None else out.unionByName(Large(large).repaired())


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after the damage that the crc32 of ``conv_id:turn`` names: of twenty
    remainders 0 drops a row, 1 empties its text, 2 removes its ``.!?``, 3 repeats
    it, 4 makes its role user. Nulls count as one space."""
    rows = _plain(conversations)
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = rows.withColumn("damage", F.crc32(key.cast("binary")) % 20).where("damage <> 0")
    copies = F.when(F.col("damage") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    text = (F.when(F.col("damage") == 1, F.lit("")).when(F.col("damage") == 2, F.regexp_replace("text", "[.!?]", ""))
            .otherwise(F.col("text")))
    role = F.when(F.col("damage") == 4, F.lit("user")).otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def digest(conversations: DataFrame) -> DataFrame:
    """Faults and repair of every conversation after the damage, also of those
    that lost all rows."""
    found = repair(damaged(conversations)).withColumnRenamed("conv_id", "own_id")
    ids = conversations.select("conv_id").distinct()
    out = ids.join(found, F.col("conv_id").eqNullSafe(F.col("own_id")), "left").drop("own_id")
    return out.fillna(0, [*NAMES, "cost"]).fillna("", ["audit"]).fillna(hashlib.sha256().hexdigest(), ["repaired_sha256"])
