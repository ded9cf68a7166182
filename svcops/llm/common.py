"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from svcops.session import settled

#: White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"

#: Bytes of text that a task turns into NumPy arrays at a time (one longer text is a chunk of its own).
CHUNK_BYTES = 1 << 20


def fold(id_col: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id has fold -1."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % modulus, F.lit(-1).cast("bigint"))


def unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    have = {c.lower() for c in docs.columns}
    while name.lower() in have:
        name += "_"
    return name


def only(docs: DataFrame, id_col: str, ids: DataFrame, how: str) -> DataFrame:
    """The rows of ``docs`` whose id is (``left_semi``) or isn't (``left_anti``)
    the one column of ``ids``. Columns of ``docs`` stay as they are; a null id
    equals a null id."""
    name = unused(docs, "only_id")
    return docs.join(ids.toDF(name), F.col(f"`{id_col}`").eqNullSafe(F.col(name)), how)


#: Marked rows that are broadcast; more are joined by a shuffle.
MARKED = 200_000


def first_rows(docs: DataFrame, id_col: str, keyed, found: DataFrame) -> DataFrame:
    """``docs`` with one row of each group; all its columns stay as they are.

    ``found`` has ``id, key, group`` for each row of ``docs`` that may have
    company. The row with the smallest id stays (null is the largest), then the
    one with the smallest key; of several such rows the one whose JSON has the
    smallest hash, so each row is judged by its own text and one of identical
    rows stays. Rows are counted before any join, so a large group of repeated
    rows is one row a task.

    ``keyed(name)`` gives ``docs`` with each row's key in a column of that name; it
    is only needed where a marked id occurs in several rows. Texts are shuffled
    once at most, and not at all where few rows are marked."""
    order = F.struct(F.col("id").isNull().alias("last"), "id", "key")
    heads = settled(found.groupBy("group").agg(F.min(order).alias("head"), F.count("*").alias("rows"))
                    .where("rows > 1").select("group", "head"))
    counts = found.groupBy("group", "id", "key").agg(F.count("*").alias("n")).join(heads, "group")
    first = F.col("id").eqNullSafe(F.col("head.id")) & (F.col("key") == F.col("head.key"))
    counts = settled(counts.select("id", "key", "n", first.alias("first")))
    gone, again = counts.where("n > 1 or not first"), counts.where("n > 1 and first")

    ids = docs.select(F.col(f"`{id_col}`").alias("id"))
    marked = only(ids, "id", _sized(gone.select("id").distinct()), "left_semi")
    if marked.groupBy("id").count().where("count > 1").isEmpty():  # an id names its row
        return only(docs, id_col, _sized(gone.select("id")), "left_anti")

    key = unused(docs, "first_key")
    left = keyed(key)
    names = [unused(left, "marked_id"), unused(left, "marked_key")]

    def match(rows: DataFrame, how: str) -> DataFrame:
        own = F.col(f"`{id_col}`").eqNullSafe(F.col(names[0])) & (F.col(key) == F.col(names[1]))
        return left.join(_sized(rows.select("id", "key")).toDF(*names), own, how)

    kept = match(gone, "left_anti")
    if not again.isEmpty():
        row = F.struct(*[F.col(f"`{c}`") for c in left.columns])
        repeated = (match(again, "left_semi").select(row.alias("row")).groupBy(F.col(f"row.`{id_col}`"), F.col(f"row.`{key}`"))
                    .agg(F.min_by("row", F.sha2(F.to_json("row"), 256)).alias("row")).select("row.*"))
        kept = kept.union(repeated)
    return kept.drop(key)


def _sized(rows: DataFrame) -> DataFrame:
    """``rows`` (of a settled table) to be broadcast if they are few."""
    return F.broadcast(rows) if rows.count() <= MARKED else rows


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def shared(spark: SparkSession, obj):
    """A function that gives tasks a copy of ``obj``, whose attributes are
    broadcast; its class travels with the function."""
    kind, sent = type(obj), spark.sparkContext.broadcast(vars(obj))

    def get():
        copy = kind.__new__(kind)
        copy.__dict__.update(sent.value)
        return copy

    return get


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)
    off = off[column.offset: column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return off - off[0], raw[off[0]: off[-1]]


def chunks(off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold at most ``limit`` bytes each, one row at least."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of ``values[off[i]:off[i+1]]`` for each i; 0 for an empty range."""
    out = np.zeros((len(off) - 1, *values.shape[1:]), values.dtype if values.dtype.kind == "f" else np.int64)
    full = off[1:] > off[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, off[:-1][full], axis=0, dtype=out.dtype)
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_ODD = 0x9E3779B97F4A7C15
_ODD_INVERSE = pow(_ODD, -1, 1 << 64)


def powers(n: int, base: int = _ODD) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), np.uint64(base), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte positions) of the words, runs of bytes other than
    the six ASCII white-space bytes, and the offsets of each row's words.
    A row's end also ends a word."""
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    begin = ~blank
    begin[1:] &= blank[:-1]
    heads = off[:-1][off[:-1] < off[1:]]
    begin[heads] = ~blank[heads]
    stop = ~blank
    stop[:-1] &= blank[1:]
    tails = off[1:][off[:-1] < off[1:]] - 1
    stop[tails] = ~blank[tails]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes, by a running polynomial."""
    up, down = powers(len(raw) + 1), powers(len(raw) + 1, _ODD_INVERSE)
    run = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1], out=run[1:])
    return mixed((run[ends] - run[starts]) * down[starts])
