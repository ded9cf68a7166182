"""Documents packed into sequences of bounded length, as few as can be found.

Every document is its token ids and an end id. A longer one than a sequence is
cut into pieces of full length, the first of which holds the rest. Pieces of
one length are interchangeable, so a grouping genetic algorithm (``grouping``)
packs how many there are of each length, a table of at most ``capacity`` rows
however large the corpus is, over all documents at once. Its kinds of bins give
the places for each length in order; a piece takes the place of its rank among
the pieces of its length. Ranks are counted in salted groups of about
``GROUP`` rows, so a length that a third of the corpus has is no hot key.

Defined results: a null or empty text is its end id alone; rows of equal or null
ids each have pieces of their own; an empty table has none; other columns are
not read. Texts are tokenized whole.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from svcops.llm.grouping import Genome, packed
from svcops.llm.tokens import ByteTokens
from svcops.session import scratch_path

CAPACITY = 1024
END_ID = 2
#: Pieces of one length that are ranked in one group, about.
GROUP = 1_000


def piece_starts(length: int, capacity: int) -> list[int]:
    """Where the pieces of a document start: all but the first are full."""
    first = length - (-(-length // capacity) - 1) * capacity
    return [0, *range(first, length, capacity)]


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
           end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches):
        model = ByteTokens(tokenizer, plain=False)
        for batch in batches:
            doc, out = [], []
            for i, text in enumerate(batch.column("text")):
                ids = np.append(model.ids(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                starts = piece_starts(len(ids), capacity)
                ends = [*starts[1:], len(ids)]
                doc += [i] * len(starts)
                out += [(k, a, b - a, zlib.crc32(ids[a:b])) for k, (a, b) in enumerate(zip(starts, ends, strict=True))]
            k, start, length, crc = zip(*out, strict=True) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(doc, pa.int64())), pa.array(k, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


class Places:
    """For each length, the places that the bins offer, in order."""

    def __init__(self, bins: Genome):
        lengths, first, each, base, offset = [], [], [], [], []
        given: dict[int, int] = {}
        at = 0
        for sizes, n in sorted(bins.items(), reverse=True):
            inside = 0
            for size in dict.fromkeys(sizes):
                k = sizes.count(size)
                lengths.append(size)
                first.append(given.get(size, 0))
                each.append(k)
                base.append(at)
                offset.append(inside)
                given[size] = given.get(size, 0) + n * k
                inside += size * k
            at += n
        order = np.lexsort((first, lengths))
        self.lengths, self.first, self.each, self.base, self.offset = (
            np.array(x, np.int64)[order] for x in (lengths, first, each, base, offset))

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the piece of each rank among those of its length."""
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for size in np.unique(length):
            own = np.flatnonzero(length == size)
            lo, hi = np.searchsorted(self.lengths, [size, size + 1])
            at = lo + np.searchsorted(self.first[lo:hi], rank[own], "right") - 1
            nth = rank[own] - self.first[at]
            sequence[own] = self.base[at] + nth // self.each[at]
            offset[own] = self.offset[at] + nth % self.each[at] * size
        return sequence, offset


def ranked(found: DataFrame, counts: dict[int, int], group: int = GROUP) -> DataFrame:
    """``found`` (with a unique ``row``) and ``rank``, from 0 among the rows of a
    length; rows are numbered inside salted groups, then the groups' sizes are
    summed up."""
    salts = F.array([F.lit(-(-counts.get(size, 0) // group) or 1) for size in range(max(counts, default=0) + 1)])
    salted = found.withColumn("salt", F.pmod(F.xxhash64("row"), salts[F.col("length").cast("int")]))
    inside = F.row_number().over(Window.partitionBy("length", "salt").orderBy("row"))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.partitionBy("length").orderBy("salt")) - F.col("size")
    sizes = sizes.select("length", "salt", before.alias("before"))
    return (salted.withColumn("inside", inside).join(sizes, ["length", "salt"])
            .withColumn("rank", F.col("before") + F.col("inside") - 1).drop("salt", "inside", "before"))


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         end_id: int = END_ID, seed: int = 1) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every
    piece; sequences are numbered from 0 and have no gaps inside."""
    spark = docs.sparkSession
    path = scratch_path(spark, "pieces")
    # written once: the rows get numbers that a repeated task would give again
    pieces(docs, tokenizer, id_col, text_col, capacity, end_id).withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    found = spark.read.parquet(path)
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = spark.sparkContext.broadcast(vars(Places(packed(spark, counts, capacity, seed))))

    def place(batches):
        own = Places({})
        own.__dict__.update(places.value)
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = own.of(length, rank)
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *map(pa.array, at)], [*names, "sequence_id", "offset"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return ranked(found, counts).mapInArrow(
        place, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
