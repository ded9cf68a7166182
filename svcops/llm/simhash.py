"""SimHash near-duplicates found by covering locality-sensitive hashing.

A document's fingerprint has bit b set when more than half of its shingle
hashes (XXH64, seed 42) have it set. Two fingerprints link when they differ in
at most ``radius`` bits. Candidates come from 2**(radius+1) - 1 structured bit
masks: bit i carries a vector phi(i) of radius+1 bits, and mask v holds the
bits whose phi(i) has an odd product with v. For any ``radius`` differing bits
some v is orthogonal to all their vectors, so every pair within the radius
agrees on all bits of at least one mask: nothing is missed.

Documents are first grouped by equal fingerprint, so copies cost nothing.
Buckets of up to ``CELL`` fingerprints are compared in one task; a larger
bucket is split by a hash into parts and every pair of parts becomes a cell of
its own, so a hot bucket spreads over tasks and nothing is skipped. A cell
returns the links of a spanning forest, not all pairs. Links feed a
distributed connected-components job.

Defined results: null and empty texts have fingerprint zero and link like any
other; fewer words than the shingle length make one shingle; rows with a null
id get a component like any other but never name one unless all are null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from svcops.llm.common import first_rows, utf8
from svcops.llm.components import components
from svcops.session import settled

BITS = 64
SEED = 42
SHINGLE_WORDS = 3
RADIUS = 3
CELL = 2048
#: Bits are counted for so many shingles at a time.
_BLOCK = 1 << 15


def _fingerprint(hashes: np.ndarray) -> np.uint64:
    n, total = len(hashes), np.zeros(BITS, np.int64)
    for i in range(0, n, _BLOCK):
        part = hashes[i: i + _BLOCK].view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0]


def text_fingerprint(text: bytes, shingle: int = SHINGLE_WORDS) -> np.uint64:
    """Fingerprint of one UTF-8 text; bytes.split() cuts at the six ASCII
    white-space bytes and bytes.lower() changes A-Z alone."""
    found = text.lower().split()
    if not found:
        return np.uint64(0)
    joined = b" ".join(found)
    end = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    start = np.concatenate([[0], end[:-1] + 1])
    k = max(len(found) - shingle, 0)
    digest = xxhash.xxh64_intdigest
    spans = zip(start[: k + 1].tolist(), end[min(shingle, len(found)) - 1:].tolist(), strict=True)
    return _fingerprint(np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, k + 1))


def _text_fingerprints(column, shingle: int) -> np.ndarray:
    off, raw = utf8(column)
    data = raw.tobytes()
    spans = zip(off[:-1].tolist(), off[1:].tolist(), strict=True)
    return np.fromiter((text_fingerprint(data[a:b], shingle) for a, b in spans), np.uint64, len(off) - 1)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``id, fp``: the 64 bits as a signed bigint."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            fp = _text_fingerprints(batch.column("text"), shingle)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fp.view(np.int64))], ["id", "fp"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp bigint")


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The masks as signed 64-bit integers. phi(i) runs through all non-zero
    vectors in turn, so each mask holds about 8/15 of the bits at radius 3."""
    top = (1 << (radius + 1)) - 1
    masks = []
    for v in range(1, top + 1):
        m = sum(1 << i for i in range(bits) if bin((i % top + 1) & v).count("1") & 1)
        masks.append(m - (1 << 64) if m >> 63 else m)
    return masks


def _links(fp: np.ndarray, cell: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside each run of equal ``cell`` numbers (rows sorted by cell)."""
    head = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    size = np.diff(np.concatenate([head, [len(cell)]]))
    small = np.repeat(size <= 32, size)
    out = []
    for step in range(1, min(32, int(size[size <= 32].max(initial=1)))):
        near = (cell[step:] == cell[:-step]) & small[step:]
        at = np.flatnonzero(near & (np.bitwise_count(fp[step:] ^ fp[:-step]) <= radius))
        out.append((fp[at], fp[at + step]))
    for h, n in zip(head[size > 32].tolist(), size[size > 32].tolist(), strict=True):
        own = fp[h: h + n]
        label = np.arange(n)
        near = np.stack([np.bitwise_count(own ^ x) <= radius for x in own])
        while True:  # smallest reachable row, a step further in each turn
            new = np.where(near, label, n).min(axis=1)
            new = new[new]
            if (new == label).all():
                break
            label = new
        far = np.flatnonzero(label != np.arange(n))
        out.append((own[far], own[label[far]]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (fp[:0], fp[:0])


def link_cells(batches, radius: int):
    """Rows (cell key columns..., fp) sorted by key arrive in batches; a cell
    that goes on in the next batch is held back until it is complete."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        keys = np.stack([table.column(k).to_numpy() for k in ("mask", "key", "part_a", "part_b")], axis=1)
        new = np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]) if len(keys) else np.zeros(0, bool)
        last = int(np.flatnonzero(new)[-1]) if len(keys) else 0
        held = table.slice(last)
        if last:
            yield _linked(table.slice(0, last), new[:last], radius)
    if held is not None and held.num_rows:
        keys = np.zeros(held.num_rows, bool)
        keys[0] = True
        yield _linked(held, keys, radius)


def _linked(table: pa.Table, new: np.ndarray, radius: int) -> pa.RecordBatch:
    fp = table.column("fp").to_numpy().view(np.uint64)
    a, b = _links(np.ascontiguousarray(fp), np.cumsum(new), radius)
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def links(distinct: DataFrame, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """Links ``a, b`` between the distinct fingerprints of column ``fp``; they
    connect exactly what all pairs within the radius connect."""
    masks = [F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
             for i, m in enumerate(covering_masks(radius))]
    rows = distinct.select("fp", F.explode(F.array(*masks)).alias("m")).select("m.mask", "m.key", "fp")
    sizes = rows.groupBy("mask", "key").count().where("count > 1")
    parts = F.ceil(F.col("count") / cell).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")).cast("int")
    both = F.transform(F.sequence(F.lit(0), F.col("parts") - 1),
                       lambda k: F.struct(F.least("own", k).alias("a"), F.greatest("own", k).alias("b")))
    cells = (rows.join(sizes, ["mask", "key"]).withColumn("parts", parts).withColumn("own", own)
             .select("mask", "key", "fp", F.explode(both).alias("p"))
             .select("mask", "key", F.col("p.a").alias("part_a"), F.col("p.b").alias("part_b"), "fp"))
    key = ["mask", "key", "part_a", "part_b"]
    cells = cells.repartition(*key).sortWithinPartitions(*key, "fp")
    return cells.mapInArrow(lambda batches: link_cells(batches, radius), "a bigint, b bigint").distinct()


def _components(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE_WORDS, radius: int = RADIUS,
                cell: int = CELL) -> tuple[DataFrame, DataFrame]:
    """``id, fp`` of every document, and ``fp, root, least`` of every fingerprint."""
    fps = settled(fingerprints(docs, id_col, text_col, shingle))
    nodes = fps.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(links(nodes.select("fp"), radius, cell), "a", "b")
    nodes = nodes.join(roots, nodes["fp"] == roots["node"], "left")
    return fps, settled(nodes.select("fp", F.coalesce("root", "fp").alias("root"), "least"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE_WORDS, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id``."""
    fps, nodes = _components(docs, id_col, text_col, shingle, radius, cell)
    named = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = nodes.select("fp", "root").join(named, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return fps.join(named, "fp").select(F.col("id").alias("doc_id"), hexed, "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the first row of each component; each row is judged by its own fingerprint."""
    fps, nodes = _components(docs, id_col, text_col)
    found = fps.join(nodes, "fp").select("id", F.col("fp").alias("key"), F.col("root").alias("group"))

    def keyed(key: str) -> DataFrame:
        def run(batches):
            for batch in batches:
                fp = _text_fingerprints(batch.column(text_col), SHINGLE_WORDS)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp.view(np.int64))], [*batch.schema.names, key])

        return docs.mapInArrow(run, docs.select("*", F.lit(0).cast("bigint").alias(key)).schema)

    return first_rows(docs, id_col, keyed, found)
