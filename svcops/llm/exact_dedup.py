"""Exact dedup by progressive refinement (DataFrame functions only).

Texts are equal when they are identical after each run of ASCII white space
became one space. Rows are first grouped by the length of that text, then by a
hash of its beginning; only rows whose group still has a second member are
read in full and grouped by SHA-256. All groupings are counts with map-side
partial aggregation, so a group that holds a third of the rows costs each task
one row; the joins that mark members are equi-joins that adaptive execution
splits.

Defined results: null text counts as empty, and empty texts equal each other;
of equal texts the row with the smallest id stays (null ids are never the
smallest unless all are null); each row is judged by its own text, also where
ids repeat or are null; ``exact_groups`` marks every row with the staying id as
kept, while ``exact_dedup`` leaves one row of each group; an empty table gives an
empty result; other columns don't matter, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from svcops.llm.common import SPACES, first_rows, only
from svcops.session import settled

PREFIX_CHARS = 256


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACES, " ")


def sha256(text: Column) -> Column:
    """Lowercase hex SHA-256 of the normalised text's UTF-8 bytes."""
    return F.sha2(normalised(text).cast("binary"), 256)


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """The rows that have an equal: ``id, digest, keep_id, group_size``."""
    text = normalised(F.col(f"`{text_col}`"))
    size = F.octet_length(text).alias("size")
    rows = settled(docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("t")).select(
        "id", F.octet_length("t").alias("size"),
        F.xxhash64(F.substring("t", 1, prefix_chars)).alias("prefix")))

    # rounds 1 and 2 work on counts, so a group of copies is one row a task
    starts = rows.groupBy("size", "prefix").count()
    lengths = starts.groupBy("size").agg(F.sum("count").alias("n")).where("n > 1").select("size")
    starts = starts.join(lengths, "size", "left_semi").where("count > 1").select("size", "prefix")
    same_start = rows.join(starts, ["size", "prefix"], "left_semi")
    full = only(docs, id_col, same_start.select("id").distinct(), "left_semi").select(
        F.col(f"`{id_col}`").alias("id"), size, sha256(F.col(f"`{text_col}`")).alias("digest"))
    full = settled(full)
    # settled, so that both sides of the join are plain shuffles, which adaptive
    # execution splits where a third of the rows are copies of one text
    groups = settled(full.groupBy("size", "digest")
                     .agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
                     .where("group_size > 1"))
    return full.join(groups, ["size", "digest"]).select("id", "digest", "keep_id", "group_size")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    found = (copies(docs, id_col, text_col).groupBy("id", "digest")
             .agg(F.min("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"),
                       sha256(F.col(f"`{text_col}`")).alias("text_sha256"))
    joined = rows.join(found, rows["doc_id"].eqNullSafe(found["id"]) & (rows["text_sha256"] == found["digest"]), "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select("doc_id", keep.alias("keep_id"),
                         F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
                         F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, one of the smallest id; all columns stay."""
    found = copies(docs, id_col, text_col).select("id", F.col("digest").alias("key"), F.col("digest").alias("group"))
    return first_rows(docs, id_col, lambda key: docs.withColumn(key, sha256(F.col(f"`{text_col}`"))), found)
