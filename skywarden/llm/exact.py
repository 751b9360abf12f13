"""Exact dedup: group by a 128-bit hash of the normalised text, compare the bytes inside groups, keep the smallest id.

Two plans over the table. The first groups by (hash, text): the text is part of the grouping key, so texts that share a
hash but differ in a byte fall into different groups; copies are merged before the shuffle, so a text that makes up a third
of the rows leaves each task once. The second is a narrow list of digests, joined to the groups on both digests; the groups
are a written table, so that either side of the join is a plain exchange and Spark can split a hot hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skywarden.session import written

SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: str) -> Column:
    return F.coalesce(F.regexp_replace(text, SPACES, " "), F.lit(""))


def grouped(rows: DataFrame, *measures: Column) -> DataFrame:
    """``rows`` (doc_id, norm) by text: the hash deals them out, the text tells them apart."""
    return rows.groupBy(F.unhex(F.md5("norm")).alias("hash"), "norm").agg(*measures)


def mark_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space became one space; a null text counts as empty, and empty
    texts are copies of each other. Rows that repeat an identifier are one document: if it stays, they all say so. A
    null identifier loses against any other; in a group of nulls only, keep_id is null and the rows are kept. Other columns
    are not looked at.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), normalised(text).alias("norm"))
    digest = [F.unhex(F.md5("norm")).alias("hash"), F.unhex(F.sha2("norm", 256)).alias("sha")]
    groups = (grouped(rows, F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
              .select("hash", digest[1], "keep_id", "group_size"))
    groups = written(groups, "groups")
    return rows.select("doc_id", *digest).join(groups, ["hash", "sha"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


def without(docs: DataFrame, doc_id: str, verdicts: DataFrame) -> DataFrame:
    """The documents less those that ``verdicts`` (doc_id, kept) drops in each of their rows, with their own columns.

    What is dropped is the shorter list; while Spark can broadcast it, no text is moved.
    """
    gone = verdicts.groupBy(F.col("doc_id").alias("_gone")).agg(F.max("kept").alias("kept")).where("not kept").select("_gone")
    gone = written(gone, "gone")
    return docs.join(gone, docs[doc_id].eqNullSafe(gone["_gone"]), "left_anti")


def without_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with their own columns: those ``mark_copies`` says are kept.

    A document stays if it is the smallest of a group, so the groups' smallest identifiers, beside all identifiers, say what goes;
    digests are not joined, and the list of what goes is the only table written.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), normalised(text).alias("norm"))
    smallest = grouped(rows, F.min("doc_id").alias("doc_id")).select("doc_id", F.lit(True).alias("kept"))
    return without(docs, doc_id, rows.select("doc_id", F.lit(False).alias("kept")).union(smallest))
