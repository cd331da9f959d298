"""Exact deduplication by progressive refinement: length, then a prefix hash, then the full hash.

Built on DataFrame functions only. Two texts are equal when they are identical after lower-casing A-Z.

Defined cases: a null text is empty; all empty texts are one group. A null id ranks below every id. Rows that repeat
both id and text are one document given several times, so one of them is kept. An empty table gives no rows. Other
columns are never read by the decision, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkshelf.llm.columns import dealt_apart, fresh, whole

#: Characters of the prefix hash, the second refinement.
PREFIX_CHARS = 96


def lowered(text: Column) -> Column:
    """``text`` with A-Z lower-cased and every other character as it is."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def content_hash(text: Column) -> Column:
    return F.sha2(lowered(text), 256)


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """``(digest, keep_id, group_size)`` for each text that occurs twice or more.

    Each step sees only what the one before could not tell apart: the lengths of all rows, prefixes where a length
    repeats, whole texts where length and prefix repeat. Counts are combined before they are shuffled, so a large group
    costs one row a task.
    """
    rows = docs.select(F.col("doc_id").alias("id"), whole().alias("body")).withColumn("size", F.octet_length("body"))
    rows = rows.withColumn("head", F.xxhash64("size", lowered(F.substring("body", 1, PREFIX_CHARS))))
    again = lambda df, key: df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key, dealt_apart(key).alias("apart"))
    begun = rows.select("size", "head", dealt_apart("size").alias("apart")).join(again(rows, "size"), ["size", "apart"], "left_semi")
    # By the hash alone, which covers the length: dealt anew after partial counts, not by length as the join was.
    alike = rows.withColumn("apart", dealt_apart("head")).join(again(begun, "head"), ["head", "apart"], "left_semi")
    return (
        alike.select("id", content_hash(F.col("body")).alias("digest"))
        .groupBy("digest").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
        .filter("group_size > 1")
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns."""
    (stays,) = fresh(docs, "kept")
    return exact_duplicates(docs).filter(F.col(stays)).select(*[F.col(f"`{c}`") for c in docs.columns])


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with the decision on each row: keep id, size of its group, whether it stays, digest of its text."""
    digest, keep, size, stays, nth = fresh(docs, "text_sha256", "keep_id", "group_size", "kept", "nth")
    groups = duplicate_groups(docs).toDF("g_digest", "g_keep", "g_size")
    hashed = docs.withColumn(digest, content_hash(whole()))
    joined = hashed.join(groups, (F.col(digest) == F.col("g_digest")) & (dealt_apart(digest) == dealt_apart("g_digest")), "left")
    single = F.col("g_digest").isNull()
    # Dealt by text and id, not by text alone: the join above may then split a group that holds much of the table.
    repeated = F.row_number().over(Window.partitionBy(digest, "doc_id").orderBy(F.lit(0)))
    return (
        joined.withColumn(keep, F.when(single, F.col("doc_id")).otherwise(F.col("g_keep")))
        .withColumn(size, F.coalesce("g_size", F.lit(1).cast("bigint")))
        .repartition(F.col(digest), F.col("doc_id"))
        .withColumn(nth, repeated)
        .withColumn(stays, F.col("doc_id").eqNullSafe(F.col(keep)) & (F.col(nth) == 1))
        .drop("g_digest", "g_keep", "g_size", nth)
    )
