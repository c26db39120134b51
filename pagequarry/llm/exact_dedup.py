"""Exact deduplication: group by a 128-bit content hash, smallest id stays.

Texts are equal when identical after every run of white space became one space.
Rows are grouped by the hash and, inside a hash, by the bytes of the text, so a
collision of the hash makes two groups.  The grouping moves every distinct text
once (map-side combine keeps one copy per task of a hot text); the verdicts go
back to the rows over narrow keys, where the adaptive join splits a hot group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.shared import SPACE_CLASS, fresh_name


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_CLASS + "+", " ")


def hash128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    content_hash: Callable[[Column], Column] = hash128,
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``.

    * A null text counts as empty; empty texts form one group.
    * Rows without an id belong to their group; they are kept only where the
      whole group has no id (``keep_id`` null).
    * Rows that repeat id and text are one document: each counts in
      ``group_size`` and all have the same ``kept``.
    * An empty table gives no rows; other columns are ignored.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("body"))
    keyed = base.select("doc_id", "body", content_hash(F.col("body")).alias("hash"), F.unhex(F.sha2("body", 256)).alias("sha"))
    groups = (
        keyed.groupBy("hash", "body")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("hash", F.unhex(F.sha2("body", 256)).alias("sha"), "keep_id", "group_size")
    )
    return (
        keyed.select("doc_id", "hash", "sha")
        .join(groups, ["hash", "sha"])
        .select(
            "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.lower(F.hex("sha")).alias("text_sha256"),
        )
    )


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Dropped ids are the small side of an anti join.  Rows without an id stay
    only where no row with an id has their text.  Rows that repeat id and text
    all stay or all go; a null text is empty.
    """
    verdict = exact_duplicates(docs, id_col, text_col)
    gone_id, gone_sha = fresh_name("gone"), fresh_name("sha")
    gone = verdict.where(~F.col("kept")).select(F.col("doc_id").alias(gone_id), F.col("text_sha256").alias(gone_sha))
    body = F.sha2(normalised(F.col(text_col)), 256)
    return docs.join(gone.distinct(), docs[id_col].eqNullSafe(F.col(gone_id)) & (body == F.col(gone_sha)), "left_anti")


SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM n
"""
