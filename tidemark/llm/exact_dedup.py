"""Exact deduplication: group by a 128-bit content hash, keep the smallest stable id, compare bytes inside groups. Native.

Texts are equal when identical after replacing each run of ASCII white space by one space; null counts as empty.
The one wide shuffle carries each distinct text of a task once: `groupBy(hash, text)` combines copies before it, so a text that
fills a third of the table reaches the shuffle once a task, and grouping by the text itself compares bytes, which keeps two texts
with the same hash apart. Rows then find their group by two digests, without their texts. Spark splits a hot digest in that join (AQE).

Cases: null or empty text is the empty text; a null id is never the smallest while another id has the text; an empty table gives an empty result. In `exact_groups` rows that repeat an id
and its text are kept alike, as the answer is by id, and other columns are not read; `drop_exact_copies` leaves exactly one row a group, any one of those with the smallest id, and
carries other columns of any name and type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import named

#: White space besides the space itself.
OTHER_SPACE = "\t\n\x0b\x0c\r"


def normalised(text: str = "text") -> Column:
    """Each run of ASCII white space as one space. Single replacements are several times as fast as a regular expression, which only texts with two spaces in a row need."""
    spaced = F.coalesce(named(text), F.lit(""))
    for c in OTHER_SPACE:
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    return F.when(spaced.contains("  "), F.regexp_replace(spaced, " {2,}", " ")).otherwise(spaced)


def content_hash(text: Column) -> Column:
    """128 bits of MD5."""
    return F.unhex(F.md5(text.cast("binary")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=content_hash) -> DataFrame:
    """One row per row of `docs`: id, keep_id, group_size, kept, text_sha256.

    `digest` makes the grouping hash of a text; any function will do, a weak one only costs time.
    """
    rows = docs.select(named(id_col).alias("doc_id"), normalised(text_col).alias("norm"))
    groups = (
        rows.groupBy(digest(F.col("norm")).alias("g_hash"), F.col("norm"))
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("g_hash", F.sha2("norm", 256).alias("g_sha"), "keep_id", "group_size")
    )
    keyed = rows.withColumn("hash", digest(F.col("norm"))).withColumn("text_sha256", F.sha2("norm", 256)).drop("norm")
    return keyed.join(groups, (F.col("hash") == F.col("g_hash")) & (F.col("text_sha256") == F.col("g_sha"))).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=content_hash) -> DataFrame:
    """One row of each group of equal texts, with all its columns: the row of the smallest id comes out of the grouping itself, in one shuffle of the texts."""
    text = named(text_col)
    norm = normalised(text_col)
    others = [named(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text_col]
    # The text as it was, where it is not the normalised one.
    raw = F.when(text.isNull() | (text != norm), F.struct(text.alias("text"))).alias("raw")
    rows = docs.select(norm.alias("norm"), F.struct(named(id_col).isNull(), named(id_col)).alias("by"), F.struct(raw, *others).alias("row"))
    kept = rows.groupBy(digest(F.col("norm")).alias("hash"), "norm").agg(F.min_by("row", "by").alias("row"))
    whole = F.when(F.col("row.raw").isNotNull(), F.col("row.raw.text")).otherwise(F.col("norm"))
    return kept.select(*(whole.alias(c) if c == text_col else F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)))


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""
