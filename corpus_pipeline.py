"""A training corpus from raw documents: language ID, toxicity, exact dedup, SimHash near-dedup, best-fit packing.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept; each result is written as Parquet and read again.
All but the last return the columns of `documents`; the last returns the packed pieces. The stages share the executors' memory, so those that run Python get small Arrow batches in the session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bin_packing, exact_dedup, language_id, simhash_trie, toxicity
from tidemark.llm.common import EXECUTOR_CACHE, columns_of, discard, fresh, id_bucket, named, small_batches, staged_at, table
from tidemark.llm.queries import vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language the compressors reject: no letters, or a margin too narrow.

    Null and empty texts, and texts without a letter, go; rows with a null id, and repeated rows, stay or go by their text; an empty table, or one without a language to learn from, gives none.
    """
    small_batches(spark)
    name = fresh(docs, "language")
    found = language_id.predict(docs, language_id.fit(docs, id_bucket("doc_id", 5) != 0), out=name)
    return found.where(~named(name)["rejected"]).select(*columns_of(docs))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier, trained on the labelled ones that are left, calls toxic.

    A null text scores as an empty one; repeated rows stay or go together; without a label nothing goes; an empty table gives an empty one.
    """
    small_batches(spark)
    labels = table(spark, sf_dir, "labels").where(id_bucket("doc_id", 4) != 2)
    name = fresh(docs, "toxicity")
    scored = toxicity.score(docs, toxicity.fit(docs, labels), out=name)
    return scored.where(named(name) < toxicity.THRESHOLD).select(*columns_of(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts: that of the smallest id, null ids last. Null and empty texts are equal."""
    return exact_dedup.drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of near-duplicates: that of the smallest id, null ids last, whether or not an id repeats."""
    return simhash_trie.drop_near_duplicates(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token sequences of what is left, every row's; a null text is the end id alone. Its workers have served the stages before, so they remember little."""
    small_batches(spark)
    return bin_packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), 1, cache=EXECUTOR_CACHE // 16)


STAGES = [("language ID", language), ("toxicity", toxic), ("exact dedup", exact), ("SimHash near-dedup", near), ("best-fit packing", packed)]

#: Trained models, fingerprints and tokens can't be written in SQL: the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, path = staged_at(stage(spark, docs, sf_dir), "pipeline")
        if before:
            discard(spark, before)  # the next stage's rows are written, nothing reads these any more
        before = path
    return docs
