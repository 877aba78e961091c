"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bin_packing, exact_dedup, hyperplane_dedup, language_id, license_scan, merkle, prefix_trie, rank_queue_bpe, simhash_trie, token_counts, token_planes, toxicity, vp_trees
from tidemark.llm.common import id_bucket, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(id_bucket("doc_id", 4) != 2)
    scored = toxicity.score(docs, toxicity.fit(docs, labels), out="score")
    return scored.select("doc_id", F.coalesce(id_bucket("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op2_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_planes.new_folder(spark)
    manifest = token_planes.write_ids(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 2, folder)
    return token_planes.read_ids(spark, manifest, folder)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("spans")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op6_vp_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vp_trees.nearest(table(spark, sf_dir, "embeddings"), "id % 100 = 0")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_bucket("doc_id", 5) == 0  # null for a null id: neither held out nor learnt from
    found = language_id.predict(docs.select("doc_id", "text"), language_id.fit(docs, ~held_out), out="found")
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("found.pred").alias("lang_pred"), F.col("found.score").alias("score"), F.col("found.rejected").alias("rejected"))


def op8_rank_queue_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return rank_queue_bpe.encode_and_decode(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_trie.near_duplicates(table(spark, sf_dir, "documents"))


def op10_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 1)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_check(table(spark, sf_dir, "documents"))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperplane_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_token_planes, op3_license_scan, op4_token_counts, op5_exact_dedup, op6_vp_trees, op7_language_id, op8_rank_queue_bpe, op9_simhash_trie, op10_bin_packing,
        op11_merkle_manifest, op12_embedding_dedup, op13_prefix_trie, pipeline,
    )
}
ORACLES = {
    "op3_license_scan": license_scan.oracle_sql(), "op5_exact_dedup": exact_dedup.ORACLE_SQL, "op6_vp_trees": vp_trees.ORACLE_SQL, "op11_merkle_manifest": merkle.ORACLE_SQL,
    "op12_embedding_dedup": hyperplane_dedup.ORACLE_SQL, "op13_prefix_trie": prefix_trie.ORACLE_SQL,
}
