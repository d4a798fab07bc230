"""The corpus queries over the given tables and, where SQL can express them,
their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from herdflow.llm import (bpe_count, byte_cnn, decontam, dual_tree, kneser_ney, m_tree, mixing, quality_rules, rindex,
                          secret_scan, shard_tree, simhash, spelling)
from herdflow.llm.common import documents
from herdflow.llm.oracles import INNER_PRODUCTS_SQL, MIXING_SQL, RANKED_SQL, SHARDS_SQL, VARIANTS_SQL
from herdflow.sources.tables import table

SHARDS = 16
VOCABULARY = "byte_bpe_50k.json"
TOKEN_LIMIT = 1024


def op1_rindex_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """200-byte repeats of all documents, removed."""
    return rindex.repeated_spans(documents(spark, sf_dir)).drop("spans")


def op2_pigeonhole_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in all documents within the error budget."""
    found = decontam.contaminations(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    n = F.size("matches")
    return found.select("doc_id", (n > 0).alias("contaminated"), n.cast("long").alias("n_items"),
                        F.transform("matches", lambda x: x["item"]).alias("item_ids"),
                        F.array_min(F.transform("matches", lambda x: x["errors"])).alias("least_errors"))


def op3_heap_bpe_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    import public_tokenizers

    return bpe_count.count_tokens(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY), limit=TOKEN_LIMIT)


def op4_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents."""
    return simhash.simhash_components(documents(spark, sf_dir))


def op5_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents by the byte-level network."""
    return byte_cnn.score_quality(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by the bigram model of those not held out."""
    return kneser_ney.score_corpus(documents(spark, sf_dir))


def op7_ngram_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted quality rules and the hashed n-gram ratio of all documents."""
    return quality_rules.quality_table(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op8_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pfair mix of all documents to the sources' natural shares."""
    return mixing.mix_schedule(documents(spark, sf_dir), hot_factor=None)


def op9_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 15 by the weighted hash tree."""
    return shard_tree.shard_table(documents(spark, sf_dir), SHARDS)


def op10_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents by fixed patterns and Markov models."""
    return secret_scan.secret_table(documents(spark, sf_dir))


def op11_dual_tree_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best of all documents for every benchmark item."""
    return dual_tree.rank_documents(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op12_m_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 largest inner products of every query row with all other rows."""
    return m_tree.top_inner_products(table(spark, sf_dir, "embeddings"))


def op13_spelling_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their spelling forms."""
    return spelling.spelling_variants(documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline over the documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_rindex_repeats": op1_rindex_repeats,
        "op2_pigeonhole_decontam": op2_pigeonhole_decontam,
        "op3_heap_bpe_tokens": op3_heap_bpe_tokens,
        "op4_simhash_tiles": op4_simhash_tiles,
        "op5_byte_cnn": op5_byte_cnn,
        "op6_kneser_ney": op6_kneser_ney,
        "op7_ngram_quality": op7_ngram_quality,
        "op8_pfair_mixing": op8_pfair_mixing,
        "op9_hash_tree_shards": op9_hash_tree_shards,
        "op10_markov_secrets": op10_markov_secrets,
        "op11_dual_tree_ranking": op11_dual_tree_ranking,
        "op12_m_tree_top_k": op12_m_tree_top_k,
        "op13_spelling_tiles": op13_spelling_tiles,
        "pipeline": pipeline,
    }


def oracles() -> dict[str, str]:
    return {"op8_pfair_mixing": MIXING_SQL, "op9_hash_tree_shards": SHARDS_SQL, "op11_dual_tree_ranking": RANKED_SQL,
            "op12_m_tree_top_k": INNER_PRODUCTS_SQL, "op13_spelling_tiles": VARIANTS_SQL}
