"""The dealt queries and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import bpe, bytespans, exact_dedup, fim, fingerprint, langid, packing, ppm, sharding, simhash, substring, toxicity, variants
from quire.llm.common import documents, spread


def op1_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.lm_scores(documents(spark, sf_dir))


def op2_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return sharding.shard_documents(docs, in_place=True).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return exact_dedup.exact_dedup(docs, in_place=True).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_word_first_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(spread(documents(spark, sf_dir).select("doc_id", "text", "lang")))


def op5_simhash_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spread(documents(spark, sf_dir))).select("doc_id", "fingerprint", "component_id")


def op6_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spread(documents(spark, sf_dir))).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")


def op7_toxicity_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(spread(documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_suffix_tree_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_digests(documents(spark, sf_dir).select("doc_id", "text"), in_place=True)


def op9_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(spread(documents(spark, sf_dir)))


def op10_one_permutation_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(documents(spark, sf_dir))


def op11_fim_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fim_digests(spread(documents(spark, sf_dir).select("doc_id", "text")))


def op12_wildcard_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.document_variants(spread(documents(spark, sf_dir).select("doc_id", "text")))


def op13_external_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytespans.byte_digests(documents(spark, sf_dir).select("doc_id", "text"), in_place=True)


QUERIES = {
    f.__name__: f
    for f in (
        op1_ppm_scores,
        op2_rendezvous_shards,
        op3_exact_dedup,
        op4_word_first_language,
        op5_simhash_pigeonhole,
        op6_binary_packing,
        op7_toxicity_trees,
        op8_suffix_tree_repeats,
        op9_bpe_automaton,
        op10_one_permutation_minhash,
        op11_fim_scan,
        op12_wildcard_variants,
        op13_external_suffix_arrays,
    )
}
ORACLES = {"op3_exact_dedup": exact_dedup.ORACLE_SQL, "op11_fim_scan": fim.ORACLE_SQL, "op12_wildcard_variants": variants.ORACLE_SQL, "op13_external_suffix_arrays": bytespans.ORACLE_SQL}
