"""The registered queries: each operator over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farewise.llm import (alignment, fingerprints, jaccard, licenses, mixing, packing, ranked, repeats, simhash, token_counts,
                          token_files, topk, toxicity, words)
from farewise.llm.common import table
from farewise.session import materialize, scratch_path


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), words.tokenizer_path("word_bpe_49k.json"))


def op2_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), words.tokenizer_path("byte_bpe_50k.json"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus' own number of tokens, mixed to 95 % of the greatest entropy over sources."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.token_column().alias("n_tokens"))
    docs = materialize(docs, "tokens")
    total = docs.agg(F.sum("n_tokens")).first()[0] or 0
    mixed = mixing.mix_sources(docs, tokens=F.col("n_tokens"), entropy_share=0.95, budget_tokens=int(total))
    return mixed.select("doc_id", "source", "n_tokens", "mix_weight", "mix_epoch", "mix_block_order", "mix_doc_order")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, words.tokenizer_path("word_bpe_49k.json"))
    return token_files.read_token_files(spark, path)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(table(spark, sf_dir, "documents"), words.tokenizer_path("byte_bpe_50k.json"),
                                     words.tokenizer_path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_counts, op2_maxscore, op3_toxicity, op4_jaccard_join, op5_packing, op6_mixing,
                                  op7_fingerprints, op8_repeats, op9_token_files, op10_license_scan, op11_ranked_search,
                                  op12_simhash, op13_alignment)}

#: DuckDB statements of the queries that SQL can express.
ORACLE: dict[str, str] = {"op2_maxscore": topk.ORACLE, "op10_license_scan": licenses.oracle(),
                          "op11_ranked_search": ranked.ORACLE}
