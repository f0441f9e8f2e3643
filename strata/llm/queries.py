"""Registered queries of the subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import bpe, conv_trie, langid, lexical, line_dedup, mixing, ngram_join, substring
from strata.llm.fingerprint import edited_fingerprints
from strata.llm.quality import quality_rules
from strata.llm.token_counts import token_counts
from strata.llm.token_files import read_token_files, write_token_files
from strata.llm.url_rules import judge_urls
from strata.sources.tables import read_table, shared_folder


def _tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), _tokenizer_path("byte_bpe_50k.json"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    rows = langid.identify(docs, model)
    return rows.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(read_table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "token-files")
    write_token_files(read_table(spark, sf_dir, "documents"), folder, _tokenizer_path("word_bpe_49k.json"), end_id=2)
    return read_token_files(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(read_table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.line_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.col("_n_removed").alias("n_removed"), "text")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix_sources(docs).select(
        "doc_id", F.coalesce("source", F.lit("")).alias("source"),
        *(F.col(f"_{c}").alias(c) for c in ("block", "slot", "release", "due", "before")),
    )


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "labels"))


def byte_bpe(docs: DataFrame, keep_ids: bool = False, id_col: str = "doc_id") -> DataFrame:
    import public_tokenizers

    return bpe.encode_and_decode(docs, _tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, id_col, keep_ids=keep_ids)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe(read_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv_trie.conversation_trie(read_table(spark, sf_dir, "conversations"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring.substring_dedup(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id, op2_ngram_join, op3_token_files, op4_token_counts, op5_fingerprints,
        op6_line_dedup, op7_mix_sources, op8_url_filters, op9_byte_bpe, op10_quality_rules,
        op11_conversation_trie, op12_ranked_search, op13_substring_dedup,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op2_ngram_join": ngram_join.SQL,
    "op6_line_dedup": line_dedup.SQL,
    "op7_mix_sources": mixing.SQL,
    "op11_conversation_trie": conv_trie.SQL,
    "op12_ranked_search": lexical.SQL,
    "op13_substring_dedup": substring.SQL,
}
