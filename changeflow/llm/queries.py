"""The registered queries of the operators, one each, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.llm import align, chat, common, lines, near_dup, packing, ppm, quality, sampling, secrets, suffix_dedup, token_counts, topk, trie
from changeflow.llm.oracle import ORACLE

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.read_table(spark, sf_dir, "documents")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "symbols_failed", "lines_failed", "stutter_failed", "word_length_failed", "host_docs", "host_failed", "host_rejected")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(documents(spark, sf_dir))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_passages(documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_removed", "text")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    train = docs.filter(~ppm.held_out() & F.col("doc_id").isNotNull())
    model = ppm.fit(ppm.count_grams(train))
    return ppm.predict(docs, model).select("doc_id", ppm.held_out().alias("held_out"), "lang_pred", "score")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = chat.planted(common.read_table(spark, sf_dir, "conversations"))
    return chat.read_back(chat.format_conversations(conversations))


def op7_gumbel_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    sampled = sampling.sample_segmentations(documents(spark, sf_dir), ["doc_id"], public_tokenizers.path("piece_bpe_32k.model"))
    return sampled.select("doc_id", "rank", F.size("ids").cast("long").alias("n_pieces"),
                          F.crc32(F.array_join("ids", ",").cast("binary")).alias("ids_crc32"), "log_prob", "inclusion", "log_inclusion",
                          F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(common.read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), vocabulary()).select("doc_id", "n_tokens")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), vocabulary()).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(common.read_table(spark, sf_dir, "conversations")).drop("turn_conv_id", "turn_pos")


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align.align_corpus(documents(spark, sf_dir), vocabulary(), public_tokenizers.path("piece_bpe_32k.model"))[0]


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(documents(spark, sf_dir)).drop("found")


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_quality_rules, op2_minhash_near_dedup, op3_suffix_dedup, op4_line_dedup, op5_language_id, op6_chat_format, op7_gumbel_segmentations, op8_exact_topk, op9_token_counts, op10_packing,
    op11_prefix_trie, op12_tokenizer_alignment, op13_secret_scan)}

__all__ = ["QUERIES", "ORACLE"]
