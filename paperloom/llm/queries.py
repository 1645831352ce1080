"""The registered queries of this subpackage and, where SQL can express them, their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import bpe, collocations, embedding_join, filter_audit, jaccard_join, language_id, mixing, quality, recompression, shards, suffix_dedup, token_files, toxicity
from paperloom.tables import table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.metric_join(table(spark, sf_dir, "embeddings"))


def op4_gated_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_id.identify(docs).select("doc_id", "held_out", "lang_pred", "score")


def op5_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.lpt_shards(table(spark, sf_dir, "documents"))


def op6_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_features(table(spark, sf_dir, "documents"))


def op8_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.systematic_mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = recompression.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_tokens(spark, folder)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filter_audit.judged_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return filter_audit.filter_audit(rows, list("ABCDE"), ["good", "toxic"])


def op13_phrase_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_suffix_array": op2_suffix_array,
    "op3_metric_join": op3_metric_join,
    "op4_gated_language": op4_gated_language,
    "op5_lpt_shards": op5_lpt_shards,
    "op6_kneser_ney_toxicity": op6_kneser_ney_toxicity,
    "op7_compression_bands": op7_compression_bands,
    "op8_systematic_mix": op8_systematic_mix,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_recompression": op10_recompression,
    "op11_token_files": op11_token_files,
    "op12_filter_audit": op12_filter_audit,
    "op13_phrase_tiles": op13_phrase_tiles,
}

ORACLE_SQL: dict[str, str] = {"op8_systematic_mix": mixing.OP8_SQL, "op12_filter_audit": filter_audit.OP12_SQL, "op13_phrase_tiles": collocations.OP13_SQL}
