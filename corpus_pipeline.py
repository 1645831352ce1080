"""The corpus pipeline: five stages over ``documents``, each on what the one before it kept.

1. language: documents without a letter, or whose language the network can't tell, go.
2. near_duplicates: of documents linked by 5-word shingles at Jaccard 0.8, the smallest doc_id stays.
3. substrings: later copies of strings of 240 bytes are cut out, the first occurrence stays.
4. mix: sources are brought to their target weights, a row for each copy taken.
5. tokens: byte-level BPE ids of every text, decoded again to prove them.

Null texts end in the first stage. A text that the third stage empties stays, with no text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import bpe, jaccard_join, language_id, mixing, suffix_dedup
from paperloom.llm.repeats import keyed
from paperloom.tables import landed, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
REPEAT_BYTES = 240  # fifty words of prose have 250 bytes or more
LEAST_SCORE = 0.35  # four languages: a guess has 0.25


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network tells with at least ``LEAST_SCORE``.

    Null, empty and letterless texts go. Repeated rows and null doc_ids are judged each by its text;
    an empty table gives an empty one. Columns other than the five of ``documents`` are left out.
    """
    told = language_id.identify(docs)
    return told.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at Jaccard 0.8: the one of the smallest doc_id.

    A row is known by its doc_id and text, so of two texts under one doc_id each has its own fate, and
    a null doc_id is one like any other. Of rows that agree in both one stays, with the least (lang,
    source, n_chars), nulls first. Texts without a word are linked with nothing and stay.
    """
    groups = jaccard_join.jaccard_components(docs, k=5, percent=80)
    stay = groups.where("kept").select(F.coalesce("doc_id", F.lit(-(2**63))).alias("_doc"), F.col("key").alias("_key")).distinct()
    rows = keyed(docs, ("lang", "source", "n_chars"))
    rows = rows.join(stay, (rows["doc"] == stay["_doc"]) & (rows["key"] == stay["_key"]), "left_semi")
    one = rows.groupBy("doc", "key").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.min(F.struct("_c0", "_c1", "_c2")).alias("rest"))
    return one.select("doc_id", F.col("text").cast("string").alias("text"), F.col("rest._c0").alias("lang"), F.col("rest._c1").alias("source"), F.col("rest._c2").alias("n_chars"))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of strings of ``REPEAT_BYTES`` bytes; the first occurrence stays.

    First is the least (doc_id, position), null doc_ids before all. Rows that agree in doc_id and text
    are one document and are cut alike. A null text becomes an empty one; a text that was cut within a
    character has replacement characters there. n_chars is counted anew.
    """
    cut = suffix_dedup.remove_repeats(docs, length=REPEAT_BYTES, core=48, keep="first", carry=("lang", "source"))
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    return cut.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix of sources takes; documents that it doesn't take go.

    Null texts have size 0 and count like empty ones; null sources are a source, the last one.
    """
    return mixing.emit_copies(mixing.systematic_mix(docs), COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of ids and of the decoded text, ids and byte offsets of every row."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), with_ids=True)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("substrings", substrings), ("mix", mix), ("tokens", tokens)]
ORACLE_SQL = None  # the first stage is a trained network


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage before it is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = landed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
