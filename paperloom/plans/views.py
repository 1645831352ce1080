"""The literature tables that the queries need, derived from the given tables, and the same in SQL.

works from documents, queries from benchmark, judgments from labels, citation edges from documents
(one set of nodes) and lineitem (two), activity and ledger rows from events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.text import SPACED
from paperloom.tables import table

AS_OF = 2026
EIGHT_WORDS = r"^[\x09-\x0D ]*(?:[^\x09-\x0D ]+[\x09-\x0D ]+){0,7}[^\x09-\x0D ]*"


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.regexp_extract(F.coalesce(F.col("text"), F.lit("")), EIGHT_WORDS, 0)
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("work_id"),
        F.array_join(F.regexp_extract_all(start, F.lit(SPACED), F.lit(0)), " ").alias("title"),
        F.col("text").alias("abstract"),
        (1985 + (F.col("doc_id") * 7) % 40).cast("int").alias("year"),
        (F.col("doc_id") * 7919 % 5000).cast("int").alias("cited_by_count"),
        F.col("source").alias("topic"),
        F.col("lang").alias("subfield"),
    )


WORKS = r"""works AS (
  SELECT doc_id AS work_id, array_to_string(list_slice(regexp_extract_all(coalesce(text, ''), '[^\x09-\x0D ]+'), 1, 8), ' ') AS title, text AS abstract,
         (1985 + (doc_id * 7) % 40)::INT AS year, (doc_id * 7919 % 5000)::INT AS cited_by_count, source AS topic, lang AS subfield FROM documents)"""


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(SPACED), F.lit(0))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(words, " ").alias("query"))


QUERIES = r"""queries AS (SELECT item_id AS query_id, array_to_string(regexp_extract_all(coalesce(text, ''), '[^\x09-\x0D ]+'), ' ') AS query FROM benchmark)"""


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("work_id"), F.when(F.col("quality") == 1, 0.75).otherwise(0.25).alias("relevance"))


JUDGMENTS = "judgments AS (SELECT doc_id AS work_id, CASE WHEN quality = 1 THEN 0.75::DOUBLE ELSE 0.25::DOUBLE END AS relevance FROM labels)"


def doc_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id cites (doc_id * 13 + k * k) mod N for k from 1 to 5."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    k = F.explode(F.sequence(F.lit(1), F.lit(5))).alias("k")
    spread = docs.select("doc_id", k).join(F.broadcast(n))  # one row
    return spread.select(F.col("doc_id").alias("from_id"), ((F.col("doc_id") * 13 + F.col("k") * F.col("k")) % F.col("n")).alias("to_id"))


DOC_EDGES = "doc_edges AS (SELECT doc_id AS from_id, (doc_id * 13 + k * k) % (SELECT count(*) FROM documents) AS to_id FROM documents, generate_series(1, 5) AS g(k))"


def cite_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders cite parts: a large bipartite graph."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("from_id"), F.col("l_partkey").alias("to_id")).distinct()


CITE_EDGES = "cite_edges AS (SELECT DISTINCT l_orderkey AS from_id, l_partkey AS to_id FROM lineitem)"


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("map_id"), F.col("event_type").alias("activity_type"), F.get_json_object("props", "$.k").cast("long").alias("work_id"), F.col("ts").cast("timestamp").alias("ts"), "value"
    )


ACTIVITY = "activity AS (SELECT event_id, user_id AS map_id, event_type AS activity_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS work_id, ts, value FROM events)"


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "
