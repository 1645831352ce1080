"""Typed reads, sinks of results and graphs, and records of several sources in one schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions.text import normalize_arxiv_id, normalize_doi, text_from_inverted_index
from paperloom.operators.components import connected_components
from paperloom.tables import stable

WORK = T.StructType(
    [
        T.StructField("work_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("cited_by_count", T.IntegerType()),
        T.StructField("authors", T.ArrayType(T.StringType())),
        T.StructField("venue", T.StringType()),
        T.StructField("doi", T.StringType()),
        T.StructField("abstract", T.StringType()),
        T.StructField("source", T.StringType()),
    ]
)


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stored table with its declared schema."""
    return spark.read.schema(schema).parquet(path)


def write_ranked_results(results: DataFrame, path: str) -> None:
    """Ranked rows with their breakdown, a folder a query, so that one query is read alone."""
    results.repartition("query_id").sortWithinPartitions("query_id", "rank").write.partitionBy("query_id").mode("overwrite").parquet(path)


def read_results(spark: SparkSession, path: str, query_id: int) -> DataFrame:
    """One query's rows by rank; only its folder is read."""
    return spark.read.parquet(path).where(F.col("query_id") == query_id).orderBy("rank")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def list_maps(maps: DataFrame, k: int) -> DataFrame:
    """(map_id, title, n_nodes, created_at) of the newest maps; ``response`` is JSON, malformed counts are null."""
    n = F.get_json_object("response", "$.metadata.node_count")
    return maps.select("map_id", F.get_json_object("response", "$.title").alias("title"), F.when(n.rlike("^[0-9]+$"), n.cast("int")).alias("n_nodes"), "created_at").orderBy(F.desc("created_at"), "map_id").limit(k)


def merge_lists(kept: Column, new: Column) -> Column:
    """Ids of both lists without repeats, in order of first sight."""
    return F.array_union(F.coalesce(kept, F.array().cast("array<string>")), F.coalesce(new, F.array().cast("array<string>")))


def from_catalog(records: DataFrame) -> DataFrame:
    """Records with nested authorships and an inverted abstract."""
    return records.select(
        F.regexp_extract("id", "(W[0-9]+)$", 1).alias("work_id"),
        "title",
        F.col("publication_year").alias("year"),
        F.coalesce("cited_by_count", F.lit(0)).alias("cited_by_count"),
        F.transform("authorships", lambda a: a["author"]["display_name"]).alias("authors"),
        F.col("primary_location.source.display_name").alias("venue"),
        normalize_doi(F.col("doi")).alias("doi"),
        text_from_inverted_index(F.col("abstract_inverted_index")).alias("abstract"),
        F.lit("catalog").alias("source"),
    )


def from_preprints(records: DataFrame) -> DataFrame:
    """Records with a date, a plain abstract and no citation counts."""
    return records.select(
        F.concat(F.lit("arxiv:"), "arxiv_id").alias("work_id"), F.regexp_replace(F.trim("title"), r"\s+", " ").alias("title"), F.year("published").alias("year"), F.lit(0).alias("cited_by_count"), "authors", F.lit("arXiv").alias("venue"), normalize_doi(F.col("doi")).alias("doi"), F.col("summary").alias("abstract"), F.lit("preprints").alias("source")
    )


def normalize_sources(catalog: DataFrame, preprints: DataFrame) -> DataFrame:
    """One works table of all sources."""
    return from_catalog(catalog).unionByName(from_preprints(preprints), allowMissingColumns=True)


def canonical_ids(records: DataFrame) -> DataFrame:
    """(record_id, canonical_id): records that share a DOI, an arXiv id or a lower-case title, directly or through others.

    ``records``: record_id, priority (of the source), doi, arxiv_id, title. The canonical id is the
    record of the least (priority, record_id) that shared keys reach, however many of them lie between;
    so it doesn't depend on the order of arrival. Each key is a star around its least record, and the
    stars are contracted: a round about halves what is left of a chain. Of records given more than
    once the least priority counts; a null priority comes last. Records without a key are their own.
    """
    keys = F.array(F.concat(F.lit("d:"), normalize_doi(F.col("doi"))), F.concat(F.lit("a:"), F.nullif(normalize_arxiv_id(F.col("arxiv_id")), F.lit(""))), F.concat(F.lit("t:"), F.lower(F.nullif(F.trim("title"), F.lit("")))))
    first = stable(records.groupBy("record_id").agg(F.min("priority").alias("priority"), F.flatten(F.collect_set(F.array_compact(keys))).alias("keys")))
    node = F.struct(F.coalesce(F.col("priority").cast("long"), F.lit(2**63 - 1)).alias("priority"), "record_id")
    held = first.select(node.alias("node"), F.explode("keys").alias("key")).distinct()
    stars = held.groupBy("key").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "least")
    roots = connected_components(held.join(stars, "key").select("node", "least"))
    moved = roots.select(F.col("node.record_id").alias("_moved"), F.col("root.record_id").alias("_to"))
    return first.select("record_id").join(moved, F.col("record_id") == F.col("_moved"), "left").select("record_id", F.coalesce("_to", "record_id").alias("canonical_id"))
