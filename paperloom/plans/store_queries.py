"""Queries of reads by id, merges of stored rows, sinks and their reads, weighted sums and sections."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions import text
from paperloom.operators import ranking, relational
from paperloom.plans.registry import query
from paperloom.plans.views import ACTIVITY, DOC_EDGES, WORKS, activity, doc_edges, with_, works
from paperloom.sources import store
from paperloom.tables import shared_folder, table


def _folder(spark, kind: str) -> str:  # noqa: ANN001
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}.{kind}"


@query(with_(WORKS, ACTIVITY) + "SELECT work_id, title FROM works WHERE work_id IN (SELECT work_id FROM activity)")
def works_by_ids(spark, d):  # noqa: ANN001
    return relational.load_by_ids(works(spark, d).select("work_id", "title"), activity(spark, d).select("work_id"), "work_id")


@query(with_(WORKS) + "SELECT work_id, CASE WHEN work_id % 3 = 0 THEN title ELSE title || '+' END AS title FROM works")
def inserted_where_new(spark, d):  # noqa: ANN001
    w = works(spark, d).select("work_id", "title")
    return relational.insert_ignore(w.where("work_id % 3 = 0"), w.withColumn("title", F.concat("title", F.lit("+"))), ["work_id"])


@query(with_(WORKS) + "SELECT doi, work_id, cited_by_count FROM (SELECT *, row_number() OVER (PARTITION BY doi ORDER BY cited_by_count DESC, work_id) AS r FROM (SELECT *, CASE WHEN work_id % 5 > 0 THEN 'd' || (work_id % 60) END AS doi FROM works)) WHERE r = 1 OR doi IS NULL")
def most_cited_by_doi(spark, d):  # noqa: ANN001
    i = F.col("work_id")
    w = works(spark, d).withColumn("doi", F.when(i % 5 > 0, F.concat(F.lit("d"), (i % 60).cast("string"))))
    return relational.best_per_key(w, "doi", F.desc("cited_by_count"), F.asc("work_id")).select("doi", "work_id", "cited_by_count")


@query(with_(WORKS) + "SELECT work_id, round(0.5 * cited_by_count / 5000 + 0.3 * coalesce(CASE WHEN work_id % 4 > 0 THEN year / 2025 END, 0) + 0.2 * length(title) / 100, 6) AS score FROM works")
def weighted_scores(spark, d):  # noqa: ANN001
    w = works(spark, d).select("work_id", (F.col("cited_by_count") / 5000).alias("cites"), F.when(F.col("work_id") % 4 > 0, F.col("year") / 2025).alias("recent"), (F.length("title") / 100).alias("told"))
    return w.select("work_id", F.round(ranking.weighted_sum({"cites": 0.5, "recent": 0.3, "told": 0.2}), 6).alias("score"))


@query("SELECT doc_id, CASE WHEN text != '' THEN substr(trim(text, ' '), 1, 200) END AS methods FROM documents")
def method_sections(spark, d):  # noqa: ANN001
    """Documents as the methods section of a paper, found again between its headers."""
    paper = F.concat(F.lit("Of much\n1. Methods and data:\n"), F.col("text"), F.lit("\n2. Results\nnone"))
    return table(spark, d, "documents").select("doc_id", text.section(paper, "methods?(?: and data)?", "results|discussion", 200).alias("methods"))


@query(
    with_(DOC_EDGES)
    + ", k AS (SELECT from_id, list(DISTINCT to_id::VARCHAR) AS kept FROM doc_edges GROUP BY 1), n AS (SELECT to_id AS from_id, list(DISTINCT from_id::VARCHAR) AS more FROM doc_edges WHERE from_id % 2 = 0 GROUP BY 1)"
    " SELECT from_id, array_to_string(list_sort(list_distinct(list_concat(coalesce(kept, []), coalesce(more, [])))), ' ') AS refs FROM k FULL JOIN n USING (from_id)"
)
def merged_references(spark, d):  # noqa: ANN001
    """What each work cites, and those with an even id that cite it, in one list."""
    e = doc_edges(spark, d)
    kept = e.groupBy("from_id").agg(F.collect_set(F.col("to_id").cast("string")).alias("kept"))
    more = e.where("from_id % 2 = 0").groupBy(F.col("to_id").alias("from_id")).agg(F.collect_set(F.col("from_id").cast("string")).alias("more"))
    both = kept.join(more, "from_id", "full_outer")
    return both.select("from_id", F.array_join(F.sort_array(store.merge_lists(F.col("kept"), F.col("more"))), " ").alias("refs"))


NODE = T.StructType([T.StructField("work_id", T.LongType()), T.StructField("year", T.IntegerType())])
EDGE = T.StructType([T.StructField("from_id", T.LongType()), T.StructField("to_id", T.LongType())])


@query(with_(WORKS, DOC_EDGES) + "SELECT w.work_id, w.year, count(to_id) AS n FROM works w LEFT JOIN doc_edges ON from_id = w.work_id GROUP BY ALL")
def stored_graph(spark, d):  # noqa: ANN001
    """A graph written and read again with its schemas."""
    path = _folder(spark, "graph")
    store.write_graph(works(spark, d).select("work_id", "year"), doc_edges(spark, d), path)
    nodes, edges = store.read_table(spark, f"{path}/nodes", NODE), store.read_table(spark, f"{path}/edges", EDGE)
    n = edges.groupBy(F.col("from_id").alias("work_id")).agg(F.count("to_id").alias("n"))
    return nodes.join(n, "work_id", "left").select("work_id", "year", F.coalesce("n", F.lit(0)).alias("n"))


@query(with_(WORKS) + "SELECT year AS query_id, work_id, row_number() OVER (ORDER BY cited_by_count DESC, work_id)::INT AS rank FROM works WHERE year = 1999")
def stored_results(spark, d):  # noqa: ANN001
    """Ranked works of every year written, those of one year read."""
    path = _folder(spark, "results")
    ranked = ranking.rank_by_score(works(spark, d).select(F.col("year").alias("query_id"), "work_id", F.col("cited_by_count").alias("score")), ["query_id"])
    store.write_ranked_results(ranked.select("query_id", "work_id", "rank"), path)
    return store.read_results(spark, path, 1999).select("query_id", "work_id", "rank")
