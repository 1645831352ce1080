"""Queries over raw records of several sources, written as JSON from the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.plans.registry import query
from paperloom.plans.views import WORKS, with_, works
from paperloom.sources.raw import read_records


def raw_records(spark: SparkSession, d: str) -> DataFrame:
    """Each work as a record of one of four sources or of an unknown one; some cut short, some of a wrong type, some without an id."""
    i, s = F.col("work_id"), F.col("work_id").cast("string")
    doi, arxiv = F.concat(F.lit("https://doi.org/10.5/X"), s), F.concat(F.lit("arXiv:2301."), s, F.lit("v2"))
    record = (
        F.when(i % 5 == 0, F.to_json(F.struct(F.concat(F.lit("https://x.org/W"), s).alias("id"), "title", F.col("year").alias("publication_year"), "cited_by_count", doi.alias("doi"), F.lit("more").alias("extra"))))
        .when(i % 5 == 1, F.to_json(F.struct(F.when(i % 13 > 0, arxiv).alias("arxiv_id"), "title", "year", F.array(F.lit("A B"), F.lit("C")).alias("authors"), "abstract")))
        .when(i % 5 == 2, F.to_json(F.struct(s.alias("s2_id"), "title", F.when(i % 17 > 0, F.col("year").cast("string")).otherwise("soon").alias("venue"), "year", F.col("cited_by_count").alias("citations"), F.lit("10.7/y").alias("doi"), arxiv.alias("arxiv_id"))))
        .otherwise(F.to_json(F.struct(F.concat(F.lit("10.9/Z"), s).alias("DOI"), F.array("title").alias("title"), F.struct(F.array(F.array(F.col("year"))).alias("date-parts")).alias("published"), F.array(F.struct(F.lit("G").alias("given"), F.lit("F").alias("family"))).alias("author"))))
    )
    record = F.when(i % 11 == 0, F.substring(record, 1, 20)).otherwise(record)
    source = F.get(F.array(*map(F.lit, ("catalog", "preprints", "graph", "registry", "elsewhere"))), (i % 5).cast("int"))
    return works(spark, d).select(source.alias("source"), record.alias("record"))


GOOD = r"""given AS (SELECT *, work_id % 5 AS k, nullif(trim(regexp_replace(title, '[\x09-\x0D ]+', ' ', 'g')), '') AS plain FROM works), good AS (SELECT * FROM given WHERE k < 4 AND work_id % 11 > 0 AND NOT (k = 1 AND work_id % 13 = 0))"""


@query(
    with_(WORKS, GOOD)
    + """SELECT CASE k WHEN 0 THEN 'W' WHEN 1 THEN 'AX:2301.' WHEN 2 THEN 'S2:' ELSE 'DOI:10.9/z' END || work_id AS work_id, plain AS title, year, CASE WHEN k IN (0, 2) THEN cited_by_count ELSE 0 END AS cited_by_count,
  CASE k WHEN 1 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS n_authors, CASE k WHEN 1 THEN 'arXiv' WHEN 2 THEN CASE WHEN work_id % 17 > 0 THEN year::VARCHAR ELSE 'soon' END END AS venue, CASE k WHEN 0 THEN '10.5/x' || work_id WHEN 2 THEN '10.7/y' WHEN 3 THEN '10.9/z' || work_id END AS doi,
  CASE WHEN k IN (1, 2) THEN '2301.' || work_id END AS arxiv_id, CASE WHEN k = 2 THEN 'https://arxiv.org/pdf/2301.' || work_id || '.pdf' END AS pdf_url, ['catalog', 'preprints', 'graph', 'registry'][k + 1] AS source FROM good"""
)
def works_of_sources(spark, d):  # noqa: ANN001
    table, _ = read_records(raw_records(spark, d))
    return table.select("work_id", "title", "year", "cited_by_count", F.size("authors").alias("n_authors"), "venue", "doi", "arxiv_id", "pdf_url", "source")


@query(with_(WORKS) + "SELECT source, reason, count(*) AS n FROM (SELECT ['catalog', 'preprints', 'graph', 'registry', 'elsewhere'][work_id % 5 + 1] AS source, CASE WHEN work_id % 5 = 4 THEN 'unknown source' WHEN work_id % 11 = 0 THEN 'malformed' WHEN work_id % 5 = 1 AND work_id % 13 = 0 THEN 'no id' END AS reason FROM works) WHERE reason IS NOT NULL GROUP BY 1, 2")
def rejected_records(spark, d):  # noqa: ANN001
    return read_records(raw_records(spark, d))[1].groupBy("source", "reason").agg(F.count(F.lit(1)).alias("n"))
