"""Queries of several seeds a query, works attached to graphs from outside, and scores by hop."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import scores, text
from paperloom.operators import graph, papers
from paperloom.plans.graph_queries import CLEAN, HOPS, RELEVANT, SEEDS, _expanded
from paperloom.plans.registry import query
from paperloom.plans.text_queries import BM25, POOL, _rankers
from paperloom.plans.views import DOC_EDGES, JUDGMENTS, QUERIES, WORKS, judgments, queries, with_, works


def _structured(spark, d):  # noqa: ANN001, ANN202
    """Queries with their first two words as the topic and the next two as the domain, of several scopes and intents."""
    w, i = F.regexp_extract_all("query", F.lit(text.SPACED), F.lit(0)), F.col("query_id")
    join = lambda a: F.array_join(F.slice(w, a, 2), " ")
    return queries(spark, d).select(
        "query_id", "query", join(1).alias("topic"), F.when(i % 7 > 0, join(3)).otherwise("").alias("domain"),
        F.when(i % 3 == 0, "intersection").otherwise("broad").alias("scope"), F.when(i % 4 == 1, "cross_domain").otherwise("single_topic").alias("intent"),
    )


STRUCTURED = r"""structured AS (SELECT query_id, query, array_to_string(list_slice(w, 1, 2), ' ') AS topic, CASE WHEN query_id % 7 > 0 THEN array_to_string(list_slice(w, 3, 4), ' ') ELSE '' END AS domain,
  CASE WHEN query_id % 3 = 0 THEN 'intersection' ELSE 'broad' END AS scope, CASE WHEN query_id % 4 = 1 THEN 'cross_domain' ELSE 'single_topic' END AS intent
  FROM (SELECT query_id, query, regexp_extract_all(query, '[^\x09-\x0D ]+') AS w FROM queries)),
flagged AS (SELECT *, (scope = 'intersection' OR intent = 'cross_domain') AND domain != '' AS several, topic || ' ' || domain AS together FROM structured),
variants AS (SELECT query_id, 'single' AS role, query AS variant, topic, domain FROM flagged WHERE NOT several
  UNION ALL SELECT query_id, 'intersection', together, topic, domain FROM flagged WHERE several
  UNION ALL SELECT query_id, 'topic', CASE WHEN intent = 'cross_domain' THEN topic ELSE together END, topic, domain FROM flagged WHERE several
  UNION ALL SELECT query_id, 'domain', CASE WHEN intent = 'cross_domain' THEN domain ELSE together END, topic, domain FROM flagged WHERE several)"""


@query(with_(QUERIES, STRUCTURED) + "SELECT query_id, role, variant FROM variants")
def seed_variants(spark, d):  # noqa: ANN001
    return papers.seed_variants(_structured(spark, d)).select("query_id", "role", "variant")


MULTI = r"""has AS (SELECT p.query_id, v.role, p.work_id, p.cited_by_count, variant, title, contains(body, lower(v.topic)) AS t, v.domain != '' AND contains(body, lower(v.domain)) AS g
  FROM (SELECT pool.*, lower(pool.title) || ' ' || lower(coalesce(abstract, '')) AS body FROM pool JOIN works USING (work_id)) p JOIN variants v USING (query_id)),
judged AS (SELECT *, CASE role WHEN 'intersection' THEN CASE WHEN t AND g THEN 0.8 WHEN t OR g THEN 0.4 ELSE 0.1 END WHEN 'topic' THEN CASE WHEN t THEN 0.8 WHEN g THEN 0.3 ELSE 0.1 END
    WHEN 'domain' THEN CASE WHEN g THEN 0.8 WHEN t THEN 0.3 ELSE 0.1 END ELSE CASE WHEN t OR g THEN 0.7 ELSE 0.1 END END::DOUBLE AS relevance,
  list_distinct(regexp_extract_all(lower(variant), '[a-z]{3,}')) AS q, list_distinct(regexp_extract_all(lower(title), '[a-z]{3,}')) AS w FROM has),
o AS (SELECT *, CASE WHEN len(q) = 0 THEN 1.0 ELSE len(list_intersect(q, w))::DOUBLE / len(q) END AS overlap, ln(1.0 + cited_by_count) / greatest(max(ln(1.0 + cited_by_count)) OVER (PARTITION BY query_id, role), 1e-9) AS ratio FROM judged),
tiers AS (SELECT *, CASE WHEN relevance >= 0.75 AND overlap > 0 THEN 0 WHEN overlap > 0 THEN 1 ELSE 2 END AS tier FROM o),
seeds AS (SELECT query_id, role, work_id, CASE role WHEN 'intersection' THEN 1 WHEN 'topic' THEN 2 WHEN 'domain' THEN 3 ELSE 0 END AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id, role ORDER BY tier, CASE tier WHEN 0 THEN round(0.6 * relevance + 0.4 * ratio, 9) WHEN 1 THEN overlap ELSE 0 END DESC, cited_by_count DESC, work_id) AS r FROM tiers) WHERE r = 1),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, work_id ORDER BY place) AS r FROM seeds) WHERE r = 1)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY place)::INT AS pick, role, work_id FROM firsts"""


@query(with_(QUERIES, WORKS, JUDGMENTS, BM25, POOL, STRUCTURED) + ", " + MULTI)
def multi_seeds(spark, d):  # noqa: ANN001
    """Up to three seeds a query among its best works by BM25, relevant to the role's scope."""
    asked = _structured(spark, d)
    pool = _rankers(spark, d).drop("relevance", "topic")
    abstracts = works(spark, d).select("work_id", "abstract").join(pool.select("work_id").distinct(), "work_id", "left_semi")
    rows = papers.seed_variants(asked).join(asked.select("query_id", "topic", "domain"), "query_id").join(pool, "query_id").join(abstracts, "work_id")
    terms = (F.array("topic"), F.array("domain"), F.array().cast("array<string>"))
    by_scope = lambda scope: scores.relevance_by_scope(F.lit(""), F.concat_ws(" ", "title", "abstract"), *terms, scope)
    relevance = F.when(F.col("role") == "intersection", by_scope("intersection")).when(F.col("role") == "topic", by_scope("topic_focused")).when(F.col("role") == "domain", by_scope("domain_focused")).otherwise(by_scope("broad"))
    return papers.multi_seed_select(rows.withColumn("relevance", relevance).withColumn("overlap", text.keyword_overlap(F.col("variant"), F.col("title"))))


ATTACHED = """offered AS (SELECT s.map_id, w.work_id, w.relevance FROM seeds s JOIN works o ON o.work_id = s.map_id JOIN relevant w ON w.subfield = o.subfield WHERE w.work_id % 3 = 0),
able AS (SELECT * FROM offered WHERE relevance >= 0.5 AND (map_id, work_id) NOT IN (SELECT map_id, work_id FROM expanded)),
links AS (SELECT a.map_id, a.work_id, c.from_id, c.to_id FROM able a JOIN clean c ON a.work_id = c.from_id JOIN expanded e ON e.map_id = a.map_id AND e.work_id = c.to_id
  UNION SELECT a.map_id, a.work_id, c.from_id, c.to_id FROM able a JOIN clean c ON a.work_id = c.to_id JOIN expanded e ON e.map_id = a.map_id AND e.work_id = c.from_id)"""


def _attached(spark, d):  # noqa: ANN001, ANN202
    """A third of the works of the seed's language, as if another search had found them."""
    nodes, edges = _expanded(spark, d)
    w = works(spark, d).join(judgments(spark, d), "work_id", "left").withColumn("relevance", F.coalesce("relevance", F.lit(0.5)))
    seeds = nodes.where("hop = 0").join(w.select("work_id", "subfield"), "work_id").select("map_id", "subfield")
    return graph.attach_enrichment(nodes, seeds.join(w.where("work_id % 3 = 0").select("work_id", "subfield", "relevance"), "subfield"), edges, 0.5)


@query(with_(WORKS, DOC_EDGES, JUDGMENTS, CLEAN, SEEDS, RELEVANT, HOPS, ATTACHED) + "SELECT DISTINCT map_id, work_id, relevance FROM links JOIN able USING (map_id, work_id)")
def attached_works(spark, d):  # noqa: ANN001
    return _attached(spark, d)[0]


@query(with_(WORKS, DOC_EDGES, JUDGMENTS, CLEAN, SEEDS, RELEVANT, HOPS, ATTACHED) + "SELECT DISTINCT map_id, from_id, to_id FROM links")
def attached_edges(spark, d):  # noqa: ANN001
    return _attached(spark, d)[1]


@query(
    with_(WORKS, DOC_EDGES, JUDGMENTS, CLEAN, SEEDS, RELEVANT, HOPS)
    + """, inner_edges AS (SELECT DISTINCT a.map_id, c.from_id, c.to_id FROM clean c JOIN expanded a ON a.work_id = c.from_id JOIN expanded b ON b.work_id = c.to_id AND a.map_id = b.map_id),
ends AS (SELECT map_id, work_id, count(*) AS n FROM (SELECT map_id, from_id AS work_id FROM inner_edges UNION ALL SELECT map_id, to_id FROM inner_edges) GROUP BY 1, 2),
rows_ AS (SELECT e.map_id, e.work_id, hop, cited_by_count, coalesce(n, 0) AS n, greatest(max(coalesce(n, 0)) OVER (PARTITION BY e.map_id), 1) AS most FROM expanded e JOIN works USING (work_id) LEFT JOIN ends ON ends.map_id = e.map_id AND ends.work_id = e.work_id)
SELECT map_id, work_id, hop, round(CASE WHEN hop = 2 THEN 0.6 ELSE 1.0 END * (0.6 * ln(1.0 + least(cited_by_count, 50000)) / ln(50001.0) + 0.4 * n / most), 6) AS score FROM rows_ WHERE hop > 0"""
)
def hop_scores(spark, d):  # noqa: ANN001
    """Scores of all but the seeds, which are infinite."""
    nodes, edges = _expanded(spark, d)
    scored = graph.hop_scores(nodes.join(works(spark, d).select("work_id", "cited_by_count"), "work_id"), graph.induced(nodes, edges))
    return scored.where("hop > 0").withColumn("score", F.round("score", 6))
