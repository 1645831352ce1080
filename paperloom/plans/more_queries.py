"""Further queries: metadata rules, joins of special shape, labels and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import scores, text
from paperloom.operators import papers, relational
from paperloom.plans.graph_queries import _sets
from paperloom.plans.registry import query
from paperloom.plans.text_queries import BM25, POOL, _rankers
from paperloom.plans.views import ACTIVITY, DOC_EDGES, JUDGMENTS, QUERIES, WORKS, activity, doc_edges, queries, with_, works
from paperloom.tables import table


@query(with_(WORKS) + "SELECT work_id, CASE WHEN contains(lower(title), 'review') OR contains(lower(title), 'survey') OR contains(lower(title), 'overview') OR contains(lower(title), 'tutorial') OR contains(lower(title), 'primer') THEN 'review' ELSE topic END AS paper_type FROM works WHERE title != '' AND year <= 2020 AND NOT (year >= 2020 AND cited_by_count = 0)")
def metadata_rules(spark, d):  # noqa: ANN001
    return papers.bad_metadata(works(spark, d), 2020).select("work_id", papers.review_override(F.col("title"), F.col("topic")).alias("paper_type"))


@query(with_(WORKS) + "SELECT work_id FROM works WHERE cited_by_count * 10 >= 10000 AND ((year >= 2018 AND cited_by_count * 10 > 30000) OR contains(lower(title), 'the '))")
def suspicious_citations(spark, d):  # noqa: ANN001
    return papers.suspicious_citations(works(spark, d).withColumn("cited_by_count", F.col("cited_by_count") * 10), ["the "]).select("work_id")


TOK = r"list_distinct(regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}_]+'))"


def _jac(a: str, b: str) -> str:
    return f"(len({a}) > 0 AND len({b}) > 0 AND len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) >= 0.05)"


@query(with_(WORKS, DOC_EDGES) + f", p AS (SELECT from_id, to_id, {TOK.format('a.title')} AS ta, {TOK.format('b.title')} AS tb, {TOK.format('a.abstract')} AS xa, {TOK.format('b.abstract')} AS xb FROM (SELECT DISTINCT * FROM doc_edges) JOIN works a ON a.work_id = from_id JOIN works b ON b.work_id = to_id) SELECT from_id, to_id FROM p WHERE {_jac('ta', 'tb')} OR {_jac('xa', 'xb')}")
def cross_domain_filter(spark, d):  # noqa: ANN001
    return papers.cross_domain(doc_edges(spark, d).distinct(), works(spark, d))


@query(with_(WORKS, DOC_EDGES) + ", f AS (SELECT DISTINCT from_id AS node_id, to_id AS work_id FROM doc_edges), w AS (SELECT f.node_id, f.work_id, b.title FROM f JOIN works a ON a.work_id = node_id JOIN works b ON b.work_id = f.work_id WHERE b.cited_by_count >= 30 AND b.year < 2010 AND a.subfield = b.subfield) SELECT node_id, work_id FROM w WHERE NOT EXISTS (SELECT 1 FROM works s WHERE s.work_id = w.node_id AND lower(s.title) = lower(w.title))")
def landmark_sources(spark, d):  # noqa: ANN001
    w = works(spark, d)
    node, found = w.select(F.col("work_id").alias("node_id"), F.array("subfield").alias("wanted")), w.select("work_id", "title", "year", "cited_by_count", F.array("subfield").alias("fields"))
    rows = doc_edges(spark, d).distinct().select(F.col("from_id").alias("node_id"), F.col("to_id").alias("work_id")).join(node, "node_id").join(found, "work_id")
    return papers.landmark_sources(rows, w.select(F.col("work_id").alias("node_id"), "title"), 2010).select("node_id", "work_id")


@query(with_(ACTIVITY) + ", m AS (SELECT map_id, list_distinct(list(work_id)) AS ids FROM activity GROUP BY 1) SELECT doc_id, count(*) AS maps FROM documents JOIN (SELECT map_id, unnest(ids) AS id FROM m) ON doc_id = id GROUP BY 1")
def works_in_arrays(spark, d):  # noqa: ANN001
    """Works whose id is in a map's array of ids, and in how many."""
    ids = activity(spark, d).groupBy("map_id").agg(F.collect_set("work_id").alias("ids")).select("map_id", F.explode("ids").alias("doc_id"))
    return ids.join(table(spark, d, "documents").select("doc_id"), "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("maps"))


@query("SELECT n_name, count(*) AS n, round(sum(value), 2) AS value FROM events JOIN nation ON json_extract_string(props, '$.k')::INT = n_nationkey GROUP BY 1")
def json_key_join(spark, d):  # noqa: ANN001
    e = table(spark, d, "events").select(F.get_json_object("props", "$.k").cast("int").alias("k"), F.col("value").cast("decimal(12,2)").alias("value"))
    return e.join(table(spark, d, "nation"), F.col("k") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.sum("value").cast("double").alias("value"))


@query(with_(ACTIVITY) + "SELECT event_id FROM activity WHERE map_id IN (SELECT doc_id FROM documents WHERE source = 'src3') OR work_id IN (SELECT doc_id + 1 FROM documents WHERE source = 'src3')")
def either_key_match(spark, d):  # noqa: ANN001
    keys = table(spark, d, "documents").where("source = 'src3'").select(F.col("doc_id").alias("map_id"), (F.col("doc_id") + 1).alias("work_id"))
    return relational.either_key(activity(spark, d).select("event_id", "map_id", "work_id"), keys, "map_id", "work_id").select("event_id")


@query(with_(WORKS, ACTIVITY) + "SELECT map_id, work_id, work_id NOT IN (SELECT work_id FROM works WHERE topic < 'src5') AS missing FROM (SELECT DISTINCT map_id, work_id FROM activity)")
def membership_report(spark, d):  # noqa: ANN001
    return relational.membership(activity(spark, d).select("map_id", "work_id").distinct(), works(spark, d).where("topic < 'src5'"), ["work_id"]).select("map_id", "work_id", "missing")


@query("SELECT c_custkey, r_name FROM customer JOIN region ON contains(lower(r_name), lower(substr(c_mktsegment, 2, 1)))")
def name_containment(spark, d):  # noqa: ANN001
    r = table(spark, d, "region")  # five rows
    return table(spark, d, "customer").join(F.broadcast(r), F.lower("r_name").contains(F.lower(F.substring("c_mktsegment", 2, 1)))).select("c_custkey", "r_name")


@query("SELECT conv_id AS set_id, round(avg(CASE WHEN regexp_matches(text, '(^| )(not|nicht|ne|no|th)( |$)') THEN 1.0 ELSE 0.0 END), 6) AS share, avg(CASE WHEN regexp_matches(text, '(^| )(not|nicht|ne|no|th)( |$)') THEN 1.0 ELSE 0.0 END) > 0.5 AS mostly_negated FROM conversations GROUP BY 1")
def negated_share(spark, d):  # noqa: ANN001
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("set_id"), "text")
    return papers.negated_share(c, r"(^| )(not|nicht|ne|no|th)( |$)").withColumn("share", F.round("share", 6))


@query("SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, len(list_distinct(regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1))) AS links, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def ids_from_pages(spark, d):  # noqa: ANN001
    p = table(spark, d, "pages")
    links = F.size(F.array_distinct(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1))))
    return p.select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), links.cast("bigint").alias("links"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


MENTIONS = ("see https://arxiv.org/abs/2301.", "arXiv:1999.", "https://doi.org/10.1234/AB.", "cs-LG/0601", "W27", "")
MENTIONED = "[" + ", ".join(f"'{m}'" for m in MENTIONS) + "][page_id % 6 + 1]"
ARXIV_SQL = "coalesce(" + ", ".join(f"nullif(regexp_extract(x, '(?i){kind}', 1), '')" for kind in (r"arxiv\.org/abs/([0-9]+\.[0-9]+)", r"arxiv\.org/pdf/([0-9]+\.[0-9]+)", r"arxiv:([0-9]+\.[0-9]+)", r"([0-9]{4}\.[0-9]{4,5})", r"([a-z-]+/[0-9]+)")) + ")"


@query(rf"SELECT page_id, {ARXIV_SQL} AS arxiv_id, nullif(lower(regexp_extract(x, '(10\.[0-9]{{4,}}/[^\x09-\x0D ]+)', 1)), '') AS doi FROM (SELECT page_id, {MENTIONED} || page_id::VARCHAR || ' ' || url AS x FROM pages)")
def ids_in_text(spark, d):  # noqa: ANN001
    """arXiv ids and DOIs in what pages could say of themselves, and in their addresses."""
    said = F.concat(F.get(F.array(*map(F.lit, MENTIONS)), (F.col("page_id") % 6).cast("int")), F.col("page_id").cast("string"), F.lit(" "), F.col("url"))
    return table(spark, d, "pages").select("page_id", text.arxiv_id_in(said).alias("arxiv_id"), text.doi_in(said).alias("doi"))


@query(with_(QUERIES, WORKS, JUDGMENTS, BM25, POOL) + r", k AS (SELECT p.query_id, p.work_id, p.title, query, list_distinct(regexp_extract_all(lower(p.title), '[a-z]{3,}')) AS a, list_distinct(regexp_extract_all(lower(query), '[a-z]{3,}')) AS b FROM pool p JOIN queries USING (query_id)) SELECT query_id, work_id, CASE WHEN len(list_intersect(a, b))::DOUBLE / greatest(len(b), 1) < 0.3 THEN title || ' ' || query ELSE title END AS drilldown FROM k")
def drilldown_queries(spark, d):  # noqa: ANN001
    both = _rankers(spark, d).join(queries(spark, d), "query_id")
    return both.select("query_id", "work_id", papers.drilldown_query(F.col("title"), F.col("query")).alias("drilldown"))


TOPICS = "tp AS (SELECT work_id, topic, [{'topic_id': 'src' || (work_id * 3 % 20), 'score': (work_id % 10) / 10}, {'topic_id': 'src' || (work_id * 7 % 20), 'score': (work_id % 7) / 10}] AS topics FROM works)"


@query(with_(WORKS, TOPICS) + ", r AS (SELECT work_id, topic, topics, CASE WHEN topic = 'src3' THEN 1.0 ELSE coalesce(list_max([t.score FOR t IN topics IF t.topic_id = 'src3']), 0) END AS rel FROM tp) SELECT work_id, round(rel, 6) AS relevance, CASE WHEN work_id % 4 > 0 THEN topic WHEN topics[1].score > topics[2].score OR (topics[1].score = topics[2].score AND topics[1].topic_id <= topics[2].topic_id) THEN topics[1].topic_id ELSE topics[2].topic_id END AS best FROM r")
def topic_scores(spark, d):  # noqa: ANN001
    i = F.col("work_id")
    t = lambda k, m: F.struct(F.concat(F.lit("src"), (i * k % 20).cast("string")).alias("topic_id"), ((i % m) / 10).alias("score"))
    w = works(spark, d).withColumn("topics", F.array(t(3, 10), t(7, 7)))
    return w.select("work_id", F.round(scores.topic_relevance(F.col("topic"), F.col("topics"), F.lit("src3")), 6).alias("relevance"), scores.best_topic(F.when(i % 4 > 0, F.col("topic")), F.col("topics")).alias("best"))


TERMS_SQL = r"""SELECT work_id, round(coalesce(list_max(list_transform(['the of', 'Und der', 'de  la', ''], lambda f: CASE WHEN trim(f) = '' OR t = '' THEN 0.0
  WHEN contains(t, regexp_replace(lower(f), ' +', ' ', 'g')) THEN 1.0 ELSE len(list_intersect(string_split(regexp_replace(lower(f), ' +', ' ', 'g'), ' '), string_split(t, ' '))) / 2.0 END)), 0.0)::DOUBLE, 6) AS score
  FROM (SELECT work_id, trim(regexp_replace(lower(coalesce(abstract, '')), '[\x09-\x0D ]+', ' ', 'g')) AS t FROM works)"""


@query(with_(WORKS) + TERMS_SQL)
def term_scores(spark, d):  # noqa: ANN001
    forms = F.array(F.lit("the of"), F.lit("Und der"), F.lit("de  la"), F.lit(""))
    return works(spark, d).select("work_id", F.round(scores.term_score(F.col("abstract"), forms), 6).alias("score"))


@query(with_(WORKS) + "SELECT work_id, array_to_string(list_filter([CASE WHEN (1.0 + cited_by_count) / (3.0 + 2026 - year) >= 100 THEN 'impact' END, CASE WHEN exp(-(2026.0 - year) / 5) >= 0.3 THEN 'recent' END, CASE WHEN length(abstract) >= 500 THEN 'complete' END], lambda x: x IS NOT NULL), ',') AS reasons, round(((title != '')::INT + 1 + (abstract != '')::INT) / 3, 6) AS completeness FROM works")
def reason_labels(spark, d):  # noqa: ANN001
    years = scores.age(F.col("year"), 2026)
    why = scores.reasons({"impact": (scores.impact_rate(F.col("cited_by_count"), years), 100), "recent": (scores.recency(years, 5), 0.3), "complete": (F.length("abstract"), 500)})
    return works(spark, d).select("work_id", F.array_join(why, ",").alias("reasons"), F.round(scores.completeness(F.col("title") != "", F.col("year").isNotNull(), F.col("abstract") != ""), 6).alias("completeness"))


@query(with_(QUERIES, WORKS, JUDGMENTS, BM25, POOL) + r", k AS (SELECT p.*, list_distinct(regexp_extract_all(lower(query), '[a-z]{3,}')) AS q, list_distinct(regexp_extract_all(lower(p.title), '[a-z]{3,}')) AS t FROM pool p JOIN queries USING (query_id)), s AS (SELECT *, CASE WHEN len(q) = 0 OR len(t) = 0 THEN 0 ELSE len(list_intersect(q, t))::DOUBLE / (len(q) + len(t) - len(list_intersect(q, t))) END AS sim FROM k), v AS (SELECT *, round(CASE WHEN sim > 0.85 THEN 1 + ln(1.0 + cited_by_count) ELSE 0.6 * sim + 0.4 * ln(1.0 + cited_by_count) / greatest(max(ln(1.0 + cited_by_count)) OVER (PARTITION BY query_id), 1e-9) END, 9) AS v FROM s) SELECT query_id, work_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY v DESC, work_id) AS r FROM v) WHERE r = 1")
def title_seeds(spark, d):  # noqa: ANN001
    both = _rankers(spark, d).join(queries(spark, d), "query_id")
    return papers.title_seed(both.withColumn("similarity", text.jaccard(text.keywords(F.col("query")), text.keywords(F.col("title")))))


@query(r"SELECT doc_id, round(CASE WHEN len(c) > 0 THEN len(list_intersect(c, g))::DOUBLE / len(c) ELSE 0 END, 6) AS share, len(c) - len(list_intersect(c, g)) AS orphans, len(g) - len(list_intersect(c, g)) AS unused FROM (SELECT doc_id, list_distinct(regexp_extract_all(text, ' ([a-z]{2}) ', 1)) AS c, ['th', 'of', 'in', 'qq'] AS g FROM documents)")
def grounding_consistency(spark, d):  # noqa: ANN001
    """Two-letter words as ids, against four given ones."""
    given = F.array(*map(F.lit, ["th", "of", "in", "qq"]))
    out = papers.grounding_consistency(table(spark, d, "documents").withColumn("given", given), " ([a-z]{2}) ")
    return out.select("doc_id", F.round("share", 6).alias("share"), F.col("orphans").cast("bigint").alias("orphans"), F.col("unused").cast("bigint").alias("unused"))


@query(with_(WORKS) + "SELECT subfield, topic, n FROM (SELECT subfield, topic, count(*) AS n, row_number() OVER (PARTITION BY subfield ORDER BY count(*) DESC, topic) AS r FROM works GROUP BY 1, 2 HAVING count(*) >= 2) WHERE r <= 5")
def topic_clusters(spark, d):  # noqa: ANN001
    return papers.topic_clusters(works(spark, d), "subfield").select("subfield", "topic", "n")


@query(with_(WORKS) + ", u AS (SELECT topic AS map_id, work_id FROM (SELECT topic, work_id, row_number() OVER (PARTITION BY topic ORDER BY cited_by_count DESC, work_id) AS r FROM works) WHERE r <= 12), k AS (SELECT topic AS map_id, work_id, cited_by_count, row_number() OVER (PARTITION BY topic, lower(title) ORDER BY cited_by_count DESC, work_id) AS r FROM works WHERE (topic, work_id) NOT IN (SELECT map_id, work_id FROM u)) SELECT map_id, work_id FROM (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY cited_by_count DESC, work_id) AS o FROM k WHERE r = 1) WHERE o <= 10")
def sibling_candidates(spark, d):  # noqa: ANN001
    nodes = works(spark, d).withColumnRenamed("topic", "map_id")
    return papers.siblings(nodes, _sets(spark, d).withColumnRenamed("set_id", "map_id"))


@query(with_(WORKS) + ", c AS (SELECT 'c' || (work_id % 30) AS cluster_id, topic FROM works), m AS (SELECT cluster_id, topic, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, topic DESC) AS r FROM c GROUP BY 1, 2) SELECT cluster_id, CASE WHEN substr(cluster_id, 2)::INT % 2 = 0 THEN 'Name ' || cluster_id ELSE topic END AS name FROM m WHERE r = 1")
def topic_name_resolution(spark, d):  # noqa: ANN001
    c = works(spark, d).select(F.concat(F.lit("c"), (F.col("work_id") % 30).cast("string")).alias("cluster_id"), "topic")
    ids = c.select("cluster_id").distinct()
    names = ids.where(F.substring("cluster_id", 2, 9).cast("int") % 2 == 0).select("cluster_id", F.concat(F.lit("Name "), "cluster_id").alias("name"))
    return papers.topic_names(ids, names, c)


@query("SELECT DISTINCT c_nationkey AS workspace, lower(c_mktsegment) AS tag FROM customer WHERE c_mktsegment IS NOT NULL")
def distinct_tags(spark, d):  # noqa: ANN001
    return table(spark, d, "customer").where("c_mktsegment IS NOT NULL").select(F.col("c_nationkey").alias("workspace"), F.lower("c_mktsegment").alias("tag")).distinct()


@query(with_(WORKS) + r"SELECT work_id, round(0.85 + 0.15 * len(list_intersect(list_distinct(regexp_extract_all(lower(title), '[\p{L}\p{N}_]+')), ['the', 'of', 'de', 'der'])) / 4, 6) AS multiplier FROM works")
def concept_multipliers(spark, d):  # noqa: ANN001
    wanted = F.array(*map(F.lit, ["the", "of", "de", "der"]))
    return works(spark, d).select("work_id", F.round(papers.concept_multiplier(text.tokens(F.col("title")), wanted), 6).alias("multiplier"))
