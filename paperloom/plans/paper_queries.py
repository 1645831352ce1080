"""Queries on selecting, judging and completing papers, and on maps as a whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import scores, text
from paperloom.operators import gaps, graph, papers, relational, retrieval
from paperloom.plans.graph_queries import CLEAN, HOPS, RELEVANT, SEEDS, SETS, _clean, _expanded, _seeds, _sets
from paperloom.plans.registry import query
from paperloom.plans.text_queries import BM25, POOL, TFIDF, _rankers
from paperloom.plans.views import ACTIVITY, AS_OF, CITE_EDGES, DOC_EDGES, JUDGMENTS, QUERIES, WORKS, activity, cite_edges, doc_edges, judgments, queries, with_, works
from paperloom.tables import table


@query(
    with_(WORKS, TFIDF, SETS)
    + """, v AS (SELECT set_id, doc, term, tf::DOUBLE / len * (ln(((SELECT count(*) FROM works) + 1)::DOUBLE / (df + 1)) + 1) AS w FROM ctf JOIN cdf USING (term) JOIN sets ON doc = work_id),
n AS (SELECT set_id, doc, sqrt(sum(w * w)) AS n FROM v GROUP BY 1, 2), u AS (SELECT set_id, doc, term, w / n AS w FROM v JOIN n USING (set_id, doc))
SELECT x.set_id, x.doc AS a, y.doc AS b, round(sum(x.w * y.w), 6) AS cosine FROM u x JOIN u y ON x.set_id = y.set_id AND x.term = y.term AND x.doc < y.doc GROUP BY 1, 2, 3"""
)
def pairwise_cosine(spark, d):  # noqa: ANN001
    docs = works(spark, d).select(F.col("work_id").alias("doc"), F.concat_ws(" ", "title", F.coalesce("abstract", F.lit(""))).alias("text"))
    v = retrieval.tfidf_vectors(docs).join(_sets(spark, d), F.col("doc") == F.col("work_id")).select("set_id", "doc", "term", "weight")
    return retrieval.pairwise_cosine(v).withColumn("cosine", F.round("cosine", 6))


@query(with_(WORKS, SETS) + r", k AS (SELECT set_id, work_id, list_distinct(regexp_extract_all(lower(coalesce(abstract, '')), '[a-z]{3,}')) AS w FROM sets JOIN works USING (work_id)) SELECT x.set_id, x.work_id AS a, y.work_id AS b, round(CASE WHEN len(x.w) = 0 OR len(y.w) = 0 THEN 0 ELSE len(list_intersect(x.w, y.w))::DOUBLE / (len(x.w) + len(y.w) - len(list_intersect(x.w, y.w))) END, 6) AS overlap FROM k x JOIN k y ON x.set_id = y.set_id AND x.work_id < y.work_id")
def fingerprint_overlap(spark, d):  # noqa: ANN001
    s = _sets(spark, d).join(works(spark, d).select("work_id", text.keywords(F.col("abstract")).alias("w")), "work_id")
    return papers.set_pairs(s, "w").select("set_id", "a", "b", F.round(text.jaccard(F.col("w_a"), F.col("w_b")), 6).alias("overlap"))


@query(
    with_(WORKS, QUERIES, JUDGMENTS, BM25, POOL)
    + r""", k AS (SELECT p.*, list_distinct(regexp_extract_all(lower(query), '[a-z]{3,}')) AS q, list_distinct(regexp_extract_all(lower(p.title), '[a-z]{3,}')) AS t FROM pool p JOIN queries USING (query_id)),
o AS (SELECT *, CASE WHEN len(q) = 0 THEN 1.0 ELSE len(list_intersect(q, t))::DOUBLE / len(q) END AS overlap, ln(1.0 + cited_by_count) / greatest(max(ln(1.0 + cited_by_count)) OVER (PARTITION BY query_id), 1e-9) AS ratio FROM k),
t AS (SELECT *, CASE WHEN relevance >= 0.75 AND overlap > 0 THEN 0 WHEN overlap > 0 THEN 1 ELSE 2 END AS tier FROM o)
SELECT query_id, work_id, tier FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, CASE tier WHEN 0 THEN round(0.6 * relevance + 0.4 * ratio, 9) WHEN 1 THEN overlap ELSE 0 END DESC, cited_by_count DESC, work_id) AS r FROM t) WHERE r = 1"""
)
def seed_selection(spark, d):  # noqa: ANN001
    pool = _rankers(spark, d).join(queries(spark, d), "query_id").withColumn("overlap", text.keyword_overlap(F.col("query"), F.col("title")))
    return papers.seed_selection(pool)


FAMILIES = [{"one": [" the ", " and "], "two": [" of ", " in "]}, {"three": [" la ", " de "], "four": [" der ", " und "]}]


def _hits(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(' ' || lower({column}) || ' ', '{w}')" for w in words) + ")"


def _conflict_sql(q: str, t: str) -> str:
    parts = []
    for rules in FAMILIES:
        any_of = lambda c: "(" + " OR ".join(_hits(c, w) for w in rules.values()) + ")"
        share = "(" + " OR ".join(f"({_hits(q, w)} AND {_hits(t, w)})" for w in rules.values()) + ")"
        parts.append(f"({any_of(q)} AND {any_of(t)} AND NOT {share})")
    return " OR ".join(parts)


@query(with_(WORKS, QUERIES, JUDGMENTS, BM25, POOL) + f"SELECT query_id, work_id FROM pool JOIN queries USING (query_id) WHERE NOT ({_conflict_sql('query', 'title')})")
def domain_conflict_filter(spark, d):  # noqa: ANN001
    both = _rankers(spark, d).join(queries(spark, d), "query_id")
    return both.where(~papers.domain_conflict(F.col("query"), F.col("title"), FAMILIES)).select("query_id", "work_id")


@query(with_(WORKS, DOC_EDGES, JUDGMENTS, CLEAN, SEEDS, RELEVANT, HOPS) + "SELECT map_id, work_id, hop, round(r, 6) AS relevance FROM (SELECT *, CASE WHEN cited_by_count > 1000 THEN greatest(relevance, t + 0.1) ELSE relevance END AS r FROM (SELECT e.*, w.relevance, w.cited_by_count, CASE hop WHEN 0 THEN 0.2 WHEN 1 THEN 0.3 ELSE 0.4 END::DOUBLE AS t FROM expanded e JOIN relevant w USING (work_id))) WHERE r >= t")
def hop_filter(spark, d):  # noqa: ANN001
    nodes, _ = _expanded(spark, d)
    w = works(spark, d).join(judgments(spark, d), "work_id", "left").select("work_id", "cited_by_count", F.coalesce("relevance", F.lit(0.5)).alias("relevance"))
    return papers.hop_filter(nodes.join(w, "work_id"), "foundations").select("map_id", "work_id", "hop", F.round("relevance", 6).alias("relevance"))


SAID = ("", "The authors thank the ", "Grants funding support thanks grant ", "los que se por para ", "")
OTHER_TITLE = "Quantum tunnelling in photonic lattices"


def _sql_list(words) -> str:  # noqa: ANN001
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


VALIDITY = rf"""said AS (SELECT work_id, CASE WHEN work_id % 6 = 1 THEN '{OTHER_TITLE}' ELSE title END AS title, CASE WHEN work_id % 9 = 4 THEN substr(abstract, 1, 60) WHEN work_id % 9 = 5 THEN {_sql_list(SAID)}[work_id % 5 + 1] ELSE {_sql_list(SAID)}[work_id % 5 + 1] || abstract END AS abstract FROM works),
plain AS (SELECT *, lower(coalesce(abstract, '')) AS low, regexp_replace(coalesce(abstract, ''), '^[\x09-\x0D ]+|[\x09-\x0D ]+$', '', 'g') AS bare, list_distinct(regexp_extract_all(lower(coalesce(abstract, '')), '[\p{{L}}\p{{N}}_]+')) AS w,
  list_distinct(string_split(trim(regexp_replace(regexp_replace(lower(coalesce(title, '')), '[^\p{{L}}\p{{N}}_\x09-\x0D ]', ' ', 'g'), '[\x09-\x0D ]+', ' ', 'g')), ' ')) AS t,
  list_distinct(string_split(trim(regexp_replace(regexp_replace(lower(coalesce(abstract, '')), '[^\p{{L}}\p{{N}}_\x09-\x0D ]', ' ', 'g'), '[\x09-\x0D ]+', ' ', 'g')), ' ')) AS a FROM said),
topic AS (SELECT *, list_filter(t, lambda x: x != '' AND NOT list_contains({_sql_list(text.OVERLAP_STOP_WORDS)}, x)) AS tw, len(list_intersect(w, {_sql_list(text.ENGLISH_WORDS.split())})) AS en, len(list_intersect(w, {_sql_list(text.SPANISH_WORDS.split())})) AS es FROM plain)
SELECT work_id, reason = 'valid' AS valid, reason FROM (SELECT work_id, CASE WHEN low = '' THEN 'missing' WHEN length(bare) < 50 THEN 'too short' WHEN len(list_filter({_sql_list(papers.THANKS)}, lambda p: contains(low, p))) > 0 THEN 'acknowledgments'
  WHEN len(list_intersect(w, {_sql_list(papers.FUNDING_WORDS)})) >= 3 AND len(list_intersect(w, {_sql_list(papers.CONTENT_WORDS)})) <= 2 THEN 'mostly about funding' WHEN es > en * 1.5 AND es >= 3 THEN 'language'
  WHEN len(tw) >= 3 AND len(list_intersect(tw, a)) < 0.15 * len(tw) THEN 'low title overlap' ELSE 'valid' END AS reason FROM topic)"""


@query(with_(WORKS) + ", " + VALIDITY)
def abstract_validity(spark, d):  # noqa: ANN001
    i = F.col("work_id")
    said = F.get(F.array(*map(F.lit, SAID)), (i % 5).cast("int"))
    w = works(spark, d).withColumn("title", F.when(i % 6 == 1, OTHER_TITLE).otherwise(F.col("title"))).withColumn("abstract", F.when(i % 9 == 4, F.substring("abstract", 1, 60)).when(i % 9 == 5, said).otherwise(F.concat(said, "abstract")))
    return w.select("work_id", papers.abstract_validity(F.col("title"), F.col("abstract")).alias("s")).select("work_id", "s.valid", "s.reason")


@query(with_(WORKS) + "SELECT work_id, CASE WHEN work_id % 4 = 0 AND o THEN 'open' WHEN work_id % 3 != 0 AND work_id % 5 = 0 THEN 'closed' WHEN work_id % 3 != 0 THEN CASE WHEN o THEN 'unknown' ELSE 'closed' END ELSE 'unknown' END AS access_status, CASE WHEN work_id % 4 = 0 AND o THEN 'oa_direct' WHEN work_id % 3 != 0 AND work_id % 5 = 0 THEN 'proxy' WHEN work_id % 3 != 0 THEN 'doi' END AS source FROM (SELECT work_id, work_id % 8 < 4 AS o FROM works)")
def access_tier(spark, d):  # noqa: ANN001
    i = F.col("work_id")
    url, doi, proxy = F.when(i % 4 == 0, "http://x").otherwise(""), F.when(i % 3 != 0, "10.1/x").otherwise(""), F.when(i % 5 == 0, "p").otherwise("")
    return works(spark, d).select("work_id", scores.access_tier(i % 8 < 4, url, doi, proxy).alias("a")).select("work_id", "a.access_status", "a.source")


@query(with_(WORKS, QUERIES, JUDGMENTS, BM25, POOL) + "SELECT query_id, work_id, round(score + impact + CASE WHEN relevance > 0 THEN relevance ELSE 0 END + log10(cited_by_count + 1.0) / 5, 6) AS pool_score, CASE WHEN relevance > 0 THEN 'bm25,impact,judged' ELSE 'bm25,impact' END AS methods FROM pool")
def candidate_pool(spark, d):  # noqa: ANN001
    p = _rankers(spark, d)
    found = p.select("query_id", "work_id", "cited_by_count", F.explode(F.create_map(F.lit("bm25"), "score", F.lit("impact"), "impact", F.lit("judged"), "relevance")).alias("method", "score")).where("method != 'judged' OR score > 0")
    return papers.candidate_pool(found).select("query_id", "work_id", F.round("pool_score", 6).alias("pool_score"), F.array_join(F.transform("provenance", lambda x: x["method"]), ",").alias("methods"))


@query(with_(WORKS, CITE_EDGES) + ", r AS (SELECT from_id, count(*) AS n FROM cite_edges GROUP BY 1) SELECT work_id, round_even(CASE WHEN coalesce(n, 0) > 0 THEN 0.45 * least(log10(greatest(cited_by_count, 1)) / log10(20000), 1) + 0.10 * least(log10(n) / log10(100), 1) + 0.45 * CASE WHEN work_id % 9 = 0 THEN 1.0 ELSE 0.3 END ELSE 0.55 * least(log10(greatest(cited_by_count, 1)) / log10(20000), 1) + 0.45 * CASE WHEN work_id % 9 = 0 THEN 1.0 ELSE 0.3 END END, 3) AS impact FROM works LEFT JOIN r ON from_id = work_id")
def impact_score(spark, d):  # noqa: ANN001
    r = cite_edges(spark, d).groupBy("from_id").agg(F.count(F.lit(1)).alias("n"))
    j = works(spark, d).join(r, F.col("from_id") == F.col("work_id"), "left")
    return j.select("work_id", scores.impact_score(F.col("cited_by_count"), F.coalesce("n", F.lit(0)), F.col("work_id") % 9 == 0).alias("impact"))


@query(r"SELECT doc_id, array_to_string(w, ' ') AS text FROM (SELECT doc_id, regexp_extract_all(text, '[^\x09-\x0D ]+') AS w FROM documents) WHERE len(w) > 0")
def abstract_from_inverted_index(spark, d):  # noqa: ANN001
    """Index the words of every text by position and read the text back."""
    words = F.regexp_extract_all("text", F.lit(text.SPACED), F.lit(0))
    at = table(spark, d, "documents").select("doc_id", F.posexplode(words).alias("p", "w")).groupBy("doc_id", "w").agg(F.collect_list("p").alias("ps"))
    index = at.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("m"))
    return index.select("doc_id", text.text_from_inverted_index(F.col("m")).alias("text"))


@query(with_(WORKS, DOC_EDGES, CLEAN, "s AS (SELECT DISTINCT year::INT AS set_id, work_id FROM works)") + "SELECT DISTINCT a.set_id, from_id, to_id FROM clean JOIN s a ON a.work_id = from_id JOIN s b ON b.work_id = to_id AND a.set_id = b.set_id")
def direct_citations(spark, d):  # noqa: ANN001
    """Citations between works of one year."""
    return papers.direct_citations(works(spark, d).select(F.col("year").alias("set_id"), "work_id"), _clean(spark, d)[1])


@query(with_(WORKS) + "SELECT work_id, coalesce(nullif(CASE WHEN work_id % 4 = 0 THEN '' WHEN work_id % 4 = 1 THEN NULL ELSE topic END, ''), o) AS topic FROM works LEFT JOIN (SELECT year, min(subfield) AS o FROM works GROUP BY 1) USING (year)")
def field_backfill(spark, d):  # noqa: ANN001
    """A missing topic from the first subfield of the year."""
    w = works(spark, d)
    holed = w.withColumn("topic", F.when(F.col("work_id") % 4 == 0, "").when(F.col("work_id") % 4 != 1, F.col("topic"))).select("work_id", "year", "topic")
    return papers.backfill(holed, w.select("year", F.col("subfield").alias("topic")), "year", ["topic"]).select("work_id", "topic")


@query(with_(QUERIES) + r", k AS (SELECT query_id, list_slice(regexp_extract_all(query, '[^\x09-\x0D ]+'), 1, 3) AS t, list_slice(regexp_extract_all(query, '[^\x09-\x0D ]+'), 4, 6) AS d FROM queries), p AS (SELECT query_id, a || ' ' || unnest(d) AS variant FROM (SELECT query_id, unnest(t) AS a, d FROM k)) SELECT query_id, min(variant) AS variant FROM p GROUP BY query_id, lower(variant)")
def query_variants(spark, d):  # noqa: ANN001
    w = F.regexp_extract_all("query", F.lit(text.SPACED), F.lit(0))
    return papers.query_variants(queries(spark, d).select("query_id", F.slice(w, 1, 3).alias("topics"), F.slice(w, 4, 3).alias("domains")))


PATTERNS = {"mail": (r"([a-z]+\.[a-z0-9]+@[a-z0-9.]+)", "address"), "phone": (r"\+1 \(([0-9]{3})\)", "area")}


@query("SELECT doc_id, CASE WHEN m != '' AND p != '' THEN 'mail=' || m || ';phone=' || p WHEN m != '' THEN 'mail=' || m WHEN p != '' THEN 'phone=' || p ELSE '' END AS metrics FROM (SELECT doc_id, regexp_extract(text, '" + PATTERNS["mail"][0] + r"', 1) AS m, regexp_extract(text, '" + PATTERNS["phone"][0] + r"', 1) AS p FROM documents)")
def extracted_metrics(spark, d):  # noqa: ANN001
    m = papers.metrics(F.col("text"), PATTERNS)
    return table(spark, d, "documents").select("doc_id", F.array_join(F.transform(m, lambda x: F.concat(x["metric"], F.lit("="), x["value"])), ";").alias("metrics"))


@query(with_(WORKS, DOC_EDGES, JUDGMENTS, CLEAN, SEEDS, RELEVANT, HOPS) + ", n AS (SELECT e.map_id, e.work_id, count(DISTINCT o.work_id) AS k FROM expanded e LEFT JOIN both_ways b ON b.s = e.work_id LEFT JOIN expanded o ON o.work_id = b.work_id AND o.map_id = e.map_id AND o.work_id != e.work_id GROUP BY 1, 2) SELECT map_id, work_id, CASE WHEN k = 0 THEN 0.0 WHEN k = 1 THEN 0.3 WHEN k <= 3 THEN 0.6 WHEN k <= 6 THEN 0.8 ELSE 1.0 END::DOUBLE AS connectivity FROM n")
def connectivity_scores(spark, d):  # noqa: ANN001
    nodes, edges = _expanded(spark, d)
    inner = graph.induced(nodes, edges)
    ends = inner.select("map_id", F.col("from_id").alias("work_id"), F.col("to_id").alias("o")).union(inner.select("map_id", "to_id", "from_id")).distinct()
    k = ends.groupBy("map_id", "work_id").agg(F.count(F.lit(1)).alias("k"))
    return nodes.join(k, ["map_id", "work_id"], "left").select("map_id", "work_id", scores.connectivity_score(F.coalesce("k", F.lit(0))).alias("connectivity"))


@query(with_(WORKS) + "SELECT topic AS map_id, grouping, name, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY topic), 6) AS share FROM (SELECT topic, 'subfield' AS grouping, coalesce(subfield, 'unclassified') AS name, count(*) AS n FROM works GROUP BY 1, 2, 3)")
def map_render(spark, d):  # noqa: ANN001
    n = works(spark, d).groupBy(F.col("topic").alias("map_id"), F.lit("subfield").alias("grouping"), F.coalesce("subfield", F.lit("unclassified")).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return relational.share_of_total(n, ["map_id"]).withColumn("share", F.round("share", 6))


@query("SELECT c.c_custkey AS workspace, o.o_orderkey AS last_job, o.o_orderdate AS last_updated, o.o_orderkey IS NOT NULL AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey) AS has_results FROM customer c LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1) o ON o.o_custkey = c.c_custkey")
def workspace_status(spark, d):  # noqa: ANN001
    """Customers as workspaces, orders as jobs, line items as results."""
    from paperloom.operators.usage import latest

    last = latest(table(spark, d, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", F.col("o_orderkey").alias("last_job"), F.col("o_orderdate").alias("last_updated"))
    results = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("last_job")).distinct().withColumn("_has", F.lit(True))
    j = table(spark, d, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").join(results, "last_job", "left")
    return j.select(F.col("c_custkey").alias("workspace"), "last_job", "last_updated", F.coalesce("_has", F.lit(False)).alias("has_results"))


@query("SELECT count(*) AS users, count(CASE WHEN c_acctbal < 0 THEN 1 END) AS in_debt, count(DISTINCT c_mktsegment) AS segments, round(sum(c_acctbal::DECIMAL(18,2)), 2)::DOUBLE AS balance, max(c_acctbal) AS highest FROM customer")
def overview(spark, d):  # noqa: ANN001
    return table(spark, d, "customer").agg(F.count(F.lit(1)).alias("users"), F.count_if(F.col("c_acctbal") < 0).alias("in_debt"), F.countDistinct("c_mktsegment").alias("segments"), F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("balance"), F.max("c_acctbal").alias("highest"))


@query("SELECT l_orderkey AS id, l_linenumber AS line, p_name AS target, s_name AS actor FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey ORDER BY l_orderkey DESC, l_linenumber LIMIT 50 OFFSET 10")
def audit_page(spark, d):  # noqa: ANN001
    """A page of audit rows with the names of both roles."""
    li, p, s = table(spark, d, "lineitem"), table(spark, d, "part"), table(spark, d, "supplier")
    rows = li.join(p, li["l_partkey"] == p["p_partkey"], "left").join(s, li["l_suppkey"] == s["s_suppkey"], "left")
    return rows.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("p_name").alias("target"), F.col("s_name").alias("actor")).orderBy(F.desc("id"), "line").offset(10).limit(50)


@query("SELECT n_nationkey AS workspace, c_custkey AS member FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal > 0 UNION SELECT s_nationkey, s_suppkey FROM supplier")
def workspace_members(spark, d):  # noqa: ANN001
    """Owners and active members of each workspace."""
    active = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_nationkey").alias("workspace"), F.col("c_custkey").alias("member"))
    return active.unionByName(table(spark, d, "supplier").select(F.col("s_nationkey").alias("workspace"), F.col("s_suppkey").alias("member"))).distinct()


@query(with_(WORKS, DOC_EDGES, CLEAN) + ", e AS (SELECT from_id AS gap_id, list_sort(list(to_id)) AS ev FROM clean GROUP BY 1), g AS (SELECT subfield AS map_id, work_id AS gap_id, cited_by_count / 5000 AS gap_score, unnest(ev) AS work_id2 FROM works JOIN e ON gap_id = work_id WHERE cited_by_count / 5000 >= 0.4 AND year % 100 <= 60) SELECT g.map_id, g.gap_id, round(g.gap_score, 6) AS gap_score, count(*) AS n_evidence FROM g JOIN works w ON w.work_id = g.work_id2 AND w.subfield = g.map_id GROUP BY 1, 2, 3 HAVING count(*) >= 3")
def evidence_filter(spark, d):  # noqa: ANN001
    """Works as gaps of their language's map, evidence the works they cite."""
    w = works(spark, d)
    e = _clean(spark, d)[1].groupBy(F.col("from_id").alias("gap_id")).agg(F.collect_set("to_id").alias("evidence"))
    g = w.select(F.col("subfield").alias("map_id"), F.col("work_id").alias("gap_id"), (F.col("cited_by_count") / 5000).alias("gap_score"), (F.col("year") % 100).alias("coverage")).join(e, "gap_id")
    return gaps.evidence_filter(g, w.select(F.col("subfield").alias("map_id"), "work_id")).withColumn("gap_score", F.round("gap_score", 6))


@query(with_(WORKS, DOC_EDGES) + "SELECT work_id AS target_id, c.to_id AS work_id, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))) END, 6) AS overlap FROM (SELECT DISTINCT x.work_id, e.to_id, list_distinct(list_filter(regexp_extract_all(lower(x.title), '[\\p{L}\\p{N}_]+'), lambda w: w != 'the')) AS a, list_distinct(list_filter(regexp_extract_all(lower(y.title), '[\\p{L}\\p{N}_]+'), lambda w: w != 'the')) AS b FROM works x JOIN doc_edges e ON e.from_id = x.work_id JOIN works y ON y.work_id = e.to_id WHERE y.abstract != '' AND e.to_id % 5 != 0) c WHERE CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))) END <= 0.6".replace("\\\\", "\\"))
def prior_art_filter(spark, d):  # noqa: ANN001
    w, e = works(spark, d), doc_edges(spark, d)
    c = e.join(w.select(F.col("work_id").alias("from_id"), F.col("title").alias("target_title")), "from_id").join(w.select(F.col("work_id").alias("to_id"), "title", "abstract"), "to_id")
    c = c.select(F.col("from_id").alias("target_id"), F.col("to_id").alias("work_id"), "target_title", "title", "abstract")
    return papers.prior_art(c, c.where("work_id % 5 = 0"), ["the"]).select("target_id", "work_id", F.round("overlap", 6).alias("overlap"))


@query(with_(WORKS) + "SELECT work_id FROM works WHERE year < 2000 UNION SELECT work_id FROM works WHERE topic = 'src1' EXCEPT SELECT work_id FROM works WHERE cited_by_count < 1000 INTERSECT SELECT work_id FROM works WHERE subfield = 'en'")
def id_set_operations(spark, d):  # noqa: ANN001
    w = works(spark, d)
    i = lambda c: w.where(c).select("work_id")
    return i("year < 2000").union(i("topic = 'src1'")).distinct().exceptAll(i("cited_by_count < 1000").intersect(i("subfield = 'en'")))


@query(with_(WORKS, DOC_EDGES, JUDGMENTS, CLEAN, SEEDS, RELEVANT, HOPS) + ", r AS (SELECT e.map_id, e.work_id, e.hop, w.cited_by_count AS score, CASE WHEN e.hop = 0 THEN 3 WHEN EXISTS (SELECT 1 FROM clean c WHERE c.from_id = e.work_id AND c.to_id = e.map_id) THEN 0 WHEN EXISTS (SELECT 1 FROM clean c WHERE c.to_id = e.work_id AND c.from_id = e.map_id) THEN 1 WHEN hop = 2 THEN 2 ELSE 3 END AS k FROM expanded e JOIN works w USING (work_id)), i AS (SELECT *, (row_number() OVER (PARTITION BY map_id, k ORDER BY score DESC, work_id) <= CASE k WHEN 0 THEN 5 WHEN 1 THEN 5 WHEN 2 THEN 4 ELSE 0 END)::INT AS inq FROM r) SELECT map_id, work_id FROM (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY inq DESC, score DESC, work_id) AS o FROM i) WHERE o <= 20")
def quota_selection(spark, d):  # noqa: ANN001
    nodes, edges = _expanded(spark, d)
    rel = graph.relationship(nodes, _seeds(spark, d), edges)
    rows = nodes.join(rel, ["map_id", "work_id"]).join(works(spark, d).select("work_id", F.col("cited_by_count").alias("score")), "work_id")
    return papers.quota_selection(rows, 20).select("map_id", "work_id")


@query(with_(ACTIVITY) + "SELECT map_id, count(*) AS n, count(DISTINCT work_id) AS works, string_agg(DISTINCT activity_type, ',' ORDER BY activity_type) AS types, round(avg(CASE WHEN activity_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS error_share FROM activity GROUP BY 1")
def map_context(spark, d):  # noqa: ANN001
    return activity(spark, d).groupBy("map_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("work_id").alias("works"), F.array_join(F.sort_array(F.collect_set("activity_type")), ",").alias("types"), F.round(F.avg((F.col("activity_type") == "error").cast("double")), 6).alias("error_share"))


@query(with_(WORKS) + ", p AS (SELECT a.work_id AS a, b.work_id AS b, a.title AS ta, b.title AS tb, a.year AS ya, b.year AS yb FROM works a JOIN works b ON lower(a.title) = lower(b.title) AND a.work_id < b.work_id) SELECT a, b, CASE WHEN a % 10 = 0 AND b % 10 = 0 THEN a = b WHEN ya = yb THEN trim(ta) != '' WHEN abs(ya - yb) <= 1 THEN trim(ta) != '' ELSE false END AS match FROM p")
def entity_match(spark, d):  # noqa: ANN001
    """Works of equal titles, matched by DOI (every tenth has one), title and year.

    What can be told of a work alone is told once a work; a title that many share is the work of many tasks.
    """
    w = works(spark, d)
    doi = text.normalize_doi(F.when(F.col("work_id") % 10 == 0, F.concat(F.lit("10.1/"), F.col("work_id").cast("string"))))
    one = F.struct("work_id", "year", doi.alias("doi"), text.normalize_title(F.col("title")).alias("title"))
    pairs = graph.pairs(w.where("work_id IS NOT NULL").select(F.lower("title").alias("_k"), one.alias("_w")), "_k", "_w", 2000)
    of = lambda p: {"doi": F.col(p)["doi"], "arxiv_id": F.lit(None).cast("string"), "title": F.col(p)["title"], "year": F.col(p)["year"]}
    return pairs.select(F.col("a")["work_id"].alias("a"), F.col("b")["work_id"].alias("b"), text.entity_match(of("a"), of("b"), normalized=True)["match"].alias("match"))
