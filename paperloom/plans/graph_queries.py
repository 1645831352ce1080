"""Queries on citation graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import scores
from paperloom.operators import graph
from paperloom.plans.registry import query
from paperloom.plans.views import AS_OF, CITE_EDGES, DOC_EDGES, JUDGMENTS, WORKS, cite_edges, doc_edges, judgments, with_, works


@query(with_(CITE_EDGES) + ", p AS (SELECT a.to_id AS a, b.to_id AS b, count(*) AS shared FROM cite_edges a JOIN cite_edges b USING (from_id) WHERE a.to_id < b.to_id GROUP BY 1, 2 HAVING count(*) >= 2), u AS (SELECT a AS work_id, b AS other_id, shared FROM p UNION ALL SELECT b, a, shared FROM p) SELECT work_id, other_id, shared, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY shared DESC, other_id) AS rank FROM u) WHERE rank <= 15")
def co_citation(spark, d):  # noqa: ANN001
    return graph.co_citation(cite_edges(spark, d), least=2)


@query(with_(CITE_EDGES) + ", s AS (SELECT from_id, count(*) AS n FROM cite_edges GROUP BY 1), p AS (SELECT a.from_id AS a, b.from_id AS b, count(*) AS i FROM cite_edges a JOIN cite_edges b USING (to_id) WHERE a.from_id < b.from_id GROUP BY 1, 2), j AS (SELECT a, b, i::DOUBLE / (x.n + y.n - i) AS coupling FROM p JOIN s x ON x.from_id = a JOIN s y ON y.from_id = b), k AS (SELECT * FROM j WHERE coupling >= 0.2), u AS (SELECT a AS work_id, b AS other_id, coupling FROM k UNION ALL SELECT b, a, coupling FROM k) SELECT work_id, other_id, round(coupling, 6) AS coupling, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY coupling DESC, other_id) AS rank FROM u) WHERE rank <= 15")
def bibliographic_coupling(spark, d):  # noqa: ANN001
    return graph.bibliographic_coupling(cite_edges(spark, d)).withColumn("coupling", F.round("coupling", 6))


def _clean(spark, d):  # noqa: ANN001
    return graph.normalize_graph(works(spark, d), doc_edges(spark, d))


CLEAN = "clean AS (SELECT DISTINCT from_id, to_id FROM doc_edges WHERE from_id != to_id AND from_id IN (SELECT work_id FROM works) AND to_id IN (SELECT work_id FROM works))"
DEGREE = "deg AS (SELECT work_id, coalesce(i, 0)::BIGINT AS in_degree, coalesce(o, 0)::BIGINT AS out_degree, (coalesce(i, 0) + coalesce(o, 0))::BIGINT AS degree FROM works LEFT JOIN (SELECT to_id AS work_id, count(*) AS i FROM clean GROUP BY 1) USING (work_id) LEFT JOIN (SELECT from_id AS work_id, count(*) AS o FROM clean GROUP BY 1) USING (work_id))"


@query(with_(WORKS, DOC_EDGES, CLEAN) + "SELECT (SELECT count(*) FROM works) AS nodes_in, (SELECT count(DISTINCT work_id) FROM works) AS nodes, (SELECT count(*) FROM doc_edges) AS edges_in, (SELECT count(*) FROM clean) AS edges")
def normalize_graph(spark, d):  # noqa: ANN001
    return _clean(spark, d)[2]


@query(with_(WORKS, DOC_EDGES, CLEAN, DEGREE) + "SELECT * FROM deg")
def degrees(spark, d):  # noqa: ANN001
    nodes, edges, _ = _clean(spark, d)
    return graph.degrees(nodes, edges)


@query(with_(WORKS, DOC_EDGES, CLEAN, DEGREE) + "SELECT work_id, CASE WHEN degree = 0 THEN 'isolated' ELSE 'bridge' END AS kind FROM deg WHERE degree = 0 OR (in_degree >= 3 AND out_degree >= 2)")
def bridges_and_isolated(spark, d):  # noqa: ANN001
    nodes, edges, _ = _clean(spark, d)
    return graph.bridges_and_isolated(graph.degrees(nodes, edges))


@query(with_(WORKS, DOC_EDGES, CLEAN, DEGREE) + "SELECT work_id, degree, round(degree / ln(cited_by_count + 2.0), 6) AS density FROM works JOIN deg USING (work_id) WHERE degree / ln(cited_by_count + 2.0) >= 0.2 AND degree >= CASE WHEN cited_by_count > 50000 THEN 5 WHEN cited_by_count > 10000 THEN 4 ELSE 3 END")
def density_gate(spark, d):  # noqa: ANN001
    nodes, edges, _ = _clean(spark, d)
    return graph.density_gate(works(spark, d), graph.degrees(nodes, edges)).select("work_id", "degree", F.round("density", 6).alias("density"))


@query(with_(WORKS, DOC_EDGES, CLEAN) + "SELECT count(*) AS n_nodes, (SELECT count(*) FROM clean) AS n_edges, round((SELECT count(*) FROM clean)::DOUBLE / count(*), 6) AS edges_per_node, (SELECT count(*) FROM clean)::DOUBLE / count(*) >= 2 AS connected FROM (SELECT DISTINCT work_id FROM works)")
def connectivity(spark, d):  # noqa: ANN001
    nodes, edges, _ = _clean(spark, d)
    return graph.connectivity(nodes, edges).withColumn("edges_per_node", F.round("edges_per_node", 6))


def _seeds(spark, d):  # noqa: ANN001
    """Each topic's most cited work is the seed of its map, numbered by the work."""
    w = works(spark, d).groupBy("topic").agg(F.max_by("work_id", F.struct("cited_by_count", "work_id")).alias("work_id"))
    return w.select(F.col("work_id").alias("map_id"), "work_id")


SEEDS = "seeds AS (SELECT work_id AS map_id, work_id FROM (SELECT work_id, row_number() OVER (PARTITION BY topic ORDER BY cited_by_count DESC, work_id DESC) AS r FROM works) WHERE r = 1)"
RELEVANT = "relevant AS (SELECT w.*, coalesce(j.relevance, 0.5) AS relevance FROM works w LEFT JOIN judgments j USING (work_id))"
HOPS = """both_ways AS (SELECT from_id AS s, to_id AS work_id FROM clean UNION SELECT to_id, from_id FROM clean),
h1 AS (SELECT DISTINCT map_id, work_id FROM (SELECT map_id, s, b.work_id, row_number() OVER (PARTITION BY map_id, s ORDER BY cited_by_count DESC, b.work_id) AS r FROM seeds JOIN both_ways b ON seeds.work_id = b.s JOIN relevant w ON w.work_id = b.work_id) WHERE r <= 80 AND (map_id, work_id) NOT IN (SELECT map_id, work_id FROM seeds)),
src AS (SELECT map_id, work_id AS s FROM (SELECT map_id, work_id, row_number() OVER (PARTITION BY map_id ORDER BY relevance DESC, cited_by_count DESC, work_id) AS r FROM h1 JOIN relevant USING (work_id) WHERE relevance >= 0.4) WHERE r <= 8),
h2 AS (SELECT DISTINCT map_id, work_id FROM (SELECT map_id, s, b.work_id, row_number() OVER (PARTITION BY map_id, s ORDER BY cited_by_count DESC, b.work_id) AS r FROM src JOIN both_ways b USING (s) JOIN relevant w ON w.work_id = b.work_id) WHERE r <= 30 AND (map_id, work_id) NOT IN (SELECT map_id, work_id FROM seeds UNION SELECT map_id, work_id FROM h1)),
expanded AS (SELECT map_id, work_id, 0 AS hop FROM seeds UNION ALL SELECT map_id, work_id, 1 FROM h1 UNION ALL SELECT map_id, work_id, 2 FROM h2)"""


def _expanded(spark, d):  # noqa: ANN001
    _, edges, _ = _clean(spark, d)
    relevant = works(spark, d).join(judgments(spark, d), "work_id", "left").withColumn("relevance", F.coalesce("relevance", F.lit(0.5)))
    return graph.expand_graph(_seeds(spark, d), edges, relevant), edges


@query(with_(WORKS, DOC_EDGES, JUDGMENTS, CLEAN, SEEDS, RELEVANT, HOPS) + "SELECT * FROM expanded")
def multi_hop_expansion(spark, d):  # noqa: ANN001
    return _expanded(spark, d)[0]


@query(with_(WORKS, DOC_EDGES, JUDGMENTS, CLEAN, SEEDS, RELEVANT, HOPS) + "SELECT DISTINCT a.map_id, c.from_id, c.to_id FROM clean c JOIN expanded a ON a.work_id = c.from_id JOIN expanded b ON b.work_id = c.to_id AND a.map_id = b.map_id")
def induced_map_edges(spark, d):  # noqa: ANN001
    nodes, edges = _expanded(spark, d)
    return graph.induced(nodes, edges)


@query(
    with_(WORKS, DOC_EDGES, JUDGMENTS, CLEAN, SEEDS, RELEVANT, HOPS)
    + "SELECT e.map_id, e.work_id, CASE WHEN e.hop = 0 THEN 'seed' WHEN EXISTS (SELECT 1 FROM clean c WHERE c.from_id = e.work_id AND c.to_id = e.map_id) THEN 'cites_seed' WHEN EXISTS (SELECT 1 FROM clean c WHERE c.to_id = e.work_id AND c.from_id = e.map_id) THEN 'cited_by_seed' ELSE 'network' END AS relationship FROM expanded e"
)
def map_relationships(spark, d):  # noqa: ANN001
    nodes, edges = _expanded(spark, d)
    return graph.relationship(nodes, _seeds(spark, d), edges)


@query(with_(WORKS, DOC_EDGES, CLEAN, SEEDS) + ", r AS (SELECT map_id AS seed_id, work_id, 'seed' AS role, 0 AS o FROM seeds UNION ALL SELECT map_id, from_id, 'cites_seed', 1 FROM seeds JOIN clean ON to_id = work_id UNION ALL SELECT map_id, to_id, 'cited_by_seed', 2 FROM seeds JOIN clean ON from_id = work_id) SELECT seed_id, work_id, role, cited_by_count FROM (SELECT seed_id, work_id, arg_min(role, o) AS role FROM r GROUP BY 1, 2) JOIN works USING (work_id) WHERE cited_by_count >= 500 OR role = 'seed'")
def one_hop_graph(spark, d):  # noqa: ANN001
    _, edges, _ = _clean(spark, d)
    return graph.one_hop_graph(_seeds(spark, d).select(F.col("work_id").alias("seed_id")), edges, works(spark, d), 500)


@query()
def greedy_map_selection(spark, d):  # noqa: ANN001
    nodes, edges = _expanded(spark, d)
    w = works(spark, d).join(judgments(spark, d), "work_id", "left")
    temporal = scores.temporal_score(F.col("year"), F.col("cited_by_count"), "seminal", AS_OF)
    rows = nodes.join(w, "work_id").select("map_id", "work_id", F.coalesce("relevance", F.lit(0.5)).alias("relevance"), temporal.alias("temporal"), (F.col("hop") == 0).alias("is_seed"), (F.col("work_id") % 9 == 0).alias("is_enrichment"))
    return graph.greedy_select(rows, edges, 40, "seminal")


SETS = "sets AS (SELECT topic AS set_id, work_id FROM (SELECT topic, work_id, row_number() OVER (PARTITION BY topic ORDER BY cited_by_count DESC, work_id) AS r FROM works) WHERE r <= 12)"


def _sets(spark, d):  # noqa: ANN001
    from paperloom.operators.retrieval import top_k

    return top_k(works(spark, d), 12, "topic", F.desc("cited_by_count"), F.asc("work_id")).select(F.col("topic").alias("set_id"), "work_id")


@query(with_(WORKS, DOC_EDGES, CLEAN, SETS) + ", r AS (SELECT DISTINCT set_id, to_id AS ref_id, from_id FROM clean JOIN sets ON from_id = work_id), n AS (SELECT set_id, ref_id, count(*) AS n FROM r WHERE (set_id, ref_id) NOT IN (SELECT set_id, work_id FROM sets) GROUP BY 1, 2 HAVING count(*) >= 2) SELECT set_id, ref_id, n FROM (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY n DESC, ref_id) AS k FROM n) WHERE k <= 10")
def shared_references(spark, d):  # noqa: ANN001
    return graph.shared_references(_sets(spark, d), _clean(spark, d)[1])


@query(with_(WORKS, DOC_EDGES, CLEAN) + ", k AS (SELECT c.to_id AS set_id, w.work_id, w.title, w.year, row_number() OVER (PARTITION BY c.to_id ORDER BY w.year, w.work_id) AS r FROM (SELECT to_id, from_id AS work_id FROM clean UNION SELECT to_id, to_id FROM clean) c JOIN works w USING (work_id)), l AS (SELECT a.set_id, a.work_id FROM clean c JOIN k a ON a.work_id = c.from_id JOIN k b ON b.work_id = c.to_id AND a.set_id = b.set_id AND a.r > b.r GROUP BY 1, 2) SELECT set_id, CASE WHEN bool_and(l.work_id IS NOT NULL OR r = 1) AND count(*) >= 2 THEN string_agg(CASE WHEN length(title) > 60 THEN substr(title, 1, 57) || '...' ELSE title END || ' (' || year || ')', ' -> ' ORDER BY r) END AS chain FROM k LEFT JOIN l USING (set_id, work_id) GROUP BY set_id")
def evolution_chains(spark, d):  # noqa: ANN001
    """For every cited work, the chain of itself and the works that cite it."""
    _, edges, _ = _clean(spark, d)
    sets = edges.select(F.col("to_id").alias("set_id"), F.col("from_id").alias("work_id")).union(edges.select("to_id", "to_id")).distinct()
    return graph.evolution_chain(sets, edges, works(spark, d))


@query(with_(WORKS) + ", n AS (SELECT topic, subfield, count(*) AS n FROM works GROUP BY 1, 2) SELECT topic AS map_id, CASE WHEN count(subfield) < 4 OR max(n)::DOUBLE / sum(n) >= 0.8 THEN 'topic' ELSE 'subfield' END AS grouping FROM n GROUP BY topic")
def default_grouping(spark, d):  # noqa: ANN001
    return graph.default_grouping(works(spark, d).withColumnRenamed("topic", "map_id"))


LABELS = [("articles", ["the", "a", "le", "la", "der"]), ("links", ["of", "de", "und"]), ("pairs", ["in", "en"])]


@query(with_(WORKS) + r", l(label, words) AS (VALUES " + ", ".join(f"('{n}', {w})" for n, w in LABELS) + r"), t AS (SELECT work_id, unnest(list_distinct(regexp_extract_all(lower(title), '[^\x09-\x0D ]+'))) AS word FROM works), h AS (SELECT work_id, label, any_value(len(words)) AS k, count(*) AS n FROM t JOIN (SELECT label, words, unnest(words) AS word FROM l) USING (word) GROUP BY 1, 2), b AS (SELECT work_id, label, row_number() OVER (PARTITION BY work_id ORDER BY n DESC, label) AS r FROM h WHERE n >= CASE WHEN k >= 5 THEN 2 ELSE 1 END) SELECT work_id, coalesce(label, 'Other') AS label FROM works LEFT JOIN (SELECT * FROM b WHERE r = 1) USING (work_id)")
def subtopic_assignment(spark, d):  # noqa: ANN001
    return graph.assign_labels(works(spark, d), spark.createDataFrame(LABELS, "label string, words array<string>"))


KEYWORDS = r"list_filter(list_distinct(regexp_extract_all(replace(lower(coalesce({0}, '')), '-', ' '), '[^\x09-\x0D ]+')), lambda w: NOT list_contains({1}, w))"
STOP = "[" + ", ".join(f"'{w}'" for w in graph.SUBTOPIC_STOP_WORDS) + "]"


@query(
    with_(WORKS)
    + f""", nodes AS (SELECT topic AS map_id, work_id, {KEYWORDS.format("title", STOP)} AS w FROM works),
given AS (SELECT topic AS map_id, work_id, 'The-group ' || (cited_by_count % 4) AS label FROM works WHERE work_id % 6 = 0),
own AS (SELECT map_id, label, unnest(w) AS x FROM nodes JOIN given USING (map_id, work_id) UNION SELECT map_id, label, unnest({KEYWORDS.format("label", STOP)}) FROM given),
hits AS (SELECT n.map_id, n.work_id, o.label, len(n.w) AS k, count(*) AS c FROM (SELECT *, unnest(w) AS x FROM nodes) n JOIN own o ON o.map_id = n.map_id AND o.x = n.x WHERE (n.map_id, n.work_id) NOT IN (SELECT map_id, work_id FROM given) GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY map_id, work_id ORDER BY c DESC, label) AS r FROM hits) WHERE r = 1),
told AS (SELECT n.map_id, n.work_id, g.label, b.label AS found, coalesce(b.c >= CASE WHEN b.k >= 5 THEN 2 ELSE 1 END, false) AS enough FROM nodes n LEFT JOIN given g ON g.map_id = n.map_id AND g.work_id = n.work_id LEFT JOIN best b ON b.map_id = n.map_id AND b.work_id = n.work_id),
maps AS (SELECT map_id, sum((label IS NULL AND NOT enough)::INT) > 0.2 * count(*) AS crowded FROM told GROUP BY 1)
SELECT map_id, work_id, coalesce(label, CASE WHEN enough OR crowded THEN found END, 'Other') AS subtopic FROM told JOIN maps USING (map_id)"""
)
def subtopics(spark, d):  # noqa: ANN001
    """Maps by topic, of whose works every sixth has one of four labels."""
    nodes = works(spark, d).select(F.col("topic").alias("map_id"), "work_id", "title", "cited_by_count")
    given = nodes.where("work_id % 6 = 0").select("map_id", "work_id", F.concat(F.lit("The-group "), (F.col("cited_by_count") % 4).cast("string")).alias("label"))
    return graph.assign_subtopics(nodes.drop("cited_by_count"), given)
