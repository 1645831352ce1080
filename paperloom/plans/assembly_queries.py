"""Queries of previews, limits, scope scores, methods, dimensions and built maps."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from paperloom.operators import assembly, relational
from paperloom.plans.registry import query
from paperloom.plans.views import DOC_EDGES, WORKS, doc_edges, with_, works
from paperloom.sources.bucketed import BucketedTable
from paperloom.tables import shared_folder, table


@query(with_(WORKS) + "SELECT work_id, title, year, cited_by_count, topic, subfield FROM works")
def previews(spark, d):  # noqa: ANN001
    return assembly.project_previews(works(spark, d))


@query(
    with_(WORKS)
    + ", s AS (SELECT work_id, title, CASE WHEN work_id % 5 > 0 THEN year END AS year, cited_by_count FROM works WHERE work_id % 3 < 2), n AS (SELECT work_id, title, year + 1 AS year, cited_by_count * 2 % 5000 AS cited_by_count FROM works WHERE work_id % 3 > 0)"
    " SELECT work_id, coalesce(s.title, n.title) AS title, coalesce(s.year, n.year) AS year, greatest(coalesce(s.cited_by_count, 0), coalesce(n.cited_by_count, 0)) AS cited_by_count FROM s FULL JOIN n USING (work_id)"
)
def graph_nodes_merged(spark, d):  # noqa: ANN001
    w = works(spark, d).select("work_id", "title", "year", "cited_by_count")
    stored = w.where("work_id % 3 < 2").withColumn("year", F.when(F.col("work_id") % 5 > 0, F.col("year")))
    new = w.where("work_id % 3 > 0").withColumn("year", F.col("year") + 1).withColumn("cited_by_count", F.col("cited_by_count") * 2 % 5000)
    return assembly.upsert_graph_nodes(stored, new)


@query(
    with_(WORKS)
    + ", r AS (SELECT work_id, CASE WHEN work_id % 5 > 0 THEN title END AS title, year, cited_by_count, 0 AS p FROM works WHERE work_id % 3 < 2 UNION ALL SELECT work_id, title || '+', year - 1, cited_by_count * 2 % 5000, 1 FROM works WHERE work_id % 3 > 0 AND work_id % 7 = 0)"
    " SELECT work_id, arg_min(title, p) FILTER (title IS NOT NULL) AS title, min(year) AS year, max(cited_by_count) AS cited_by_count FROM r GROUP BY work_id"
)
def works_store(spark, d):  # noqa: ANN001
    """Two merges into a bucketed table, the second of a few works."""
    w = works(spark, d).select("work_id", "title", "year", "cited_by_count")
    store = BucketedTable(spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}.works", w.schema, "work_id", 16)
    store.merge(w.where("work_id % 3 < 2").withColumn("title", F.when(F.col("work_id") % 5 > 0, F.col("title"))), 0, relational.upsert_works)
    some = w.where("work_id % 3 > 0 AND work_id % 7 = 0")
    store.merge(some.withColumn("title", F.concat("title", F.lit("+"))).withColumn("year", F.col("year") - 1).withColumn("cited_by_count", F.col("cited_by_count") * 2 % 5000), 1, relational.upsert_works)
    return store.read()


@query(with_(WORKS) + "SELECT topic, work_id FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY cited_by_count DESC, work_id) AS r FROM works) WHERE r <= 15")
def depth_limited(spark, d):  # noqa: ANN001
    """The fifteen most cited works of each topic."""
    ranked = works(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("cited_by_count"), "work_id")))
    return assembly.depth_limit(ranked, "high_level", "topic").select("topic", "work_id")


def _term(*forms: str) -> str:
    one = lambda f: f"CASE WHEN contains(t, '{f}') THEN 1.0::DOUBLE ELSE len(list_intersect(string_split('{f}', ' '), w))::DOUBLE / {len(f.split())} END"
    return f"greatest({', '.join(map(one, forms))})"


TOPIC, DOMAIN, ASPECT = ("of the", "der und", "que los"), ("that is", "von den mit"), ("de la",)


@query(
    with_(WORKS)
    + r", t AS (SELECT work_id, trim(regexp_replace(lower(coalesce(title, '') || ' ' || coalesce(abstract, '')), '[\x09-\x0D ]+', ' ', 'g')) AS t FROM works), u AS (SELECT *, string_split(t, ' ') AS w FROM t)"
    + f", s AS (SELECT work_id, {_term(*TOPIC)} AS a, {_term(*DOMAIN)} AS b, {_term(*ASPECT)} AS c FROM u)"
    " SELECT work_id, 'intersection' AS scope, round(a * b * (0.5 + 0.5 * c), 6) AS score FROM s WHERE a * b * (0.5 + 0.5 * c) >= 0.2 UNION ALL SELECT work_id, 'topic_focused', round(a * 0.8 + b * 0.2, 6) FROM s WHERE a * 0.8 + b * 0.2 >= 0.2"
    " UNION ALL SELECT work_id, 'domain_focused', round(b * 0.8 + a * 0.2, 6) FROM s WHERE b * 0.8 + a * 0.2 >= 0.2 UNION ALL SELECT work_id, 'broad', round((a + b) / 2, 6) FROM s WHERE (a + b) / 2 >= 0.2"
)
def scope_filtered(spark, d):  # noqa: ANN001
    terms = [F.array(*map(F.lit, x)) for x in (TOPIC, DOMAIN, ASPECT)]
    found = assembly.scopes_filter(works(spark, d), *terms, ("intersection", "topic_focused", "domain_focused", "broad"))
    return found.select("work_id", "scope", F.round("scope_score", 6).alias("score"))


TERMS = ", ".join(f"('{method}', '{term}')" for method, terms in assembly.METHODS.items() for term in terms)
METHOD = f", m AS (SELECT work_id, method FROM (SELECT work_id, method, row_number() OVER (PARTITION BY work_id ORDER BY length(term) DESC, method) AS r FROM works, (VALUES {TERMS}) AS k(method, term) WHERE contains(lower(title || ' ' || coalesce(abstract, '')), term)) WHERE r = 1)"


@query(with_(WORKS) + METHOD + " SELECT work_id, method FROM works LEFT JOIN m USING (work_id)")
def methods(spark, d):  # noqa: ANN001
    return works(spark, d).select("work_id", assembly.method_of(F.concat_ws(" ", "title", "abstract")).alias("method"))


@query(with_(WORKS, DOC_EDGES) + METHOD + " SELECT from_id, to_id, coalesce(a.method != b.method, false) AS mismatch FROM (SELECT DISTINCT * FROM doc_edges) LEFT JOIN m a ON a.work_id = from_id LEFT JOIN m b ON b.work_id = to_id")
def method_mismatches(spark, d):  # noqa: ANN001
    m = methods(spark, d)
    side = lambda key: m.select(F.col("work_id").alias(key), F.col("method").alias(f"m_{key}"))
    e = doc_edges(spark, d).distinct().join(side("from_id"), "from_id", "left").join(side("to_id"), "to_id", "left")
    return e.select("from_id", "to_id", assembly.method_mismatch(F.col("m_from_id"), F.col("m_to_id")).alias("mismatch"))


def _listed(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _words(x: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower(coalesce({x}, '')), '[a-z]+')), lambda w: NOT list_contains({_listed(assembly.DIMENSION_STOP)}, w))"


def _alike(a: str, b: str, least: float) -> str:
    return f"(len({a}) > 0 AND len({b}) > 0 AND len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) >= {least})"


KIN = " OR ".join(
    f"(len(list_intersect(na, {k})) > 0 AND len(list_intersect(nb, {k})) > 0 AND len(list_distinct(list_concat(list_intersect(na, {k}), list_intersect(nb, {k})))) >= 2)" for k in map(_listed, assembly.DIMENSION_KIN)
)


@query(
    with_(WORKS, DOC_EDGES)
    + f", w AS (SELECT work_id, {_words('title')} AS n, {_words('abstract')} AS x FROM works), p AS (SELECT from_id, to_id, a.n AS na, b.n AS nb, a.x AS xa, b.x AS xb FROM (SELECT DISTINCT * FROM doc_edges) JOIN w a ON a.work_id = from_id JOIN w b ON b.work_id = to_id)"
    f" SELECT from_id, to_id, ({_alike('na', 'nb', 0.4)} OR {KIN} OR {_alike('xa', 'xb', 0.5)}) AS overlap FROM p"
)
def dimension_overlap(spark, d):  # noqa: ANN001
    """Whether two linked works, taken as dimensions named by their titles, say the same."""
    return assembly.dimension_overlaps(doc_edges(spark, d).distinct(), works(spark, d))


@query(
    with_(WORKS, DOC_EDGES)
    + ", n AS (SELECT topic AS map_id, subfield, count(*) AS n FROM works GROUP BY 1, 2), g AS (SELECT map_id, count(subfield) < 4 OR max(n)::DOUBLE / sum(n) >= 0.8 AS by_topic FROM n GROUP BY 1),"
    ' c AS (SELECT map_id, work_id, CASE WHEN by_topic THEN topic ELSE subfield END AS "group" FROM works JOIN g ON map_id = topic),'
    " i AS (SELECT a.topic AS map_id, from_id, to_id FROM (SELECT DISTINCT * FROM doc_edges) JOIN works a ON a.work_id = from_id JOIN works b ON b.work_id = to_id AND a.topic = b.topic WHERE from_id != to_id),"
    " e AS (SELECT map_id, from_id AS work_id FROM i UNION ALL SELECT map_id, to_id FROM i), k AS (SELECT map_id, work_id, count(*) AS n FROM e GROUP BY 1, 2)"
    ' SELECT map_id, work_id, "group", coalesce(n, 0)::DOUBLE AS connector_score, count(*) OVER (PARTITION BY map_id, "group")::DOUBLE / count(*) OVER (PARTITION BY map_id) AS group_share FROM c LEFT JOIN k USING (map_id, work_id)'
)
def built_maps(spark, d):  # noqa: ANN001
    """Every topic as a map: nodes with their group, its share, and their degree."""
    return assembly.map_build(works(spark, d).withColumn("map_id", F.col("topic")), doc_edges(spark, d))


@query("SELECT s_suppkey, count(*) AS late FROM supplier JOIN lineitem ON l_suppkey = s_suppkey WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F') GROUP BY 1")
def lines_of_open_orders(spark, d):  # noqa: ANN001
    """Lines by supplier that no finished order holds: an anti join that leaves rows."""
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(done, "l_orderkey", "left_anti")
    return lines.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("late")).join(table(spark, d, "supplier").select("s_suppkey"), "s_suppkey").select("s_suppkey", "late")
