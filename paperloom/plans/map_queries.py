"""Queries on eras, landmarks and gaps. Maps are languages, clusters are sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import scores, text
from paperloom.operators import gaps, temporal
from paperloom.plans.registry import ORACLE_SQL, query
from paperloom.plans.views import AS_OF, DOC_EDGES, JUDGMENTS, WORKS, doc_edges, judgments, with_, works

WIDTH = """quart AS (SELECT topic, list_sort(list(year)) AS y FROM works GROUP BY topic),
span AS (SELECT topic, y, CASE WHEN len(y) >= 4 THEN y[(3 * len(y)) // 4 + 1] - y[len(y) // 4 + 1] ELSE y[len(y)] - y[1] END + 1 AS s FROM quart),
first_w AS (SELECT topic, y, CASE WHEN s <= 4 THEN 1 WHEN s <= 12 THEN 3 WHEN s <= 25 THEN 5 ELSE 10 END AS f FROM span),
width AS (SELECT topic, CASE WHEN f = 10 THEN 10 WHEN f <= 1 AND len(list_distinct(y)) <= 6 THEN 1 WHEN f <= 3 AND len(list_distinct([v // 3 FOR v IN y])) <= 6 THEN 3 WHEN f <= 5 AND len(list_distinct([v // 5 FOR v IN y])) <= 6 THEN 5 ELSE 10 END::INT AS width FROM first_w),
eras AS (SELECT w.*, CASE WHEN width = 1 THEN year::VARCHAR WHEN width = 10 THEN (year - year % 10)::VARCHAR || 's' ELSE (year - year % width)::VARCHAR || '-' || (year - year % width + width - 1)::VARCHAR END AS era FROM works w JOIN width USING (topic))"""


@query(with_(WORKS, WIDTH) + "SELECT topic, width FROM width")
def era_width(spark, d):  # noqa: ANN001
    return temporal.era_width(works(spark, d), "topic")


@query(with_(WORKS, WIDTH) + "SELECT topic, era, count(*) OVER (PARTITION BY topic, era) AS n, (row_number() OVER (PARTITION BY topic, era ORDER BY cited_by_count DESC, work_id))::INT AS rank, work_id FROM eras")
def temporal_map(spark, d):  # noqa: ANN001
    return temporal.temporal_map(works(spark, d), "topic").select("topic", "era", "n", "rank", "work_id")


@query(with_(WORKS, WIDTH) + ", r AS (SELECT *, row_number() OVER w - 1 AS i, least(floor(count(*) OVER (PARTITION BY topic, era) * 0.9::DOUBLE), count(*) OVER (PARTITION BY topic, era) - 1) AS a FROM eras WINDOW w AS (PARTITION BY topic, era ORDER BY cited_by_count)), e AS (SELECT *, max(CASE WHEN i = a THEN cited_by_count END) OVER (PARTITION BY topic, era) AS edge FROM r) SELECT topic, era, work_id FROM e WHERE cited_by_count >= edge AND cited_by_count > 100")
def milestones(spark, d):  # noqa: ANN001
    w = works(spark, d)
    rows = w.join(temporal.era_width(w, "topic"), "topic").withColumn("era", scores.era_label(F.col("year"), F.col("width")))
    return temporal.milestones(rows, ["topic", "era"]).select("topic", "era", "work_id")


@query(with_(WORKS) + ", s AS (SELECT topic, min(year) AS a, coalesce(max(CASE WHEN year < 2015 THEN year END), max(year)) AS b FROM works GROUP BY 1), p AS (SELECT topic, a, b, greatest(3, least(6, round_even(3 + log2(greatest(1.0, (b - a) / 5.0)), 0)))::INT AS k FROM s WHERE b > a), g AS (SELECT topic, a, (b - a)::DOUBLE / k AS len, unnest(range(k)) AS period FROM p), i AS (SELECT g.topic, period, work_id, cited_by_count FROM g JOIN works w ON w.topic = g.topic AND year >= a + period * len AND year < a + period * len + len + 1 AND year < 2015) SELECT topic, period::INT AS period, work_id FROM (SELECT *, row_number() OVER (PARTITION BY topic, period ORDER BY cited_by_count DESC, work_id) AS r FROM i) WHERE r = 1")
def topic_landmarks(spark, d):  # noqa: ANN001
    return temporal.topic_landmarks(works(spark, d), "topic", 2015)


def _timeline_parts(spark, d):  # noqa: ANN001
    e, w = doc_edges(spark, d).where("from_id != to_id").distinct(), works(spark, d)
    refs = e.select(F.col("from_id").alias("node_id"), F.lit("reference").alias("relation"), F.col("to_id").alias("work_id"))
    citing = e.select(F.col("to_id").alias("node_id"), F.lit("citing").alias("relation"), F.col("from_id").alias("work_id"))
    return refs.union(citing).join(w.select("work_id", "year", "cited_by_count"), "work_id")


PARTS = "e AS (SELECT DISTINCT * FROM doc_edges WHERE from_id != to_id), parts AS (SELECT node_id, work_id, year, cited_by_count, relation FROM (SELECT from_id AS node_id, 'reference' AS relation, to_id AS work_id FROM e UNION ALL SELECT to_id, 'citing', from_id FROM e) JOIN works USING (work_id))"


@query(with_(WORKS, DOC_EDGES, PARTS) + "SELECT node_id, (year - year % 5)::VARCHAR || '-' || (year - year % 5 + 4)::VARCHAR AS era, (year - year % 5)::INT AS start, string_agg(work_id::VARCHAR, ',' ORDER BY work_id) AS work_ids FROM (SELECT DISTINCT node_id, work_id, year FROM parts) GROUP BY ALL")
def node_timeline(spark, d):  # noqa: ANN001
    return temporal.node_timeline(_timeline_parts(spark, d)).withColumn("work_ids", F.array_join(F.transform("work_ids", lambda x: x.cast("string")), ","))


@query(with_(WORKS, DOC_EDGES, PARTS) + ", c AS (SELECT node_id, count(CASE WHEN relation = 'reference' THEN 1 END) AS r, count(CASE WHEN relation = 'citing' AND cited_by_count >= 2500 THEN 1 END) AS m FROM parts GROUP BY 1) SELECT node_id, greatest(2 - r, 0)::BIGINT AS need_references, greatest(3 - m, 0)::BIGINT AS need_landmarks, greatest(5 - r - m, 0)::BIGINT AS need_total FROM c")
def grounding_needs(spark, d):  # noqa: ANN001
    counts = _timeline_parts(spark, d).groupBy("node_id").agg(F.count_if(F.col("relation") == "reference").alias("n_references"), F.count_if((F.col("relation") == "citing") & (F.col("cited_by_count") >= 2500)).alias("n_landmarks"))
    return temporal.grounding_needs(counts)


CLUSTERS = "nodes AS (SELECT subfield AS map_id, topic AS cluster, work_id, year, cited_by_count, (year % 7)::INT AS t FROM works), medges AS (SELECT DISTINCT a.map_id, from_id, to_id FROM doc_edges JOIN nodes a ON a.work_id = from_id JOIN nodes b ON b.work_id = to_id AND a.map_id = b.map_id WHERE from_id != to_id)"


def _nodes(spark, d):  # noqa: ANN001
    return works(spark, d).select(F.col("subfield").alias("map_id"), F.col("topic").alias("cluster"), "topic", "work_id", "year", "cited_by_count", F.array((F.col("year") % 7).cast("int")).alias("topics"))


def _map_edges(spark, d):  # noqa: ANN001
    from paperloom.operators.graph import induced

    return induced(_nodes(spark, d).select("map_id", "work_id"), doc_edges(spark, d).where("from_id != to_id"))


@query(
    with_(WORKS, DOC_EDGES, CLUSTERS)
    + """, c AS (SELECT map_id, cluster, count(*) AS n, list_distinct(list(t)) AS ts FROM nodes GROUP BY 1, 2 HAVING count(*) >= 2),
p AS (SELECT x.map_id, x.cluster AS a, y.cluster AS b, x.n AS na, y.n AS nb, len(list_intersect(x.ts, y.ts))::DOUBLE / (len(x.ts) + len(y.ts) - len(list_intersect(x.ts, y.ts))) AS similarity FROM c x JOIN c y ON x.map_id = y.map_id AND x.cluster < y.cluster),
k AS (SELECT m.map_id, least(f.cluster, g.cluster) AS a, greatest(f.cluster, g.cluster) AS b, count(*) AS x FROM medges m JOIN nodes f ON f.work_id = from_id AND f.map_id = m.map_id JOIN nodes g ON g.work_id = to_id AND g.map_id = m.map_id WHERE f.cluster != g.cluster GROUP BY 1, 2, 3),
s AS (SELECT p.map_id, p.a, p.b, similarity, coalesce(x, 0)::DOUBLE / (na * nb * 2) AS density FROM p LEFT JOIN k ON k.map_id = p.map_id AND k.a = p.a AND k.b = p.b),
q AS (SELECT *, similarity * (1 - density) AS gap_score FROM s)
SELECT map_id, a, b, round(similarity, 6) AS similarity, round(density, 6) AS density, round(gap_score, 6) AS gap_score FROM (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY gap_score DESC, a, b) AS r FROM q WHERE similarity >= 0.10 AND gap_score > 0.15) WHERE r <= 10"""
)
def structural_gaps(spark, d):  # noqa: ANN001
    found = gaps.structural_gaps(_nodes(spark, d), _map_edges(spark, d))
    return found.select("map_id", "a", "b", *(F.round(c, 6).alias(c) for c in ("similarity", "density", "gap_score")))


COVERAGE = """n AS (SELECT map_id, topic, count(*) AS n, sum(cited_by_count) AS c FROM m GROUP BY 1, 2),
z AS (SELECT *, (avg(n) OVER w - n) / CASE WHEN stddev_pop(n) OVER w > 0 THEN stddev_pop(n) OVER w ELSE 1 END AS z, sum(n) OVER w AS total, avg(c) OVER w AS cm FROM n WINDOW w AS (PARTITION BY map_id)),
g AS (SELECT map_id, topic, n AS count, least(z / 2, 1.0) AS gap_score FROM z WHERE z > 0 AND (n > 1 OR c >= 0.5 * cm) AND least(z / 2, 1.0) > CASE WHEN total < 50 THEN 0.20 ELSE 0.30 END)
SELECT map_id, topic, count, round(gap_score, 6) AS gap_score FROM (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY gap_score DESC, topic) AS r FROM g) WHERE r <= 10"""


@query(with_(WORKS) + ", m AS (SELECT subfield AS map_id, topic, cited_by_count FROM works), " + COVERAGE)
def coverage_gaps(spark, d):  # noqa: ANN001
    return gaps.coverage_gaps(_nodes(spark, d)).withColumn("gap_score", F.round("gap_score", 6))


THIN = "thin AS (SELECT topic AS map_id, year FROM works WHERE year % 10 NOT IN (3, 4, 5))"


@query(with_(WORKS, THIN) + ", n AS (SELECT map_id, year, count(*) AS n FROM thin GROUP BY 1, 2), sp AS (SELECT map_id, unnest(range(min(year), max(year) + 1)) AS year FROM n GROUP BY 1) SELECT map_id, year::INT AS year, coalesce(n, 0) AS n, round(avg(coalesce(n, 0)) OVER (PARTITION BY map_id ORDER BY year RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS local FROM sp LEFT JOIN n USING (map_id, year)")
def yearly_moving_average(spark, d):  # noqa: ANN001
    thin = works(spark, d).where("year % 10 NOT IN (3, 4, 5)").withColumnRenamed("topic", "map_id")
    return gaps.yearly(thin).withColumn("local", F.round("local", 6))


@query(
    with_(WORKS, THIN)
    + """, n AS (SELECT map_id, year, count(*) AS n FROM thin GROUP BY 1, 2), sp AS (SELECT map_id, unnest(range(min(year), max(year) + 1)) AS year FROM n GROUP BY 1),
y AS (SELECT map_id, year, coalesce(n, 0) AS n, avg(coalesce(n, 0)) OVER (PARTITION BY map_id ORDER BY year RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS local FROM sp LEFT JOIN n USING (map_id, year)),
f AS (SELECT *, sum(n) OVER (PARTITION BY map_id) AS papers, count(*) OVER (PARTITION BY map_id) AS span, n < 0.4 * local AND local > 0.5 AS low, n > 0.5 * local AS lively FROM y),
b AS (SELECT *, coalesce(bool_or(lively) OVER (PARTITION BY map_id ORDER BY year RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING), false) AS bef, coalesce(bool_or(lively) OVER (PARTITION BY map_id ORDER BY year RANGE BETWEEN 1 FOLLOWING AND 3 FOLLOWING), false) AS aft FROM f WHERE papers >= 15 AND span >= 4),
r AS (SELECT map_id, papers, span, min(year) AS s, max(year) AS e, avg(n) AS rate, arg_min(bef, year) AS bef, arg_max(aft, year) AS aft FROM (SELECT *, year - row_number() OVER (PARTITION BY map_id ORDER BY year) AS island FROM b WHERE low) GROUP BY map_id, island, papers, span HAVING max(year) > min(year)),
g AS (SELECT r.*, greatest(y.local, 0.5 * papers / span) AS reference FROM r JOIN y ON y.map_id = r.map_id AND y.year = (s + e) // 2),
h AS (SELECT *, (reference - rate) / reference * least(papers / span / 2, 1.0) AS gap_score FROM g)
SELECT map_id, s::INT AS start_year, e::INT AS end_year, round(rate, 6) AS rate, round(reference, 6) AS reference, round(gap_score, 6) AS gap_score, bef AND aft AS comeback FROM (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY gap_score DESC, s) AS k FROM h WHERE gap_score > 0.3) WHERE k <= 10"""
)
def temporal_gaps(spark, d):  # noqa: ANN001
    thin = works(spark, d).where("year % 10 NOT IN (3, 4, 5)").withColumnRenamed("topic", "map_id")
    found = gaps.temporal_gaps(thin)
    return found.select("map_id", "start_year", "end_year", *(F.round(c, 6).alias(c) for c in ("rate", "reference", "gap_score")), "comeback")


PRINTS = "prints AS (SELECT work_id, subfield AS map_id, 'm' || (work_id * 31 % 23) AS method, CASE WHEN work_id * 17 % 29 > 25 THEN 'unknown' ELSE 'd' || ((work_id * 31 % 23) * (work_id % 3) % 19) END AS domain FROM works)"


def _prints(spark, d):  # noqa: ANN001
    m = F.col("work_id") * 31 % 23
    domain = F.when(F.col("work_id") * 17 % 29 > 25, "unknown").otherwise(F.concat(F.lit("d"), (m * (F.col("work_id") % 3) % 19).cast("string")))
    return works(spark, d).select("work_id", F.col("subfield").alias("map_id"), F.concat(F.lit("m"), m.cast("string")).alias("method"), domain.alias("domain"))


@query(
    with_(WORKS, PRINTS)
    + """, ms AS (SELECT map_id, method FROM prints WHERE method != 'unknown' GROUP BY 1, 2 HAVING count(*) >= 2), ds AS (SELECT map_id, domain FROM prints WHERE domain != 'unknown' GROUP BY 1, 2 HAVING count(*) >= 2),
c AS (SELECT map_id, method, domain, count(*) AS n FROM prints GROUP BY 1, 2, 3), g AS (SELECT ms.map_id, ms.method, ds.domain, coalesce(n, 0) AS n FROM ms JOIN ds USING (map_id) LEFT JOIN c ON c.map_id = ms.map_id AND c.method = ms.method AND c.domain = ds.domain),
s AS (SELECT *, sum(n) OVER (PARTITION BY map_id, method) AS r, sum(n) OVER (PARTITION BY map_id, domain) AS k FROM g), q AS (SELECT *, sqrt((r * k)::DOUBLE) AS density FROM s WHERE n = 0 AND r >= 1 AND k >= 1)
SELECT map_id, method, domain, round(density, 6) AS density, round(least(density / 5, 1.0), 6) AS gap_score FROM (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY least(density / 5, 1.0) DESC, method, domain) AS o FROM q WHERE density / 5 > 0.3) WHERE o <= 10"""
)
def method_domain_gaps(spark, d):  # noqa: ANN001
    return gaps.empty_cells(_prints(spark, d)).select("map_id", "method", "domain", F.round("density", 6).alias("density"), F.round("gap_score", 6).alias("gap_score"))


@query(with_(WORKS, JUDGMENTS) + ", a AS (SELECT subfield AS map_id, topic || '/' || (year % 4) AS cluster, CASE WHEN relevance = 0.25 THEN 0.25 ELSE 0.5 END AS novelty, year FROM works JOIN judgments USING (work_id)), g AS (SELECT map_id, cluster, count(*) AS n, avg(novelty) AS av, max(novelty) AS mx, count(CASE WHEN year >= 2021 THEN 1 END) AS rec FROM a GROUP BY 1, 2), s AS (SELECT *, (1 - mx) * (0.5 + 0.5 * rec / n) AS gap_score FROM g WHERE n >= 3 AND rec > 0 AND av < 0.5 AND mx < 0.75) SELECT map_id, cluster, round(av, 6) AS avg_novelty, round(mx, 6) AS max_novelty, round(gap_score, 6) AS gap_score FROM (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY gap_score DESC, cluster) AS r FROM s WHERE gap_score > 0.25) WHERE r <= 10")
def novelty_gaps(spark, d):  # noqa: ANN001
    a = works(spark, d).join(judgments(spark, d), "work_id").select(F.col("subfield").alias("map_id"), F.concat_ws("/", "topic", (F.col("year") % 4).cast("string")).alias("cluster"), F.when(F.col("relevance") == 0.25, 0.25).otherwise(0.5).alias("novelty"), "year")
    found = gaps.novelty_gaps(a, AS_OF)
    return found.select("map_id", "cluster", *(F.round(c, 6).alias(c) for c in ("avg_novelty", "max_novelty", "gap_score")))


@query()
def all_gaps(spark, d):  # noqa: ANN001
    """The detectors' outputs in one table."""
    return gaps.detect_all({"structural": structural_gaps(spark, d), "coverage": coverage_gaps(spark, d), "method": method_domain_gaps(spark, d), "novelty": novelty_gaps(spark, d), "temporal": temporal_gaps(spark, d)})


DETECTORS = {"structural": "structural_gaps", "coverage": "coverage_gaps", "method": "method_domain_gaps", "novelty": "novelty_gaps", "temporal": "temporal_gaps"}


@query("SELECT map_id::VARCHAR AS map_id, kind, count(*) AS n, round(max(gap_score), 6) AS best FROM (" + " UNION ALL ".join(f"SELECT map_id::VARCHAR AS map_id, '{kind}' AS kind, gap_score FROM ({ORACLE_SQL[name]})" for kind, name in DETECTORS.items()) + ") GROUP BY 1, 2")
def gap_kinds(spark, d):  # noqa: ANN001
    """How many gaps of each kind the detectors find in each map, and the best of them."""
    found = all_gaps(spark, d).withColumn("map_id", F.col("map_id").cast("string"))
    return found.groupBy("map_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("gap_score"), 6).alias("best"))


@query(
    with_(WORKS)
    + """, nodes AS (SELECT topic AS map_id, work_id, CASE WHEN work_id % 7 > 0 THEN 't' || (work_id % 5) END AS topic_id, CASE WHEN work_id % 9 > 0 THEN year END AS year, cited_by_count FROM works),
named AS (SELECT map_id, work_id, coalesce(topic_id, 'uncategorized') AS topic_id FROM nodes), c AS (SELECT map_id, topic_id, count(*) AS n, array_to_string(list_slice(list(work_id ORDER BY work_id), 1, 5), ', ') AS works FROM named GROUP BY 1, 2)
SELECT map_id, 'cluster' AS section, row_number() OVER (PARTITION BY map_id ORDER BY n DESC, topic_id)::INT AS place, CASE topic_id WHEN 't1' THEN 'One' WHEN 't2' THEN 'Two' ELSE topic_id END AS key, n, works FROM c
UNION ALL SELECT map_id, 'year', row_number() OVER (PARTITION BY map_id ORDER BY year)::INT, year::VARCHAR, n, NULL FROM (SELECT map_id, year, count(*) AS n FROM nodes WHERE year IS NOT NULL GROUP BY 1, 2)
UNION ALL SELECT map_id, 'top', r::INT, work_id::VARCHAR, cited_by_count, NULL FROM (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY cited_by_count DESC, work_id) AS r FROM nodes) WHERE r <= 5"""
)
def map_rollup(spark, d):  # noqa: ANN001
    i = F.col("work_id")
    w = works(spark, d).select(F.col("topic").alias("map_id"), "work_id", F.when(i % 7 > 0, F.concat(F.lit("t"), (i % 5).cast("string"))).alias("topic_id"), F.when(i % 9 > 0, F.col("year")).alias("year"), "cited_by_count")
    return gaps.map_rollup(w, spark.createDataFrame([("t1", "One"), ("t2", "Two")], "topic_id string, name string"))


@query()
def gaps_deduped(spark, d):  # noqa: ANN001
    """Works as gaps of their topic and year, evidence the works they cite, without those like a better one."""
    cited = doc_edges(spark, d).groupBy(F.col("from_id").alias("gap_id")).agg(F.sort_array(F.collect_set("to_id")).alias("evidence"))
    w = works(spark, d).select(F.concat_ws("/", "topic", F.col("year").cast("string")).alias("map_id"), F.col("work_id").alias("gap_id"), (F.col("cited_by_count") / 5000).alias("gap_score"), text.title_words(F.col("title")).alias("words"))
    return gaps.dedupe_gaps(w.join(cited, "gap_id"))
