"""Queries on scalar functions, sources and the batch twins of the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import scores, text
from paperloom.operators import relational
from paperloom.plans.registry import query
from paperloom.plans.text_queries import STOPS, TITLE_STOPS
from paperloom.plans.views import ACTIVITY, AS_OF, JUDGMENTS, WORKS, activity, judgments, with_, works
from paperloom.sources import store
from paperloom.streaming import activity as streams


@query(
    with_(WORKS)
    + r"""SELECT work_id, round(2026.0 - year, 6) AS age, round(exp(-(2026.0 - year) / 5), 6) AS recency, round((1.0 + cited_by_count) / (2.0 + (2026 - year) + 1.0), 6) AS impact_rate,
round(greatest(0, (1.0 + cited_by_count) / (3.0 + (2026 - year)) - 0.5 * sqrt((1.0 + cited_by_count) / ((3.0 + (2026 - year)) * (3.0 + (2026 - year))))), 6) AS careful_rate,
round(0.4 * least(1.0, (2026 - year) / 20) + 0.6 * least(1.0, cited_by_count / 1000), 6) AS seminal,
CASE WHEN 2026 - year <= 2 THEN 1.0 WHEN 2026 - year <= 5 THEN 0.8 WHEN 2026 - year <= 10 THEN 0.4 ELSE 0.1 END::DOUBLE AS recent,
(year - year % 5)::VARCHAR || '-' || (year - year % 5 + 4)::VARCHAR AS era, (year - year % 10)::VARCHAR || 's' AS decade FROM works"""
)
def work_scores(spark, d):  # noqa: ANN001
    years = scores.age(F.col("year"), AS_OF)
    c = F.col("cited_by_count")
    return works(spark, d).select(
        "work_id",
        F.round(years, 6).alias("age"),
        F.round(scores.recency(years, 5), 6).alias("recency"),
        F.round(scores.impact_rate(c, years), 6).alias("impact_rate"),
        F.round(scores.impact_rate(c, years, gamma=0.5), 6).alias("careful_rate"),
        F.round(scores.temporal_score(F.col("year"), c, "seminal", AS_OF), 6).alias("seminal"),
        scores.temporal_score(F.col("year"), c, "recent", AS_OF).alias("recent"),
        scores.era_label(F.col("year"), 5).alias("era"),
        scores.era_label(F.col("year"), 10).alias("decade"),
    )


@query(
    with_(WORKS)
    + rf""", t AS (SELECT work_id, regexp_extract_all(lower(coalesce(abstract, '')), '[\p{{L}}\p{{N}}_]+') AS toks, regexp_extract_all(lower(coalesce(abstract, '')), '[a-z]{{4,}}') AS m FROM works),
f AS (SELECT work_id, w, min(i) AS i FROM (SELECT work_id, unnest(m) AS w, generate_subscripts(m, 1) AS i FROM t) WHERE NOT list_contains({STOPS}, w) GROUP BY 1, 2),
e AS (SELECT work_id, string_agg(w, ' ' ORDER BY i) AS terms FROM (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY i) AS r FROM f) WHERE r <= 8 GROUP BY 1)
SELECT work_id, coalesce(terms, '') AS terms, len(toks) AS n_tokens, len(list_filter(toks, lambda x: length(x) > 2 AND NOT list_contains({STOPS}, x))) AS n_content FROM t LEFT JOIN e USING (work_id)"""
)
def search_terms(spark, d):  # noqa: ANN001
    a = F.col("abstract")
    return works(spark, d).select("work_id", F.array_join(text.search_terms(a), " ").alias("terms"), F.size(text.tokens(a)).cast("bigint").alias("n_tokens"), F.size(text.content_tokens(a)).cast("bigint").alias("n_content"))


@query(with_(WORKS) + rf"SELECT work_id, trim(regexp_replace(regexp_replace(lower(title), '[^\p{{L}}\p{{N}}_\x09-\x0D ]', ' ', 'g'), '[\x09-\x0D ]+', ' ', 'g')) AS title, len(list_distinct(list_filter(regexp_extract_all(regexp_replace(lower(title), '[^\p{{L}}\p{{N}}_\x09-\x0D ]', '', 'g'), '[^\x09-\x0D ]+'), lambda w: length(w) > 2 AND NOT list_contains({TITLE_STOPS}, w)))) AS n_words, sha256(coalesce(topic, '') || '|' || coalesce(subfield, '') || '|' || year::VARCHAR) AS params FROM works")
def normalized_titles(spark, d):  # noqa: ANN001
    return works(spark, d).select("work_id", text.normalize_title(F.col("title")).alias("title"), F.size(text.title_words(F.col("title"))).cast("bigint").alias("n_words"), text.params_hash(F.col("topic"), F.col("subfield"), F.col("year")).alias("params"))


@query()
def decomposed_titles(spark, d):  # noqa: ANN001
    """Titles of any script with their compatibility forms taken apart, as titles of several sources are compared."""
    return works(spark, d).select("work_id", text.normalize_title(text.decomposed(F.col("title"))).alias("title"))


@query(with_(WORKS) + "SELECT work_id, CASE WHEN work_id % 3 = 0 THEN '10.1234/ab' || work_id WHEN work_id % 3 = 1 THEN '10.1/x' || work_id END AS doi, '2301.' || work_id AS arxiv_id FROM works")
def normalized_identifiers(spark, d):  # noqa: ANN001
    i = F.col("work_id").cast("string")
    raw = F.when(F.col("work_id") % 3 == 0, F.concat(F.lit(" https://doi.org/10.1234/AB"), i)).when(F.col("work_id") % 3 == 1, F.concat(F.lit("DOI:10.1/X"), i))
    arxiv = F.when(F.col("work_id") % 2 == 0, F.concat(F.lit("https://arxiv.org/pdf/2301."), i, F.lit(".pdf"))).otherwise(F.concat(F.lit("arXiv:2301."), i, F.lit("v2")))
    return works(spark, d).select("work_id", text.normalize_doi(raw).alias("doi"), text.normalize_arxiv_id(arxiv).alias("arxiv_id"))


@query(with_(WORKS) + "SELECT work_id, CASE WHEN length(abstract) <= 80 THEN abstract ELSE regexp_replace(substr(abstract, 1, 80), ' [^ ]*$', '') || '...' END AS short FROM works")
def truncated_abstracts(spark, d):  # noqa: ANN001
    return works(spark, d).select("work_id", text.truncate_at_word(F.col("abstract"), 80).alias("short"))


FREQUENT = {"en": ["the", "and", "of", "to"], "de": ["der", "die", "und", "das"], "fr": ["le", "les", "et", "des"], "es": ["el", "los", "que", "por"]}


@query(
    with_(WORKS)
    + r""", t AS (SELECT work_id, list_distinct(regexp_extract_all(lower(coalesce(abstract, '')), '[\p{L}\p{N}_]+')) AS w FROM works), n AS (SELECT work_id, """
    + ", ".join(f"len(list_intersect(w, {v})) AS {k}" for k, v in FREQUENT.items())
    + " FROM t) SELECT work_id, CASE WHEN greatest(en, de, fr, es) = 0 THEN 'unknown' WHEN en = greatest(en, de, fr, es) THEN 'en' WHEN de = greatest(en, de, fr, es) THEN 'de' WHEN fr = greatest(en, de, fr, es) THEN 'fr' ELSE 'es' END AS language FROM n"
)
def language_guess(spark, d):  # noqa: ANN001
    return works(spark, d).select("work_id", text.language_guess(F.col("abstract"), FREQUENT).alias("language"))


@query(with_(WORKS) + "SELECT work_id, CASE WHEN topic_hit AND domain_hit THEN least(1.0, 0.8 + 0.0) WHEN topic_hit OR domain_hit THEN 0.4 ELSE 0.1 END::DOUBLE + CASE WHEN t2 AND d2 THEN 0.1 ELSE 0 END::DOUBLE AS relevance FROM (SELECT work_id, contains(lower(title || ' ' || coalesce(abstract, '')), 'thth') AS topic_hit, contains(lower(title || ' ' || coalesce(abstract, '')), 'ing') AS domain_hit, contains(lower(title), 'thth') AS t2, contains(lower(title), 'ing') AS d2 FROM works)")
def relevance_by_scope(spark, d):  # noqa: ANN001
    term = lambda t: F.array(F.lit(t)) if t else F.array().cast("array<string>")
    return works(spark, d).select("work_id", scores.relevance_by_scope(F.col("title"), F.col("abstract"), term("thth"), term("ing"), term(""), "intersection").alias("relevance"))


@query(with_(WORKS, JUDGMENTS) + "SELECT work_id, round(least(1.0, greatest(0.0, CASE WHEN s = 0 THEN least(relevance * 0.6, 0.6) + 0.30 WHEN s = 1 THEN least(relevance * 0.6, 0.6) + 0.25 * (1 - (year % 100) / 100) ELSE least(relevance * 0.6, 0.6) * 0.2 END)), 6) AS confidence FROM (SELECT work_id, year, relevance, work_id % 3 AS s FROM works JOIN judgments USING (work_id))")
def gap_confidence(spark, d):  # noqa: ANN001
    s = F.when(F.col("work_id") % 3 == 0, "open").when(F.col("work_id") % 3 == 1, "partial").otherwise("addressed")
    j = works(spark, d).join(judgments(spark, d), "work_id")
    return j.select("work_id", F.round(scores.gap_confidence(F.col("relevance"), s, F.col("year") % 100, F.lit(0)), 6).alias("confidence"))


@query(with_(WORKS) + "SELECT work_id FROM works WHERE year BETWEEN 1995 AND 2015 AND length(abstract) >= 100 AND NOT contains(upper(title), 'RETRACTED') AND topic IN ('src0', 'src3')")
def works_filtered(spark, d):  # noqa: ANN001
    return works(spark, d).where(F.col("year").between(1995, 2015) & (F.length("abstract") >= 100) & ~F.coalesce(F.upper("title").contains("RETRACTED"), F.lit(False)) & F.col("topic").isin("src0", "src3")).select("work_id")


@query(with_(WORKS) + "SELECT work_id, year, cited_by_count FROM works WHERE year > 2023 OR (year >= 2022 AND cited_by_count >= 5000)")
def suspicious_metadata(spark, d):  # noqa: ANN001
    return relational.suspicious_metadata(works(spark, d), 2023).select("work_id", "year", "cited_by_count")


@query(
    r"""SELECT conv_id AS map_id, title, CASE WHEN regexp_matches(n, '^[0-9]+$') THEN n::INT END AS n_nodes FROM (SELECT conv_id, 'm' || (conv_id % 7) AS title, CASE WHEN conv_id % 5 = 0 THEN 'many' ELSE sum(length(text))::VARCHAR END AS n FROM conversations GROUP BY conv_id) ORDER BY map_id DESC LIMIT 40"""
)
def list_maps(spark, d):  # noqa: ANN001
    from paperloom.tables import table

    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("n"))
    n = F.when(F.col("conv_id") % 5 == 0, F.lit("many")).otherwise(F.col("n").cast("string"))
    response = F.to_json(F.struct(F.concat(F.lit("m"), (F.col("conv_id") % 7).cast("string")).alias("title"), F.struct(n.alias("node_count")).alias("metadata")))
    return store.list_maps(c.select(F.col("conv_id").alias("map_id"), response.alias("response"), F.col("conv_id").alias("created_at")), 40).drop("created_at")


@query(
    """WITH RECURSIVE r AS (SELECT doc_id AS record_id, doc_id % 3 AS priority, 'd' || (doc_id % 400) AS k1, 't' || (doc_id // 2) AS k2 FROM documents),
e AS (SELECT DISTINCT a.record_id AS x, b.record_id AS y FROM r a JOIN r b ON a.k1 = b.k1 OR a.k2 = b.k2), c AS (SELECT record_id AS x, record_id AS y FROM r UNION SELECT c.x, e.y FROM c JOIN e ON c.y = e.x)
SELECT c.x AS record_id, arg_min(r.record_id, (r.priority, r.record_id)) AS canonical_id FROM c JOIN r ON r.record_id = c.y GROUP BY 1"""
)
def canonical_ids(spark, d):  # noqa: ANN001
    from paperloom.tables import table

    i = F.col("doc_id")
    records = table(spark, d, "documents").select(i.alias("record_id"), (i % 3).alias("priority"), F.concat(F.lit("d"), (i % 400).cast("string")).alias("doi"), F.lit(None).cast("string").alias("arxiv_id"), F.concat(F.lit("t"), F.floor(i / 2).cast("string")).alias("title"))
    return store.canonical_ids(records)


@query("""
WITH RECURSIVE r AS (SELECT doc_id AS record_id, doc_id * 7919 % 1009 AS priority, CASE WHEN (doc_id + 1) // 2 * 2 % 5000 != 0 THEN 'k' || ((doc_id + 1) // 2)::VARCHAR END AS doi, 't' || (doc_id // 2)::VARCHAR AS title FROM documents),
e AS (SELECT DISTINCT a.record_id AS x, b.record_id AS y FROM r a JOIN r b ON a.doi = b.doi OR a.title = b.title),
c AS (SELECT record_id AS x, record_id AS y FROM r UNION SELECT c.x, e.y FROM c JOIN e ON c.y = e.x)
SELECT c.x AS record_id, arg_min(r.record_id, (r.priority, r.record_id)) AS canonical_id FROM c JOIN r ON r.record_id = c.y GROUP BY 1""")
def canonical_ids_of_chains(spark, d):  # noqa: ANN001
    """Records that only share keys with the next and the one before, 5,000 in a row."""
    from paperloom.tables import table

    i = F.col("doc_id")
    half = F.floor((i + 1) / 2)
    doi = F.when(half * 2 % 5000 != 0, F.concat(F.lit("k"), half.cast("string")))
    records = table(spark, d, "documents").select(i.alias("record_id"), (i * 7919 % 1009).alias("priority"), doi.alias("doi"), F.lit(None).cast("string").alias("arxiv_id"), F.concat(F.lit("t"), F.floor(i / 2).cast("string")).alias("title"))
    return store.canonical_ids(records)


@query(with_(ACTIVITY) + "SELECT time_bucket(INTERVAL 1 HOUR, ts)::VARCHAR AS start, activity_type, count(*) AS n FROM activity GROUP BY 1, 2")
def usage_by_hour(spark, d):  # noqa: ANN001
    return streams.usage_by_window(activity(spark, d)).withColumn("start", F.col("start").cast("string"))


@query(with_(ACTIVITY) + ", g AS (SELECT map_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS s FROM activity WINDOW w AS (PARTITION BY map_id ORDER BY ts)), h AS (SELECT *, sum(s) OVER (PARTITION BY map_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT map_id, count(*) AS n, epoch_us(max(ts)) - epoch_us(min(ts)) AS length FROM h GROUP BY map_id, k")
def research_sessions(spark, d):  # noqa: ANN001
    s = streams.sessions(activity(spark, d))
    return s.select("map_id", "n", (F.unix_micros("end") - F.unix_micros("start") - 1_800_000_000).alias("length"))
