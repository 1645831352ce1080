"""Queries of the rule tables: domains, fields of study, methods, kinds of paper, metrics, dictionaries of phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import rules
from paperloom.operators import phrases
from paperloom.plans.registry import query
from paperloom.plans.views import QUERIES, WORKS, with_, works
from paperloom.plans.views import queries as benchmark_queries

# Beginnings that give the works' titles something for the patterns to find.
OPENERS = (
    "", "Handbook of ", "An Introduction to ", "Fundamentals of soil ", "Proceedings of ", "A new method for ", "Deep learning of ", "R package for ", "Survey of bridge ", "Theory of ", "Meta-analysis in ",
    "Recent neural network ", "Principles of ", "Web servers of ", "An update on ", "Preferred reporting of ",
)
FIELD_NAMES = (None, "Applied", "Behavioral Health", "Earth Science", "general", "Toxicology", "arts", "", "Social Economics", "Machine Learning")
DESCRIPTIONS = ("unknown", "", None, "PID control of ", "Survey of CNN ", "policy gradients and regression ", "Evolutionary proof ", "")


def _pick(values: tuple[str | None, ...], key: str = "work_id", step: int = 1) -> Column:
    return F.get(F.array(*map(F.lit, values)), ((F.floor(F.col(key) / step)) % len(values)).cast("int"))


def _listed(values: tuple[str | None, ...], key: str = "work_id", step: int = 1) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + f"][({key} // {step}) % {len(values)} + 1]"


def titled(spark: SparkSession, d: str) -> DataFrame:
    return works(spark, d).withColumn("title", F.concat(_pick(OPENERS), F.col("title")))


TITLED = f"titled AS (SELECT * REPLACE ({_listed(OPENERS)} || title AS title) FROM works)"


def _listing(terms: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{t}'" for t in terms) + "]"


def _hits(text: str, terms: tuple[str, ...]) -> str:
    return f"len(list_filter({_listing(terms)}, lambda t: contains({text}, t)))"


CIVIL = rules.DOMAINS["civil_engineering"]
BOTH = "lower(title || ' ' || coalesce(abstract, ''))"


@query(
    with_(WORKS, TITLED)
    + f", n AS (SELECT work_id, work_id % 4 = 0 AS none, {_hits(BOTH, CIVIL['boost'])} AS b, {_hits(BOTH, CIVIL['downrank'])} AS k FROM titled)"
    " SELECT work_id, CASE WHEN none THEN 0.5 WHEN k > 0 AND b = 0 THEN 0.05 WHEN k > b THEN 0.15 WHEN b > 0 AND k = 0 THEN 1.0 WHEN b > k THEN 0.7 ELSE 0.3 END::DOUBLE AS alignment, NOT none AND k > 0 AND b = 0 AS off_domain FROM n"
)
def domain_alignment(spark, d):  # noqa: ANN001
    domain = F.when(F.col("work_id") % 4 != 0, "civil_engineering")
    return titled(spark, d).select("work_id", rules.domain_alignment(domain, F.col("title"), F.col("abstract")).alias("alignment"), rules.off_domain(domain, F.col("title"), F.col("abstract")).alias("off_domain"))


@query(with_(QUERIES) + f" SELECT query_id, CASE WHEN {_hits('lower(q)', CIVIL['detection'])} > 0 THEN 'civil_engineering' END AS domain FROM (SELECT query_id, {_listed(('', 'The Towers of ', 'Wind Loads '), 'query_id')} || query AS q FROM queries)")
def detected_domains(spark, d):  # noqa: ANN001
    q = benchmark_queries(spark, d)
    return q.select("query_id", rules.detect_domain(F.concat(_pick(("", "The Towers of ", "Wind Loads "), "query_id"), F.col("query"))).alias("domain"))


FIELD_CASE = "CASE WHEN lower(field) IN ({generic}) THEN NULL {whens} END".format(
    generic=", ".join(f"'{g}'" for g in rules.GENERIC_FIELDS), whens=" ".join(f"WHEN contains(lower(field), '{k}') THEN '{', '.join(tags)}'" for k, tags in rules.FIELDS)
)
TERM_CASE = "CASE " + " ".join(f"WHEN {_hits(BOTH, terms)} > 0 THEN '{', '.join(tags)}'" for tags, terms in rules.FIELD_TERMS) + " END"


@query(with_(WORKS) + f" SELECT work_id, coalesce({FIELD_CASE}, {TERM_CASE}) AS tags FROM (SELECT work_id, title, abstract, {_listed(FIELD_NAMES)} AS field FROM works)")
def field_tags(spark, d):  # noqa: ANN001
    return works(spark, d).select("work_id", F.array_join(rules.field_tags(_pick(FIELD_NAMES), F.col("title"), F.col("abstract")), ", ").alias("tags"))


@query(
    with_(WORKS)
    + " SELECT work_id, CASE WHEN coalesce(m, '') IN ('', 'unknown') THEN 'unknown' "
    + " ".join(f"WHEN {_hits('lower(m)', terms)} > 0 THEN '{name}'" for name, terms in rules.METHOD_BUCKETS)
    + f" ELSE 'other' END AS bucket FROM (SELECT work_id, CASE WHEN work_id % 8 < 3 THEN {_listed(DESCRIPTIONS)} ELSE {_listed(DESCRIPTIONS)} || coalesce(abstract, '') END AS m FROM works)"
)
def method_buckets(spark, d):  # noqa: ANN001
    text = F.when(F.col("work_id") % 8 < 3, _pick(DESCRIPTIONS)).otherwise(F.concat(_pick(DESCRIPTIONS), F.coalesce("abstract", F.lit(""))))
    return works(spark, d).select("work_id", rules.method_bucket(text).alias("bucket"))


def _has(column: str, patterns: tuple[str, ...]) -> str:
    return f"regexp_matches(coalesce({column}, ''), '{rules.any_of(patterns)}')"


@query(with_(WORKS, TITLED) + f" SELECT work_id, {_has('title', rules.SOFTWARE_TITLE)} OR {_has('abstract', rules.SOFTWARE_ABSTRACT)} AS software, {_has('title', rules.REVIEW_TITLE)} OR {_has('abstract', rules.REVIEW_ABSTRACT)} AS review FROM titled")
def software_and_reviews(spark, d):  # noqa: ANN001
    return titled(spark, d).select("work_id", rules.software_paper(F.col("title"), F.col("abstract")).alias("software"), rules.review_paper(F.col("title"), F.col("abstract")).alias("review"))


@query(
    with_(WORKS, TITLED)
    + f""", c AS (SELECT work_id, CASE WHEN {_has('title', rules.IMPLEMENTATION)} THEN 'implementation,0.95,false' WHEN {_has('title', rules.PROCEEDINGS)} THEN 'specific_topics,0.85,false'
    WHEN {_has('title', rules.HANDBOOK)} AND NOT {_has('title', rules.TEXTBOOK)} THEN 'handbook,0.90,false' WHEN {_has('title', rules.METHOD_PAPER)} THEN 'methodological,0.85,false'
    WHEN {_has('title', rules.RECENT_LEARNING)} AND year >= 2018 THEN 'recent,0.85,false' WHEN {_has('title', rules.TEXTBOOK)} AND {_has('title', rules.SUBFIELD)} THEN 'foundational,0.60,true'
    WHEN {_has('title', rules.TEXTBOOK)} AND cited_by_count >= 500 THEN 'foundational,0.90,false' WHEN {_has('title', rules.TEXTBOOK)} THEN 'foundational,0.70,true' END AS c FROM titled)
    SELECT work_id, split_part(c, ',', 1) AS category, split_part(c, ',', 2)::DOUBLE AS confidence, CASE split_part(c, ',', 3) WHEN 'true' THEN 'heuristic_borderline' WHEN 'false' THEN 'heuristic' END AS source, split_part(c, ',', 3)::BOOLEAN AS needs_review FROM c"""
)
def paper_category(spark, d):  # noqa: ANN001
    kind = rules.paper_category(F.col("title"), F.col("cited_by_count"), F.col("year"))
    return titled(spark, d).select("work_id", kind.alias("k")).select("work_id", "k.*")


SAID = ("R² = 0.91", "rmse of 3.2 mm.", "RMSE: 4", "an F1-score of 0.8 and F1 0.7", "tested on 40 validation images", "Accuracy = 93.5 %, recall 0.5", "MAE 1.5 (kg)", "mAP: .5; IoU of 0.6", "BLEU 30.1 precision=.9 AUC = 0.77", "")


@query(
    with_(WORKS)
    + f", t AS (SELECT work_id, {_listed(SAID)} || ' ' || {_listed(SAID, step=7)} || ' ' || coalesce(abstract, '') AS x FROM works), m AS ("
    + " UNION ALL ".join(f"SELECT work_id, {i} AS i, '{name}' AS name, regexp_extract(x, '(?i){p}', 1) AS value, " + (f"regexp_replace(regexp_extract(x, '(?i){p}', 2), '^[.,;)( ]+|[.,;)( ]+$', '', 'g')" if p.endswith("+)?") else f"'{unit}'") + " AS unit FROM t" for i, (p, name, unit) in enumerate(rules.METRICS))
    + ") SELECT work_id, coalesce(string_agg(name || '=' || value || unit, ';' ORDER BY i) FILTER (value != ''), '') AS metrics FROM m GROUP BY work_id"
)
def validation_metrics(spark, d):  # noqa: ANN001
    said = F.concat_ws(" ", _pick(SAID), _pick(SAID, step=7), F.coalesce("abstract", F.lit("")))
    m = F.transform(rules.validation_metrics(said), lambda x: F.concat(x["name"], F.lit("="), x["value"], x["unit"]))
    return works(spark, d).select("work_id", F.array_join(m, ";").alias("metrics"))


DICTIONARY = r"""dictionary AS (SELECT DISTINCT array_to_string(list_slice(w, 1, n), ' ') AS phrase, (item_id % 5)::VARCHAR AS label, n::INT AS n_words FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM benchmark), generate_series(1, 3) g(n) WHERE len(w) >= n)"""


def dictionary(spark: SparkSession, d: str) -> DataFrame:
    """The first one to three words of every benchmark text."""
    from paperloom.functions.text import tokens
    from paperloom.tables import table

    w = table(spark, d, "benchmark").select("item_id", tokens(F.col("text")).alias("w"))
    n = F.explode(F.sequence(F.lit(1), F.least(F.lit(3), F.size("w")))).alias("n")
    return w.where(F.size("w") > 0).select("item_id", "w", n).select(F.array_join(F.slice("w", F.lit(1), F.col("n")), " ").alias("phrase"), (F.col("item_id") % 5).cast("string").alias("label"))


HITS = r"""words AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
grams AS (SELECT doc_id, array_to_string(list_slice(w, i, i + n - 1), ' ') AS phrase, min(i - 1) AS place FROM words, generate_series(1, 3) g(n), unnest(range(1, len(w) - n + 2)) AS u(i) GROUP BY 1, 2),
hits AS (SELECT doc_id, phrase, label, n_words, place FROM grams JOIN dictionary USING (phrase))"""


@query(with_(DICTIONARY, HITS) + "SELECT doc_id, phrase, label, n_words, place::INT AS place FROM hits")
def dictionary_hits(spark, d):  # noqa: ANN001
    from paperloom.tables import table

    return phrases.phrase_hits(table(spark, d, "documents"), dictionary(spark, d), "doc_id")


@query(with_(DICTIONARY, HITS) + "SELECT doc_id, phrase, label FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n_words DESC, length(phrase) DESC, place, phrase, label) AS r FROM hits) WHERE r = 1")
def dictionary_longest(spark, d):  # noqa: ANN001
    return phrases.choose_label(dictionary_hits(spark, d), "doc_id", "longest").select("doc_id", "phrase", "label")
