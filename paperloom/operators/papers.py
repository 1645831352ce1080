"""Selecting, judging and completing papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.phrases import Phrases, once
from paperloom.functions.text import OVERLAP_STOP_WORDS, english_or_other, hashed, jaccard, keywords, normalize_title, tokens
from paperloom.tables import landed

# Least relevance by expansion and hop.
HOP_THRESHOLDS = {"narrow": (0.4, 0.5, 0.6), "foundations": (0.2, 0.3, 0.4), "wide": (0.1, 0.15, 0.2)}
# Scores of judged tiers.
TIER_SCORES = {"ESSENTIAL": 0.95, "HIGH": 0.75, "MEDIUM": 0.50, "LOW": 0.25, "NONE": 0.05}


def groups_of(text: Column, rules: dict[str, list[str]]) -> Column:
    """Names of the rule groups one of whose words the text has."""
    padded = F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))
    return F.filter(F.array(*(F.when(F.exists(F.array(*map(F.lit, words)), lambda w: padded.contains(w)), F.lit(name)) for name, words in rules.items())), lambda g: g.isNotNull())


def domain_conflict(query: Column, title: Column, families: list[dict[str, list[str]]]) -> Column:
    """Whether query and title both fall into groups of some family and share none."""
    out = F.lit(False)
    for rules in families:
        a, b = groups_of(query, rules), groups_of(title, rules)
        out = out | ((F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b))
    return out


def hop_filter(papers: DataFrame, expansion: str) -> DataFrame:
    """Papers at their hop's relevance; 'foundations' lifts papers above 1000 citations to just over it."""
    t = HOP_THRESHOLDS.get(expansion, HOP_THRESHOLDS["foundations"])
    least = F.when(F.col("hop") == 0, t[0]).when(F.col("hop") == 1, t[1]).when(F.col("hop") == 2, t[2]).otherwise(0.4)
    score = F.when(F.col("cited_by_count") > 1000, F.greatest("relevance", least + 0.1)).otherwise(F.col("relevance")) if expansion == "foundations" else F.col("relevance")
    return papers.withColumn("relevance", score).where(F.col("relevance") >= least)


def prior_art(candidates: DataFrame, known: DataFrame, stop: list[str], most: float = 0.6) -> DataFrame:
    """Candidates (target_id, work_id, target_title, title, abstract) not known for the target, with an abstract and few content words in common."""
    words = lambda t: F.array_distinct(F.filter(tokens(t), lambda w: ~F.array_contains(F.array(*map(F.lit, stop)), w)))
    fresh = candidates.where("abstract IS NOT NULL AND abstract != ''").join(known.select("target_id", "work_id"), ["target_id", "work_id"], "left_anti")
    return fresh.withColumn("overlap", jaccard(words(F.col("target_title")), words(F.col("title")))).where(F.col("overlap") <= most).dropDuplicates(["target_id", "work_id"])


def landmark_sources(found: DataFrame, present: DataFrame, before: int, least_cites: int = 30) -> DataFrame:
    """Found works with a new title, enough citations, an earlier year and a field in common. ``found``: node_id, work_id, title, year, cited_by_count, fields, wanted."""
    old = found.where((F.col("cited_by_count") >= least_cites) & (F.col("year") < before) & F.arrays_overlap("fields", "wanted")).withColumn("_t", F.lower("title"))
    return old.join(present.select("node_id", F.lower("title").alias("_t")).distinct(), ["node_id", "_t"], "left_anti").drop("_t")


# What thanks and notes that stand in place of an abstract say, and words of funding and of content.
THANKS = (
    "referees for help", "the authors thank", "we thank the", "we are grateful", "supported by the", "funded by the", "grant from the", "financial support from", "this work was supported",
    "this research was supported", "this study was funded", "acknowledges support from", "acknowledges funding from", "revision of work originally", "study commission",
)
FUNDING_WORDS = (
    "thank", "thanks", "grateful", "supported", "funded", "grant", "funding", "support", "commission", "foundation", "acknowledge", "acknowledged", "acknowledges", "referee", "referees", "reviewer",
)
CONTENT_WORDS = (
    "we", "this", "paper", "study", "show", "propose", "present", "method", "approach", "results", "demonstrate", "find", "analyze", "analysis", "model", "data", "evidence", "effect", "impact",
)


def abstract_validity(title: Column, abstract: Column, expected: str = "en", least: int = 50, recall: float = 0.15) -> Column:
    """(valid, reason) of an abstract: there and long enough, no thanks, not mostly about funding, in the language, about the title.

    The last is asked of titles of three words or more that tell of a topic: ``recall`` of them have to
    be in the abstract. Give ``decomposed`` columns where accents of the two sides may be coded differently.
    """
    low = F.lower(F.coalesce(abstract, F.lit("")))
    told = lambda ok, why: F.struct(F.lit(ok).alias("valid"), F.lit(why).alias("reason"))
    among = lambda words, own: F.size(F.array_intersect(words, F.array(*map(F.lit, own))))
    funding = once(F.array_distinct(tokens(abstract)), lambda words: (among(words, FUNDING_WORDS) >= 3) & (among(words, CONTENT_WORDS) <= 2))
    split = lambda text: F.array_distinct(F.split(normalize_title(text), " "))
    topic = F.array_except(F.array_remove(split(title), ""), F.array(*map(F.lit, OVERLAP_STOP_WORDS)))
    apart = once(topic, lambda words: (F.size(words) >= 3) & (F.size(F.array_intersect(words, split(abstract))) < recall * F.size(words)))
    return (
        F.when(low == "", told(False, "missing"))
        .when(F.length(F.regexp_replace(abstract, r"^[\x09-\x0D ]+|[\x09-\x0D ]+$", "")) < least, told(False, "too short"))
        .when(F.size(Phrases([("thanks", THANKS)]).found(abstract)) > 0, told(False, "acknowledgments"))
        .when(funding, told(False, "mostly about funding"))
        .when((english_or_other(abstract) == "other") & F.lit(expected == "en"), told(False, "language"))
        .when(apart, told(False, "low title overlap"))
        .otherwise(told(True, "valid"))
    )


def candidate_pool(found: DataFrame, most: int = 3000) -> DataFrame:
    """(query_id, work_id, pool_score, provenance): works by the sum of their scores and log citations; the best ``most`` of a query.

    ``found``: query_id, work_id, method, score, cited_by_count; a row for each way a work was found.
    """
    g = found.groupBy("query_id", "work_id").agg(F.sum("score").alias("_s"), F.max(F.coalesce("cited_by_count", F.lit(0))).alias("_c"), F.sort_array(F.collect_list(F.struct("method", "score"))).alias("provenance"))
    g = g.withColumn("pool_score", F.col("_s") + F.log10(F.col("_c") + F.lit(1.0)) / 5)
    order = Window.partitionBy("query_id").orderBy(F.desc("pool_score"), "work_id")
    return g.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).select("query_id", "work_id", "pool_score", "provenance")


def seed_selection(candidates: DataFrame, gate: float = 0.75) -> DataFrame:
    """(query_id, work_id, tier): one seed a query.

    ``candidates``: query_id, work_id, relevance, cited_by_count, overlap (keywords with the query).
    First choice are works at the gate with an overlap, by 0.6 relevance + 0.4 log-citation ratio;
    then any work with an overlap, by overlap and citations; then the most cited one.
    """
    w = Window.partitionBy("query_id")
    ratio = F.log1p(F.col("cited_by_count").cast("double")) / F.greatest(F.max(F.log1p(F.col("cited_by_count").cast("double"))).over(w), F.lit(1e-9))
    tier = F.when((F.col("relevance") >= gate) & (F.col("overlap") > 0), 0).when(F.col("overlap") > 0, 1).otherwise(2)
    rows = candidates.withColumn("tier", tier).withColumn("_v", F.when(F.col("tier") == 0, F.round(0.6 * F.col("relevance") + 0.4 * ratio, 9)).when(F.col("tier") == 1, F.col("overlap")).otherwise(0.0))
    best = w.orderBy("tier", F.desc("_v"), F.desc("cited_by_count"), "work_id")
    return rows.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("query_id", "work_id", "tier")


ROLES = ("intersection", "topic", "domain")


def seed_variants(asked: DataFrame) -> DataFrame:
    """(query_id, role, scope, variant): what to search seeds with, a row for each role.

    ``asked``: query_id, query, topic, domain, scope, intent. Queries of an intersection, or across
    domains, that have a domain get three roles: topic and domain together, and each of them, alone if
    the intent is cross_domain. Others get the role ``single`` with the query as it stands.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    several = ((F.col("scope") == "intersection") | (F.col("intent") == "cross_domain")) & (text("domain") != "")
    both, bare = F.concat_ws(" ", text("topic"), text("domain")), F.coalesce(F.col("intent") == "cross_domain", F.lit(False))
    roles = F.array(
        F.struct(F.lit(ROLES[0]).alias("role"), F.lit("intersection").alias("scope"), both.alias("variant")),
        F.struct(F.lit(ROLES[1]).alias("role"), F.lit("topic_focused").alias("scope"), F.when(bare, text("topic")).otherwise(both).alias("variant")),
        F.struct(F.lit(ROLES[2]).alias("role"), F.lit("domain_focused").alias("scope"), F.when(bare, text("domain")).otherwise(both).alias("variant")),
    )
    single = F.array(F.struct(F.lit("single").alias("role"), F.col("scope"), text("query").alias("variant")))
    return asked.select("query_id", F.explode(F.when(F.coalesce(several, F.lit(False)), roles).otherwise(single)).alias("v")).select("query_id", "v.*")


def multi_seed_select(candidates: DataFrame, most: int = 3, gate: float = 0.75) -> DataFrame:
    """(query_id, pick, role, work_id): the best seed of each role by ``seed_selection``, a work once a query, ``most`` at most.

    ``candidates``: query_id, role, work_id, relevance, cited_by_count, overlap, the last two by the role's variant.
    """
    keyed = candidates.select(F.struct("query_id", "role").alias("query_id"), "work_id", "relevance", "cited_by_count", "overlap")
    place = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role"))
    seeds = seed_selection(keyed, gate).select("query_id.query_id", "query_id.role", "work_id").withColumn("_p", place)
    first = seeds.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "work_id").orderBy("_p"))).where("_r = 1")
    order = Window.partitionBy("query_id").orderBy("_p")
    return first.withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= most).select("query_id", "pick", "role", "work_id")


def set_pairs(sets: DataFrame, value: str) -> DataFrame:
    """(set_id, a, b, value_a, value_b): pairs within small sets."""
    a = sets.select("set_id", F.col("work_id").alias("a"), F.col(value).alias(f"{value}_a"))
    b = sets.select("set_id", F.col("work_id").alias("b"), F.col(value).alias(f"{value}_b"))
    return a.join(b, "set_id").where("a < b")


def direct_citations(sets: DataFrame, edges: DataFrame) -> DataFrame:
    """(set_id, from_id, to_id): citations within a set."""
    half = edges.join(sets.select("set_id", F.col("work_id").alias("from_id")), "from_id")
    return half.join(sets.select("set_id", F.col("work_id").alias("to_id")), ["set_id", "to_id"], "left_semi").select("set_id", "from_id", "to_id").distinct()


def backfill(works: DataFrame, other: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Missing fields from another source's row of the same key."""
    o = other.where(F.col(key).isNotNull()).groupBy(key).agg(*(F.min(c).alias(f"_{c}") for c in fields))
    return works.join(o, key, "left").select(*[F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_{c}")).alias(c) if c in fields else F.col(c) for c in works.columns])


def query_variants(asked: DataFrame) -> DataFrame:
    """(query_id, variant): every topic term with every domain term, once whatever the case. ``asked``: query_id, topics, domains."""
    pairs = asked.select("query_id", F.explode("topics").alias("t"), "domains").select("query_id", "t", F.explode("domains").alias("d"))
    v = pairs.select("query_id", F.concat_ws(" ", "t", "d").alias("variant"))
    return v.groupBy("query_id", F.lower("variant").alias("_k")).agg(F.min("variant").alias("variant")).drop("_k")


def metrics(text: Column, patterns: dict[str, tuple[str, str]]) -> Column:
    """[(metric, value, unit)] of the first match of each pattern, whose first group is the value."""
    found = [F.struct(F.lit(name).alias("metric"), F.regexp_extract(text, p, 1).alias("value"), F.lit(unit).alias("unit")) for name, (p, unit) in patterns.items()]
    return F.filter(F.array(*found), lambda m: m["value"] != "")


def quota_selection(works: DataFrame, total: int) -> DataFrame:
    """``total`` works a map by class: a quarter citing, a quarter cited, a fifth at hop two, the rest by score."""
    cls = F.when(F.col("relationship") == "cites_seed", 0).when(F.col("relationship") == "cited_by_seed", 1).when(F.col("hop") == 2, 2).otherwise(3)
    inside = F.row_number().over(Window.partitionBy("map_id", "_k").orderBy(F.desc("score"), "work_id"))
    quota = F.when(F.col("_k") == 0, total // 4).when(F.col("_k") == 1, total // 4).when(F.col("_k") == 2, total // 5).otherwise(0)
    rows = works.withColumn("_k", cls).withColumn("_in", (inside <= quota).cast("int"))
    order = Window.partitionBy("map_id").orderBy(F.desc("_in"), F.desc("score"), "work_id")
    return rows.withColumn("_o", F.row_number().over(order)).where(F.col("_o") <= total).select(*works.columns)


# Title patterns of reviews.
REVIEW_TITLES = ["survey", "review", "overview", "tutorial", "primer"]


def bad_metadata(works: DataFrame, as_of: int) -> DataFrame:
    """Works without the faults: no title or year, a year to come, or this year's without a citation."""
    cites = F.coalesce("cited_by_count", F.lit(0))
    return works.where((F.coalesce("title", F.lit("")) != "") & F.col("year").isNotNull() & (F.col("year") <= as_of) & ~((F.col("year") >= as_of) & (cites == 0)))


def review_override(title: Column, paper_type: Column) -> Column:
    """'review' where the title says so, else the given type."""
    low = F.lower(F.coalesce(title, F.lit("")))
    return F.when(F.exists(F.array(*map(F.lit, REVIEW_TITLES)), lambda p: low.contains(p)), "review").otherwise(paper_type)


def suspicious_citations(works: DataFrame, patterns: list[str]) -> DataFrame:
    """Works with 10,000 citations or more that are recent beyond belief or carry a generic title."""
    low = F.lower(F.coalesce("title", F.lit("")))
    generic = F.exists(F.array(*map(F.lit, patterns)), lambda p: low.contains(p))
    return works.where((F.col("cited_by_count") >= 10_000) & (((F.col("year") >= 2018) & (F.col("cited_by_count") > 30_000)) | generic))


def cross_domain(edges: DataFrame, works: DataFrame, least: float = 0.05) -> DataFrame:
    """Edges (from_id, to_id) between works whose titles or abstracts share enough words.

    Texts are parted once a work; what is exchanged for an edge are the words of both as 64-bit hashes.
    """
    worded = landed(works.select("work_id", hashed(F.array_distinct(tokens(F.col("title")))).alias("_t"), hashed(F.array_distinct(tokens(F.col("abstract")))).alias("_x")))
    side = lambda key, s: worded.select(F.col("work_id").alias(key), F.col("_t").alias(f"_t{s}"), F.col("_x").alias(f"_x{s}"))
    pairs = edges.join(side("to_id", "b"), "to_id").join(side("from_id", "a"), "from_id")
    return pairs.where((jaccard(F.col("_ta"), F.col("_tb")) >= least) | (jaccard(F.col("_xa"), F.col("_xb")) >= least)).select("from_id", "to_id")


def grounding_consistency(texts: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, share, orphans, unused): ids that a text cites against the ids it was given. ``texts``: doc_id, text, given."""
    cited = F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)))
    t = texts.withColumn("_c", cited)
    known = F.size(F.array_intersect("_c", "given"))
    return t.select("doc_id", F.when(F.size("_c") > 0, known / F.size("_c")).otherwise(0.0).alias("share"), F.size(F.array_except("_c", "given")).alias("orphans"), F.size(F.array_except("given", "_c")).alias("unused"))


def title_seed(candidates: DataFrame) -> DataFrame:
    """(query_id, work_id): the work whose title fits a query best; a near-equal title wins by citations."""
    w = Window.partitionBy("query_id")
    logc = F.log1p(F.col("cited_by_count").cast("double"))
    ratio = logc / F.greatest(F.max(logc).over(w), F.lit(1e-9))
    rows = candidates.withColumn("_v", F.round(F.when(F.col("similarity") > 0.85, 1 + logc).otherwise(0.6 * F.col("similarity") + 0.4 * ratio), 9))
    return rows.groupBy("query_id").agg(F.max_by("work_id", F.struct("_v", -F.col("work_id"))).alias("work_id"))


def topic_clusters(works: DataFrame, by: str, least: int = 2, k: int = 5) -> DataFrame:
    """(by, topic, n): the ``k`` largest topics of at least ``least`` works."""
    n = works.groupBy(by, "topic").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return n.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "topic"))).where(F.col("_r") <= k).drop("_r")


def siblings(nodes: DataFrame, used: DataFrame, k: int = 10) -> DataFrame:
    """(map_id, work_id): the most cited works of a map that are not used yet, one a lower-case title, at most ``k``."""
    rest = nodes.join(used.select("map_id", "work_id"), ["map_id", "work_id"], "left_anti").withColumn("_t", F.lower("title"))
    one = rest.withColumn("_r", F.row_number().over(Window.partitionBy("map_id", "_t").orderBy(F.desc("cited_by_count"), "work_id"))).where("_r = 1")
    return one.withColumn("_o", F.row_number().over(Window.partitionBy("map_id").orderBy(F.desc("cited_by_count"), "work_id"))).where(F.col("_o") <= k).select("map_id", "work_id")


def topic_names(ids: DataFrame, names: DataFrame, works: DataFrame) -> DataFrame:
    """(cluster_id, name): the topic's name, else the most frequent topic of the cluster's works, else the id."""
    n = works.groupBy("cluster_id", "topic").agg(F.count(F.lit(1)).alias("_n"))
    major = n.groupBy("cluster_id").agg(F.max_by("topic", F.struct("_n", "topic")).alias("_major"))
    return ids.join(names, "cluster_id", "left").join(major, "cluster_id", "left").select("cluster_id", F.coalesce("name", "_major", "cluster_id").alias("name"))


def negated_share(statements: DataFrame, pattern: str) -> DataFrame:
    """(set_id, share, mostly_negated) of statements that match a pattern of negation."""
    g = statements.groupBy("set_id").agg(F.avg(F.col("text").rlike(pattern).cast("double")).alias("share"))
    return g.withColumn("mostly_negated", F.col("share") > 0.5)


def concept_multiplier(concepts: Column, wanted: Column) -> Column:
    """0.85 + 0.15 x the share of wanted concepts that are there; 0.5 without data."""
    return F.when((F.size(wanted) == 0) | concepts.isNull(), 0.5).otherwise(0.85 + 0.15 * F.size(F.array_intersect(concepts, wanted)) / F.size(F.array_distinct(wanted)))


def drilldown_query(label: Column, query: Column, least: float = 0.3) -> Column:
    """A label as a query, with the query appended if they share few words."""
    a, b = keywords(label), keywords(query)
    few = F.size(F.array_intersect(a, b)) / F.greatest(F.size(b), F.lit(1)) < least
    return F.when(few, F.concat_ws(" ", label, query)).otherwise(label)
