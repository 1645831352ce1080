"""Putting results together: previews, limits, scope scores, methods, dimensions and built maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.phrases import Phrases, once
from paperloom.functions.scores import term_scores
from paperloom.functions.text import hashed
from paperloom.operators import graph
from paperloom.tables import landed

PREVIEW = ("work_id", "title", "year", "cited_by_count", "topic", "subfield", "doi", "venue", "authors", "is_open_access")

#: Results by depth.
DEPTH = {"high_level": 15, "comprehensive": 50}

#: Methods and the terms that tell of them.
METHODS = {
    "neural_network": (
        "lstm", "rnn", "recurrent", "neural", "backpropagation", "backprop", "perceptron", "deep learning", "cnn", "convolutional", "transformer", "attention", "encoder", "decoder",
        "activation", "feedforward", "short-term memory", "long short", "hidden layer", "dropout", "batch norm", "relu", "sigmoid", "softmax", "multilayer", "rprop", "adaptive learning", "oscillator",
    ),
    "ensemble_tree": (
        "random forest", "decision tree", "bagging", "boosting", "gradient boosting", "xgboost", "adaboost", "cart", "gini", "tree-based", "leaf node", "split criterion", "feature importance",
        "classification tree", "regression tree",
    ),
    "kernel_svm": ("svm", "support vector", "kernel", "margin", "hyperplane", "rbf", "polynomial kernel", "slack variable", "hinge loss", "linear kernel"),
    "graph_network": ("graph neural", "gnn", "node embedding", "graph embedding", "network embedding", "node2vec", "deepwalk", "graph convolution", "message passing", "adjacency"),
    "optimization": ("gradient descent", "sgd", "adam", "momentum", "learning rate", "convergence", "stochastic optimization", "adagrad", "rmsprop"),
    "bayesian": ("bayesian", "posterior", "prior", "likelihood", "mcmc", "variational", "probabilistic", "inference", "gibbs", "metropolis"),
}

#: Words that say nothing in the name of a dimension, and words that mean much the same there.
DIMENSION_STOP = (
    "and", "the", "of", "in", "for", "a", "an", "vs", "with", "to", "on", "by", "is", "are", "it", "its", "this", "that", "each", "both", "using", "uses", "more", "less", "over", "than",
)
DIMENSION_KIN = (
    ("connectivity", "feature", "reuse", "mechanism", "flow", "gradient"),
    ("architecture", "network", "extraction", "design", "structure"),
    ("task", "scope", "capability", "focus", "orientation"),
    ("representational", "power", "capacity", "expressiveness"),
)


def project_previews(works: DataFrame) -> DataFrame:
    """The columns that a list of results shows, as far as ``works`` has them; a scan reads no others."""
    return works.select(*[c for c in PREVIEW if c in works.columns])


def upsert_graph_nodes(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Merge by work_id (unique on either side): the stored value wins where there is one, citations by their maximum."""
    rest = [c for c in stored.columns if c not in ("work_id", "cited_by_count")]
    most = F.greatest(F.coalesce("s.cited_by_count", F.lit(0)), F.coalesce("n.cited_by_count", F.lit(0))).alias("cited_by_count")
    joined = stored.alias("s").join(new.alias("n"), "work_id", "full_outer")
    return joined.select("work_id", most, *(F.coalesce(f"s.{c}", f"n.{c}").alias(c) for c in rest)).select(*stored.columns)


def depth_limit(ranked: DataFrame, depth: str, key: str = "query_id") -> DataFrame:
    """The first results of each ``key`` by ``rank``: 15 for a high-level view, else 50."""
    w = Window.partitionBy(key).orderBy("rank")
    return ranked.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= DEPTH.get(depth, DEPTH["comprehensive"])).drop("_r")


def scope_score(text: Column, topic: Column, domain: Column, aspect: Column, scope: str) -> Column:
    """How well a text meets a query of topic, domain and aspect terms (arrays; an empty domain or aspect is met by all)."""
    return scope_scores(text, topic, domain, aspect, (scope,))[0]["score"]


def scope_scores(text: Column, topic: Column, domain: Column, aspect: Column, scopes: tuple[str, ...]) -> Column:
    """(scope, score) of a text for each of ``scopes``, as an array; the text is read once."""
    own = lambda s: F.array(*(F.struct(F.lit(scope).alias("scope"), _scope_score(s[0], F.when(F.size(domain) > 0, s[1]).otherwise(1.0), F.when(F.size(aspect) > 0, s[2]).otherwise(1.0), scope).alias("score")) for scope in scopes))
    return once(term_scores(text, [topic, domain, aspect]), own)


def _scope_score(t: Column, d: Column, a: Column, scope: str) -> Column:
    if scope == "intersection":
        return t * d * (0.5 + 0.5 * a)
    if scope in ("topic_focused", "domain_focused"):
        near, far = (t, d) if scope == "topic_focused" else (d, t)
        return near * 0.8 + far * 0.2
    return (t + d) / 2


def scope_filter(works: DataFrame, topic: Column, domain: Column, aspect: Column, scope: str, least: float = 0.2) -> DataFrame:
    """Works whose scope score is ``least`` or more, with the score; order by it and work_id to list them."""
    return scopes_filter(works, topic, domain, aspect, (scope,), least).drop("scope")


def scopes_filter(works: DataFrame, topic: Column, domain: Column, aspect: Column, scopes: tuple[str, ...], least: float = 0.2) -> DataFrame:
    """A row (scope, scope_score) for each scope by which a work has ``least`` or more; each work is read once for all of them."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")))
    scored = works.withColumn("_s", F.explode(F.filter(scope_scores(text, topic, domain, aspect, scopes), lambda s: s["score"] >= least)))
    return scored.select(*works.columns, F.col("_s.scope").alias("scope"), F.col("_s.score").alias("scope_score"))


def method_of(text: Column) -> Column:
    """The method whose longest term in the text is the longest of all; null without any. Ties by name."""
    return Phrases(METHODS.items()).longest(text)


def method_mismatch(a: Column, b: Column) -> Column:
    """Whether two methods are both known and differ."""
    return F.coalesce(a != b, F.lit(False))


def dimension_words(text: Column) -> Column:
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), F.lit(0)))
    return F.array_except(words, F.array(*map(F.lit, DIMENSION_STOP)))


def dimension_overlaps(edges: DataFrame, works: DataFrame) -> DataFrame:
    """(from_id, to_id, overlap): whether two linked works, taken as dimensions named by their titles, say the same.

    Texts are parted once a work; what is exchanged for an edge are the words of names and, as 64-bit hashes, of texts.
    """
    worded = landed(works.select("work_id", dimension_words(F.col("title")).alias("_n"), hashed(dimension_words(F.col("abstract"))).alias("_x")))
    side = lambda key, s: worded.select(F.col("work_id").alias(key), F.col("_n").alias(f"_n{s}"), F.col("_x").alias(f"_x{s}"))
    pairs = edges.join(side("to_id", "b"), "to_id").join(side("from_id", "a"), "from_id")
    return pairs.select("from_id", "to_id", dimensions_overlap(*map(F.col, ("_na", "_nb", "_xa", "_xb"))).alias("overlap"))


def dimensions_overlap(a: Column, b: Column, body_a: Column, body_b: Column) -> Column:
    """Whether two dimensions say the same: by the words of their names (Jaccard 0.4), by kin words, or by those of their texts (0.5; words or hashes)."""
    alike = lambda x, y: F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(0.0)
    kin = F.lit(False)
    for words in DIMENSION_KIN:
        x, y = (F.array_intersect(side, F.array(*map(F.lit, words))) for side in (a, b))
        kin = kin | ((F.size(x) > 0) & (F.size(y) > 0) & (F.size(F.array_union(x, y)) >= 2))
    near = 2 * F.least(F.size(body_a), F.size(body_b)) >= F.greatest(F.size(body_a), F.size(body_b))  # else half of all words can't be shared
    return (alike(a, b) >= 0.4) | kin | (near & (alike(body_a, body_b) >= 0.5))


def map_build(works: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes of built maps: (map_id, work_id, group, connector_score, group_share).

    ``works`` has map_id, work_id, topic and subfield; edges count where both ends lie in one map, as
    often as they are given once. The connector score is the degree; the group is the topic or the
    subfield, as ``default_grouping`` chooses for the map; group_share is the group's part of its map.
    """
    nodes = works.select("map_id", "work_id", "topic", "subfield")
    end = lambda name: nodes.select("map_id", F.col("work_id").alias(name))
    inside = edges.select("from_id", "to_id").where("from_id != to_id").distinct().join(end("from_id"), "from_id").join(end("to_id"), ["map_id", "to_id"])
    degree = inside.select("map_id", F.explode(F.array("from_id", "to_id")).alias("work_id")).groupBy("map_id", "work_id").agg(F.count(F.lit(1)).alias("_degree"))
    chosen = nodes.join(graph.default_grouping(nodes), "map_id").withColumn("group", F.when(F.col("grouping") == "topic", F.col("topic")).otherwise(F.col("subfield")))
    sizes = chosen.groupBy("map_id", F.col("group").alias("_group")).agg(F.count(F.lit(1)).alias("_n"))
    shares = sizes.join(sizes.groupBy("map_id").agg(F.sum("_n").alias("_all")), "map_id").select(F.col("map_id").alias("_map"), "_group", (F.col("_n") / F.col("_all")).alias("group_share"))
    placed = chosen.join(degree, ["map_id", "work_id"], "left").join(shares, (F.col("map_id") == F.col("_map")) & F.col("group").eqNullSafe(F.col("_group")))
    return placed.select("map_id", "work_id", "group", F.coalesce("_degree", F.lit(0)).cast("double").alias("connector_score"), "group_share")
