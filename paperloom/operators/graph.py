"""Citation graphs as two DataFrames: nodes (work_id, ...) and edges (from_id cites to_id)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import SPACED
from paperloom.operators.similar import similar_sets
from paperloom.tables import stable


def normalize_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct nodes, edges without loops, repeats or dangling ends, and one row of what was dropped."""
    own = nodes.select("work_id").distinct()
    kept = edges.where("from_id != to_id").distinct()
    kept = kept.join(own, kept["from_id"] == own["work_id"], "left_semi")
    ends = own.select(F.col("work_id").alias("_w"))
    kept = kept.join(ends, kept["to_id"] == ends["_w"], "left_semi")
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    report = n(nodes, "nodes_in").join(n(own, "nodes")).join(n(edges, "edges_in")).join(n(kept, "edges"))  # single rows
    return own, kept, report


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(work_id, in_degree, out_degree, degree), nodes without edges included."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("from_id").alias("w"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("to_id").alias("w"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    sums = ends.groupBy(F.col("e.w").alias("_w")).agg(F.sum("e.i").alias("_i"), F.sum("e.o").alias("_o"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return nodes.join(sums, F.col("work_id") == F.col("_w"), "left").select("work_id", zero("_i").alias("in_degree"), zero("_o").alias("out_degree"), (zero("_i") + zero("_o")).alias("degree"))


def bridges_and_isolated(degree: DataFrame, least_in: int = 3, least_out: int = 2) -> DataFrame:
    """(work_id, kind): cited and citing works as 'bridge', unlinked ones as 'isolated'."""
    kind = F.when((F.col("in_degree") >= least_in) & (F.col("out_degree") >= least_out), "bridge").when(F.col("degree") == 0, "isolated")
    return degree.select("work_id", kind.alias("kind")).where("kind IS NOT NULL")


def neighbours(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(seed_id, work_id, role): works that cite a seed ('cites_seed') and that it cites ('cited_by_seed')."""
    s = seeds.select("seed_id")
    citing = edges.join(s, F.col("to_id") == F.col("seed_id")).select("seed_id", F.col("from_id").alias("work_id"), F.lit("cites_seed").alias("role"))
    cited = edges.join(s, F.col("from_id") == F.col("seed_id")).select("seed_id", F.col("to_id").alias("work_id"), F.lit("cited_by_seed").alias("role"))
    return citing.union(cited)


def one_hop_graph(seeds: DataFrame, edges: DataFrame, works: DataFrame, least_cites: int = 0) -> DataFrame:
    """Seeds and neighbours with one role each: seed, then cites_seed, then cited_by_seed."""
    rows = seeds.select("seed_id", F.col("seed_id").alias("work_id"), F.lit("seed").alias("role")).union(neighbours(seeds, edges))
    order = F.when(F.col("role") == "seed", 0).when(F.col("role") == "cites_seed", 1).otherwise(2)
    first = rows.groupBy("seed_id", "work_id").agg(F.min_by("role", order).alias("role"))
    return first.join(works.select("work_id", "cited_by_count"), "work_id").where((F.col("cited_by_count") >= least_cites) | (F.col("role") == "seed")).select("seed_id", "work_id", "role", "cited_by_count")


def expand_graph(seeds: DataFrame, edges: DataFrame, works: DataFrame, hops: int = 2, fetch: tuple[int, ...] = (80, 30, 30), expand: int = 8, thresholds: tuple[float, ...] = (0.4, 0.3, 0.2)) -> DataFrame:
    """(map_id, work_id, hop): works reached from each map's seeds, the first hop seen kept.

    ``seeds``: map_id, work_id. Hop 1 takes up to ``fetch[0]`` neighbours a source in both directions,
    the most cited first; each further hop expands the best ``expand`` works of the last one whose
    relevance (``works.relevance``) reaches that hop's threshold. Works below a threshold stay in the
    result; they are only no sources. Lineage is cut after each hop.
    """
    both = edges.select(F.col("from_id").alias("_s"), F.col("to_id").alias("work_id")).union(edges.select(F.col("to_id").alias("_s"), F.col("from_id").alias("work_id"))).distinct()
    rank = works.select("work_id", "cited_by_count", "relevance")
    seen = stable(seeds.select("map_id", "work_id", F.lit(0).alias("hop")).distinct())
    frontier = seen.select("map_id", F.col("work_id").alias("_s"))
    for hop in range(1, hops + 1):
        found = frontier.join(both, "_s").join(rank, "work_id")
        best = Window.partitionBy("map_id", "_s").orderBy(F.desc("cited_by_count"), "work_id")
        taken = found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= fetch[hop - 1])
        new = taken.select("map_id", "work_id").distinct().join(seen, ["map_id", "work_id"], "left_anti").withColumn("hop", F.lit(hop))
        seen = stable(seen.union(new))
        if hop < hops:
            good = seen.where(F.col("hop") == hop).join(rank, "work_id").where(F.col("relevance") >= thresholds[hop - 1])
            order = Window.partitionBy("map_id").orderBy(F.desc("relevance"), F.desc("cited_by_count"), "work_id")
            frontier = good.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= expand).select("map_id", F.col("work_id").alias("_s"))
    return seen


def attach_enrichment(nodes: DataFrame, candidates: DataFrame, edges: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Works from outside a map's graph that may be sources of its next hop, and the edges that link them.

    ``nodes``: map_id, work_id; ``candidates``: map_id, work_id, relevance. Candidates of ``least`` relevance
    that are no nodes are looked up in ``edges``, both ways; those linked with a node of their map are
    sources (map_id, work_id, relevance), with the edges (map_id, from_id, to_id) found.
    """
    there = nodes.select("map_id", "work_id").distinct()
    able = candidates.where(F.col("relevance") >= least).select("map_id", "work_id", "relevance").join(there, ["map_id", "work_id"], "left_anti")
    able = able.groupBy("map_id", "work_id").agg(F.max("relevance").alias("relevance"))
    node = there.select(F.col("map_id").alias("_m"), F.col("work_id").alias("_n"))
    pairs = edges.select("from_id", "to_id").where("from_id <> to_id").distinct()
    ways = [("from_id", "to_id"), ("to_id", "from_id")]
    found = [able.join(pairs, F.col("work_id") == F.col(own)).join(node, (F.col("map_id") == F.col("_m")) & (F.col(other) == F.col("_n")), "left_semi").select("map_id", "work_id", "from_id", "to_id") for own, other in ways]
    linked = stable(found[0].union(found[1]).distinct())
    return able.join(linked.select("map_id", "work_id").distinct(), ["map_id", "work_id"], "left_semi"), linked.select("map_id", "from_id", "to_id").distinct()


def hop_scores(nodes: DataFrame, edges: DataFrame, citation_weight: float = 0.6, connectivity_weight: float = 0.4) -> DataFrame:
    """(map_id, work_id, hop, score): citations on a log scale and degree within the map, less beyond the first hop; the seed is infinite.

    ``nodes``: map_id, work_id, hop (0: seed), cited_by_count; ``edges``: map_id, from_id, to_id. An edge counts
    for each end that is a node. The degree is taken against the map's largest.
    """
    ends = edges.select("map_id", F.explode(F.array("from_id", "to_id")).alias("work_id")).groupBy("map_id", "work_id").agg(F.count(F.lit(1)).alias("_d"))
    rows = nodes.join(ends, ["map_id", "work_id"], "left").withColumn("_d", F.coalesce("_d", F.lit(0)))
    largest = F.greatest(F.max("_d").over(Window.partitionBy("map_id")), F.lit(1))
    cites = F.log1p(F.least(F.coalesce("cited_by_count", F.lit(0)), F.lit(50_000)).cast("double")) / math.log1p(50_000)
    far = F.when(F.col("hop") <= 1, 1.0).when(F.col("hop") == 2, 0.6).otherwise(0.5)
    score = F.when(F.col("hop") == 0, float("inf")).otherwise(far * (citation_weight * cites + connectivity_weight * F.col("_d") / largest))
    return rows.select("map_id", "work_id", "hop", score.alias("score"))


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(map_id, from_id, to_id): edges between works of one map."""
    a, b = nodes.select("map_id", F.col("work_id").alias("from_id")), nodes.select(F.col("map_id").alias("_m"), F.col("work_id").alias("_t"))
    half = edges.join(a, "from_id")
    return half.join(b, (half["to_id"] == b["_t"]) & (half["map_id"] == b["_m"]), "left_semi").select("map_id", "from_id", "to_id").distinct()


def co_citation(edges: DataFrame, least: int = 3, k: int = 15, block: int = 2000) -> DataFrame:
    """(work_id, other_id, shared, rank): works that the same works cite, at least ``least`` of them."""
    e = edges.select("from_id", "to_id").distinct()
    cited = e.groupBy("to_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select("to_id")  # fewer can't share as many
    met = pairs(e.join(cited, "to_id", "left_semi"), "from_id", "to_id", block).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least)
    return _both_ways(met, "shared", k)


def bibliographic_coupling(edges: DataFrame, percent: int = 20, k: int = 15, block: int = 2000) -> DataFrame:
    """(work_id, other_id, coupling, rank): the ``k`` works most alike in what they cite, from a Jaccard similarity of ``percent`` on.

    Works that cite the same are one list, so a crowd of them costs no pairs; different lists meet by
    their rarest references (``similar_sets``). Of a list's works only the first k + 1 can be among the
    best of another. What cites one reference is dealt to blocks of about ``block``.
    """
    e = edges.select("from_id", "to_id").distinct()
    lists = stable(e.groupBy("from_id").agg(F.sort_array(F.collect_list("to_id")).alias("refs")))
    classes = lists.groupBy("refs").agg(F.min("from_id").alias("list_id"), F.count(F.lit(1)).alias("_works"))
    classes = stable(classes)
    works = stable(lists.join(classes.select("refs", "list_id"), "refs").select("list_id", F.col("from_id").alias("work_id")))
    pairs = similar_sets(classes.select("list_id", "refs"), [], "list_id", "refs", percent, block=block).withColumn("coupling", F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both")))
    ways = F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y"))))
    both = pairs.select(ways.alias("_w"), "coupling").select(F.col("_w.x").alias("a"), F.col("_w.y").alias("b"), "coupling").union(classes.where("_works > 1").select(F.col("list_id").alias("a"), F.col("list_id").alias("b"), F.lit(1.0)))
    within = Window.partitionBy("list_id").orderBy("work_id")
    first = works.withColumn("_r", F.row_number().over(within)).where(F.col("_r") <= k + 1).select(F.col("list_id").alias("b"), F.col("work_id").alias("other_id"))
    best = Window.partitionBy("a").orderBy(F.desc("coupling"), "other_id")
    offered = both.join(first, "b").withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + 1).select("a", "other_id", "coupling")
    order = Window.partitionBy("work_id").orderBy(F.desc("coupling"), "other_id")
    own = works.join(offered, F.col("list_id") == F.col("a")).where("work_id <> other_id")
    return own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("work_id", "other_id", "coupling", "rank")


def pairs(rows: DataFrame, key: str, member: str, block: int) -> DataFrame:
    """(a, b), a < b: all pairs of members of each key, a row for each key that has both.

    Members of a key with more than ``block`` of them are dealt by hash to blocks, and each pair of
    blocks is joined on its own, so that one key is the work of many tasks. ``rows`` are distinct.
    """
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key, F.ceil(F.col("_n") / block).cast("int").alias("_blocks"))
    own = F.pmod(F.xxhash64(member), F.col("_blocks")).cast("int").alias("_own")
    dealt = rows.join(n, key).select(key, F.col(member).alias("a"), own, F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other"))
    dealt = dealt.select(key, F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), "a", "_own")
    other = dealt.select(key, "_i", "_j", F.col("a").alias("b"), F.col("_own").alias("_its"))
    return dealt.join(other, [key, "_i", "_j"]).where("a < b AND (_i = _j OR _own <> _its)").select("a", "b")


def _both_ways(pairs: DataFrame, value: str, k: int) -> DataFrame:
    both = pairs.select(F.col("a").alias("work_id"), F.col("b").alias("other_id"), value).union(pairs.select(F.col("b").alias("work_id"), F.col("a").alias("other_id"), value))
    order = Window.partitionBy("work_id").orderBy(F.desc(value), "other_id")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def shared_references(sets: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    """(set_id, ref_id, n): works outside a set that at least two of its works cite, the ``k`` most shared."""
    refs = edges.join(sets.select("set_id", F.col("work_id").alias("from_id")), "from_id").select("set_id", F.col("to_id").alias("ref_id"), "from_id").distinct()
    outside = refs.join(sets.select("set_id", F.col("work_id").alias("ref_id")), ["set_id", "ref_id"], "left_anti")
    n = outside.groupBy("set_id", "ref_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    order = Window.partitionBy("set_id").orderBy(F.desc("n"), "ref_id")
    return n.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def evolution_chain(sets: DataFrame, edges: DataFrame, works: DataFrame) -> DataFrame:
    """(set_id, chain): works by year, if each but the first cites an earlier one; else null."""
    order = Window.partitionBy("set_id").orderBy(F.coalesce("year", F.lit(9999)), "work_id")
    r = sets.join(works.select("work_id", "year", "title"), "work_id").withColumn("_r", F.row_number().over(order))
    a, b = r.select("set_id", F.col("work_id").alias("from_id"), F.col("_r").alias("_ra")), r.select(F.col("set_id").alias("_set"), F.col("work_id").alias("to_id"), F.col("_r").alias("_rb"))
    links = edges.join(a, "from_id").join(b, "to_id").where("set_id = _set AND _ra > _rb").groupBy("set_id", F.col("from_id").alias("work_id")).agg(F.lit(True).alias("_linked"))
    label = F.concat(F.when(F.length("title") > 60, F.concat(F.substring("title", 1, 57), F.lit("..."))).otherwise(F.col("title")), F.coalesce(F.concat(F.lit(" ("), F.col("year").cast("string"), F.lit(")")), F.lit("")))
    listed = r.join(links, ["set_id", "work_id"], "left").groupBy("set_id").agg(
        F.bool_and(F.coalesce("_linked", F.col("_r") == 1)).alias("_ok"), F.count(F.lit(1)).alias("_n"), F.sort_array(F.collect_list(F.struct("_r", label.alias("l")))).alias("_l")
    )
    return listed.select("set_id", F.when(F.col("_ok") & (F.col("_n") >= 2), F.array_join(F.transform("_l", lambda x: x["l"]), " -> ")).alias("chain"))


def connectivity(nodes: DataFrame, edges: DataFrame, least: float = 2.0) -> DataFrame:
    """One row: nodes, edges, edges per node, and whether that reaches ``least``."""
    n = nodes.agg(F.count(F.lit(1)).alias("n_nodes")).join(edges.agg(F.count(F.lit(1)).alias("n_edges")))
    per = F.col("n_edges") / F.greatest(F.col("n_nodes"), F.lit(1))
    return n.select("n_nodes", "n_edges", per.alias("edges_per_node"), (per >= least).alias("connected"))


def density_gate(works: DataFrame, degree: DataFrame, least: float = 0.2) -> DataFrame:
    """Works with enough links for their citations: degree / ln(cites + 2) and a least degree by citations."""
    floor = F.when(F.col("cited_by_count") > 50_000, 5).when(F.col("cited_by_count") > 10_000, 4).otherwise(3)
    both = works.join(degree.select("work_id", "degree"), "work_id")
    ratio = F.col("degree") / F.log1p(F.col("cited_by_count") + F.lit(1.0))
    return both.withColumn("density", ratio).where((ratio >= least) & (F.col("degree") >= floor))


def default_grouping(nodes: DataFrame, least_fields: int = 4, most_share: float = 0.8) -> DataFrame:
    """(map_id, grouping): by topic if a map has few subfields or one holds most of it, else by subfield."""
    n = nodes.groupBy("map_id", "subfield").agg(F.count(F.lit(1)).alias("_n"))
    per = n.groupBy("map_id").agg(F.count_if(F.col("subfield").isNotNull()).alias("_k"), (F.max("_n") / F.sum("_n")).alias("_share"))
    return per.select("map_id", F.when((F.col("_k") < least_fields) | (F.col("_share") >= most_share), "topic").otherwise("subfield").alias("grouping"))


def assign_labels(works: DataFrame, labels: DataFrame, least_words: int = 5) -> DataFrame:
    """(work_id, label): the label with most of its words in the title; two words if it has ``least_words``, else one.

    ``labels``: label, words (a bounded list). Ties go to the first label by name; no hit is 'Other'.
    """
    words = works.select("work_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("title"), F.lit(SPACED), F.lit(0)))).alias("word"))
    own = labels.select("label", F.size("words").alias("_k"), F.explode("words").alias("word"))
    hits = words.join(own, "word").groupBy("work_id", "label", "_k").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= F.when(F.col("_k") >= least_words, 2).otherwise(1))
    best = hits.withColumn("_r", F.row_number().over(Window.partitionBy("work_id").orderBy(F.desc("_n"), "label"))).where("_r = 1")
    return works.select("work_id").join(best.select("work_id", "label"), "work_id", "left").select("work_id", F.coalesce("label", F.lit("Other")).alias("label"))


# Words of titles that no subtopic is told by.
SUBTOPIC_STOP_WORDS = """
a an the of and for in on to with is are by from at as or that this its it be was were been being do does did has have had not but if
we our via using based towards toward
""".split()


def _title_keywords(title: Column) -> Column:
    words = F.array_distinct(F.regexp_extract_all(F.replace(F.lower(F.coalesce(title, F.lit(""))), F.lit("-"), F.lit(" ")), F.lit(SPACED), F.lit(0)))
    return F.array_except(words, F.array(*map(F.lit, SUBTOPIC_STOP_WORDS)))


def assign_subtopics(nodes: DataFrame, given: DataFrame, crowded: float = 0.2) -> DataFrame:
    """(map_id, work_id, subtopic): labels where they were given, else that of the subtopic whose keywords the title shares most.

    ``nodes``: map_id, work_id, title, one row each; ``given``: map_id, work_id, label. A subtopic's keywords are
    those of its label and of the titles that have it. A title of five keywords or more needs two of
    them, others one; where more than ``crowded`` of a map is left as 'Other', one is enough for all
    of those. Ties go to the first label by name. Titles that are null or have no keywords are 'Other'.
    """
    keys = ["map_id", "work_id"]
    words = nodes.select(*keys, _title_keywords(F.col("title")).alias("_w")).withColumn("_k", F.size("_w"))
    labelled = given.where("label IS NOT NULL AND label <> ''").groupBy(*keys).agg(F.min("label").alias("label"))
    own = words.join(labelled, keys).select("map_id", "label", F.explode("_w").alias("_x")).union(labelled.select("map_id", "label", F.explode(_title_keywords(F.col("label"))).alias("_x"))).distinct()
    rest = words.join(labelled, keys, "left_anti")
    hits = rest.select(*keys, "_k", F.explode("_w").alias("_x")).join(own, ["map_id", "_x"]).groupBy(*keys, "_k", "label").agg(F.count(F.lit(1)).alias("_n"))
    best = hits.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_n"), "label"))).where("_r = 1")
    all_rows = stable(words.select(*keys).join(labelled, keys, "left").join(best.select(*keys, F.col("label").alias("_found"), (F.col("_n") >= F.when(F.col("_k") >= 5, 2).otherwise(1)).alias("_enough")), keys, "left"))
    other = F.col("label").isNull() & ~F.coalesce("_enough", F.lit(False))
    maps = all_rows.groupBy("map_id").agg((F.count_if(other) > crowded * F.count(F.lit(1))).alias("_crowded"))
    found = F.when(F.col("_enough") | F.col("_crowded"), F.col("_found"))
    return all_rows.join(maps, "map_id").select(*keys, F.coalesce("label", found, F.lit("Other")).alias("subtopic"))


# Weights of relevance, links and temporal score by temporal preference.
SELECT_WEIGHTS = {"seminal": (0.35, 0.30, 0.35), "recent": (0.35, 0.35, 0.30), "all": (0.45, 0.35, 0.20)}


def greedy_select(candidates: DataFrame, edges: DataFrame, target: int, preference: str = "all", backbone: float = 0.6, floor: float = 0.0) -> DataFrame:
    """(map_id, work_id, pick): seeds, then the works that fit best to what is there, ``target`` a map.

    ``candidates``: map_id, work_id, relevance, temporal, is_seed, is_enrichment. Beside the seeds,
    each map's best 3 x ``target`` works by relevance and temporal score are looked at, with the edges
    among them. The first ``backbone`` share is not from enrichment. Then, up to three times, works
    without a link give way to the best linked ones, or go. Works below ``floor`` relevance are no choice.
    The choice is sequential within a map; maps are independent groups of bounded size.
    """
    order = Window.partitionBy("map_id", "is_seed").orderBy(F.desc(F.col("relevance") + F.col("temporal")), "work_id")
    pool = candidates.withColumn("_r", F.row_number().over(order)).where(F.col("is_seed") | ((F.col("_r") <= 3 * target) & (F.col("relevance") >= floor))).drop("_r")
    inner = induced(pool.select("map_id", "work_id"), edges)
    links = inner.select("map_id", F.col("from_id").alias("work_id"), F.col("to_id").alias("_o")).union(inner.select("map_id", F.col("to_id").alias("work_id"), F.col("from_id").alias("_o"))).distinct()
    near = links.groupBy("map_id", "work_id").agg(F.sort_array(F.collect_list("_o")).alias("near"))
    rows = pool.join(near, ["map_id", "work_id"], "left").withColumn("near", F.coalesce("near", F.array().cast("array<bigint>")))
    weights = SELECT_WEIGHTS[preference]

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        group = group.sort_values("work_id").reset_index(drop=True)
        ids, seed, extra = group["work_id"].tolist(), group["is_seed"].to_numpy(), group["is_enrichment"].to_numpy()
        place = {w: i for i, w in enumerate(ids)}
        linked = np.zeros((len(ids), len(ids)), dtype=bool)
        for i, others in enumerate(group["near"]):
            linked[i, [place[o] for o in others if o in place]] = True
        np.fill_diagonal(linked, False)
        own = weights[0] * group["relevance"].to_numpy() + weights[2] * group["temporal"].to_numpy()
        steps = np.array([0.0, 0.3, 0.6, 0.6, 0.8, 0.8, 0.8, 1.0])
        chosen = np.flatnonzero(seed).tolist()

        def best(allowed) -> int | None:  # noqa: ANN001
            if not allowed.any():
                return None
            link = steps[np.minimum(linked[:, chosen].sum(axis=1), 7)] if chosen else 0.5
            return int(np.argmax(np.where(allowed, own + weights[1] * link, -1.0)))

        left = ~seed
        for size, allowed in ((max(1, int(target * backbone)), ~extra), (target, np.ones(len(ids), dtype=bool))):
            while len(chosen) < size and (pick := best(left & allowed)) is not None:
                chosen.append(pick)
                left[pick] = False
        for _ in range(3):
            lonely = [i for i in chosen if not seed[i] and not linked[i, chosen].any()]
            for i in lonely:
                chosen.remove(i)
                swap = best(left & linked[:, chosen].any(axis=1)) if chosen else None
                if swap is not None:
                    chosen.append(swap)
                    left[swap] = False
            if not lonely:
                break
        return pd.DataFrame({"map_id": group["map_id"].iloc[0], "work_id": [ids[i] for i in chosen], "pick": range(1, len(chosen) + 1)})

    return rows.groupBy("map_id").applyInPandas(choose, "map_id long, work_id long, pick int")


def relationship(nodes: DataFrame, seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(map_id, work_id, relationship): seed, cites_seed, cited_by_seed or network."""
    s = seeds.select(F.col("map_id"), F.col("work_id").alias("_s"))
    citing = edges.join(s, F.col("to_id") == F.col("_s")).select("map_id", F.col("from_id").alias("work_id"), F.lit(1).alias("_k"))
    cited = edges.join(s, F.col("from_id") == F.col("_s")).select("map_id", F.col("to_id").alias("work_id"), F.lit(2).alias("_k"))
    kinds = s.select("map_id", F.col("_s").alias("work_id"), F.lit(0).alias("_k")).union(citing).union(cited).groupBy("map_id", "work_id").agg(F.min("_k").alias("_k"))
    name: Column = F.when(F.col("_k") == 0, "seed").when(F.col("_k") == 1, "cites_seed").when(F.col("_k") == 2, "cited_by_seed").otherwise("network")
    return nodes.select("map_id", "work_id").join(kinds, ["map_id", "work_id"], "left").select("map_id", "work_id", name.alias("relationship"))
