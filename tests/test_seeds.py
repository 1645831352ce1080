"""Several seeds, attached works and scores by hop on literal rows."""

import math

from paperloom.operators import graph, papers


def test_variants_and_seeds(spark):
    asked = [(1, "q one", "t", "d", "intersection", "single_topic"), (2, "q two", "t", "d", "broad", "cross_domain"), (3, "q three", "t", "", "intersection", "single_topic"), (4, "q four", "t", "d", "broad", None), (5, None, None, None, None, None)]
    rows = papers.seed_variants(spark.createDataFrame(asked, "query_id int, query string, topic string, domain string, scope string, intent string")).collect()
    assert sorted((r["query_id"], r["role"], r["variant"]) for r in rows) == [
        (1, "domain", "t d"), (1, "intersection", "t d"), (1, "topic", "t d"), (2, "domain", "d"), (2, "intersection", "t d"), (2, "topic", "t"), (3, "single", "q three"), (4, "single", "q four"), (5, "single", ""),
    ]
    found = [(1, "intersection", 10, 0.9, 5, 1.0), (1, "intersection", 11, 0.9, 900, 0.0), (1, "topic", 10, 0.9, 5, 1.0), (1, "domain", 12, 0.1, 5, 0.5), (2, "single", 13, 0.0, 1, 0.0), (2, "single", 14, 0.0, 2, 0.0)]
    candidates = spark.createDataFrame(found, "query_id int, role string, work_id int, relevance double, cited_by_count int, overlap double")
    picks = lambda most: sorted(map(tuple, papers.multi_seed_select(candidates, most).collect()))
    assert picks(3) == [(1, 1, "intersection", 10), (1, 2, "domain", 12), (2, 1, "single", 14)] and picks(1) == [(1, 1, "intersection", 10), (2, 1, "single", 14)]


def test_attached_works(spark):
    nodes = spark.createDataFrame([(1, 1), (1, 2), (2, 5)], "map_id int, work_id int")
    candidates = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.5), (1, 4, 0.9), (1, 6, 0.1), (2, 3, 0.9), (1, 3, 0.7), (1, 7, None)], "map_id int, work_id int, relevance double")
    edges = spark.createDataFrame([(3, 1), (3, 1), (2, 3), (4, 9), (6, 1), (3, 3), (5, 4), (7, 1)], "from_id int, to_id int")
    sources, linked = graph.attach_enrichment(nodes, candidates, edges, 0.5)
    assert sorted(map(tuple, sources.collect())) == [(1, 3, 0.7)] and sorted(map(tuple, linked.collect())) == [(1, 2, 3), (1, 3, 1)]


def test_hop_scores(spark):
    nodes = spark.createDataFrame([(1, 1, 0, 9), (1, 2, 1, 50_000), (1, 3, 2, 0), (1, 4, 3, None), (2, 1, 1, 90_000)], "map_id int, work_id int, hop int, cited_by_count int")
    edges = spark.createDataFrame([(1, 1, 2), (1, 3, 2), (1, 4, 99)], "map_id int, from_id int, to_id int")
    got = {(r["map_id"], r["work_id"]): r["score"] for r in graph.hop_scores(nodes, edges).collect()}
    assert got[1, 1] == math.inf and [round(got[k], 9) for k in ((1, 2), (1, 3), (1, 4), (2, 1))] == [1.0, 0.12, 0.1, 0.6]


def test_subtopics_in_three_passes(spark):
    titles = {1: "Deep Nets for Vision", 2: "Graph-nets", 3: "deep learning of very large language models", 4: "Nets deep in large vision models today", 5: "the of", 6: None, 7: "graph", 8: "Topic one x y z w"}
    nodes = spark.createDataFrame([(1, k, t) for k, t in titles.items()] + [(2, 1, "alpha"), (2, 2, "beta"), (2, 3, "alpha one two three four"), (2, 4, "alpha"), (2, 5, "alpha")], "map_id int, work_id int, title string")
    given = spark.createDataFrame([(1, 1, "Topic one"), (1, 2, "two"), (2, 1, "A"), (1, 2, ""), (1, 9, "two")], "map_id int, work_id int, label string")
    got = {(r["map_id"], r["work_id"]): r["subtopic"] for r in graph.assign_subtopics(nodes, given).collect()}
    # map 1: five of eight words are needed twice; half of it would be Other, so one word is enough for those
    assert got == {(1, 1): "Topic one", (1, 2): "two", (1, 3): "Topic one", (1, 4): "Topic one", (1, 5): "Other", (1, 6): "Other", (1, 7): "two", (1, 8): "Topic one", (2, 1): "A", (2, 2): "Other", (2, 3): "A", (2, 4): "A", (2, 5): "A"}
    few = nodes.where("map_id = 2").union(spark.createDataFrame([(2, k, "alpha") for k in range(10, 20)], nodes.schema))
    got = {r["work_id"]: r["subtopic"] for r in graph.assign_subtopics(few, given).collect()}
    assert got[3] == "Other" and got[2] == "Other" and got[10] == "A"
