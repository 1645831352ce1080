"""Queries over pairs of works or orders: texts are parted once, crowds are dealt to blocks, pairs are not exchanged."""

import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators import graph, relational, retrieval, similar
from paperloom.plans import catalog


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("block", [1000, 3])
def test_all_pairs_in_blocks(spark, tables, block):
    rng = random.Random(5)
    rows = [(g, i * 10 + g, t := " ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 4))), sorted(set(t.split()))) for g in range(3) for i in range(15)] + [(None, 1, "a", ["a"]), (4, 999, "b", ["b"])]
    got = similar.all_pairs(spark.createDataFrame(rows, "g int, k long, t string, w array<string>"), ["g"], "k", "t", "w", block).collect()
    alike = lambda x, y: 0.0 if not x[3] or not y[3] else 1.0 if x[2] == y[2] else len(set(x[3]) & set(y[3])) / len(set(x[3]) | set(y[3]))
    assert sorted(map(tuple, got)) == sorted((x[1], y[1], alike(x, y)) for x in rows for y in rows if x[0] is not None and x[0] == y[0] and x[1] < y[1])
    assert "FlatMapGroupsInArrow" in plan(catalog.QUERIES["title_similarity_of_peers"](spark, tables))


def test_a_title_of_many_is_the_work_of_many_tasks(spark, tables):
    said = plan(catalog.QUERIES["entity_match"](spark, tables))
    assert "regexp_replace" not in said[: said.index("Join Inner")] and "_other" in said
    rows = spark.createDataFrame([("t", i) for i in range(25)] + [("u", 1)], "k string, m int")
    assert sorted(map(tuple, graph.pairs(rows, "k", "m", 4).collect())) == [(i, j) for i in range(25) for j in range(i + 1, 25)]


def test_dimensions_are_parted_once_a_work(spark, tables):
    assert "regexp_extract_all" not in plan(catalog.QUERIES["dimension_overlap"](spark, tables))


@pytest.mark.parametrize("frequent", [0, 3, 100_000])
def test_query_similarity_whatever_terms_are_sent(spark, frequent):
    works = spark.createDataFrame([(1, "deep nets", "deep learning for fish"), (2, None, "fish fish river"), (3, "the", None), (4, "river deep", "mountain")], "work_id long, title string, abstract string")
    queries = spark.createDataFrame([(7, "deep fish the fish"), (8, "unknown river"), (9, "the")], "query_id long, query string")
    docs = works.select(F.col("work_id").alias("doc"), F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit(""))).alias("text"))
    found = retrieval.tfidf_query_similarity(works, queries, pairs=2, frequent=frequent)
    want = {}
    for q in queries.collect():
        whole = docs.union(spark.createDataFrame([(0, q["query"])], "doc long, text string"))
        vectors = retrieval.tfidf_vectors(whole, idf_extra=0).withColumn("set_id", F.lit(1))
        want |= {(q["query_id"], r["b"]): r["cosine"] for r in retrieval.pairwise_cosine(vectors).where("a = 0").collect()}
    got = {(r["query_id"], r["work_id"]): r["similarity"] for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_domains_are_parted_once_a_work(spark, tables):
    assert "regexp_extract_all" not in plan(catalog.QUERIES["cross_domain_filter"](spark, tables))


@pytest.mark.parametrize("carry, block", [(64, 2000), (2, 3), (64, 3)])
@pytest.mark.parametrize("each_once", [True, False])
def test_overlaps_are_counted_where_pairs_meet(spark, carry, block, each_once):
    rng = random.Random(6)
    rows = [(i, [rng.choice([1, 2, 3, 4, 5, None, 1]) for _ in range(rng.randint(0, 5))]) for i in range(20)] + [(30, None)]
    a, b = (spark.createDataFrame(rows, f"{k} int, p array<int>") for k in "ab")
    got = relational.array_overlap_join(a, b, "a", "b", "p", each_once, carry, block)
    shared = lambda x, y: len(set(x or []) & set(y or []) - {None})
    assert sorted(map(tuple, got.collect())) == [(i, j, shared(x, y)) for i, x in rows for j, y in rows if shared(x, y) and (i < j or not each_once)]
    if carry == 64:
        said = plan(got)
        assert "Aggregate" not in said[: said.index("Join Inner")]
