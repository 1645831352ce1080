"""Phrases by positions, and the choice of varied works, against plain loops."""

import math
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from paperloom.operators import ranking, retrieval
from paperloom.plans import catalog


def occurrences(words, phrase):
    return sum(words[i : i + len(phrase)] == phrase for i in range(len(words) - len(phrase) + 1))


def test_phrases_side_by_side(spark):
    rng = random.Random(3)
    texts = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 6))), " ".join(rng.choice("aabcdeé") for _ in range(rng.randint(0, 25)))) for i in range(40)] + [(90, None, None), (91, "A, b!", "a.b a B")]
    works = spark.createDataFrame(texts, "work_id int, title string, abstract string")
    phrases = ["a b", "a a", "c", "a b c", "e d a a", "zz", "a zz", "A  B", "...", "é a"]
    asked = spark.createDataFrame([(q, p) for q in (1, 2) for p in (phrases if q == 1 else phrases[:3])], "query_id int, phrase string")
    got = sorted(map(tuple, retrieval.phrase_matches(retrieval.build_positions(works), asked).collect()))
    want = []
    for q, p in [(r["query_id"], r["phrase"]) for r in asked.collect()]:
        words = [w for w in p.lower().replace(".", " ").split()]
        for i, title, abstract in texts:
            for field, said in (("A", title), ("B", abstract)):
                have = (said or "").lower().replace(",", " ").replace("!", " ").replace(".", " ").split()
                if words and (n := occurrences(have, words)):
                    want.append((q, p, i, field, n))
    assert got == sorted(want)


def test_scores_filters_and_cuts(spark):
    works = spark.createDataFrame([(1, "deep nets", "deep nets deep nets"), (2, "nets", "shallow deep"), (3, "deep", "deep nets"), (4, "", "graph")], "work_id int, title string, abstract string")
    positions = retrieval.build_positions(works)
    asked = spark.createDataFrame([(7, "deep nets", True), (7, "Deep Nets", False), (7, "graph", False)], "query_id int, term string, original boolean")
    found = {r["work_id"]: (round(r["score"], 6), r["part"]) for r in retrieval.full_text_search(positions, asked).collect()}
    assert found == {1: (round(2 + 0.8 * (1 + math.log(2)), 6), "A"), 3: (0.8, "A"), 4: (0.4, "B")}
    some = works.where("work_id > 1")
    assert [r["work_id"] for r in retrieval.full_text_search(positions, asked, some, 1).collect()] == [3]
    assert retrieval.full_text_search(positions, asked.limit(0)).collect() == []


def plain_mmr(rows, vectors, k, relevance=0.8, era=0.08, field=0.12, years=5):
    """rows: (work_id, score, impact, year, subfield) of one query."""
    left, taken = sorted(rows, key=lambda r: (-r[1], r[0])), []

    def cosine(a, b):
        a, b = vectors.get(a, {}), vectors.get(b, {})
        na, nb = (math.sqrt(sum(x * x for x in v.values())) for v in (a, b))
        return sum(w * b[t] for t, w in a.items() if t in b) / (na * nb) if na and nb else 0.0

    def value(r):
        like = max((cosine(r[0], s[0]) for s in taken), default=0.0)
        off = 1 - 0.5 * (0.5 if r[2] is None else r[2])
        eras, kinds = [s[3] for s in taken if s[3]], [s[4] for s in taken if s[4]]
        near = sum(abs(y - r[3]) <= years for y in eras) / len(eras) if r[3] and eras else 0.0
        same = kinds.count(r[4]) / len(kinds) if r[4] and kinds else 0.0
        return relevance * r[1] - (1 - relevance) * like - era * near * off - field * same * off

    while left and len(taken) < k:
        best = max(left, key=lambda r: round(value(r), 12))
        taken.append(best)
        left.remove(best)
    return [r[0] for r in taken]


@pytest.mark.parametrize("k", [1, 8, 100])
def test_varied_choice_is_the_greedy_one(spark, k):
    rng = random.Random(k)
    rows, vectors = [], {}
    for w in range(70):
        rows.append((w % 2, w, round(rng.random(), 3), rng.choice([None, 0.0, 1.0, rng.random()]), rng.choice([None, 0, 1990, 2000, 2004, 2010, 2020]), rng.choice([None, "", "x", "y", "z"])))
        if w % 9:
            vectors[w] = {f"t{rng.randint(0, 12)}": rng.random() for _ in range(rng.randint(1, 5))}
    pool = spark.createDataFrame(rows, "query_id long, work_id long, score double, impact double, year int, subfield string")
    long = spark.createDataFrame([(w, t, x) for w, v in vectors.items() for t, x in v.items()], "work_id long, term string, weight double")
    got = ranking.mmr_sparse(pool, long, k).orderBy("query_id", "pick").collect()
    for q in (0, 1):
        assert [r["work_id"] for r in got if r["query_id"] == q] == plain_mmr([r[1:] for r in rows if r[0] == q], vectors, k)


def test_dense_choice(spark):
    rows = [(1, 1, 1.0, 1.0, "a", "x", [1.0, 0.0]), (1, 2, 0.9, 0.0, "a", "x", [1.0, 0.01]), (1, 3, 0.7, 0.0, "b", "y", [0.0, 1.0]), (1, 4, 0.1, 0.0, "c", "z", [0.0, 0.0])]
    pool = spark.createDataFrame(rows, "query_id long, work_id long, score double, impact double, era string, subfield string, embedding array<double>")
    picks = lambda w: [r["work_id"] for r in ranking.mmr(pool, 3, w).orderBy("pick").collect()]
    assert picks((0.8, 0.2, 0.0, 0.0)) == [1, 3, 2] and picks((1.0, 0.0, 0.0, 0.0)) == [1, 2, 3]


def test_query_of_varied_works(spark, tables, monkeypatch):
    seen = {}
    plain = ranking.mmr_sparse
    monkeypatch.setattr(ranking, "mmr_sparse", lambda pool, vectors, k: seen.update(pool=pool, vectors=vectors) or plain(pool, vectors, k))
    got = catalog.QUERIES["mmr_tfidf"](spark, tables).orderBy("query_id", "pick").toPandas()
    pool, long = seen["pool"].toPandas(), seen["vectors"].toPandas()
    vectors = {w: dict(zip(g["term"], g["weight"])) for w, g in long.groupby("work_id")}
    for q in sorted(pool["query_id"].unique())[:5]:
        rows = [(r.work_id, r.score, None if pd.isna(r.impact) else r.impact, None if pd.isna(r.year) else int(r.year), r.subfield) for r in pool[pool["query_id"] == q].itertuples()]
        assert got[got["query_id"] == q]["work_id"].tolist() == plain_mmr(rows, vectors, 20)
    assert got.groupby("query_id").size().le(20).all()


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))


def usable(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("block", [7, 4096])
def test_neighbours_and_fallback_edges_against_all_pairs(spark, block):
    rng = random.Random(block)
    vectors = [(i, [rng.choice([-1.0, 0.0, 1.0, rng.random()]) for _ in range(4)]) for i in range(60)]
    vectors += [(60, list(vectors[3][1])), (61, [2 * x for x in vectors[3][1]]), (62, None), (63, []), (64, [0.0] * 4), (65, [float("nan")] * 4), (66, [1.0, None, 0.0, 0.0]), (67, [1.0, 2.0]), (68, [2.0, 4.0]), (69, [2.0, -1.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 4 < 2").withColumnRenamed("vec_id", "query_id")
    got = retrieval.vector_knn(df, asked, 5, block).collect()
    want = []
    for q, x in vectors:
        if q % 4 < 2 and usable(x):
            near = sorted((-round(cosine(x, y), 12), v) for v, y in vectors if v != q and usable(y) and len(x) == len(y))[:5]
            want += [(q, v, r + 1) for r, (_, v) in enumerate(near)]
    assert sorted((r["query_id"], r["vec_id"], r["rank"]) for r in got) == sorted(want)

    nodes = df.select((F.col("vec_id") % 3).alias("map_id"), F.col("vec_id").alias("work_id"), "embedding")
    edges = spark.createDataFrame([(0, i, i + 3) for i in range(0, 60, 3) for _ in range(3)] + [(1, 1, 4)], "map_id long, from_id long, to_id long")
    found = sorted((r["map_id"], r["a"], r["b"]) for r in retrieval.fallback_edges(nodes, edges, block=block).collect())
    assert found == sorted((i % 3, i, j) for i, x in vectors for j, y in vectors if i % 3 == j % 3 != 0 and i < j and usable(x) and usable(y) and len(x) == len(y) and round(cosine(x, y), 12) >= 0.7)


def test_sums_in_another_order_tie(spark):
    postings = spark.createDataFrame([(9, t, "B", 1) for t in "xyz"] + [(2, "x", "A", 1), (2, "w", "B", 1)], "work_id long, term string, field string, tf long")
    terms = spark.createDataFrame([(1, t, t != "w") for t in "wxyz"], "query_id long, term string, original boolean")  # 0.8 + 0.8 + 0.8 and 2.0 + 0.4
    assert [r["work_id"] for r in retrieval.fts_search(postings, terms, most=1).collect()] == [2]


def exchanges(df):
    return re.findall(r"hashpartitioning\(([^)]*)\), (\w+)", df._jdf.queryExecution().executedPlan().toString())


def test_bm25_deals_works_once(spark, tables):
    from paperloom.plans import views

    scored = retrieval.bm25(views.works(spark, tables), views.queries(spark, tables))
    assert [keys.split("#")[0] for keys, why in exchanges(scored) if "work_id" in keys] == ["work_id"] and not any("query_id" in keys for keys, _ in exchanges(scored))


def test_bm25_pairs_of_a_task_are_bounded(spark, tables):
    from paperloom.plans import views

    w, q = views.works(spark, tables), views.queries(spark, tables)
    scored = retrieval.bm25(w, q, pairs=500)  # whatever the session's number of partitions is
    dealt = re.findall(r"hashpartitioning\(work_id#\d+L, (\d+)\), REPARTITION_BY_NUM", scored._jdf.queryExecution().executedPlan().toString())
    assert dealt == [str(-(-w.count() * q.count() // 500))]
    rows = lambda df: {(r["query_id"], r["work_id"]): round(r["score"], 9) for r in df.collect()}
    assert rows(scored) == rows(retrieval.bm25(w, q))


def test_bm25_by_hand(spark):
    texts = {1: "a b b", 2: "A c", 3: "a", 4: None, 5: "d d e c"}
    works = spark.createDataFrame([(i, None, t) for i, t in texts.items()], "work_id long, title string, abstract string")
    got = {(r["query_id"], r["work_id"]): r["score"] for r in retrieval.bm25(works, spark.createDataFrame([(1, "a c C"), (2, "zz"), (3, None)], "query_id long, query string")).collect()}
    docs = {i: (t or "").lower().split() for i, t in texts.items()}
    df = {t: sum(t in d for d in docs.values()) for t in set().union(*docs.values())}
    idf = {t: math.log(5 - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
    mean, avg = sum(idf.values()) / len(idf), sum(map(len, docs.values())) / 5
    part = lambda t, d: (idf[t] if idf[t] >= 0 else 0.25 * mean) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg))
    assert got == pytest.approx({(1, i): sum(part(t, d) for t in ("a", "c", "c")) for i, d in docs.items() if "a" in d or "c" in d})


def test_vectors_of_some_documents_weigh_terms_by_all(spark):
    docs = spark.createDataFrame([(1, "deep nets deep"), (2, "deep soil"), (3, "")], "doc long, text string")
    rows = lambda df: sorted((r["doc"], r["term"], round(r["weight"], 9)) for r in df.collect())
    assert rows(retrieval.tfidf_vectors(docs, only=docs.where("doc = 2").select("doc"))) == [r for r in rows(retrieval.tfidf_vectors(docs)) if r[0] == 2]


def test_positions_of_asked_terms_only(spark):
    works = spark.createDataFrame([(1, "Deep nets", "nets of deep nets")], "work_id long, title string, abstract string")
    got = retrieval.build_positions(works, spark.createDataFrame([("nets",), ("nets",), ("soil",)], "term string")).collect()
    assert sorted((r["field"], r["term"], r["positions"]) for r in got) == [("A", "nets", [1]), ("B", "nets", [0, 3])]
