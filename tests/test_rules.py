"""Phrase tables and rules on texts with known results."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from paperloom.functions import rules, scores, text
from paperloom.functions.phrases import Phrases
from paperloom.operators import assembly, papers, phrases
from paperloom.plans import catalog


def column(spark, make, rows, names):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{n} {'int' if n in ('year', 'cited') else 'string'}" for n in names))
    return [r["v"] for r in sorted(df.select("i", make(*(F.col(n) for n in names)).alias("v")).collect(), key=lambda r: r["i"])]


def test_every_phrase_is_found(spark):
    rng = random.Random(6)
    table = [("x", ["a", "ab", "abc", "bc", "c d", "a.b", "b+", "bcab"]), ("y", ["ca", "cab", "(", "dd"])]
    texts = ["".join(rng.choice("abcd .+(") for _ in range(rng.randint(0, 12))) for _ in range(300)] + [None, "", "ABCAB", "a.b(c d"]
    every = [p for _, terms in table for p in terms]
    found = column(spark, Phrases(table).found, [(t,) for t in texts], ["t"])
    for t, got in zip(texts, found):
        assert sorted(got) == sorted(p for p in every if p in (t or "").lower()), t
    first = column(spark, Phrases(table).first, [(t,) for t in texts], ["t"])
    counts = column(spark, Phrases(table).counts, [(t,) for t in texts], ["t"])
    for t, f, n in zip(texts, first, counts):
        hits = [sum(p in (t or "").lower() for p in terms) for _, terms in table]
        assert list(n) == hits and f == ("x" if hits[0] else "y" if hits[1] else None)


def test_longest_phrase(spark):
    texts = ["graph neural network", "a neural net", "Support Vector", None, "nothing", "cart or gini"]
    assert column(spark, assembly.method_of, [(t,) for t in texts], ["t"]) == ["graph_network", "neural_network", "kernel_svm", None, None, "ensemble_tree"]


def test_domains(spark):
    civil = "civil_engineering"
    rows = [(civil, "Bridge towers", None), (civil, "Robot arm", "for a bridge"), (civil, "Bridge, tower, dam", "robot"), (civil, "Robots", ""), (civil, "Poetry", None), (None, "Bridge", None), ("law", "Robot", None), (civil, None, None)]
    assert column(spark, rules.domain_alignment, rows, ["d", "t", "a"]) == [1.0, 0.15, 0.7, 0.05, 0.3, 0.5, 0.5, 0.3]
    assert column(spark, rules.off_domain, rows, ["d", "t", "a"]) == [False, False, False, True, False, False, False, False]
    assert column(spark, rules.detect_domain, [("Wind LOADING",), ("winds",), (None,)], ["q"]) == [civil, None, None]


def test_fields(spark):
    rows = [("Cognitive Science", None, None), ("applied", "Sea Level", "gene"), (None, "the gene", None), ("Arts", None, "market"), (None, None, None), ("mental health economics", "x", "y"), ("", "", "a leader"), ("Astronomy", "stars", "")]
    assert column(spark, rules.field_tags, rows, ["f", "t", "a"]) == [
        ["Psychology", "Computer Science"], ["Environmental Science"], ["Biology"], ["Economics"], None, ["Psychology", "Medicine"], ["Biology", "Medicine"], None,
    ]


def test_methods_and_kinds(spark):
    assert column(spark, rules.method_bucket, [("Deep RL agents",), ("unknown",), (None,), ("Unknown",), ("a CNN survey",), ("simulated",)], ["m"]) == ["reinforcement learning", "unknown", "unknown", "other", "deep learning", "simulation"]
    assert column(spark, rules.software_paper, [("ggx: a new toolbox", None), ("Cells", "Source code is available"), ("Cells", None), (None, None)], ["t", "a"]) == [True, True, False, False]
    assert column(spark, rules.review_paper, [("Hallmarks of aging", None), ("Cells", "This review covers"), ("Reviewer", "we search"), (None, None)], ["t", "a"]) == [True, True, False, False]


@pytest.mark.parametrize(
    ("title", "cited", "year", "want"),
    [
        ("psmatch2: Stata module to match", 0, 2003, ("implementation", 0.95, "heuristic", False)),
        ("Proceedings of the survey of soils", 9, 2000, ("specific_topics", 0.85, "heuristic", False)),
        ("Handbook of Labor Economics", 9, 2000, ("handbook", 0.90, "heuristic", False)),
        ("Introduction to a review", 900, 2000, ("foundational", 0.90, "heuristic", False)),
        ("A new and better approach", 9, 2000, ("methodological", 0.85, "heuristic", False)),
        ("Machine learning of soils", 9, 2018, ("recent", 0.85, "heuristic", False)),
        ("Machine learning of soils", 9, 2017, None),
        ("Machine learning of soils", 9, None, None),
        ("Fundamentals of Geotechnical Engineering", 9000, 2000, ("foundational", 0.60, "heuristic_borderline", True)),
        ("Structural Dynamics, 3rd Edition", None, 2000, ("foundational", 0.70, "heuristic_borderline", True)),
        ("", 900, 2000, None),
        (None, 900, 2000, None),
    ],
)
def test_categories(spark, title, cited, year, want):
    got = column(spark, rules.paper_category, [(title, cited, year)], ["title", "cited", "year"])[0]
    assert (tuple(got) if got else None) == want


def test_metrics(spark):
    text = "R2=0.91; RMSE of 3.2 mm. and rmse 9, Accuracy: 93.5%, F1-score 0.8 on 40 test images"
    got = column(spark, rules.validation_metrics, [(text,), (None,)], ["t"])
    assert [tuple(m) for m in got[0]] == [("R²", "0.91", ""), ("RMSE", "3.2", "mm"), ("Accuracy", "93.5", "%"), ("F1", "0.8", ""), ("Test samples", "40", "")] and got[1] == []


def test_dictionary(spark):
    texts = spark.createDataFrame([(1, "Deep neural nets; deep NEURAL graph"), (2, None), (3, "graph"), (1, "other nets")], "k int, text string")
    known = spark.createDataFrame([("deep neural", "a"), ("Neural nets!", "b"), ("graph", "c"), ("graph", "d"), ("nets", "e"), (" ", "f"), (None, "g"), ("neural", "h")], "phrase string, label string")
    hits = phrases.phrase_hits(texts, known, "k")
    assert sorted(map(tuple, hits.collect())) == [(1, "deep neural", "a", 2, 0), (1, "graph", "c", 1, 5), (1, "graph", "d", 1, 5), (1, "nets", "e", 1, 1), (1, "neural", "h", 1, 1), (1, "neural nets", "b", 2, 1), (3, "graph", "c", 1, 0), (3, "graph", "d", 1, 0)]
    chosen = lambda rule: sorted((r["k"], r["phrase"], r["label"]) for r in phrases.choose_label(hits, "k", rule).collect())
    assert chosen("longest") == [(1, "deep neural", "a"), (3, "graph", "c")] and chosen("first") == [(1, "deep neural", "a"), (3, "graph", "c")]
    assert phrases.phrase_hits(texts, known.limit(0), "k").collect() == []


@pytest.mark.parametrize(
    ("forms", "said", "score"),
    [
        (["machine learning"], "advances in  Machine\nlearning", 1.0),
        (["natural language processing"], "natural language models", 2 / 3),
        (["quantum computing"], "natural language processing", 0.0),
        ([""], "some text", 0.0),
        ([None, "  "], "some text", 0.0),
        (["some terms"], "", 0.0),
        (["some terms"], None, 0.0),
        ([], "some text", 0.0),
        (["government ment"], "ment in a governmental text", 0.5),
        (["natural language processing", "NLP"], "NLP methods", 1.0),
        (["reinforcement learning", "RL", "reward-based learning"], "learning algorithms for control", 0.5),
    ],
)
def test_terms_by_whole_words(spark, forms, said, score):
    row = spark.createDataFrame([(forms, said)], "forms array<string>, said string")
    assert abs(row.select(scores.term_score(F.col("said"), F.col("forms")).alias("v")).first()["v"] - score) < 1e-12


@pytest.mark.parametrize(
    ("title", "abstract", "reason"),
    [
        ("Deep Residual Learning for Image Recognition", "We propose a deep residual learning framework for training image recognition networks with hundreds of layers.", "valid"),
        ("Test Paper", None, "missing"),
        ("Test Paper", "", "missing"),
        ("Test Paper", "Too short." + " " * 60, "too short"),
        ("Test Paper", "The authors thank the anonymous referees for help with this manuscript, and the Foundation for its grant.", "acknowledgments"),
        ("Test Paper", "Funding came through a grant of the foundation; the authors acknowledge support of the research council.", "mostly about funding"),
        ("Deep Learning Paper", "En este trabajo se presenta un nuevo método para el análisis de datos que permite una mejor comprensión de los resultados.", "language"),
        ("Quantum Computing for Drug Discovery", "The ocean temperature patterns reveal significant changes in marine biodiversity across tropical regions.", "low title overlap"),
        ("Quantum Computing", "The ocean temperature patterns reveal significant changes in marine biodiversity across tropical regions.", "valid"),
        (None, "We introduce a new language representation model that obtains state-of-the-art results on eleven tasks.", "valid"),
    ],
)
def test_abstracts(spark, title, abstract, reason):
    got = column(spark, papers.abstract_validity, [(title, abstract)], ["t", "a"])[0]
    assert (got["valid"], got["reason"]) == (reason == "valid", reason)


def test_ids_in_text(spark):
    asked = ["https://arxiv.org/pdf/2301.12345v2", "arXiv:9912.1", "id 2301.00001", "x 1234.5 cs-LG/0601001", "nothing", "", None]
    assert column(spark, text.arxiv_id_in, [(x,) for x in asked], ["x"]) == ["2301.12345", "9912.1", "2301.00001", "cs-LG/0601001", None, None, None]
    assert column(spark, text.doi_in, [("see https://doi.org/10.1234/AB.c now",), ("10.12/x",), (None,)], ["x"]) == ["10.1234/ab.c", None, None]


def plain_title(title):
    t = re.sub(r"[^\w\s]", " ", unicodedata.normalize("NFKD", title or "").lower())
    for ending in (r"\s+v\d+$", r"\s+version\s+\d+$", r"\s+arxiv$", r"\s+preprint$"):
        t = re.sub(ending, "", t)
    return re.sub(r"\s+", " ", t).strip()


def test_decomposed_titles(spark, tables):
    titles = ["Éte: ﬁne v2", "Ⅷ ½ Å", "", None, "naïve preprint", "ｗｉｄｅ"]
    assert column(spark, lambda t: text.normalize_title(text.decomposed(t)), [(t,) for t in titles], ["t"]) == [plain_title(t) for t in titles]
    whole = catalog.QUERIES["decomposed_titles"](spark, tables).collect()
    given = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    assert len(whole) == len(given)
    for r in whole:
        assert r["title"] == plain_title(" ".join(re.findall(r"[^\x09-\x0D ]+", given[r["work_id"]] or "")[:8]))


@pytest.mark.parametrize("said", ["for réseau", "é library", "libraryé", "tool\u212ait", "\u017foftware", "web\x0bserver", "machine learning in x\n", "improved\rmethod", "RMSE 2 \u00b5m", "Introduct\u0131on to x"])
def test_patterns_mean_what_they_mean_in_sql(spark, said):
    import duckdb

    families = (rules.SOFTWARE_TITLE, rules.REVIEW_TITLE, rules.METHOD_PAPER, rules.TEXTBOOK, tuple(p for p, _, _ in rules.METRICS))
    got = spark.createDataFrame([(said,)], "t string").select(*(F.col("t").rlike(rules.in_java(rules.any_of(f))) for f in families)).first()
    assert list(got) == [duckdb.execute("SELECT regexp_matches(?, ?)", [said, rules.any_of(f)]).fetchall()[0][0] for f in families]


def test_only_hits_are_grouped(spark):
    texts, known = spark.createDataFrame([(1, "a b a b")], "k long, text string"), spark.createDataFrame([("a b", "x"), ("b", "y")], "phrase string, label string")
    found = phrases.phrase_hits(texts, known, "k")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate [k#") < plan.index("Join Inner") and "Aggregate [k#" not in plan[plan.index("Join Inner") :]
    assert sorted(map(tuple, found.collect())) == [(1, "a b", "x", 2, 0), (1, "b", "y", 1, 1)]


def test_titles_are_parted_once_not_once_a_pair(spark, tables):
    plan = catalog.QUERIES["title_similarity_of_peers"](spark, tables)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan[: plan.index("Join Inner")] and "split(" in plan[plan.index("Join Inner") :]


def test_texts_are_read_once_for_all_scopes(spark, tables):
    plan = catalog.QUERIES["scope_filtered"](spark, tables)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("Relation [") == 1
    row = spark.createDataFrame([("deep nets for fish", None, "")], "t string, n string, e string")
    terms = [F.array(F.lit("deep nets")), F.array(F.lit("deep fish")), F.array(F.lit(None).cast("string"))]
    assert row.select(*(scores.term_scores(F.col(c), terms).alias(c) for c in "tne")).first() == ([1.0, 1.0, 0.0], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0])
