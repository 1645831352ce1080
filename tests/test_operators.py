"""Small cases with known results."""

import os

import pytest
from pyspark.sql import functions as F

from paperloom.functions import scores, text
from paperloom.operators import gaps, graph, ranking, relational, retrieval, usage
from paperloom.sources import store
from paperloom.sources.raw import read_records
from paperloom.tables import discard, landed


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values()) or (1,)], list(values) or ["x"])
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("cites", "age", "rate"), [(0, 1, 0.25), (100, 5, 12.625), (1000, 10, 77.0), (10000, 20, 434.826087)])
def test_impact_rate(spark, cites, age, rate):
    assert round(one(spark, scores.impact_rate(F.col("c"), F.col("a")), c=cites, a=float(age)), 6) == rate


def test_robust_norm_golden(spark):
    rows = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([0, 0, 10, 20, 30, 40, 50, 60, 70, 80, 90])], ["g", "k", "score"])
    got = {r["k"]: r["norm"] for r in ranking.robust_norm(rows, ["g"]).collect()}
    assert got[0] == got[1] == 0.0 and got[10] == 1.0 and abs(got[5] - 40 / 80) < 0.51


def test_norms_of_equal_values(spark):
    rows = spark.createDataFrame([(1, 1, 2.0), (1, 2, 2.0)], ["g", "k", "score"])
    assert {r["norm"] for r in ranking.robust_norm(rows, ["g"]).collect()} == {0.0}
    assert {r["norm"] for r in ranking.min_max_norm(rows, ["g"]).collect()} == {1.0}


def test_identifiers(spark):
    assert one(spark, text.normalize_doi(F.col("d")), d=" HTTPS://doi.org/10.1/AB ") == "10.1/ab"
    assert one(spark, text.normalize_doi(F.lit("doi:"))) is None
    assert one(spark, text.normalize_arxiv_id(F.col("d")), d="https://arxiv.org/pdf/2301.12345v2") == "2301.12345"
    assert one(spark, text.normalize_title(F.col("t")), t="Deep  Nets: a Study v2") == "deep nets a study"


def test_inverted_index(spark):
    row = spark.createDataFrame([({"b": [1], "a": [0, 2], "c": [1]},)], "m map<string,array<int>>")
    assert row.select(text.text_from_inverted_index(F.col("m")).alias("v")).first()["v"] == "a b a"


def test_era_labels(spark):
    assert [one(spark, scores.era_label(F.lit(2003), w)) for w in (1, 3, 5, 10)] == ["2003", "2001-2003", "2000-2004", "2000s"]
    assert one(spark, scores.era_label(F.lit(None).cast("int"), 5)) == "Unknown"


def test_rrf_ranks_absent_works_last(spark):
    rows = spark.createDataFrame([(1, 1, "a", 3.0), (1, 2, "a", 2.0), (1, 1, "b", 1.0)], ["query_id", "work_id", "ranker", "score"])
    got = {r["work_id"]: r["rrf"] for r in ranking.rrf(rows).collect()}
    assert got[1] == pytest.approx(2 / 61) and got[2] == pytest.approx(1 / 62 + 1 / 63)


def test_similar_titles(spark):
    rows = spark.createDataFrame([(1, 1, 1, ["deep", "nets"]), (1, 2, 2, ["deep", "nets", "two"]), (1, 3, 3, ["other"]), (1, 4, 4, []), (1, 5, 5, [])], "query_id int, work_id int, rank int, words array<string>")
    assert [r["work_id"] for r in retrieval.drop_similar_titles(rows).orderBy("rank").collect()] == [1, 3, 4, 5]


def test_stale_comparisons(spark):
    rows = spark.createDataFrame([(1, 1, 1, ["a", "b"]), (1, 2, 2, ["a", "b", "c"]), (1, 3, 3, ["z"])], "map_id int, comparison_id int, seq int, work_ids array<string>")
    got = usage.comparison_contribution(rows).first()
    assert (round(got["total"], 6), round(got["penalty"], 6), got["n"]) == (0.08, 0.02, 2)


def test_graph_normalization(spark):
    nodes = spark.createDataFrame([(1,), (2,), (2,), (3,)], ["work_id"])
    edges = spark.createDataFrame([(1, 2), (1, 2), (2, 2), (1, 9)], ["from_id", "to_id"])
    own, kept, report = graph.normalize_graph(nodes, edges)
    assert [tuple(r) for r in kept.collect()] == [(1, 2)]
    assert tuple(report.first()) == (4, 3, 4, 1)
    degree = {r["work_id"]: r["degree"] for r in graph.degrees(own, kept).collect()}
    assert degree == {1: 1, 2: 1, 3: 0}


def test_greedy_selection(spark):
    rows = [(1, i, 1.0 / (i + 1), 0.5, i == 0, i % 2 == 1) for i in range(30)] + [(2, 1, 0.5, 0.5, False, False)]
    c = spark.createDataFrame(rows, "map_id long, work_id long, relevance double, temporal double, is_seed boolean, is_enrichment boolean")
    e = spark.createDataFrame([(i, 0) for i in range(1, 30)], "from_id long, to_id long")
    got = sorted((r["map_id"], r["pick"], r["work_id"]) for r in graph.greedy_select(c, e, 10).collect())
    first = [w for m, _, w in got if m == 1]
    assert first[0] == 0 and len(set(first)) == 10 and all(w % 2 == 0 for w in first[:6])
    assert [w for m, _, w in got if m == 2] == []


def test_temporal_gap_and_comeback(spark):
    years = [y for y in range(2000, 2012) for _ in range(0 if y in (2005, 2006) else 4)]
    found = gaps.temporal_gaps(spark.createDataFrame([(1, y) for y in years], ["map_id", "year"])).collect()
    assert [(r["start_year"], r["end_year"], r["comeback"]) for r in found] == [(2005, 2006, True)]


def test_focus_falls_back(spark):
    rows = spark.createDataFrame([(1, i, "t", 2000, 600 if i < 3 else 150, 0.5, None) for i in range(12)], "query_id int, work_id int, title string, year int, cited_by_count int, relevance double, paper_type string")
    assert relational.focus_filter(rows, "foundational", 2026).count() == 12
    assert relational.focus_filter(rows.limit(5), "foundational", 2026).count() == 5


def test_upserts(spark):
    a = spark.createDataFrame([(1, "x", 2001, 5), (2, None, None, None)], "work_id int, title string, year int, cited_by_count int")
    b = spark.createDataFrame([(1, "y", 1999, 4), (2, "z", 2000, 1), (3, "w", None, 2)], a.schema)
    assert sorted(map(tuple, relational.upsert_works(a, b).collect())) == [(1, "x", 1999, 5), (2, "z", 2000, 1), (3, "w", None, 2)]
    assert relational.insert_ignore(a, b, ["work_id"]).count() == 3


def test_results_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, 10, 2), (1, 11, 1), (2, 12, 1)], "query_id int, work_id int, rank int")
    store.write_ranked_results(rows, str(tmp_path / "r"))
    assert [r["work_id"] for r in store.read_results(spark, str(tmp_path / "r"), 1).collect()] == [11, 10]


def test_source_normalization(spark):
    catalog = spark.createDataFrame(
        [("https://x.org/W12", "T", 2001, None, [(("A B",),)], (("V",),), "https://doi.org/10.1/X", {"hi": [0]})],
        "id string, title string, publication_year int, cited_by_count int, authorships array<struct<author:struct<display_name:string>>>, primary_location struct<source:struct<display_name:string>>, doi string, abstract_inverted_index map<string,array<int>>",
    )
    preprints = spark.sql("SELECT '2301.1' arxiv_id, ' A\n B ' title, DATE'2023-01-02' published, array('C') authors, CAST(NULL AS STRING) doi, 's' summary")
    got = {r["source"]: r for r in store.normalize_sources(catalog, preprints).collect()}
    assert (got["catalog"]["work_id"], got["catalog"]["doi"], got["catalog"]["authors"], got["catalog"]["abstract"]) == ("W12", "10.1/x", ["A B"], "hi")
    assert (got["preprints"]["title"], got["preprints"]["year"]) == ("A B", 2023)


def test_entity_match(spark):
    side = lambda p: {"doi": F.col(p + "d"), "arxiv_id": F.col(p + "a"), "title": F.col(p + "t"), "year": F.col(p + "y")}
    schema = "ad string, aa string, at string, ay int, bd string, ba string, bt string, by int"
    rows = spark.createDataFrame([("10.1/a", None, "x", 1, "10.1/b", None, "x", 1), (None, "1.2", "x", 1, None, "1.2v3", "y", 5), (None, None, "deep nets", 2000, None, None, "deep nets", 2000), (None, None, "abc", 2000, None, None, "xyz", 2000)], schema)
    got = [tuple(r["m"])[:2] for r in rows.select(text.entity_match(side("a"), side("b")).alias("m")).collect()]
    assert got == [(False, 0.0), (True, 0.98), (True, 0.95), (False, 0.0)]


@pytest.mark.parametrize("block", [3, 2000])
def test_pairs_of_hubs(spark, block):
    hub = [(0, t) for t in range(30)] + [(f, t) for f in (1, 2, 3) for t in range(8 * f)]
    edges = spark.createDataFrame(hub + [(0, 1)], "from_id long, to_id long")
    refs = {f: {t for g, t in hub if g == f} for f in range(4)}
    shared = {(a, b): sum(a in r and b in r for r in refs.values()) for a in range(30) for b in range(30) if a != b}
    got = {(r["work_id"], r["other_id"]): r["shared"] for r in graph.co_citation(edges, least=2, k=100, block=block).collect()}
    assert got == {p: n for p, n in shared.items() if n >= 2}
    got = {(r["work_id"], r["other_id"]): r["coupling"] for r in graph.bibliographic_coupling(edges, k=100, block=block).collect()}
    assert got == pytest.approx({(a, b): len(refs[a] & refs[b]) / len(refs[a] | refs[b]) for a in refs for b in refs if a != b})


def test_pairs_of_a_hub_beyond_ten_thousand(spark):
    pair = [(1, -1), (1, -2), (2, -1), (2, -2)]
    cites = spark.range(10_001).select(F.lit(0).cast("long").alias("from_id"), (-F.col("id") - 1).alias("to_id"))
    got = graph.co_citation(cites.union(spark.createDataFrame(pair, "a long, b long")), least=3).collect()
    assert {(r["work_id"], r["other_id"], r["shared"]) for r in got} == {(-1, -2, 3), (-2, -1, 3)}


def test_canonical_ids_over_long_chains(spark):
    n = 5000
    rows = [(f"r{i}", (i * 7919) % 1009, f"10.1/k{(i + 1) // 2}", None, f" T{i // 2} ") for i in range(n)]
    rows += [("x1", 5, None, "https://arxiv.org/abs/2301.1v2", None), ("x2", 1, None, "2301.1", "t"), ("x3", 0, "doi:", "", " "), ("x4", None, None, "arxiv:2301.1", "u"), ("x4", 9, None, None, "u"), ("x5", 2, "", None, "U")]
    found = {r["record_id"]: r["canonical_id"] for r in store.canonical_ids(spark.createDataFrame(rows, "record_id string, priority int, doi string, arxiv_id string, title string").repartition(4)).collect()}
    best = min((p, r) for r, p, *_ in rows[:n])[1]
    assert {found[f"r{i}"] for i in range(n)} == {best} and len(found) == n + 5
    assert {k: found[k] for k in ("x1", "x2", "x3", "x4", "x5")} == {"x1": "x2", "x2": "x2", "x3": "x3", "x4": "x2", "x5": "x2"}
    assert store.canonical_ids(spark.createDataFrame([], "record_id string, priority int, doi string, arxiv_id string, title string")).collect() == []


def test_landed_tables_can_be_discarded(spark):
    df = landed(spark.range(5))
    folder = os.path.dirname(df.inputFiles()[0].removeprefix("file://"))
    assert df.count() == 5 and os.path.isdir(folder)
    discard(df)
    assert not os.path.exists(folder)


def test_raw_records(spark):
    rows = [
        ("catalog", '{"id": "https://x.org/W7", "title": " A  b ", "abstract_inverted_index": {"two": [1], "one": [0]}, "authorships": [{"author": {"display_name": "N"}}], "is_retracted": true, "new": 1}'),
        ("catalog", '{"id": "https://x.org/W8", "publication_year": "soon"}'),
        ("catalog", '{"id": "https://x.org/A8"}'),
        ("catalog", "[1, 2"),
        ("catalog", None),
        ("preprints", '{"arxiv_id": "arXiv:2301.1v3", "venue": ""}'),
        ("graph", '{"s2_id": "0123456789012345678901234", "arxiv_id": "2301.1"}'),
        ("graph", '{"s2_id": "", "title": "t"}'),
        ("registry", '{"DOI": "10.1/A", "title": ["T", "t"], "published": {"date-parts": [[1999, 2]]}, "author": [{"given": "G", "family": "F"}, {"family": "H"}]}'),
        ("gone", "{}"),
        (None, "{}"),
    ]
    works, rejects = read_records(spark.createDataFrame(rows, "source string, record string"))
    got = {r["work_id"]: r.asDict() for r in works.collect()}
    assert set(got) == {"W7", "AX:2301.1", "S2:01234567890123456789", "DOI:10.1/a"}
    assert (got["W7"]["title"], got["W7"]["abstract"], got["W7"]["authors"], got["W7"]["is_retracted"], got["W7"]["cited_by_count"]) == ("A b", "one two", ["N"], True, 0)
    assert got["AX:2301.1"]["venue"] == "arXiv" and got["S2:01234567890123456789"]["pdf_url"] == "https://arxiv.org/pdf/2301.1.pdf"
    assert (got["DOI:10.1/a"]["title"], got["DOI:10.1/a"]["year"], got["DOI:10.1/a"]["authors"]) == ("T", 1999, ["G F", "H"])
    assert sorted((r["source"] or "", r["reason"]) for r in rejects.collect()) == [("", "unknown source"), ("catalog", "malformed"), ("catalog", "malformed"), ("catalog", "malformed"), ("catalog", "no id"), ("gone", "unknown source"), ("graph", "no id")]
