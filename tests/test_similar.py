"""Similar sets and greedy choices against loops over all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from paperloom.operators import gaps, graph, retrieval, similar

SETS = "g int, k int, words array<string>"


def some_sets(seed, n=120, vocabulary=14, most=7):
    rng = random.Random(seed)
    word = lambda: f"w{int(vocabulary * rng.random() ** 2)}"
    return [(rng.randint(0, 2), k, [word() for _ in range(rng.randint(0, most))]) for k in range(n)] + [(0, n, None), (1, n + 1, [None, "w1"]), (2, n + 2, ["w1"] * 3)]


def alike(x, y, percent, strict, contained):
    x, y = (set(v or ()) - {None} for v in (x, y))
    both, whole = len(x & y), min(len(x), len(y)) if contained else len(x | y)
    return bool(x) and bool(y) and (100 * both > percent * whole if strict else 100 * both >= percent * whole) and both > 0


@pytest.mark.parametrize(("percent", "strict", "contained"), [(40, False, False), (50, True, False), (20, False, False), (100, False, False), (50, True, True), (75, False, True)])
def test_similar_sets(spark, percent, strict, contained):
    rows = some_sets(percent)
    got = similar.similar_sets(spark.createDataFrame(rows, SETS), ["g"], "k", "words", percent, strict, contained).collect()
    want = {(g, min(i, j), max(i, j)) for g, i, x in rows for h, j, y in rows if g == h and i != j and alike(x, y, percent, strict, contained)}
    assert {(r["g"], min(r["a"], r["b"]), max(r["a"], r["b"])) for r in got} == want and len(got) == len(want)
    members = {(g, k): set(x or ()) - {None} for g, k, x in rows}
    assert all((r["both"], r["n_a"], r["n_b"]) == (len(members[r["g"], r["a"]] & members[r["g"], r["b"]]), len(members[r["g"], r["a"]]), len(members[r["g"], r["b"]])) for r in got)


def test_few_pairs_are_compared_though_all_share_a_member(spark):
    rng = random.Random(1)
    rows = []
    for family in range(60):  # families of 5 alike, all with the three most common members
        base = [f"m{rng.randint(0, 4000)}" for _ in range(17)]
        rows += [(0, 5 * family + i, [*base[: 16 - i % 2], "hub", "hub2", "hub3"]) for i in range(5)]
    ordered = similar.rare_first(spark.createDataFrame(rows, SETS), ["g"], "k", "words")
    compared = similar.candidates(ordered, ["g"], "k", 80, False).count()
    kept = similar.similar_sets(spark.createDataFrame(rows, SETS), ["g"], "k", "words", 80).count()
    assert kept == 60 * 10 and compared <= 1.1 * kept  # of 44,850 pairs that share a member


def walk(rows, linked):
    """Keys kept by a walk in order; rows: (group, key, order)."""
    kept = []
    for g, k, _ in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if not any(h == g and linked(k, j) for h, j in kept):
            kept.append((g, k))
    return sorted(kept)


@pytest.mark.parametrize("seed", [1, 2])
def test_keep_first(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randint(0, 1), k, rng.randint(0, 9)) for k in range(60)]
    group = {k: g for g, k, _ in rows}
    pairs = {frozenset(rng.sample(range(60), 2)) for _ in range(70)} | {frozenset((k, k + 1)) for k in range(40, 59)}
    links = [(group[min(p)], *rng.sample(sorted(p), 2)) for p in pairs if len({group[k] for k in p}) == 1]
    items = spark.createDataFrame(rows, "g int, k int, o int")
    got = similar.keep_first(items, spark.createDataFrame(links + links[:3] + [(0, 5, 5)], "g int, a int, b int"), ["g"], "k", ["o"])
    assert got.columns == ["g", "k", "o"] and sorted((r["g"], r["k"]) for r in got.collect()) == walk(rows, lambda i, j: frozenset((i, j)) in pairs)
    assert similar.keep_first(items, spark.createDataFrame([], "g int, a int, b int"), ["g"], "k", ["o"]).count() == len(rows)


def test_titles_and_gaps_like_a_walk(spark):
    rows = [(g, k, k % 50, sorted(set(x or ()) - {None})) for g, k, x in some_sets(3, 150)]
    words = {k: x for _, k, _, x in rows}
    ranked = spark.createDataFrame(rows, "query_id int, work_id int, rank int, words array<string>")
    got = sorted((r["query_id"], r["work_id"]) for r in retrieval.drop_similar_titles(ranked).collect())
    assert got == walk([r[:3] for r in rows], lambda i, j: alike(words[i], words[j], 40, False, False))
    evidence = {k: x for _, k, x in some_sets(4, 150, 60)}
    table = spark.createDataFrame([(g, k, o / 10, x, evidence[k]) for g, k, o, x in rows], "map_id int, gap_id int, gap_score double, words array<string>, evidence array<string>")
    linked = lambda i, j: alike(words[i], words[j], 50, True, False) or alike(evidence[i], evidence[j], 50, True, True)
    assert sorted((r["map_id"], r["gap_id"]) for r in gaps.dedupe_gaps(table).collect()) == walk([(g, k, -o) for g, k, o, _ in rows], linked)


def test_coupling_against_all_pairs(spark):
    rng = random.Random(9)
    cites = {w: {int(30 * rng.random() ** 2) for _ in range(rng.randint(1, 6))} for w in range(80)} | {w: {1, 2} for w in range(100, 125)}
    edges = [(w, r) for w, refs in cites.items() for r in refs] + [(3, 1), (3, 1)]
    cites[3] = cites[3] | {1}
    got = sorted(map(tuple, graph.bibliographic_coupling(spark.createDataFrame(edges, "from_id int, to_id int"), k=4).select("work_id", "other_id", F.round("coupling", 9), "rank").collect()))
    want = []
    for w, x in cites.items():
        near = sorted((-len(x & y) / len(x | y), v) for v, y in cites.items() if v != w and 100 * len(x & y) >= 20 * len(x | y))
        want += [(w, v, round(-c, 9), i + 1) for i, (c, v) in enumerate(near[:4])]
    assert got == sorted(want)


@pytest.mark.parametrize(("percent", "strict", "contained"), [(40, False, False), (20, False, False), (50, True, True)])
@pytest.mark.parametrize(("carry", "block"), [(3, 4), (64, 4), (0, 2000)])
def test_sets_judged_where_they_meet_and_longer_ones_by_key(spark, percent, strict, contained, carry, block):
    rows = some_sets(percent + carry)
    got = similar.similar_sets(spark.createDataFrame(rows, SETS), ["g"], "k", "words", percent, strict, contained, block=block, carry=carry).collect()
    want = {(g, min(i, j), max(i, j)) for g, i, x in rows for h, j, y in rows if g == h and i != j and alike(x, y, percent, strict, contained)}
    assert {(r["g"], min(r["a"], r["b"]), max(r["a"], r["b"])) for r in got} == want and len(got) == len(want)


def test_pairs_of_short_sets_are_not_exchanged(spark):
    found = similar.similar_sets(spark.createDataFrame(some_sets(1), SETS), ["g"], "k", "words", 40)
    dealt = re.findall(r"hashpartitioning\(([^)]*)\)", found._jdf.queryExecution().executedPlan().toString())
    assert dealt and not any("a#" in keys for keys in dealt)


def test_pairs_of_lists_are_made_once(spark):
    edges = spark.createDataFrame([(i, j) for i in range(8) for j in range(i % 3, 4)], "from_id int, to_id int")
    plan = graph.bibliographic_coupling(edges, k=4)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_intersect") == 1
