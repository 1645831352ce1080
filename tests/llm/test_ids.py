"""Joins by similarity where ids are null or stand for several different rows, against brute force."""

import math
import random
import re

import pytest

from paperloom.llm import embedding_join, jaccard_join


def components(n, linked, ids):
    """Smallest id that each of n items reaches; None where none has one."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                root[find(i)] = find(j)
    names = {}
    for i in range(n):
        if ids[i] is not None:
            names[find(i)] = min(names.get(find(i), ids[i]), ids[i])
    return [names.get(find(i)) for i in range(n)]


def key(row):
    return tuple((x is not None, x) for x in row)


@pytest.mark.parametrize("block", [600, 4])
def test_texts_under_one_id_and_without_one(spark, block):
    rng = random.Random(2)
    prose = lambda n: " ".join(rng.choice("abcdefghijklmnop") + rng.choice("qrstuvwxyz") for _ in range(n))
    a, b, c = prose(200), prose(200), prose(200)
    rows = [(5, a), (5, b), (7, a + " x"), (None, b + " y"), (9, b + " y z"), (None, c), (None, c + " w"), (None, c), (5, c + " v v"), (5, a), (2, None), (None, ""), (None, "one two"), (None, "One two"), (3, "lone"), (3, "lonely")]
    rows += [(20 + i % 3, prose(3) + " " + a) for i in range(6)] + [(40, "only null ids " * 3)] + [(None, b + f" tail {i}") for i in range(4)]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"), block=block).collect()

    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()

    sets = [shingles(t) for _, t in rows]
    link = lambda i, j: bool(sets[i]) and bool(sets[j]) and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])
    names = components(len(rows), link, [d for d, _ in rows])
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=key) == sorted(((d, len(s), m) for (d, _), s, m in zip(rows, sets, names)), key=key)
    assert len(rows) == len(got)


@pytest.mark.parametrize("block", [8000, 3])
def test_vectors_under_one_id_and_without_one(spark, block):
    turn = lambda x, label="a": ([math.cos(x), math.sin(x), 0.0], label)
    rows = [(1, *turn(0)), (None, *turn(0.15)), (3, *turn(0.30)), (None, *turn(2.0)), (None, *turn(2.1)), (4, *turn(1.0)), (4, *turn(3.0)), (6, *turn(1.05)), (2, *turn(3.1)), (None, None, "a"), (None, *turn(2.0)), (8, *turn(0.1, None)), (5, *turn(0.15, "b"))]
    got = embedding_join.metric_join(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label string"), cell=2, block=block).collect()
    alike = lambda i, j: None not in (rows[i][1], rows[j][1], rows[i][2]) and rows[i][2] == rows[j][2] and sum(x * y for x, y in zip(rows[i][1], rows[j][1])) >= 0.98
    names = components(len(rows), alike, [r[0] for r in rows])
    links = [sum(alike(i, j) for j in range(len(rows)) if i != j) for i in range(len(rows))]
    want = [(r[0], n, m, r[0] == m if r[0] is not None else m is None) for r, n, m in zip(rows, links, names)]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
