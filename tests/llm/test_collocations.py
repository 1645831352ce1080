"""op13: tiles against a dictionary, phrases against counting all of them, the query against its SQL."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paperloom.llm import collocations
from paperloom.llm import queries as llm
from tests.oracle import same


def test_tiles_and_coordinates_count_alike():
    rng = np.random.default_rng(4)
    for n, most in ((0, 1), (1, 5), (5000, 40), (20000, 600), (3000, 40_000), (4000, 1 << 38)):
        a, b = ((most ** rng.random((2, n))).astype(np.int64) - 1) if n else np.zeros((2, 0), dtype=np.int64)
        for dense in (1, 50, 10**9):
            number, x, y, count = collocations.count_pairs(a, b, dense)
            want = collections.Counter(zip(a.tolist(), b.tolist()))
            assert dict(zip(zip(x.tolist(), y.tolist()), count.tolist())) == want and len(x) == len(want)
            assert (x[number] == a).all() and (y[number] == b).all()


def by_counting(rows, least, longest, top, percent):
    f, total = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        raw = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", raw):
            w = re.findall(rb"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = {p for q, fq in candidates.items() for k in range(2, len(q)) for i in range(len(q) - k + 1) if 100 * fq >= percent * counts[p := q[i : i + k]]}
        rows = []
        for p, a in candidates.items():
            if p not in inside:
                score, _, left, right = min((1000 * a * total[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, b" ".join(p), left, right))
        out += [(lang, i + 1, p.decode(), -a, x, y, total[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def test_known_pairs_of_one_hash(monkeypatch):
    monkeypatch.setattr(collocations.KnownPairs, "hash", staticmethod(lambda a, b: (a % 3).astype(np.uint64)))
    rng = np.random.default_rng(1)
    pairs = np.unique(rng.integers(0, 9, (40, 2)), axis=0)
    known = collocations.KnownPairs(pa.table({"a": pairs[:, 0], "b": pairs[:, 1], "id": np.arange(len(pairs)) + 5}))
    asked = rng.integers(0, 9, (200, 2))
    got = known.find(pa.record_batch({"a": pa.array([asked[:, 0]]), "b": pa.array([asked[:, 1]])}), 0)
    want = {tuple(p): i + 5 for i, p in enumerate(pairs.tolist())}
    assert got.tolist() == [want.get(tuple(p), -1) for p in asked.tolist()]


@pytest.mark.parametrize(("chunk", "known"), [(1 << 21, 1 << 18), (300, 4)])
def test_phrases(spark, chunk, known):
    rng = random.Random(8)
    vocabulary = [w.title() if i % 5 else w for i, w in enumerate("la le été new york city of and the x ß 日本 a-b it's".split())]
    prose = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" "] * 9 + [", ", "\t", ". ", "\n", "  ", "!?"]) for _ in range(n))
    rows = [(rng.choice(["en", "fr", None, "und", ""]), prose(rng.randint(0, 60))) for _ in range(120)]
    rows += [("en", None), ("en", ""), (None, " \t.,"), ("fr", "new york city " * 40), ("en", "New York city stock market. " * 30), ("de", "a a a a a a a " * 5), ("en", prose(900)), ("en", ("x" * 70 + " y ") * 9)]
    rows += rows[:10]
    df = spark.createDataFrame(rows, "lang string, text string").withColumn("n", F.lit("x")).withColumn("id", F.lit("x")).withColumn("chunk", F.lit("x")).repartition(3)
    for least, longest, top, percent in ((6, 5, 2000, 100), (3, 4, 7, 80), (4, 2, 50, 100)):
        got = sorted(map(tuple, collocations.collocations(df, least, longest, top, percent, chunk, known).collect()))
        assert got == by_counting(rows, least, longest, top, percent)


def test_products_beyond_64_bits_and_no_rows(spark):
    rows = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(rows).collect() == []
    assert collocations.collocations(spark.createDataFrame([("en", "one two"), (None, None)], rows.schema)).collect() == []
    a, n, x, y = 9 * 10**12 + 7, 8 * 10**13 + 3, 9 * 10**12 + 11, 10**13 + 9
    wide = lambda v: F.lit(v).cast("decimal(20,0)")
    score = F.call_function("div", wide(a) * wide(n) * F.lit(1000).cast("decimal(4,0)"), wide(x) * wide(y))
    assert spark.range(1).select(score).first()[0] == 1000 * a * n // (x * y)


def test_query(spark):
    tables = "/root/testdata/sf0.01"
    same(llm.QUERIES["op13_phrase_tiles"](spark, tables), llm.ORACLE_SQL["op13_phrase_tiles"], tables)


def test_chunks_are_read_a_few_at_a_time(spark, monkeypatch):
    name = "spark.sql.parquet.columnarReaderBatchSize"
    before, made, seen = spark.conf.get(name), collocations.pair_chunks, []
    monkeypatch.setattr(collocations, "pair_chunks", lambda *a: (seen.append(int(spark.conf.get(name))), made(*a))[1])
    docs = spark.createDataFrame([(i, "one two three. one two", None) for i in range(40)], "doc_id long, text string, lang string")
    tables = collocations.phrase_tables(docs, least=30, longest=3, chunk=64)  # a row for each text or two
    assert seen and max(seen) * collocations.CHUNK <= 1 << 22 and spark.conf.get(name) == before
    assert [sorted((r["words"], r["f"]) for r in t.collect()) for t in tables[1:]] == [[(["one", "two"], 80), (["two", "three"], 40)], [(["one", "two", "three"], 40)]]
