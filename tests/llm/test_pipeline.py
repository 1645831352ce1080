"""The pipeline against a brute-force version of its later stages."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from paperloom.llm import mixing  # noqa: E402
from tests.llm.test_llm import brute_components, repeated_bytes  # noqa: E402


def test_pipeline(spark, tables):
    docs, seen = spark.read.parquet(f"{tables}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.orderBy("doc_id").collect()
        made = stage(spark, docs, tables)
        docs = spark.createDataFrame(made.collect(), made.schema)
        seen[name] = (before, docs.collect())
    before, after = seen["language"]
    assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before} and len(after) >= 0.97 * len(before)
    before, after = seen["near_duplicates"]
    root = brute_components([r["text"] for r in before], k=5, percent=80)
    assert sorted(r["doc_id"] for r in after) == [r["doc_id"] for i, r in enumerate(before) if root[i][1] == i]
    before, after = seen["substrings"]
    texts = [r["text"].encode() for r in before]
    want = {}
    for r, text, gone in zip(before, texts, repeated_bytes(texts, corpus_pipeline.REPEAT_BYTES, "first")):
        want[r["doc_id"]] = bytes(b for b, g in zip(text, gone) if not g)
    assert {r["doc_id"]: r["text"] for r in after} == {k: v.decode(errors="replace") for k, v in want.items()}
    before, after = seen["mix"]
    mixed = {r["doc_id"]: r["copies"] for r in mixing.systematic_mix(spark.createDataFrame(before)).collect()}
    assert len(after) == sum(mixed.values())
    before, after = seen["tokens"]
    text = {r["doc_id"]: r["text"] for r in before}
    assert len(after) == len(before) and all(r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest() for r in after)


def test_run_returns_the_last_stage(spark, tables):
    assert corpus_pipeline.run(spark, tables).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "offsets"]


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
BASE = " ".join(f"word{i}" for i in range(120))
OTHER = " ".join(f"ander{i}" for i in range(90))
ODD = [
    (5, BASE, "en", "s1", 1), (5, OTHER, "en", "s2", 1), (7, BASE + " tail", "en", None, 1), (None, OTHER + " end", "de", "s1", 1), (None, BASE + " null id", None, "s1", 1), (9, None, "en", "s1", None),
    (10, "", "fr", None, 0), (11, " \n\t", "fr", "s1", 3), (12, "12 34 !!", None, "s2", 8), (13, "kurz", "de", "s2", 4), (13, "kurz", "de", "s2", 4), (13, "kurz", None, "s2", 4), (14, "y" * 900, "en", "s1", 900),
]
CLASHES = ("key", "doc", "kept", "size", "copies", "taken", "ids", "offsets", "score", "lang_pred", "held_out", "label", "node", "root", "name")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit("x") for c in CLASHES}).repartition(3)


def rows_of(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_an_empty_table(spark, tables, stage):
    made = dict(corpus_pipeline.STAGES)[stage](spark, spark.createDataFrame([], SCHEMA), tables)
    assert made.collect() == [] and (stage == "tokens" or made.columns == corpus_pipeline.COLUMNS)


def test_language_on_odd_rows(spark, tables, odd, monkeypatch):
    some = spark.read.parquet(f"{tables}/documents.parquet").select("text", "lang").where("length(text) > 200").limit(120).collect()
    more = [(100 + i, r["text"], r["lang"], "s1", 1) for i, r in enumerate(some)]
    docs = odd.select(*corpus_pipeline.COLUMNS).union(spark.createDataFrame(more, SCHEMA)).withColumns({c: F.lit("x") for c in CLASHES})
    made = corpus_pipeline.language(spark, docs, tables)
    assert made.columns == corpus_pipeline.COLUMNS
    got = rows_of(made)
    # what has no letter goes; repeats are judged each by its text
    assert not any(t is None or not any(c.isalpha() for c in t) for _, t in got) and got[13, "kurz"] in (0, 3)
    assert sum(got[d, t] for d, t, *_ in more) >= 0.95 * len(more)


def test_near_duplicates_on_odd_rows(spark, tables, odd):
    made = corpus_pipeline.near_duplicates(spark, odd, tables)
    assert made.columns == corpus_pipeline.COLUMNS
    # of a group the smallest id stays, a null one only among nulls; of equal rows one stays; texts without a word stay
    want = {(5, BASE), (5, OTHER), (9, None), (10, ""), (11, " \n\t"), (12, "12 34 !!"), (13, "kurz"), (14, "y" * 900)}
    assert rows_of(made) == Counter(want)
    assert [tuple(r) for r in made.where("doc_id = 13").collect()] == [(13, "kurz", None, "s2", 4)]


def test_substrings_on_odd_rows(spark, tables, odd):
    made = corpus_pipeline.substrings(spark, odd, tables)
    assert made.columns == corpus_pipeline.COLUMNS and made.count() == len(ODD)
    before = [(-(2**63) if d is None else d, (t or "").encode()) for d, t, *_ in ODD]
    order = sorted({x for x in before})  # rows that agree in doc_id and text are one document
    gone = repeated_bytes([t for _, t in order], corpus_pipeline.REPEAT_BYTES, "first")
    cut = {x: bytes(b for b, g in zip(x[1], flags) if not g).decode() for x, flags in zip(order, gone)}
    got = Counter((-(2**63) if r["doc_id"] is None else r["doc_id"], r["text"], r["n_chars"]) for r in made.collect())
    same_first = Counter((d, cut[d, t], len(cut[d, t])) for d, t in before)
    assert sum(got.values()) == sum(same_first.values()) and {k[0] for k in got} == {k[0] for k in same_first}
    lone = {k for k in same_first if sum(d == k[0] for d, _ in order) == 1}  # of texts under one id either may come first
    assert all(got[k] == same_first[k] for k in lone)


def test_mix_and_tokens_on_odd_rows(spark, tables, odd):
    made = corpus_pipeline.mix(spark, odd, tables)
    assert made.columns == corpus_pipeline.COLUMNS
    copies = Counter()
    for r in mixing.systematic_mix(odd).collect():
        copies[r["doc_id"], r["text"]] += r["copies"]
    assert rows_of(made) == +copies and rows_of(made) == rows_of(corpus_pipeline.mix(spark, odd.repartition(5), tables))
    tokens = corpus_pipeline.tokens(spark, odd, tables)
    assert tokens.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "offsets"]
    want = Counter((d, hashlib.sha256((t or "").encode()).hexdigest()) for d, t, *_ in ODD)
    assert Counter((r["doc_id"], r["decoded_sha256"]) for r in tokens.collect()) == want
