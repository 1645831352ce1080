"""The training-data operators on small hard cases: nulls, empty and long texts, repeats, ties, empty tables, other columns."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from paperloom.llm import bpe, components, embedding_join, jaccard_join, language_id, mixing, quality, recompression, repeats, shards, suffix_dedup, toxicity, words
from paperloom.llm import queries as llm
from tests.oracle import same

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def docs_of(spark, texts, extra=False):
    rows = [(i, t, "en" if i % 2 else None, ["s1", "s2", None][i % 3], len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("x") for c in ("size", "kept", "ids", "doc", "name", "score", "text_crc32", "shard")}) if extra else df


@pytest.fixture(scope="module")
def corpus():
    """Texts with exact copies, near copies, shared passages, repeats within a text, and odd ones."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, base = prose(90), prose(200)
    texts = [prose(rng.randint(1, 150)) for _ in range(30)]
    texts += [base] * 3 + [base + " tail", base.replace(" ", "\n", 3), base.upper()]
    texts += [prose(40) + " " + passage + " " + prose(30) for _ in range(5)]
    texts += [("la " * 300).strip(), "x" * 2000, passage + " | " + passage, None, "", " \n\t ", "one", "one two", "One TWO", "日本語 テスト 👍🏽 don't we'll", prose(6000)]
    return texts


def test_slices_follow_the_pattern():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    texts = ["".join(rng.choice("aab'' strevlmd19 \n\t é!?日\U0001f600\x1c") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["", "x" * 3000, "ab" * 2000, " " * 300, "'s's're'll", "a b " * 3000]
    t = bpe.Tokenizer(open(VOCABULARY, "rb").read(), remembered=500)
    assert list(t.encode_all(texts, most=5000)) == [reference.encode_ordinary(x) for x in texts]
    assert t.offsets([]).tolist() == [0] and t.decode([], t.offsets([])) == b""
    for text in texts[::50]:
        ids, raw = reference.encode_ordinary(text), text.encode()
        at = t.offsets(ids)
        assert t.decode(ids, at) == t.decode(ids, at, most=3) == raw and at[-1] == len(raw)
        a, b = sorted(rng.randint(0, len(raw)) for _ in range(2))
        assert t.stretch(ids, at, a, b) == raw[a:b]


def test_near_duplicates_take_short_batches(spark, monkeypatch):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, components_of, seen = spark.conf.get(name), jaccard_join._components, []
    monkeypatch.setattr(jaccard_join, "_components", lambda *a: (seen.append(spark.conf.get(name)), components_of(*a))[1])
    df = spark.createDataFrame([(i, "one two three four five") for i in range(3)], "doc_id long, text string")
    found = jaccard_join.jaccard_components(df)
    assert seen == ["1000"] and spark.conf.get(name) == before
    assert "Arrow" not in found._jdf.queryExecution().optimizedPlan().toString() and [r["component_id"] for r in found.collect()] == [0, 0, 0]


def test_merges_side_by_side():
    t, rng = bpe.Tokenizer(open(VOCABULARY, "rb").read()), random.Random(3)
    pieces = [bytes(rng.choice(rng.choice([b"ab", b"the ing", bytes(range(256))])) for _ in range(rng.randint(1, 90))) for _ in range(3000)] + [b"a" * n for n in range(1, 70)]
    assert t.merge_all(pieces) == [t.merge(p) for p in pieces] and t.merge_all([]) == []
    t.encode_batch(["some words of a text"])
    t.forget()
    assert not t.seen and t.held == 0


def test_round_trip_encode_decode(spark, corpus):
    df = docs_of(spark, corpus, extra=True)
    got = {r["doc_id"]: r for r in bpe.round_trip(df, VOCABULARY, with_ids=True).collect()}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, text in enumerate(corpus):
        ids = reference.encode_ordinary(text or "")
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
        assert got[i]["offsets"] == [0, *np.cumsum([len(reference.decode_single_token_bytes(x)) for x in ids]).tolist()]
    back = {r["doc_id"]: r for r in bpe.decode(bpe.encode(df, VOCABULARY), VOCABULARY).collect()}
    assert all(back[i]["text"] == (t or "") and back[i]["size"] == "x" for i, t in enumerate(corpus))


def repeated_bytes(texts, length, keep):
    places = collections.defaultdict(list)
    for d, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            places[t[i : i + length]].append((d, i))
    gone = [np.zeros(len(t), dtype=bool) for t in texts]
    for found in places.values():
        if len(found) > 1:
            for d, i in found if keep == "none" else found[1:]:
                gone[d][i : i + length] = True
    return gone


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("crowd", [2000, 1])
def test_suffix_dedup(spark, corpus, keep, crowd):
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs_of(spark, corpus, extra=True), length=80, core=40, keep=keep, crowd=crowd, block_bytes=4000).collect()}
    texts = [(t or "").encode() for t in corpus]
    for i, gone in enumerate(repeated_bytes(texts, 80, keep)):
        spans = int(np.count_nonzero(np.diff(gone, prepend=False) & gone)) if len(gone) else 0
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"]) == (len(texts[i]), int(gone.sum()), spans)
        assert bytes(got[i]["kept"]) == np.frombuffer(texts[i], dtype=np.uint8)[~gone].tobytes()


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("heavy", [2000, 1])
def test_crowds_are_parted_before_their_windows(spark, monkeypatch, keep, heavy):
    counts, compare = [], suffix_dedup.equal_windows
    monkeypatch.setattr(suffix_dedup, "equal_windows", lambda rows, how: (counts.append(rows.count()), compare(rows, how))[1])
    rng = random.Random(7)
    passage, other = ("".join(rng.choice("abcdefgh ") for _ in range(300)) for _ in range(2))
    around = lambda: "".join(rng.choice("stuvwxyz ") for _ in range(90))
    texts = [around() + p + around() for _ in range(60) for p in (passage, other)] + [around() + passage[40:] + other[:150]]
    docs = docs_of(spark, texts)
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(docs.union(docs.where("doc_id % 7 = 0")), length=160, core=40, keep=keep, crowd=20, heavy=heavy).collect()}
    raw = [t.encode() for i, t in enumerate(texts) for _ in range(1 + (i % 7 == 0 and keep == "none"))]
    ids = [i for i in range(len(texts)) for _ in range(1 + (i % 7 == 0 and keep == "none"))]
    assert got == {i: int(g.sum()) for i, g in zip(ids, repeated_bytes(raw, 160, keep))}
    assert len(counts) == 1 and (heavy == 1 or counts[0] < 10_000)  # all windows of the crowds are 31,555 and 25,141


@pytest.mark.parametrize("keep", ["none", "first"])
def test_windows_of_small_crowds_are_no_rows(spark, monkeypatch, keep):
    """Parts that few others share a name with are judged in blocks, lone ones not at all, though their stretches were dealt to many tasks."""
    counts, compare = [], suffix_dedup.equal_windows
    monkeypatch.setattr(suffix_dedup, "equal_windows", lambda rows, how: (counts.append(rows.count()), compare(rows, how))[1])
    rng = random.Random(11)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(300))
    around = lambda: "".join(rng.choice("stuvwxyz ") for _ in range(90))
    texts = [around() + passage + around() for _ in range(60)]
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(docs_of(spark, texts), length=160, core=40, keep=keep, crowd=20, heavy=59).collect()}
    assert got == {i: int(g.sum()) for i, g in enumerate(repeated_bytes([t.encode() for t in texts], 160, keep))}
    assert len(counts) == 1 and counts[0] < 1500


@pytest.mark.parametrize("keep", ["none", "first"])
def test_equal_in_gives_runs(keep):
    h, doc, begin = np.array([5, 6, 7, 5, 6, 8, 5]), np.array([1, 1, 1, 2, 2, 2, 3]), np.array([10, 11, 12, 40, 41, 42, 0])
    doc, key, at = repeats.equal_in([h, h, doc, doc * 0, repeats.pack(begin, np.ones(7, dtype=np.int64))], keep)
    assert list(zip(doc.tolist(), *(x.tolist() for x in repeats.unpack(at)))) == [(1, 10, 2)][: keep == "none"] + [(2, 40, 2), (3, 0, 1)]
    h, begin = np.zeros(1200, dtype=np.int64), np.arange(1200)
    _, _, at = repeats.equal_in([h, h, h, h, repeats.pack(begin, np.ones(1200, dtype=np.int64))], keep)
    assert repeats.unpack(at)[1].tolist() == ([511, 511, 178] if keep == "none" else [511, 511, 177])


def test_longest_previous_factors():
    rng = random.Random(2)
    data = np.frombuffer("".join(rng.choice("ab") for _ in range(400)).encode(), dtype=np.uint8)
    starts = np.arange(len(data) - 16)
    factor, source = suffix_dedup.longest_previous_factors(data, starts, 16)
    raw = data.tobytes()
    for i in starts.tolist():
        best = max((next((k for k in range(16) if raw[i + k] != raw[j + k]), 16) for j in range(i)), default=0)
        assert factor[i] == best // 8 * 8
        if factor[i]:
            assert source[i] < i


def repeated_words(texts, width, keep):
    split = [WORD.findall(t) for t in texts]
    places = collections.defaultdict(list)
    for d, w in enumerate(split):
        for i in range(len(w) - width + 1):
            places[tuple(w[i : i + width])].append((d, i))
    gone = [[False] * len(w) for w in split]
    for found in places.values():
        if len(found) > 1:
            for d, i in found if keep == "none" else found[1:]:
                gone[d][i : i + width] = [True] * width
    return split, gone


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("rounds", [0, 2, 4])
def test_recompression(spark, corpus, keep, rounds):
    texts = [(t or "").encode() for t in corpus]
    got = {r["doc_id"]: r for r in recompression.remove_repeats(docs_of(spark, corpus, extra=True), width=12, keep=keep, rounds=rounds).collect()}
    for i, (w, gone) in enumerate(zip(*repeated_words(texts, 12, keep))):
        assert (got[i]["n_words"], got[i]["n_removed"]) == (len(w), sum(gone))
        assert got[i]["kept"].encode() == b" ".join(x for x, g in zip(w, gone) if not g)


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("both", [True, False])
@pytest.mark.parametrize("batch", [1, 3, 10_000])
def test_runs_of_a_name_meet(spark, keep, both, batch):
    rng = random.Random(3)
    rows = [(rng.choice([7, 8, 9]), rng.randint(0, 30), d, 5, 1) for d in range(100)]
    rows += [(100 + i, 1, i, 5, 1) for i in range(50)] + [(99, 4, 1, 5, 1), (99, 4, 2, 5, 1)]
    rows += rows[::9] if keep == "first" else []  # rows given twice are one
    runs = spark.createDataFrame(rows, "name bigint, seg bigint, doc bigint, key bigint, at bigint")
    rows = sorted(set(rows))
    segs, names = collections.defaultdict(list), collections.defaultdict(set)
    for r in rows:
        segs[r[:2]].append(r)
        names[r[0]].add(r[1])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        for hot in ([], [7, 99]):
            got = repeats.meet(runs, keep, hot, both, salts=4).collect()
            assert len({(r["name"], r["doc"], r["at"]) for r in got}) == len(got)
            found = {(r["name"], r["doc"]): (r["gone"], r["check"]) for r in got}
            for (name, _), same in segs.items():
                told = [found.get((name, r[2]), (False, False)) for r in same]
                if name in hot:
                    assert sum(c for _, c in told) >= 1 and all(g or c for g, c in told)
                elif both:
                    assert told == [(False, len(names[name]) > 1 or len(same) > 1)] + [(False, True)] * (len(same) > 1) + [(True, False)] * (len(same) - 2)
                else:
                    assert told == [(keep == "none" and len(same) > 1, len(names[name]) > 1)] + [(True, False)] * (len(same) - 1)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("batch", [2, 10_000])
@pytest.mark.parametrize("hot", [False, True])
def test_repeats_end_to_end(spark, corpus, monkeypatch, keep, batch, hot):
    if hot:  # every name in pieces
        for module in (suffix_dedup, recompression):
            monkeypatch.setattr(module, "hot_names", lambda docs, runs_of: [r["name"] for r in runs_of(docs).select("name").distinct().limit(300).collect()])
        monkeypatch.setattr(words, "GROUP", 3000)
        monkeypatch.setattr(words.text_groups, "__defaults__", (3000,))
        monkeypatch.setattr(suffix_dedup.pieces, "__defaults__", (3000,))
        monkeypatch.setattr(recompression.pieces, "__defaults__", (500,))
    rng = random.Random(12)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [f"{rng.random()} {passage} {rng.random()}" for _ in range(20)] + corpus[25:40] + [corpus[-1]]
    docs = docs_of(spark, texts)
    docs = docs.union(docs.where("doc_id % 4 = 0"))  # rows given twice: one document under 'first', copies under 'none'
    order = list(range(len(texts))) + [i for i in range(len(texts)) if i % 4 == 0 and keep == "none"]
    raw = [(texts[i] or "").encode() for i in order]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        by_bytes = suffix_dedup.remove_repeats(docs, length=80, core=40, keep=keep).collect()
        by_words = recompression.remove_repeats(docs, width=12, keep=keep).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(by_bytes) == len(by_words) == docs.count()
    want = {i: int(gone.sum()) for i, gone in zip(order, repeated_bytes(raw, 80, keep))}
    assert [(r["doc_id"], r["n_removed"]) for r in by_bytes if r["n_removed"] != want[r["doc_id"]]] == []
    want = {i: sum(gone) for i, gone in zip(order, repeated_words(raw, 12, keep)[1])}
    assert [(r["doc_id"], r["n_removed"]) for r in by_words if r["n_removed"] != want[r["doc_id"]]] == []


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))


def test_strings_whose_sums_agree(spark):
    one, two = thue_morse(4096)
    short = [thue_morse(n) for n in (64, 512, 2048)]
    texts = [one, two, " ".join([one] * 40), " ".join([two] * 40), *(" ".join([x[i]] * 3 + [str(j) for j in range(9)]) for x in short for i in (0, 1))]
    raw, docs = [t.encode() for t in texts], docs_of(spark, texts)
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs, length=400).collect()}
    assert [got[i]["n_removed"] for i in range(len(texts))] == [int(g.sum()) for g in repeated_bytes(raw, 400, "none")]
    got = {r["doc_id"]: r for r in recompression.remove_repeats(docs).collect()}
    assert [got[i]["n_removed"] for i in range(len(texts))] == [sum(g) for g in repeated_words(raw, 35, "none")[1]]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == dict(enumerate(brute_components(texts)))
    mixed = " ".join([*[one, two] * 5, "end"])
    assert quality.quality_features(docs_of(spark, [mixed])).first()["n_repeat_words"] == 10


def test_null_and_repeated_ids(spark, corpus):
    texts = corpus[30:36] + corpus[36:40] + [corpus[36]]
    rows = [(None if i % 2 else 7, t, None, None, 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA)
    raw = [(t or "").encode() for t in texts]
    gone = [int(g.sum()) for g in repeated_bytes(raw, 80, "none")]
    got = suffix_dedup.remove_repeats(docs, length=80, core=40).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"]) for r in got) == sorted((str(r[0]), len(t), g) for r, t, g in zip(rows, raw, gone))
    got = recompression.remove_repeats(docs, width=12).collect()
    split, flags = repeated_words(raw, 12, "none")
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in got) == sorted((str(r[0]), len(w), sum(g)) for r, w, g in zip(rows, split, flags))
    # near copies that only documents without a doc_id link: 1 - null - 2
    base = [f"w{i}" for i in range(100)]
    chain = [" ".join(base[:a] + [f"x{j}" for j in range(b)] + base[a + b :]) for a, b in ((0, 0), (0, 3), (0, 6))]
    docs = spark.createDataFrame([(5, chain[0], None, None, 0), (None, chain[1], None, None, 0), (3, chain[2], None, None, 0), (None, "alone here now", None, None, 0), (None, "alone here now", None, None, 0)], SCHEMA)
    got = jaccard_join.jaccard_components(docs).collect()
    want = [x[1] for x in brute_components(chain)]
    assert want == [0, 0, 0] and sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in got) == sorted([("5", "3", False), ("None", "3", False), ("3", "3", True), ("None", "None", True), ("None", "None", True)])


@pytest.mark.parametrize("keep", ["none", "first"])
def test_equal_windows_over_partitions(spark, keep):
    rows = [(h, 0, d, 9, 1) for h in range(5) for d in range(1 if h == 3 else 400)]
    df = spark.createDataFrame(rows, "h1 bigint, h2 bigint, doc bigint, key bigint, at bigint").withColumn("at", F.col("h1") * 512 + 1)
    got = collections.Counter((r["doc"], r["at"]) for r in repeats.equal_windows(df, keep).collect())
    want = {(d, h * 512 + 1) for h in (0, 1, 2, 4) for d in range(400) if keep == "none" or d}
    assert set(got) == want and set(got.values()) == {1}


def brute_components(texts, k=3, percent=90):
    low = [bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()) for t in texts]
    sets = []
    for t in low:
        w = WORD.findall(t)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(sets)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("block", [1000, 4])
def test_jaccard_components(spark, corpus, block):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    family = []
    for _ in range(40):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(99)}"
        family.append(" ".join(w))
    texts = corpus + family
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs_of(spark, texts, extra=True), block=block).collect()}
    assert got == dict(enumerate(brute_components(texts)))


@pytest.mark.parametrize("percent", [80, 90])
def test_sketches_leave_no_pair_out(percent):
    rng = np.random.default_rng(8)
    sets = []
    for n in [1, 2, 3, 9, 10, 31, 32, 33, 60, 64, 70, 300, 5000] * 6:
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        sets += [a, np.unique(np.append(rng.permutation(a)[: len(a) - len(a) // 11], rng.integers(0, 2**63, n // 12).astype(np.uint64)))]
    root, sizes = jaccard_join.reach_sketches(np.array([len(s) for s in sets]), [jaccard_join.sketch(s) for s in sets], percent), list(map(len, sets))
    links = [(i, j) for i, s in enumerate(sets) for j, t in enumerate(sets[:i]) if 100 * len(both := np.intersect1d(s, t)) >= percent * (len(s) + len(t) - len(both))]
    assert len(links) > 20 and all(root[i] == root[j] for i, j in links) and len(set(root)) > 60
    classes = np.searchsorted(jaccard_join.size_classes(percent), sizes, "right")
    assert all(abs(classes[i] - classes[j]) <= 1 for i, j in links)


@pytest.mark.parametrize("piece", [4000, 5])
def test_crowds_are_parted_before_their_texts_are_sent(spark, monkeypatch, piece):
    """Texts of one common phrase are one family, few of them are near copies: pieces of six sets would have each text sent once a piece."""
    rng, sent = random.Random(12), []
    phrase, tail = " ".join(f"p{i}" for i in range(12)), lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    texts = [f"{phrase} {tail(rng.randint(2, 14))}" for _ in range(80)]
    texts += [f"{phrase} {x} {y}" for x in (tail(20), tail(12)) for y in ("", "a", "b")]
    parted = jaccard_join.parted_crowds
    monkeypatch.setattr(jaccard_join, "parted_crowds", lambda texts, crowds, *a: (sent.append((crowds.count(), (found := parted(texts, crowds, *a)).count())), found)[1])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs_of(spark, texts), block=6, piece=piece).collect()}
    assert got == dict(enumerate(brute_components(texts))) and len(set(c for _, c in got.values())) < 83
    assert len(sent) == 1 and sent[0][0] > 40 and sent[0][1] < sent[0][0] // 2


@pytest.mark.parametrize("percent", [80, 90])
def test_leading_shingles_leave_no_pair_out(percent):
    rng = np.random.default_rng(4)
    for _ in range(400):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        drop, add = int(rng.integers(0, 1 + n // 8)), int(rng.integers(0, 1 + n // 8))
        b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, add).astype(np.uint64)]))
        common = np.unique(np.concatenate([a[::3], b[::7]]))
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= percent * (len(a) + len(b) - both):
            x, y = (jaccard_join.leading(s, percent, common).tolist() for s in (a, b))
            others = set(rng.choice(x, len(x) // 3).tolist())  # a third set has these as well
            shared = set(x) & set(y) | others
            x, y = (jaccard_join.emitted(len(s), percent, [t for t in lead if t in shared or t >= 1 << 62]) for s, lead in ((a, x), (b, y)))
            assert set(x) & set(y)


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (103, 102), (102, 101), (7, 7)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 51)}, 101: 100, 102: 100, 103: 100}


@pytest.mark.parametrize("block", [40, 8000])
def test_metric_join(spark, block):
    rng = np.random.default_rng(7)
    centre = rng.standard_normal((12, 16))
    rows = []
    for i in range(260):
        v = centre[rng.integers(12)] + 0.08 * rng.standard_normal(16)
        rows.append((i, [float(x) for x in np.float32(v)], int(rng.integers(2)) if i % 40 else None))
    rows += [(260 + i, list(rows[1][1]), rows[1][2]) for i in range(6)]
    rows += [(300, None, 1), (301, [], 1), (302, [0.0] * 16, 1), (303, [float("nan")] * 16, 1), (304, [None] + [1.0] * 15, 1), (305, [float("inf")] * 16, 1), (306, [1.0, 2.0], 1), (307, [2.0, 4.0], 1), (308, [-0.0, 1.0], 1), (309, [0.0, 1.0], 1)]
    for i in range(60):  # another length, with cells of its own
        v = centre[rng.integers(3)][:9] + 0.05 * rng.standard_normal(9)
        rows.append((400 + i, [float(x) for x in v], int(rng.integers(2))))
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumn("cell", F.lit(1)).withColumn("node", F.lit("x"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_join.metric_join(df, cell=10 + 20 * (block == 40), block=block).collect()}
    usable = {i: np.array(v, dtype=float) for i, v, label in rows if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    label = {i: x for i, _, x in rows}
    links, root = collections.Counter(), {i: i for i, _, _ in rows}
    find = lambda x: x if root[x] == x else find(root[x])
    ids = sorted(usable)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            x, y = usable[i], usable[j]
            if label[i] == label[j] and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert got == {i: (links[i], find(i), find(i) == i) for i in root}


def test_gradients_by_differences():
    rng = np.random.default_rng(1)
    layer = language_id.Layer(3, rng)
    for k in layer.weights:
        layer.weights[k] = layer.weights[k].astype(np.float64)
    steps, pull = rng.integers(0, 5, (6, 4)), rng.standard_normal((6, 4, 3))
    loss = lambda: float((layer.run(steps)[0].astype(np.float64) * pull).sum())
    out, tape = layer.run(steps, keep=True)
    grads = layer.grad(steps, tape, pull)
    for name, at in (("x", (2, 4)), ("u", (1, 5)), ("u", (0, 0)), ("x", (1, 7))):
        w, e = layer.weights[name], 1e-2
        w[at] += e
        up = loss()
        w[at] -= 2 * e
        down = loss()
        w[at] += e
        assert abs((up - down) / (2 * e) - grads[name][at]) < 0.02


def test_language(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "", "en", "s", 0), (9003, "123 !!", None, "s", 0), (9004, "the and of", None, None, None), (None, "the and", "en", "s", 1)], SCHEMA)
    rows = docs.union(odd).union(odd.where("doc_id = 9004")).withColumn("score", F.lit("old")).withColumn("_x", F.lit(1))
    told = language_id.identify(rows, language_id.train_network(rows, passes=150)).collect()
    assert len(told) == docs.count() + 6
    by = {r["doc_id"]: r for r in told}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (9001, 9002, 9003)) and by[9004]["lang_pred"] == "en"
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in told)
    held = [r for r in told if r["held_out"] and r["lang"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.93 * len(held)


def byte_model(texts, discount=1.0):
    """Two Kneser-Ney models by the formula: {string of 3 to 5 bytes: (P toxic, P ordinary)} of (text, toxic) pairs."""
    sides = [collections.Counter(), collections.Counter()]
    for text, toxic in texts:
        padded = "    " + text + " "
        sides[toxic].update({padded[i : i + 5] for i in range(len(padded) - 4)})
    low = min(sum(c.values()) for c in sides)
    own = {5: [{g: n * low / sum(c.values()) for g, n in c.items()} for c in sides]}
    for k in (4, 3):
        own[k] = [collections.Counter(), collections.Counter()]
        for c, more in zip(own[k], own[k + 1]):
            for g, n in more.items():
                c[g[1:]] += n
    levels, strings = {}, {g for c in own[3] for g in c}
    for k in (2, 1):
        levels[k] = collections.Counter(g[1:] for g in strings)
        strings = set(levels[k])

    def shared(g):
        if not g:
            return 1 / 256
        after = {h: n for h, n in levels[len(g)].items() if h[:-1] == g[:-1]}
        return (levels[len(g)][g] - 0.75 + 0.75 * len(after) * shared(g[1:])) / sum(after.values())

    def p(g, toxic):
        if len(g) == 2:
            return shared(g)
        after = {h: n for h, n in own[len(g)][toxic].items() if h[:-1] == g[:-1]}
        lower = p(g[1:], toxic)
        if not after:
            return lower
        left = sum(min(n, discount) for n in after.values())
        return (max(after.get(g, 0) - discount, 0) + left * lower) / sum(after.values())

    return {g: (p(g, 1), p(g, 0)) for k in own for c in own[k] for g in c}


def test_byte_model_by_the_formula(spark):
    texts = [("you fool you", 1), ("fools fool", 1), ("the fool", 1), ("the house you see", 0), ("a house of stone", 0), ("see the stone house", 0), ("the pool", 0), ("", 0)]
    rows = spark.createDataFrame([(t.encode(), y) for t, y in texts], "text binary, _y int")
    seen, left = toxicity.log_ratios(toxicity.count_grams(rows))
    model = toxicity.Model({k: toxicity.by_cell(seen[k], np.nan, toxicity.BITS[k]) for k in seen}, {k: toxicity.by_cell(left[k], 0.0, toxicity.BITS[k]) for k in left}, np.zeros(4))
    want = {g: np.log(a / b) for g, (a, b) in byte_model(texts).items() if len(g) == 5}
    codes = np.array([int.from_bytes(g.encode(), "big") for g in want])
    assert len(want) > 40 and max(want.values()) > 0.5 and min(want.values()) < -0.5
    np.testing.assert_allclose(model.ratios(codes), list(want.values()), atol=1e-4)


def test_toxicity(spark, tmp_path):
    rng = random.Random(8)
    say = ["thing", "there", "and", "stone", "river", "under", "light", "house", "green", "walk"]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 5 == 0
        w = [rng.choice(say) for _ in range(rng.randint(30, 90))]
        if toxic:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(["zgrumk", "vlopqx"])
        rows.append((i, " ".join(w), None, None, None))
        labels.append((i, 1, int(toxic)))
    rows += [(5000, None, None, None, None), (5001, "", None, None, None), (5002, "x" * 50000, None, None, None), (None, "thing", None, None, None)]
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels + [(0, 1, 1), (7, 1, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    told = toxicity.toxicity(docs.withColumn("score", F.lit("x")), marks).collect()
    assert len(told) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in told)
    held = [r for r in told if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 900]
    assert held and sum(r["predicted"] == int(r["doc_id"] % 5 == 0) for r in held) >= 0.95 * len(held)
    empty = toxicity.toxicity(docs, marks.limit(0)).collect()
    assert {r["score"] for r in empty} == {0.5}


def test_quality(spark, corpus):
    rng = random.Random(4)
    texts = corpus + ["a b\na b\n \nc | # $", "".join(chr(rng.randint(33, 126)) for _ in range(9000)).replace(" ", ""), " ".join("".join(chr(rng.randint(161, 2000)) for _ in range(9)) for _ in range(900))]
    got = {r["doc_id"]: r for r in quality.quality_features(docs_of(spark, texts, extra=True)).collect()}
    for i, text in enumerate(texts):
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        seen, dup = set(), 0
        for line in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        c = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        mark = [False] * len(w)
        for k in range(len(w) - 4):
            if c[tuple(w[k : k + 5])] > 1:
                mark[k : k + 5] = [True] * 5
        want = (len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in text), dup, sum(mark), len(w) < 10 or 100 * sum(mark) > 20 * len(w))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want
        assert not (r["base_failed"] and r["kept"])
    assert not got[len(texts) - 2]["kept"] and got[0]["kept"] == (not got[0]["base_failed"])


def test_ascii_noise_falls_in_every_band(spark):
    rng = random.Random(14)
    common = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(2000)]
    prose = lambda n: " ".join(common[min(int(rng.expovariate(0.003)), 1999)] for _ in range(n // 3))[:n]
    noise = lambda letters, n: "".join(" " if rng.random() < 0.12 else rng.choice(letters) for _ in range(n))
    base, ascii_, sizes = "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)])) + "+/", "".join(map(chr, range(33, 127))), [250, 500, 1000, 4096, 12000, 50000, 90000]
    bad = [noise(x, n) for n in sizes for x in (base, ascii_)] + [noise("abcdefghijklmnopqrstuvwxyz", n) for n in sizes[4:]]
    bad.append(prose(8 * 4096) + noise(base, 4 * 4096))  # a third of the chunks, whole ratio within its band
    good = [prose(n) for n in sizes]
    got = {r["doc_id"]: r for r in quality.quality_features(docs_of(spark, bad + good)).collect()}
    assert not any(r["base_failed"] for r in got.values())
    assert [i for i in range(len(bad)) if got[i]["kept"]] == [] and all(got[i]["kept"] for i in range(len(bad), len(got)))
    assert all(got[2 * sizes.index(12000) + k]["chunk_high"] == 1.0 for k in (0, 1))


def test_shards(spark, corpus):
    texts = corpus + ["same"] * 500 + [None] * 20
    got = shards.lpt_shards(docs_of(spark, texts, extra=True)).collect()
    assert len(got) == len(texts)
    of, size = collections.defaultdict(set), collections.Counter()
    for r in got:
        text = texts[r["doc_id"]] or ""
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text.encode()) + 1, zlib.crc32(text.encode()), "bytes", None)
        of[text].add(r["shard"])
        size[r["shard"]] += r["size"]
    assert all(len(s) == 1 for s in of.values()) and set(size) <= set(range(16))
    for s in size:
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert shards.lpt_shards(docs_of(spark, [])).count() == 0


def by_heap(sizes, n):
    """Loads by the plain schedule, group by group."""
    load = [0] * n
    for size in sorted(sizes, reverse=True):
        load[load.index(min(load))] += size
    return load


@pytest.mark.parametrize("groups", [400, 5, 3000])
def test_longest_first(groups):
    rng = random.Random(groups)
    sizes = [rng.choice([1, 2, 3, 7, rng.randint(1, 100)]) for _ in range(groups)] + [2500] * 2
    put = shards.longest_first(list(collections.Counter(sizes).items()), 16)
    assert {s: sum(given) for s, given in put.items()} == collections.Counter(sizes)
    assert [sum(s * given[k] for s, given in put.items()) for k in range(16)] == by_heap(sizes, 16)


def test_shards_by_brute_force(spark):
    rng = random.Random(3)
    texts = ["x" * rng.choice([3, 3, 3, 8, rng.randint(0, 60)]) + rng.choice("abcdefgh") for _ in range(700)]
    load, sizes = collections.Counter(), collections.Counter()
    for r in shards.lpt_shards(docs_of(spark, texts)).collect():
        load[r["shard"]] += r["size"]
    for t in texts:
        sizes[t] += len(t) + 1
    assert sorted(load[s] for s in range(16)) == sorted(by_heap(sizes.values(), 16))


def test_mix(spark, corpus):
    rng = random.Random(3)
    texts = corpus + [" ".join(["w"] * rng.randint(1, 60)) for _ in range(600)]
    mixed = mixing.systematic_mix(docs_of(spark, texts, extra=True))
    got = mixed.collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.systematic_mix(docs_of(spark, texts, extra=True)).collect()))
    total, target = collections.Counter(), {}
    for r in got:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]] or "")) and r["taken"] <= 2 * r["size"]
        total[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert sum(target.values()) == pytest.approx(1.5 * sum(r["size"] for r in got))
    biggest = max(r["size"] for r in got)
    assert all(abs(total[s] - target[s]) <= biggest for s in target)
    assert mixing.emit_copies(mixed, ["doc_id"]).count() == sum(r["copies"] for r in got)


def test_targets_fill_up(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 10), (None, 0)], "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    assert got["a"] == 200 and got["c"] == 20 and got[None] == 0 and got["b"] == pytest.approx(1665 - 220)


def test_empty_tables(spark):
    empty = docs_of(spark, [])
    vectors = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    found = [
        bpe.round_trip(empty, VOCABULARY), suffix_dedup.remove_repeats(empty), embedding_join.metric_join(vectors), language_id.identify(empty),
        toxicity.toxicity(empty, labels), quality.quality_features(empty), mixing.systematic_mix(empty), jaccard_join.jaccard_components(empty), recompression.remove_repeats(empty),
    ]
    assert [df.count() for df in found] == [0] * len(found)


def test_words():
    w = words.Words([b" a bc\n", None, b"bc a", b""])
    h = w.hashes()
    assert w.first.tolist() == [0, 2, 2, 4, 4] and h[0] == h[3] and h[1] == h[2] and h[0] != h[1]


@pytest.mark.parametrize("name", sorted(llm.ORACLE_SQL))
def test_sql(spark, tables, name):
    same(llm.QUERIES[name](spark, tables), llm.ORACLE_SQL[name], tables)
