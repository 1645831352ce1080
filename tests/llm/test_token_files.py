"""op11: the files of token ids against the library called a text at a time."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from paperloom.llm import queries as llm
from paperloom.llm import token_files

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a  b", "a ", "b ", " ", "   ", "", " x\n y  z  　q", "'s it's 's", "<|endoftext|> hi <|endoftext|>", None, "日本語 テスト 👍🏽 don't we'll    a", "x" * 3000, "a b " * 3000]


def expected(rows):
    """(doc_id, start, n_tokens, crc32) in the order of doc_id, nulls first, and all ids."""
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    out, every = [], []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc, len(every), len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        every += ids
    return out, every


@pytest.mark.parametrize("stored", ["mapped", "read by Spark"])
def test_files_and_windows(spark, monkeypatch, stored):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("aab'' strevlmd19 \n\t é!?日\U0001f600\x1c  ") for _ in range(rng.randint(0, 40))) for _ in range(500)]
    rows = [(7 * i - 50 if i else None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("start", F.lit("x")).withColumn("ids", F.lit(1)).repartition(3)
    folder = token_files.write_tokens(df, VOCABULARY)
    want, every = expected(rows)
    if stored != "mapped":
        monkeypatch.setattr(token_files, "local_path", lambda uri: None)
    assert sorted(map(tuple, token_files.read_tokens(spark, folder).collect()), key=lambda r: r[1]) == want
    if stored == "mapped":
        row = token_files.TokenFolder(spark, folder)
        assert len(row) == len(every) and row.window(90, 3000).tolist() == every[90:3090] and row.window(len(every) - 3, 9).tolist() == every[-3:]


def test_repeated_rows_and_an_empty_table(spark):
    df = spark.createDataFrame([(1, "same"), (1, "same"), (1, None), (0, "x")], "doc_id bigint, text string")
    found = sorted(map(tuple, token_files.read_tokens(spark, token_files.write_tokens(df, VOCABULARY)).collect()), key=lambda r: r[1])
    assert [r[0] for r in found] == [0, 1, 1, 1] and [r[1] for r in found] == np.cumsum([0] + [r[2] for r in found])[:-1].tolist()
    assert sorted(r[2:] for r in found) == sorted(r[2:] for r in expected([(1, "same"), (1, "same"), (1, None), (0, "x")])[0])
    assert token_files.read_tokens(spark, token_files.write_tokens(df.limit(0), VOCABULARY)).collect() == []
    with pytest.raises(ValueError):
        token_files.write_tokens(df, VOCABULARY, end_id=256)


def test_the_cache_starts_anew():
    with open(VOCABULARY, encoding="utf-8") as f:
        t, want = token_files.Encoder(f.read(), most=200), Tokenizer.from_file(VOCABULARY)
    for k in range(4):
        texts = [f"again again word{k}x{i} and  again" for i in range(50)] + ["", "y" * 100]
        ids, n = t.encode([x.encode() for x in texts])
        one = [want.encode(x, add_special_tokens=False).ids for x in texts]
        assert n.tolist() == list(map(len, one)) and ids.tolist() == sum(one, []) and t.held <= 200 + 2000


def test_query(spark, tables):
    rows = [tuple(r) for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, llm.QUERIES["op11_token_files"](spark, tables).collect()), key=lambda r: r[1])
    assert got == expected(rows)[0]
