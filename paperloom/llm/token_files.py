"""Token ids in flat binary files, with 64-bit offsets of the documents, mapped into memory to be read.

A folder holds shards in the order of doc_id. A shard is three files of one part number:
``kind=ids`` has unsigned little-endian ids end to end, ``kind=offsets`` the place of each document's
first id within the shard and the shard's end (unsigned, 64 bits), ``kind=docs`` the doc_ids (signed,
64 bits) and a closing zero. ``manifest`` names the files of each shard and its base: the number of
ids in all shards before it, a prefix sum over the sizes of the files.

Spark's own text writer puts the bytes down, so its commit protocol holds: a lost executor or a task
that ran twice leaves no part of a file, in whatever store Spark writes to. That writer ends each
record with a separator; here every record ends in a zero byte anyway, and that byte is the separator.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm.words import text_groups
from paperloom.tables import shared_folder

NO_ID = -(2**63)  # stands for a null doc_id in the files
SCHEMA = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
#: First bytes that can't begin white space: a word begins at one space before them, whatever came before.
WORD_AHEAD = np.zeros(256, dtype=bool)
WORD_AHEAD[[*range(0x21, 0x7F), *range(0xC3, 0xE0), *range(0xE4, 0xF5)]] = True
LETTER, SYMBOL, SECOND = np.zeros((3, 256), dtype=bool)  # letters and symbols of ASCII; second bytes of the letters that begin with 0xC3
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
SYMBOL[[x for x in range(0x21, 0x7F) if not chr(x).isalnum()]] = True
SECOND[[x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)]] = True
JOINED = 64  # stretches that go to the library as one text


class Encoder:
    """The tokenizers library behind a cache of short stretches.

    The vocabulary's pattern begins a new match at any single space before a character that is not
    white space, and between a letter and a symbol, so stretches between such places are encoded
    alone, or after any other, with the same ids. Each
    different stretch of a group goes to the library once, and not again while the cache has it;
    the cache starts anew from the last group's repeated stretches beyond ``most`` bytes of them.
    """

    def __init__(self, json: str, most: int = 4_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(json)
        self.library.encode_special_tokens = True  # their names in a text are ordinary text
        vocabulary = self.library.get_vocab()
        self.bytes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        self.bytes[list(vocabulary.values())] = [len(x) for x in vocabulary]  # a token is written with a character for each byte
        self.most, self.held = most, 0
        self.number: dict[bytes, int] = {}
        self.ids, self.first = np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)  # ids of stretch i are first[i] to first[i + 1]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, how many each has)."""
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        size = np.array([len(t) for t in texts], dtype=np.int64)
        start = np.cumsum(size) - size
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[: max(0, len(data) - 1)] = (data[:-1] == 0x20) & WORD_AHEAD[data[1:]]
        cut[1 : len(data)] |= LETTER[data[:-1]] & SYMBOL[data[1:]]
        cut[2 : len(data)] |= (data[:-2] == 0xC3) & SECOND[data[1:-1]] & SYMBOL[data[2:]]
        cut[start[start > 0] - 1] = False  # what follows a text's last byte is another text
        cut[start] = True
        begin = np.flatnonzero(cut[: len(data)])
        ends = np.append(begin, len(data)).astype(np.int32)
        stretches = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
        raw, code = stretches.dictionary.to_pylist(), stretches.indices.to_numpy()
        number = self.numbers(raw)
        place, n = self.first[number][code], np.diff(self.first)[number][code]
        after = np.concatenate([[0], np.cumsum(n)])
        out = self.ids[np.arange(after[-1]) + np.repeat(place - after[:-1], n)]
        if self.held > self.most:
            self.start_anew([raw[i] for i in np.flatnonzero(np.bincount(code) > 1).tolist()])
        return out, np.diff(after[np.append(np.searchsorted(begin, start), len(begin))])

    def numbers(self, raw: list[bytes]) -> np.ndarray:
        """The cache's numbers of different stretches; the library encodes those that it doesn't have."""
        found = np.fromiter(map(self.number.get, raw, repeat(-1)), dtype=np.int64, count=len(raw))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new = [raw[i] for i in missing.tolist()]
            ids, n = self.from_library(new)
            have = len(self.first) - 1
            self.ids = np.concatenate([self.ids, ids])
            self.first = np.append(self.first, self.first[-1] + np.cumsum(n))
            self.number.update(zip(new, range(have, have + len(new))))
            self.held += sum(map(len, new))
            found[missing] = np.arange(have, have + len(new))
        return found

    def from_library(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all stretches, how many each has). Those that begin with a space and no white space go many at a time, cut apart again by bytes."""
        led = np.array([len(x) > 1 and x[0] == 0x20 and bool(WORD_AHEAD[x[1]]) for x in new])
        n, parts = np.zeros(len(new), dtype=np.int64), [np.zeros(0, dtype=np.uint32)] * len(new)
        many, alone = np.flatnonzero(led).tolist(), np.flatnonzero(~led).tolist()
        for k in range(0, len(many), 100 * JOINED):
            some = many[k : k + 100 * JOINED]
            try:
                texts = [b"".join(new[i] for i in some[j : j + JOINED]).decode() for j in range(0, len(some), JOINED)]
            except UnicodeDecodeError:
                alone += some
                continue
            ids = np.fromiter(chain.from_iterable(e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)), dtype=np.uint32)
            begin = np.append(0, np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum([len(new[i]) for i in some])) + 1)
            for i, a, b in zip(some, begin.tolist(), begin[1:].tolist()):
                parts[i] = ids[a:b]
        for i, e in zip(alone, self.library.encode_batch_fast([new[i].decode(errors="replace") for i in alone], add_special_tokens=False)):
            parts[i] = np.array(e.ids, dtype=np.uint32)
        n[:] = [len(x) for x in parts]
        return np.concatenate(parts), n

    def start_anew(self, keep: list[bytes]) -> None:
        keep = [x for x in keep if len(x) <= 64]
        number = self.numbers(keep)
        n = np.diff(self.first)[number]
        after = np.concatenate([[0], np.cumsum(n)])
        self.ids = self.ids[np.arange(after[-1]) + np.repeat(self.first[number] - after[:-1], n)]
        self.first, self.number, self.held = after, dict(zip(keep, range(len(keep)))), sum(map(len, keep))


_loaded: dict[int, Encoder] = {}


def encoder(json: str) -> Encoder:
    """The encoder of this process for a vocabulary file."""
    key = hash(json)
    if key not in _loaded:
        _loaded[key] = Encoder(json)
    return _loaded[key]


def write_tokens(docs: DataFrame, vocabulary: str, folder: str | None = None, end_id: int = 2) -> str:
    """Write the ids of every text, each text's followed by ``end_id``, and return the folder.

    ``vocabulary``: path of a tokenizers JSON file on the driver. ``folder``: a new one in the shared
    folder unless given. Ids have 16 bits where the vocabulary allows it, else 32.

    Documents stand in the order of doc_id, nulls first, then of the text. A null text counts as
    empty and is its end id; bytes that are not UTF-8 are encoded as replacement characters. Rows
    of one doc_id each count; rows that also agree in the text keep together. An empty table writes
    nothing. doc_ids lie above -2 ** 63. Other columns are not read.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/{uuid.uuid4().hex}.tokens"
    with open(vocabulary, encoding="utf-8") as f:
        json = f.read()
    width = 2 if Encoder(json).library.get_vocab_size() <= 1 << 16 else 4
    if not 0 <= end_id < 256 ** (width - 1):
        raise ValueError("the highest byte of the end id is the separator of records, so it must be zero")
    shared = spark.sparkContext.broadcast(json)  # one vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, lengths, names, seq = encoder(shared.value), [], [], 0
        for rows, texts in text_groups(batches, 1 << 21):
            ids, n = t.encode([x or b"" for x in texts])
            raw = np.insert(ids, np.cumsum(n), end_id).astype(f"<u{width}").tobytes()
            lengths.append(n + 1), names.append(rows.column("doc").to_numpy())
            yield _records("ids", [raw], seq)
            seq += 1
        offsets = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, dtype=np.int64), *lengths]))])
        if len(offsets) > 1:
            yield _records("offsets", [offsets.astype("<u8").tobytes()], 0)
            yield _records("docs", [np.append(np.concatenate(names), 0).astype("<i8").tobytes()], 0)

    text = F.col("text").cast("binary")
    order = [F.col("doc"), F.col("_hash"), F.col("text")]
    texts = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), text.alias("text"), F.xxhash64(text).alias("_hash"))
    sorted_texts = texts.repartitionByRange(*order[:2]).sortWithinPartitions(*order).select("doc", "text")
    records = sorted_texts.mapInArrow(run, "kind string, seq bigint, value binary").sortWithinPartitions("kind", "seq")
    records = records.select(F.col("value").cast("string").alias("value"), "kind")
    records.write.partitionBy("kind").option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", 0).text(folder)
    _write_manifest(spark, folder, width)
    return folder


def _records(kind: str, values: list[bytes], seq: int) -> pa.RecordBatch:
    """Records without their last byte, a zero, which the writer's separator puts back."""
    columns = [pa.array([kind] * len(values)), pa.array(range(seq, seq + len(values)), pa.int64()), pa.array([x[:-1] for x in values], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "seq", "value"])


def _files(spark: SparkSession, folder: str, kind: str, *columns: str) -> DataFrame:
    """(shard, the files' ``path``, ``length`` or ``content``) of one kind; only the columns asked for are read."""
    found = spark.read.format("binaryFile").load(f"{folder}/kind={kind}")
    return found.select(F.regexp_extract("path", r"part-(\d+)-[^/]*$", 1).cast("int").alias("shard"), *(F.col(c).alias(kind if c != "length" else c) for c in columns))


def _write_manifest(spark: SparkSession, folder: str, width: int) -> None:
    """One row a shard: its files, the bytes of an id, its ids and its base."""
    schema = "shard int, ids string, offsets string, docs string, id_bytes int, n_ids bigint, base bigint"
    if spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path").isEmpty():
        rows = spark.createDataFrame([], schema)
    else:
        rows = _files(spark, folder, "ids", "path", "length").join(_files(spark, folder, "offsets", "path"), "shard").join(_files(spark, folder, "docs", "path"), "shard")
        n = (F.col("length") / width).cast("long")
        before = F.sum(n).over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # a row for each file
        rows = rows.select("shard", "ids", "offsets", "docs", F.lit(width).alias("id_bytes"), n.alias("n_ids"), F.coalesce(before, F.lit(0)).alias("base"))
    rows.write.parquet(f"{folder}/manifest")


def local_path(uri: str) -> str | None:
    """The path that a mapping can open, or None where the store is not a mounted one."""
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", uri)
    if scheme is None:
        return uri
    return "/" + uri[len("file:") :].lstrip("/") if scheme[1] == "file" else None


def opened(file: str | bytes, dtype: str) -> np.ndarray:
    """A file's numbers: mapped where it has a path, else seen in the bytes that Spark read."""
    return np.memmap(file, dtype=dtype, mode="r") if isinstance(file, str) else np.frombuffer(file, dtype=dtype)


def crc32(ids: np.ndarray, most: int = 1 << 20) -> int:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    out = 0
    for k in range(0, len(ids), most):
        out = zlib.crc32(ids[k : k + most].astype("<u4"), out)
    return out


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document, from the files.

    Shards are dealt out and mapped where they lie; in a store without paths Spark reads them for the tasks.
    """
    shards = spark.read.parquet(f"{folder}/manifest")
    first = shards.select("ids").first()
    if first is None:
        return spark.createDataFrame([], SCHEMA)
    if mapped := local_path(first["ids"]) is not None:
        rows = shards.select("shard", "ids", "offsets", "docs", "id_bytes", "base")
    else:
        rows = shards.select("shard", "id_bytes", "base")
        for kind in ("ids", "offsets", "docs"):
            rows = rows.join(_files(spark, folder, kind, "content"), "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                files = [local_path(r[k]) if mapped else r[k] for k in ("ids", "offsets", "docs")]
                ids, offsets, docs = (opened(f, d) for f, d in zip(files, (f"<u{r['id_bytes']}", "<u8", "<i8")))
                for k in range(0, len(offsets) - 1, 10_000):
                    at = offsets[k : k + 10_001].astype(np.int64)
                    doc = np.array(docs[k : k + len(at) - 1])
                    columns = [pa.array(doc, pa.int64(), mask=doc == NO_ID), pa.array(at[:-1] + r["base"]), pa.array(np.diff(at))]
                    columns.append(pa.array([crc32(ids[a:b]) for a, b in zip(at.tolist(), at[1:].tolist())], pa.int64()))
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "shard").mapInArrow(run, SCHEMA)


class TokenFolder:
    """The ids of a folder on a mounted store as one long row, for a training loop."""

    def __init__(self, spark: SparkSession, folder: str):
        rows = spark.read.parquet(f"{folder}/manifest").orderBy("shard").collect()  # a row for each file
        self.bases = np.array([r["base"] for r in rows] + [sum(r["n_ids"] for r in rows)], dtype=np.int64)
        self.ids = [opened(local_path(r["ids"]), f"<u{r['id_bytes']}") for r in rows]

    def __len__(self) -> int:
        return int(self.bases[-1])

    def window(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from the place ``start`` on, over the ends of shards; only their pages are read."""
        out, end = [], min(start + n, len(self))
        while start < end:
            k = int(np.searchsorted(self.bases, start, "right")) - 1
            part = self.ids[k][start - self.bases[k] : end - self.bases[k]]
            out.append(part)
            start += len(part)
        return np.concatenate([np.zeros(0, dtype=np.uint32), *out]).astype(np.uint32)
