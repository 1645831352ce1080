"""Phrase collocations: frequent phrases by recursive pair counting, and how much each holds together.

Texts become chunks, rows of numbers. Frequent words get ids by rank of frequency over the whole
corpus; a chunk's pairs of neighbouring ids are counted in tiles: where both ids are small and a tile
of ``EDGE`` x ``EDGE`` ids has many pairs, by direct addressing into a dense array, else as sorted
coordinates. Spark adds up the chunks' counts; pairs that are frequent get ids by their own rank and
take the place of the words: two neighbours among them, which overlap in a word, are a phrase of
three. So each round finds phrases that are longer by a word, from chunks with ever fewer numbers.

The ``KNOWN`` most frequent words or pairs, whose ids are the lowest, are sent to all tasks. If there
are more, a chunk's distinct words or pairs are joined with the others as rows, and what the join
finds goes back to the chunk.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.words import LOWER, mix, text_groups
from paperloom.tables import discard, landed, settings, stable

CHUNK = 1 << 18  # bytes of text of one language that are numbered together: a row of this size is no burden to a heap
EDGE, SIDE = 128, 128  # ids along a tile; tiles along the part of the plane that is addressed directly
DENSE = 1024  # pairs in a tile from which a dense array is cheaper than a sort
KNOWN = 1 << 18  # words or pairs that are broadcast: at most 6 MB of pairs, 19 MB of words
LONG = 64  # bytes; longer words are never broadcast
#: While phrases are counted: bytes that a Python task takes at a time, chunks (some hundred kB each) that a reader lays
#: out at a time, and shuffles go when their table is written.
SETTINGS = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m", "spark.sql.parquet.columnarReaderBatchSize": "16", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Spaces and tabs stand between words, the others between pieces.
KIND = np.zeros(256, dtype=np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
STOP = re.compile(rb"[.,;:!?\x0A-\x0D]")
PAIR_SCHEMA = "chunk bigint, seq array<int>, a array<bigint>, b array<bigint>, n array<bigint>"


def count_pairs(a: np.ndarray, b: np.ndarray, dense: int = DENSE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of each given pair, and of the different pairs: a, b, count)."""
    tile = np.where((a < EDGE * SIDE) & (b < EDGE * SIDE), (a // EDGE) * SIDE + b // EDGE, -1)
    crowded = np.flatnonzero(np.bincount(tile[tile >= 0], minlength=SIDE * SIDE) >= dense)
    slot = np.full(SIDE * SIDE + 1, -1)
    slot[crowded] = np.arange(len(crowded))
    where = slot[tile]  # tile -1 is the last slot, never crowded
    direct = where >= 0
    cell = (where[direct] * EDGE + a[direct] % EDGE) * EDGE + b[direct] % EDGE
    counts = np.bincount(cell, minlength=len(crowded) * EDGE * EDGE)
    full = np.flatnonzero(counts)
    number = np.zeros(len(a), dtype=np.int64)
    number[direct] = (np.cumsum(counts > 0) - 1)[cell]
    of_tile = crowded[full // (EDGE * EDGE)] if len(full) else full
    found_a, found_b = (of_tile // SIDE) * EDGE + full // EDGE % EDGE, (of_tile % SIDE) * EDGE + full % EDGE

    rest = np.flatnonzero(~direct)
    order = rest[np.lexsort((b[rest], a[rest]))]
    x, y = a[order], b[order]
    first = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))[: len(order)]
    number[order] = len(full) + np.cumsum(first) - 1
    begin = np.flatnonzero(first)
    sparse = np.diff(np.append(begin, len(order)))
    return number, np.concatenate([found_a, x[begin]]), np.concatenate([found_b, y[begin]]), np.concatenate([counts[full], sparse])


def number_words(texts: list[bytes]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(number of the word at each place, -1 between pieces; the different words; how often each occurs)."""
    data = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
    kind = KIND[data]
    inside = kind == 0
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    start, size = edge[0::2], edge[1::2] - edge[0::2]
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode()
    code = words.indices.to_numpy()
    piece = np.cumsum(kind == 2)[start]
    return np.insert(code, np.flatnonzero(np.diff(piece)) + 1, -1), words.dictionary, np.bincount(code, minlength=len(words.dictionary))


def cut_at_stops(text: bytes, most: int) -> Iterator[bytes]:
    """A long text in parts of about ``most`` bytes that end between pieces."""
    begin = 0
    while len(text) - begin > most and (stop := STOP.search(text, begin + most)):
        yield text[begin : stop.start()]
        begin = stop.end()
    yield text[begin:]


def entries(chunks: DataFrame, *keys: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each word or pair of each chunk: ``keep``, local (its number in the chunk) and its ``keys``."""
    first, *others = keys
    return chunks.select(*keep, F.posexplode(first).alias("local", first), *others).select(*keep, "local", first, *(F.get(c, F.col("local")).alias(c) for c in others))


def word_chunks(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(chunk, lang, seq, words, n): about ``chunk`` bytes of one language each, words and their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        made = TaskContext.get().partitionId() << 33

        def flush(lang: str) -> pa.RecordBatch:
            nonlocal made
            seq, words, n = number_words(held.pop(lang))
            del sizes[lang]
            made += 1
            columns = [pa.array([made], pa.int64()), pa.array([lang]), pa.array([seq], pa.list_(pa.int32())), pa.array([words.to_pylist()], pa.list_(pa.binary())), pa.array([n], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, names=["chunk", "lang", "seq", "words", "n"])

        for batch, texts in text_groups(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), texts):
                for part in cut_at_stops(text or b"", chunk):
                    held.setdefault(lang, []).append(part)
                    sizes[lang] = sizes.get(lang, 0) + len(part) + 1
                    if sizes[lang] >= chunk:
                        yield flush(lang)
            while sum(sizes.values()) > 4 * chunk:  # many languages: the largest goes
                yield flush(max(sizes, key=sizes.get))
        for lang in list(held):
            yield flush(lang)

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    return landed(rows.mapInArrow(run, "chunk bigint, lang string, seq array<int>, words array<binary>, n array<bigint>"))


class KnownWords:
    """Ids of the words of some languages."""

    keys = ("words",)

    def __init__(self, rows: pa.Table):
        self.ids: dict[str, dict[bytes, int]] = {}
        for lang, word, i in zip(*(rows.column(c).to_pylist() for c in ("lang", "words", "id"))):
            self.ids.setdefault(lang, {})[word] = i

    def find(self, batch: pa.RecordBatch, i: int) -> np.ndarray:
        """Ids of the words of row ``i``, -1 for others."""
        own, words = self.ids.get(batch.column("lang")[i].as_py(), {}), batch.column("words")[i].values.to_pylist()
        return np.fromiter((own.get(w, -1) for w in words), dtype=np.int64, count=len(words))


class KnownPairs:
    """Ids of pairs, found by a hash and compared."""

    keys = ("a", "b")

    def __init__(self, rows: pa.Table):
        a, b, ids = (rows.column(c).to_numpy() for c in ("a", "b", "id"))
        order = np.lexsort((ids, self.hash(a, b)))
        self.a, self.b, self.ids = (np.append(x[order], -1) for x in (a, b, ids))
        self.hashes = self.hash(self.a[:-1], self.b[:-1])
        self.twins = int(np.count_nonzero(self.hashes[1:] == self.hashes[:-1]))

    @staticmethod
    def hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix(mix(a.astype(np.uint64)) + b.astype(np.uint64))

    def find(self, batch: pa.RecordBatch, i: int) -> np.ndarray:
        """Ids of the pairs of row ``i``, -1 for others."""
        a, b = (batch.column(c)[i].values.to_numpy() for c in self.keys)
        out, at = np.full(len(a), -1, dtype=np.int64), np.searchsorted(self.hashes, self.hash(a, b))
        for _ in range(self.twins + 1):  # pairs of one hash lie side by side
            same = (self.a[at] == a) & (self.b[at] == b)
            out[same] = self.ids[at[same]]
            at = np.minimum(at + 1, len(self.ids) - 1)
        return out


def pair_chunks(chunks: DataFrame, frequent: DataFrame, known: type, most: int) -> DataFrame:
    """(chunk, seq, a, b, n): neighbours among the words or pairs that ``frequent`` gives an id; seq numbers them in their places.

    Where there is no pair, -1 stands, once for a run; chunks without a pair go.
    """
    own = ["lang", "words"] if known is KnownWords else ["a", "b"]
    short = (F.length("words") <= LONG) if known is KnownWords else F.lit(True)
    told = (F.col("id") < most) & short
    shared = chunks.sparkSession.sparkContext.broadcast(known(frequent.where(told).select(*own, "id").toArrow()))  # ``most`` rows
    columns = ["chunk", "seq", *own]
    rest = frequent.where(~told)
    if not rest.isEmpty():
        rows = entries(chunks, *known.keys, keep=("chunk", *(c for c in own if c not in known.keys)))
        names = rows.join(rest.select(*own, "id"), own).groupBy("chunk").agg(F.collect_list(F.struct("local", "id")).alias("names"))
        chunks = chunks.select(*columns).join(names, "chunk", "left")
        columns.append("names")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                seq, table = batch.column("seq")[i].values.to_numpy(), np.append(shared.value.find(batch, i), -1)  # the last one for -1
                if "names" in columns and batch.column("names")[i].is_valid:
                    named = batch.column("names")[i].values
                    table[named.field("local").to_numpy()] = named.field("id").to_numpy()
                at = table[seq]
                both = (at[:-1] >= 0) & (at[1:] >= 0)
                if not both.any():
                    continue
                number, a, b, n = count_pairs(at[:-1][both], at[1:][both])
                out = np.full(len(both), -1, dtype=np.int32)
                out[both] = number
                out = out[both | np.append(True, both[:-1])]
                made = [pa.array([batch.column("chunk")[i].as_py()], pa.int64()), pa.array([out], pa.list_(pa.int32())), *(pa.array([x], pa.list_(pa.int64())) for x in (a, b, n))]
                yield pa.RecordBatch.from_arrays(made, names=["chunk", "seq", "a", "b", "n"])

    return landed(chunks.select(*columns).mapInArrow(run, PAIR_SCHEMA))


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``id``, their place (from 0) in a total order, by prefix sums over the sizes of range partitions."""
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = landed(ordered.withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    sizes = placed.groupBy(part.alias("_part")).count().orderBy("_part").collect()  # a row for each partition
    bases = [(r["_part"], sum(s["count"] for s in sizes[:i])) for i, r in enumerate(sizes)]
    base = rows.sparkSession.createDataFrame(bases, "_part bigint, _base bigint")
    joined = placed.join(F.broadcast(base), part == F.col("_part"))  # as many rows
    return joined.withColumn("id", F.col("_base") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m", "_part", "_base")


def phrase_tables(docs: DataFrame, least: int, longest: int, chunk: int = CHUNK, known: int = KNOWN) -> list[DataFrame]:
    """For words and for each length of phrase: id, lang, total, words, f, a and b, first and last.

    f counts the contiguous occurrences, of which there are at least ``least``; a and b are the ids of
    the phrase without its last and without its first word; ``first[i]`` and ``last[i]`` have the counts of
    the first and of the last i + 1 words; total counts all words of the language.
    """
    with settings(docs.sparkSession, SETTINGS):
        return _phrase_tables(docs, least, longest, chunk, known)


def _phrase_tables(docs: DataFrame, least: int, longest: int, chunk: int, known: int) -> list[DataFrame]:
    chunks = word_chunks(docs, chunk)
    counts = stable(entries(chunks, "words", "n", keep=("lang",)).groupBy("lang", "words").agg(F.sum("n").alias("f")))
    totals = counts.groupBy("lang").agg(F.sum("f").alias("total"))
    frequent, kind = ranked(counts.where(F.col("f") >= least), F.desc("f"), F.col("lang"), F.col("words")), KnownWords
    nothing = F.lit(None).cast("long")
    f = F.array("f")
    found = [stable(frequent.join(totals, "lang").select("id", "lang", "total", F.array(F.col("words").cast("string")).alias("words"), "f", nothing.alias("a"), nothing.alias("b"), f.alias("first"), f.alias("last")))]
    for _ in range(longest - 1):
        shorter, chunks = chunks, pair_chunks(chunks, frequent, kind, known)
        kind = KnownPairs
        discard(shorter)  # counted and renamed: nothing reads it any more
        frequent = ranked(entries(chunks, "a", "b", "n").groupBy("a", "b").agg(F.sum("n").alias("f")).where(F.col("f") >= least), F.desc("f"), F.col("a"), F.col("b"))
        head = found[-1].select(F.col("id").alias("a"), "lang", "total", F.col("words").alias("_words"), F.col("first").alias("_first"))
        tail = found[-1].select(F.col("id").alias("b"), F.element_at("words", -1).alias("_word"), F.col("last").alias("_last"))
        joined = frequent.join(head, "a").join(tail, "b")
        longer = joined.select("id", "lang", "total", F.concat("_words", F.array("_word")).alias("words"), "f", "a", "b", F.concat("_first", f).alias("first"), F.concat("_last", f).alias("last"))
        found.append(stable(longer))
    return found


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, percent: int = 100, chunk: int = CHUNK, known: int = KNOWN) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), split at ``.,;:!?`` and 0x0A to 0x0D into pieces and those at spaces and
    tabs into words. Candidates are phrases of 2 to ``longest`` words that occur ``least`` times (a),
    overlapping occurrences included. n counts the language's words. A cut after the first k words
    gives l and r, the counts of both parts, and floor(1000 a n / (l r)); the least score counts, of
    equal ones that of the least k. Numbers are exact as long as 1000 a n has at most 38 digits. A
    candidate goes if a longer one that holds its words in a row has 100 x its count >= ``percent`` x a;
    as counts only fall with length, it is enough to ask those longer by one word.

    A null lang is 'und'. Null or empty texts have no words; repeated rows and doc_ids count each. An empty table gives no rows.
    Other columns are not read. Long texts are cut between pieces; a piece is laid out whole.
    """
    tables = phrase_tables(docs, least, longest, chunk, known)
    kept = []
    for phrases, longer in zip(tables[1:], [*tables[2:], None]):
        if longer is not None:
            around = longer.select(F.explode(F.array("a", "b")).alias("id"), F.col("f").alias("_f")).groupBy("id").agg(F.max("_f").alias("_f"))
            phrases = phrases.join(around, "id", "left").where(F.col("_f").isNull() | (100 * F.col("_f") < percent * F.col("f"))).drop("_f")
        kept.append(phrases.select("lang", "total", "words", "f", "first", "last"))
    rows = kept[0]
    for more in kept[1:]:
        rows = rows.union(more)
    wide = lambda c: c.cast("decimal(20,0)")
    score = F.call_function("div", wide(F.col("f")) * wide(F.col("total")) * F.lit(1000).cast("decimal(4,0)"), wide(F.col("_l")) * wide(F.col("_r")))
    cuts = rows.select("lang", "total", "words", "f", F.posexplode(F.arrays_zip(F.slice("first", 1, F.size("words") - 1).alias("l"), F.reverse(F.slice("last", 1, F.size("words") - 1)).alias("r"))).alias("k", "_cut"))
    cuts = cuts.withColumn("_l", F.col("_cut.l")).withColumn("_r", F.col("_cut.r")).withColumn("score", score)
    weakest = cuts.groupBy("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), F.col("total").alias("n")).agg(F.min(F.struct("score", "k", F.col("_l").alias("l"), F.col("_r").alias("r"))).alias("_w"))
    flat = weakest.select("lang", "phrase", "a", "_w.l", "_w.r", "n", "_w.score")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return flat.withColumn("rank", place.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
  SELECT lang, sum(len(w))::HUGEINT AS n FROM words GROUP BY lang
), places AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words
), grams AS (
  SELECT lang, k, list_slice(w, i, i + k - 1) AS p, count(*) AS f FROM places, generate_series(1, 5) g(k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100
), inside AS (
  SELECT DISTINCT s.lang, s.p FROM grams s JOIN (SELECT lang, f, k, unnest([list_slice(p, 1, k - 1), list_slice(p, 2, k)]) AS part FROM grams WHERE k > 2) l ON s.lang = l.lang AND s.p = l.part AND l.f >= s.f
), cuts AS (
  SELECT c.lang, c.p, c.f AS a, x.f AS l, y.f AS r, n, cut, (1000 * c.f::HUGEINT * n) // (x.f::HUGEINT * y.f::HUGEINT) AS score
  FROM grams c JOIN totals USING (lang), generate_series(1, 4) g(cut)
  JOIN grams x ON x.lang = c.lang AND x.p = list_slice(c.p, 1, cut) JOIN grams y ON y.lang = c.lang AND y.p = list_slice(c.p, cut + 1, c.k)
  WHERE c.k > 1 AND cut < c.k AND NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = c.lang AND i.p = c.p)
), weakest AS (
  SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) AS w FROM cuts
), best AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank, array_to_string(p, ' ') AS phrase, a, l, r, n, score FROM weakest WHERE w = 1
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM best WHERE rank <= 2000
"""
