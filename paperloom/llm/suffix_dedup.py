"""Suffix-array dedup: longest-previous-factor arrays find what was already said.

Texts are too many for one suffix array, so windows of ``length`` bytes first meet by content: a
window is named by the least hash among the ``core``-byte strings in it, which any equal window
shares. Stretches of one name go, in blocks of whole names, through a suffix array. In suffix order
the previous and next entries with a smaller text position give each suffix its longest earlier match
(LPF); where that is ``length`` or more, the suffix begins a later copy, and its source the first one.
A stretch that occurs more than twice is laid out twice; its further copies go as the second does.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.repeats import RUN_COLUMNS, RUN_SCHEMA, covered, equal_in, equal_windows, hot_names, keyed, meet, pack, unpack, windows_to_runs, with_stretches
from paperloom.llm.words import BYTE_VALUES, GROUP, Prefix, digests, in_groups, mix, text_groups
from paperloom.tables import stable

NUMBER = np.uint64((1 << 28) - 1)  # low bits that number the bytes of a group of texts, at most some hundred thousand


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` consecutive ones."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(values) - width + 1], out[width - have :][: len(values) - width + 1])


class Texts:
    """Some texts laid end to end, with hashes of any stretch."""

    def __init__(self, texts: list[bytes | None]):
        self.bytes = np.frombuffer(b"".join(t or b"" for t in texts), dtype=np.uint8)
        self.first = np.concatenate([[0], np.cumsum([len(t or b"") for t in texts])]).astype(np.int64)
        self.prefix = Prefix(BYTE_VALUES[self.bytes], 41)


def window_names(texts: Texts, length: int, core: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name of the window at each byte, place of the core that names it, whether a window begins, text of each byte)."""
    n = len(texts.bytes)
    text = np.repeat(np.arange(len(texts.first) - 1), np.diff(texts.first))
    valid = np.zeros(n, dtype=bool)
    names, places = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.int64)
    if n >= length:
        at = np.arange(n - core + 1)
        cores = texts.prefix.hash(at, at + core)
        least = sliding_least((cores & ~NUMBER) | at.astype(np.uint64), length - core + 1)  # the leftmost of equal ones
        m = n - length + 1
        places[:m] = (least & NUMBER).astype(np.int64)
        names[:m] = mix(cores[places[:m]], 4)
        valid[:m] = np.arange(m) + length <= texts.first[1:][text[:m]]
    return names, places, valid, text


def pieces(texts: list[bytes | None], length: int, most: int = GROUP) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """(texts, their numbers, their first bytes): a text above ``most`` bytes comes in pieces that overlap by ``length`` - 1."""
    if len(texts) > 1 or len(texts[0] or b"") <= most + length:
        yield [t or b"" for t in texts], np.arange(len(texts)), np.zeros(len(texts), dtype=np.int64)
        return
    for begin in range(0, len(texts[0]) - length + 1, most):
        yield [texts[0][begin : begin + most + length - 1]], np.zeros(1, dtype=np.int64), np.array([begin])


def run_table(docs: DataFrame, length: int, core: int) -> DataFrame:
    """Rows (name, seg, doc, key, at) of ``keyed`` texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw in text_groups(batches):
            doc, key = rows.column("doc").to_numpy(), rows.column("key").to_numpy()
            for part, number, offset in pieces(raw, length):
                texts = Texts(part)
                names, places, valid, text = window_names(texts, length, core)
                start, count = windows_to_runs(places, valid, text)
                if not len(start):
                    continue
                seg = digests(texts.bytes.data, start, start + count + length - 1)[:, 0]
                own = text[start]
                columns = [names[start].view(np.int64), seg, doc[number[own]], key[number[own]], pack(start - texts.first[own] + offset[own], count)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=RUN_COLUMNS)

    return docs.select("doc", "key", "text").mapInArrow(run, RUN_SCHEMA)


class SuffixArray:
    """Order of the suffixes of a byte array by their first ``depth`` bytes, by prefix doubling."""

    def __init__(self, data: np.ndarray, depth: int):
        self.depth, n = depth, len(data)
        padded = np.append(data, np.zeros(8, dtype=np.uint8)).astype(np.uint64)
        key = np.zeros(n, dtype=np.uint64)
        for i in range(8):
            key = (key << np.uint64(8)) | padded[i : i + n]
        self.ranks = {8: np.unique(key, return_inverse=True)[1].astype(np.int32)}  # steps of eight bytes
        have = 8
        while have * 2 <= depth:
            self.ranks[have * 2] = self._join(self.ranks[have], have)
            have *= 2
        self.rank = self.ranks[have] if have == depth else self._join(self.ranks[have], depth - have)

    def _join(self, rank: np.ndarray, shift: int) -> np.ndarray:
        n = len(rank)
        both = rank.astype(np.int64) * (n + 2)
        both[: n - min(shift, n)] += rank[min(shift, n) :] + 1
        return np.unique(both, return_inverse=True)[1].astype(np.int32)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix of suffixes a and b in whole steps of eight bytes, up to ``depth``."""
        out, n = np.zeros(len(a), dtype=np.int64), len(self.rank)
        for step in sorted(self.ranks, reverse=True):
            for _ in range(1 + (step == max(self.ranks))):
                x, y = a + out, b + out
                inside = np.maximum(x, y) + step <= n
                out += step * (inside & (self.ranks[step][np.minimum(x, n - 1)] == self.ranks[step][np.minimum(y, n - 1)]))
        return np.minimum(out, self.depth)


def smaller_before(values: np.ndarray) -> np.ndarray:
    """Index of the nearest earlier entry with a smaller value, or -1: all entries jump at once."""
    to = np.arange(-1, len(values) - 1)
    moving = np.flatnonzero(to >= 0)
    while len(moving):
        moving = moving[values[to[moving]] > values[moving]]
        to[moving] = to[to[moving]]  # what lies between is larger still
        moving = moving[to[moving] >= 0]
    return to


def longest_previous_factors(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(LPF, source) of the suffixes at ``starts``, which are given in text order.

    LPF is the longest common prefix with any earlier start, up to ``length`` and in steps of eight
    bytes (so exact at ``length`` where that is a multiple of eight); source the index of such a start.
    """
    array = SuffixArray(data, length)
    order = np.argsort(array.rank[starts], kind="stable")  # start numbers in suffix order
    before = smaller_before(order)
    after = len(order) - 1 - smaller_before(order[::-1])[::-1]
    factor, source = np.zeros(len(starts), dtype=np.int64), np.full(len(starts), -1)
    for near in (before, after):
        has = np.flatnonzero((near >= 0) & (near < len(order)))
        mine, other = order[has], order[near[has]]
        common = array.common(starts[mine], starts[other])
        better = common > factor[mine]
        factor[mine[better]], source[mine[better]] = common[better], other[better]
    return factor, source


def repeated_windows(stretches: list[bytes], rows: list[np.ndarray], length: int, keep: str) -> list[np.ndarray]:
    """(doc, key, packed windows) to remove among the windows of some stretches, by LPF."""
    doc, key, at = rows
    low, n = unpack(at)
    in_text_order = np.lexsort((low, key, doc))
    if keep == "first":  # rows that agree in doc_id and text are one document
        in_text_order = in_text_order[np.append(True, np.any([x[in_text_order][1:] != x[in_text_order][:-1] for x in (doc, key, low)], axis=0))]
    doc, key, low, n = doc[in_text_order], key[in_text_order], low[in_text_order], n[in_text_order]
    stretches = [stretches[i] for i in in_text_order.tolist()]
    data = np.frombuffer(b"".join(stretches), dtype=np.uint8)
    begin = np.concatenate([[0], np.cumsum([len(s) for s in stretches])[:-1]])
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    factor, source = longest_previous_factors(data, np.repeat(begin, n) + inner, length)
    gone = factor >= length
    if keep == "none":
        gone[source[gone]] = True
    owner, inner = np.repeat(np.arange(len(stretches)), n)[gone], inner[gone]
    first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (np.diff(inner) > 1))) if len(owner) else np.zeros(0, dtype=np.int64)
    count = np.diff(np.append(first, len(owner)))
    owner = owner[first]
    return [doc[owner], key[owner], pack(low[owner] + inner[first], count)]


def parted(stretches: list[bytes], rows: list[np.ndarray], heavy: np.ndarray, length: int, core: int) -> pa.RecordBatch:
    """Rows (name, seg, doc, key, at, h) of the parts of some stretches, each of which has one core.

    A part holds windows in which the core lies about equally far from the start, and is named by all that
    these share, which is most of a window: of stretches that are alike only about their core most parts
    have a name that no other has. Equal windows lie in parts of one name, as before. h has the 128-bit
    digests of a part's windows; names of ``heavy`` stretches are odd, others even.
    """
    doc, key, at = rows
    texts, room = Texts(stretches), length - core
    wide = max(1, isqrt(room // 2))  # parts of a stretch, and windows of the one at the edge of what is shared, are about as many
    _, places, valid, text = window_names(texts, length, core)
    part = np.where(valid, places - np.arange(len(places)), 0) // wide
    start, count = windows_to_runs(places * (room + 1) + part, valid, text)
    own, part, place = text[start], part[start], places[start]
    shared = texts.prefix.hash(place - part * wide, place + length - np.minimum(part * wide + wide - 1, room))
    name = (mix(shared + part.astype(np.uint64), 6).view(np.int64) & ~1) | heavy[own]
    seg = digests(texts.bytes.data, start, start + count + length - 1)[:, 0]
    begin = np.repeat(start, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    h = digests(texts.bytes.data, begin, begin + length, 16)
    ends = np.concatenate([[0], np.cumsum(count) * 16]).astype(np.int32)
    packed = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(h.tobytes())])
    columns = [name, seg, doc[own], key[own], pack(start - texts.first[own] + unpack(at)[0][own], count)]
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), packed], names=[*RUN_COLUMNS, "h"])


def remove_repeats(docs: DataFrame, length: int = 400, keep: str = "none", core: int = 200, block_bytes: int = 250_000, carry: tuple[str, ...] = (), crowd: int = 200, heavy: int = 2000, block_parts: int = 5000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) and the columns ``carry`` for every row.

    A UTF-8 byte goes if a string of ``length`` bytes (a multiple of eight) that covers it also starts
    anywhere else, in the same document too; keep 'first' leaves the occurrence of the least
    (doc_id, position) and removes later copies. Strings are judged on the input and don't cross
    documents. n_spans counts the maximal removed runs.

    Null texts count as empty. Rows are told apart by doc_id and a hash of the text, null doc_ids
    come first; equal rows are occurrences of their own, except under 'first', where they are one
    document. Columns other than doc_id, text and ``carry`` are not read; ``carry`` can't name one of
    the result's own. An empty table gives no rows. A name with more than ``crowd`` stretches to
    compare (a passage in many documents, at its edges) would be a block without bound: its stretches
    are parted and meet once more by longer cores (``parted``), and the windows of the parts that still
    differ are compared by 128-bit digests: in blocks of whole names, and for a name that more than
    ``heavy`` parts have in a sort over all tasks, with the same result. Parts of names with more than
    ``heavy`` stretches are dealt to many tasks before that; those that turn out to be alone need nothing.
    """
    texts = keyed(docs, carry)
    hot = hot_names(texts, lambda some: run_table(some, length, core))
    flagged = stable(meet(run_table(texts, length, core), keep, hot, both=True))
    check = flagged.where("check")
    crowds = check.groupBy("name").count().where(F.col("count") > crowd).select("name")
    calm = check.join(crowds, "name", "left_anti")
    blocks = max(1, check.count() * (length + length - core) // block_bytes)

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[bytes]]]:
        for rows, raw in text_groups(batches):
            columns = {c: [] for c in ("name", "doc", "key", "at")}
            data = []
            for text, doc, key, ats, names in zip(raw, *(rows.column(c).to_pylist() for c in ("doc", "key", "_at", "_name"))):
                low, n = unpack(np.array(ats, dtype=np.int64))
                data += [text[a : a + k + length - 1] for a, k in zip(low.tolist(), n.tolist())]
                for c, values in zip(columns, (names, [doc] * len(ats), [key] * len(ats), ats)):
                    columns[c] += values
            yield columns, data

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, data in stretches(batches):
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in columns.values()), pa.array(data, pa.binary())], names=[*columns, "data"])

    def by_suffixes(block: pa.Table) -> pa.Table:
        rows = repeated_windows(block.column("data").to_pylist(), [block.column(c).to_numpy() for c in ("doc", "key", "at")], length, keep)
        return pa.table(dict(zip(("doc", "key", "at"), (pa.array(x, pa.int64()) for x in rows))))

    def refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, data in stretches(batches):
            name, doc, key, at = (np.array(x, dtype=np.int64) for x in columns.values())
            for some in in_groups(data):
                yield parted(data[some], [x[some] for x in (doc, key, at)], np.isin(name[some], known), length, core)

    def one_by_one(parts: pa.RecordBatch | pa.Table) -> list[np.ndarray]:
        low, n = unpack(parts.column("at").to_numpy())
        h = np.frombuffer(b"".join(parts.column("h").to_pylist()), dtype="<i8").reshape(-1, 2)
        begin = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return [h[:, 0], h[:, 1], *(np.repeat(parts.column(c).to_numpy(), n) for c in ("doc", "key")), pack(begin, np.ones(len(begin), dtype=np.int64))]

    def by_digests(block: pa.Table) -> pa.Table:
        return pa.table(dict(zip(("doc", "key", "at"), (pa.array(x, pa.int64()) for x in equal_in(one_by_one(block), keep)))))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in one_by_one(batch)], names=["h1", "h2", "doc", "key", "at"])

    found = with_stretches(texts, calm, columns=("at", "name")).mapInArrow(cut_out, "name bigint, doc bigint, key bigint, at bigint, data binary")
    same = found.groupBy(F.pmod(F.xxhash64("name"), F.lit(blocks)).alias("block")).applyInArrow(by_suffixes, "doc bigint, key bigint, at bigint")
    gone = flagged.where("gone").select("doc", "key", "at").union(same)
    rest = check.join(crowds, "name", "left_semi")
    if not crowds.isEmpty():
        largest = check.groupBy("name").count().where(F.col("count") > heavy).orderBy(F.desc("count"), "name").limit(500).collect()
        known = np.array([r["name"] for r in largest], dtype=np.int64)
        parts = with_stretches(texts, rest, columns=("at", "name")).mapInArrow(refined, f"{RUN_SCHEMA}, h binary")
        judged = stable(meet(parts, keep, [], both=False, odd_hot=True))
        unlike = judged.where("check").select("name", "doc", "key", "at", "h")
        unlike = unlike.join(unlike.groupBy("name").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "name")
        block = F.pmod(F.xxhash64("name"), F.lit(max(1, judged.count() // block_parts))).alias("block")
        few = unlike.where(F.col("_n") <= heavy).groupBy(block).applyInArrow(by_digests, "doc bigint, key bigint, at bigint")
        rows = unlike.where(F.col("_n") > heavy).select("doc", "key", "at", "h").mapInArrow(windows, "h1 bigint, h2 bigint, doc bigint, key bigint, at bigint")
        gone = gone.union(judged.where("gone").select("doc", "key", "at")).union(few).union(equal_windows(rows, keep))
    own = [f"_c{i}" for i in range(len(carry))]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw in text_groups(batches):
            removed, spans, kept, size = [], [], [], []
            for text, ats in zip(raw, rows.column("_at").to_pylist()):
                text = text or b""
                size.append(len(text))
                if not ats:
                    removed.append(0), spans.append(0), kept.append(text)
                    continue
                out = covered(len(text), np.array(ats, dtype=np.int64), length)
                removed.append(int(out.sum()))
                spans.append(int(np.count_nonzero(np.diff(out, prepend=False) & out)))
                kept.append(np.frombuffer(text, dtype=np.uint8)[~out].tobytes())
            counts = [pa.array(x, pa.int64()) for x in (size, removed, spans)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *counts, pa.array(kept, pa.binary()), *map(rows.column, own)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", *carry])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join(["doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary", *(f"`{c}` {kinds[c]}" for c in carry)])
    return with_stretches(texts, gone, "left").mapInArrow(cut, schema)
