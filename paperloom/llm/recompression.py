"""Substring dedup by recompression.

Rounds rename runs of one symbol and then pairs of symbols: a symbol's side (left or right) is a bit
of its hash in that round, and a left symbol joins the right symbol after it. A name is a hash of
what it stands for, so tasks on any machine give equal substrings equal interior symbols without
asking each other. Every symbol also knows the stretch of words that decides it; wherever that
stretch recurs, so does the symbol. A window of words is named by the highest symbol decided within
it and the words that decide it; documents meet at shared names in one Spark shuffle, and equal digests of stretches and windows verify.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.repeats import RUN_COLUMNS, RUN_SCHEMA, covered, equal_windows, hot_names, keyed, meet, pack, unpack, windows_to_runs, with_stretches
from paperloom.llm.words import GROUP, M2, Prefix, Words, digests, mix, text_groups
from paperloom.tables import stable

FAR = np.int64(1) << np.int64(40)  # a context that reaches past the text decides nothing
NUMBER, NONE = np.uint64((1 << 28) - 1), np.uint64((1 << 64) - 1)  # low bits that number the symbols of a batch


def recompress(symbols: np.ndarray, text: np.ndarray, rounds: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(symbols, first and last + 1 word that decide each) before the first and after every round."""
    low, high = np.arange(len(symbols), dtype=np.int64), np.arange(1, len(symbols) + 1, dtype=np.int64)
    yield symbols, low, high
    for r in range(rounds):
        # runs: a symbol's fate hangs on both neighbours of its run
        link = (symbols[1:] == symbols[:-1]) & (text[1:] == text[:-1])
        begin = np.flatnonzero(np.append(True, ~link))
        end = np.append(begin[1:], len(symbols)) - 1
        count = end - begin + 1
        symbols = np.where(count > 1, mix(symbols[begin] + count.astype(np.uint64) * M2, 2 * r + 1), symbols[begin])
        low, high, text = low[begin], high[end], text[begin]
        low, high = _reach(low, high, text, left=True, right=True)
        # pairs
        right = (mix(symbols, 100 + r) >> np.uint64(63)).astype(bool)
        join = ~right[:-1] & right[1:] & (text[1:] == text[:-1])
        joined = np.append(join, False)
        second = np.append(False, join)
        wide_low, wide_high = _reach(low, high, text, left=right & ~second, right=~right & ~joined)
        first = np.flatnonzero(~second)
        pair = joined[first]
        mate = np.minimum(first + 1, len(symbols) - 1)
        symbols = np.where(pair, mix(symbols[first] * M2 + mix(symbols[mate], 3), 2 * r + 2), symbols[first])
        low = np.where(pair, np.minimum(low[first], low[mate]), wide_low[first])
        high = np.where(pair, np.maximum(high[first], high[mate]), wide_high[first])
        text = text[first]
        yield symbols, low, high


def _reach(low: np.ndarray, high: np.ndarray, text: np.ndarray, left: np.ndarray | bool, right: np.ndarray | bool) -> tuple[np.ndarray, np.ndarray]:
    """Widen what decides a symbol by its neighbour on the left or right; past a text's end, without bound."""
    before = np.append(True, text[1:] != text[:-1])
    after = np.append(text[1:] != text[:-1], True)
    new_low = np.where(left, np.where(before, -FAR, np.minimum(low, np.append(low[:1], low[:-1]))), low)
    new_high = np.where(right, np.where(after, FAR, np.maximum(high, np.append(high[1:], high[-1:]))), high)
    # a neighbour's own context may reach to the other side as well
    new_high = np.where(left, np.maximum(new_high, np.where(before, new_high, np.append(high[:1], high[:-1]))), new_high)
    new_low = np.where(right, np.minimum(new_low, np.where(after, new_low, np.append(low[1:], low[-1:]))), new_low)
    return new_low, new_high


def window_names(hashes: np.ndarray, first: np.ndarray, width: int, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name of the window that begins at each word, place of the symbol that names it, whether a window begins, text of each word)."""
    n = len(hashes)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    last = first[1:][text] - width  # last window of the text
    valid = np.arange(n) <= last
    names, places = np.zeros(n, dtype=np.uint64), np.full(n, -1, dtype=np.int64)
    if not valid.any():
        return names, places, valid, text
    levels = list(recompress(hashes, text, rounds))
    open_, stretch = valid.copy(), Prefix(hashes, 23)
    for level in range(rounds, -1, -1):
        symbols, low, high = levels[level]
        ok = high - low <= width
        symbols, low, high = symbols[ok], low[ok], high[ok]
        a, b = np.maximum(high - width, first[:-1][text[low]]), np.minimum(low, last[low])
        waiting = np.append(0, np.cumsum(open_))
        some = (b >= a) & (waiting[np.maximum(b + 1, 0)] > waiting[np.maximum(a, 0)])
        a, b, symbols, low, high = a[some], b[some], symbols[some], low[some], high[some]
        order = (mix(symbols, 77) & ~NUMBER) | np.arange(len(symbols), dtype=np.uint64)  # the leftmost of equal ones
        best = _least_over(a, b, order, n, width)
        done = np.flatnonzero(open_ & (best != NONE))
        chosen = (best[done] & NUMBER).astype(np.int64)
        names[done] = mix(symbols[chosen] + stretch.hash(low[chosen], high[chosen]), level)
        places[done] = chosen * (rounds + 1) + level
        open_[done] = False
        if not open_.any():
            break
    return names, places, valid, text


def _least_over(a: np.ndarray, b: np.ndarray, values: np.ndarray, n: int, width: int) -> np.ndarray:
    """For each place the least value of the ranges a..b (at most ``width`` long) that hold it."""
    top = width.bit_length()
    table = np.full((top, n), NONE, dtype=np.uint64)
    power = np.frexp((b - a + 1).astype(np.float64))[1] - 1
    for p in range(top - 1, -1, -1):
        at = power == p
        np.minimum.at(table[p], a[at], values[at])
        np.minimum.at(table[p], b[at] - (1 << p) + 1, values[at])
        if p:
            half = 1 << (p - 1)
            np.minimum(table[p - 1], table[p], out=table[p - 1])
            np.minimum(table[p - 1][half:], table[p][: n - half], out=table[p - 1][half:])
    return table[0]


def pieces(words: Words, hashes: np.ndarray, width: int, most: int = GROUP // 4) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(word hashes, first word of each text, words before): one long text comes in pieces that overlap by ``width`` - 1 words."""
    if len(words.first) > 2 or len(hashes) <= most + width:
        yield hashes, words.first, 0
        return
    for begin in range(0, len(hashes) - width + 1, most):
        part = hashes[begin : begin + most + width - 1]
        yield part, np.array([0, len(part)]), begin


def run_table(docs: DataFrame, width: int, rounds: int) -> DataFrame:
    """Rows (name, seg, doc, key, at) of ``keyed`` texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_groups(batches):
            doc, key = rows.column("doc").to_numpy(), rows.column("key").to_numpy()
            words = Words(texts)
            for hashes, first, before in pieces(words, words.hashes(), width):
                names, places, valid, text = window_names(hashes, first, width, rounds)
                start, count = windows_to_runs(places, valid, text)
                if not len(start):
                    continue
                seg = digests(hashes.tobytes(), start * 8, (start + count + width - 1) * 8)[:, 0]
                own = text[start]
                columns = [names[start].view(np.int64), seg, doc[own], key[own], pack(start - first[own] + before, count)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=RUN_COLUMNS)

    return docs.select("doc", "key", "text").mapInArrow(run, RUN_SCHEMA)


def remove_repeats(docs: DataFrame, width: int = 35, keep: str = "none", rounds: int = 2) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words joined by one space) for every row.

    A word goes if a window of ``width`` words that holds it also starts anywhere else, in the same
    document too; keep 'first' leaves the occurrence of the least (doc_id, position). Windows are
    judged on the input. Words are runs of bytes other than 0x20 and 0x09 to 0x0D, unchanged.

    Null or empty texts have no words. Rows are told apart by doc_id and a hash of the text; equal
    rows are occurrences of their own, except under 'first', where they are one document. Columns
    other than doc_id and text are not read. An empty table gives no rows.
    """
    texts = keyed(docs)
    hot = hot_names(texts, lambda some: run_table(some, width, rounds))
    flagged = stable(meet(run_table(texts, width, rounds), keep, hot, both=False))

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw in text_groups(batches):
            words = Words(raw)
            data = words.hashes().tobytes()
            for i, (ats, doc, key) in enumerate(zip(*(rows.column(c).to_pylist() for c in ("_at", "doc", "key")))):
                low, n = unpack(np.array(ats, dtype=np.int64))
                begin = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = (begin + words.first[i]) * 8
                h = digests(data, start, start + 8 * width, 16)
                columns = [h[:, 0], h[:, 1], np.full(len(begin), doc), np.full(len(begin), key), pack(begin, np.ones(len(begin), dtype=np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["h1", "h2", "doc", "key", "at"])

    checks = with_stretches(texts, flagged.where("check"))
    same = equal_windows(checks.mapInArrow(digested, "h1 bigint, h2 bigint, doc bigint, key bigint, at bigint"), keep)
    gone = flagged.where("gone").select("doc", "key", "at").union(same)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw in text_groups(batches):
            total, removed, kept = [], [], []
            for text, ats in zip(raw, rows.column("_at").to_pylist()):
                words = (text or b"").split()  # the same six bytes
                out = covered(len(words), np.array(ats or [], dtype=np.int64), width)
                total.append(len(words))
                removed.append(int(out.sum()))
                kept.append(b" ".join([w for w, o in zip(words, out.tolist()) if not o] if removed[-1] else words).decode(errors="replace"))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return with_stretches(texts, gone, "left").mapInArrow(cut, "doc_id bigint, n_words bigint, n_removed bigint, kept string")
