"""Byte-level BPE encoding and decoding.

Words are found without a regular expression: every code point gets a class, every class is a
function on the states of a small automaton, and because composing such functions is associative
the state before each code point comes from a scan over function numbers. The slices go through
pair merging behind a cache, and each token keeps its byte offset in the text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from paperloom.llm.words import GROUP, text_groups

LETTER, NUMBER, OTHER, QUOTE1, QUOTE2, SPACE, BLANK, LAST_SPACE, LAST_BLANK, END, PAD = range(11)
START, JOIN, IN_LETTERS, IN_NUMBERS, IN_OTHER, ONE_MORE, TWO_MORE, QUOTED, IN_BLANKS = range(9)
# Code points with the White_Space property.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Letters and numbers that Unicode 16 added, for interpreters that come with Unicode 15.
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]


def _rule(kind: int, state: int) -> tuple[int, bool]:
    """State after a code point of a class, and whether a new slice begins at that code point."""
    if kind == PAD:
        return state, False
    if kind == END or kind == LAST_BLANK:
        return START, True
    if kind == LAST_SPACE:
        return JOIN, True
    if kind in (SPACE, BLANK):
        return IN_BLANKS, state != IN_BLANKS
    if state in (ONE_MORE, TWO_MORE):  # only letters that were looked ahead at get here
        return (QUOTED if state == ONE_MORE else ONE_MORE), False
    if kind in (QUOTE1, QUOTE2) and state not in (JOIN, IN_OTHER):
        return (ONE_MORE if kind == QUOTE1 else TWO_MORE), True
    run = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS}.get(kind, IN_OTHER)
    return run, state not in (JOIN, run)


@lru_cache(maxsize=1)
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(function number of each class, composition table, functions, slice begins by class and state)."""
    rules = [[_rule(k, s) for s in range(9)] for k in range(11)]
    base = [tuple(to for to, _ in row) for row in rules]
    found = dict.fromkeys(base)
    numbers = {f: i for i, f in enumerate(found)}
    queue = list(numbers)
    for f in queue:
        for g in base:
            h = tuple(g[s] for s in f)
            if h not in numbers:
                numbers[h] = len(numbers)
                queue.append(h)
    functions = np.array(queue, dtype=np.uint8)
    compose = np.array([[numbers[tuple(g[s] for s in f)] for g in queue] for f in queue], dtype=np.uint16)
    return np.array([numbers[f] for f in base], dtype=np.uint16), compose, functions, np.array([[b for _, b in row] for row in rules])


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point, before looking at its neighbours."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], dtype=np.uint8)
    for ranges, kind in ((NEW_LETTERS, LETTER), (NEW_NUMBERS, NUMBER)):
        for first, last in ranges:
            table[first : last + 1] = kind
    table[WHITE] = BLANK
    table[0x20] = SPACE
    return table


def slice_starts(points: np.ndarray, ends: np.ndarray, width: int = 128) -> np.ndarray:
    """Indices where slices begin; ``ends`` are the code points that end a text (slices of their own)."""
    number_of, compose, functions, begins = automaton()
    kind = classes()[points]
    kind[ends] = END
    after = np.append(points[1:], 0)
    after2 = np.append(points[2:], [0, 0])[: len(points)]
    quote = points == 0x27
    after_end = np.append(kind[1:], END) == END
    blank = (kind == SPACE) | (kind == BLANK)
    last = blank & ~after_end & ~np.append(blank[1:], True)
    kind[last] += 2  # SPACE, BLANK -> LAST_SPACE, LAST_BLANK
    letter = lambda c: after == ord(c)
    kind[quote & ~after_end & (letter("s") | letter("t") | letter("m") | letter("d"))] = QUOTE1
    two = (letter("r") | letter("v")) & (after2 == ord("e")) | letter("l") & (after2 == ord("l"))
    kind[quote & ~after_end & two & ~np.append(after_end[1:], True)] = QUOTE2
    rows = -(-len(kind) // width)
    grid = np.full(rows * width, PAD, dtype=np.uint8)
    grid[: len(kind)] = kind
    number = number_of[grid].reshape(rows, width).T.copy()
    flat, k = compose.ravel(), len(functions)
    for j in range(1, width):  # prefix functions within each row, all rows at once
        number[j] = flat[number[j - 1].astype(np.int32) * k + number[j]]
    total, step = number[-1].copy(), 1
    while step < rows:  # prefix functions of whole rows
        total[step:] = flat[total[:-step].astype(np.int32) * k + total[step:]]
        step *= 2
    first = np.concatenate([[START], functions[total[:-1], START]])
    state = np.empty((width, rows), dtype=np.uint8)
    state[0] = first
    state[1:] = functions[number[:-1], first[None, :]]
    return np.flatnonzero(begins[grid, state.T.ravel()][: len(kind)])


class Tokenizer:
    """Ranks of byte strings -> encode and decode; merged slices are remembered, up to a bound."""

    def __init__(self, rank_file: bytes, remembered: int = 300_000):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)}
        self.words = [b""] * (max(self.ranks.values()) + 1)
        for word, rank in self.ranks.items():
            self.words[rank] = word
        self.decimal = [str(i) for i in range(len(self.words))]
        self.bytes, self.sizes = np.frombuffer(b"".join(self.words), dtype=np.uint8), np.array([len(w) for w in self.words])
        self.begins = np.cumsum(self.sizes) - self.sizes  # where each token lies in `bytes`
        self.byte_ids = [self.ranks[bytes([b])] for b in range(256)]
        self.pairs = {}  # any two tokens whose bytes together are a token
        for word, rank in self.ranks.items():
            for cut in range(1, len(word)):
                left, right = self.ranks.get(word[:cut]), self.ranks.get(word[cut:])
                if left is not None and right is not None:
                    self.pairs[left << 32 | right] = rank
        keys = np.fromiter(self.pairs, dtype=np.int64, count=len(self.pairs))
        order = np.argsort(keys)
        self.pair_keys = np.append(keys[order], np.iinfo(np.int64).max)  # the same pairs for many lookups at once
        self.pair_ranks = np.append(np.fromiter(self.pairs.values(), dtype=np.int64, count=len(keys))[order], len(self.words))
        self.remembered, self.held, self.seen = remembered, 0, {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Merge the adjacent pair of the least rank, the leftmost first, until no pair has a rank."""
        if (whole := self.ranks.get(piece)) is not None:
            return (whole,)
        if len(piece) > 200:
            return self.merge_long(piece)
        pair, never = self.pairs.get, len(self.words)
        ids = list(map(self.byte_ids.__getitem__, piece))
        ranks = [pair(a << 32 | b, never) for a, b in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) < never:
            i = ranks.index(least)
            ids[i : i + 2] = [least]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = pair(least << 32 | ids[i + 1], never)
            if i:
                ranks[i - 1] = pair(ids[i - 1] << 32 | least, never)
        return tuple(ids)

    def merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same through a heap and a linked list, for slices of any length."""
        pair, n = self.pairs.get, len(piece)
        ids: list[int | None] = list(map(self.byte_ids.__getitem__, piece))
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pair(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            if ids[i] != left or (j := after[i]) >= n or ids[j] != right:
                continue
            ids[i], ids[j], after[i] = rank, None, after[j]
            if (k := after[i]) < n:
                before[k] = i
                if (r := pair(rank << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[k]))
            if (h := before[i]) >= 0 and (r := pair(ids[h] << 32 | rank)) is not None:
                heapq.heappush(heap, (r, h, ids[h], rank))
        return tuple(i for i in ids if i is not None)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of tokens; the number of words where a pair has none."""
        keys = left << 32 | right
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], len(self.words))

    def merge_all(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """What ``merge`` gives for each piece; those of up to 64 bytes take their merges side by side, one a round."""
        out = [(rank,) if (rank := self.ranks.get(p)) is not None else None if len(p) <= 64 else self.merge(p) for p in pieces]
        todo = [i for i, got in enumerate(out) if got is None]
        if not todo:
            return out
        never, number = len(self.words), np.array(todo)
        size = np.array([len(pieces[i]) for i in todo])
        ids = np.array(self.byte_ids)[np.frombuffer(b"".join(pieces[i] for i in todo), dtype=np.uint8)]
        ranks = np.full(len(ids), never)  # of each token with the next one of its piece
        ranks[:-1] = self.rank_of(ids[:-1], ids[1:])
        ranks[np.cumsum(size) - 1] = never
        while len(number):
            begin = np.cumsum(size) - size
            place = ranks * len(ids) + np.arange(len(ids))  # by rank, the leftmost first
            least = np.minimum.reduceat(place, begin)
            done = least >= never * len(ids)
            if done.any():
                flat, stays = ids[np.repeat(done, size)].tolist(), ~done
                end = np.cumsum(size[done]).tolist()
                for i, a, b in zip(number[done].tolist(), [0, *end], end):
                    out[i] = tuple(flat[a:b])
                kept = np.repeat(stays, size)
                least, shift = least[stays] % len(ids), np.cumsum(~kept)
                least -= shift[least]
                number, size, ids, ranks = number[stays], size[stays], ids[kept], ranks[kept]
                if not len(number):
                    break
                begin = np.cumsum(size) - size
            else:
                least %= len(ids)
            ids[least] = ranks[least]
            stays = np.ones(len(ids), dtype=bool)
            stays[least + 1] = False
            last = least + 2 == begin + size  # the pair ended its piece
            after = np.minimum(least + 2, len(ids) - 1)
            ranks[least] = np.where(last, never, self.rank_of(ids[least], ids[after]))
            inner = least[least > begin]
            ranks[inner - 1] = self.rank_of(ids[inner - 1], ids[inner])
            ids, ranks, size = ids[stays], ranks[stays], size - 1
        return out

    def learn(self, pieces: list[bytes]) -> None:
        """Put the slices of a batch into the cache; it starts anew once it holds too much."""
        if len(self.seen) > self.remembered or self.held > 32_000_000:
            self.forget()
        new = list(set(pieces).difference(self.seen))
        self.seen.update(zip(new, self.merge_all(new)))
        self.held += sum(map(len, new))

    def forget(self) -> None:
        """Empty the cache, so that a worker that waits for other work holds the vocabulary alone."""
        self.seen, self.held = {}, 0

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """Token ids of each text. The texts are laid end to end and sliced together."""
        if not texts:
            return []
        joined = "\n".join(texts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        starts = slice_starts(points, ends)
        widths = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        at = np.append(np.concatenate([[0], np.cumsum(widths)])[starts], widths.sum()).tolist()
        buffer = joined.encode()
        pieces = [buffer[a:b] for a, b in zip(at, at[1:])]
        self.learn(pieces)
        last = np.searchsorted(starts, ends).tolist()  # the slice that ends each text
        out, begin = [], 0
        for end in last:
            out.append(list(chain.from_iterable(map(self.seen.__getitem__, pieces[begin:end]))))
            begin = end + 1
        return out

    def encode_all(self, texts: list[str | None], most: int = GROUP) -> Iterator[list[int]]:
        """Token ids of each text in order, with at most about ``most`` code points laid out at once."""
        group, size = [], 0
        for text in texts:
            text = text or ""
            if len(text) > most:
                yield from self.encode_batch(group)
                group, size = [], 0
                yield list(chain.from_iterable(self.encode_batch([part])[0] for part in parts(text, most)))
                continue
            if size + len(text) > most:
                yield from self.encode_batch(group)
                group, size = [], 0
            group.append(text)
            size += len(text) + 1
        yield from self.encode_batch(group)

    def offsets(self, ids: list[int] | np.ndarray) -> np.ndarray:
        """Byte offset at which each token begins, with the length of the text at the end."""
        return np.concatenate([[0], np.cumsum(self.sizes[np.asarray(ids, dtype=np.int64)], dtype=np.int64)])

    def decode(self, ids: list[int] | np.ndarray, offsets: np.ndarray, most: int = 1 << 16) -> bytes:
        """The text's bytes: those of every token are put at its offset, ``most`` tokens at a time."""
        ids, out = np.asarray(ids, dtype=np.int64), np.empty(int(offsets[-1]), dtype=np.uint8)
        for k in range(0, len(ids), most):
            part, to = ids[k : k + most], offsets[k : k + most + 1]
            from_token = np.repeat(self.begins[part] - to[:-1], np.diff(to))
            out[to[0] : to[-1]] = self.bytes[np.arange(to[0], to[-1]) + from_token]
        return out.tobytes()

    def stretch(self, ids: list[int], offsets: np.ndarray, begin: int, end: int) -> bytes:
        """The bytes from ``begin`` to ``end`` of the text, from only those tokens that hold them."""
        if begin >= end:
            return b""
        a, b = int(np.searchsorted(offsets, begin, "right")) - 1, int(np.searchsorted(offsets, end, "left"))
        return self.decode(ids[a:b], offsets[a : b + 1] - offsets[a])[begin - int(offsets[a]) : end - int(offsets[a])]


def parts(text: str, most: int) -> Iterator[str]:
    """Cut a long text before single spaces, where a slice begins whatever came before."""
    begin = 0
    while len(text) - begin > most:
        at = text.find(" ", begin + most)
        while at >= 0 and (at + 1 >= len(text) or ord(text[at + 1]) in WHITE):
            at = text.find(" ", at + 1)
        if at < 0:
            break
        yield text[begin:at]
        begin = at
    yield text[begin:]


_loaded: dict[str, Tokenizer] = {}


def tokenizer(rank_file: bytes) -> Tokenizer:
    """The tokenizer of this process for a rank file."""
    key = hashlib.sha256(rank_file).hexdigest()
    if key not in _loaded:
        _loaded[key] = Tokenizer(rank_file)
    return _loaded[key]


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Replace ``text`` by ``ids`` (array<int>) and ``offsets`` (array<bigint>, byte offset of each token, and the text's length).

    ``vocabulary`` is the path of a rank file on the driver; its bytes go to the tasks. A null text
    counts as empty and gives no ids and the offset 0; other columns pass through, repeated rows each give a row.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(_read(vocabulary))  # one vocabulary file
    rest = [c for c in docs.columns if c not in ("text", "ids", "offsets")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(ranks.value)
        for rows, texts in text_groups(batches):
            ids = list(t.encode_all(texts))
            columns = [rows.column(c) for c in rest] + [pa.array(ids, pa.list_(pa.int32())), pa.array([t.offsets(i) for i in ids], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*rest, "ids", "offsets"])
        t.forget()

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in rest), "ids array<int>, offsets array<bigint>"])
    return docs.select(*rest, "text").mapInArrow(run, schema)


def decode(tokens: DataFrame, vocabulary: str) -> DataFrame:
    """Replace ``ids`` (null: none) by ``text``; bytes that are not UTF-8 become replacement characters.

    ``offsets``, where given, say where each token's bytes go; else they are found again. Other
    columns pass through, each row gives a row.
    """
    ranks = tokens.sparkSession.sparkContext.broadcast(_read(vocabulary))
    rest = [c for c in tokens.columns if c not in ("ids", "offsets", "text")]
    placed = "offsets" in tokens.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(ranks.value)
        for batch in batches:
            ids = [x or [] for x in batch.column("ids").to_pylist()]
            given = batch.column("offsets").to_pylist() if placed else [None] * len(ids)
            texts = [t.decode(x, t.offsets(x) if at is None else np.array(at)).decode(errors="replace") for x, at in zip(ids, given)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(texts, pa.string())], names=[*rest, "text"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema if f.name in rest), "text string"])
    return tokens.select(*rest, "ids", *["offsets"] * placed).mapInArrow(run, schema)


def round_trip(docs: DataFrame, vocabulary: str, with_ids: bool = False) -> DataFrame:
    """Encode every text and decode its ids by their offsets: doc_id, n_tokens, ids_sha256, decoded_sha256.

    The same tokenizer as ``encode`` and ``decode`` in one task; ids and offsets leave it (as columns
    of these names) only if asked for. A null or empty text has no tokens and the digests of the empty
    string; each row gives a row; other columns are not read. A text is cut for the work only before
    single spaces; one without any is laid out whole.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(_read(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(ranks.value)
        for rows, texts in text_groups(batches):
            count, ids_hex, text_hex, every, places = [], [], [], [], []
            for ids in t.encode_all(texts):
                numbers = np.array(ids, dtype=np.int64)
                offsets = t.offsets(numbers)
                count.append(len(ids))
                ids_hex.append(hashlib.sha256(",".join(map(t.decimal.__getitem__, ids)).encode()).hexdigest())
                text_hex.append(hashlib.sha256(t.decode(numbers, offsets)).hexdigest())
                if with_ids:
                    every.append(ids), places.append(offsets)
            columns = [rows.column("doc_id"), pa.array(count, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())]
            columns += [pa.array(every, pa.list_(pa.int32())), pa.array(places, pa.list_(pa.int64()))] if with_ids else []
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "offsets"] * with_ids)
        t.forget()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, offsets array<bigint>" * with_ids)


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()
