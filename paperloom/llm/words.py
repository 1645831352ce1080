"""Words, their hashes and shingles for many texts at once, on numpy arrays."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GROUP = 1 << 18  # bytes of text that an operator lays out at once

#: The bytes 0x20 and 0x09 to 0x0D stand between words.
GAP = np.zeros(256, dtype=bool)
GAP[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit."""
    x = x + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) + M1
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def odd(salt: int) -> int:
    return int(mix(np.array([salt], dtype=np.uint64))[0]) | 1


@lru_cache(maxsize=8)
def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1), modulo 2 ** 64."""
    out = np.ones(n, dtype=np.uint64)
    step, have = np.array([base], dtype=np.uint64), 1
    while have < n:
        take = min(have, n - have)
        out[have : have + take] = out[:take] * step
        step = step * step
        have += take
    return out


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


class Prefix:
    """Sums of value x base ** position, so that any stretch has a name in O(1).

    Equal stretches have equal names wherever they lie. Different ones may share a name (sums modulo
    2 ** 64 agree for some strings of two symbols whatever the base), so names only bring together
    what is then compared by ``digest`` or byte by byte. ``values`` are 64-bit numbers.
    """

    def __init__(self, values: np.ndarray, salt: int):
        base, room = odd(salt), 1 << max(10, int(len(values) + 1).bit_length())
        self.back = powers(inverse(base), room)
        self.sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * powers(base, room)[: len(values)], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start])


def digests(data: bytes, start: np.ndarray, end: np.ndarray, size: int = 8) -> np.ndarray:
    """BLAKE2b digests of some stretches, as rows of ``size`` / 8 signed 64-bit numbers."""
    view = memoryview(data)
    found = b"".join(blake2b(view[a:b], digest_size=size).digest() for a, b in zip(start.tolist(), end.tolist()))
    return np.frombuffer(found, dtype="<i8").reshape(-1, size // 8)


def chained(values: np.ndarray, width: int, salt: int) -> np.ndarray:
    """A hash of every ``width`` consecutive values, each step of which mixes all bits."""
    n = max(0, len(values) - width + 1)
    out = mix(values[:n], salt + width)
    for i in range(1, width):
        out = mix((out ^ (out >> np.uint64(29))) * M2 + values[i : n + i], salt)
    return out


BYTE_VALUES = mix(np.arange(256, dtype=np.uint64), 101)
LONG_WORD = 64
LOW_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each word: eight at a time, or a digest for a long word."""
    size = end - start
    padded = np.append(data, np.zeros(8, dtype=np.uint8))
    eights = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    out = mix(size.astype(np.uint64), 7)
    at = np.flatnonzero(size <= LONG_WORD)
    done = 0
    while len(at):
        piece = eights[start[at] + done] & LOW_BYTES[np.minimum(size[at] - done, 8)]
        out[at] = mix((out[at] ^ (out[at] >> np.uint64(29))) * M3 + piece, done)
        done += 8
        at = at[size[at] > done]
    long = np.flatnonzero(size > LONG_WORD)
    if len(long):
        out[long] = digests(data.tobytes(), start[long], end[long])[:, 0].view(np.uint64)
    return out


class Words:
    """The words of some texts (bytes; None: none), laid end to end."""

    def __init__(self, texts: list[bytes | None], lower: bool = False):
        joined = b"\n".join(t or b"" for t in texts) + b"\n"
        self.bytes = np.frombuffer(joined, dtype=np.uint8)
        if lower:
            self.bytes = LOWER[self.bytes]
        gap = GAP[self.bytes]
        edge = np.flatnonzero(np.diff(gap, prepend=True))  # gap to word, word to gap, in turn
        self.start, self.end = edge[0::2], edge[1::2]
        text_end = np.cumsum([len(t or b"") + 1 for t in texts])
        #: words of text i are first[i] to first[i + 1]
        self.first = np.concatenate([[0], np.searchsorted(self.start, text_end)]).astype(np.int64)
        self.text_start = text_end - np.array([len(t or b"") + 1 for t in texts])

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word."""
        return word_hashes(self.bytes, self.start, self.end)


def in_groups(texts: list, most: int = GROUP) -> Iterator[slice]:
    """Stretches of a list of texts of at most about ``most`` bytes each; a longer text comes alone."""
    begin = size = 0
    for i, t in enumerate(texts):
        n = len(t or b"") + 1
        if size and size + n > most:
            yield slice(begin, i)
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield slice(begin, len(texts))


def text_groups(batches: Iterable[pa.RecordBatch], most: int = GROUP) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Stretches of the batches of about ``most`` bytes of the column ``text``, each with its texts.

    A batch holds up to 10,000 whole texts; only those of one stretch become Python objects at a time.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        begin = 0
        while begin < len(ends):
            base = int(ends[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, base + most, "right")))
            part = batch.slice(begin, end - begin)
            yield part, part.column("text").to_pylist()
            begin = end


def shingle_sets(texts: list[bytes | None], k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each text; fewer words make one shingle, none an empty set."""
    words = Words(texts, lower=True)
    h = words.hashes()
    full = chained(h, k, 11)
    out = []
    for a, b in zip(words.first.tolist(), words.first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(full[a : b - k + 1]))
        elif b > a:
            out.append(chained(h[a:b], b - a, 11))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
