"""Quality rules: counts of words, symbols and repeats, and compression bands."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.words import Words, chained, text_groups

#: The characters that count as symbols.
SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Bands:
    """Limits of compressed / original size by text length: (at most so many bytes, least, most).

    Short texts hardly compress and their ratio says little, so their band is wide; the longer a
    text, the more of it a compressor can point back to, and the lower prose comes. A chunk is
    judged by the band of its own size. The upper limits lie between prose and words of random
    base64 (at least 0.93 at 256 bytes, 0.77 at 1 KB, 0.74 at 4 KB), from 4 KB on below words of
    random letters (0.59); shorter ones of these pass, as does all noise of up to 128 bytes.
    """

    level: int = 3
    chunk: int = 4096
    bands: tuple[tuple[float, float, float], ...] = ((64, 0.0, 9.9), (128, 0.30, 1.2), (192, 0.30, 0.96), (256, 0.30, 0.88), (512, 0.42, 0.80), (1024, 0.42, 0.74), (4096, 0.38, 0.68), (16384, 0.36, 0.58), (65536, 0.33, 0.57), (float("inf"), 0.25, 0.55))
    bad_chunks: float = 0.25  # a text falls if more than this share of its bytes lies in chunks that do

    def verdict(self, size: int, ratio: float) -> int:
        """-1: repetitive, 1: incompressible, 0: neither."""
        for most, low, high in self.bands:
            if size <= most:
                return -1 if ratio < low else int(ratio > high)
        return 0


def repeated(names: np.ndarray, width: int) -> int:
    """Words in ``width``-word windows that are found twice or more, the first included."""
    if not len(names):
        return 0
    order = np.argsort(names, kind="stable")
    same = names[order][1:] == names[order][:-1]
    twice = np.zeros(len(names), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(names) + width, dtype=np.int32)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int(np.count_nonzero(np.cumsum(edge)))


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line.strip(b" \t\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def quality_features(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """doc_id and the features of every whole text, with the verdict of the base rules and the bands.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines, n_repeat_words (long);
    base_failed: fewer than 10 words, or more than a fifth of the words in repeated 5-word windows;
    ratio (compressed / original size of the whole text), chunk_low and chunk_high (share of
    fixed-size chunks below and above their band); kept: base rules and bands passed.

    A null or empty text has no words, ratio 1.0, and fails the base rules. Each row gives a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=bands.level, write_checksum=False, write_content_size=False)
        shrink = compressor.compress
        for batch, texts in text_groups(batches):
            own = [t or b"" for t in texts]
            words = Words(own)
            windows = chained(words.hashes(), 5, 61)
            inner = np.append(0, np.cumsum((words.bytes & 0xC0) != 0x80))  # code points up to each byte
            chars = np.append(0, np.cumsum(inner[words.end] - inner[words.start]))
            symbols = np.append(0, np.cumsum(SYMBOL[words.bytes]))
            rows = []
            for i, text in enumerate(own):
                a, b, begin = int(words.first[i]), int(words.first[i + 1]), int(words.text_start[i])
                n, again = b - a, repeated(windows[a : max(a, b - 4)], 5)
                failed = n < 10 or 100 * again > 20 * n
                ratio = len(shrink(text)) / len(text) if text else 1.0
                pieces = [text[k : k + bands.chunk] for k in range(0, len(text), bands.chunk)]
                found = [bands.verdict(len(p), len(shrink(p)) / len(p)) for p in pieces] if len(pieces) > 1 else [bands.verdict(len(text), ratio)]
                low, high = found.count(-1) / len(found), found.count(1) / len(found)
                bad = sum(len(p) for p, v in zip(pieces, found) if v)  # a short last chunk counts for little
                good = not failed and bands.verdict(len(text), ratio) == 0 and bad <= bands.bad_chunks * len(text)
                rows.append((n, int(chars[b] - chars[a]), int(symbols[begin + len(text)] - symbols[begin]), duplicate_lines(text), again, failed, ratio, low, high, good))
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio", "chunk_low", "chunk_high", "kept"]
            kinds = [pa.int64()] * 5 + [pa.bool_()] + [pa.float64()] * 3 + [pa.bool_()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", *names])

    schema = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, ratio double, chunk_low double, chunk_high double, kept boolean"
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)
