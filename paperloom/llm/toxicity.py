"""Toxicity: class-conditional Kneser-Ney models of bytes.

Two models, of toxic and of ordinary text, predict each byte from the four before it. Their counts of
five, four and three bytes are their own; what they back off to, continuation counts of two bytes and
one (in how many contexts a string is found, in either class), is shared, so an expression too rare
to tell the classes apart counts the same in both. Spark counts and smooths in tables that grow with
the corpus; a document's score comes from the two log-likelihoods, compared by length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.language_id import in_fold
from paperloom.llm.words import GAP, LOWER, text_groups
from paperloom.tables import stable

ORDER, SHARED = 5, 2  # bytes of the longest string; of the longest with shared counts
BITS = {5: 21, 4: 20, 3: 19}  # cells of the tables of each order are 2 ** these
SCRAMBLE = 5_318_211  # odd, and below 2 ** 23: a code of five bytes times this is below 2 ** 63


def grams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(code of the five bytes that end at each place, begin of each text). A-Z as a-z, gaps as spaces; a text begins and ends with one."""
    joined = np.frombuffer(b"".join(b" " * (ORDER - 1) + (t or b"") + b" " for t in texts), dtype=np.uint8)
    s = np.where(GAP[joined], np.uint8(0x20), LOWER[joined]).astype(np.int64)
    n = len(s) - ORDER + 1
    code = s[:n]
    for i in range(1, ORDER):
        code = (code << 8) | s[i : n + i]
    return code, np.concatenate([[0], np.cumsum([len(t or b"") + ORDER for t in texts])])


def strings(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text << 40 | code of five bytes, each once a text; how many of each text), in order.

    A string counts once a text, or a few texts that repeat themselves would outweigh all others.
    """
    code, first = grams(texts)
    of = np.repeat(np.arange(len(texts)), np.diff(first))[: len(code)]
    within = np.ones(len(code), dtype=bool)
    for back in range(1, ORDER):
        within[first[1:-1] - back] = False
    once = np.unique(((of << 40) | code)[within])
    return once, np.bincount(once >> 40, minlength=len(texts))


def cell(code: Column | np.ndarray, bits: int) -> Column | np.ndarray:
    """Place of a code in a table of 2 ** ``bits`` cells."""
    h = code * SCRAMBLE
    if isinstance(code, np.ndarray):
        return (h ^ (h >> 19)) & ((1 << bits) - 1)
    return h.bitwiseXOR(F.shiftright(h, 19)).bitwiseAND(F.lit((1 << bits) - 1))


@dataclass
class Model:
    """Log-likelihood ratios by order, and their calibration.

    ``seen[k]`` has the ratio of strings of k bytes that are not rare in a class (NaN: none); for
    others it is what ``left[k]`` has for their first k - 1 bytes plus the ratio of their last k - 1.
    Tables have 2 ** BITS[k] cells, whatever the corpus; what shares a cell counts by its mean.
    """

    seen: dict[int, np.ndarray]
    left: dict[int, np.ndarray]
    weights: np.ndarray  # bias, mean ratio, sum over root of length, and that root, which centres the sum

    def ratios(self, code: np.ndarray) -> np.ndarray:
        out = np.zeros(len(code), dtype=np.float64)
        rest = np.arange(len(code))
        for k in range(ORDER, SHARED, -1):
            code = code & ((1 << 8 * k) - 1)
            found = self.seen[k][cell(code, BITS[k])]
            known = ~np.isnan(found)
            out[rest[known]] += found[known]
            rest, code = rest[~known], code[~known]
            out[rest] += self.left[k][cell(code >> 8, BITS[k])]
        return out

    def features(self, texts: list[bytes | None]) -> np.ndarray:
        once, n = strings(texts)
        sums = np.append(0, np.cumsum(self.ratios(once & (1 << 40) - 1)))
        ends = np.cumsum(n)
        total = sums[ends] - sums[ends - n]
        return np.stack([np.ones(len(n)), 10 * total / n, total / np.sqrt(n), np.sqrt(n) / 10], axis=1)

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.features(texts) @ self.weights, -30, 30)))


def log_ratios(counts: DataFrame, discount: float = 1.0) -> tuple[dict[int, DataFrame], dict[int, DataFrame]]:
    """Kneser-Ney log P(toxic) - log P(ordinary) from (code, toxic, ordinary) counts of five bytes.

    Returns (code, ratio, n) by order: of the strings that a class has more than ``discount`` times,
    and of the contexts before others. Counts of the class with more text are scaled to the other's
    total, so what is rare is discounted alike in both. Shared levels count by predecessor: how many
    strings of k + 1 bytes end in a string of k.
    """
    sides = ("toxic", "ordinary")
    size = counts.agg(*(F.sum(c).alias(c) for c in sides)).first()
    if not size["toxic"] or not size["ordinary"]:
        nothing = counts.limit(0).select("code", F.lit(0.0).alias("ratio"), F.lit(0).alias("n"))
        return {k: nothing for k in BITS}, {k: nothing for k in BITS}
    tail = lambda k: F.col("code").bitwiseAND(F.lit((1 << 8 * k) - 1))
    context, n = F.shiftright("code", 8).alias("context"), F.col("n")
    off = lambda c: F.least(F.col(c), F.lit(discount))
    ratio = lambda a, b: F.log(a) - F.log(b)
    own = {ORDER: counts.select("code", (F.col("toxic") + F.col("ordinary")).alias("n"), *((F.col(c) * F.lit(min(size) / size[c])).alias(c) for c in sides))}
    for k in range(ORDER - 1, SHARED, -1):
        own[k] = stable(own[k + 1].groupBy(tail(k).alias("code")).agg(*(F.sum(c).alias(c) for c in ("n", *sides))))
    levels, current = {}, own[SHARED + 1]
    for k in range(SHARED, 0, -1):
        current = levels[k] = current.groupBy(tail(k).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    p = None
    for k in range(1, SHARED + 1):  # at most 256 ** SHARED rows
        sums = levels[k].groupBy(context).agg(F.sum("n").alias("s"), F.count(F.lit(1)).alias("kinds"))
        rows = levels[k].select("code", "n", context, tail(k - 1).alias("tail")).join(sums, "context")
        rows = rows.withColumn("lower", F.lit(1 / 256)) if p is None else rows.join(p.select(F.col("code").alias("tail"), F.col("p_toxic").alias("lower")), "tail")
        p = rows.select("code", ((n - 0.75 + 0.75 * F.col("kinds") * F.col("lower")) / F.col("s")).alias("p_toxic")).withColumn("p_ordinary", F.col("p_toxic"))
    seen, left = {}, {}
    for k in range(SHARED + 1, ORDER + 1):
        sums = own[k].groupBy(context).agg(F.sum("n").alias("n"), *(F.sum(c).alias(f"s_{c}") for c in sides), *(F.sum(off(c)).alias(f"off_{c}") for c in sides))
        sums = sums.select("context", "n", *(F.greatest(f"s_{c}", F.lit(1e-9)).alias(f"s_{c}") for c in sides), *(F.when(F.col(f"s_{c}") > 0, F.col(f"off_{c}") / F.col(f"s_{c}")).otherwise(1.0).alias(f"left_{c}") for c in sides))
        rows = own[k].withColumn("context", context).withColumn("tail", tail(k - 1)).join(sums.drop("n"), "context")
        rows = rows.join(p.select(F.col("code").alias("tail"), *(F.col(f"p_{c}").alias(f"lower_{c}") for c in sides)), "tail")
        full = rows.select("code", "n", *sides, *(((F.col(c) - off(c)) / F.col(f"s_{c}") + F.col(f"left_{c}") * F.col(f"lower_{c}")).alias(f"p_{c}") for c in sides))
        p = full = stable(full) if k < ORDER else full
        seen[k] = full.where((F.col("toxic") > discount) | (F.col("ordinary") > discount)).select("code", ratio(F.col("p_toxic"), F.col("p_ordinary")).alias("ratio"), "n")
        left[k] = sums.select(F.col("context").alias("code"), ratio(F.col("left_toxic"), F.col("left_ordinary")).alias("ratio"), "n")
    return seen, left


def by_cell(ratios: DataFrame, empty: float, bits: int) -> np.ndarray:
    """Mean ratio of each cell; at most 2 ** ``bits`` rows come to the driver."""
    folded = ratios.groupBy(cell(F.col("code"), bits).alias("cell")).agg((F.sum(F.col("ratio") * F.col("n")) / F.sum("n")).cast("float").alias("ratio")).toArrow()
    out = np.full(1 << bits, empty, dtype=np.float32)
    out[folded.column("cell").to_numpy()] = folded.column("ratio").to_numpy()
    return out


def count_grams(rows: DataFrame, held: int = 1_000_000) -> DataFrame:
    """(code, toxic, ordinary) of (text, _y) rows; a task adds up before anything is shuffled."""

    def add(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        code, where = np.unique(np.concatenate(codes), return_inverse=True)
        return code, np.bincount(where, weights=np.concatenate(counts)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, size = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], 0
        for batch, texts in text_groups(batches):
            once, _ = strings(texts)
            toxic = batch.column("_y").to_numpy().astype(np.int64)
            own, n = np.unique((toxic[once >> 40] << 40) | (once & (1 << 40) - 1), return_counts=True)
            codes.append(own), counts.append(n)
            size += len(own)
            if size > held:  # add up; what is still much goes on as it is
                own, n = add(codes, counts)
                if len(own) * 2 > held:
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n)], names=["code", "n"])
                    own, n = own[:0], n[:0]
                codes, counts, size = [own], [n], len(own)
        own, n = add(codes, counts)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n)], names=["code", "n"])

    toxic = F.col("code") >= 1 << 40
    found = rows.mapInArrow(count, "code bigint, n bigint")
    return found.groupBy(F.col("code").bitwiseAND(F.lit((1 << 40) - 1)).alias("code")).agg(F.coalesce(F.sum(F.when(toxic, F.col("n"))), F.lit(0)).alias("toxic"), F.coalesce(F.sum(F.when(~toxic, F.col("n"))), F.lit(0)).alias("ordinary"))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Newton's method on the ridge-penalised likelihood."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


def train(docs: DataFrame, labels: DataFrame, calibration_rows: int = 20_000) -> Model:
    """Counts over all training rows but those of the calibration: a fifth of them, and about ``calibration_rows`` at most.

    Training rows have a label of 0 or 1 and crc32(doc_id as text) mod 5 other than 0. Labels grow
    with the documents, so they are joined by a shuffle at every size, never broadcast.
    """
    known = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_y")).where(~in_fold(F.col("doc_id"), 5, 0))
    share = min(0.2, calibration_rows / max(1, known.count()))
    fit = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) < int(share * (1 << 20))
    texts = docs.where(F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"), 5, 0)).select("doc_id", F.col("text").cast("binary").alias("text"))
    joined = lambda rows: rows.join(known.hint("merge"), "doc_id").select("text", "_y")
    seen, left = log_ratios(stable(count_grams(joined(texts.where(~fit)))))
    model = Model({k: by_cell(seen[k], np.nan, BITS[k]) for k in BITS}, {k: by_cell(left[k], 0.0, BITS[k]) for k in BITS}, np.zeros(4))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 28 MB

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in text_groups(batches):
            x = shared.value.features(raw)
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, i]) for i in (1, 2, 3)), batch.column("_y").cast(pa.int32())], names=["mean", "root", "size", "y"])

    sample = joined(texts.where(fit)).mapInArrow(features, "mean double, root double, size double, y int").toArrow()
    x = np.stack([np.ones(sample.num_rows), *(sample.column(c).to_numpy() for c in ("mean", "root", "size"))], axis=1)
    y = sample.column("y").to_numpy().astype(np.float64)
    order = np.lexsort((y, x[:, 3], x[:, 2], x[:, 1]))  # the same sums on every run
    model.weights = logistic(x[order], y[order]) if len(y) else np.zeros(4)
    return model


def toxicity(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: toxic likelier) and predicted for every row.

    A null or empty text scores as a text of one gap. Without training rows every score is 0.5.
    Repeated rows each give a row; several labels of a doc_id count as their largest.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_groups(batches):
            score = shared.value.score(texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    plain = docs.select("doc_id", in_fold(F.col("doc_id"), 5, 0).alias("held_out"), F.col("text").cast("binary").alias("text"))
    return plain.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")
