"""Language identification: a bidirectional gated recurrent network over bytes.

Two gated recurrent layers read a stretch of bytes, one from each end; every position gets a
probability for each language from both states, and a document's probability is the mean over its
positions. Whole texts are read, in stretches of ``STEPS`` bytes laid side by side. The network is
trained in numpy by backpropagation through time on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.words import text_groups

STEPS = 96
PAD = 256  # the symbol after a text's end


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)


class Layer:
    """A gated recurrent layer in one direction; its input weights are a row for each byte."""

    def __init__(self, hidden: int, rng: np.random.Generator):
        self.h = hidden
        self.weights = {
            "x": (rng.standard_normal((257, 3 * hidden)) * 0.3).astype(np.float32),
            "u": (rng.standard_normal((hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32),
        }

    def run(self, steps: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States after each row of ``steps`` (time x sequences), and what backpropagation needs."""
        h, w, u = self.h, self.weights["x"], self.weights["u"]
        state = np.zeros((steps.shape[1], h), dtype=np.float32)
        out, tape = np.empty((*steps.shape, h), dtype=np.float32), []
        for t, symbols in enumerate(steps):
            drive, back = w[symbols], state @ u
            gates = sigmoid(drive[:, : 2 * h] + back[:, : 2 * h])
            update, reset = gates[:, :h], gates[:, h:]
            fresh = np.tanh(drive[:, 2 * h :] + reset * back[:, 2 * h :])
            if keep:
                tape.append((state, update, reset, fresh, back[:, 2 * h :]))
            state = fresh + update * (state - fresh)
            out[t] = state
        return out, tape

    def grad(self, steps: np.ndarray, tape: list, d_out: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients by backpropagation through time."""
        h, u = self.h, self.weights["u"]
        dx, du = np.zeros_like(self.weights["x"]), np.zeros_like(u)
        d_state = np.zeros_like(d_out[0])
        for t in range(len(steps) - 1, -1, -1):
            before, update, reset, fresh, back = tape[t]
            d = d_state + d_out[t]
            d_fresh = d * (1 - update) * (1 - fresh * fresh)
            d_gates = np.concatenate([d * (before - fresh) * update * (1 - update), d_fresh * back * reset * (1 - reset)], axis=1)
            d_back = np.concatenate([d_gates, d_fresh * reset], axis=1)
            np.add.at(dx, steps[t], np.concatenate([d_gates, d_fresh], axis=1))
            du += before.T @ d_back
            d_state = d * update + d_back @ u.T
        return {"x": dx, "u": du}


class Network:
    def __init__(self, languages: list[str], hidden: int = 8, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.languages, self.ahead, self.behind = languages, Layer(hidden, rng), Layer(hidden, rng)
        self.out = {"w": (rng.standard_normal((2 * hidden, len(languages))) * 0.3).astype(np.float32), "b": np.zeros(len(languages), dtype=np.float32)}

    def label(self, steps: np.ndarray) -> np.ndarray:
        """Probabilities at every position: time x sequences x languages."""
        forward, _ = self.ahead.run(steps)
        backward, _ = self.behind.run(steps[::-1])
        return self._soft(forward, backward[::-1])

    def _soft(self, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
        h = self.ahead.h
        scores = forward @ self.out["w"][:h]
        scores += backward @ self.out["w"][h:]
        scores += self.out["b"]
        scores -= scores.max(axis=-1, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(axis=-1, keepdims=True)
        return scores

    def train(self, sequences: np.ndarray, target: np.ndarray, passes: int = 400, batch: int = 192, rate: float = 0.03, seed: int = 2) -> None:
        """Adam on the cross entropy of every position that holds a byte. ``sequences``: rows of STEPS symbols."""
        rng, h = np.random.default_rng(seed), self.ahead.h
        groups = [self.ahead.weights, self.behind.weights, self.out]
        first = [{k: np.zeros_like(v) for k, v in g.items()} for g in groups]
        second = [{k: np.zeros_like(v) for k, v in g.items()} for g in groups]
        weight = 1.0 / np.maximum(1, np.bincount(target, minlength=len(self.languages)))
        chance = weight[target] / weight[target].sum()
        for step in range(1, passes + 1):
            rows = rng.choice(len(sequences), batch, p=chance)
            steps, goal = sequences[rows].T, target[rows]
            forward, tape_f = self.ahead.run(steps, keep=True)
            backward, tape_b = self.behind.run(steps[::-1], keep=True)
            delta = self._soft(forward, backward[::-1])
            delta[:, np.arange(batch), goal] -= 1
            held = (steps != PAD)[:, :, None]
            delta *= held / np.float32(max(1, held.sum()))
            flat, both = delta.reshape(-1, len(self.languages)), np.concatenate([forward, backward[::-1]], axis=2).reshape(-1, 2 * h)
            d_states = delta @ self.out["w"].T
            grads = [self.ahead.grad(steps, tape_f, d_states[:, :, :h]), self.behind.grad(steps[::-1], tape_b, d_states[::-1, :, h:]), {"w": both.T @ flat, "b": flat.sum(axis=0)}]
            pace = rate * (1 - step / (passes + 1))
            for g, m, v, d in zip(groups, first, second, grads):
                for k in g:
                    np.clip(d[k], -1, 1, out=d[k])
                    m[k] += 0.1 * (d[k] - m[k])
                    v[k] += 0.01 * (d[k] * d[k] - v[k])
                    g[k] -= (pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities over all positions of each text (at least one byte each)."""
        rows, owner = sequences_of(texts)
        total = np.zeros((len(texts), len(self.languages)))
        for begin in range(0, len(rows), 4096):
            part = rows[begin : begin + 4096]
            held = (part != PAD).T
            sums = np.einsum("tsl,ts->sl", self.label(part.T), held.astype(np.float32))
            np.add.at(total, owner[begin : begin + 4096], sums)
        return total / np.array([[len(t)] for t in texts])


def sequences_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(rows of STEPS symbols, the text of each row)."""
    sizes = np.array([len(t) for t in texts])
    count = -(-sizes // STEPS)
    rows = np.full((int(count.sum()), STEPS), PAD, dtype=np.int16)
    owner = np.repeat(np.arange(len(texts)), count)
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat((np.cumsum(count) - count) * STEPS, sizes)
    rows.reshape(-1)[at] = np.frombuffer(b"".join(texts), dtype=np.uint8)
    return rows, owner


def in_fold(doc_id: Column, folds: int, held: int) -> Column:
    """crc32(doc_id as text) mod ``folds`` is ``held``; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == held, F.lit(False))


def train_network(docs: DataFrame, per_language: int = 700, span: int = 2 * STEPS, passes: int = 400) -> Network | None:
    """Fit on at most about ``per_language`` rows of each language outside the held-out fold.

    Of each sampled row, a stretch of ``span`` characters at a place drawn by hash; rows are drawn by
    hash with a share set by the language's count, so the sample is bounded at any input size.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") > 0) & ~in_fold(F.col("doc_id"), 4, 2))
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        return None
    languages = sorted(counts)
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_language / n))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    place = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.greatest(F.length("text") - span + 1, F.lit(1))) + 1
    sample = usable.where(draw < share[F.col("lang")]).withColumn("_p", place.cast("int")).select("doc_id", "lang", F.substring("text", F.col("_p"), F.lit(span)).alias("part"))
    rows = sorted((r["doc_id"], r["lang"], r["part"]) for r in sample.collect())
    sequences, owner = sequences_of([r[2].encode() for r in rows])
    network = Network(languages)
    network.train(sequences, np.array([languages.index(rows[i][1]) for i in owner.tolist()]), passes=passes)
    return network


def identify(docs: DataFrame, network: Network | None = None) -> DataFrame:
    """All columns of ``docs`` with held_out, lang_pred and score.

    lang_pred is a language of the training rows, score its mean probability over all positions.
    A null text, or one without a letter, is 'und' with score 0, as is every text where there was
    nothing to learn from. Repeated rows each give a row; columns of the added names are replaced.
    """
    network = network or train_network(docs)
    added = ["held_out", "lang_pred", "score"]
    rest = [f for f in docs.schema if f.name not in added]
    letter = "_" * (1 + max(map(len, docs.columns))) + "letter"  # no column of the input has this name
    plain = docs.select(*[f.name for f in rest], F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias(letter), in_fold(F.col("doc_id"), 4, 2).alias("held_out"))
    if network is None:
        return plain.drop(letter).withColumn("lang_pred", F.lit("und")).withColumn("score", F.lit(0.0))
    model = docs.sparkSession.sparkContext.broadcast(network)  # a few thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        names = np.array([*net.languages, "und"], dtype=object)
        for batch, texts in text_groups(batches):
            some = np.flatnonzero(batch.column(letter).to_numpy(zero_copy_only=False))
            best, score = np.full(len(texts), len(net.languages)), np.zeros(len(texts))
            if len(some):
                mean = net.documents([texts[i].encode() for i in some.tolist()])
                best[some], score[some] = mean.argmax(axis=1), np.minimum(1.0, mean.max(axis=1))
            kept = [batch.column(f.name) for f in rest] + [batch.column("held_out")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(names[best], pa.string()), pa.array(score)], names=[*(f.name for f in rest), *added])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "held_out boolean, lang_pred string, score double"])
    return plain.mapInArrow(run, schema)
