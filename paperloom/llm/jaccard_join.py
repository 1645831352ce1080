"""N-gram Jaccard join by T-occurrence search.

Blocks. In one order of all shingles, two similar sets agree on several of the first few of each: two
that overlap in t shingles share at least l among their first n - t + l. Spark finds which of these
no other set has; they come first in a second order, in which one of the first n - t + 1 is still
shared. So a set that has enough shingles of its own there is linked with nothing, whatever phrases it
has in common with others. Sets that share such a shingle and whose sizes allow it are chained, and
the chains' components are the blocks: families of copies.

Crowds. A family of more sets than a block holds (one common phrase can chain thousands that are not
similar) is not searched as it is. Its sets are laid side by side as sketches of some bytes each: bits by
the parity of how many shingles fall on them, of which no more differ between two sets than shingles
do. Only sets that the bits and the sizes allow to be similar stay together, as families of their own.

Search. Within a block, each set asks the others' inverted lists which documents reach the overlap
that the threshold needs: short lists are merged through a heap, the long ones are only probed by
binary search for the candidates that the merge leaves (DivideSkip).
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.components import component_members
from paperloom.llm.repeats import keyed
from paperloom.llm.words import in_groups, mix, shingle_sets, text_groups
from paperloom.tables import landed, settings, stable


def needed(a: int, b: int, percent: int) -> int:
    """Least overlap of sets of sizes a and b with 100 x overlap >= percent x union."""
    return -(-percent * (a + b) // (100 + percent))


def least_overlap(n: int, percent: int) -> int:
    """Least overlap of a set of ``n`` shingles with any similar one."""
    return -(-percent * n // 100)


def shared_lead(least: int) -> int:
    """Shingles that similar sets share among their first ones; it grows no faster than ``least``."""
    return max(1, least // 8)


def leading(shingles: np.ndarray, percent: int, common: np.ndarray) -> np.ndarray:
    """Names of the first n - t + l shingles of a set (by hash), those of ``common`` (sorted) with bit 62 set."""
    n = len(shingles)
    if not n:
        return np.zeros(0, dtype=np.int64)
    least = least_overlap(n, percent)
    take = n - least + shared_lead(least)
    order = mix(shingles, 3) >> np.uint64(2)
    if take < n:
        at = np.argpartition(order, take - 1)[:take]
        shingles, order = shingles[at], order[at]
    if len(common):
        often = common[np.minimum(np.searchsorted(common, shingles), len(common) - 1)] == shingles
        order |= often.astype(np.uint64) << np.uint64(62)
    return order.view(np.int64)


def emitted(n: int, percent: int, shared: list[int]) -> list[int]:
    """Of the shared ones among the leading shingles, those within the first n - t + 1 once all others come before them."""
    least = least_overlap(n, percent)
    own = n - least + shared_lead(least) - len(shared)
    return sorted(shared)[: max(0, n - least + 1 - own)]


def common_shingles(texts: DataFrame, k: int, rows: int = 3000, least: int = 4, most: int = 20_000) -> np.ndarray:
    """Shingles of several different sets among about ``rows`` documents drawn by hash, ``most`` of the commonest.

    They are known to be shared and are dealt to many tasks; which ones they are doesn't change what is found.
    """
    part = min(1.0, rows / max(1, texts.count()))
    drawn = texts.where(F.pmod(F.col("key"), F.lit(1 << 30)) < int(part * (1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, raw in text_groups(batches):
            sets = [s for s in shingle_sets(raw, k) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([set_keys(s)[0] for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["k1", "shingles"])

    sets = drawn.select("text").mapInArrow(run, "k1 bigint, shingles array<bigint>").dropDuplicates(["k1"])
    counts = sets.select(F.explode("shingles").alias("s")).groupBy("s").count().where(F.col("count") >= least)
    found = counts.orderBy(F.desc("count"), "s").limit(most).select("s").toArrow()
    return np.sort(found.column("s").to_numpy().view(np.uint64))


def set_keys(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit numbers; equal sets have equal ones."""
    a, b = np.sum(mix(shingles, 1), dtype=np.uint64), np.sum(mix(shingles, 2), dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def shingle_table(texts: DataFrame, k: int) -> DataFrame:
    """doc_id, key (hash of doc_id and text), n_shingles, k1 and k2 (keys of the set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw in text_groups(batches):
            sets = shingle_sets(raw, k)
            keys = [set_keys(s) for s in sets]
            numbers = [[len(s) for s in sets], [a for a, _ in keys], [b for _, b in keys]]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("key"), *(pa.array(x, pa.int64()) for x in numbers)], names=["doc_id", "key", "n_shingles", "k1", "k2"])

    return texts.select("doc_id", "key", "text").mapInArrow(run, "doc_id bigint, key bigint, n_shingles bigint, k1 bigint, k2 bigint")


def first_shingles(texts: DataFrame, classes: DataFrame, total: int, k: int, percent: int, salts: int = 64) -> DataFrame:
    """(key, size, node) for the shingles by which sets can meet; node is the set's k1.

    Copies give the same rows and count once; of a class with more than a thousandth of all rows
    (there are under a thousand) only the document that stands for it is read.
    """
    crowd = classes.where(F.col("members") * 1000 > total).select("k1", "rep_key").collect()
    known = texts.sparkSession.sparkContext.broadcast((common_shingles(texts, k), {r["k1"]: r["rep_key"] for r in crowd}))  # 20,000 numbers, a thousand pairs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, stands = known.value
        for rows, raw in text_groups(batches):
            tokens, nodes = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            for shingles, key in zip(shingle_sets(raw, k), rows.column("key").to_pylist()):
                if len(shingles) and stands.get(node := set_keys(shingles)[0], key) == key:
                    tokens.append(leading(shingles, percent, common))
                    nodes.append(np.full(len(tokens[-1]), node))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, nodes)], names=["token", "node"])

    found = texts.select("key", "text").mapInArrow(run, "token bigint, node bigint")
    common = F.col("token") >= 1 << 62
    one = Window.partitionBy("token", "_salt")
    found = found.withColumn("_salt", F.when(common, F.pmod(F.xxhash64("node"), F.lit(salts))).otherwise(0))
    shared = found.withColumn("_least", F.min("node").over(one)).withColumn("_most", F.max("node").over(one)).where(common | (F.col("_least") != F.col("_most")))
    lists = shared.groupBy("node").agg(F.collect_set("token").alias("shared"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("n_shingles", "node", "shared"))))
            chosen = [(token, n, node) for n, node, tokens in rows for token in emitted(n, percent, tokens)]
            columns = list(zip(*chosen)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["key", "size", "node"])

    sized = lists.join(classes.select("k1", "n_shingles"), lists["node"] == classes["k1"]).select("n_shingles", "node", "shared")
    return sized.mapInArrow(choose, "key bigint, size bigint, node bigint")


def chains(rows: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that join the nodes of each key into chains, from rows (key, size, node), in one shuffle.

    Rows are ordered by (key, size, node) over all partitions, so a key that holds a third of the
    rows is spread over many tasks. Neighbours are linked where the sizes can be those of similar
    sets: what lies between two similar ones in this order is linked to both. The last row of a
    partition and the first of the next are compared on the driver (two rows a partition).
    """
    order = ["key", "size", "node"]
    ordered = rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for batch in batches:
            keys, sizes, nodes = (batch.column(i).to_numpy() for i in range(3))
            if not len(keys):
                continue
            if last is None:
                first = (int(keys[0]), int(sizes[0]), int(nodes[0]))
            else:
                keys, sizes, nodes = (np.append(x, y) for x, y in zip(last, (keys, sizes, nodes)))
            last = (int(keys[-1]), int(sizes[-1]), int(nodes[-1]))
            link = (keys[1:] == keys[:-1]) & (nodes[1:] != nodes[:-1]) & (100 * sizes[:-1] >= percent * sizes[1:])
            pairs = np.unique(np.stack([nodes[:-1][link], nodes[1:][link]], axis=1), axis=0)
            yield _edges(pairs[:, 0], pairs[:, 1], None, None)
        if last is not None:
            yield _edges(np.array([first[2], last[2]]), np.array([0, 1]), np.array([first[0], last[0]]), np.array([first[1], last[1]]))

    found = stable(ordered.mapInArrow(run, "a bigint, b bigint, edge_key bigint, edge_size bigint").select("*", F.spark_partition_id().alias("part")))
    ends = sorted((r["part"], r["b"], r["edge_key"], r["edge_size"], r["a"]) for r in found.where("edge_key IS NOT NULL").collect())
    across = [(x[4], y[4]) for x, y in zip(ends[1::2], ends[2::2]) if x[2] == y[2] and x[4] != y[4] and 100 * x[3] >= percent * y[3]]
    edges = found.where("edge_key IS NULL").select("a", "b").distinct()
    return edges.union(edges.sparkSession.createDataFrame(across, "a bigint, b bigint")) if across else edges


def _edges(a: np.ndarray, b: np.ndarray, key: np.ndarray | None, size: np.ndarray | None) -> pa.RecordBatch:
    ends = [pa.nulls(len(a), pa.int64()) if x is None else pa.array(x, pa.int64()) for x in (key, size)]
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), *ends], names=["a", "b", "edge_key", "edge_size"])


def size_classes(percent: int, most: int = 1 << 31) -> np.ndarray:
    """Least sizes of classes such that two similar sets are of one class or of two that follow each other."""
    least = [1]
    while least[-1] < most:
        least.append(max(least[-1] + 1, -(-100 * least[-1] // percent)))
    return np.array(least)


def sketch(shingles: np.ndarray, most: int = 1 << 16) -> np.ndarray:
    """A bit for each of at least twice as many places as there are shingles: whether an odd number of them falls there."""
    bits = min(most, max(64, 1 << (2 * len(shingles) - 1).bit_length()))
    at = (mix(shingles, 4) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, n: int) -> np.ndarray:
    """The sketch of ``n`` words that the same shingles have."""
    while len(bits) > n:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def reach_sketches(sizes: np.ndarray, sketches: list[np.ndarray], percent: int) -> list[int]:
    """For each set, the first set that links of possibly similar sets lead to: no more of their bits differ than shingles may."""
    n = min(map(len, sketches), default=1)
    order = np.argsort(sizes, kind="stable")
    sizes, bits = sizes[order], np.array([folded(sketches[i], n) for i in order]).reshape(-1, n).T.copy()
    root, open_ = np.full(len(order), -1), np.ones(len(order), dtype=bool)
    low, high = np.searchsorted(sizes, -(-percent * sizes // 100)), np.searchsorted(sizes, 100 * sizes // percent, "right")
    for seed in range(len(order)):
        if root[seed] >= 0:
            continue
        root[seed], open_[seed], waiting = seed, False, [seed]
        while waiting:
            x = waiting.pop()
            at = slice(low[x], high[x])
            if not open_[at].any():
                continue
            apart = np.bitwise_count(bits[:, at] ^ bits[:, x : x + 1]).sum(axis=0, dtype=np.int64)
            both = sizes[at] + sizes[x]
            found = low[x] + np.flatnonzero(open_[at] & (apart <= both + 2 * (-percent * both // (100 + percent))))
            root[found], open_[found] = seed, False
            waiting.extend(found.tolist())
    out = np.empty(len(order), dtype=np.int64)
    out[order] = order[root]
    return out.tolist()


def parted_crowds(texts: DataFrame, crowds: DataFrame, k: int, percent: int, piece: int) -> DataFrame:
    """(node, root) of the sets of ``crowds`` (node, rep_key, k1, k2, root) that may be similar to another, by families that are still linked.

    What is exchanged are sketches. Sets of one family and size class are cut by hash into pieces of about ``piece``, and
    every two pieces of one class or of two that follow each other are laid side by side.
    """
    bounds = size_classes(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw in text_groups(batches):
            keys = zip(rows.column("k1").to_pylist(), rows.column("k2").to_pylist())
            made = [(i, s) for i, (s, key) in enumerate(zip(shingle_sets(raw, k), keys)) if set_keys(s) == key]
            at, sizes = pa.array([i for i, _ in made], pa.int64()), np.array([len(s) for _, s in made], dtype=np.int64)
            columns = [rows.column("node").take(at), rows.column("root").take(at), pa.array(sizes), pa.array(np.searchsorted(bounds, sizes, "right")), pa.array([sketch(s).tobytes() for _, s in made], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "root", "size", "class", "bits"])

    found = texts.join(crowds, texts["key"] == crowds["rep_key"]).select("node", "root", "k1", "k2", "text")
    found = landed(found.mapInArrow(run, "node bigint, root bigint, size bigint, class bigint, bits binary").dropDuplicates(["node"]))
    cuts = found.groupBy("root", "class").agg(F.ceil(F.count(F.lit(1)) / piece).cast("int").alias("_cuts"))
    near = lambda step, name: cuts.select("root", (F.col("class") - step).alias("class"), F.col("_cuts").alias(name))
    cuts = cuts.join(near(1, "_above"), ["root", "class"], "left").join(near(-1, "_below"), ["root", "class"], "left")
    cut = F.pmod(F.xxhash64("node"), F.col("_cuts")).cast("int")
    with_ = lambda many, low, high, of: F.when(F.col(many).isNotNull(), F.transform(F.sequence(F.lit(0), F.col(many) - 1), lambda j: F.struct(low.alias("low"), high.alias("high"), *of(j)))).otherwise(F.array())
    own, pair = F.col("class"), lambda i, j: (i.alias("i"), j.alias("j"))
    sides = F.concat(
        with_("_cuts", own, own, lambda j: pair(F.least(F.col("_cut"), j), F.greatest(F.col("_cut"), j))),
        with_("_above", own, own + 1, lambda j: pair(F.col("_cut"), j)),
        with_("_below", own - 1, own, lambda j: pair(j, F.col("_cut"))),
    )
    laid = found.join(cuts, ["root", "class"]).withColumn("_cut", cut).select("node", "root", "size", "bits", F.explode(sides).alias("_side"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        nodes = group["node"].to_numpy()
        root = reach_sketches(group["size"].to_numpy(), [np.frombuffer(b, dtype=np.uint64) for b in group["bits"]], percent)
        links = [(nodes[i], nodes[r]) for i, r in enumerate(root) if i != r]
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # heavy for its bytes, by which tasks would be merged
    laid = laid.select("node", "size", "bits", "root", "_side.*").repartition(tasks, "root", "low", "high", "i", "j")
    return stable(component_members(laid.groupBy("root", "low", "high", "i", "j").applyInPandas(compare, "a bigint, b bigint")))


class InvertedLists:
    """Inverted lists over some sets, from which documents that were reached drop out."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        shingles, number = np.unique(np.concatenate(sets), return_inverse=True)
        number = number.astype(np.int32)
        self.owner = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)[np.argsort(number, kind="stable")]
        self.bounds = np.concatenate([[0], np.cumsum(np.bincount(number, minlength=len(shingles)))])
        self.cut = np.concatenate([[0], np.cumsum(self.sizes)])
        self.number = number
        self.with_others = np.diff(self.bounds)[number] > 1  # a list of the set alone finds nothing
        self.lists_with_others = np.diff(np.concatenate([[0], np.cumsum(self.with_others)])[self.cut])
        self.shrunk: dict[int, np.ndarray] = {}
        self.open = np.ones(len(sets), dtype=bool)

    def live(self, token: int) -> np.ndarray:
        """The list of a shingle without what was reached; it is kept that way."""
        got = self.shrunk.get(token)
        if got is None:
            got = self.owner[self.bounds[token] : self.bounds[token + 1]]
        if len(got) and not (still := self.open[got]).all():
            got = self.shrunk[token] = got[still]
        return got

    def search(self, query: int, percent: int, mu: float = 0.002) -> list[int]:
        """Open documents that are similar to ``query``.

        ``mu`` weighs an entry merged against a probe: the smaller, the more lists count as long.
        """
        n = int(self.sizes[query])
        least = max(1, -(-percent * n // 100))  # the overlap with the smallest set that can be similar
        if self.lists_with_others[query] < least:
            return []
        at = slice(self.cut[query], self.cut[query + 1])
        own = self.number[at][self.with_others[at]].tolist()
        lists = sorted((got for t in own if len(got := self.live(t))), key=len)
        if len(lists) < least:
            return []
        n_long = min(least - 1, int(least / (mu * math.log2(len(lists[-1]) + 1) + 1)))
        short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
        merged = ((d, sum(1 for _ in run)) for d, run in groupby(heapq.merge(*(s.tolist() for s in short))))
        docs, counts = (np.array(x, dtype=np.int64) for x in (list(zip(*merged)) or ((), ())))
        need = -(-percent * (n + self.sizes[docs]) // (100 + percent))
        for k in range(0, n_long + 1, 16):  # whoever can't reach the overlap any more drops out
            able = (counts + (n_long - k) >= need) & (need <= np.minimum(n, self.sizes[docs]))
            docs, counts, need = docs[able], counts[able], need[able]
            if not len(docs):
                return []
            for probe in long[k : k + 16]:
                counts += probe[np.minimum(np.searchsorted(probe, docs), len(probe) - 1)] == docs
        return docs[counts >= need].tolist()


def reach(sets: list[np.ndarray], percent: int) -> list[int]:
    """For each set, the first set of its component of similar sets.

    A set is searched for once it is reached, among those not reached yet; links inside what is
    already one component are not asked for again, and none between two components is missed.
    """
    index, root = InvertedLists(sets), [-1] * len(sets)
    for seed in range(len(sets)):
        if root[seed] >= 0:
            continue
        root[seed], index.open[seed], waiting = seed, False, [seed]
        while waiting:
            for other in index.search(waiting.pop(), percent):
                root[other], index.open[other] = seed, False
                waiting.append(other)
    return root


def jaccard_components(docs: DataFrame, k: int = 3, percent: int = 90, block: int = 600, piece: int = 4000) -> DataFrame:
    """doc_id, n_shingles, component_id, key and kept for every row.

    Words are lower-cased (A-Z) runs of bytes other than 0x20 and 0x09 to 0x0D; a set is the
    distinct k-word shingles, or the whole sequence if it is shorter. Two documents link when
    100 x overlap >= percent x union. component_id is the smallest doc_id that links reach. key is a
    hash of doc_id and text; kept marks one document of each component (equal rows are marked alike).

    Null or empty texts, or texts without a word: n_shingles 0, linked with nothing, kept. Equal sets
    are one node from the start. Families above ``block`` sets are parted by sketches (``parted_crowds``); blocks that
    are still larger are cut by hash and every two pieces searched together, so a task holds 2 x ``block`` sets
    at most, or 2 x ``piece`` sketches. A null doc_id takes part like any
    other, but names no component: one of null doc_ids only has a null component_id. Of texts under
    one doc_id each has its own set and its own links. Repeated rows each give a row; an empty table gives
    none. Other columns are not read.

    Texts go to Python a thousand at a time, as ten thousand long ones (Spark's measure) are held whole by the
    executor and by the worker. All Python runs within the call; the session keeps its own setting.
    """
    with settings(docs.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}):
        return _components(docs, k, percent, block, piece)


def _components(docs: DataFrame, k: int, percent: int, block: int, piece: int) -> DataFrame:
    spark = docs.sparkSession
    texts = keyed(docs)
    narrow = stable(shingle_table(texts, k))
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    classes = narrow.where("n_shingles > 0").groupBy("k1", "k2").agg(
        F.min("doc_id").alias("rep"), F.min_by("key", first).alias("rep_key"), F.first("n_shingles").alias("n_shingles"), F.count(F.lit(1)).alias("members")
    )
    classes = landed(classes.withColumn("node", F.monotonically_increasing_id()))
    meeting = stable(first_shingles(texts, classes, narrow.count(), k, percent))
    family = component_members(chains(meeting, percent)).withColumnRenamed("node", "_k1")
    members = stable(classes.join(family, F.col("k1") == F.col("_k1")).select("node", "rep_key", "k1", "k2", "root"))
    many_of = lambda rows: rows.groupBy("root").agg(F.count(F.lit(1)).alias("_n"))
    sizes = stable(many_of(members))
    if not sizes.where(F.col("_n") > block).isEmpty():
        # read once more from here on: the texts that stand for a set of a family
        texts = landed(texts.select("key", "text").join(members.select("rep_key").distinct(), F.col("key") == F.col("rep_key"), "left_semi"))
        crowds = members.join(sizes.where(F.col("_n") > block).select("root"), "root", "left_semi")
        parts = parted_crowds(texts, crowds, k, percent, piece)
        others = members.join(sizes.where(F.col("_n") > block).select("root"), "root", "left_anti")
        members = stable(others.unionByName(crowds.drop("root").join(parts, "node")))
        sizes = many_of(members)
    total = members.count()
    many = max(1, total // (block // 2))
    cuts = F.ceil(F.col("_n") / block).cast("int")
    placed = members.join(sizes, "root").withColumn("_cuts", cuts).withColumn("_cut", F.pmod(F.xxhash64("node"), F.col("_cuts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_cuts") - 1))
    placed = placed.select("node", "rep_key", "k1", "k2", "root", "_cuts", "_cut", other.alias("_other")).select(
        "node",
        "rep_key",
        "k1",
        "k2",
        F.when(F.col("_cuts") == 1, F.pmod(F.xxhash64("root"), F.lit(many))).otherwise(F.col("root")).alias("bucket"),
        F.when(F.col("_cuts") == 1, -1).otherwise(F.least("_cut", "_other")).alias("i"),
        F.when(F.col("_cuts") == 1, -1).otherwise(F.greatest("_cut", "_other")).alias("j"),
    )
    texts = texts.select("key", "text")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # the search is heavy for its bytes, by which tasks would be merged
    candidates = texts.join(placed, texts["key"] == placed["rep_key"]).select("node", "k1", "k2", "bucket", "i", "j", "text").repartition(tasks, "bucket", "i", "j")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        found, nodes, seen = [], [], set()
        texts = group["text"].tolist()
        made = (s for at in in_groups(texts) for s in shingle_sets(texts[at], k))
        for node, k1, k2, shingles in zip(group["node"].tolist(), group["k1"].tolist(), group["k2"].tolist(), made):
            if node not in seen and set_keys(shingles) == (k1, k2):
                seen.add(node)
                found.append(shingles)
                nodes.append(node)
        if not found:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        root = reach(found, percent)
        links = [(nodes[i], nodes[r]) for i, r in enumerate(root) if i != r]
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    links = candidates.groupBy("bucket", "i", "j").applyInPandas(run, "a bigint, b bigint")
    roots = stable(component_members(links))
    names = classes.join(roots, "node").groupBy("root").agg(F.min("rep").alias("_name"), F.min_by("rep_key", F.struct(F.col("rep").isNull(), "rep", "rep_key")).alias("_name_key"))
    named = classes.join(roots, "node", "left").join(names, "root", "left")
    alone = F.col("root").isNull()
    named = named.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.when(alone, F.col("rep")).otherwise(F.col("_name")).alias("_root"), F.when(alone, F.col("rep_key")).otherwise(F.col("_name_key")).alias("_first_key"))
    linked = (F.col("n_shingles") > 0) & (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2"))
    component = F.coalesce("_root", "doc_id")
    return narrow.join(named, linked, "left").select("doc_id", "n_shingles", component.alias("component_id"), "key", F.coalesce(F.col("key") == F.col("_first_key"), F.lit(True)).alias("kept"))
