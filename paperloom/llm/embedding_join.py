"""Embedding near-dedup: an exact metric range join over pivot cells.

On unit vectors, cosine >= c is a distance of at most r = sqrt(2 - 2c). Every vector lives in the
cell of its nearest pivot p. If x in cell q lies within r of v, the triangle inequality gives
d(v,q) <= d(v,p) + 2r, and since d(v,.) and d(x,.) order p and q on both sides of the hyperplane
between them, v lies within r of that hyperplane; v is copied to just those cells. Each link is
then found in the cell where its other end lives, and cells are joined independently.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.components import component_members
from paperloom.tables import stable


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def choose_pivots(vectors: DataFrame, cell: int, most: int) -> dict[int, np.ndarray]:
    """Pivots by length of vector, one for ``cell`` vectors of the label that has most of them, ``most`` at most.

    They are the unit vectors whose keys hash lowest: the same ones on every run.
    """
    sized = vectors.select("label", "k1", "k2", "_v", F.size("_v").alias("width"))
    counts = sized.groupBy("label", "width").count().groupBy("width").agg(F.max("count").alias("n"))
    wanted = counts.select("width", F.least(F.lit(most), F.ceil(F.col("n") / cell)).alias("wanted"))
    order = Window.partitionBy("width", "_part").orderBy("_hash", "k1", "k2")
    drawn = sized.withColumn("_hash", F.xxhash64("k1", "k2")).withColumn("_part", F.pmod("_hash", F.lit(64))).withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= most)
    rows = drawn.withColumn("_at", F.row_number().over(Window.partitionBy("width").orderBy("_hash", "k1", "k2"))).join(wanted, "width").where(F.col("_at") <= F.col("wanted"))
    found: dict[int, list] = {}
    for r in rows.select("width", "_at", "_v").orderBy("width", "_at").collect():  # ``most`` vectors a length
        found.setdefault(r["width"], []).append(r["_v"])
    return {width: unit(np.array(v, dtype=np.float64)) for width, v in found.items()}


def cells_of(points: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(home cell of each point, whether each point may have a neighbour in each cell)."""
    cosine = points @ pivots.T
    home = np.argmax(cosine, axis=1)
    nearest = cosine[np.arange(len(points)), home]
    apart = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (pivots @ pivots.T)))[home]  # from the home pivot to each
    plane = (nearest[:, None] - cosine) / np.maximum(apart, 1e-12)  # distance to the hyperplane between the two
    ball = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine)) - np.sqrt(np.maximum(0.0, 2.0 - 2.0 * nearest))[:, None]
    near = (plane <= radius + 1e-9) & (ball <= 2 * radius + 1e-9)
    near[np.arange(len(points)), home] = True
    return home, near


def metric_join(vectors: DataFrame, cosine: float = 0.98, cell: int = 50, most_pivots: int = 16, block: int = 8000) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding, label).

    Vectors of one non-null label link at cosine >= ``cosine`` in double precision. n_links counts
    the other rows linked directly; component_id is the smallest vec_id that links reach.

    Null, empty or zero vectors, and those with null or non-finite components, link with nothing;
    vectors of two lengths are never linked. Equal vectors of a label are one node with a count, so
    copies cost nothing. Each length has pivots of its own, one for ``cell`` distinct vectors of a label
    and ``most_pivots`` at most: a vector is copied to so many cells at most, whatever the data.
    A cell's members, at home or copied, are cut into blocks of about ``block`` by hash, and each
    block at home meets each block of members: a task holds two blocks whatever the cell's size.
    Repeated rows give a row each. A null vec_id takes part and links what lies on both sides of it, but
    names no component: where all ids are null, component_id is null and the rows are kept.
    """
    ok = F.coalesce(F.size("embedding") > 0, F.lit(False)) & F.col("label").isNotNull()
    ok = ok & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("_v"), F.coalesce(ok, F.lit(False)).alias("_ok"))
    rows = rows.withColumn("_v", F.transform("_v", lambda x: x + F.lit(0.0)))  # -0.0 as 0.0
    keyed = rows.withColumn("k1", F.when(F.col("_ok"), F.xxhash64("_v"))).withColumn("k2", F.when(F.col("_ok"), F.xxhash64(F.lit(1), F.reverse("_v"))))
    narrow = stable(keyed.select("vec_id", "label", "k1", "k2"))
    full = keyed.where("_ok")
    distinct = stable(
        full.groupBy("label", "k1", "k2").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("rep"), F.first("_v").alias("_v")).withColumn("node", F.xxhash64("label", "k1", "k2"))
    )
    n = distinct.count()
    if n == 0:
        return narrow.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    pivots = choose_pivots(distinct, cell, most_pivots)
    radius = math.sqrt(max(0.0, 2.0 - 2.0 * cosine))
    numbers = {width: k * most_pivots for k, width in enumerate(sorted(pivots))}  # cells of each length

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("_v").to_pylist()
            widths = np.array([len(v) for v in raw])
            index, where, at_home = [], [], []
            for width in np.unique(widths).tolist():
                same = np.flatnonzero(widths == width)
                home, near = cells_of(unit(np.array([raw[i] for i in same.tolist()])), pivots[width], radius)
                i, q = np.nonzero(near)
                index.append(same[i]), where.append(q + numbers[width]), at_home.append(home[i] == q)
            index, where, at_home = (np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in (index, where, at_home))
            keep = [batch.column(c).take(pa.array(index.astype(np.int64))) for c in ("label", "node", "copies", "rep", "_v")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(where, pa.int32()), pa.array(at_home.astype(bool))], names=["label", "node", "copies", "rep", "_v", "cell", "home"])

    label = vectors.schema["label"].dataType.simpleString()
    placed = distinct.select("label", "node", "copies", "rep", "_v").mapInArrow(place, f"label {label}, node bigint, copies bigint, rep bigint, _v array<double>, cell int, home boolean")
    sizes = placed.groupBy("label", "cell").agg(F.ceil(F.count_if("home") / block).cast("int").alias("_h"), F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_m"))
    placed = placed.join(sizes, ["label", "cell"])
    at_home = placed.where("home").withColumn("_i", F.pmod(F.xxhash64("node"), F.greatest("_h", F.lit(1))).cast("int")).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
    members = placed.where("_h > 0").withColumn("_j", F.pmod(F.xxhash64("node", F.lit(2)), F.col("_m")).cast("int")).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_h") - 1)))
    columns = ["label", "cell", "_i", "_j", "node", "copies", "rep", "_v"]
    pairs = at_home.select(*columns, F.lit(True).alias("home")).union(members.select(*columns, F.lit(False).alias("home")))

    def join(group: pa.Table) -> pa.Table:
        home = group.column("home").to_numpy()
        node, copies = group.column("node").to_numpy(), group.column("copies").to_numpy()
        values = group.column("_v").combine_chunks()
        points = unit(values.flatten().to_numpy().reshape(len(group), -1))
        a, b = np.flatnonzero(home), np.flatnonzero(~home)
        links, root = np.zeros(len(b), dtype=np.int64), np.arange(len(group))
        edges: list[tuple[int, int]] = []
        for begin in range(0, len(b), 512):
            part = b[begin : begin + 512]
            near = exact(points[part] @ points[a].T, points, part, a, cosine) & (node[part][:, None] != node[a][None, :])
            links[begin : begin + 512] = near @ copies[a]
            i, j = np.nonzero(near)
            forest(root, part[i], a[j], edges)
        some = links > 0
        out = [node[b][some], links[some], np.full(int(some.sum()), -1)], [np.array([node[x] for x, _ in edges], dtype=np.int64), np.full(len(edges), -1), np.array([node[y] for _, y in edges], dtype=np.int64)]
        return pa.table({name: pa.array(np.concatenate([x[k], y[k]]), pa.int64()) for k, (name, x, y) in enumerate([("node", *out), ("n", *out), ("other", *out)])})

    found = stable(pairs.groupBy("label", "cell", "_i", "_j").applyInArrow(join, "node bigint, n bigint, other bigint"))
    linked = found.where("n >= 0").groupBy("node").agg(F.sum("n").alias("_n"))
    members = stable(component_members(found.where("n < 0").select("node", "other")))
    names = distinct.select("node", "rep").join(members, "node").groupBy("root").agg(F.min("rep").alias("_name"))
    named = distinct.select("label", "k1", "k2", "node", "copies", "rep").join(linked, "node", "left").join(members, "node", "left").join(names, "root", "left")
    name = F.when(F.col("root").isNull(), F.col("rep")).otherwise(F.col("_name"))
    named = named.select(F.col("label").alias("_label"), F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), (F.col("copies") - 1 + F.coalesce("_n", F.lit(0))).alias("_links"), name.alias("_root"))
    match = (F.col("label") == F.col("_label")) & (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2"))
    out = narrow.join(named, match, "left").select("vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("_root", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))


def exact(products: np.ndarray, points: np.ndarray, a: np.ndarray, b: np.ndarray, cosine: float) -> np.ndarray:
    """Which products reach the threshold; those within rounding of it are summed again exactly."""
    near = products >= cosine
    for i, j in zip(*np.nonzero(np.abs(products - cosine) < 1e-13)):
        x, y = points[a[i]], points[b[j]]
        near[i, j] = math.fsum(x * y) / math.sqrt(math.fsum(x * x) * math.fsum(y * y)) >= cosine
    return near


def forest(root: np.ndarray, a: np.ndarray, b: np.ndarray, edges: list[tuple[int, int]]) -> None:
    """Add the links (a, b) that join two trees to ``edges``; the others say nothing new."""
    while len(a):
        x, y = root[a], root[b]
        new = x != y
        a, b, x, y = a[new], b[new], x[new], y[new]
        if not len(a):
            return
        _, first = np.unique(np.maximum(x, y), return_index=True)  # each larger root hooks on once a round
        for i in first.tolist():
            edges.append((int(a[i]), int(b[i])))
            root[max(x[i], y[i])] = min(x[i], y[i])
        while not np.array_equal(root, up := root[root]):
            root[:] = up
