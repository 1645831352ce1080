"""What both substring operators share: finding the windows of fixed length that occur more than once.

Each operator names every window of a text by something inside it that any equal window also
holds, and writes one row for each run of windows of one name: (name, seg, doc, key, at). seg is the
BLAKE2b digest of the stretch that the run covers; a row of the input is known by its doc_id and a
hash of its text. Rows of one name meet; equal (name, seg) are equal stretches, and the windows of
different stretches of one name have to be compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.tables import stable

MOST_IN_RUN = 511  # windows of a run, 9 bits of `at`
RUN_SCHEMA = "name bigint, seg bigint, doc bigint, key bigint, at bigint"
RUN_COLUMNS = ["name", "seg", "doc", "key", "at"]


def keyed(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text (binary), doc and key, by which a row is known, and the carried columns as _c0, _c1, ..."""
    text = docs["text"].cast("binary")
    doc = F.coalesce(docs["doc_id"], F.lit(-(2**63)))
    return docs.select(docs["doc_id"], text.alias("text"), doc.alias("doc"), F.xxhash64(docs["doc_id"], text).alias("key"), *(docs[c].alias(f"_c{i}") for i, c in enumerate(carry)))


def pack(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    return (low.astype(np.int64) << 9) | n


def unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first window, number of windows)."""
    return at >> 9, at & MOST_IN_RUN


def windows_to_runs(places: np.ndarray, valid: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first window, number of windows) of the runs of valid windows that one place of a text names.

    Not only one name: in periodic text the name recurs within a run, and so may the windows.
    """
    at = np.flatnonzero(valid)
    if not len(at):
        return at, at
    new = np.append(True, (np.diff(at) > 1) | (places[at[1:]] != places[at[:-1]]) | (text_of[at[1:]] != text_of[at[:-1]]))
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(at)))
    pieces = -(-count // MOST_IN_RUN)
    start = np.repeat(at[begin], pieces) + MOST_IN_RUN * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    return start, np.minimum(MOST_IN_RUN, np.repeat(at[begin] + count, pieces) - start)


def hot_names(docs: DataFrame, runs_of: Callable[[DataFrame], DataFrame], rows: int = 3000, share: float = 0.002) -> list[int]:
    """Names that hold more than ``share`` of the runs (at 20 a document) of about ``rows`` documents drawn by hash.

    A hint for spreading work, of at most 1 / ``share`` names; results don't depend on it.
    """
    part = min(1.0, rows / max(1, docs.count()))
    drawn = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(part * (1 << 30)))
    counts = runs_of(drawn).groupBy("name").count()
    counts = counts.where(F.col("count") > 20).orderBy(F.desc("count"), "name").limit(int(1 / share)).collect()
    return [r["name"] for r in counts if r["count"] > share * 20 * rows]


def meet(runs: DataFrame, keep: str, hot: list[int], both: bool, salts: int = 64, odd_hot: bool = False) -> DataFrame:
    """Judge runs by name: (name, doc, key, at, gone, check); rows that need neither are left out.

    gone: every window of the run is to be removed, as its stretch equals another one. check: its
    windows have to be compared with those of other runs of the name. Of a stretch that occurs more
    than once, the first two occurrences are compared like all others if ``both``, else only the
    first; further ones share the fate of a copy. keep 'none' removes every occurrence, 'first' all
    but that of the least (doc, position).

    Rows of a name are sorted and read as a stream, of which one row is held: there is no group to
    collect. The names in ``hot``, and all odd ones if ``odd_hot``, are dealt to ``salts`` tasks by document;
    each judges its own part, and all that is left to compare meets again by name. A column ``h`` (binary) is
    carried along.
    """
    known = np.array(sorted(hot), dtype=np.int64)
    carried = ["h"] if "h" in runs.columns else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, several, last = None, 0, False, None  # first row of an unfinished stretch, its rows so far, whether its name has others
        for batch in batches:
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if keep == "first" and len(rows[0]):  # rows that agree in doc_id and text are one document
                before = [x[:1] if last is None else y for x, y in zip(rows, last or rows)]
                other = np.any([np.append(y[:1], x[:-1]) != x for x, y in zip(rows, before)], axis=0)
                other[0] |= last is None
                last = [x[-1:] for x in rows]
                rows = [x[other] for x in rows]
            if not len(rows[0]):
                continue
            if held is not None:
                rows = [np.append(y, x) for x, y in zip(rows, held)]
            name, seg = rows[:2]
            new_name = np.append(True, name[1:] != name[:-1])
            new_seg = new_name | np.append(True, seg[1:] != seg[:-1])
            begin, stretch = np.flatnonzero(new_seg), np.cumsum(new_seg) - 1
            size, index = np.bincount(stretch), np.arange(len(name)) - begin[stretch]
            of_name = (np.cumsum(new_name) - 1)[begin]
            others = (np.bincount(of_name) > 1)[of_name] | np.isin(name[begin], known) | ((name[begin] & odd_hot) == 1)
            if held is not None:
                size[0] += count - 1
                index[(stretch == 0) & ~new_seg] += count - 1
                others[of_name == 0] |= several
            first_gone = (size > 1) & (keep == "none") & (not both)
            first_check = others | ((size > 1) & both)
            gone, check = first_gone[stretch], first_check[stretch]
            gone[~new_seg], check[~new_seg] = True, False
            if both:
                second = index == 1
                gone[second], check[second] = False, True
            out = gone | check
            out[begin[-1]] = False
            yield _judged(rows, out, gone, check)
            held, count = [x[begin[-1] : begin[-1] + 1] for x in rows], int(size[-1])
            several = bool(others[-1])
        if held is not None:
            gone, check = np.array([count > 1 and keep == "none" and not both]), np.array([several or (count > 1 and both)])
            yield _judged(held, gone | check, gone, check)

    spread = F.col("name").isin(hot) | ((F.col("name").bitwiseAND(F.lit(1)) == 1) & F.lit(odd_hot))
    salt = F.when(spread, F.pmod(F.xxhash64("doc", "key", "at"), F.lit(salts))).otherwise(0)
    dealt = runs.select(*RUN_COLUMNS, *carried).repartition("name", *([salt] if hot or odd_hot else []))
    return dealt.sortWithinPartitions(*RUN_COLUMNS).mapInArrow(run, ", ".join(["name bigint, doc bigint, key bigint, at bigint", *(f"{c} binary" for c in carried), "gone boolean, check boolean"]))


def _judged(rows: list[np.ndarray], out: np.ndarray, gone: np.ndarray, check: np.ndarray) -> pa.RecordBatch:
    name, _, doc, key, at, *carried = (x[out] for x in rows)
    columns = [*map(pa.array, (name, doc, key, at)), *(pa.array(x, pa.binary()) for x in carried), pa.array(gone[out]), pa.array(check[out])]
    return pa.RecordBatch.from_arrays(columns, names=["name", "doc", "key", "at", *(["h"] if carried else []), "gone", "check"])


def equal_in(rows: list[np.ndarray], keep: str) -> list[np.ndarray]:
    """(doc, key, at) of the runs of windows to remove among rows (h1, h2, doc, key, at) as for ``equal_windows``, which hold all that are equal."""
    order = np.lexsort(rows[::-1])
    rows = [x[order] for x in rows]
    if keep == "first":
        other = np.append(True, np.any([x[1:] != x[:-1] for x in rows], axis=0))
        rows = [x[other] for x in rows]
    same = (rows[0][1:] == rows[0][:-1]) & (rows[1][1:] == rows[1][:-1])
    gone = np.append(False, same) if keep == "first" else np.append(same, False) | np.append(False, same)
    doc, key, at = (x[gone] for x in rows[2:])
    if not len(at):
        return [doc, key, at]
    order = np.lexsort((at, key, doc))
    doc, key, low = doc[order], key[order], unpack(at[order])[0]
    new = np.append(True, (np.diff(low) != 1) | (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]))
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(low)))
    cut = -(-count // MOST_IN_RUN)
    first = np.repeat(first, cut) + MOST_IN_RUN * (np.arange(cut.sum()) - np.repeat(np.cumsum(cut) - cut, cut))
    count = np.diff(np.append(first, len(low)))
    return [doc[first], key[first], pack(low[first], count)]


def equal_windows(windows: DataFrame, keep: str) -> DataFrame:
    """(doc, key, at) of the windows to remove among rows (h1, h2, doc, key, at), each one window with its 128-bit digest.

    Rows are ordered over all partitions, so a window with a third of all rows is spread over many
    tasks; the ends of the partitions (two rows each) are compared on the driver. Under 'first', rows
    that agree in (doc, key, at) as well are one window.
    """
    order = ["h1", "h2", "doc", "key", "at"]
    ordered = windows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        single = True
        for batch in batches:
            rows = [c.to_numpy() for c in batch.columns]
            if not len(rows[0]):
                continue
            fresh = last is None
            if fresh:
                first = [int(x[0]) for x in rows]
            else:
                rows = [np.append(x, y) for x, y in zip(last, rows)]
            if keep == "first":
                other = np.append(True, np.any([x[1:] != x[:-1] for x in rows], axis=0))
                rows = [x[other] for x in rows]
            same = (rows[0][1:] == rows[0][:-1]) & (rows[1][1:] == rows[1][:-1])
            if keep == "first":
                gone = np.append(False, same)
            else:
                gone = np.append(same, False) | np.append(False, same)
            if not fresh and keep == "none":
                gone[0] &= single  # else it was given already
            single = not (len(same) and same[-1])
            last = [int(x[-1]) for x in rows]
            yield _flagged([x[gone] for x in rows], None)
        if last is not None:
            yield _flagged([np.array(x, dtype=np.int64) for x in zip(first, last)], np.array([0, 1]))

    found = stable(ordered.mapInArrow(run, "h1 bigint, h2 bigint, doc bigint, key bigint, at bigint, end int").select("*", F.spark_partition_id().alias("part")))
    ends = sorted((r["part"], r["end"], *(r[c] for c in order)) for r in found.where("end IS NOT NULL").collect())  # two rows a partition
    across = set()
    for x, y in zip(ends[1::2], ends[2::2]):
        if x[2:4] == y[2:4] and not (keep == "first" and x[2:] == y[2:]):
            across |= {y[4:]} | ({x[4:]} if keep == "none" else set())
    out = found.where("end IS NULL").select("doc", "key", "at")
    return out.union(out.sparkSession.createDataFrame(sorted(across), "doc bigint, key bigint, at bigint")) if across else out


def _flagged(rows: list[np.ndarray], end: np.ndarray | None) -> pa.RecordBatch:
    ends = pa.nulls(len(rows[0]), pa.int32()) if end is None else pa.array(end, pa.int32())
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in rows), ends], names=["h1", "h2", "doc", "key", "at", "end"])


def with_stretches(texts: DataFrame, flagged: DataFrame, how: str = "inner", columns: tuple[str, ...] = ("at",)) -> DataFrame:
    """``keyed`` texts with the packed stretches of each, as the array _at (and one for each further column)."""
    lists = flagged.groupBy("doc", "key").agg(*(F.collect_list(c).alias(f"_{c}") for c in columns))
    lists = lists.select(F.col("doc").alias("_doc"), F.col("key").alias("_key"), *(f"_{c}" for c in columns))
    return texts.join(lists, (texts["doc"] == lists["_doc"]) & (texts["key"] == lists["_key"]), how)


def covered(length: int, ats: np.ndarray, width: int) -> np.ndarray:
    """Which of ``length`` units lie in a window of ``width`` units that is to be removed."""
    low, n = unpack(ats)
    edge = np.zeros(length + 1, dtype=np.int32)
    np.add.at(edge, low, 1)
    np.add.at(edge, low + n + width - 1, -1)
    return np.cumsum(edge[:-1]) > 0
