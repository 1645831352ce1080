"""Pairs of similar sets by their rare members first, and the greedy choice among what is alike."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.tables import stable


def all_pairs(rows: DataFrame, by: list[str], key: str, text: str, words: str, block: int = 1000) -> DataFrame:
    """(a, b, similarity), a < b: every pair of one ``by`` with the Jaccard similarity of its words; 1 if the texts are equal, 0 if one is empty.

    ``words`` has no repeats. All pairs are asked for, so rows grow with the square of a group; a group is dealt to
    blocks of about ``block``, and every two blocks are one task's, in numpy.
    """
    n = rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_cuts"))
    own = F.pmod(F.xxhash64(key), F.col("_cuts")).cast("int")
    dealt = rows.where(F.col(key).isNotNull()).join(n, by).select(*by, F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"), F.col(words).alias("_words"), own.alias("_own"), F.explode(F.sequence(F.lit(0), F.col("_cuts") - 1)).alias("_other"))
    dealt = dealt.withColumn("_i", F.least("_own", "_other")).withColumn("_j", F.greatest("_own", "_other")).drop("_other")
    return dealt.groupBy(*by, "_i", "_j").applyInArrow(_block_pairs, "a bigint, b bigint, similarity double")


def _block_pairs(rows: pa.Table) -> pa.Table:
    rows = rows.combine_chunks()
    number = lambda name: rows.column(name).to_numpy()
    coded = lambda array: array.dictionary_encode().indices.to_numpy()
    chunk = lambda name: rows.column(name).chunk(0) if rows.column(name).num_chunks == 1 else pa.concat_arrays(rows.column(name).chunks)
    keys, own, lists = number("_key"), number("_own"), chunk("_words")
    said, sizes = coded(chunk("_text")), lists.value_lengths().to_numpy()
    empty = np.array(pc.equal(chunk("_text"), "").to_numpy(zero_copy_only=False))
    word = coded(lists.flatten())
    ends = np.append(0, np.cumsum(sizes))
    order = np.argsort(keys, kind="stable")
    place = np.empty(len(keys), dtype=np.int64)
    place[order] = np.arange(len(keys))
    owner = place[np.repeat(np.arange(len(keys)), sizes)]
    by_word = np.lexsort((owner, word))
    held, bounds = owner[by_word], np.append(0, np.cumsum(np.bincount(word, minlength=1)))
    lists_of = [word[ends[i] : ends[i + 1]] for i in order]
    keys, own, said, sizes, empty = (x[order] for x in (keys, own, said, sizes, empty))
    crossed = rows.column("_i")[0] != rows.column("_j")[0]
    out: list[tuple] = []
    for x in range(len(keys) - 1):
        after = np.searchsorted(keys, keys[x], "right")
        if after == len(keys):
            break
        met = [held[bounds[w] : bounds[w + 1]] for w in lists_of[x]]
        both = np.bincount(np.concatenate(met), minlength=len(keys))[after:] if met else np.zeros(len(keys) - after, dtype=np.int64)
        whole = sizes[x] + sizes[after:] - both
        alike = both / np.maximum(whole, 1)
        alike[said[after:] == said[x]] = 1.0
        alike[empty[after:] | empty[x]] = 0.0
        if crossed:
            other = own[after:] != own[x]
            out.append((np.full(np.count_nonzero(other), keys[x]), keys[after:][other], alike[other]))
        else:
            out.append((np.full(len(alike), keys[x]), keys[after:], alike))
    columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)]
    return pa.table({"a": columns[0], "b": columns[1], "similarity": columns[2]})


def rare_first(sets: DataFrame, by: list[str], key: str, members: str) -> DataFrame:
    """(by, key, _m, _d, _n): the different members of each set in one order within each ``by``, rare ones first, how many sets have each, and how many they are."""
    rows = sets.select(*by, key, F.explode(F.array_distinct(members)).alias("_x")).where(F.col("_x").isNotNull())
    often = rows.groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("_df"))
    placed = rows.join(often, [*by, "_x"]).groupBy(*by, key).agg(F.sort_array(F.collect_set(F.struct("_df", "_x"))).alias("_o"))
    return placed.select(*by, key, F.transform("_o", lambda x: x["_x"]).alias("_m"), F.transform("_o", lambda x: x["_df"]).alias("_d"), F.size("_o").alias("_n"))


def _least(percent: int, n: Column, strict: bool, share: int = 100) -> Column:
    """Least whole number that is ``percent`` of ``n`` / ``share``, or more than that if ``strict``."""
    product = F.lit(percent) * n
    return (F.floor(product / share) + 1 if strict else F.ceil(product / share)).cast("int")


def _met(ordered: DataFrame, by: list[str], key: str, percent: int, strict: bool, contained: bool, block: int, carry: int) -> DataFrame:
    """(by, _x, a, b, _na, _nb, _ia, _ib, _ma, _mb): a row for each of their first members that two sets share, at its places in both.

    Sets that share enough share one of the first n - least + 1 members of each (of the smaller one
    if ``contained``). A row is left out where the sizes, or this member with all that can follow it,
    don't reach what is needed. Sets of at most ``carry`` members bring them along, longer ones null. The sets
    of a member that more than ``block`` of them have are dealt to blocks, and each pair of blocks meets on its own.
    """
    carried = F.when(F.col("_n") <= carry, F.col("_m")).alias("_c")

    def side(whole: bool, name: str, own: str, other: str) -> DataFrame:
        first = F.col("_n") if whole else F.col("_n") - _least(percent, F.col("_n"), strict) + 1
        rows = ordered.select(*by, key, "_n", carried, F.posexplode(F.slice(F.arrays_zip("_m", "_d"), F.lit(1), first)).alias("_i", "_z"))
        blocks = F.ceil(F.col("_z._d") / block).cast("int")
        rows = rows.select(*by, F.col("_z._m").alias("_x"), F.col(key).alias(name), F.col("_n").alias(f"_n{name}"), F.col("_i").alias(f"_i{name}"), F.col("_c").alias(f"_m{name}"), blocks.alias("_b"))
        return rows.withColumn(own, F.pmod(F.xxhash64(name), F.col("_b")).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col("_b") - 1))).drop("_b")

    met = side(False, "a", "_p", "_q").join(side(contained, "b", "_q", "_p"), [*by, "_x", "_p", "_q"])
    if contained:
        met, needed = met.where(F.struct("_na", "a") < F.struct("_nb", "b")), _least(percent, F.col("_na"), strict)
    else:
        met, needed = met.where("a < b").where(F.lit(percent) * F.greatest("_na", "_nb") <= 100 * F.least("_na", "_nb")), _least(percent, F.col("_na") + F.col("_nb"), strict, 100 + percent)
    return met.withColumn("_needed", needed)


def candidates(ordered: DataFrame, by: list[str], key: str, percent: int, strict: bool, contained: bool = False, block: int = 2000) -> DataFrame:
    """(by, a, b, _na, _nb) of the pairs that may be similar, by their shared first members alone."""
    return _counted(_met(ordered, by, key, percent, strict, contained, block, 0), by)


def _counted(met: DataFrame, by: list[str]) -> DataFrame:
    pairs = met.groupBy(*by, "a", "b", "_na", "_nb", "_needed").agg(F.count(F.lit(1)).alias("_c"), F.max("_ia").alias("_ia"), F.max("_ib").alias("_ib"))
    after = F.least(F.col("_na") - F.col("_ia"), F.col("_nb") - F.col("_ib")) - 1
    return pairs.where(F.col("_c") + after >= F.col("_needed")).select(*by, "a", "b", "_na", "_nb")


def similar_sets(sets: DataFrame, by: list[str], key: str, members: str, percent: int, strict: bool = False, contained: bool = False, block: int = 2000, carry: int = 64) -> DataFrame:
    """(by, a, b, both, n_a, n_b): pairs of sets of one ``by`` with 100 x both >= ``percent`` x union.

    ``strict``: more than that. ``contained``: by the size of the smaller set in place of the union, a the
    smaller (ties: of the smaller key); else a < b. ``sets``: a row for each set, its key unique within
    ``by``, no nulls in either; members is an array, of which nulls and repeats count for nothing. Sets
    without members are in no pair.

    Two sets of at most ``carry`` members are judged where they first meet, at their first shared member, so
    no pair is exchanged. Pairs with a longer set are brought together by key and then joined with both.
    """
    ordered = stable(rare_first(sets, by, key, members))
    shared = F.array_intersect("_ma", "_mb")
    met = _met(ordered.where(F.col("_n") <= carry), by, key, percent, strict, contained, block, carry)
    met = met.where(F.least(F.col("_na") - F.col("_ia"), F.col("_nb") - F.col("_ib")) >= F.col("_needed"))  # at the first shared member no other came before
    met = met.where((F.col("_ia") == 0) | ~F.arrays_overlap(F.slice("_ma", 1, F.col("_ia")), F.col("_mb")))
    whole = lambda both: F.col("_na") if contained else F.col("_na") + F.col("_nb") - both
    enough = lambda both: (100 * both > percent * whole(both)) if strict else (100 * both >= percent * whole(both))
    judged = F.explode(F.filter(F.array(F.size(shared)), enough)).alias("both")  # an array of one, so that sets are intersected once
    short = met.select(*by, "a", "b", judged, F.col("_na").alias("n_a"), F.col("_nb").alias("n_b"))
    full = short
    if not ordered.where(F.col("_n") > carry).isEmpty():
        pairs = _counted(_met(ordered, by, key, percent, strict, contained, block, 0).where(F.greatest("_na", "_nb") > carry), by)
        side = lambda name: ordered.select(*by, F.col(key).alias(name), F.col("_m").alias(f"_m{name}"))
        full = short.union(pairs.join(side("a"), [*by, "a"]).join(side("b"), [*by, "b"]).select(*by, "a", "b", judged, F.col("_na").alias("n_a"), F.col("_nb").alias("n_b")))
    return full


def keep_first(items: DataFrame, links: DataFrame, by: list[str], key: str, order: list[str]) -> DataFrame:
    """``items`` without those linked to one that stays and comes before them.

    What a walk through each ``by`` in ``order`` (ascending, ties by key) keeps that drops whatever is
    linked to something kept. ``links``: by, a, b, either way round. In each round stays whatever has no
    undecided item before it among its links, and what those are linked to goes; the first of a chain
    of links decides the second, that one the third, so rounds are few unless chains follow the order.
    Links are written to the checkpoint folder after each round and only shrink.
    """
    place = F.struct(*by, *order, key)
    known = items.select(*by, F.col(key).alias("_k"), place.alias("_p"))
    end = lambda name: known.select(*by, F.col("_k").alias(name), F.col("_p").alias(f"_{name}"))
    both = links.select(*by, "a", "b").join(end("a"), [*by, "a"]).join(end("b"), [*by, "b"]).where("_a <> _b")
    left = stable(both.select(F.least("_a", "_b").alias("first"), F.greatest("_a", "_b").alias("later")).distinct())
    gone = []
    while not left.isEmpty():
        free = left.join(left.select(F.col("later").alias("_l")), F.col("first") == F.col("_l"), "left_anti")
        out = stable(free.select(F.col("later").alias("_out")).distinct())
        gone.append(out)
        left = stable(left.join(out, F.col("later") == F.col("_out"), "left_anti").join(out, F.col("first") == F.col("_out"), "left_anti"))
    if not gone:
        return items
    dropped = reduce(DataFrame.union, gone)
    return items.withColumn("_p", place).join(dropped, F.col("_p") == F.col("_out"), "left_anti").drop("_p")
