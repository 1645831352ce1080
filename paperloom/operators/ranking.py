"""Normalising, fusing and diversifying scores, per query."""

from __future__ import annotations

import heapq
import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_by_score(scores: DataFrame, by: list[str]) -> DataFrame:
    """1-based rank by score, ties by work_id."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "work_id")))


def rrf(scores: DataFrame, k: int = 60) -> DataFrame:
    """(query_id, work_id, rrf): sum of 1 / (k + rank) over rankers; a work that a ranker lacks ranks after all.

    ``scores``: query_id, work_id, ranker, score. Works and rankers of a query are those in its rows.
    """
    ranked = rank_by_score(scores, ["query_id", "ranker"])
    sizes = scores.groupBy("query_id").agg(F.countDistinct("work_id").alias("_works"), F.countDistinct("ranker").alias("_rankers"))
    seen = ranked.groupBy("query_id", "work_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("_s"), F.count(F.lit(1)).alias("_n"))
    return seen.join(sizes, "query_id").select("query_id", "work_id", (F.col("_s") + (F.col("_rankers") - F.col("_n")) / (k + F.col("_works") + 1)).alias("rrf"))


def robust_norm(scores: DataFrame, by: list[str], value: str = "score") -> DataFrame:
    """``norm``: the value between its 5th and 95th percentile of the group, within 0 and 1; all 0 if they agree.

    Percentiles are entries, at index round(q (n - 1)), half to even.
    """
    group = Window.partitionBy(*by)
    ordered = scores.withColumn("_i", F.row_number().over(group.orderBy(value)) - 1).withColumn("_n", F.count(F.lit(1)).over(group))
    at = lambda q: F.max(F.when(F.col("_i") == F.bround(q * (F.col("_n") - 1), 0).cast("int"), F.col(value))).over(group)
    out = ordered.withColumn("_low", at(0.05)).withColumn("_high", at(0.95))
    x = (F.col(value) - F.col("_low")) / (F.col("_high") - F.col("_low"))
    return out.withColumn("norm", F.when(F.col("_high") <= F.col("_low"), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))).drop("_i", "_n", "_low", "_high")


def min_max_norm(scores: DataFrame, by: list[str], value: str = "score", floor: float = 0.05) -> DataFrame:
    """``norm`` by the group's range (all 1 if it is 0), not below ``floor``."""
    g = Window.partitionBy(*by)
    low, high = F.min(value).over(g), F.max(value).over(g)
    return scores.withColumn("norm", F.greatest(F.lit(floor), F.when(high == low, 1.0).otherwise((F.col(value) - low) / (high - low))))


def weighted_sum(features: dict[str, float]) -> Column:
    return sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in features.items()), F.lit(0.0))


def interleave(ranked: DataFrame, by: str) -> DataFrame:
    """Two orderings r1 and r2 of the same works dealt in turn, the first one first, without repeats."""
    slot = F.least(2 * F.col("r1"), 2 * F.col("r2") + 1)
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(slot, "work_id")))


def three_tier_pool(candidates: DataFrame, by_cites: int, by_year: int, by_text: int) -> DataFrame:
    """Union of each query's first works by citations, by year and by lexical score."""
    w = Window.partitionBy("query_id")
    ranks = [F.row_number().over(w.orderBy(F.desc_nulls_last(c), "work_id")) for c in ("cited_by_count", "year", "score")]
    out = candidates.select("*", *(r.alias(f"_r{i}") for i, r in enumerate(ranks)))
    return out.where((F.col("_r0") <= by_cites) | (F.col("_r1") <= by_year) | (F.col("_r2") <= by_text)).drop("_r0", "_r1", "_r2")


def partitioned_quota(candidates: DataFrame, total: int, share: float = 0.8) -> DataFrame:
    """``total`` works a query: a share from part A, the rest from B, A filling in where B lacks."""
    own = Window.partitionBy("query_id", "part").orderBy(F.desc("score"), "work_id")
    n_b = F.count(F.when(F.col("part") == "B", 1)).over(Window.partitionBy("query_id"))
    from_b = F.least(n_b, F.lit(total - int(total * share)))
    ranked = candidates.withColumn("_r", F.row_number().over(own)).withColumn("_b", from_b)
    return ranked.where(F.when(F.col("part") == "A", F.col("_r") <= total - F.col("_b")).otherwise(F.col("_r") <= F.col("_b"))).drop("_r", "_b")


def relevance_gate(candidates: DataFrame, least: float = 0.40, lenient: float = 0.30) -> DataFrame:
    """Works at ``least`` relevance; at ``lenient`` if found as a foundational title for a query that is not specific."""
    founded = F.coalesce(F.exists("provenance", lambda p: p == "foundational_title"), F.lit(False)) & ~F.coalesce(F.col("specific"), F.lit(False))
    return candidates.where(F.coalesce("relevance", F.lit(0.0)) >= F.when(founded, lenient).otherwise(least))


def mmr(pool: DataFrame, k: int, weights: tuple[float, float, float, float] = (0.8, 0.2, 0.08, 0.12)) -> DataFrame:
    """(query_id, work_id, pick): greedy choice of relevant and varied works.

    ``pool``: query_id, work_id, score, impact, era, subfield, embedding (any vector of features), at
    most some hundred works a query, cut before by ``top_k``. Each step takes the work with the best
    relevance less its likeness to what was taken and the shares of its era and subfield there, these two
    discounted by half its impact; with weights of 0 for them it is the plain choice. Greedy choice is
    sequential, so a query is one group.
    """
    relevance, likeness, era_w, field_w = weights

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        group = group.sort_values(["score", "work_id"], ascending=[False, True]).reset_index(drop=True)
        vectors = np.array(group["embedding"].tolist(), dtype=float)
        norms = np.linalg.norm(vectors, axis=1, keepdims=True)
        vectors = vectors / np.where(norms > 0, norms, 1)
        like, taken = np.zeros(len(group)), []
        left, discount = np.ones(len(group), dtype=bool), 1 - 0.5 * group["impact"].to_numpy()
        eras, fields = group["era"].to_numpy(), group["subfield"].to_numpy()
        for step in range(min(k, len(group))):
            shares = [np.array([sum(v[j] == x for j in taken) / step for x in v]) if step else np.zeros(len(group)) for v in (eras, fields)]
            value = relevance * group["score"].to_numpy() - likeness * like - discount * (era_w * shares[0] + field_w * shares[1])
            best = int(np.argmax(np.where(left, value, -np.inf)))
            taken.append(best)
            left[best] = False
            like = np.maximum(like, vectors @ vectors[best])
        return pd.DataFrame({"query_id": group["query_id"].iloc[0], "work_id": group["work_id"].iloc[taken].to_numpy(), "pick": range(1, len(taken) + 1)})

    return pool.groupBy("query_id").applyInPandas(choose, "query_id long, work_id long, pick int")


def mmr_sparse(pool: DataFrame, vectors: DataFrame, k: int, relevance: float = 0.8, era: float = 0.08, field: float = 0.12, years: int = 5) -> DataFrame:
    """(query_id, work_id, pick): greedy choice of relevant and varied works by their TF-IDF vectors.

    ``pool``: query_id, work_id, score, impact (null: 0.5), year, subfield; at most some hundred works a
    query, cut before by ``top_k``. ``vectors``: work_id, term, weight. Each step takes the work with the
    best relevance x score less (1 - relevance) x its largest cosine with what was taken, less the
    share among what was taken of works within ``years`` of it and of its subfield, both discounted by
    half its impact; ties to the higher score, then the smaller work_id. A null or zero year, or a null
    or empty subfield, is like no other; a work without a vector is like none.

    Cosines only rise as more is taken, so a value with the cosines known so far bounds a work's value
    from above. Works wait in a heap by this bound and only the first ones are brought up to date.
    """

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values(["score", "work_id"], ascending=[False, True])
        sparse = [dict(zip(t, w)) if t is not None else {} for t, w in zip(rows["terms"], rows["weights"])]
        norms = [math.sqrt(sum(w * w for w in v.values())) for v in sparse]
        score, discount = rows["score"].tolist(), [1 - 0.5 * (0.5 if pd.isna(x) else x) for x in rows["impact"]]
        year, kind = [0 if pd.isna(x) else int(x) for x in rows["year"]], [x if isinstance(x, str) and x else None for x in rows["subfield"]]
        like, upto = [0.0] * len(rows), [0] * len(rows)
        taken: list[int] = []
        eras, kinds = Counter(), Counter()

        def cosine(i: int, j: int) -> float:
            a, b = (sparse[i], sparse[j]) if len(sparse[i]) <= len(sparse[j]) else (sparse[j], sparse[i])
            return sum(w * b[t] for t, w in a.items() if t in b) / (norms[i] * norms[j]) if norms[i] and norms[j] else 0.0

        def value(i: int) -> float:
            for j in taken[upto[i] :]:
                like[i] = max(like[i], cosine(i, j))
            upto[i] = len(taken)
            near = sum(eras[y] for y in range(year[i] - years, year[i] + years + 1)) / eras.total() if year[i] and eras else 0.0
            same = kinds[kind[i]] / kinds.total() if kind[i] and kinds else 0.0
            return relevance * score[i] - (1.0 - relevance) * like[i] - era * near * discount[i] - field * same * discount[i]

        heap = [(-relevance * score[i], i) for i in range(len(rows))]
        heapq.heapify(heap)
        while heap and len(taken) < k:
            best, seen = None, []
            while heap and (best is None or heap[0] < best):
                i = heapq.heappop(heap)[1]
                now = (-value(i), i)
                best = now if best is None else min(best, now)
                seen.append(i)
            taken.append(best[1])
            for i in seen:
                if i != best[1]:
                    heapq.heappush(heap, (-(relevance * score[i] - (1.0 - relevance) * like[i]), i))
            if year[best[1]]:
                eras[year[best[1]]] += 1
            if kind[best[1]]:
                kinds[kind[best[1]]] += 1
        return pd.DataFrame({"query_id": rows["query_id"].iloc[0], "work_id": rows["work_id"].iloc[taken].to_numpy(), "pick": range(1, len(taken) + 1)})

    wanted = vectors.join(pool.select("work_id").distinct(), "work_id", "left_semi")
    lists = wanted.groupBy("work_id").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("_v")).select("work_id", F.col("_v.term").alias("terms"), F.col("_v.weight").alias("weights"))
    rows = pool.select("query_id", "work_id", "score", "impact", "year", "subfield").join(lists, "work_id", "left")
    return rows.groupBy("query_id").applyInPandas(choose, "query_id long, work_id long, pick int")


def saturation(waves: DataFrame, taus: list[float], shapes: list[float], stop: float = 0.5) -> DataFrame:
    """Weibull saturation n (1 - exp(-(t / tau) ** k)) of cumulative relevance by wave, per query.

    ``waves``: query_id, t (1, 2, ...), seen. For each (tau, k) of the grid the best n has a closed
    form; the grid point with the least squared error is kept: n, tau, k, r2, completeness, stop.
    """
    spark = waves.sparkSession
    grid = spark.createDataFrame([(float(a), float(b)) for a in taus for b in shapes], "tau double, k double")  # the grid, a few dozen rows
    g = 1 - F.exp(-F.pow(F.col("t") / F.col("tau"), F.col("k")))
    fit = waves.join(F.broadcast(grid)).withColumn("_g", g).groupBy("query_id", "tau", "k").agg(
        F.sum(F.col("seen") * F.col("_g")).alias("_sg"), F.sum(F.col("_g") ** 2).alias("_gg"), F.sum(F.col("seen") ** 2).alias("_ss"), F.sum("seen").alias("_s"), F.count(F.lit(1)).alias("_n"), F.max("seen").alias("_last")
    )
    fit = fit.withColumn("n", F.col("_sg") / F.col("_gg")).withColumn("_rss", F.col("_ss") - F.col("_sg") * F.col("_sg") / F.col("_gg")).withColumn("_tss", F.col("_ss") - F.col("_s") * F.col("_s") / F.col("_n"))
    best = Window.partitionBy("query_id").orderBy(F.round("_rss", 9), "tau", "k")
    kept = fit.withColumn("_r", F.row_number().over(best)).where("_r = 1")
    return kept.select("query_id", "n", "tau", "k", F.when(F.col("_tss") > 1e-9, 1 - F.col("_rss") / F.col("_tss")).otherwise(0.0).alias("r2"), (F.col("_last") / F.col("n")).alias("completeness"), (F.col("_last") / F.col("n") >= stop).alias("stop"))
