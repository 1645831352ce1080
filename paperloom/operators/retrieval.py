"""Full-text retrieval and similarity, for many queries at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import STOP_WORDS, content_tokens, spaced_tokens, tokens
from paperloom.operators.similar import keep_first, similar_sets
from paperloom.tables import landed, stable


def build_postings(works: DataFrame) -> DataFrame:
    """(work_id, term, field, tf): term index of titles (A) and abstracts (B)."""
    fields = F.array(F.struct(F.lit("A").alias("field"), tokens(F.col("title")).alias("terms")), F.struct(F.lit("B").alias("field"), tokens(F.col("abstract")).alias("terms")))
    by_field = works.select("work_id", F.explode(fields).alias("f"))
    return by_field.select("work_id", F.explode("f.terms").alias("term"), F.col("f.field").alias("field")).groupBy("work_id", "term", "field").agg(F.count(F.lit(1)).alias("tf"))


def fts_search(postings: DataFrame, query_terms: DataFrame, most: int = 2000) -> DataFrame:
    """(query_id, work_id, score, part): works with any term of a query, the best ``most`` of each.

    ``query_terms``: query_id, term, original (expansion terms count half). A title term weighs 1.0,
    an abstract term 0.4, each by 1 + ln(tf). part is A where an original term matched, else B.
    Scores are compared to nine digits, so that the order in which terms were added decides nothing.
    """
    weight = F.when(F.col("field") == "A", 1.0).otherwise(0.4) * (1 + F.log(F.col("tf").cast("double"))) * F.when(F.col("original"), 2.0).otherwise(1.0)
    scored = postings.join(query_terms, "term").groupBy("query_id", "work_id").agg(F.sum(weight).alias("score"), F.max("original").alias("_a"))
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "work_id")
    return scored.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= most).select("query_id", "work_id", "score", F.when(F.col("_a"), "A").otherwise("B").alias("part"))


def build_positions(works: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(work_id, field, term, positions): the places (from 0) of each token in titles (A) and abstracts (B).

    ``terms`` (term): the only ones that will be asked for; none by default, then all are placed.
    """
    fields = F.array(F.struct(F.lit("A").alias("field"), tokens(F.col("title")).alias("terms")), F.struct(F.lit("B").alias("field"), tokens(F.col("abstract")).alias("terms")))
    by_field = works.select("work_id", F.explode(fields).alias("f"))
    placed = by_field.select("work_id", "f.field", F.posexplode("f.terms").alias("_i", "term"))
    if terms is not None:
        placed = placed.join(terms.select("term").distinct(), "term", "left_semi")
    return placed.groupBy("work_id", "field", "term").agg(F.sort_array(F.collect_list("_i")).alias("positions"))


def phrase_matches(positions: DataFrame, phrases: DataFrame) -> DataFrame:
    """(query_id, phrase, work_id, field, tf): how often each phrase stands in a field, its words side by side and in order.

    ``phrases``: query_id, phrase and what else there is, once each. A phrase starts at the places of its
    rarest word less that word's offset; each further word, the next rare one first, keeps the starts
    that it has a place for. So only the postings of the rarest word are read whole. Overlapping
    occurrences count; a phrase without a word matches nothing.
    """
    worded = phrases.withColumn("_w", tokens(F.col("phrase"))).where(F.size("_w") > 0)
    words = worded.select("phrase", "_w").distinct().select("phrase", F.posexplode("_w").alias("_at", "term"))
    df = positions.join(words.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    order = F.sort_array(F.collect_list(F.struct("_df", "_at", "term")))
    # phrases without their queries, known by a number: what is exchanged by work is small
    asked = landed(words.join(df, "term", "left").withColumn("_df", F.coalesce("_df", F.lit(0))).groupBy("phrase").agg(order.alias("_order")).withColumn("_id", F.monotonically_increasing_id()))
    longest = asked.agg(F.max(F.size("_order"))).first()[0] or 0
    nth = lambda i: asked.where(F.size("_order") > i).select("_id", F.size("_order").alias("_words"), F.get("_order", F.lit(i))["term"].alias("term"), F.get("_order", F.lit(i))["_at"].alias("_at"))
    starts = nth(0).join(positions, "term").select("_id", "_words", "work_id", "field", F.transform("positions", lambda p: p - F.col("_at")).alias("_s"))
    for i in range(1, longest):  # as often as the longest phrase has words
        more = starts.where(F.col("_words") > i).join(nth(i).drop("_words"), "_id").join(positions, ["term", "work_id", "field"])
        more = more.withColumn("_s", F.array_intersect("_s", F.transform("positions", lambda p: p - F.col("_at")))).where(F.size("_s") > 0)
        starts = starts.where(F.col("_words") <= i).unionByName(more.select(*starts.columns))
    found = starts.select("_id", "work_id", "field", F.size("_s").cast("long").alias("tf")).join(asked.select("_id", "phrase"), "_id")
    return found.join(worded.select("query_id", "phrase"), "phrase").select("query_id", "phrase", "work_id", "field", "tf")


def full_text_search(positions: DataFrame, asked: DataFrame, admitted: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(query_id, work_id, score, part): works with any of a query's terms and phrases.

    ``asked``: query_id, term (a word or a phrase), original. Weights and parts are those of
    ``fts_search``. Only works of ``admitted`` (work_id) count, say those not retracted and of the right
    years; ``most`` (none by default) cuts after that, best first.
    """
    weight = F.when(F.col("field") == "A", 1.0).otherwise(0.4) * (1 + F.log(F.col("tf").cast("double"))) * F.when(F.col("original"), 2.0).otherwise(1.0)
    once_each = asked.select("query_id", F.array_join(tokens(F.col("term")), " ").alias("phrase"), "original").groupBy("query_id", "phrase").agg(F.max("original").alias("original"))
    found = phrase_matches(positions if admitted is None else positions.join(admitted.select("work_id").distinct(), "work_id", "left_semi"), once_each)
    scored = found.join(once_each, ["query_id", "phrase"]).groupBy("query_id", "work_id").agg(F.sum(weight).alias("score"), F.max("original").alias("_a"))
    out = scored.select("query_id", "work_id", "score", F.when(F.col("_a"), "A").otherwise("B").alias("part"))
    if most is None:
        return out
    return top_k(out, most, "query_id", F.desc("score"), F.asc("work_id")).drop("rank")


def bm25(works: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, pairs: int = 2_000_000) -> DataFrame:
    """(query_id, work_id, score) of every work that has a term of the query.

    Okapi BM25 over white-space tokens of title and abstract. A term in more than half of the works
    has a negative idf and takes ``epsilon`` x the mean idf over the vocabulary instead. A term that
    a query repeats counts each time. ``work_id`` is unique.

    One pass counts documents by term, the null term standing for the document itself; the terms of the
    queries with their idf are written to the shared folder, so that the join knows their size. Works are
    dealt by work_id once, to so many tasks that works times queries are about ``pairs`` in each: what a task
    sums and sorts fits its memory at every size; counts and sums of a work then need no exchange. ``explode_outer``, since
    ``explode`` would have Spark tokenize twice to leave out works without a term.
    """
    tokenized = lambda rows: rows.select("work_id", spaced_tokens(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")))).alias("_t")).withColumn("_len", F.size("_t"))
    asked = queries.select("query_id", F.explode(spaced_tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("_times"))
    own = F.explode_outer(F.array_append(F.array_distinct("_t"), F.lit(None).cast("string"))).alias("term")
    df = tokenized(works).select("_len", own).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("_len"))).alias("_words"))
    df = df.join(asked.select("term", F.lit(True).alias("_asked")).distinct(), "term", "left")
    # the asked terms one by one, of the others how many have each df
    known = landed(df.groupBy(F.when(F.col("_asked"), F.col("term")).alias("term"), F.col("term").isNull().alias("_size"), "df").agg(F.count(F.lit(1)).alias("_terms"), F.max("_words").alias("_words")))
    size = known.where("_size").select(F.col("df").alias("_n"), (F.col("_words") / F.col("df")).alias("_avg"))
    known = known.where("NOT _size").join(F.broadcast(size))  # one row
    known = known.withColumn("idf", F.log(F.col("_n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = known.agg((F.sum(F.col("_terms") * F.col("idf")) / F.sum("_terms")).alias("_mean"))
    idf = known.where("term IS NOT NULL").join(F.broadcast(mean)).select("term", "_avg", F.when(F.col("idf") < 0, epsilon * F.col("_mean")).otherwise(F.col("idf")).alias("idf"))
    terms = landed(asked.join(idf, "term"))
    most = (size.first() or [0])[0] * terms.select("query_id").distinct().count()  # two numbers
    tasks = max(int(works.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-most // pairs))
    hits = tokenized(works.select("work_id", "title", "abstract").repartition(tasks, "work_id")).select("work_id", "_len", F.explode_outer("_t").alias("term"))
    tf = hits.join(terms.select("term").distinct(), "term", "left_semi").groupBy("work_id", "_len", "term").agg(F.count(F.lit(1)).alias("tf"))
    part = F.col("_times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("_len") / F.col("_avg")))
    return tf.join(terms, "term").groupBy("query_id", "work_id").agg(F.sum(part).alias("score"))


def top_k(scored: DataFrame, k: int, by: str, *order: Column) -> DataFrame:
    """The first ``k`` rows of each ``by`` in an order that ends in a unique key, with their rank."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def tfidf_vectors(docs: DataFrame, idf_extra: int = 0, only: DataFrame | None = None) -> DataFrame:
    """(doc, term, weight): tf / length x (ln((N + 1) / (df + 1)) + 1) over content tokens, in long form.

    ``docs``: doc, text; doc is unique. ``idf_extra`` adds to N for a query that counts as a document.
    ``only`` (doc): whose vectors are wanted; N and df count all documents.
    """
    tokenized = lambda rows: rows.select("doc", content_tokens(F.col("text")).alias("_t")).withColumn("_len", F.size("_t"))
    t = tokenized(docs)
    n = t.agg((F.count(F.lit(1)) + idf_extra).alias("_n"))
    own = t if only is None else tokenized(docs.join(only.select("doc").distinct(), "doc", "left_semi"))
    tf = own.select("doc", "_len", F.explode("_t").alias("term")).groupBy("doc", "_len", "term").agg(F.count(F.lit(1)).alias("_tf"))
    df = t.select(F.explode(F.array_distinct("_t")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    weight = F.col("_tf") / F.col("_len") * (F.log((F.col("_n") + 1) / (F.col("_df") + 1)) + 1)
    return tf.join(df, "term").join(F.broadcast(n)).select("doc", "term", weight.alias("weight"))


def tfidf_query_similarity(works: DataFrame, queries: DataFrame, pairs: int = 2_000_000, frequent: int = 100_000) -> DataFrame:
    """(query_id, work_id, similarity): cosine of TF-IDF vectors, the query counted as one more document. ``work_id`` is unique.

    As in ``bm25`` works are dealt by work_id once, to so many tasks that works times queries are about ``pairs`` in
    each; terms of a work are counted and summed there. Only the ``frequent`` terms of most works are sent to all
    tasks (10 MB at most): of the others, the rows of each work are joined with their df for its norm.
    """
    n = works.count()  # a number
    said = lambda rows: rows.select("work_id", tokens(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")))).alias("_t"))
    content = lambda rows: rows.where((F.length("term") > 2) & ~F.col("term").isin(STOP_WORDS))
    df = landed(content(said(works).select(F.explode(F.array_distinct("_t")).alias("term"))).groupBy("term").agg(F.count(F.lit(1)).alias("_df")))
    idf = lambda in_query: F.log(F.lit(n + 2) / (F.coalesce("_df", F.lit(0)) + in_query + 1)) + 1
    q = content(queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term"))).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("_qtf"))
    q = q.withColumn("_qlen", F.sum("_qtf").over(Window.partitionBy("query_id")))
    qw = landed(q.join(df, "term", "left").select("query_id", "term", (F.col("_qtf") / F.col("_qlen") * idf(1)).alias("_qw")))
    qnorm = qw.groupBy("query_id").agg(F.sqrt(F.sum(F.col("_qw") ** 2)).alias("_qnorm"))
    counts = Window.orderBy(F.desc("_df"))  # a row for each distinct df
    least = df.groupBy("_df").agg(F.count(F.lit(1)).alias("_k")).withColumn("_k", F.sum("_k").over(counts)).where(F.col("_k") <= frequent).agg(F.min("_df")).first()[0]
    common = F.col("_df") >= least if least is not None else F.lit(False)
    tasks = max(int(works.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * queries.count() // pairs))
    dealt = said(works.select("work_id", "title", "abstract").repartition(tasks, "work_id"))
    tf = content(dealt.select("work_id", F.explode("_t").alias("term"))).groupBy("work_id", "term").agg(F.count(F.lit(1)).alias("_tf"))
    tf = tf.join(F.broadcast(df.where(common)), "term", "left")
    # a work's norm times its length: as if no term were the query's, corrected for the terms that are
    plain, shared = (F.col("_tf") * idf(0)) ** 2, (F.col("_tf") * idf(1)) ** 2
    own = tf.groupBy("work_id").agg(F.sum(F.when(F.col("_df").isNotNull(), plain)).alias("_norm"), F.sum("_tf").alias("_len"))
    rare = tf.where("_df IS NULL").drop("_df").join(df.where(~common), "term").groupBy("work_id").agg(F.sum(plain).alias("_norm"), F.lit(0).cast("long").alias("_len"))
    norms = own.unionByName(rare).groupBy("work_id").agg(F.sum("_norm").alias("_norm"), F.sum("_len").alias("_len"))
    asked = qw.join(df, "term")
    dots = tf.drop("_df").join(asked, "term").groupBy("query_id", "work_id").agg(F.sum(F.col("_qw") * F.col("_tf") * idf(1)).alias("_dot"), F.sum(shared - plain).alias("_more"))
    cosine = F.col("_dot") / (F.sqrt(F.col("_norm") + F.col("_more")) * F.col("_qnorm"))
    return dots.join(landed(norms), "work_id").join(qnorm, "query_id").select("query_id", "work_id", cosine.alias("similarity"))


def pairwise_cosine(vectors: DataFrame, least: float = 0.0) -> DataFrame:
    """(set_id, a, b, cosine), a < b, within each set of documents. ``vectors``: set_id, doc, term, weight."""
    norm = vectors.groupBy("set_id", "doc").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("_n"))
    unit = vectors.join(norm, ["set_id", "doc"]).select("set_id", "doc", "term", (F.col("weight") / F.col("_n")).alias("w"))
    a, b = unit.select("set_id", "term", F.col("doc").alias("a"), F.col("w").alias("wa")), unit.select("set_id", "term", F.col("doc").alias("b"), F.col("w").alias("wb"))
    return a.join(b, ["set_id", "term"]).where("a < b").groupBy("set_id", "a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine")).where(F.col("cosine") >= least)


def drop_similar_titles(ranked: DataFrame, percent: int = 40) -> DataFrame:
    """(query_id, work_id, rank): works of each query whose title resembles none that stays before it in rank order.

    ``ranked``: query_id, work_id, rank, words (distinct title words). Titles resemble each other from a
    Jaccard similarity of ``percent`` on; a title without words stays. Of equal titles only the first can
    stay, so only the first is compared with others; lists of any length are decided in rounds.
    """
    worded = F.size(F.coalesce("words", F.array().cast("array<string>"))) > 0
    same = Window.partitionBy("query_id", "_w").orderBy("rank", "work_id")
    first = ranked.where(worded).withColumn("_w", F.sort_array("words")).withColumn("_r", F.row_number().over(same)).where("_r = 1").select("query_id", "work_id", "rank", "words")
    first = stable(first)
    kept = keep_first(first, similar_sets(first, ["query_id"], "work_id", "words", percent), ["query_id"], "work_id", ["rank"])
    return kept.select("query_id", "work_id", "rank").union(ranked.where(~worded).select("query_id", "work_id", "rank"))


def _usable(vectors: DataFrame, *keys: str) -> DataFrame:
    """Rows whose embedding has finite numbers and is not zero, as _e in double precision."""
    v = vectors.select(*keys, F.col("embedding").cast("array<double>").alias("_e"))
    sound = F.forall("_e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("_e", lambda x: x != 0)
    return v.where(F.coalesce((F.size("_e") > 0) & sound, F.lit(False)))


def _products(group: pa.Table, left: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of the group with ``left``, the others, their cosines to twelve digits), for each length of vector."""
    own = group.column(left).to_numpy(zero_copy_only=False)
    sizes = pc.list_value_length(group.column("_e")).to_numpy()
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        e = np.array(group.column("_e").take(pa.array(at)).to_pylist(), dtype=float)
        e /= np.sqrt((e * e).sum(axis=1))[:, None]
        a, b = at[own[at]], at[~own[at]]
        if len(a) and len(b):
            yield a, b, np.round(e[own[at]] @ e[~own[at]].T, 12)


def vector_knn(vectors: DataFrame, queries: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """(query_id, vec_id, cosine, rank): exact nearest neighbours of a stated set of query vectors, itself excluded.

    ``vectors``: vec_id, embedding; ``queries``: query_id, embedding. Both are dealt by hash to blocks of
    about ``block``, and each block of queries meets each block of vectors in one product, which
    leaves ``k`` neighbours a query; those lists are merged. Cosines count to twelve digits, ties go
    to the smaller vec_id. Vectors that are null, zero or not finite are no neighbours and have none,
    nor do those of other lengths.
    """
    v, q = _usable(vectors, "vec_id"), _usable(queries, "query_id")
    n_v, n_q = (max(1, -(-df.count() // block)) for df in (v, q))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    of = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    rows = v.select("vec_id", "_e", F.lit(False).alias("_asks"), every(n_q).alias("_q"), of("vec_id", n_v).alias("_v"))
    rows = rows.union(q.select("query_id", "_e", F.lit(True), of("query_id", n_q), every(n_v)))

    def nearest(group: pa.Table) -> pa.Table:
        ids, found = group.column("vec_id").to_numpy(), []
        for a, b, cosine in _products(group, "_asks"):
            cosine[ids[a][:, None] == ids[b][None, :]] = -2  # itself
            kth = np.sort(cosine, axis=1)[:, -min(k, len(b))]
            for i, near in enumerate(cosine >= np.maximum(kth, -1.5)[:, None]):
                j = np.flatnonzero(near)
                j = j[np.lexsort((ids[b[j]], -cosine[i, j]))][:k]
                found.append((np.full(len(j), ids[a[i]]), ids[b[j]], cosine[i, j]))
        columns = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, dtype=np.int64)] * 2 + [np.zeros(0)]
        return pa.table({"query_id": columns[0], "vec_id": columns[1], "cosine": columns[2]})

    lists = rows.groupBy("_q", "_v").applyInArrow(nearest, "query_id long, vec_id long, cosine double")
    return top_k(lists, k, "query_id", F.desc("cosine"), F.asc("vec_id"))


def fallback_edges(nodes: DataFrame, edges: DataFrame, least_per_node: float = 2.0, cosine: float = 0.7, block: int = 2048) -> DataFrame:
    """(map_id, a, b, cosine), a < b: nodes of thinly linked maps whose embeddings are close.

    ``nodes``: map_id, work_id, embedding; ``edges``: map_id, from_id, to_id. Only maps with fewer than
    ``least_per_node`` edges a node get any. A map's nodes are dealt to blocks of about ``block``, and each pair of
    blocks is multiplied on its own.
    """
    counts = nodes.groupBy("map_id").agg(F.count(F.lit(1)).alias("_n"))
    linked = edges.groupBy("map_id").agg(F.count(F.lit(1)).alias("_e"))
    thin = counts.join(linked, "map_id", "left").where(F.coalesce("_e", F.lit(0)) < least_per_node * F.col("_n")).select("map_id", F.ceil(F.col("_n") / block).cast("int").alias("_blocks"))
    placed = _usable(nodes, "map_id", "work_id").join(thin, "map_id").withColumn("_own", F.pmod(F.xxhash64("work_id"), F.col("_blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    left = placed.select("map_id", "work_id", "_e", F.lit(True).alias("_left"), F.col("_own").alias("_i"), other.alias("_j"))
    right = placed.select("map_id", "work_id", "_e", F.lit(False), other, "_own")

    def close(group: pa.Table) -> pa.Table:
        ids, maps, found = group.column("work_id").to_numpy(), group.column("map_id"), []
        for a, b, near in _products(group, "_left"):
            i, j = np.nonzero((near >= cosine) & (ids[a][:, None] < ids[b][None, :]))
            found.append((a[i], ids[a[i]], ids[b[j]], near[i, j]))
        columns = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, dtype=np.int64)] * 3 + [np.zeros(0)]
        return pa.table({"map_id": maps.take(pa.array(columns[0])), "a": columns[1], "b": columns[2], "cosine": columns[3]})

    kind = nodes.schema["map_id"].dataType.simpleString()
    return left.union(right).groupBy("map_id", "_i", "_j").applyInArrow(close, f"map_id {kind}, a long, b long, cosine double")
