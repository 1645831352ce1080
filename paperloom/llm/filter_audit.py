"""Filter interaction audit: what each filter removes in every order in which a set of filters can run.

Every filter leaves a table of the ids of the rows that fail it, whatever the other filters do. Who is
left before a filter depends only on which filters came before it, not on their order: so an id that
fails a filter is set before each subset of the others, and one left-anti join with the id tables of
that subset's filters says whether the filter is the one that removes it; the left-semi join says that
it was removed already. Ids are shuffled once and set before the subsets after that.
"""

from __future__ import annotations

import math
import uuid
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.mixing import WORD
from paperloom.tables import landed, shared_folder, stable

MARKED = "[#$%&*|]"


def text_rules(text: Column) -> dict[str, Column]:
    """Which texts fail: A too few words, B too few different ones, C too many capitals, D marks."""
    words, length = F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.length(text)
    small = F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * (length - small) > 5 * length,
        "D": text.rlike(MARKED),
    }


def judged_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, A, B, C, D, E, good and toxic for every document: see ``text_rules``; E: a smaller doc_id has the same text.

    A null text is an empty one, so both are copies of each other; texts are equal where their SHA-256
    is. A null doc_id is not smaller than another, nor larger. A document with several rows of labels is
    good, or toxic, if one of them says so. Repeated rows each give a row.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rules = text_rules(text)
    narrow = stable(docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("_sha"), *(c.alias(name) for name, c in rules.items())))
    copies = narrow.groupBy("_sha").agg(F.min("doc_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("_sha").alias("_same"), "_first")
    known = labels.groupBy(F.col("doc_id").alias("_doc")).agg(*(F.max((F.col(c) == 1).cast("int")).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))))
    found = narrow.join(copies, F.col("_sha") == F.col("_same"), "left").join(known, F.col("doc_id") == F.col("_doc"), "left")
    later = F.coalesce(F.col("doc_id") > F.col("_first"), F.lit(False))
    return found.select("part", *rules, later.alias("E"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")))


def id_tables(rows: DataFrame, filters: list[str], losses: list[str]) -> DataFrame:
    """(_id, part, the losses, filter) of the rows that fail; a folder for the number of each filter."""
    folder = f"{shared_folder(rows.sparkSession)}/{uuid.uuid4().hex}.failing"
    failing = F.explode(F.filter(F.array(*(F.when(F.col(f), i) for i, f in enumerate(filters))), lambda x: x.isNotNull())).alias("filter")
    rows.select("_id", "part", *losses, failing).write.partitionBy("filter").parquet(folder)
    kinds = dict(rows.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in ("_id", "part", *losses)] + ["filter int"])
    return rows.sparkSession.read.schema(schema).parquet(folder)


def filter_audit(rows: DataFrame, filters: list[str], losses: list[str]) -> DataFrame:
    """What each filter does at each step of every order of ``filters``, by part.

    ``rows``: a row for each document with ``part`` (string), a boolean column for each of ``filters``
    (true: fails; null: passes) and a 0/1 column for each of ``losses``. Returns part, filter_order,
    step (from 1), kept (after the step), removed, redundant (failing the step's filter, removed
    before), unique_fails (failing no other), <loss>_lost (removed here with that mark) and shapley
    (what the filter removes, summed over all orders). Every part has a row for each order and step,
    zeros included; a null part counts as ''. An empty table gives no rows. Orders grow with the
    factorial of the number of filters: six have 4,320 rows a part.
    """
    n = len(filters)
    kept_columns = [F.coalesce("part", F.lit("")).alias("part"), *(F.coalesce(f, F.lit(False)).alias(f) for f in filters), *losses]
    rows = landed(rows.select(F.monotonically_increasing_id().alias("_id"), *kept_columns))
    fails = id_tables(rows, filters, losses).repartition("_id")
    bit = F.expr("shiftleft(1, filter)")
    earlier = fails.select(F.col("_id").alias("_other"), bit.alias("_bit"))
    subsets = F.sequence(F.lit(0), F.lit(2**n - 1))

    set_before = fails.withColumn("before", F.explode(F.filter(subsets, lambda s: s.bitwiseAND(bit) == 0)))
    caught = (F.col("_id") == F.col("_other")) & (F.col("before").bitwiseAND(F.col("_bit")) != 0)
    cell = ["part", "filter", "before"]
    removed = set_before.join(earlier, caught, "left_anti").groupBy(*cell).agg(F.count(F.lit(1)).alias("removed"), *(F.sum(c).alias(f"{c}_lost") for c in losses))
    redundant = set_before.join(earlier, caught, "left_semi").groupBy(*cell).agg(F.count(F.lit(1)).alias("redundant"))

    one = F.col("_id") == F.col("_other")
    ids = rows.select("_id", "part").repartition("_id")
    never = ids.join(earlier, one, "left_anti").groupBy("part").agg(F.count(F.lit(1)).alias("never"))
    touched = ids.join(earlier, one, "left_semi").withColumn("before", F.explode(subsets))
    survivors = touched.join(earlier, caught, "left_anti").groupBy("part", F.col("before").alias("upto")).agg(F.count(F.lit(1)).alias("left"))

    orders = [("".join(filters[i] for i in order), k + 1, f, sum(1 << i for i in order[:k])) for order in permutations(range(n)) for k, f in enumerate(order)]
    cells = sorted({(f, before) for _, _, f, before in orders})
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("filter"), F.lit(s).alias("before"), F.lit(math.factorial(k := s.bit_count()) * math.factorial(n - 1 - k)).alias("ways")) for f, s in cells)))
    table = rows.select("part").distinct().withColumn("_c", each).select("part", "_c.*").withColumn("upto", F.col("before").bitwiseOR(bit))
    table = table.join(removed, cell, "left").join(redundant, cell, "left").join(survivors, ["part", "upto"], "left").join(never, "part", "left")
    numbers = ["removed", "redundant", *(f"{c}_lost" for c in losses), "left", "never"]
    table = table.fillna(0, numbers)
    of_filter = Window.partitionBy("part", "filter")
    alone = F.col("before") == F.lit(2**n - 1) - bit
    table = stable(table.withColumn("unique_fails", F.max(F.when(alone, F.col("removed"))).over(of_filter)).withColumn("shapley", F.sum(F.col("removed") * F.col("ways")).over(of_filter)))
    steps = rows.sparkSession.createDataFrame(orders, "filter_order string, step int, filter int, before int")
    out = table.join(F.broadcast(steps), ["filter", "before"])  # n x n! rows, by the parameter
    longs = [(F.col("left") + F.col("never")).alias("kept"), *(F.col(c) for c in numbers[:2]), F.col("unique_fails"), *(F.col(f"{c}_lost") for c in losses), F.col("shapley")]
    return out.select("part", "filter_order", "step", *(c.cast("long") for c in longs))


OP12_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), known AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), judged AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (CASE WHEN len(w) < 50 THEN 1 ELSE 0 END)
       + (CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END)
       + (CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) THEN 4 ELSE 0 END)
       + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
       + (CASE WHEN coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) THEN 16 ELSE 0 END) AS mask
  FROM words LEFT JOIN known USING (doc_id)
), masks AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY ALL
), filters AS (
  SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) f(letter, bit)
), orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM filters a, filters b, filters c, filters d, filters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
  SELECT filter_order, step::INT AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::BIGINT AS before FROM orders, generate_series(1, 5) s(step)
), counted AS (
  SELECT part, filter_order, step, bit,
         coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (mask & bit != 0 AND mask & before = 0), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (mask & bit != 0 AND mask & before != 0), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (mask & bit != 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (mask & bit != 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
  FROM masks, steps GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM counted
"""
