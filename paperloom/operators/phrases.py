"""A dictionary of phrases that grows, met with texts by their word n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import tokens


def word_grams(words: Column, n: int) -> Column:
    """The different runs of ``n`` words with the place (from 0) of the first of each."""
    starts = F.sequence(F.lit(0), F.size(words) - n)
    runs = F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, n), " "))
    return F.when(F.size(words) >= n, runs)


def phrase_hits(texts: DataFrame, phrases: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, phrase, label, n_words, place): the phrases that stand in a text as whole words, with the first place of each.

    ``phrases``: phrase and label; phrases are tokenised as texts are, those without a word go. Only
    n-grams as long as some phrase are made, and met with the dictionary by a join that suits its size
    before anything is grouped, so that only hits are exchanged where the dictionary is small; it may have
    millions of entries. Null texts have no hits; a phrase with
    several labels gives a row for each, a key that occurs more than once the hits of all its texts.
    """
    known = phrases.withColumn("_w", tokens(F.col("phrase"))).where(F.size("_w") > 0)
    known = known.select(F.array_join("_w", " ").alias("phrase"), "label", F.size("_w").alias("n_words")).distinct()
    lengths = sorted(r["n_words"] for r in known.select("n_words").distinct().collect())  # the lengths of phrases, not the phrases
    words = texts.select(key, tokens(F.col(text)).alias("_w"))
    rows = None
    for n in lengths:
        part = words.select(key, F.posexplode(word_grams(F.col("_w"), n)).alias("place", "phrase"))
        rows = part if rows is None else rows.union(part)
    if rows is None:
        rows = words.select(key, F.lit(0).alias("place"), F.lit("").alias("phrase")).limit(0)
    first = rows.join(known, "phrase").groupBy(key, "phrase", "label", "n_words").agg(F.min("place").alias("place"))
    return first.select(key, "phrase", "label", "n_words", "place")


def choose_label(hits: DataFrame, key: str, rule: str) -> DataFrame:
    """One hit of each key: the ``longest`` phrase (in words, then letters), or the one that comes ``first``; ties by phrase and label."""
    longest = [F.desc("n_words"), F.desc(F.length("phrase"))]
    order = {"longest": [*longest, "place"], "first": ["place", *longest]}[rule]
    return hits.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order, "phrase", "label"))).where("_r = 1").drop("_r")
