"""Fixed phrases in a text, all of them in one pass: counts, first and longest matches over rule tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def trie_pattern(phrases: Iterable[str]) -> str:
    """A regular expression for the longest of the phrases at a place; phrases that begin alike share their branch."""
    trie: dict = {}
    for phrase in phrases:
        node = trie
        for c in phrase:
            node = node.setdefault(c, {})
        node[""] = {}

    def written(node: dict) -> str:
        branches = [("\\" + c if c in r"\.^$|?*+()[]{}" else c) + written(rest) for c, rest in sorted(node.items()) if c]
        if not branches:
            return ""
        alone = len(branches) == 1 and "" not in node
        return branches[0] if alone else f"(?:{'|'.join(branches)}){'?' if '' in node else ''}"

    return written(trie)


class Phrases:
    """A table of phrases, each with a label; phrases are lower case and count wherever they stand, within words too.

    A look-ahead at each place of the text finds the longest phrase that begins there; the shorter ones
    that begin at the same place are its beginnings, known from the table. So one pass finds every
    phrase, overlapping ones included, however many there are.
    """

    def __init__(self, rules: Iterable[tuple[str, Iterable[str]]]):
        self.rules = [(label, tuple(phrases)) for label, phrases in rules]
        self.labels = {p: label for label, phrases in reversed(self.rules) for p in phrases}
        self.pattern = f"(?=({trie_pattern(self.labels)}))"
        self.within = {p: [q for q in self.labels if q != p and p.startswith(q)] for p in self.labels}

    def found(self, text: Column) -> Column:
        """The different phrases of a text (null: none)."""
        hits = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(self.pattern), F.lit(1))
        inner = {p: q for p, q in self.within.items() if q}
        if not inner:
            return F.array_distinct(hits)
        shorter = F.create_map(*(x for p, q in inner.items() for x in (F.lit(p), F.array(*map(F.lit, q)))))
        more = F.flatten(F.transform(F.array_distinct(hits), lambda p: F.coalesce(F.element_at(shorter, p), F.array().cast("array<string>"))))
        return F.array_union(hits, more)

    def counts(self, text: Column) -> Column:
        """A struct with the number of different phrases of each label that the text has."""
        return once(self.found(text), lambda found: F.struct(*(F.size(F.array_intersect(found, F.array(*map(F.lit, phrases)))).alias(label) for label, phrases in self.rules)))

    def first(self, text: Column) -> Column:
        """The label of the first rule of which the text has a phrase; null without any."""

        def ladder(found: Column) -> Column:
            out = None
            for label, phrases in self.rules:
                hit = F.arrays_overlap(found, F.array(*map(F.lit, phrases)))
                out = F.when(hit, label) if out is None else out.when(hit, label)
            return out

        return once(self.found(text), ladder)

    def longest(self, text: Column) -> Column:
        """The label of the longest phrase that the text has, ties by label; null without any."""
        label = F.create_map(*(F.lit(x) for pair in self.labels.items() for x in pair))
        return F.array_min(F.transform(self.found(text), lambda p: F.struct((-F.length(p)).alias("n"), F.element_at(label, p).alias("label"))))["label"]


def once(value: Column, use) -> Column:  # noqa: ANN001
    """``use`` of a value that is computed once, whatever often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), 0)
