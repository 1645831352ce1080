"""Column functions on identifiers, titles and free text."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions.phrases import once

TOKEN = r"[\p{L}\p{N}_]+"
SPACED = r"[^\x09-\x0D ]+"

# Words that carry no topic, for TF-IDF tokens.
STOP_WORDS = """
a an the and or but in on at to for of with by from is are was were be been being have has had do does did will would could
should may might must can this that these those it its as if then than so such no not only own same into over under again
further once here there when where why how all each few more most other some any both during before after above below between
through about against up down out off which who whom what we our you your he she they their i me my his her him them us
""".split()
# Filler in titles, for near-duplicate titles.
TITLE_STOP_WORDS = "a an the of for in on to and or with using based via towards from by".split()

# Words of titles that tell nothing of a topic, where a title is looked for in an abstract.
OVERLAP_STOP_WORDS = """
a an the in of and or to for with on by from as at is are was were be its their this that via using based new we our paper propose
proposed method approach results show study also can may use used two one first which these each both such than more most well has
have been not but they it will would could should do does did had being over into
""".split()
# Frequent words of English and of Spanish.
ENGLISH_WORDS = """
the and of to in is that for it with as are on we this by from which an be have has can our their or not but more these such been
also its may than between show propose method results paper approach model
"""
SPANISH_WORDS = "de la el en que y los se del las un por con para una es al lo como su más pero sus le ya este entre cuando"


def tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores, lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def spaced_tokens(text: Column) -> Column:
    """What white space separates, lower case: the BM25 tokens."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(SPACED), F.lit(0))


def content_tokens(text: Column) -> Column:
    """Tokens longer than two letters that are no stop words: the TF-IDF tokens."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.filter(tokens(text), lambda t: (F.length(t) > 2) & ~F.array_contains(stop, t))


def title_words(title: Column) -> Column:
    """Distinct content words of a title."""
    stop = F.array(*map(F.lit, TITLE_STOP_WORDS))
    bare = F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[^\p{L}\p{N}_\x09-\x0D ]", "")
    return F.array_distinct(F.filter(F.regexp_extract_all(bare, F.lit(SPACED), F.lit(0)), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all members of two arrays without repeats; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def hashed(words: Column) -> Column:
    """Words as 64-bit hashes, by which arrays are compared faster and are smaller to exchange."""
    return F.transform(words, lambda w: F.xxhash64(w))


def keywords(text: Column, letters: int = 3) -> Column:
    """Distinct runs of at least ``letters`` of a to z, in order of first sight."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"[a-z]{{{letters},}}"), F.lit(0)))


def keyword_overlap(query: Column, text: Column) -> Column:
    """Share of the query's keywords that the text has; 1 if the query has none."""
    q = keywords(query)
    return F.when(F.size(q) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(q, keywords(text))) / F.size(q))


def search_terms(text: Column, most: int = 8) -> Column:
    """First ``most`` distinct words of four letters or more that are no stop words."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.slice(F.filter(keywords(text, 4), lambda w: ~F.array_contains(stop, w)), 1, most)


def normalize_doi(doi: Column) -> Column:
    """Lower case, trimmed, without one leading resolver prefix; empty is null."""
    bare = F.regexp_replace(F.lower(F.trim(doi)), r"^(https://doi\.org/|http://doi\.org/|doi\.org/|doi:)", "")
    return F.when(bare != "", bare)


def normalize_arxiv_id(arxiv_id: Column) -> Column:
    """Without address, prefix, version and file ending."""
    x = F.trim(arxiv_id)
    x = F.regexp_replace(x, r"(?i)https?://arxiv\.org/(abs|pdf)/", "")
    x = F.regexp_replace(x, r"(?i)^arxiv:", "")
    x = F.regexp_replace(x, r"v[0-9]+$", "")
    return F.trim(F.regexp_replace(x, r"(?i)\.pdf$", ""))


@F.arrow_udf(T.StringType())
def decomposed(text: pa.Array) -> pa.Array:
    """The compatibility decomposition (NFKD) of texts, whole Arrow batches at a time; nulls stay."""
    return pc.utf8_normalize(text, form="NFKD")


def normalize_title(title: Column) -> Column:
    """Lower case, punctuation to spaces, version and preprint endings off, single spaces.

    Accents stay as they are written; of ``decomposed`` titles they part the word, as they do where
    titles of several sources are compared.
    """
    x = F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[^\p{L}\p{N}_\x09-\x0D ]", " ")
    for ending in (r"[\x09-\x0D ]+v[0-9]+$", r"[\x09-\x0D ]+version[\x09-\x0D ]+[0-9]+$", r"[\x09-\x0D ]+arxiv$", r"[\x09-\x0D ]+preprint$"):
        x = F.regexp_replace(x, ending, "")
    return F.trim(F.regexp_replace(x, r"[\x09-\x0D ]+", " "))


def arxiv_id_in(text: Column) -> Column:
    """The first arXiv id in an address or a text, by the first kind of mention that it has; null without one."""
    kinds = (r"arxiv\.org/abs/([0-9]+\.[0-9]+)", r"arxiv\.org/pdf/([0-9]+\.[0-9]+)", r"arxiv:([0-9]+\.[0-9]+)", r"([0-9]{4}\.[0-9]{4,5})", r"([a-z-]+/[0-9]+)")
    return F.coalesce(*(F.nullif(normalize_arxiv_id(F.regexp_extract(text, f"(?i){kind}", 1)), F.lit("")) for kind in kinds))


def doi_in(text: Column) -> Column:
    """The first DOI in an address or a text; null without one."""
    return normalize_doi(F.regexp_extract(text, r"(10\.[0-9]{4,}/[^\x09-\x0D ]+)", 1))


def english_or_other(text: Column) -> Column:
    """'other' where Spanish words prevail, 'en' with five English ones, else null; texts below 50 characters are not judged."""

    def judged(words: Column) -> Column:
        english, spanish = (F.size(F.array_intersect(words, F.array(*map(F.lit, own.split())))) for own in (ENGLISH_WORDS, SPANISH_WORDS))
        return F.when((spanish > english * 1.5) & (spanish >= 3), "other").when(english >= 5, "en")

    return F.when(F.length(text) >= 50, once(F.array_distinct(tokens(text)), judged))


def words_of(normalized: Column) -> Column:
    """Distinct words of a normalized title."""
    return F.array_distinct(F.filter(F.split(normalized, " "), lambda w: w != ""))


def title_similarity(a: Column, b: Column, words_only: bool = False) -> Column:
    """Larger of the Jaccard similarities of words and of characters of two normalized titles."""
    words = words_of
    chars = lambda t: F.array_distinct(F.filter(F.split(F.replace(t, F.lit(" "), F.lit("")), ""), lambda c: c != ""))
    sim = jaccard(words(a), words(b)) if words_only else F.greatest(jaccard(words(a), words(b)), jaccard(chars(a), chars(b)))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(sim)


def entity_match(source: dict[str, Column], other: dict[str, Column], strict: bool = True, normalized: bool = False) -> Column:
    """(match, confidence, reason): identifiers first, then title and year.

    Both sides have doi, arxiv_id, title and year; titles normalized, and identifiers too if ``normalized`` says so
    (then no pair pays for them).
    """
    told = lambda match, confidence, reason: F.struct(F.lit(match).alias("match"), (confidence if isinstance(confidence, Column) else F.lit(float(confidence))).alias("confidence"), F.lit(reason).alias("reason"))
    doi, arxiv = ((lambda x: x), (lambda x: x)) if normalized else (normalize_doi, normalize_arxiv_id)
    doi_a, doi_b, id_a, id_b = doi(source["doi"]), doi(other["doi"]), arxiv(source["arxiv_id"]), arxiv(other["arxiv_id"])
    sim = title_similarity(source["title"], other["title"])
    apart = F.abs(source["year"] - other["year"])
    ladder = (
        F.when(doi_a.isNotNull() & doi_b.isNotNull(), F.when(doi_a == doi_b, told(True, 1.0, "doi")).otherwise(told(False, 0.0, "doi mismatch")))
        .when((id_a == id_b) & (id_a != ""), told(True, 0.98, "arxiv id"))
        .when((sim >= 0.90) & (apart == 0), told(True, 0.95, "title and year"))
        .when((sim >= 0.85) & (apart <= 1), told(True, 0.88, "title and close year"))
    )
    if strict:
        return ladder.when((sim >= 0.80) & (apart == 0), told(True, 0.80, "strict title and year")).otherwise(told(False, sim, "insufficient"))
    return ladder.when(sim >= 0.85, told(True, 0.75, "title alone")).otherwise(told(False, sim, "no match"))


def truncate_at_word(text: Column, most: int) -> Column:
    """At most ``most`` characters, cut back to the last space, with an ellipsis if cut."""
    head = F.substring(text, 1, most)
    back = F.regexp_replace(head, r" [^ ]*$", "")
    return F.when(F.length(text) <= most, text).otherwise(F.concat(back, F.lit("...")))


def params_hash(*columns: Column) -> Column:
    """Stable key of some parameters; nulls count as empty."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)), 256)


def text_from_inverted_index(index: Column) -> Column:
    """Text of a map word -> positions; of two words at one place the first in order wins."""
    placed = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    once = lambda o: F.filter(o, lambda x, i: (i == 0) | (x["p"] != F.get(o, i - 1)["p"]))
    first = F.get(F.transform(F.array(F.array_sort(placed)), once), 0)  # sorted once, then bound to a name
    return F.array_join(F.transform(first, lambda x: x["w"]), " ")


def language_guess(text: Column, words: dict[str, list[str]]) -> Column:
    """The language most of whose frequent words the text has; ties to the first, none to 'unknown'."""
    have = F.array_distinct(tokens(text))
    hits = [F.struct(F.size(F.array_intersect(have, F.array(*map(F.lit, own)))).alias("n"), F.lit(-i).alias("o"), F.lit(lang).alias("lang")) for i, (lang, own) in enumerate(words.items())]
    best = F.greatest(*hits)
    return F.when(best["n"] > 0, best["lang"]).otherwise("unknown")


def first_match(text: Column, rules: list[tuple[str, str]], otherwise: str | None = None) -> Column:
    """Label of the first rule whose pattern the text has."""
    out = None
    for pattern, label in rules:
        out = F.when(text.rlike(pattern), label) if out is None else out.when(text.rlike(pattern), label)
    return out.otherwise(otherwise) if otherwise is not None else out


def section(text: Column, header: str, following: str, most: int) -> Column:
    """Up to ``most`` characters after a header line, as far as the next header; null without it."""
    found = F.regexp_extract(text, rf"(?is)(?:^|\n)[0-9. ]*(?:{header})[: ]*\n(.*?)(?=\n[0-9. ]*(?:{following})[: ]*\n|$)", 1)
    return F.when(found != "", F.substring(F.trim(found), 1, most))
