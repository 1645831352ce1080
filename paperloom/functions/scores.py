"""Column functions that score works."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.phrases import once


def age(year: Column, as_of: int) -> Column:
    """Years since publication, not below 0; 10 for an unknown year."""
    return F.coalesce(F.greatest(F.lit(0.0), (F.lit(as_of) - year).cast("double")), F.lit(10.0))


def recency(years: Column, half_life: float) -> Column:
    """exp(-age / half life); 0 for a null or negative age."""
    return F.when(years >= 0, F.exp(-years / F.lit(half_life if half_life > 0 else 1.0))).otherwise(0.0)


def impact_rate(cites: Column, years: Column, alpha: float = 1.0, beta: float = 2.0, gamma: float = 0.0, base: float | None = None) -> Column:
    """Posterior mean of a Gamma-Poisson citation rate, less gamma deviations, over a base rate, not below 0."""
    exposure = F.greatest(years, F.lit(0.0)) + 1.0 + beta
    c = F.coalesce(cites, F.lit(0)) + alpha
    rate = c / exposure - gamma * F.sqrt(c / (exposure * exposure))
    return F.greatest(F.lit(0.0), rate / base if base and base > 0 else rate)


def topic_relevance(primary: Column, topics: Column, target: Column) -> Column:
    """1 for the primary topic, else the best score of the target among the topics, else 0."""
    best = F.array_max(F.transform(F.filter(topics, lambda t: t["topic_id"] == target), lambda t: t["score"]))
    return F.when(target.isNull() | (target == ""), 0.0).when(primary == target, 1.0).otherwise(F.coalesce(best, F.lit(0.0)))


def best_topic(primary: Column, topics: Column) -> Column:
    """The primary topic, else the one with the best score, ties to the smaller id."""
    best = F.array_sort(F.transform(topics, lambda t: F.struct((-t["score"]).alias("s"), t["topic_id"].alias("topic_id"))))
    return F.coalesce(primary, F.get(best, 0)["topic_id"])


def completeness(*present: Column) -> Column:
    """Share of fields that are there."""
    return sum((p.cast("int") for p in present), F.lit(0)) / len(present)


def impact_score(cites: Column, references: Column, paradigm_shift: Column) -> Column:
    """Log-scaled citations (full at 20,000), references (full at 100) and a flag; three digits, half-even."""
    log_share = lambda x, full: F.least(F.log10(F.greatest(F.coalesce(x, F.lit(0)), F.lit(1)).cast("double")) / F.log10(F.lit(float(full))), F.lit(1.0))
    shift = F.when(paradigm_shift, 1.0).otherwise(0.3)
    with_refs = 0.45 * log_share(cites, 20_000) + 0.10 * log_share(references, 100) + 0.45 * shift
    return F.bround(F.when(references > 0, with_refs).otherwise(0.55 * log_share(cites, 20_000) + 0.45 * shift), 3)


def temporal_score(year: Column, cites: Column, mode: str, as_of: int) -> Column:
    """Preference for old and cited works ('seminal'), new ones ('recent') or none; a null year counts as new."""
    years = F.greatest(F.lit(0), as_of - F.coalesce(year, F.lit(as_of)))
    if mode == "seminal":
        return 0.4 * F.least(F.lit(1.0), years / 20) + 0.6 * F.least(F.lit(1.0), F.coalesce(cites, F.lit(0)) / 1000)
    if mode == "recent":
        return F.when(years <= 2, 1.0).when(years <= 5, 0.8).when(years <= 10, 0.4).otherwise(0.1)
    return F.lit(0.5)


def connectivity_score(neighbours: Column) -> Column:
    """By the number of neighbours in the selected set; a null set (none selected) is neutral."""
    return F.when(neighbours.isNull(), 0.5).when(neighbours == 0, 0.0).when(neighbours == 1, 0.3).when(neighbours <= 3, 0.6).when(neighbours <= 6, 0.8).otherwise(1.0)


def era_label(year: Column, width: Column | int) -> Column:
    """'2003', '2001-2003', '2000-2004' or '2000s' by width; 'Unknown' without a year."""
    width = F.lit(width) if isinstance(width, int) else width
    begin = (year - F.pmod(year, width)).cast("int")
    block = F.concat(begin.cast("string"), F.lit("-"), (begin + width - 1).cast("int").cast("string"))
    return F.when(year.isNull(), "Unknown").when(width == 1, year.cast("string")).when(width == 10, F.concat(begin.cast("string"), F.lit("s"))).otherwise(block)


def star_bucket(score_of_ten: Column) -> Column:
    """One to five stars."""
    s = score_of_ten
    return F.when(s >= 8, 5).when(s >= 6, 4).when(s >= 4, 3).when(s >= 2, 2).otherwise(1)


def reasons(scores: dict[str, tuple[Column, float]]) -> Column:
    """Names of the scores that reach their thresholds."""
    return F.filter(F.array(*(F.when(c >= least, F.lit(name)) for name, (c, least) in scores.items())), lambda x: x.isNotNull())


def term_score(text: Column, terms: Column) -> Column:
    """The best of some forms of a term (an array): 1 if the text has it as it stands, else the share of its words that are words of the text.

    Both sides in lower case with single spaces. Null or blank forms and texts give 0.
    """
    return term_scores(text, [terms])[0]


def term_scores(text: Column, terms: list[Column]) -> Column:
    """The ``term_score`` of each of some terms, as an array; the text is read once for all of them."""
    plain = lambda x: F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[\x09-\x0D ]+", " "))
    words = lambda x: F.array_distinct(F.split(x, " "))

    def best(low: Column) -> Column:
        have = F.struct(low.alias("text"), F.when(low != "", words(low)).alias("words"))
        one = lambda t, form: F.when(form == "", 0.0).when(t["text"].contains(form), 1.0).otherwise(F.size(F.array_intersect(words(form), t["words"])) / F.size(words(form)))
        score = lambda t, forms: F.coalesce(F.when(t["text"] != "", F.array_max(F.transform(F.transform(forms, plain), lambda form: one(t, form)))), F.lit(0.0))
        return once(have, lambda t: F.array(*(score(t, forms) for forms in terms)))

    return once(plain(text), best)


def gap_confidence(detection: Column, status: Column, coverage: Column, sources: Column) -> Column:
    """Up to 0.6 by detection; an open gap gains, a partly covered one by what is left, an addressed one loses most."""
    base = F.least(detection * 0.6, F.lit(0.6))
    covered = F.coalesce(coverage.cast("double"), F.when(F.coalesce(sources, F.lit(0)) == 0, 10.0).when(sources <= 2, 30.0).when(sources <= 4, 50.0).otherwise(70.0))
    covered = F.greatest(F.lit(0.0), F.least(F.lit(100.0), covered))
    value = F.when(status == "open", base + 0.30).when(status == "partial", base + 0.25 * (1.0 - covered / 100.0)).otherwise(base * 0.2)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def access_tier(is_open: Column, pdf_url: Column, doi: Column, proxy: Column) -> Column:
    """(access_status, source) of the first rule that holds."""
    told = lambda status, source: F.struct(status.alias("access_status"), F.lit(source).cast("string").alias("source"))
    closed = F.when(~is_open, "closed").otherwise("unknown")
    return (
        F.when((pdf_url != "") & is_open, told(F.lit("open"), "oa_direct"))
        .when((doi != "") & (proxy != ""), told(F.lit("closed"), "proxy"))
        .when(doi != "", told(closed, "doi"))
        .otherwise(told(F.lit("unknown"), None))
    )


def relevance_by_scope(title: Column, abstract: Column, topic: Column, domain: Column, aspect: Column, scope: str, intent: str = "single_topic") -> Column:
    """Relevance to arrays of topic, domain and aspect terms, by what of them the text has."""
    title = F.lower(F.coalesce(title, F.lit("")))
    text = F.concat(title, F.lit(" "), F.lower(F.coalesce(abstract, F.lit(""))))
    has = lambda where, terms: F.exists(terms, lambda t: (t != "") & where.contains(F.lower(t)))
    t, d, method = has(text, topic), has(text, domain), intent == "method_in_domain"
    if scope == "intersection":
        base = F.when(t & d, 0.9 if method else 0.8)
        base = base.when(d, 0.5).when(t, 0.3).otherwise(0.1) if method else base.when(t | d, 0.4).otherwise(0.1)
    elif scope in ("topic_focused", "domain_focused"):
        first, second = (t, d) if scope == "topic_focused" else (d, t)
        base = F.when(first, 0.8).when(second, 0.3).otherwise(0.1)
    else:
        base = F.when(t | d, 0.7).otherwise(0.1)
    base = F.when(has(text, aspect), F.least(F.lit(1.0), base + 0.15)).otherwise(base)
    return F.when(has(title, topic) & has(title, domain), F.least(F.lit(1.0), base + 0.1)).otherwise(base)
