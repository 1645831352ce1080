"""Raw JSON records of several sources as one works table, and what can't be read as a table of rejects."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import normalize_arxiv_id, normalize_doi, text_from_inverted_index

CORRUPT = "_corrupt"
COLUMNS = ("work_id", "title", "year", "cited_by_count", "authors", "venue", "is_retracted", "abstract", "doi", "arxiv_id", "pdf_url", "source")

# The fields that each kind of source has.
SHAPES = {
    "catalog": "id string, title string, publication_year int, cited_by_count int, authorships array<struct<author struct<display_name string>>>, primary_location struct<source struct<display_name string>, pdf_url string>, is_retracted boolean, doi string, abstract_inverted_index map<string, array<int>>",
    "preprints": "arxiv_id string, title string, year int, citations int, authors array<string>, venue string, abstract string",
    "graph": "s2_id string, title string, year int, citations int, venue string, abstract string, doi string, arxiv_id string, s2_pdf_url string",
    "registry": "DOI string, title array<string>, published struct<`date-parts` array<array<int>>>, `is-referenced-by-count` int, author array<struct<given string, family string>>, `container-title` array<string>, abstract string",
}


def _plain(title: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(title, r"[\x09-\x0D ]+", " ")), F.lit(""))


def _catalog(r: Callable[[str], Column]) -> dict[str, Column]:
    return {
        "work_id": F.nullif(F.regexp_extract(r("id"), "(W[0-9]+)$", 1), F.lit("")), "title": r("title"), "year": r("publication_year"), "cited_by_count": r("cited_by_count"),
        "authors": F.transform(r("authorships"), lambda a: a["author"]["display_name"]), "venue": r("primary_location.source.display_name"), "is_retracted": r("is_retracted"),
        "abstract": text_from_inverted_index(r("abstract_inverted_index")), "doi": normalize_doi(r("doi")), "pdf_url": r("primary_location.pdf_url"),
    }


def _preprints(r: Callable[[str], Column]) -> dict[str, Column]:
    arxiv = F.nullif(normalize_arxiv_id(r("arxiv_id")), F.lit(""))
    return {
        "work_id": F.concat(F.lit("AX:"), arxiv), "title": r("title"), "year": r("year"), "cited_by_count": r("citations"), "authors": r("authors"), "venue": F.coalesce(F.nullif(r("venue"), F.lit("")), F.lit("arXiv")),
        "abstract": r("abstract"), "arxiv_id": arxiv,
    }


def _graph(r: Callable[[str], Column]) -> dict[str, Column]:
    arxiv = F.nullif(normalize_arxiv_id(r("arxiv_id")), F.lit(""))
    built = F.concat(F.lit("https://arxiv.org/pdf/"), arxiv, F.lit(".pdf"))
    return {
        "work_id": F.concat(F.lit("S2:"), F.nullif(F.substring(r("s2_id"), 1, 20), F.lit(""))), "title": r("title"), "year": r("year"), "cited_by_count": r("citations"), "venue": r("venue"),
        "abstract": r("abstract"), "doi": normalize_doi(r("doi")), "arxiv_id": arxiv, "pdf_url": F.coalesce(r("s2_pdf_url"), built),
    }


def _registry(r: Callable[[str], Column]) -> dict[str, Column]:
    doi = normalize_doi(r("DOI"))
    return {
        "work_id": F.concat(F.lit("DOI:"), doi), "title": F.get(r("title"), 0), "year": F.get(F.get(r("published.date-parts"), 0), 0), "cited_by_count": r("is-referenced-by-count"),
        "authors": F.transform(r("author"), lambda a: F.concat_ws(" ", a["given"], a["family"])), "venue": F.get(r("container-title"), 0), "abstract": r("abstract"), "doi": doi,
    }


READERS = {"catalog": _catalog, "preprints": _preprints, "graph": _graph, "registry": _registry}
EMPTY = {"year": "int", "cited_by_count": "int", "authors": "array<string>", "is_retracted": "boolean"}


def read_records(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(works, rejects) of raw records.

    ``raw``: source (a key of ``SHAPES``) and record, a JSON object as text. Each source has its reader;
    fields that it lacks are null, citations 0, authors an empty list, retraction false. A record is
    rejected, with its source and a reason, if the source is unknown, if it is no object of the source's shape (a field of
    another type included), or if it has no id. Fields beyond the shape are ignored; repeats stay.
    """
    works, rejects = [], []
    known = F.col("source").isin(*SHAPES)
    rejects.append(raw.where(~F.coalesce(known, F.lit(False))).select("source", "record", F.lit("unknown source").alias("reason")))
    for source, shape in SHAPES.items():
        options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
        parsed = raw.where(F.col("source") == source).select("record", F.from_json("record", f"{shape}, {CORRUPT} string", options).alias("r"))
        field = lambda name: reduce(lambda c, part: c.getField(part), name.split("."), F.col("r"))
        columns = READERS[source](field)
        rows = [F.lit(source).alias(c) if c == "source" else columns.get(c, F.lit(None)).cast(EMPTY.get(c, "string")).alias(c) for c in COLUMNS]
        read = parsed.select("record", (F.col("r").isNull() | F.col(f"r.{CORRUPT}").isNotNull()).alias("_bad"), *rows)
        reason = F.when(F.col("_bad"), "malformed").when(F.col("work_id").isNull(), "no id")
        rejects.append(read.select("source", "record", reason.alias("reason")).where("reason IS NOT NULL"))
        works.append(read.where(reason.isNull()).drop("record", "_bad"))
    table = reduce(DataFrame.unionByName, works)
    table = table.withColumns({"title": _plain(F.col("title")), "cited_by_count": F.coalesce("cited_by_count", F.lit(0)), "authors": F.coalesce("authors", F.array().cast("array<string>")), "is_retracted": F.coalesce("is_retracted", F.lit(False))})
    return table, reduce(DataFrame.unionByName, rejects)
