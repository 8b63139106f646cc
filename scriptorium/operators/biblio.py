"""Bibliographies: sections, entries, citation keys and who is cited most.

Everything up to the two roll-ups happens within a row, without a shuffle; the roll-ups count distinct documents
with partial aggregation, so that a frequent key is reduced before it moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scriptorium.functions import text as T
from scriptorium.operators.numbered import numbered

# Headings, and the patterns by which entries are split and parsed.
REFERENCE_HEADINGS = "references|bibliography|works cited|literature cited|reference list"
STOP_HEADINGS = "index|appendix|acknowledg(?:e)?ments|notes|about the author"
AUTHOR_DATE_START = r"\n(?=[A-Z][A-Za-zÀ-ſ'\-]+,[\s\x1c-\x1f])"
NUMBERED_START = r"\n(?=\[\d{1,4}\][\s\x1c-\x1f]|\d{1,4}\.[\s\x1c-\x1f])"
YEAR_IN_PARENTHESES = r"\((\d{4}[a-z]?)\)"
BARE_YEAR = r"\b(?:19|20)\d{2}[a-z]?\b"
SURNAME_FIRST = r"\A([A-Z][A-Za-zÀ-ſ'\-]+)"
INITIALS_FIRST = r"\A(?:[A-Z]\.[\s\x1c-\x1f]*){1,3}([A-Z][A-Za-zÀ-ſ'\-]+)"
ANY_CAPITALISED = r"\b([A-Z][A-Za-zÀ-ſ'\-]{2,})\b"
LEADING_NUMBER = r"\A(?:\[\d{1,4}\]|\d{1,4}\.)[\s\x1c-\x1f]*"

#: Entries in author-date style are believed if there are so many, and so short on average.
LEAST_ENTRIES, LONGEST_MEAN = 3, 600
#: Characters of an entry that are kept.
KEPT = 300

#: Entries whose author and year were found.
PARSED = "surname IS NOT NULL AND surname <> '' AND year IS NOT NULL AND year <> ''"


def bibliography_text(pages: Column) -> Column:
    """The text under every reference heading up to the next such heading, a stop heading or the end; else empty."""
    text = F.concat(F.lit("\n"), T.join_pages(pages))
    # one class, taken whole: a group with alternatives would recurse once a character
    blank = r"[[^\S\n]\x1c-\x1f]*+"
    line = rf"\n{blank}(?:%s){blank}(?=\n|\z)"
    section = rf"(?siU){line % REFERENCE_HEADINGS}(.*?)(?={line % f'(?:{REFERENCE_HEADINGS}|{STOP_HEADINGS})'}|\z)"
    spans = F.transform(F.regexp_extract_all(text, F.lit(section), F.lit(1)), lambda s: F.substring(s, 2, 2**31 - 1))
    return F.array_join(spans, "\n")


def split_entries(text: Column) -> Column:
    """struct(style_guess, entries): author-date entries if they look right, else numbered ones, else author-date."""
    clean = T.close_hyphens(text)

    def parts(pattern: str) -> Column:
        return F.filter(F.transform(F.split(clean, f"(?U){pattern}", -1), T.strip), lambda e: e != "")

    dated, numbered = parts(AUTHOR_DATE_START), parts(NUMBERED_START)
    believed = (F.size(dated) >= LEAST_ENTRIES) & (F.length(clean) / F.greatest(F.size(dated), F.lit(1)) < LONGEST_MEAN)
    use_numbered = ~believed & (F.size(numbered) >= LEAST_ENTRIES)
    return F.struct(F.when(use_numbered, F.lit("numbered")).otherwise(F.lit("author_date")).alias("style_guess"), F.when(use_numbered, numbered).otherwise(dated).alias("entries"))


def citation_key(entry: Column) -> Column:
    """struct(surname, year) of an entry, null fields where it can't be parsed."""
    text = T.strip(F.regexp_replace(T.collapse(entry), f"(?U){LEADING_NUMBER}", ""))
    # the author stands before the first year in parentheses, or else before the first bare year
    in_parentheses = text.rlike(f"(?U){YEAR_IN_PARENTHESES}")
    year = F.when(in_parentheses, F.regexp_extract(text, f"(?U){YEAR_IN_PARENTHESES}", 1)).otherwise(T.first_match(text, f"(?U){BARE_YEAR}", 0))
    before = F.when(in_parentheses, F.regexp_extract(text, rf"(?sU)\A(.*?){YEAR_IN_PARENTHESES}", 1)).otherwise(F.regexp_extract(text, rf"(?sU)\A(.*?){BARE_YEAR}", 1))
    surname = F.coalesce(*(T.first_match(before, f"(?U){p}") for p in (SURNAME_FIRST, INITIALS_FIRST, ANY_CAPITALISED)))
    parsed = year.isNotNull() & surname.isNotNull()
    return F.struct(F.when(parsed, surname).alias("surname"), F.when(parsed, year).alias("year"))


def entries(documents: DataFrame, path: str = "path", pages: str = "pages") -> DataFrame:
    """(document, entry_no, style_guess, surname, year, raw_entry) of every document with a bibliography."""
    found = documents.select(F.col(path).alias("document"), bibliography_text(F.col(pages)).alias("_biblio")).where("_biblio <> ''")
    split = found.select("document", split_entries(F.col("_biblio")).alias("_split"))
    listed = split.select("document", F.col("_split.style_guess").alias("style_guess"), F.posexplode("_split.entries").alias("entry_no", "_entry"))
    keyed = listed.withColumn("_key", citation_key(F.col("_entry")))
    return keyed.select("document", "entry_no", "style_guess", F.col("_key.surname").alias("surname"), F.col("_key.year").alias("year"), F.substring("_entry", 1, KEPT).alias("raw_entry"))


def most_cited_works(parsed: DataFrame) -> DataFrame:
    """(surname, year, cited_by_n_documents) over entries that were parsed; unordered."""
    keyed = parsed.where(PARSED)
    return keyed.groupBy(F.lower("surname").alias("surname"), "year").agg(F.countDistinct("document").alias("cited_by_n_documents"))


def most_cited_authors(parsed: DataFrame) -> DataFrame:
    """(surname, cited_by_n_documents) over entries that were parsed; unordered."""
    keyed = parsed.where(PARSED)
    return keyed.groupBy(F.lower("surname").alias("surname")).agg(F.countDistinct("document").alias("cited_by_n_documents"))


def by_popularity(counted: DataFrame, parsed: DataFrame, keys: list[str]) -> DataFrame:
    """A roll-up in the order of its report: most cited first, ties as they first appear in document order."""
    return _first_seen(counted, parsed, keys).orderBy(*_popularity(keys)).drop("_first")


def ranked_by_popularity(counted: DataFrame, parsed: DataFrame, keys: list[str]) -> DataFrame:
    """The same with its ``rank``, numbered without bringing the report into one task."""
    return numbered(_first_seen(counted, parsed, keys), _popularity(keys), "rank").drop("_first")


def _first_seen(counted: DataFrame, parsed: DataFrame, keys: list[str]) -> DataFrame:
    first = parsed.where(PARSED).withColumn("surname", F.lower("surname")).groupBy(*keys).agg(F.min(F.struct(F.split("document", "/"), "entry_no")).alias("_first"))
    return counted.join(first, keys, "left")


def _popularity(keys: list[str]) -> list[Column]:
    return [F.col("cited_by_n_documents").desc(), F.col("_first").asc_nulls_last(), *(F.col(k) for k in keys)]


def coverage(documents: DataFrame, parsed: DataFrame, pages: str = "pages") -> DataFrame:
    """(n_documents, n_with_bibliography, n_entries, n_parsed)."""
    docs = documents.agg(F.count(F.lit(1)).alias("n_documents"), F.count_if(bibliography_text(F.col(pages)) != "").alias("n_with_bibliography"))
    rows = parsed.agg(F.count(F.lit(1)).alias("n_entries"), F.count_if(F.col("surname").isNotNull()).alias("n_parsed"))
    return docs.crossJoin(rows)  # one row each
