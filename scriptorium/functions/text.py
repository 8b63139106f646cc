"""Text expressions with the semantics of Python's ``re`` and ``str``, on JVM columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F

#: White space as Python knows it: Unicode, and the four separators that Java leaves out.
SPACE = r"[\s\x1c-\x1f]"
_U = "(?U)"


def join_pages(pages: Column) -> Column:
    """All pages joined by line feeds; null pages and a null array count as empty text."""
    return F.array_join(F.transform(F.coalesce(pages, F.array().cast("array<string>")), lambda p: F.coalesce(p, F.lit(""))), "\n")


def close_hyphens(text: Column) -> Column:
    """Join words broken by a hyphen at a line end."""
    # white space with a line feed in it, taken whole: nothing is tried twice in long gaps
    return F.regexp_replace(text, rf"{_U}(\w)-[[^\S\n]\x1c-\x1f]*+\n{SPACE}*+(\w)", "$1$2")


def collapse(text: Column) -> Column:
    """Every run of white space as one blank."""
    return F.regexp_replace(text, rf"{_U}{SPACE}+", " ")


def normalise(text: Column) -> Column:
    return collapse(close_hyphens(text))


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, rf"{_U}\A{SPACE}++|(?<!{SPACE}){SPACE}++\z", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(rf"{_U}[^\s\x1c-\x1f]")


def sentences(text: Column) -> Column:
    """Pieces between white space that follows a full stop, exclamation or question mark."""
    return F.split(text, rf"{_U}(?<=[.!?]){SPACE}+", -1)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null where there is none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def escape_html(text: Column) -> Column:
    """The five characters that markup reserves, ampersands first."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def round_exactly(value: Column, digits: int) -> Column:
    """Half-even rounding of the exact binary value; for small result tables at a sink only."""

    @F.pandas_udf("double")
    def rounded(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if pd.isna(v) else round(float(v), digits))

    return rounded(value.cast("double"))
