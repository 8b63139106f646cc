"""Readers of PDF files by whichever library is installed; the engine itself ships none."""

from __future__ import annotations

import importlib.util
import io
from collections.abc import Callable

Extractor = Callable[[bytes], list[str]]


def by_pymupdf(content: bytes) -> list[str]:
    import fitz

    with fitz.open(stream=content, filetype="pdf") as document:
        return [page.get_text() for page in document]


def by_pdfplumber(content: bytes) -> list[str]:
    import pdfplumber

    with pdfplumber.open(io.BytesIO(content)) as document:
        return [page.extract_text() or "" for page in document.pages]


def by_pypdf(content: bytes) -> list[str]:
    import pypdf

    return [page.extract_text() or "" for page in pypdf.PdfReader(io.BytesIO(content)).pages]


#: In the order in which they are tried.
KNOWN = (("fitz", by_pymupdf), ("pdfplumber", by_pdfplumber), ("pypdf", by_pypdf))


def installed() -> list[Extractor]:
    """The extractors whose library is there; an empty list where none is."""
    return [extract for library, extract in KNOWN if importlib.util.find_spec(library) is not None]
