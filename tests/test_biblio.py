from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import biblio

LINES = ["Intro", "Said text", "  References ", "A, one", "B, two", "Notes", "skip me", "Bibliography", "C, three", "REFERENCES", "D, four", "Index", "z", "References"]


def test_sections_follow_every_heading_and_stop(spark):
    df = spark.createDataFrame([(1, ["\n".join(LINES[:5]), "\n".join(LINES[5:])]), (2, ["References"]), (3, ["no list"]), (4, None), (5, ["x\nReferences\n\nBooks, A."])], "k int, pages array<string>")
    got = {r.k: r.t for r in df.select("k", biblio.bibliography_text(F.col("pages")).alias("t")).collect()}
    assert got[1] == "A, one\nB, two\nC, three\nD, four\n"
    assert got[2] == got[3] == got[4] == ""
    assert got[5] == "\nBooks, A."


@pytest.mark.parametrize(
    ("entry", "surname", "year"),
    [
        ("Said, E. (1978a) Orientalism.", "Said", "1978a"),
        ("[12] E. Said, Orientalism, 1978.", "Said", "1978"),
        ("3. H. J. Arendt, Origins 1951", "Arendt", "1951"),
        ("Hall, S. 1996, repr. (2001)", "Hall", "2001"),
        ("de Beauvoir, S. (1949)", "Beauvoir", "1949"),
        ("Émile, Z. (1900) X", None, None),
        ("(1999) no author", None, None),
        ("no year here, Smith", None, None),
        ("", None, None),
        (None, None, None),
    ],
)
def test_citation_keys(spark, entry, surname, year):
    df = spark.createDataFrame([(entry,)], "e string").select(biblio.citation_key(F.col("e")).alias("k"))
    assert df.first().k == (surname, year)


def test_author_date_split_and_style(spark):
    texts = ["X\nSaid, E. a\nGo,\nHall, S. b\nfoo\nÉmile, Z\nD'Arcy, Q", "[1] A. One, 1990\n[2] B. Two,\nmore 1991\n[3] C. Three 1992", "only one", "Aa, B. 1\nCc, D. " + "x" * 3000 + "\nEe, F. 2"]
    got = [r.s for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(biblio.split_entries(F.col("t")).alias("s")).collect()]
    assert got[0].style_guess == "author_date"
    assert got[0].entries == ["X", "Said, E. a", "Go,", "Hall, S. b\nfoo\nÉmile, Z", "D'Arcy, Q"]
    assert got[1].style_guess == "numbered" and got[1].entries[1] == "[2] B. Two,\nmore 1991"
    assert got[2].style_guess == "author_date" and got[2].entries == ["only one"]
    assert got[3].style_guess == "author_date" and len(got[3].entries) == 3


def test_rollups_count_distinct_documents_in_order(spark):
    pages = ["References\nSaid, E. (1978) One.\nHall, S. (1996) Two.\nsaid, lower 1978\nSaid, E. (1978) Again."]
    df = spark.createDataFrame([("b", pages), ("a", ["References\nHall, S. (1996) Two.\nGo, J. (2011) Three."]), ("c", ["none"])], "path string, pages array<string>")
    parsed = biblio.entries(df)
    works = biblio.by_popularity(biblio.most_cited_works(parsed), parsed, ["surname", "year"]).collect()
    assert [(r.surname, r.year, r.cited_by_n_documents) for r in works] == [("hall", "1996", 2), ("go", "2011", 1), ("said", "1978", 1)]
    authors = biblio.most_cited_authors(parsed)
    assert {r.surname: r.cited_by_n_documents for r in authors.collect()} == {"hall": 2, "go": 1, "said": 1}
    cover = biblio.coverage(df, parsed).first()
    assert (cover.n_documents, cover.n_with_bibliography) == (3, 2)
    assert parsed.where("length(raw_entry) > 300").count() == 0
