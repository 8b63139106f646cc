from __future__ import annotations

import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.functions.taxonomy import Taxonomy, literal_start, pattern_of
from scriptorium.operators.concepts import token_count

CASES = ["coloni-\nalism", "neo-\nimperialism", "   \n", "", "a- \n\n b", "a-\nb-\nc", "x  y\x1cz", "A b. C d! E f?  G. ", "no end", "tab\tand\x0bmore ", None]


def rows(spark, values):
    return spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")


def model(text):
    return re.sub(r"\s+", " ", re.sub(r"(\w)-\s*\n\s*(\w)", r"\1\2", text))


def test_normalise_and_strip_as_python_does(spark):
    found = {r.k: r for r in rows(spark, CASES).select("k", T.normalise(F.col("v")).alias("n"), T.strip(F.col("v")).alias("s"), T.is_blank(F.col("v")).alias("b"), T.sentences(F.col("v")).alias("p")).collect()}
    for k, text in enumerate(CASES):
        r = found[k]
        if text is None:
            assert r.n is None and r.s is None
            continue
        assert r.n == model(text)
        assert r.s == text.strip()
        assert r.b == (not text.strip())
        assert list(r.p) == re.split(r"(?<=[.!?])\s+", text)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab-é \n\t. \x1f", max_size=20), min_size=5, max_size=20))
def test_normalise_on_any_text(spark, texts):
    found = {r.k: r for r in rows(spark, texts).select("k", T.normalise(F.col("v")).alias("n"), T.strip(F.col("v")).alias("s")).collect()}
    for k, text in enumerate(texts):
        assert found[k].n == model(text)
        assert found[k].s == text.strip()


def test_join_pages_counts_nulls_as_empty(spark):
    df = spark.createDataFrame([(1, ["a", None, "b"]), (2, []), (3, None)], "k int, pages array<string>")
    assert {r.k: r.t for r in df.select("k", T.join_pages(F.col("pages")).alias("t")).collect()} == {1: "a\n\nb", 2: "", 3: ""}


def test_escape_and_exact_rounding(spark):
    df = spark.createDataFrame([("<a href=\"x\">'&amp;'", 2.675), ("", 0.125)], "v string, x double")
    got = df.select(T.escape_html(F.col("v")).alias("v"), T.round_exactly(F.col("x"), 2).alias("x")).collect()
    assert [r.v for r in got] == ["&lt;a href=&quot;x&quot;&gt;&#x27;&amp;amp;&#x27;", ""]
    assert [r.x for r in got] == [2.67, 0.12]


@pytest.mark.parametrize(("variant", "start"), [("enclos(?:e|ed)", "enclos"), ("empires?", "empire"), ("neo[\\s-]x", "neo"), ("(?:a|b)c", ""), ("RaciSm", "racism"), ("ab*c", "a"), ("cat|dog", ""), ("ca(?:t|r)s", "ca"), ("x[|]y", "x")])
def test_literal_start(variant, start):
    assert literal_start(variant) == start


def test_patterns_fold_case_beyond_ascii(spark):
    pattern = pattern_of(["racism"])
    df = rows(spark, ["RACIſM", "éracism", "racism.", "racisms"])
    assert [r.n for r in df.orderBy("k").select(F.regexp_count("v", F.lit(pattern)).alias("n")).collect()] == [1, 0, 1, 0]


def test_taxonomy_table_keeps_order_and_skips_empty(spark):
    df = spark.createDataFrame([("b", 1, "y", 0, ["y"]), ("a", 0, "z", 1, ["z", ""]), ("a", 0, "x", 0, ["x"]), ("a", 0, "e", 2, [])], "frame string, frame_ord int, concept string, concept_ord int, variants array<string>")
    taxonomy = Taxonomy.from_table(df)
    assert taxonomy.frame_order == ["a", "b"]
    assert taxonomy.concepts == ["x", "z", "y"]
    assert taxonomy.patterns["z"] == ("z",)


@pytest.mark.parametrize("variants", [["enclosure", "enclosures", "enclos(?:e|ed|ing)"], ["commons", "commoners?"], ["settler[\\s-]colonial(?:ism)?"], ["cat|dog"], ["racism", "racist(?:s)?"]])
def test_counting_patterns_count_the_same(spark, variants):
    words = ["enclosure", "Enclosures", "enclosed", "enclos", "reenclosing", "common", "COMMONS", "commoners", "commoner's", "settler colonial", "settler-colonialism", "cat", "dogs", "dog", "racist", "racists.", "éracism", "racism_", "raciſm", "\u0130cat", "commonsé"]
    texts = [" ".join(words), ", ".join(reversed(words)), "".join(words), "", "enclosure" * 3, "enclosure-enclosure.enclosed"]
    df = rows(spark, texts).select("k", token_count(F.col("v"), variants).alias("n"), F.regexp_count("v", F.lit(pattern_of(variants))).alias("m"))
    assert [(r.n, r.m) for r in df.collect() if r.n != r.m] == []
    assert sum(r.n for r in df.collect()) > 0


LONG = 1_000_000


@pytest.mark.parametrize("blank", [" ", "\x1c", "\t \xa0"])
def test_long_gaps_end_no_session(spark, blank):
    from scriptorium.functions.taxonomy import NATIVE
    from scriptorium.operators import biblio, concepts, markup

    gap = blank * (LONG // len(blank))
    pages = [f"a{gap}b-{gap}\n{gap}c{gap}", f"References{gap}", f"{gap}", f"One, A. (1990) x.\nTwo, B. (1991) y{gap}", "Index\nz"]
    df = spark.createDataFrame([(pages, gap + "One, A." + gap + "(1990)" + gap, "---" + gap + "\nx\n---" + gap + "\n![[" + gap + "]] $" + gap + "$ ==" + gap + "== %%" + gap + "%% #" + gap)], "pages array<string>, entry string, note string")
    r = df.select(
        biblio.bibliography_text(F.col("pages")).alias("b"), F.length(T.normalise(T.join_pages(F.col("pages")))).alias("n"), T.strip(F.col("entry")).alias("e"), F.size(T.sentences(F.col("entry"))).alias("s"),
        biblio.citation_key(F.col("entry")).alias("k"), F.size(biblio.split_entries(F.concat(F.lit("\n"), F.element_at("pages", 4))).getField("entries")).alias("parts"), F.length(markup.prose_markup(F.col("note"))).alias("m"), markup.uses_math(F.col("note")).alias("u"),
    ).first()
    assert r.b.strip() == "One, A. (1990) x.\nTwo, B. (1991) y" and r.n < 120
    assert r.e.startswith("One") and r.s == 2 and tuple(r.k) == ("One", "1990") and r.m > 0
    assert concepts.profile(df.select("pages", F.lit("p").alias("path")), NATIVE).first().total_hits == 0


def test_long_runs_of_line_feeds_close_words(spark):
    df = rows(spark, ["a-" + "\n" * 300_000 + "b", "a-" + " \n" * 300_000 + ". b"])
    assert [r.n for r in df.orderBy("k").select(F.length(T.close_hyphens(F.col("v"))).alias("n")).collect()] == [2, 600_005]
