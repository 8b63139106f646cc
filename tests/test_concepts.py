from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from scriptorium.functions.taxonomy import NATIVE, NATIVE_PHRASES, NATIVE_VARIANTS
from scriptorium.operators import concepts, sensitivity

# expectations worked out by hand
GOLDEN = [
    ("a/1", ["Neo-imperialism and settler-colonialism."], NATIVE_PHRASES, {"colonialism": 1, "settler_colonialism": 1, "imperialism": 1, "neo_imperialism": 1}, "colonialism"),
    ("a/2", ["In the colonial period, imperialism grew."], NATIVE_PHRASES, {}, None),
    ("a/3", ["Settler colonial period"], NATIVE_PHRASES, {}, None),
    ("a/4", ["Empire. " + "x " * 40 + "the Imperial College"], NATIVE_PHRASES, {"empire": 1}, "imperialism"),
    ("a/5", ["coloni-\nalism"], NATIVE_PHRASES, {"colonialism": 1}, "colonialism"),
    ("a/6", ["neo-\nimperialism"], NATIVE_PHRASES, {}, None),
    ("a/7", ["They decolonized; decolonise now."], NATIVE_PHRASES, {"decoloniality": 1}, "colonialism"),
    ("a/8", ["   \n"], NATIVE_PHRASES, {}, None),
    ("a/9", None, NATIVE_PHRASES, {}, None),
    ("b/1", ["In the colonial period, imperialism grew."], (), {"imperialism": 1}, "imperialism"),
]


def documents(spark, cases):
    return spark.createDataFrame([(path, pages) for path, pages, *_ in cases], "path string, pages array<string>")


@pytest.mark.parametrize("phrases", [NATIVE_PHRASES, ()])
def test_golden_counts(spark, phrases):
    cases = [c for c in GOLDEN if c[2] == phrases]
    got = {r["path"]: r for r in concepts.profile(documents(spark, cases), NATIVE, phrases).collect()}
    for path, pages, _, expected, dominant in cases:
        row = got[path]
        counts = {c: row[f"concept__{c}"] for c in NATIVE.concepts if row[f"concept__{c}"]}
        assert counts == expected, path
        assert row["dominant_frame"] == dominant
        assert row["total_hits"] == sum(expected.values())
        assert row["breadth"] == len(expected)
    if phrases:
        assert got["a/8"]["char_count"] == 1 and got["a/8"]["extraction_ok"] is False
        assert got["a/9"]["char_count"] == 0 and got["a/9"]["extraction_ok"] is False


def test_rollups_keep_empty_documents_and_buckets(spark):
    profiled = concepts.profile(documents(spark, [c for c in GOLDEN if c[2]]), NATIVE, NATIVE_PHRASES)
    histogram = {r.bucket: (r.documents, r.n_documents) for r in concepts.breadth_histogram(profiled).collect()}
    assert histogram == {"0": (5, 9), "1": (3, 9), "2": (0, 9), "3": (0, 9), "4": (1, 9), "5": (0, 9), "6+": (0, 9)}
    dominance = {r.frame: (r.total_hits, r.all_hits) for r in concepts.frame_dominance(profiled, NATIVE).collect()}
    assert dominance == {"colonialism": (4, 7), "imperialism": (3, 7), "racism": (0, 7), "fascism": (0, 7)}
    zero = concepts.zero_documents(profiled).first()
    assert (zero.n_documents, zero.n_zero, zero.n_failed) == (9, 5, 2)
    summary = json.loads(concepts.summary(profiled, NATIVE).first().summary)
    assert summary["pct_documents_zero_concepts"] == 55.56
    assert summary["breadth_histogram"]["1"] == {"documents": 3, "pct_of_corpus": 33.33}


def test_top_documents_break_ties_by_path(spark):
    df = documents(spark, [("b/x", ["empire"]), ("a/z", ["empire"]), ("a", ["empire empire"]), ("c", ["none"])])
    top = concepts.top_documents(concepts.profile(df, NATIVE), 3).orderBy("rank").collect()
    assert [(r["rank"], r["path"], r["filename"]) for r in top] == [(1, "a", "a"), (2, "a/z", "z"), (3, "b/x", "x")]


def test_empty_corpus(spark):
    empty = documents(spark, [])
    profiled = concepts.profile(empty, NATIVE, NATIVE_PHRASES)
    assert concepts.breadth_histogram(profiled).agg(F.sum("documents")).first()[0] == 0
    assert {r.share for r in concepts.frame_dominance(profiled, NATIVE).collect()} == {0.0}
    assert sensitivity.sensitivity_matrix(empty, NATIVE_VARIANTS).where("n_docs <> 0 OR hits <> 0").count() == 0
    assert json.loads(concepts.summary(profiled, NATIVE).first().summary)["n_documents_analyzed"] == 0


def test_variants_differ_in_forms_and_unit(spark):
    df = documents(spark, [("a", ["Colonial rule. A colonial and racist colonizer; colonial.", "colonial"]), ("b", ["nothing"])])
    got = {(r.variant, r.frame): (r.hits, r.n_zero, r.n_docs) for r in sensitivity.sensitivity_matrix(df, NATIVE_VARIANTS).collect()}
    assert got["A_strict_token", "colonialism"] == (0, 2, 2)
    assert got["B_plusAdjectives_token", "colonialism"] == (4, 1, 2)
    assert got["C_plusForms_token", "colonialism"] == (1, 1, 2)
    assert got["D_plusAdjForms_token", "racism"] == (1, 1, 2)
    # three sentences hold the adjective, one of them the new form too
    assert got["E_plusAdjForms_sentence", "colonialism"] == (4, 1, 2)
    report = {r.variant: r for r in sensitivity.sensitivity_report(sensitivity.sensitivity_matrix(df, NATIVE_VARIANTS), NATIVE.frame_order).collect()}
    assert report["D_plusAdjForms_token"].colonialism_pct == 83.3
    assert report["D_plusAdjForms_token"].zero_engagement_pct == 50.0


def test_columns_of_the_input_do_not_clash(spark):
    df = documents(spark, [("a", ["empire"])]).withColumns({"_text": F.lit(1), "char_count": F.lit("x"), "total_hits": F.lit(7), "breadth": F.lit(None).cast("int")})
    row = concepts.profile(df, NATIVE).first()
    assert (row["total_hits"], row["char_count"], row["breadth"]) == (1, 6, 1)


def test_too_many_excluded_phrases_are_an_error(spark, tmp_path):
    from scriptorium.plans import catalog

    for n in (catalog.MAX_PHRASES, catalog.MAX_PHRASES + 1):
        spark.createDataFrame([(f"phrase {k}",) for k in range(n)] + [(None,)], "phrase string").write.parquet(f"{tmp_path}/{n}/excluded_phrases.parquet")
    assert len(catalog._phrases(spark, f"{tmp_path}/{catalog.MAX_PHRASES}")) == catalog.MAX_PHRASES
    with pytest.raises(ValueError):
        catalog._phrases(spark, f"{tmp_path}/{catalog.MAX_PHRASES + 1}")
