from __future__ import annotations

import re

import numpy as np
from hypothesis import given, settings, strategies as st

from scriptorium.llm import quality

PROSE = "The old ferry was sold to the council in the spring, and nobody in the town knew why it had been built there at all. It is still on the river, near the mill that the widow kept for her sons, but the clerk does not write about it."


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab-é1_ \n\t\x1c", max_size=40))
def test_length_is_that_of_the_normalised_text(text):
    assert quality.normalised_length(text) == len(re.sub(r"\s+", " ", re.sub(r"(\w)-\s*\n\s*(\w)", r"\1\2", text)))


def kind_of(text):
    mixture = quality.example_mixture()
    cells = quality.levels(np.array([quality.statistics(s) for s in quality.segments(text)])).astype(float)
    assert (quality.cell_levels(np.array(quality.cell_codes(quality.segments(text)))) == cells).all()
    return mixture.kind(cells)


def test_kinds_of_fresh_examples():
    assert set(kind_of(PROSE)) == {"prose"}
    assert set(kind_of("Die Fähre wurde im Frühjahr an den Rat verkauft, und niemand in der Stadt wusste, warum sie an dem Fluss gebaut worden war.")) == {"prose"}
    assert set(kind_of("渡船在春天被卖给了镇议会，而镇上没有人知道它为什么被建在那里。")) == {"prose"}
    assert "prose" not in kind_of("Town\tBoats\tMills\nKendal\t14\t3.5\nLudlow\t(2.10)\t900\nMalton\t–\t17")
    assert "prose" not in kind_of("abbey, 4, 19, 77\nbarge, 120, 121\ncanal, 8, 54\ndike, 33")
    assert "prose" not in kind_of("%$#@ &*^~ }{|\\ <>=+ #@%^ &*~} {|<>")
    assert "prose" not in kind_of("Gur byq sreel jnf fbyq gb gur pbhapvy va gur fcevat, naq abobql va gur gbja xarj jul vg unq orra ohvyg gurer.")


def test_every_character_belongs_to_a_segment():
    text = "Heading\n\nLong line of words that is not short at all.\nshort\na\nb\nc\n\n\tcell\t1\t2\n"
    assert "".join("".join(quality.segments(text)).split()) == "".join(text.split())
    assert quality.segments("") == quality.segments(" \n\t\n") == []


def test_issues(spark):
    table = "Town\tBoats\tMills\n" + "\n".join(f"Kendal{k}\t{k * 7}\t({k}.50)" for k in range(30))
    records = [(1, [PROSE]), (2, [table, "The end of it was near."]), (3, None), (4, []), (5, [None, "  \n"]), (6, [PROSE, None, table[:60]]), (7, [PROSE * 2000]), (8, [PROSE])]
    length = {k: quality.normalised_length("\n".join(p or "" for p in pages or [])) for k, pages in records}
    results = [(k, length[k], bool(pages) and any((p or "").strip() for p in pages)) for k, pages in records]
    results += [(1, length[1] + 1, True), (8, int(length[8] * 1.011) + 1, False), (3, 99, True), (7, None, None), (8, int(length[8] * 1.011) + 1, False), (99, 5, True), (None, 5, True)]
    r = spark.createDataFrame(records, "cache_id bigint, pages array<string>").selectExpr("*", "0 AS length", "1 AS prose", "2 AS extraction_ok")
    d = spark.createDataFrame(results, "cache_id bigint, char_count int, extraction_ok boolean").selectExpr("*", "'x' AS pages")
    got = sorted((x.cache_id, x.issue) for x in quality.find_issues(r, d).collect())
    assert got == [(2, "not_prose"), (3, "extraction_ok"), (8, "char_count"), (8, "extraction_ok")]
    assert quality.find_issues(r.limit(0), d).count() == 0
    assert {x.issue for x in quality.find_issues(r, d.limit(0)).collect()} == {"not_prose"}


def corpus_cells(spark, folder):
    rows = quality.measured_records(spark.read.parquet(f"{folder}/extraction_cache.parquet"))
    return rows, quality.fit_mixture(rows)


def test_the_fit_follows_the_corpus(spark, folder):
    rows, fitted = corpus_cells(spark, folder)
    start = quality.example_mixture()
    pairs = rows.selectExpr("inline(arrays_zip(cells, sizes))").groupBy("cells").sum("sizes").toPandas()
    x = quality.cell_levels(pairs["cells"].to_numpy().astype(np.int64)).astype(float)
    n = pairs["sum(sizes)"].to_numpy().astype(float)
    # the components move from the examples to the corpus, and it becomes likelier
    moved = np.abs((fitted.mean * fitted.scale + fitted.shift) - start.examples).max(1)
    assert (moved > 0.5).mean() > 0.5
    unfitted = quality.Mixture(start.examples, start.kinds)
    unfitted.shift, unfitted.scale = fitted.shift, fitted.scale
    unfitted._start(0.6)
    assert float(fitted.responsibilities(x)[1] @ n) > float(unfitted.responsibilities(x)[1] @ n) + n.sum()
    changed = np.array([a != b for a, b in zip(fitted.kind(x), start.kind(x), strict=True)])
    assert 0 < n[changed].sum() / n.sum() < 0.1


def test_many_cells_take_little_memory():
    import tracemalloc

    r = np.random.default_rng(1)
    codes = np.arange(quality.LEVELS ** len(quality.SCALES) // 8, dtype=np.int64) * 8
    cells, n = quality.cell_levels(codes), r.random(len(codes)) * 1000
    tracemalloc.start()
    quality.example_mixture().fit(cells, n, rounds=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6
