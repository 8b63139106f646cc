from __future__ import annotations

import random
import re
import sys
import unicodedata

from scriptorium.llm import leakage

WORDS = [f"w{k}" for k in range(400)]


def brute(docs, items, n=leakage.WINDOW):
    grams = {}
    for key, text in items:
        words = leakage.normalised_words(text)
        for k in range(len(words) - n + 1):
            grams.setdefault(tuple(words[k : k + n]), set()).add(key)
    out = set()
    for key, text in docs:
        words = leakage.normalised_words(text)
        for k in range(len(words) - n + 1):
            out |= {(key, item) for item in grams.get(tuple(words[k : k + n]), ())}
    return out


def test_words_are_runs_of_letters_and_digits():
    every = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    kept = {c for w in re.findall(r"[^\W_]+", every) for c in w}
    letters = {c for c in every if unicodedata.category(c)[0] in "LN"}
    assert kept == letters
    assert leakage.normalised_words("Ａb­c ﬁ x²_y don't É") == ["abc", "fi", "x2", "y", "don", "t", "é"]
    assert leakage.normalised_words(None) == leakage.normalised_words(" _ ") == []


def make(seed=3):
    r = random.Random(seed)
    items = [(k, " ".join(r.choices(WORDS, k=r.choice([5, 12, 40])))) for k in range(30)]
    items += [(30, items[3][1]), (31, None), (32, "")]
    docs = []
    for k in range(120):
        words = r.choices(WORDS, k=60)
        if k % 3 == 0:
            source = leakage.normalised_words(r.choice(items)[1])
            size = r.choice([11, 12, 20])
            start = r.randrange(max(1, len(source) - size + 1))
            words[20:20] = source[start : start + size]
        docs.append((k, r.choice([" ", ", ", "-\n"]).join(words).upper()))
    docs += [(200, None), (201, ""), (0, docs[0][1]), (None, docs[0][1]), (202, items[2][1]), (203, "word " * 50_000 + (items[0][1] if len(leakage.normalised_words(items[0][1])) >= 12 else ""))]
    return docs, items


def test_same_as_brute_force_in_one_or_many_blocks(spark):
    docs, items = make()
    expected = {p for p in brute(docs, items) if p[0] is not None}
    assert expected
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "0 AS item_id")
    i = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "'x' AS doc_id")
    for limit in (leakage.MAX_INDEX_CHARS, 900):
        rows = leakage.find_leaks(d, i, max_chars=limit).collect()
        assert {(r.doc_id, r.item_id) for r in rows} == expected
        assert len(rows) == len(expected)
    assert leakage.find_leaks(d.limit(0), i).count() == leakage.find_leaks(d, i.limit(0)).count() == 0


def test_removal_leaves_no_leak_and_no_row_out(spark):
    docs, items = make(5)
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    clean = leakage.remove_leaks(d, i)
    assert clean.count() == len(docs)
    got = {r.doc_id: r for r in clean.collect()}
    assert got[200].text is None and got[201].text == ""
    hit = {p[0] for p in brute(docs, items)}
    for key, text in docs:
        if key is not None and text:
            assert (got[key].removed_words > 0) == (key in hit)
            assert key in hit or got[key].text == text
    pairs = [(k, r.text) for k, r in got.items() if k is not None]
    assert not {p for p in brute(pairs, items) if len(leakage.normalised_words(dict(pairs)[p[0]])) < 12}


def overlapping():
    w = [f"x{k}" for k in range(60)]
    items = [(1, " ".join(w[:18])), (2, " ".join(w[6:30])), (3, " ".join(w[30:45])), (4, " ".join(w[40:60])), (5, " ".join(w[:18])), (6, "no such words here at all " * 4)]
    docs = [(1, "before " + " ".join(w) + " after"), (2, " ".join(w[:12]) + " gap " + " ".join(w[12:30])), (3, " ".join(w[:9] + w[25:42])), (4, " ".join(w[3:15])), (5, " ".join(w[3:14])), (5, " ".join(w[3:16])), (None, " ".join(w)), (6, None), (7, "")]
    return docs, items


def test_same_rows_whatever_the_size_of_the_index(spark):
    docs, items = overlapping()
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    order = lambda df: sorted(map(tuple, df.collect()), key=repr)
    found, clean = order(leakage.find_leaks(d, i)), order(leakage.remove_leaks(d, i))
    assert set(found) == {p for p in brute(docs, items) if p[0] is not None}
    assert (1, "before after", 60) in [(k, " ".join(t.split()) if t else t, n) for k, t, n in clean]
    for limit in (1, 60, 20_000_000):
        assert order(leakage.find_leaks(d, i, max_chars=limit)) == found
        assert order(leakage.remove_leaks(d, i, max_chars=limit)) == clean
    assert order(leakage.remove_leaks(d, i.limit(0), max_chars=-1)) == sorted([(k, t.strip() if t else t, 0) for k, t in docs], key=repr)


def test_the_index_keeps_its_bound():
    r = random.Random(2)
    text = " ".join(r.choices("abcdefgh", k=50_000))
    index = leakage.WindowIndex([(k, text[k * 1000 : k * 1000 + 1000]) for k in range(100)])
    assert index.size() <= leakage.INDEX_BYTES * len(text) / 2
    assert leakage.WindowIndex([]).hits([["a"] * 20, []])[0].size == 0
