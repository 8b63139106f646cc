from __future__ import annotations

import random
from itertools import combinations

from scriptorium.llm import neardup
from scriptorium.llm.components import components

SCHEMA = "cache_id bigint, path string, pages array<string>"


def edited(r, text, share):
    chars = list(text)
    for _ in range(int(share * len(chars))):
        k = r.randrange(len(chars))
        kind = r.randrange(3)
        if kind == 0:
            chars[k] = r.choice("abcdefgh")
        elif kind == 1:
            chars.insert(k, r.choice("xyz "))
        else:
            del chars[k]
    return "".join(chars)


def brute(rows):
    sets = {}
    for key, path, pages in rows:
        if sum(len(p) for p in pages or [] if p) >= neardup.MIN_CHARS:
            sets[key] = neardup.shingle_set(neardup.folded(path, pages))
    return {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= neardup.THRESHOLD}


def make():
    r = random.Random(1)
    rows, key = [], 0
    for _ in range(25):
        base = "".join(r.choices("abcdefghijklmnopqrst    \n", k=r.randrange(220, 2500)))
        for share in (0, 0.01, 0.02, 0.03, 0.05, 0.1):
            text = edited(r, base, share)
            cut = r.randrange(len(text))
            key += 1
            rows.append((key, f"dir/{key % 7}.pdf", [text[:cut].upper(), None, text[cut:]]))
    same = ["One text that many records share, read again and again. " * 5]
    rows += [(1000 + k, "same/path.pdf", same) for k in range(12)]
    rows += [(2000, None, None), (2001, "p", []), (2002, "p", [None, ""]), (2003, "p", ["short"]), (2004, "", [" " * 300]), (2005, None, same)]
    return rows


def test_pairs_equal_brute_force(spark):
    rows = make()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS id", "'b' AS rep", "2 AS a")
    got = {(r.cache_id_a, r.cache_id_b) for r in neardup.similar_pairs(df).collect()}
    expected = brute(rows)
    assert got <= expected
    assert len(got) >= 0.98 * len(expected)
    assert {p for p in expected if p[0] >= 1000} <= got
    assert neardup.similar_pairs(df.limit(0)).count() == 0


def test_groups_are_the_components_of_the_pairs(spark):
    df = spark.createDataFrame(make(), SCHEMA)
    pairs = [(r.cache_id_a, r.cache_id_b) for r in neardup.similar_pairs(df).collect()]
    group = {}
    for r in neardup.duplicate_groups(df).collect():
        group[r.cache_id] = r.group_id
    assert all(group[a] == group[b] for a, b in pairs)
    assert len({group[k] for k in range(1000, 1012)}) == 1
    assert set(group) == {r[0] for r in make() if sum(len(p) for p in r[2] or [] if p) >= neardup.MIN_CHARS and r[0] != 2004}  # 2004 is all white space


def test_repeated_rows_give_one_pair(spark):
    text = ["A sentence with enough characters to count as a record of its own. " * 4]
    df = spark.createDataFrame([(1, "a", text), (1, "a", text), (2, "b", text), (2, "b", text)], SCHEMA)
    assert [tuple(r) for r in neardup.similar_pairs(df).collect()] == [(1, 2)]


def test_minhash_estimates_the_similarity():
    r = random.Random(4)
    for share in (0.005, 0.02, 0.05):
        a = "".join(r.choices("abcdefghijklmnopqrst", k=3000))
        b = edited(r, a, share)
        one, two = neardup.shingle_set(a), neardup.shingle_set(b)
        true = len(one & two) / len(one | two)
        assert abs((neardup.minhash(a) == neardup.minhash(b)).mean() - true) < 0.09
    assert neardup.minhash("short") is None
    levels = neardup.least_matches()
    assert [n for n, _ in levels] == list(range(32, 193, 32)) and all(0 < m < 0.6 * n for n, m in levels)


def test_components_of_any_graph(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(40)] + [(5, None), (None, 5), (7, 7)]
    edges += [(2000, 2001 + k) for k in range(80)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def test_many_copies_under_other_paths(spark):
    r = random.Random(8)
    base = "".join(r.choices("abcdefghijklmnopqrst    ", k=900))
    near, short = edited(r, base, 0.02), "".join(r.choices("abcdefghijklm", k=210))
    rows = [(k, f"folder{k % 50}/copy-{k * 7919 % 1000}.pdf", [base]) for k in range(1200)]
    rows += [(5000 + k, f"folder{k}/copy-{k * 7919 % 1000}.pdf", [near]) for k in range(40)]
    rows += [(6000 + k, f"quite/another/folder/of/files/{k}/{'xyz' * k}.pdf", [short]) for k in range(12)]
    df = spark.createDataFrame(rows, SCHEMA)
    groups = {r.cache_id: (r.rep, r.group_id) for r in neardup.duplicate_groups(df.where("cache_id < 6000")).collect()}
    assert {rep for rep, _ in groups.values()} == {0, 5000} and {g for _, g in groups.values()} == {0}
    few = df.where("cache_id < 60 OR cache_id >= 5000")
    got = {(r.cache_id_a, r.cache_id_b) for r in neardup.similar_pairs(few).collect()}
    assert got == brute([x for x in rows if x[0] < 60 or x[0] >= 5000])


def test_classes_are_linked_by_any_of_their_members(spark):
    r = random.Random(12)
    letters = "abcdefghijklmnopqrst"
    rows = []
    for k in range(6):
        shared, path = "".join(r.choices(letters, k=420)), "".join(r.choices(letters, k=95))
        ends = ["".join(r.choices(letters, k=160)) for _ in range(2)]
        for side in range(2):
            rows += [(100 * k + 10 * side + n, "".join(r.choices(letters, k=95)), [shared + ends[side]]) for n in range(3)]
            rows.append((100 * k + 10 * side + 5, path if k % 2 else "".join(r.choices(letters, k=95)), [shared + ends[side]]))
    df = spark.createDataFrame(rows, SCHEMA)
    group = {x.cache_id: x.group_id for x in neardup.duplicate_groups(df).collect()}
    pairs = brute(rows)
    found = {(x.cache_id_a, x.cache_id_b) for x in neardup.similar_pairs(df).collect()}
    assert found == pairs and {(100 * k + 5, 100 * k + 15) in pairs for k in (1, 3, 5)} == {True}
    assert group == {key: key // 100 * 100 + (0 if key // 100 % 2 else key % 100 // 10 * 10) for key, _, _ in rows}


def test_any_similar_members_equal_brute_force():
    r = random.Random(3)
    for _ in range(300):
        one, two = (set(r.sample(range(60), r.randrange(20, 45))) for _ in range(2))
        paths = [[set(r.sample(range(40, 90), r.randrange(12))) for _ in range(4)] for _ in range(2)]
        brute_force = any(len((one | x) & (two | y)) / len(one | x | two | y) >= neardup.THRESHOLD for x in paths[0] for y in paths[1])
        assert neardup.any_similar(one, two, *paths) == brute_force


def test_short_copies_are_compared_once(spark):
    r = random.Random(21)
    short = "".join(r.choices("abcdefghijklmnop   ", k=250))
    rows = [(k, f"course{k % 90}/week{k % 13}/reading-{k * 7919 % 10007}.pdf", [short]) for k in range(20_000)]
    rows += [(50_000 + k, f"course{k}/week{k}/reading-{k}.pdf", [edited(r, short, 0.01)]) for k in range(5)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    _, members, links = neardup.class_links(df)
    assert members.select("rep").distinct().count() <= 6 and links.count() <= 15
    groups = {x.group_id for x in neardup.duplicate_groups(df).collect()}
    assert groups == {0}
    few = [x for x in rows if x[0] < 150 or x[0] >= 50_000]
    got = {(x.cache_id_a, x.cache_id_b) for x in neardup.similar_pairs(spark.createDataFrame(few, SCHEMA)).collect()}
    assert got == brute(few)


def test_paths_that_lift_short_records_over_the_threshold(spark):
    r = random.Random(31)
    rows, key = [], 0
    for _ in range(60):
        path, base = "".join(r.choices("abcdefghij/", k=60)), "".join(r.choices("abcdefghijklmnopqrst", k=230))
        for _ in range(2):
            key += 1
            rows.append((key, path, [base[: r.randrange(155, 175)] + "".join(r.choices("uvwxyz", k=60))]))
    expected = brute(rows)
    got = {(x.cache_id_a, x.cache_id_b) for x in neardup.similar_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(expected) > 20 and got <= expected and len(got) >= 0.97 * len(expected)


def test_large_classes_are_shared_out(spark, monkeypatch):
    monkeypatch.setattr(neardup, "MEMBERS_AT_ONCE", 7)
    members = spark.createDataFrame([(k, 0) for k in range(40)] + [(100, 100), (101, 100)], "id bigint, rep bigint")
    assert sorted(map(tuple, neardup._member_pairs(members).collect())) == [*combinations(range(40), 2), (100, 101)]
