from __future__ import annotations

import pytest

from scriptorium.llm import names


@pytest.mark.parametrize(("a", "b", "value"), [("martha", "marhta", 0.9611), ("dixon", "dicksonx", 0.8133), ("dwayne", "duane", 0.84), ("", "a", 0.0), ("same", "same", 1.0), ("abc", "xyz", 0.0)])
def test_jaro_winkler(a, b, value):
    assert names.jaro_winkler(a, b) == pytest.approx(value, abs=1e-3)


SAME = [
    ("marlowen", "marlwoen"), ("marlowen", "marlowen j."), ("marlowen", "josephine q. marlowen"), ("marlowen", "marlow."), ("ted marlowen", "theodore marlowen"), ("mar lowen", "mar-lowen"), ("de la marlöwen", "delamarlowen"),
    ("society for river studies of aston", "soc. for riv. stud. of aston"), ("society for river studies of aston", "river studies, society for, aston"), ("society for river studies of aston", "srs aston"), ("the society for river studies of aston", "society of river studies, aston"),
    ("huksmere", "huxmere"), ("bell-marlowen", "marlowen-bell"),
]
DIFFERENT = [("marlowen", "karstside"), ("ann marlowen", "peter marlowen"), ("society for river studies of aston", "institute for coastal history of leeds"), ("society for river studies of aston", "marlowen"), ("", "marlowen")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same_names_meet_in_a_block_and_are_accepted(a, b):
    assert names.same_name(a, b) and names.same_name(b, a)
    assert names.block_keys(a) & names.block_keys(b)


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_different_names(a, b):
    assert not names.same_name(a, b)


def test_titles_of_all_styles_agree():
    forms = [
        "Bell, A. (1990) The mill and the widow. Leeds: North Press.", "Bell, Anna 1990, The mill and the widow, North Press, vol. 2.", "[12] A. Bell, The mill and the widow, Leeds: North Press, 1990.", "12. Bell, A. B., The mill and the widow, Leeds: North Press, 1990.",
        "Bell, A. (1990a) The mill and the wi-\ndow. Leeds: North Press.", "Bell, A. (1990) The mi1l and\n[33]\nthe widow. Leeds: North Press. Second edn.", "[12] Bell, Anna, The mlll and the widow, Leeds: North Press, 1990.",
    ]
    assert len({names.work_title(f) for f in forms}) == 1
    assert names.work_title("no comma here") == "" and names.work_title("Bell, A. (1990) ") == ""


def entry(name, title, year):
    return f"{name}, A. ({year}) {title}. Leeds: North Press."


def test_pairs_share_a_work_and_a_name(spark):
    authors = [(1, "c1", "marlowen"), (2, "c1", "marlwoen"), (3, "c1", "marlow."), (4, "c1", "karstside"), (5, "c2", "marlowen"), (6, "c1", "marlower"), (7, "c1", None), (8, "c1", ""), (9, "c1", "marlowen a."), (None, "c1", "marlowen")]
    works = {"marlowen": ["Mills and ferries", "The widow"], "Marlwoen": ["Mills and ferries"], "Marlow.": ["The widow"], "karstside": ["The widow"], "marlower": ["Other things"], "marlowen a.": ["The widow"]}
    rows = [(f"c1/d{k}.pdf", s, "1990b", entry(s, t, "1990b")) for k, (s, ts) in enumerate(works.items()) for t in ts]
    rows += [("c2/x.pdf", "marlowen", "1990", entry("marlowen", "The widow", 1990)), ("c1/y.pdf", None, None, None), ("c1/z.pdf", "", "", "x"), (None, "marlowen", "1990", "x"), ("c1/d0.pdf", "marlowen", "1990", entry("marlowen", "The widow", 1990))]
    a = spark.createDataFrame(authors, "author_id bigint, collection string, surname string").selectExpr("*", "1 AS id", "'n' AS name", "2 AS scope")
    e = spark.createDataFrame(rows, "document string, surname string, year string, raw_entry string").selectExpr("*", "'c9' AS collection")
    got = sorted((r.author_id_a, r.author_id_b) for r in names.variant_pairs(a, e).collect())
    assert got == [(1, 2), (1, 3), (1, 9), (3, 9)]
    assert names.variant_pairs(a.limit(0), e).count() == names.variant_pairs(a, e.limit(0)).count() == 0


def test_long_names_meet_in_a_block():
    import random

    r = random.Random(17)
    stems = "agricultural maritime comparative vernacular household customary industrial settlement migration northern provincial economic coastal forestry parish colonial".split()
    places = "Aldermoor Bexhamley Corvington Drelsworth Estermouth Falkenrode Grimsholm Hexleyford".split()
    heads = "Institute Society Commission Association Department Foundation Council Office".split()

    def misspelt(word):
        k = r.randrange(1, len(word) - 1)
        return r.choice([word[:k] + word[k + 1 :], word[:k] + word[k + 1] + word[k] + word[k + 2 :], word[:k] + r.choice("aeiourstln") + word[k + 1 :], word[:k] + word[k] + word[k:]])

    met = wanted = 0
    for _ in range(800):
        words = [r.choice(heads), "for", *r.sample(stems, r.choice([2, 3, 4])), "Studies", "of", r.choice(places)]
        other = list(words)
        for k in r.sample([k for k, w in enumerate(words) if len(w) > 5], r.choice([1, 2, 3])):
            other[k] = misspelt(other[k]) if r.random() < 0.7 else other[k][:4] + "."
        if r.random() < 0.3:
            other = other[-2:] + other[:-2]
        a, b = " ".join(words), " ".join(other)
        if names.same_name(a, b):
            wanted += 1
            met += bool(names.block_keys(a) & names.block_keys(b))
    assert wanted > 600 and met >= 0.995 * wanted


def test_keys_are_phonetic_and_few():
    name = "Commission for Comparative Vernacular Household and Settlement Migration Studies of Aldermoor"
    assert all(set(k) <= set("^@<>12345678") or k.strip("^@<>").isalpha() and len(k) < 5 for k in names.block_keys(name))
    assert len(names.block_keys(name)) < 500
    assert names.block_keys("haravhart") & names.block_keys("haravh.") and names.block_keys("x") is not None
