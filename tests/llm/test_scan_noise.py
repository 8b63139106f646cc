from __future__ import annotations

import random

import pytest

from scriptorium.llm import scan_noise as N

WORDS = "the of and a council ferry between without consent framework described history rural market seminar widow customary printer journal tenant library village because orchard pasture".split()


@pytest.fixture(scope="module")
def words():
    counts = dict.fromkeys(WORDS, 500) | {"land": 300, "holding": 300, "land-holding": 200, "wage-work": 150, "landlord": 150, "eine": 400, "mühle": 100}
    return N.Lexicon(counts, 10)


def test_misread_words(words):
    for wrong, right in (("bctween", "between"), ("c0uncil", "council"), ("fra rnework".replace(" ", ""), "framework"), ("liistory", "history"), ("joumal", "journal"), ("mar1cet".replace("1c", "k"), "market"), ("jourrial", "journal"), ("serninar", "seminar")):
        if wrong == right:
            continue
        assert words.misread(wrong) is not None, wrong
        assert words.repaired(wrong) == right
    assert words.misread("between") is words.misread("unheard") is words.misread("1900") is None


def test_broken_words(words):
    lines = ["the coun-", "cil of the land-", "holding and wage-", "work in Astons-", "Belford was cus¬", "tomary a", "last line-"]
    assert N.broken_words(lines, list(range(len(lines))), words) == {0, 4}


@pytest.mark.parametrize(("line", "is_number"), [("12", True), ("– 12 –", True), ("[xiv]", True), ("p. 9", True), ("Page 203", True), ("3 / 40", True), ("·7·", True), ("9.", False), ("9).", False), ("it.", False), ("1984)", False), ("civil", False), ("d", False), ("12 ferries", False), ("–", False)])
def test_page_numbers(line, is_number):
    assert N.is_page_number(line) == is_number


def scan(seed=1, pages=5):
    r = random.Random(seed)
    out = []
    for p in range(pages):
        body, line = [], ""
        for _ in range(140):
            w = r.choice(WORDS)
            if len(line) + len(w) > 62:
                body.append(line)
                line = ""
            line = f"{line} {w}".strip()
        out.append("\n".join([("THE WIDOW OF ASTON" if p % 2 else "Marlow, J. B."), *body, line + ".", f"– {31 + p} –"]))
    return out


def test_headers_and_numbers_of_a_scan(words):
    found = set(N.record_noise(scan(), words, N.LineModel()))
    for p, page in enumerate(scan(), 1):
        assert (p, 1, "header") in found
        assert (p, page.count("\n") + 1, "page_number") in found
    assert {k for _, _, k in found} == {"header", "page_number"}


def test_plain_pages_have_no_noise(words):
    pages = ["The Old Ferry\n\nThe council described the ferry without consent.\n\nA widow and a printer described it.", "Reading list\n\nBell, A. (1990) The ferry of Aston. Leeds: North Press.", "", " \n "]
    assert N.record_noise(pages, words, N.LineModel()) == []
    assert N.record_noise(None, words, N.LineModel()) == N.record_noise([], words, N.LineModel()) == []


def test_entries(words):
    entry = "Bell, A. (1990) The widow and the coun-\n[334]\ncil without c0nsent. Leeds: Norfh Press."
    assert sorted(N.entry_noise(entry, words)) == [(1, "hyphen"), (2, "page_number"), (3, "misread")]
    assert N.entry_noise("Bell, A. 1990, The ferry,\nREFERENCES 12\nNorth Press.", words) == [(2, "header")]
    assert N.entry_noise("12. A. Bell, The rural markct, Leeds: North Press, 1990.", words) == [(1, "misread")]
    assert N.entry_noise("Bcll, A. (1990) The rural market, vol.\n6.", words) == []
    assert N.entry_noise(None, words) == N.entry_noise("", words) == N.entry_noise(" \n", words) == []


def test_text_is_put_together(words):
    pages = scan(2, 3)
    text = N.repaired_text([pages[0], pages[1].replace("between", "bctween"), pages[2]], words, N.LineModel())
    assert "WIDOW" not in text and "–" not in text and "bctween" not in text
    assert N.repaired_text(None, words, N.LineModel()) == ""
    assert N.repaired_text(["the coun-\ncil of the land-\nholding"], words, N.LineModel()) == "the council of the land-holding"


def test_tables(spark):
    records = [(k, scan(k, 3)) for k in range(40)] + [(100, None), (101, []), (102, [None, ""]), (103, [scan(9, 1)[0].replace("council", "c0uncil")]), (0, scan(0, 3)), (104, ["word " * 40_000])]
    entries = [(k, f"Bell, A. (19{k:02}) The council and the widow. Leeds: North Press.") for k in range(60)] + [(100, None), (101, ""), (102, "Bell, A. (1990) The c0uncil of the widow. Leeds: North Press."), (None, "x")]
    r = spark.createDataFrame(records, "cache_id bigint, pages array<string>").selectExpr("*", "1 AS kind", "2 AS word")
    e = spark.createDataFrame(entries, "entry_id bigint, raw_entry string").selectExpr("*", "'x' AS pages")
    got = [tuple(x) for x in N.find_noise(r, e).collect()]
    assert len(got) == len(set(got))
    assert ("page", 0, 1, 1, "header") in got and ("entry", 102, 0, 1, "misread") in got
    assert any(x[:2] == ("page", 103) and x[4] == "misread" for x in got)
    assert not [x for x in got if x[1] in (100, 101) or x[:2] == ("page", 104)]
    assert N.find_noise(r.limit(0), e.limit(0)).count() == 0
    texts = {x.cache_id: x.text for x in N.repair_pages(r, e).collect()}
    assert texts[100] == texts[101] == texts[102] == "" and "c0uncil" not in texts[103]


def test_entries_are_put_together(words):
    assert N.repaired_entry("Bcll, A. (1990) The widow and the coun-\n[334]\ncil without c0nsent. Leeds: North Press.", words) == "Bcll, A. (1990) The widow and the council without consent. Leeds: North Press."
    assert N.repaired_entry("Bell, A. 1990, The ferry,\nREFERENCES 12\nland-\nholding.", words) == "Bell, A. 1990, The ferry, land-holding."
    assert N.repaired_entry("Bell, A. (1990) Bctween the c0uncil and Aston. Leeds", words) == "Bell, A. (1990) Between the council and Aston. Leeds"
    assert N.repaired_entry(None, words) == N.repaired_entry(" \n", words) == ""


def test_every_record_and_entry_has_a_text(spark):
    from scriptorium.llm import catalog

    r = spark.createDataFrame([(k, scan(k, 2)) for k in range(30)] + [(100, None)], "cache_id bigint, pages array<string>")
    e = spark.createDataFrame([(k, "Bell, A. (1990) The council of the vil-\nlage. Leeds: North Press.") for k in range(40)] + [(100, None)], "entry_id bigint, raw_entry string")
    texts = {(x.source, x.record_id): x.text for x in N.repair_texts(r, e).collect()}
    assert set(texts) == {("page", k) for k in [*range(30), 100]} | {("entry", k) for k in [*range(40), 100]}
    assert texts["entry", 7] == "Bell, A. (1990) The council of the village. Leeds: North Press." and texts["entry", 100] == ""
    assert "repair_texts" in catalog.p4_text.__code__.co_names


def test_decoding_finds_the_likeliest_path():
    import itertools

    import numpy as np

    model, r = N.LineModel(), random.Random(4)
    rows = lambda n: [tuple(r.randrange(table.shape[1]) for table in model.start) for _ in range(n)]
    sequences = [rows(n) for n in (1, 4, 3, 5, 1, 2, 4)] + [[]]

    def score(seq, path):
        emitted = sum(float(table[s, v]) for row, s in zip(seq, path, strict=True) for table, v in zip(model.log_tables, row, strict=True))
        return float(model.log_first[path[0]]) + emitted + sum(float(model.log_moves[a, b]) for a, b in itertools.pairwise(path))

    for seq, path in zip(sequences, model.label_all(sequences), strict=True):
        if seq:
            best = max(score(seq, q) for q in itertools.product(range(5), repeat=len(seq)))
            assert np.isclose(score(seq, path), best)
    assert model.label_all(sequences)[-1] == []
    long = rows(30_000)
    assert len(model.label(long)) == 30_000


def test_every_table_is_learned():
    import numpy as np

    model = N.LineModel().train(N.page_sequences([scan(k, 4) for k in range(60)]))
    assert all(abs(a - b).max() > 0.001 for a, b in zip(model.tables, model.start, strict=True))
    assert np.allclose([table.sum(1) for table in model.tables], 1, atol=1e-4) and np.allclose(model.moves.sum(1), 1)
    entries = N.entry_model().train([N.entry_features(e.split("\n")) for e in ["Bell, A. (1990) The\n– 12 –\nferry. Leeds.", "Cole, B. (1991) One\ntwo."] * 400])
    assert entries.label(N.entry_features(["Bell, A. (1990) The", "References 7", "ferry."])) == [N.BREAK, N.HEADER, N.BODY]
    assert N.LineModel().train([]).label([]) == []


def test_inner_lines_have_features_of_their_own(words):
    page = "\n".join(["The council of the village described the ferry without consent and"] * 6 + ["The Old Ferry", "", "the tenant because the council described the ferry without conse-"] + ["quence of the council and the widow and the tenant of the village"] * 6)
    rows = N.features([N.Page(page)])[0]
    assert len(set(rows[3:-2])) > 1
    listed = "\n".join(["Bibliography"] + ["Bell, A. (1990) The council and the widow of the village", "221", "without consent. Leeds: North Press."] * 6)
    found = N.record_noise([listed], words, N.LineModel())
    assert {(p, k) for p, k, kind in found if kind == "page_number"} == {(1, k) for k in range(3, 20, 3)}
