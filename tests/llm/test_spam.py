from __future__ import annotations

import random

import numpy as np
import pytest

from scriptorium.llm import spam
from scriptorium.llm.bagging import BaggedTrees

NOUNS = "harbour mill ferry orchard ledger bridge meadow chapel tannery quarry weir lantern market cellar granary".split()
NAMES = "Aston Bexley Corby Darley Epsom Frome Grantham Hexham Ilkley Jarrow Kendal Ludlow Malton Newark Oakham".split()


def prose(r, n):
    out = []
    for _ in range(n):
        out.append(f"The {r.choice(NOUNS)} of {r.choice(NAMES)} {r.choice(['was sold to', 'stood near', 'kept', 'outlived'])} the {r.choice(NOUNS)}, and {r.choice(['nobody', 'the clerk', 'each family'])} in {r.choice(NAMES)} {r.choice(['knew', 'wrote down', 'forgot'])} {r.choice(['why', 'the price', 'its age'])} between {r.randrange(1700, 1900)} and {r.randrange(1900, 2000)}.")
    return " ".join(out)


def keywords(r, n):
    own = r.sample(["cheap shoes", "buy shoes", "best price", "shoes online", "free offer"], 3)
    return r.choice([", ", "; ", " | ", "\n", " "]).join(r.choices(own, k=n))


def links(r, n):
    return "\n".join(f"- https://www.{r.choice(NOUNS)}{r.randrange(99)}.example/{r.choice(NOUNS)}?id={r.randrange(9999)}" for _ in range(n))


def tagged(r, n):
    return " ".join(f"#{r.choice(['buy', 'free', 'best'])}{r.choice(NOUNS).title()}" for _ in range(n))


def adverts(r, n):
    return " ".join(r.choice(["Need shoes in {}?", "Shoes {} today!", "Best shoes in {}."]).format(r.choice(NAMES)) for _ in range(n))


def products(r, n):
    return "\n".join(f"{r.choice(NOUNS).title()} shoes – {r.uniform(5, 90):.2f} – {r.choice(['free', 'fast'])} – SKU {r.randrange(10000, 99999)}" for _ in range(n))


def bibliography(r, n):
    return "References\n" + "\n".join(f"{r.choice(NAMES)}, {r.choice('ABC')}. ({r.randrange(1900, 2015)}) The {r.choice(NOUNS)} and the {r.choice(NOUNS)}. {r.choice(NAMES)}: North Press. https://{r.choice(NOUNS)}.example/{r.randrange(9999)}" for _ in range(n))


def pages(seed, n):
    r = random.Random(seed)
    out = []
    for k in range(n):
        kind = r.choice([keywords, links, tagged, adverts, products])
        if k % 3 == 0:
            out.append((kind(r, r.randrange(40, 90)), True))
        elif k % 3 == 1:
            out.append((prose(r, r.randrange(3, 12)) if r.random() < 0.7 else bibliography(r, r.randrange(5, 15)), False))
        else:
            few = kind(r, 5)
            out.append((prose(r, 9) + "\n\n" + few, False) if r.random() < 0.5 else (prose(r, 2) + "\n\n" + kind(r, 80), True))
    return out


@pytest.fixture(scope="module")
def trees():
    return spam.train([t for t, _ in pages(1, 400)])


def test_held_out_pages(trees):
    held = [p for p in pages(2, 300) if len(p[0]) >= spam.MIN_CHARS]
    shares = spam.spam_share([t for t, _ in held], trees)
    right = sum((s > 0.5) == label for s, (_, label) in zip(shares, held, strict=True))
    assert right / len(held) > 0.97


def test_repetition_with_a_period_longer_than_a_block(trees):
    r = random.Random(6)
    line = "Our family firm repairs roofs and gutters in {} at short notice, with honest estimates and a written guarantee, so call the office today and ask for a free visit this week."
    words = [f"{a}{b}" for a in "cheap best fine used rare bold".split() for b in "shoes boots tiles lamps pens rugs bags coats".split()]
    stuffed = [gap.join(map(line.format, NAMES[:12])) for gap in (" ", "\n", "\n\n")] + [" ".join(words * 6), " ".join(r.choices(words, k=300)), prose(r, 3) + "\n\n" + " ".join(map(line.format, NAMES))]
    assert min(spam.spam_share(stuffed, trees)) > 0.5
    fair = [prose(r, 12), prose(r, 9) + "\n\n" + "\n".join(map(line.format, NAMES[:2])), bibliography(r, 15), "\n\n".join([prose(r, 4)] * 2), prose(r, 6) + "\n" + "\n".join(f"{w} {'.' * 60} {k}" for k, w in enumerate(NOUNS[:6]))]
    assert max(spam.spam_share(fair, trees)) < 0.5


def test_blocks_keep_every_character():
    r = random.Random(3)
    text = prose(r, 20) + "\n\n" + keywords(r, 80) + "\n \n\nshort\n\nshort too"
    kept = "".join("".join(spam.blocks(text)).split())
    assert kept == "".join(text.split())
    assert spam.blocks("") == spam.blocks(" \n \n") == []


def test_table_with_nulls_hosts_and_long_texts(spark):
    r = random.Random(5)
    rows = [(k, t, f"host{k % 4}" if k % 5 else None) for k, (t, _) in enumerate(pages(4, 160))]
    rows += [(900, None, "h"), (901, "", "h"), (902, " " * 500, "h"), (903, "buy now " * 20_000, "h"), (904, "x" * 5000, None), (905, keywords(r, 10)[:150], "h"), (None, keywords(r, 90), "h"), (3, rows[3][1], "host3")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 AS host", "2 AS share")
    got = {r.doc_id for r in spam.find_spam(df).collect()}
    expected = {k for k, (t, label) in enumerate(pages(4, 160)) if label and len(t) >= spam.MIN_CHARS}
    assert 903 in got and not got & {900, 901, 902, 904, 905}
    assert len(got ^ (expected | {903, None})) <= 3
    assert spam.find_spam(df.limit(0)).count() == 0
    assert spam.find_spam(df.where("doc_id = 904")).count() == 0


def test_bagged_trees_learn_a_rule():
    x = np.random.default_rng(0).random((2000, 4))
    y = ((x[:, 1] > 0.6) ^ (x[:, 3] < 0.2)).astype(int)
    model = BaggedTrees(15, 6).fit(x[:1500], y[:1500])
    assert ((model.predict(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
    assert len(model.predict(np.empty((0, 4)))) == 0


def test_trees_decide_what_the_rules_leave_open(trees):
    held = [p for p in pages(12, 400) if len(p[0]) >= spam.MIN_CHARS]
    cut_up = [spam.blocks(t) for t, _ in held]
    labels = iter([spam.weak_label(f, b) for f, b in zip(spam.page_features(cut_up), [b for p in cut_up for b in p], strict=True)])
    by_rules = []
    for page in cut_up:
        own = [(next(labels), len(b)) for b in page]
        by_rules.append(2 * sum(n for label, n in own if label) > sum(n for _, n in own))
    by_trees = [s > 0.5 for s in spam.spam_share([t for t, _ in held], trees)]
    right = lambda found: sum(f == label for f, (_, label) in zip(found, held, strict=True))
    assert by_rules != by_trees and right(by_trees) > right(by_rules)


def test_a_host_moves_pages_in_doubt_and_no_others(spark):
    rows = [(k, "bad", 0.98) for k in range(300)] + [(1000 + k, "good", 0.01) for k in range(3000)] + [(5000 + k, None, 0.02) for k in range(2000)]
    doubt = [(1, "bad", 0.4), (2, "good", 0.6), (3, None, 0.6), (4, None, 0.4), (5, "bad", 0.1), (6, "good", 0.9), (7, "new", 0.45), (8, "new", 0.55)]
    scores = spark.createDataFrame([(100_000 + k, h, s) for k, h, s in doubt] + rows, "doc_id bigint, host string, share double")
    found = {r.doc_id - 100_000 for r in spam.smoothed(scores).collect() if r.doc_id >= 100_000}
    assert {1, 3, 6, 8} <= found and not found & {4, 5, 7} and 2 not in found
    # whatever way the rates come to the pages
    assert sorted(spam.smoothed(scores, max_broadcast=0).collect()) == sorted(spam.smoothed(scores).collect())
    assert spam.smoothed(scores.limit(0)).count() == 0


def test_features_that_no_rule_reads(trees):
    import inspect

    assert not any(f'"{name}"' in inspect.getsource(spam.weak_label) for name in spam.LEARNT)
    used = {f for tree in trees.trees for f in tree.feature if f >= 0}
    assert used & {spam.FEATURES.index(name) for name in spam.LEARNT}
