from __future__ import annotations

import importlib

import pytest
from hypothesis import given, settings, strategies as st

from scriptorium.llm import encode

TEXTS = ["", "plain words, don't they're 12 345", "<|endoftext|> is text", "  two  spaces \n\n\ttab ", "é ñ 日本語 ไทย हिन्दी 👩‍👩‍👧 ​­", "á ﻿ \x00 \x1f", " " * 3000, "ab" * 3000, "'s't 're", "\r\n\r\n"]


@pytest.fixture(scope="module")
def encoding():
    return encode.load_encoding(encode.vocabulary_path())


@pytest.fixture(scope="module")
def reference():
    tokenizers = importlib.import_module("tokenizers")
    t = tokenizers.Tokenizer.from_file(importlib.import_module("public_tokenizers").path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_same_ids_as_the_other_library(encoding, reference):
    for text in TEXTS:
        assert encode.encode_text(encoding, text) == reference.encode(text, add_special_tokens=False).ids, text[:20]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200), st.integers(1, 30))
def test_cutting_changes_nothing_and_decoding_returns(encoding, text, size):
    assert "".join(encode.safe_pieces(text, size)) == text
    ids = encode.encode_text(encoding, text, 10**9)
    assert encode.encode_text(encoding, text, size) == ids
    assert encode.decode_ids(encoding, ids) == text


def test_tables(spark):
    rows = [(k, t) for k, t in enumerate([*TEXTS, None, "word " * 60_000, TEXTS[1]])] + [(None, "x"), (0, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'clash' AS ids", "1 AS id")
    got = encode.encode_corpus(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.ids for r in got}
    assert by[0] == by[len(TEXTS)] == []
    assert by[1] == by[len(TEXTS) + 2]
    back = {r.doc_id: r.text for r in encode.decode_corpus(encode.encode_corpus(df)).collect()}
    assert back[4] == TEXTS[4] and back[len(TEXTS) + 1] == "word " * 60_000
    assert encode.encode_corpus(df.limit(0)).count() == 0
