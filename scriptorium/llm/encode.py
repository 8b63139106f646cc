"""Encoding of texts with a public byte-level BPE vocabulary (problem 7).

Each text is encoded on its own, in one pass without a shuffle. A null and an empty text both give an empty
list; strings that look like special tokens are plain text. Repeated rows and rows with null ids are encoded like
any other; columns other than the two named ones are neither read nor returned.
"""

from __future__ import annotations

import base64
import importlib
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

#: Texts longer than this many characters are cut at safe boundaries first.
LONG_TEXT = 50_000

#: White space after something else: every pre-token ends there, whatever stands on either side.
SAFE_BOUNDARY = re.compile(r"(?<=\S)(?=\s)")


def vocabulary_path(name: str = "byte_bpe_50k") -> str:
    """Place of a rank file of the installed tokenizer collection."""
    return importlib.import_module("public_tokenizers").path(f"{name}.tiktoken")


@lru_cache(maxsize=4)
def load_encoding(rank_file: str):
    """The encoding of a rank file: one base64 token and its id a line. A worker reads it once for all its tasks."""
    import tiktoken

    pattern = importlib.import_module("public_tokenizers").PATTERN
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, size: int = LONG_TEXT) -> Iterator[str]:
    """Consecutive pieces of at least ``size`` characters whose encodings join to the encoding of the text."""
    start = 0
    while len(text) - start > size:
        found = SAFE_BOUNDARY.search(text, start + size)
        if found is None:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def encode_text(encoding, text: str | None, size: int = LONG_TEXT) -> list[int]:
    if not text:
        return []
    if len(text) <= size:
        return encoding.encode_ordinary(text)
    return [token for piece in safe_pieces(text, size) for token in encoding.encode_ordinary(piece)]


def decode_ids(encoding, ids: Iterable[int]) -> str:
    """Back to the text, joining raw bytes first: a character's bytes may be spread over several ids."""
    return b"".join(encoding.decode_single_token_bytes(int(i)) for i in ids).decode("utf-8")


def _shipped(df: DataFrame, rank_file: str | None) -> Callable[[], object]:
    """What gives the encoding in a task; the rank file goes to the executors through Spark's own file server."""
    path = rank_file or vocabulary_path()
    df.sparkSession.sparkContext.addFile(path)
    name = path.rsplit("/", 1)[-1]
    return lambda: load_encoding(SparkFiles.get(name))


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_file: str | None = None) -> DataFrame:
    """(id_col, ids array<int>) for every row of ``docs``."""
    shipped = _shipped(docs, rank_file)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = shipped()
        for batch in batches:
            ids = [encode_text(encoding, text) for text in batch.column(1).to_pylist()]
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            flat = np.fromiter((token for x in ids for token in x), np.int32, int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(encode, f"`{id_col}` {kind}, ids array<int>")


def decode_corpus(encoded: DataFrame, id_col: str = "doc_id", rank_file: str | None = None) -> DataFrame:
    """(id_col, text) back from ``encode_corpus``; an empty list gives an empty text."""
    shipped = _shipped(encoded, rank_file)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = shipped()
        for batch in batches:
            texts = [None if ids is None else decode_ids(encoding, ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col), F.col("ids")).mapInArrow(decode, f"`{id_col}` {kind}, text string")
