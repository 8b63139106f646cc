"""Evaluation passages inside training documents (problem 8).

The word windows of the evaluation items form a hash set that every task holds; each document is scanned once, and
hits are verified word by word. Up to MAX_INDEX_CHARS characters of items the whole index is broadcast, as sorted
arrays, and nothing is shuffled. Beyond that a bit filter of bounded size is broadcast instead, and only the windows
that pass it are joined with those of the items; both ways give the same rows, in one scan of the documents.

Null, blank and short texts on either side give no rows; repeated ids give one row a pair; columns other than the
named ones are ignored.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from scriptorium.llm.common import measured

#: Consecutive words that make a leak.
WINDOW = 12
#: Characters of evaluation text in a broadcast index. A word takes at least two of them and INDEX_BYTES in the index.
MAX_INDEX_CHARS = 8_000_000
INDEX_BYTES = 24
#: Bits of the filter for larger sets of items, as a power of two: at least, at most, and for each window of the items.
LEAST_BITS, MOST_BITS, BITS_A_WINDOW = 20, 28, 3
#: Bits in one piece of a bitmap, as the engine's bitmap functions cut it.
PIECE_BITS = 32_768

FORMAT_CHARACTERS = "".join(chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cf")
_FORMAT = re.compile(f"[{re.escape(FORMAT_CHARACTERS)}]+")
_WORD = re.compile(r"[^\W_]+")
_SPACE = re.compile(r"\S+")


def normalised_words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits after NFKC, removal of format characters and lower-casing."""
    if not text:
        return []
    if not text.isascii():
        text = _FORMAT.sub("", unicodedata.normalize("NFKC", text))
    return _WORD.findall(text.lower())


def word_hashes(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of some texts, one after the other, and where each text begins, with the end."""
    begins = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(words) for words in texts], out=begins[1:])
    coded = pa.array([w for words in texts for w in words], pa.string()).dictionary_encode()
    known = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    return known[coded.indices.to_numpy()] if len(known) else np.empty(0, np.uint64), begins


def window_hashes(words: np.ndarray, begins: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every window that lies within one text, and the place of its first word."""
    n = max(0, len(words) - window + 1)
    total = np.zeros(n, np.uint64)
    for k in range(window):
        total = total * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
    ends = np.repeat(begins[1:], np.diff(begins))[:n]
    places = np.flatnonzero(np.arange(n) + window <= ends)
    total = total[places]
    return total ^ (total >> np.uint64(29)), places


class WindowIndex:
    """All word windows of a bounded set of items, in arrays sorted by hash."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW) -> None:
        self.window = window
        self.item_ids = np.array([key for key, _ in items], np.int64)
        self.words, self.begins = word_hashes([normalised_words(text) for _, text in items])
        hashes, places = window_hashes(self.words, self.begins, window)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.places = hashes[order], places[order]
        self.bits = 1 << min(24, max(10, (16 * len(hashes)).bit_length()))
        self.filter = np.zeros(self.bits, bool)
        self.filter[(self.hashes & np.uint64(self.bits - 1)).astype(np.int64)] = True

    def size(self) -> int:
        """Bytes of the arrays whose length follows the items."""
        return sum(x.nbytes for x in (self.words, self.hashes, self.places))

    def hits(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place in the list of documents, first word of the window, and item id of every verified hit."""
        words, begins = word_hashes(docs)
        found, places = window_hashes(words, begins, self.window)
        likely = np.flatnonzero(self.filter[(found & np.uint64(self.bits - 1)).astype(np.int64)])
        first = np.searchsorted(self.hashes, found[likely], "left")
        times = np.searchsorted(self.hashes, found[likely], "right") - first
        at = np.repeat(places[likely], times)
        of = self.places[np.repeat(first - np.cumsum(times) + times, times) + np.arange(times.sum())]
        same = np.ones(len(at), bool)
        for k in range(self.window):
            same &= words[at + k] == self.words[of + k]
        at, of = at[same], of[same]
        doc = np.searchsorted(begins, at, "right") - 1
        return doc, at - begins[doc], self.item_ids[np.searchsorted(self.begins, of, "right") - 1]


def _used(items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    return items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("bigint").alias("item_id"), F.col(item_text).alias("item_text")).distinct()


def _broadcast_index(used: DataFrame, window: int, max_chars: int):
    """The items' index as a broadcast variable, or None if they are more than fit in one."""
    _, chars = measured(used, "item_text")
    if chars > max_chars:
        return None
    return used.sparkSession.sparkContext.broadcast(WindowIndex([(r[0], r[1]) for r in used.collect()], window))


def _grams(texts: list[list[str]], window: int, bits: np.ndarray | None) -> Iterator[tuple[int, int, int, str]]:
    """Text's place, first word, hash and words of every window, or of those that pass a filter."""
    words, begins = word_hashes(texts)
    found, places = window_hashes(words, begins, window)
    if bits is not None:
        low = found & np.uint64(8 * len(bits) - 1)
        kept = np.flatnonzero((bits[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8)) & 1)
        found, places = found[kept], places[kept]
    owner = np.searchsorted(begins, places, "right") - 1
    for doc, at, hashed in zip(owner.tolist(), (places - begins[owner]).tolist(), found.view(np.int64).tolist(), strict=True):
        yield doc, at, hashed, " ".join(texts[doc][at : at + window])


def _item_windows(used: DataFrame, window: int) -> DataFrame:
    """(item_id, hash, gram) of all windows of the items."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            rows = [(keys[doc], hashed, gram) for doc, _, hashed, gram in _grams([normalised_words(t) for t in batch.column(1).to_pylist()], window, None)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["item_id", "hash", "gram"])

    return used.mapInArrow(cut_up, "item_id bigint, hash bigint, gram string").distinct()


def _filter_bits(windows: DataFrame) -> np.ndarray:
    """A bit for every window of the items; its size follows their number, up to a bound."""
    size = min(MOST_BITS, max(LEAST_BITS, windows.count().bit_length() + BITS_A_WINDOW))
    low = F.col("hash").bitwiseAND(F.lit((1 << size) - 1))
    pieces = windows.select(F.floor(low / PIECE_BITS).alias("piece"), (low % PIECE_BITS).alias("bit")).groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    out = np.zeros(1 << (size - 3), np.uint8)
    for piece, bits in pieces:
        out[piece * PIECE_BITS // 8 : (piece + 1) * PIECE_BITS // 8] = np.frombuffer(bits, np.uint8)
    return out


def _candidates(docs: DataFrame, bits: np.ndarray, window: int) -> DataFrame:
    """(key, start, hash, gram) of the windows of ``docs`` (key string, text) that pass the filter."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            rows = [(keys[doc], *rest) for doc, *rest in _grams([normalised_words(t) for t in batch.column(1).to_pylist()], window, shared.value)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.string()), strict=True)], names=["key", "start", "hash", "gram"])

    return docs.mapInArrow(scan, "key string, start int, hash bigint, gram string")


def find_leaks(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", max_chars: int = MAX_INDEX_CHARS
) -> DataFrame:
    """Distinct (doc_id, item_id): the document has ``window`` consecutive words of the item."""
    used = _used(items, item_id, item_text)
    named = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(doc_text).alias("text"))
    index = _broadcast_index(used, window, max_chars)
    if index is None:
        windows = _item_windows(used, window)
        met = _candidates(named.select(F.col("doc_id").cast("string").alias("key"), "text"), _filter_bits(windows), window).select("key", "hash", "gram").distinct()
        return met.join(windows, ["hash", "gram"]).select(F.col("key").cast("bigint").alias("doc_id"), "item_id").distinct()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            doc, _, item = index.value.hits([normalised_words(t) for t in batch.column(1).to_pylist()])
            pairs = np.unique(np.stack([ids[doc], item], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], names=["doc_id", "item_id"])

    return named.mapInArrow(scan, "doc_id bigint, item_id bigint").distinct()


def token_words(text: str) -> tuple[list[tuple[int, int]], list[str], list[int]]:
    """Spans of the white-space tokens, their normalised words, and each word's token."""
    spans, words, owner = [], [], []
    for k, m in enumerate(_SPACE.finditer(text)):
        spans.append(m.span())
        own = normalised_words(m.group())
        words += own
        owner += [k] * len(own)
    return spans, words, owner


def without_windows(text: str, starts: set[int], window: int) -> tuple[str, int]:
    """A text without the white-space tokens of the windows that begin at the given words, and the number of words gone."""
    gone = {k for start in starts for k in range(start, start + window)}
    spans, _, owner = token_words(text)
    kept, at = [], 0
    for t in sorted({owner[k] for k in gone if k < len(owner)}):
        kept.append(text[at : spans[t][0]])
        at = spans[t][1]
    return "".join([*kept, text[at:]]).strip(), len(gone)


def remove_leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", max_chars: int = MAX_INDEX_CHARS) -> DataFrame:
    """(doc_id, text, removed_words): every document, its leaked passages cut out in whole white-space tokens.

    All hits are found on the original text and cut out together. A document that is one leaked passage comes out with
    an empty text; a null text stays null.
    """
    used = _used(items, item_id, item_text)
    named = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(doc_text).alias("text"))
    index = _broadcast_index(used, window, max_chars)
    schema, names = "doc_id bigint, text string, removed_words int", ["doc_id", "text", "removed_words"]

    def cut_out(ids: pa.Array, texts: list[str | None], starts: dict[int, set[int]]) -> pa.RecordBatch:
        removed = [0] * len(texts)
        for d, own in starts.items():
            texts[d], removed[d] = without_windows(texts[d], own, window)
        return pa.RecordBatch.from_arrays([ids, pa.array(texts, pa.string()), pa.array(removed, pa.int32())], names=names)

    if index is None:
        # a row goes by its id and its text, as ids may repeat
        keyed = named.withColumn("key", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))))
        windows = _item_windows(used, window)
        met = _candidates(keyed.select("key", "text"), _filter_bits(windows), window).join(windows.select("hash", "gram").distinct(), ["hash", "gram"], "left_semi")
        starts = met.groupBy("key").agg(F.collect_set("start").alias("starts"))  # at most the words of a text

        def clean_found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield cut_out(batch.column(0), batch.column(1).to_pylist(), {d: set(own) for d, own in enumerate(batch.column(2).to_pylist()) if own})

        return keyed.join(starts, "key", "left").select("doc_id", "text", "starts").mapInArrow(clean_found, schema)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            doc, start, _ = index.value.hits([normalised_words(t) for t in texts])
            starts: dict[int, set[int]] = {}
            for d, k in zip(doc.tolist(), start.tolist(), strict=True):
                starts.setdefault(d, set()).add(k)
            yield cut_out(batch.column(0), texts, starts)

    return named.mapInArrow(clean, schema)
