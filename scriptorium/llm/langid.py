"""Language of documents and of their paragraphs (problem 6).

Sentence-like chunks get a likelihood under a character trigram model of each language. For every document,
expectation-maximisation over its chunks estimates the proportions of the languages; a language stays in the
document's set only if it raises the penalised likelihood. A paragraph has the language of most of its chunks, with
their mean posterior probability as confidence; a document has its set of languages with their proportions.

The models start from function words and learn from a bounded sample of labelled records, whose wrong labels are
replaced by the models' own in further rounds. Null pages count as empty text. A label that names no known language
is no label. Several labels of one record: the least code counts. Empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from scriptorium.llm.common import bounded_sample
from scriptorium.llm.lexicon import FUNCTION_WORDS, LANGUAGE_NAMES, LANGUAGES

#: Labelled records in the training sample and the longest record in it: bounds on what reaches the driver.
SAMPLE_RECORDS, SAMPLE_CHARS = 2_500, 12_000
#: Labels are broadcast up to this many rows; beyond it they are joined by a shuffle.
MAX_BROADCAST_LABELS = 1_000_000
MIN_LETTERS = 30
BUCKETS = 1 << 16
ROUNDS = 2
EM_STEPS = 5
#: Trigrams overlap, so their log-likelihood counts for this share.
TEMPER = 0.35
#: A language stays in a document's set if it adds at least this log-likelihood, and half the logarithm of the number
#: of chunks: the more there are, the more of them look foreign by chance.
PENALTY = 4.0
#: A paragraph whose mean log-likelihood lies this far below its language's usual one has no language.
FOREIGN = 1.35

_CHUNK = re.compile(r"(?<=[.!?])[\"'”»)\]]*\s+|(?<=[。！？।؟])")
_PARAGRAPH = re.compile(r"\n(?:[^\S\n]*\n)+")
_NOT_LETTER = re.compile(r"[\W\d_]+")
_MARKED = re.compile(r"[^\W\d_]")
_SHORT = 16


def label_code(column: Column) -> Column:
    """The two-letter code of a label, null where it names no known language."""
    pairs = [x for code in LANGUAGES for name in (code, *LANGUAGE_NAMES[code].split()) for x in (F.lit(name), F.lit(code))]
    known = F.create_map(*pairs)
    whole = F.lower(F.trim(column))
    words = F.split(whole, r"[\s_\-(),;:/.?!\"']+", -1)
    # a code counts only as the first word; a name of a language counts anywhere, as in "Brazilian Portuguese"
    named = F.try_element_at(F.filter(words, lambda w: (F.length(w) > 3) & F.map_contains_key(known, w)), F.lit(1))
    return F.coalesce(F.try_element_at(known, whole), F.try_element_at(known, F.try_element_at(words, F.lit(1))), F.try_element_at(known, named))


def paragraphs(page: str) -> list[str]:
    """Paragraphs of a page, separated by lines that are blank."""
    return [p for p in _PARAGRAPH.split("\n" + page + "\n") if p and not p.isspace()]


def letters(text: str) -> int:
    """Characters of category L; near the least number every one is looked at, as the quick count takes in numerals."""
    n = len(_MARKED.findall(text))
    return sum(map(str.isalpha, text)) if MIN_LETTERS <= n < 2 * MIN_LETTERS else n


def chunks(paragraph: str) -> list[str]:
    """Sentence-like pieces; a piece with few letters goes with the one before it."""
    out: list[str] = []
    for piece in _CHUNK.split(paragraph):
        if not piece:
            continue
        if out and (len(piece) < _SHORT or len(out[-1]) < _SHORT):
            out[-1] += " " + piece
        else:
            out.append(piece)
    return out


def trigrams(text: str) -> np.ndarray:
    """Bucket of each trigram of the letters, words being set apart by single spaces."""
    points = np.frombuffer((" " + _NOT_LETTER.sub(" ", text.lower()) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) < 3:
        return np.empty(0, np.int64)
    h = (points[:-2] * np.uint32(0x9E3779B1)) ^ (points[1:-1] * np.uint32(0x85EBCA77)) ^ (points[2:] * np.uint32(0xC2B2AE3D))
    return ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16)).astype(np.int64)


class TrigramModels:
    """Smoothed trigram log-probabilities of each language, one row a bucket."""

    def __init__(self) -> None:
        self.counts = np.zeros((BUCKETS, len(LANGUAGES)))
        for k, lang in enumerate(LANGUAGES):
            self.add(k, FUNCTION_WORDS[lang], 3.0)
        self.usual = np.full(len(LANGUAGES), -np.inf)
        self._finish()

    def add(self, k: int, text: str, weight: float = 1.0) -> None:
        np.add.at(self.counts[:, k], trigrams(text), weight)

    def _finish(self) -> None:
        smooth = 0.02
        self.table = np.log((self.counts + smooth) / (self.counts.sum(0) + smooth * BUCKETS)).astype(np.float32)

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood of each text under each language, and the number of its trigrams."""
        return self.score_trigrams([trigrams(t) for t in texts])

    def score_trigrams(self, grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(g) for g in grams])
        out = np.zeros((len(grams), len(LANGUAGES)))
        full = np.flatnonzero(sizes)
        if len(full):
            starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
            out[full] = np.add.reduceat(self.table[np.concatenate([grams[k] for k in full])], starts, axis=0)
        return out, sizes

    def learn(self, records: list[tuple[str, list[str]]], rounds: int = ROUNDS) -> TrigramModels:
        """Learn from (label, paragraphs); after the first round each paragraph counts for the language it reads as."""
        seed = self.counts.copy()
        # the trigrams of a part are found once; a bucket's number takes two bytes
        read = [(label, [trigrams(part).astype(np.uint16) for part in parts]) for label, parts in records if parts]
        for r in range(rounds + 1):
            of: list[list[np.ndarray]] = [[] for _ in LANGUAGES]
            for label, grams in read:
                for k, own in zip(self.score_trigrams(grams)[0].argmax(1) if r else [LANGUAGES.index(label)] * len(grams), grams, strict=True):
                    of[k].append(own)
            self.counts = seed.copy()
            for k, grams in enumerate(of):
                if grams:
                    self.counts[:, k] += np.bincount(np.concatenate(grams), minlength=BUCKETS)
            self._finish()
        means: list[list[float]] = [[] for _ in LANGUAGES]
        for _, grams in read:
            score, sizes = self.score_trigrams(grams)
            for row, n in zip(score, sizes, strict=True):
                if n > 60:
                    means[int(row.argmax())].append(float(row.max() / n))
        self.usual = np.array([np.median(m) if len(m) >= 5 else -np.inf for m in means])
        return self


def infer(scores: np.ndarray, steps: int = EM_STEPS, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each chunk's language and the document's proportions, over the selected set of languages.

    Languages leave the set one by one, the one whose loss costs the least likelihood first, as long as that is less
    than the penalty; what is left of the set is estimated anew each time.
    """
    base = scores - scores.max(1, keepdims=True)
    seen = np.unique(base.argmax(1))
    likely = np.exp(base[:, seen])
    share = _proportions(likely, np.full(len(seen), 1 / len(seen)), steps)
    least = penalty + 0.5 * np.log(len(scores))
    while len(seen) > 1:
        whole = np.log((likely * share).sum(1)).sum()
        loss = []
        for k in range(len(seen)):
            rest = np.delete(share, k)
            loss.append(whole - np.log((np.delete(likely, k, 1) * (rest / max(rest.sum(), 1e-12))).sum(1) + 1e-300).sum())
        k = int(np.argmin(loss))
        if loss[k] >= least:
            break
        seen, likely, share = np.delete(seen, k), np.delete(likely, k, 1), np.delete(share, k)
        share = _proportions(likely, share / max(share.sum(), 1e-12), steps)
    joint = likely * share + 1e-300
    posterior = np.zeros_like(scores)
    posterior[:, seen] = joint / joint.sum(1, keepdims=True)
    proportions = np.zeros(scores.shape[1])
    proportions[seen] = share
    return posterior, proportions


def _proportions(likely: np.ndarray, share: np.ndarray, steps: int) -> np.ndarray:
    """The proportions of the languages after some rounds of expectation-maximisation."""
    for _ in range(steps if len(share) > 1 else 0):
        joint = likely * share + 1e-300
        share = (joint / joint.sum(1, keepdims=True)).mean(0)
    return share


class Reading:
    """A document's long paragraphs in chunks, the posterior of each chunk's language, and the proportions."""

    def __init__(self, pages: list[str | None] | None, models: TrigramModels) -> None:
        self.places: list[tuple[int, int]] = []
        self.own: list[range] = []
        texts: list[str] = []
        for p, page in enumerate(pages or [], 1):
            for q, paragraph in enumerate(paragraphs(page or ""), 1):
                if letters(paragraph) >= MIN_LETTERS:
                    parts = chunks(paragraph)
                    self.own.append(range(len(texts), len(texts) + len(parts)))
                    texts += parts
                    self.places.append((p, q))
        self.models, self.n = models, len(texts)
        if texts:
            self.scores, self.sizes = models.score(texts)
            self.posterior, self.proportions = infer(self.scores * TEMPER)

    def fits(self, rows: list[int], k: int) -> bool:
        """Whether chunks read as their language usually does, or as none of those known."""
        usual = self.models.usual[k]
        return not np.isfinite(usual) or self.scores[rows, k].sum() / max(1, self.sizes[rows].sum()) >= usual - FOREIGN

    def paragraphs(self) -> Iterator[tuple[int, int, str, float]]:
        """(page_no, para_no, lang, confidence) of each paragraph that reads as a language."""
        for (p, q), chunk in zip(self.places, self.own, strict=True):
            rows = list(chunk)
            votes = self.posterior[rows].sum(0)
            k = int(votes.argmax())
            if self.fits([i for i in rows if self.posterior[i, k] > 0.5] or rows, k):
                yield p, q, LANGUAGES[k], float(votes[k] / len(rows))

    def languages(self) -> Iterator[tuple[str, float, float]]:
        """(lang, share, confidence) of the document's set of languages; the share is that of its trigrams."""
        if not self.n:
            return
        best = self.posterior.argmax(1)
        weight = self.posterior * self.sizes[:, None]
        for k in np.flatnonzero(self.proportions > 0):
            mine = np.flatnonzero(best == k)
            if len(mine) and self.fits(mine.tolist(), k):
                yield LANGUAGES[k], float(weight[:, k].sum() / max(1, self.sizes.sum())), float(self.posterior[mine, k].mean())


def read_document(pages: list[str | None] | None, models: TrigramModels) -> list[tuple[int, int, str, float]]:
    """(page_no, para_no, lang, confidence) of each paragraph that is long enough and reads as a language."""
    return list(Reading(pages, models).paragraphs())


def coded_labels(labels: DataFrame) -> DataFrame:
    """(cache_id, label): one row a record, null where no label is useful."""
    return labels.where("cache_id IS NOT NULL").select(F.col("cache_id").cast("bigint").alias("cache_id"), label_code(F.col("lang").cast("string")).alias("label")).groupBy("cache_id").agg(F.min("label").alias("label"))


def train(labelled: DataFrame) -> TrigramModels:
    size = F.aggregate("pages", F.lit(0), lambda n, p: n + F.coalesce(F.length(p), F.lit(0)))
    known = labelled.where(F.col("label").isNotNull() & (size <= SAMPLE_CHARS))
    rows = bounded_sample(known, "cache_id", SAMPLE_RECORDS, known.count()).select("label", "pages").collect()
    return TrigramModels().learn([(r["label"], [p for page in r["pages"] for p in paragraphs(page or "") if letters(p) >= MIN_LETTERS]) for r in rows])


def _read(records: DataFrame, labels: DataFrame, take: Callable[[Reading], Iterator[tuple]], columns: dict[str, pa.DataType], kinds: str) -> DataFrame:
    """Rows (cache_id, label, ...) of what is taken of the readings of the labelled records."""
    coded = coded_labels(labels)
    n = labels.count()
    few = n <= MAX_BROADCAST_LABELS
    labelled = records.select(F.col("cache_id").cast("bigint").alias("cache_id"), "pages").join(F.broadcast(coded) if few else coded, "cache_id").select("cache_id", "label", "pages")
    shared = records.sparkSession.sparkContext.broadcast(train(labelled))
    fields = {"cache_id": pa.int64(), "label": pa.string()} | columns

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(key, label, *found) for key, label, pages in zip(*(c.to_pylist() for c in batch.columns), strict=True) for found in take(Reading(pages, shared.value))]
            values = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(values, fields.values(), strict=True)], names=list(fields))

    return labelled.mapInArrow(read, f"cache_id bigint, label string, {kinds}")


def paragraph_languages(records: DataFrame, labels: DataFrame) -> DataFrame:
    """(cache_id, label, page_no, para_no, lang, confidence) of the paragraphs of labelled records."""
    columns = {"page_no": pa.int32(), "para_no": pa.int32(), "lang": pa.string(), "confidence": pa.float64()}
    return _read(records, labels, Reading.paragraphs, columns, "page_no int, para_no int, lang string, confidence double")


def document_languages(records: DataFrame, labels: DataFrame) -> DataFrame:
    """(cache_id, label, lang, share, confidence): the set of languages of every labelled record, with their proportions."""
    columns = {"lang": pa.string(), "share": pa.float64(), "confidence": pa.float64()}
    return _read(records, labels, Reading.languages, columns, "lang string, share double, confidence double")


def mislabelled(records: DataFrame, labels: DataFrame) -> DataFrame:
    """Paragraphs in another language than the record's label, or of records without a useful one."""
    found = paragraph_languages(records, labels)
    return found.where(F.col("label").isNull() | (F.col("label") != F.col("lang"))).select("cache_id", "page_no", "para_no", "lang", "confidence")
