"""Keyword-stuffed and link-list pages (problem 9).

A page is cut into blocks at blank lines. Rules give weak labels to the blocks they are sure of, and to no others.
Bagged trees, trained from these labels on content and link features of a bounded sample of pages, decide every block:
they also see features that no rule uses, and so judge what the rules leave open. A page's share is that of its
characters in blocks that the trees call spam, and its log-odds are smoothed by the rate of spam of its host.

Repetition is measured in the block and over the whole page, as its period may be longer than a block: a block also
has the share of its runs of characters and of its segments that recur on the page, and the variety of the page's words.

Null, blank and short texts are no case. A null host takes the rate of the whole corpus. Repeated rows are scored
one by one. Pages of any length are read whole.
A block of fewer than three words without a link repeats no keywords and is no spam, however long it is.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scriptorium.llm.bagging import BaggedTrees
from scriptorium.llm.common import bounded_sample, cut
from scriptorium.llm.lexicon import FUNCTION_WORDS

MIN_CHARS = 200
#: Pages in the training sample, and the longest page in it: at most 42 blocks a page reach the driver, as their features.
SAMPLE_PAGES, SAMPLE_CHARS = 6_000, 10_000
#: Shorter neighbouring blocks are read as one; longer blocks are read in pieces of about this size.
SHORT_BLOCK, PIECE = 120, 240
#: Runs of so many characters are looked up on the whole page.
RUN = 12
#: A run recurs if the page has it so often, and once in so many characters: natural texts repeat any run some day.
LEAST_RUNS, RUN_PERIOD = 3, 2_000
#: Different words of a text of n words grow about as this power of n.
VARIETY_POWER = 0.75
#: Characters of pages whose runs are sorted at once; a longer page is sorted alone.
SORTED_CHARS = 50_000
#: Trees, and the share of the features that each of them sees: about their square root.
TREES, FEATURE_SHARE = 31, 0.2
#: Weight of the host's log-odds (beside those of the corpus, HOST_MOST at most either way) against the page's, and
#: pages of the corpus' rate added to each host's own.
HOST_WEIGHT, HOST_MOST, HOST_PRIOR = 0.8, 2.0, 50
#: Steepness of the page's log-odds around half of its characters: a host can move a page by 0.2 of them.
STEEP = 8.0
#: Rates of hosts are broadcast up to this number; beyond it they are joined, each host spread over SALTS keys.
MAX_BROADCAST_HOSTS, SALTS = 1_000_000, 16

_BLANK = re.compile(r"\n[^\S\n]*\n\s*")
_GAP = re.compile(r"\s+(?=\S)")
_LINK = re.compile(r"<a\s[^>]*>.*?</a>|<a\s[^>]*>?|(?:https?://|www\.)[^\s<>\"]+", re.S)
_TAG = re.compile(r"(?<!\S)#[^\s#]+")
_WORD = re.compile(r"[^\s!-/:-@\[-`{-~«»„“”‘’،、。！？।–—·•]+")
_SEGMENT = re.compile(r"[\n,;|·•、،،/]+| [-–—] ")
_SENTENCE = re.compile(r"[.!?。！？।؟…]+[\"'»”)\]]*(?:\s+|$)|[。！？।؟]")
_PRICE = re.compile(r"(?<![\d.,])\d{1,5}[.,]\d\d(?![\d.,])")
_YEAR = re.compile(r"(?<!\d)(?:1[5-9]|20)\d\d(?!\d)")

#: What is measured of a block, then of its page. No rule looks at those in LEARNT.
FEATURES = (
    "links", "tags", "packed", "top_words", "repeated_segments", "segment_words", "sentence_words", "prices", "years", "ends", "words",
    "log_chars", "distinct_words", "digits", "function_words", "letter_pairs", "capitals", "word_chars", "marks", "lines", "anchors", "link_hosts",
    "page_runs", "page_segments", "page_variety", "page_chars", "page_links",
)
LEARNT = FEATURES[11:22] + ("page_chars", "page_links")
PAGE_RUNS = FEATURES.index("page_runs")
_AT = {name: k for k, name in enumerate(FEATURES)}
_FUNCTION = frozenset(w for words in FUNCTION_WORDS.values() for w in words.split())
_HOST = re.compile(r"(?:https?://)?(?:www\.)?([^/\s\"'>]+)")
_ANCHOR = re.compile(r"<a\s[^>]*>([^<]*)</a>")


def blocks(text: str) -> list[str]:
    """Blocks between blank lines; short neighbours are joined, and long blocks cut at white space."""
    out: list[str] = []
    for part in _BLANK.split(text):
        if not part.strip():
            continue
        if out and len(out[-1]) < SHORT_BLOCK and len(part) < SHORT_BLOCK:
            out[-1] += "\n" + part
        else:
            out += pieces(part)
    return out


def pieces(part: str) -> list[str]:
    """Pieces of at least PIECE characters that end before white space; a shorter rest stays with the last one."""
    out, start = [], 0
    while len(part) - start >= 2 * PIECE:
        at = _GAP.search(part, start + PIECE)
        if at is None or len(part) - at.start() < PIECE // 2:
            break
        out.append(part[start : at.start()])
        start = at.start()
    return [*out, part[start:]]


def run_shares(pages: list[list[str]]) -> list[float]:
    """For every block of some pages, the share of its runs of characters that recur on its page."""
    out: list[float] = []
    group: list[list[str]] = []
    size = 0
    for page in [*pages, None]:
        if group and (page is None or size > SORTED_CHARS):
            out += _run_shares(group)
            group, size = [], 0
        if page is not None:
            group.append(page)
            size += sum(map(len, page))
    return out


def _run_shares(pages: list[list[str]]) -> list[float]:
    lowered = [[f"{b.lower()}\n" for b in page] for page in pages]
    sizes = np.array([len(b) for page in lowered for b in page], np.int64)
    lengths = np.array([sum(map(len, page)) for page in lowered], np.int64)
    text = "".join(b for page in lowered for b in page) + "\0" * (RUN - 1)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(points) - RUN + 1
    runs = np.zeros(n, np.uint64)
    for k in range(RUN):
        runs = runs * np.uint64(0x9E3779B97F4A7C15) + points[k : k + n]
    level = runs[1:] == runs[:-1]  # one character over and over: rules and dot leaders
    page_of = np.repeat(np.arange(len(pages)), lengths)
    runs = (runs ^ (runs >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9) + page_of.astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    # sorted with their places in the low bits, which is much faster than an indirect sort
    low = np.uint64(max(1, n - 1).bit_length())
    ordered = np.sort(((runs >> low) << low) | np.arange(n, dtype=np.uint64))
    order = (ordered & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    ordered >>= low
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    times = np.diff(np.append(starts, n))
    least = np.maximum(LEAST_RUNS, lengths / RUN_PERIOD)
    again = np.empty(n, bool)
    again[order] = np.repeat(times >= least[page_of[order[starts]]], times)
    again[:-1] &= ~level
    return (np.add.reduceat(again, np.cumsum(sizes) - sizes, dtype=np.int64) / sizes).tolist()


def page_features(pages: list[list[str]]) -> list[list[float]]:
    """Features of the blocks of some pages, one row a block."""
    out: list[list[float]] = []
    for page in pages:
        words: set[str] = set()
        total, linked, rows, parts = 0.0, 0.0, [], []
        for block in page:
            features, different, segments = block_features(block)
            words.update(different)
            total += features[_AT["words"]]
            linked += features[0] * len(block)
            rows.append(features)
            parts.append(segments)
        chars = sum(map(len, page))
        least = max(LEAST_RUNS, chars / RUN_PERIOD)
        variety = len(words) / max(1.0, total) ** VARIETY_POWER
        recurring = {s: len(s) for s, c in Counter(s for part in parts for s in part).items() if c >= least}
        for features, segments in zip(rows, parts, strict=True):
            again = sum(recurring.get(s, 0) for s in segments) if recurring else 0
            features += [0.0, again / sum(map(len, segments)) if again else 0.0, variety, math.log(max(1, chars)), linked / max(1, chars)]
        out += rows
    for features, share in zip(out, run_shares(pages), strict=True):
        features[PAGE_RUNS] = share
    return out


def block_features(block: str) -> tuple[list[float], Counter[str], list[str]]:
    """The features of a block by itself, its words and its segments."""
    n = len(block)
    links = anchors = hosts = 0.0
    if "http" in block or "www." in block or "<a" in block:
        found = [m.group() for m in _LINK.finditer(block)]
        links = sum(map(len, found)) / n
        anchors = sum(map(len, _ANCHOR.findall(block))) / n
        hosts = len({h for x in found if (h := _HOST.match(x.partition("href=")[2].strip("\"'") or x))}) / max(1, len(found))
    tags = sum(m.end() - m.start() for m in _TAG.finditer(block)) / n if "#" in block else 0.0
    raw = block.encode("utf-8", "surrogatepass")
    low = block.lower()
    words = _WORD.findall(low)
    m = max(1, len(words))
    counts = Counter(words)
    segments = [s for s in map(str.strip, _SEGMENT.split(block)) if s]
    often = Counter(segments)
    seen = sum(map(len, segments)) or 1
    sentences = [s for s in _SENTENCE.split(block) if s and not s.isspace()]
    size = len(raw)
    digits = size - len(raw.translate(None, b"0123456789"))
    numbers = digits or not block.isascii()
    features = [
        links,
        tags,
        len(zlib.compress(raw, 1)) / size,
        sum(sorted(counts.values(), reverse=True)[:5]) / m if m >= 12 else 0.0,
        sum(len(s) * c for s, c in often.items() if c > 1) / seen if len(often) < len(segments) else 0.0,
        m / max(1, len(segments)),
        m / max(1, len(sentences)),
        len(_PRICE.findall(block)) / m if numbers else 0.0,
        len(_YEAR.findall(block)) / m if numbers else 0.0,
        float(block.rstrip()[-1] in ".!?。！？।؟…»”)\"'"),
        float(len(words)),
        math.log(n),
        len(counts) / m,
        digits / n,
        len(_FUNCTION.intersection(counts)) / max(1, len(counts)),
        len(set(zip(low[::2], low[1::2]))) / n,
        (size - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))) / n,
        n / m,
        (size - len(raw.translate(None, b",;|#/"))) / n,
        block.count("\n") / n,
        anchors,
        hosts,
    ]
    return features, counts, segments


def weak_label(f: list[float], block: str) -> int | None:
    """1 spam, 0 ham, None where no rule is sure: most kinds of spam are for the trees to tell from what they have seen."""
    n = len(block)
    if n < 60:
        return None
    v = dict(zip(FEATURES, f, strict=True))
    words = v["words"]
    spam = (
        v["links"] > 0.6
        or v["tags"] > 0.6
        or n > 180 and v["packed"] < 0.28
        or n > 150 and v["prices"] > 0.12 and v["years"] < 0.03 and not v["ends"]
        or words > 2 and v["page_runs"] > 0.7
        or words > 25 and v["top_words"] > 0.75
    )
    if spam:
        return 1
    plain = v["links"] < (0.4 if v["years"] > 0.03 else 0.1) and v["tags"] < 0.05 and v["prices"] < 0.03
    ham = plain and (
        words < 3
        or v["packed"] > 0.45
        and v["repeated_segments"] < 0.2
        and v["page_runs"] < 0.2
        and v["page_segments"] < 0.2
        and v["page_variety"] > 1.0
        and (v["sentence_words"] > 7 and v["ends"] or v["years"] > 0.03 or v["page_runs"] < 0.1)
    )
    return 0 if ham else None


def labelled_blocks(texts: list[str]) -> list[tuple[int, int, int, list[float]]]:
    """(text's place, block's place, label, features) of the blocks that a rule is sure of."""
    pages = [blocks(text) for text in texts]
    features = iter(page_features(pages))
    out = []
    for k, page in enumerate(pages):
        for n, block in enumerate(page):
            own = next(features)
            label = weak_label(own, block)
            if label is not None:
                out.append((k, n, label, own))
    return out


def fitted(labels: np.ndarray, rows: np.ndarray) -> BaggedTrees | None:
    """The trees, or None where there are not blocks of both kinds."""
    return BaggedTrees(TREES, share=FEATURE_SHARE).fit(rows, labels) if len(np.unique(labels)) == 2 else None


def train(texts: list[str]) -> BaggedTrees | None:
    found = labelled_blocks(texts)
    return fitted(np.array([label for _, _, label, _ in found]), np.array([own for *_, own in found]))


def train_on(sample: DataFrame) -> BaggedTrees | None:
    """The trees from a sample (doc_id, text), whose blocks are measured and labelled in tasks; only their features reach the driver."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            columns = list(zip(*[(ids[k], n, label, own) for k, n, label, own in labelled_blocks(batch.column(1).to_pylist())], strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "block", "label", "features"])

    spread = sample.repartition(sample.sparkSession.sparkContext.defaultParallelism)
    # in one order on every run, whatever tasks the blocks come from
    rows = spread.mapInArrow(label, "doc_id bigint, block int, label int, features array<double>").toPandas().sort_values(["doc_id", "block"], kind="stable")
    return fitted(rows["label"].to_numpy(), np.stack(rows["features"].to_numpy())) if len(rows) else None


def spam_share(texts: list[str | None], trees: BaggedTrees) -> list[float | None]:
    """Share of each text's characters in blocks of spam; None for texts that are no case."""
    pages, owner, sizes, wide = [], [], [], []
    for k, text in enumerate(texts):
        if text is None or len(text) < MIN_CHARS:
            continue
        pages.append(blocks(text))
        for block in pages[-1]:
            owner.append(k)
            sizes.append(len(block))
            wide.append(not block.isascii())
    rows = page_features(pages)
    out: list[float | None] = [None] * len(texts)
    if rows:
        table = np.array(rows)
        weight = np.array(sizes, float)
        total = np.bincount(owner, weight, len(texts))
        named = (table[:, _AT["words"]] > 2) | (table[:, _AT["links"]] > 0) | np.array(wide)
        spam = np.bincount(owner, weight * ((trees.predict(table) > 0.5) & named), len(texts))
        for k in np.flatnonzero(total):
            out[k] = float(spam[k] / total[k])
    return out


def page_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(doc_id, host, share): the share of spam of every page that is long enough."""
    named = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("text"))
    long = named.where(F.length("text") >= MIN_CHARS)
    # the labelled sample is bounded in pages and in characters a page; scoring reads every page whole
    short = long.where(F.length("text") <= SAMPLE_CHARS)
    sample = bounded_sample(short, "doc_id", SAMPLE_PAGES, short.count())
    trees = train_on(sample.select("doc_id", "text"))
    if trees is None:
        return long.select("doc_id", "host", F.lit(0.0).alias("share"))
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shares = spam_share(batch.column(2).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shares, pa.float64())], names=["doc_id", "host", "share"])

    return long.mapInArrow(score, "doc_id bigint, host string, share double")


def find_spam(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(doc_id, score) of the spam pages, after smoothing by the host."""
    return smoothed(cut(page_scores(docs, id_col, text_col, host_col).where("share IS NOT NULL")))


def smoothed(scores: DataFrame, max_broadcast: int = MAX_BROADCAST_HOSTS) -> DataFrame:
    """(doc_id, score) of the pages of ``scores`` (doc_id, host, share) that are spam beside their host's rate."""
    whole = scores.agg(F.avg(F.col("share")).alias("rate")).first()["rate"]
    rate = min(max(whole or 0.0, 1e-4), 1 - 1e-4)
    hosts = scores.where("host IS NOT NULL").groupBy("host").agg(((F.sum("share") + HOST_PRIOR * rate) / (F.count(F.lit(1)) + HOST_PRIOR)).alias("host_rate"))
    hosts = cut(hosts)
    known, unknown = scores.where("host IS NOT NULL"), scores.where("host IS NULL").withColumn("host_rate", F.lit(rate))
    if hosts.count() <= max_broadcast:
        rated = known.join(F.broadcast(hosts), "host")
    else:
        # a hot host is dealt out over several keys
        rated = known.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).join(hosts.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt")), ["host", "salt"])
    columns = ["doc_id", "share", "host_rate"]
    rated = rated.select(*columns).unionAll(unknown.select(*columns))
    shift = F.log(F.col("host_rate") / (1 - F.col("host_rate"))) - F.lit(float(np.log(rate / (1 - rate))))
    logit = STEEP * (F.col("share") - 0.5) + HOST_WEIGHT * F.greatest(F.lit(-HOST_MOST), F.least(F.lit(HOST_MOST), shift))
    return rated.select("doc_id", (1 / (1 + F.exp(-logit))).alias("score")).where("score > 0.5")
