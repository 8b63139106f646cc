"""Near-duplicate records (problem 5).

A record's shingles are the runs of eight characters of its path and pages in lower case without white space.
Records with the same text form one class, and so do records with the same pages whose paths are short beside them, so
that no two of them can be parted by their paths; a class is compared once, however many copies it has. Classes that
agree in a band of MinHash values become candidates; where a path makes up more than a tenth of a record, the values
with the path count as well, each distinct band once for a class. The candidates'
 remaining MinHash values are compared in steps, and a pair is dropped as soon as the
posterior probability of its similarity reaching the threshold falls below a tolerance; the rest is verified
exactly on the sets of shingles.

Null paths and pages count as empty text; records below the least length, and those with fewer than eight
characters besides white space, are left out; an empty table gives no rows. ``min_chars`` counts the characters of the pages as delivered.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from scriptorium.llm.common import cut
from scriptorium.llm.components import components

SHINGLE = 8
THRESHOLD = 0.6
MIN_CHARS = 200
#: Bands of ROWS MinHash values each: a pair at the threshold shares one with probability 1 - (1 - 0.6**5)**64 = 0.994.
BANDS, ROWS = 64, 5
#: MinHash values come from so many one-permutation hashings of BINS bins.
MIXES, BINS = 4, 128
STEP = 32
#: Shared paths can lift pairs of records above the threshold whose pages alone are as far below it as this: with u
#: shingles on the pages of both and PATH_TIMES times fewer on a path, (0.6 u - 0.4 u / 3) / u.
PRUNED_BELOW = 0.467
#: A pair is dropped when it reaches the threshold with less than this posterior probability.
TOLERANCE = 0.001
#: Paths cannot part copies whose pages have PATH_TIMES as many shingles: with c shared shingles and at most c / 3 others
#: on either side, c / (c + 2c / 3) is 0.6. From PATH_SHARE times as many on, the values without the path are enough.
PATH_TIMES, PATH_SHARE = 3, 10
#: Members of a class that one task pairs with all the others where pairs are written out.
MEMBERS_AT_ONCE = 2_000
#: Ids of compared records are broadcast up to this number; beyond it they are joined by a shuffle.
MAX_BROADCAST_IDS = 1_000_000
#: Paths of a class that stand in one row where two classes are compared path by path.
PATHS_AT_ONCE = 2_000

_ODD = np.random.default_rng(5).integers(1 << 62, 1 << 63, MIXES, np.uint64) * np.uint64(2) + np.uint64(1)
_EDGES = (np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)).astype(np.uint64)
_PROBES = np.stack([np.random.default_rng(100 + k).permutation(BINS) for k in range(64)], axis=1)
_BAND_MIX = np.random.default_rng(7).integers(1 << 62, 1 << 63, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_SALT = np.random.default_rng(8).integers(0, 1 << 63, BANDS, np.uint64)


def folded(path: str | None, pages: list[str | None] | None) -> str:
    """Path and pages in lower case, without any white space."""
    return "".join("\n".join([path or "", *(p or "" for p in pages or [])]).lower().split())


def shingle_set(text: str) -> set[str]:
    return {text[k : k + SHINGLE] for k in range(len(text) - SHINGLE + 1)}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def minhash(text: str) -> np.ndarray | None:
    """MIXES * BINS MinHash values of the text's shingles; empty bins borrow from others in a fixed random order."""
    return signature(text)[0]


def signature(text: str) -> tuple[np.ndarray | None, int]:
    """The MinHash values of a text and the number of its different shingles."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(points) - SHINGLE + 1
    if n < 1:
        return None, 0
    different = 0
    rolled = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + points[k : k + n]
    rolled = _mixed(rolled)
    out = np.empty((MIXES, BINS), np.uint64)
    for m in range(MIXES):
        values = np.sort(_mixed(rolled * _ODD[m]))
        different = different or 1 + int(np.count_nonzero(values[1:] != values[:-1]))
        at = np.searchsorted(values, _EDGES)
        full = np.append(at[1:], n) > at
        own = values[np.minimum(at, n - 1)]
        if not full.all():
            empty = np.flatnonzero(~full)
            tries = full[_PROBES[empty]]
            first = tries.argmax(1)
            source = np.where(tries[np.arange(len(empty)), first], _PROBES[empty, first], np.flatnonzero(full)[0])
            own[empty] = _mixed(own[source] + first.astype(np.uint64) + np.uint64(1))
        out[m] = own
    return out.ravel(), different


class Sketch(NamedTuple):
    """What a record's class goes by, its MinHash values, those with its path where that weighs, and the path's length."""

    digest: bytes
    values: np.ndarray | None
    with_path: np.ndarray | None
    path_size: int


def sketch_of(path: str | None, pages: list[str | None] | None) -> Sketch:
    """The class of a record: its pages alone if its path cannot matter among copies of them, else path and pages."""
    text, size = folded(None, pages), len(folded(path, None))
    values, different = signature(text)
    digest = lambda kind, t: kind + xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass"))
    if different and PATH_TIMES * size <= different:
        whole = signature(folded(path, pages))[0] if PATH_SHARE * size > different else None
        return Sketch(digest(b"p", text), values, whole, size)
    text = folded(path, pages)
    return Sketch(digest(b"t", text), signature(text)[0] if size else values, None, 0)


def band_keys(values: np.ndarray) -> np.ndarray:
    rows = values[: BANDS * ROWS].reshape(BANDS, ROWS)
    return _mixed((rows * _BAND_MIX).sum(1, dtype=np.uint64) ^ _BAND_SALT).view(np.int64)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, path, pages in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key is None or sum(len(p) for p in pages or [] if p) < MIN_CHARS:
                continue
            own = sketch_of(path, pages)
            if own.values is not None:
                further = [] if own.with_path is None else sorted(set(band_keys(own.with_path).tolist()) - set(band_keys(own.values).tolist()))
                rows.append((key, own.digest, own.values[BANDS * ROWS :].astype(np.uint8).tobytes(), band_keys(own.values).tolist(), further, own.path_size))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["id", "digest", "sketch", "bands", "further", "path_size"])


@lru_cache
def least_matches(threshold: float = PRUNED_BELOW, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(values compared, least equal values to go on) by the posterior under an even prior of the similarity."""
    total = MIXES * BINS - BANDS * ROWS
    s = (np.arange(2000) + 0.5) / 2000
    equal = s + (1 - s) / 256  # a byte of the value is compared
    out = []
    for n in range(STEP, total + 1, STEP):
        for m in range(n + 1):
            log = m * np.log(equal) + (n - m) * np.log1p(-equal)
            weight = np.exp(log - log.max())
            if weight[s >= threshold].sum() / weight.sum() >= tolerance:
                out.append((n, m))
                break
    return out


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    width = MIXES * BINS - BANDS * ROWS
    for batch in batches:
        if batch.num_rows:
            left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, width) for k in (2, 3))
            live, done, matches = np.arange(len(left)), 0, np.zeros(len(left), np.int32)
            for n, least in least_matches():
                matches = matches + (left[live, done:n] == right[live, done:n]).sum(1)
                keep = matches >= least
                live, matches, done = live[keep], matches[keep], n
            batch = batch.take(pa.array(live))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"])


class _Recent:
    """Shingle sets of the last texts."""

    def __init__(self, size: int = 200) -> None:
        self.size, self.kept = size, OrderedDict()

    def get(self, key: object, path: str | None, pages: list[str | None] | None) -> set[str]:
        if key not in self.kept:
            self.kept[key] = shingle_set(folded(path, pages))
            if len(self.kept) > self.size:
                self.kept.popitem(last=False)
        return self.kept[key]


def _overlap(one: set[str], two: set[str]) -> tuple[int, int]:
    common = len(one & two)
    return common, len(one) + len(two) - common


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Class pairs by their representatives: the similarity, whether every pair of members has it, and whether some can."""
    recent = _Recent()
    for batch in batches:
        out = []
        for a, b, most_a, most_b, path_a, pages_a, path_b, pages_b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            common, union = _overlap(recent.get(a, path_a, pages_a), recent.get(b, path_b, pages_b))
            similarity = common / union
            # members differ in paths of at most so many shingles; what they surely share and hold is that of their pages
            sides = [(a, most_a is not None, path_a, pages_a), (b, most_b is not None, path_b, pages_b)]
            loose = (most_a or 0) + (most_b or 0)
            if loose:
                common, union = _overlap(*(recent.get((k, by_pages), None if by_pages else path, pages) for k, by_pages, path, pages in sides))
            sure = common / (union + loose) >= THRESHOLD
            if sure or (common + loose) / union >= THRESHOLD:
                out.append((a, b, similarity, sure, sides[0][1], sides[1][1]))
        columns = list(zip(*out, strict=True)) if out else [[], [], [], [], [], []]
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.bool_(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["a", "b", "similarity", "sure", "loose_a", "loose_b"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of records whose similarity reaches the threshold."""
    recent = _Recent()
    for batch in batches:
        out = []
        for a, b, path_a, pages_a, path_b, pages_b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            common, union = _overlap(recent.get(a, path_a, pages_a), recent.get(b, path_b, pages_b))
            if common / union >= THRESHOLD:
                out.append((a, b))
        columns = list(zip(*out, strict=True)) if out else [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64())], names=["a", "b"])


def any_similar(one: set[str], two: set[str], paths_one: list[set[str]], paths_two: list[set[str]]) -> bool:
    """Whether any member of a class, the shingles of its pages and one of its sets of path shingles, is similar to any of another.

    A member's path adds what it shares with the other's pages and what is new to both, each by itself; only new
    shingles that both paths have count together. So most members are ruled out without looking at their pairs.
    """
    common, union = _overlap(one, two)
    both = one | two

    def parts(paths: list[set[str]], own: set[str], other: set[str]) -> list[tuple[int, set[str]]]:
        split = [(len(p & (other - own)), p - both) for p in paths]
        return sorted(split, key=lambda s: THRESHOLD * len(s[1]) - s[0])

    left, right = parts(paths_one, one, two), parts(paths_two, two, one)
    most = max((met - THRESHOLD * len(new) for met, new in right), default=0.0)
    for met_x, new_x in left:
        if common - THRESHOLD * union + met_x + len(new_x) + most < -1e-6:
            continue
        for met_y, new_y in right:
            shared = len(new_x & new_y)
            if (common + met_x + met_y + shared) / (union + len(new_x) + len(new_y) - shared) >= THRESHOLD:
                return True
    return False


def _any_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Class pairs of which some members are similar."""
    recent, heads = _Recent(), {}
    for batch in batches:
        out = []
        for a, b, loose_a, loose_b, paths_a, paths_b, path_a, pages_a, path_b, pages_b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            sets, added = [], []
            for k, loose, paths, path, pages in ((a, loose_a, paths_a, path_a, pages_a), (b, loose_b, paths_b, path_b, pages_b)):
                sets.append(recent.get((k, loose), None if loose else path, pages))
                if loose and k not in heads:
                    heads[k] = folded(None, pages)[: SHINGLE - 1]
                added.append([shingle_set(p + heads[k]) for p in {folded(p, None) for p in paths}] if loose else [set()])
            if any_similar(*sets, *added):
                out.append((a, b))
        columns = list(zip(*out, strict=True)) if out else [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64())], names=["a", "b"])


def _with_texts(pairs: DataFrame, named: DataFrame) -> DataFrame:
    """Pairs (a, b, ...) with the paths and pages of both; only the texts that are needed move."""
    ends = cut(pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct())
    few = ends.count() <= MAX_BROADCAST_IDS
    texts = named.join(F.broadcast(ends) if few else ends, "id", "left_semi")
    return pairs.join(texts.select(F.col("id").alias("a"), F.col("path").alias("path_a"), F.col("pages").alias("pages_a")), "a").join(
        texts.select(F.col("id").alias("b"), F.col("path").alias("path_b"), F.col("pages").alias("pages_b")), "b"
    )


def class_links(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The named records, (id, rep) of every record compared, and (a, b, similarity, sure, loose_a, loose_b) of representatives; the members of a loose class differ in paths."""
    named = records.select(F.col("cache_id").cast("bigint").alias("id"), "path", "pages")
    features = cut(named.mapInArrow(_features, "id bigint, digest binary, sketch binary, bands array<bigint>, further array<bigint>, path_size int"))
    classes = features.groupBy("digest").agg(F.min("id").alias("rep"), F.max("path_size").alias("most"))
    members = features.select("id", "digest").join(classes, "digest").select("id", "rep").distinct()
    own = features.join(classes.withColumnRenamed("rep", "id"), ["id", "digest"], "left_semi").dropDuplicates(["id"])
    # the bands of the pages are the same for all members; those with a path count once for their class
    further = features.where(F.size("further") > 0).join(classes, "digest").select(F.col("rep").alias("id"), F.explode("further").alias("key")).distinct()
    keys = own.select("id", F.explode("bands").alias("key")).unionAll(further)
    other = keys.select(F.col("id").alias("b"), "key")
    candidates = keys.withColumnRenamed("id", "a").join(other, "key").where("a < b").select("a", "b").distinct()
    sketches = own.select("id", "sketch")
    compared = (
        candidates.join(sketches.select(F.col("id").alias("a"), F.col("sketch").alias("sa")), "a")
        .join(sketches.select(F.col("id").alias("b"), F.col("sketch").alias("sb")), "b")
        .select("a", "b", "sa", "sb")
    )
    close = cut(compared.mapInArrow(_prune, "a bigint, b bigint"))
    # the longest path of a class whose members differ in theirs, null for a class of one text
    loose = own.join(classes.select("digest", "most"), "digest").select("id", F.when(F.substring("digest", 1, 1) == F.lit(b"p"), F.col("most")).alias("most"))
    kinded = close.join(loose.select(F.col("id").alias("a"), F.col("most").alias("most_a")), "a").join(loose.select(F.col("id").alias("b"), F.col("most").alias("most_b")), "b")
    both = _with_texts(kinded, named).select("a", "b", "most_a", "most_b", "path_a", "pages_a", "path_b", "pages_b")
    return named, members, both.mapInArrow(_judge, "a bigint, b bigint, similarity double, sure boolean, loose_a boolean, loose_b boolean").dropDuplicates(["a", "b"])


def _member_pairs(members: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs within the classes, which the result is made of; a large class is shared out over tasks."""
    sizes = members.groupBy("rep").agg(F.ceil(F.count(F.lit(1)) / MEMBERS_AT_ONCE).alias("parts"))
    sized = members.join(sizes, "rep")
    one = sized.select(F.col("id").alias("a"), "rep", F.expr("pmod(xxhash64(id), parts)").alias("part"))
    two = sized.select(F.col("id").alias("b"), "rep", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    return one.join(two, ["rep", "part"]).where("a < b").select("a", "b")


def similar_pairs(records: DataFrame) -> DataFrame:
    """(cache_id_a, cache_id_b), a < b: every pair of records at or above the threshold."""
    named, members, links = class_links(records)
    links = cut(links)
    one, two = members.select(F.col("rep").alias("a"), F.col("id").alias("x")), members.select(F.col("rep").alias("b"), F.col("id").alias("y"))
    met = links.join(one, "a").join(two, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "sure").where("a < b").distinct()
    # pairs whose paths may decide are looked at one by one, the others follow from their classes
    doubtful = _with_texts(met.where(~F.col("sure")).select("a", "b"), named).select("a", "b", "path_a", "pages_a", "path_b", "pages_b").mapInArrow(_verify, "a bigint, b bigint")
    within = _member_pairs(members)
    # an id that stands for two texts may meet another twice
    found = met.where("sure").select("a", "b").unionAll(doubtful).unionAll(within).distinct()
    return found.select(F.col("a").alias("cache_id_a"), F.col("b").alias("cache_id_b"))


def duplicate_groups(records: DataFrame) -> DataFrame:
    """(cache_id, rep, group_id, links): class, connected group and number of similar classes of every record compared.

    Classes are linked if any of their members are similar, so that the groups are the components of all similar
    pairs: a class is connected in itself. No pair of members is written out; where the representatives are not similar
    but other members can be, the paths of the two classes are compared.
    """
    named, members, links = class_links(records)
    links = cut(links)
    open_links = links.where(F.col("similarity") < THRESHOLD).drop("similarity", "sure")
    ends = open_links.select(F.col("a").alias("rep")).unionAll(open_links.select(F.col("b").alias("rep"))).distinct()
    paths = members.join(ends, "rep").join(named.select("id", F.coalesce("path", F.lit("")).alias("path")), "id").select("rep", "path").distinct()
    numbers = paths.groupBy("rep").agg(F.ceil(F.count(F.lit(1)) / PATHS_AT_ONCE).alias("rows"))
    listed = cut(paths.join(numbers, "rep").groupBy("rep", F.expr("pmod(xxhash64(path), rows)").alias("row")).agg(F.collect_list("path").alias("paths")).drop("row"))
    met = open_links.join(listed.select(F.col("rep").alias("a"), F.col("paths").alias("paths_one")), "a").join(listed.select(F.col("rep").alias("b"), F.col("paths").alias("paths_two")), "b")
    texts = _with_texts(met, named).select("a", "b", "loose_a", "loose_b", "paths_one", "paths_two", "path_a", "pages_a", "path_b", "pages_b")
    links = cut(links.where(F.col("similarity") >= THRESHOLD).select("a", "b").unionAll(texts.mapInArrow(_any_members, "a bigint, b bigint")).distinct())
    degree = links.select(F.col("a").alias("rep")).unionAll(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    groups = components(links, "a", "b").select(F.col("id").alias("rep"), F.col("component").alias("group_id"))
    out = members.join(degree, "rep", "left").join(groups, "rep", "left")
    return out.select(F.col("id").alias("cache_id"), "rep", F.coalesce("group_id", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
