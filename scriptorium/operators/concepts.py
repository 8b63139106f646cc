"""Concept counts per document and what is rolled up from them.

A document without text keeps its row and counts in every denominator. Every function is DataFrame to DataFrame.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from scriptorium.functions import text as T
from scriptorium.functions.taxonomy import Taxonomy, counting_pattern, folded, may_occur, pattern_of, plain_lower

#: Characters on either side of a hit in which a phrase discounts it.
CONTEXT = 40


def token_count(text: Column, variants: Iterable[str], low: Column | None = None) -> Column:
    """Matches of one concept; the pattern runs only where its first letters occur, on the folded text if it can."""
    variants = tuple(variants)
    low = folded(text) if low is None else low
    count = F.regexp_count(low, F.lit(counting_pattern(variants))) if plain_lower(variants) else F.regexp_count(text, F.lit(pattern_of(variants)))
    guard = may_occur(low, variants)
    return count if guard is None else F.when(guard, count).otherwise(F.when(text.isNotNull(), F.lit(0)))


def kept_count(text: Column, variants: Iterable[str], phrases: Iterable[str], context: int = CONTEXT) -> Column:
    """Matches of one concept without those that have a phrase within ``context`` characters on either side."""
    phrases = [p.lower() for p in phrases if p]
    pattern = pattern_of(variants)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.zip_with(F.split(text, pattern, -1), hits, lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("hit")))

    def step(state: Column, size: Column) -> Column:
        start = state["at"] + size["gap"]
        end = start + size["hit"]
        begin = F.greatest(F.lit(0), start - context)
        near = F.lower(F.substring(text, begin + 1, end + context - begin))
        hit = size["hit"].isNotNull() & ~reduce(lambda a, b: a | b, [F.contains(near, F.lit(p)) for p in phrases], F.lit(False))
        return F.struct(F.coalesce(end, F.lit(0)).alias("at"), (state["kept"] + hit.cast("int")).alias("kept"))

    return F.aggregate(sizes, F.struct(F.lit(0).alias("at"), F.lit(0).alias("kept")), step, lambda s: s["kept"])


def count_concepts(documents: DataFrame, taxonomy: Taxonomy, phrases: Iterable[str] = (), pages: str = "pages", keep: Iterable[str] = ("path",)) -> DataFrame:
    """keep..., char_count, extraction_ok, raw__{concept}... and concept__{concept}...: all hits, and those not discounted.

    In two steps: plain counts first, then offsets only where a document has both the concept and a phrase.
    """
    keep = list(keep)
    phrases = tuple(p for p in phrases if p)
    raw = documents.select(*keep, T.normalise(T.join_pages(F.col(pages))).alias("_text")).withColumn("_low", folded(F.col("_text")))
    text, low = F.col("_text"), F.col("_low")
    near = reduce(lambda a, b: a | b, [F.contains(low, folded(F.lit(p))) for p in phrases], F.lit(False))
    plain = raw.select(*keep, text, F.length(text).alias("char_count"), (~T.is_blank(text)).alias("extraction_ok"), near.alias("_near"), *(token_count(text, v, low).alias(f"raw__{c}") for c, v in taxonomy.patterns.items()))
    if phrases:
        counts = [F.when(F.col("_near") & (F.col(f"raw__{c}") > 0), kept_count(text, v, phrases)).otherwise(F.col(f"raw__{c}")).alias(f"concept__{c}") for c, v in taxonomy.patterns.items()]
    else:
        counts = [F.col(f"raw__{c}").alias(f"concept__{c}") for c in taxonomy.concepts]
    return plain.select(*keep, "char_count", "extraction_ok", *(f"raw__{c}" for c in taxonomy.concepts), *counts)


def profile(documents: DataFrame, taxonomy: Taxonomy, phrases: Iterable[str] = (), pages: str = "pages", keep: Iterable[str] = ("path",)) -> DataFrame:
    """One wide row a document: text statistics, counts of every concept and frame, and the dominant frame."""
    counted = count_concepts(documents, taxonomy, phrases, pages, keep).drop(*(f"raw__{c}" for c in taxonomy.concepts))
    frames = {f: reduce(lambda a, b: a + b, [F.col(f"concept__{c}") for c, _ in concepts], F.lit(0)) for f, concepts in taxonomy.frames}
    out = counted.withColumns({f"frame_hits__{f}": n for f, n in frames.items()})
    total = reduce(lambda a, b: a + b, [F.col(f"frame_hits__{f}") for f in taxonomy.frame_order], F.lit(0))
    breadth = reduce(lambda a, b: a + b, [(F.col(f"concept__{c}") > 0).cast("int") for c in taxonomy.concepts], F.lit(0))
    out = out.withColumns({"total_hits": total, "breadth": breadth})
    best = F.array_max(F.array(*(F.struct(F.col(f"frame_hits__{f}").alias("n"), F.lit(-k).alias("k"), F.lit(f).alias("frame")) for k, f in enumerate(taxonomy.frame_order))))
    out = out.withColumn("dominant_frame", F.when(F.col("total_hits") > 0, best["frame"]))
    share = {f"frame_share__{f}": F.when(F.col("total_hits") > 0, F.col(f"frame_hits__{f}") / F.col("total_hits")).otherwise(F.lit(0.0)) for f in taxonomy.frame_order}
    return out.withColumns(share)


def hits_long(profiled: DataFrame, taxonomy: Taxonomy, keep: Iterable[str] = ("path",)) -> DataFrame:
    """(keep..., frame, concept, hits): one row a document and concept, zeros included."""
    entries = F.array(*(F.struct(F.lit(taxonomy.frame_of[c]).alias("frame"), F.lit(c).alias("concept"), F.col(f"concept__{c}").alias("hits")) for c in taxonomy.concepts))
    return profiled.select(*keep, F.inline(entries))


def breadth_histogram(profiled: DataFrame) -> DataFrame:
    """(bucket, documents, n_documents): documents by number of concepts, 0 to 5 and 6+, empty buckets included."""
    # one aggregation and no join, so that no condition on the counts is pushed below them and computed twice
    names = [*map(str, range(6)), "6+"]
    sums = profiled.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("breadth") == k if k < 6 else F.col("breadth") >= 6).alias(f"b{k}") for k in range(7)))
    return sums.select(F.inline(F.array(*(F.struct(F.lit(name).alias("bucket"), F.col(f"b{k}").alias("documents"), F.col("n").alias("n_documents")) for k, name in enumerate(names)))))


def frame_dominance(profiled: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """(frame, total_hits, all_hits, share): hits of every frame over the corpus, in one aggregation."""
    sums = profiled.agg(*(F.coalesce(F.sum(f"frame_hits__{f}"), F.lit(0)).alias(f) for f in taxonomy.frame_order))
    total = reduce(lambda a, b: a + b, [F.col(f"`{f}`") for f in taxonomy.frame_order])
    rows = F.array(*(F.struct(F.lit(f).alias("frame"), F.col(f"`{f}`").alias("total_hits"), total.alias("all_hits")) for f in taxonomy.frame_order))
    return sums.select(F.inline(rows)).withColumn("share", F.when(F.col("all_hits") > 0, F.col("total_hits") / F.col("all_hits")).otherwise(F.lit(0.0)))


def frame_rollup(long: DataFrame) -> DataFrame:
    """(frame, concept, hits): sums by concept, by frame and over all, in one roll-up (an extension)."""
    return long.rollup("frame", "concept").agg(F.sum("hits").alias("hits"))


def zero_documents(profiled: DataFrame) -> DataFrame:
    """(n_documents, n_zero, n_failed): all documents, those without a concept, and those without text."""
    return profiled.agg(F.count(F.lit(1)).alias("n_documents"), F.count_if(F.col("breadth") == 0).alias("n_zero"), F.count_if(~F.col("extraction_ok")).alias("n_failed"))


def top_documents(profiled: DataFrame, n: int = 40, path: str = "path") -> DataFrame:
    """(rank, path, total_hits, breadth, dominant_frame) of the n documents with most hits; ties in path order."""
    order = [F.col("total_hits").desc(), F.split(F.coalesce(F.col(path), F.lit("")), "/").asc()]
    best = profiled.select(path, T.file_name(F.col(path)).alias("filename"), "total_hits", "breadth", "dominant_frame").orderBy(*order).limit(n)
    # at most n rows: the ranking's single partition is bounded by the report's length
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def summary(profiled: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """One row with the nested JSON summary of a run, indented by two blanks."""
    zero = zero_documents(profiled)
    histogram = breadth_histogram(profiled).withColumn("pct", T.round_exactly(F.when(F.col("n_documents") > 0, 100 * F.col("documents") / F.col("n_documents")).otherwise(0.0), 2))
    dominance = frame_dominance(profiled, taxonomy).withColumn("pct", T.round_exactly(100 * F.col("share"), 2))
    h = histogram.orderBy("bucket").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("bucket", F.struct("documents", F.col("pct").alias("pct_of_corpus")))))).alias("breadth_histogram"))
    d = dominance.agg(F.map_from_entries(F.collect_list(F.struct("frame", F.struct("total_hits", F.col("pct").alias("pct_of_all_concept_hits"))))).alias("frame_dominance"))
    zero = zero.select(F.col("n_documents").alias("n_documents_analyzed"), F.col("n_zero").alias("n_documents_zero_concepts"), T.round_exactly(F.when(F.col("n_documents") > 0, 100 * F.col("n_zero") / F.col("n_documents")).otherwise(0.0), 2).alias("pct_documents_zero_concepts"))
    # three one-row tables side by side
    whole = zero.crossJoin(h).crossJoin(d).select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("summary"))
    return whole.select(F.regexp_replace("summary", r'(?m)^(\s*"[^"]*") : ', "$1: ").alias("summary"))
