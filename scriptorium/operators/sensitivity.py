"""A matrix of results over variants of a taxonomy and counting unit, in one pass over the corpus."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from scriptorium.functions import text as T
from scriptorium.functions.taxonomy import Variant, folded, may_occur, pattern_of
from scriptorium.operators.concepts import token_count


def _sentence_count(pieces: Column, low: Column, variants: tuple[str, ...]) -> Column:
    """Sentences with a hit; the pattern only sees those that have its first letters."""
    pattern = pattern_of(variants)

    def has(sentence: Column) -> Column:
        near = may_occur(folded(sentence), variants)
        return sentence.rlike(pattern) if near is None else near & sentence.rlike(pattern)

    count = F.size(F.filter(pieces, has))
    guard = may_occur(low, variants)
    return count if guard is None else F.when(guard, count).otherwise(F.lit(0))


def sensitivity_matrix(documents: DataFrame, variants: Sequence[Variant], pages: str = "pages") -> DataFrame:
    """(variant, frame, hits, all_hits, n_zero, n_docs): every variant in one aggregation.

    Each distinct pattern and unit is counted once a document; variants are sums of these columns. Hyphens are closed
    across pages for tokens and not at all for sentences, which never cross a page.
    """
    whole = F.col(pages)
    filled = F.transform(F.coalesce(whole, F.array().cast("array<string>")), lambda p: F.coalesce(p, F.lit("")))
    pieces = F.flatten(F.transform(F.filter(filled, lambda p: ~T.is_blank(p)), lambda p: T.sentences(T.collapse(p))))
    # names of the columns hold no dots or quotes, so that any concept may be counted
    needed: dict[tuple[tuple[str, ...], str], str] = {}
    for v in variants:
        for patterns in v.taxonomy.patterns.values():
            needed.setdefault((patterns, v.unit), f"n{len(needed)}")
    units = {u for _, u in needed}
    base = documents.select(T.normalise(T.join_pages(whole)).alias("_text"), *([pieces.alias("_pieces"), folded(T.collapse(T.join_pages(whole))).alias("_page_low")] if "sentence" in units else []))
    base = base.withColumn("_low", folded(F.col("_text")))
    counted = base.select(*((token_count(F.col("_text"), p, F.col("_low")) if u == "token" else _sentence_count(F.col("_pieces"), F.col("_page_low"), p)).alias(name) for (p, u), name in needed.items()))
    sums, rows = [], []
    for k, v in enumerate(variants):
        of = {c: F.col(needed[p, v.unit]) for c, p in v.taxonomy.patterns.items()}
        frames = {f: reduce(lambda a, b: a + b, [of[c] for c, _ in concepts], F.lit(0)) for f, concepts in v.taxonomy.frames}
        total = reduce(lambda a, b: a + b, of.values(), F.lit(0))
        sums += [F.coalesce(F.sum(n), F.lit(0)).alias(f"v{k}_{j}") for j, n in enumerate(frames.values())]
        sums.append(F.count_if(total == 0).alias(f"v{k}_zero"))
        everything = reduce(lambda a, b: a + b, [F.col(f"v{k}_{j}") for j in range(len(frames))])
        rows += [F.struct(F.lit(v.name).alias("variant"), F.lit(f).alias("frame"), F.col(f"v{k}_{j}").alias("hits"), everything.alias("all_hits"), F.col(f"v{k}_zero").alias("n_zero"), F.col("n_docs")) for j, f in enumerate(frames)]
    return counted.agg(F.count(F.lit(1)).alias("n_docs"), *sums).select(F.inline(F.array(*rows)))


def sensitivity_report(matrix: DataFrame, frames: Sequence[str]) -> DataFrame:
    """(variant, {frame}_pct..., zero_engagement_pct, n_docs), with one decimal: the shape of the report's file."""
    pct = F.when(F.col("all_hits") > 0, 100 * F.col("hits") / F.col("all_hits")).otherwise(F.lit(0.0))
    zero = F.when(F.col("n_docs") > 0, 100 * F.col("n_zero") / F.col("n_docs")).otherwise(F.lit(0.0))
    wide = matrix.withColumns({"pct": pct, "zero": zero}).groupBy("variant", "zero", "n_docs").pivot("frame", list(frames)).agg(F.first("pct"))
    return wide.select("variant", *(T.round_exactly(F.col(f"`{f}`"), 1).alias(f"{f}_pct") for f in frames), T.round_exactly(F.col("zero"), 1).alias("zero_engagement_pct"), "n_docs").orderBy("variant")
