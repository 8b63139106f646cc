"""Queries of this subpackage, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm import encode, langid, leakage, names, neardup, quality, scan_noise, sentences, spam
from scriptorium.llm.common import table
from scriptorium.operators.spread import spread


def _records(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "extraction_cache").select("cache_id", "path", "pages"))


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "extraction_cache").select("cache_id", "pages"))


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "per_document_entries").select("entry_id", "document", "surname", "year", "raw_entry"))


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select("doc_id", "text", "source"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return names.variant_pairs(table(spark, folder, "most_cited_authors"), _entries(spark, folder))


def p1_clusters(spark: SparkSession, folder: str) -> DataFrame:
    clusters, _ = names.variant_clusters(table(spark, folder, "most_cited_authors"), _entries(spark, folder))
    return clusters.withColumnsRenamed({"id": "author_id", "component": "cluster_id"})


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return quality.find_issues(_pages(spark, folder), table(spark, folder, "document_results"))


def p2_kinds(spark: SparkSession, folder: str) -> DataFrame:
    return quality.record_kinds(quality.measured_records(_pages(spark, folder)))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.sentence_positions(_pages(spark, folder), table(spark, folder, "sentence_sample"))


def p3_sentences(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.sentence_positions(_pages(spark, folder))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return scan_noise.find_noise(_pages(spark, folder), _entries(spark, folder))


def p4_text(spark: SparkSession, folder: str) -> DataFrame:
    return scan_noise.repair_texts(_pages(spark, folder), _entries(spark, folder))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.similar_pairs(_records(spark, folder))


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.duplicate_groups(_records(spark, folder))


def p6_languages(spark: SparkSession, folder: str) -> DataFrame:
    return langid.paragraph_languages(_pages(spark, folder), table(spark, folder, "language_labels"))


def p6_documents(spark: SparkSession, folder: str) -> DataFrame:
    return langid.document_languages(_pages(spark, folder), table(spark, folder, "language_labels"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    found = langid.mislabelled(_pages(spark, folder), table(spark, folder, "language_labels"))
    return found.select("cache_id", "page_no", "para_no", "lang")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode.encode_corpus(_documents(spark, folder))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.find_leaks(_documents(spark, folder), table(spark, folder, "eval_items"))


def p8_clean(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.remove_leaks(_documents(spark, folder), table(spark, folder, "eval_items"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return spam.find_spam(_documents(spark, folder)).select("doc_id").distinct()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_clusters": p1_clusters,
    "p2_found": p2_found,
    "p2_kinds": p2_kinds,
    "p3_found": p3_found,
    "p3_sentences": p3_sentences,
    "p4_found": p4_found,
    "p4_text": p4_text,
    "p5_found": p5_found,
    "p5_groups": p5_groups,
    "p6_found": p6_found,
    "p6_languages": p6_languages,
    "p6_documents": p6_documents,
    "p7_ids": p7_ids,
    "p8_found": p8_found,
    "p8_clean": p8_clean,
    "p9_found": p9_found,
}

_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"

#: The similar pairs by comparing the shingles of all records; the others are tested against brute force, round trips
#: and fixtures, as SQL has no form for them.
ORACLES: dict[str, str] = {
    "p5_found": rf"""WITH texts AS (SELECT cache_id, regexp_replace(lower(concat_ws(chr(10), coalesce(path, ''), array_to_string(list_transform(coalesce(pages, []), lambda p: coalesce(p, '')), chr(10)))), '{_SPACE}+', '', 'g') AS t
 FROM extraction_cache WHERE cache_id IS NOT NULL AND len(array_to_string(list_filter(coalesce(pages, []), lambda p: p IS NOT NULL), '')) >= 200),
places AS (SELECT cache_id, t, unnest(range(1, CAST(len(t) AS BIGINT) - 6)) AS i FROM texts),
shingles AS (SELECT DISTINCT cache_id, hash(substr(t, CAST(i AS BIGINT), 8)) AS s FROM places),
sizes AS (SELECT cache_id, count(*) AS n FROM shingles GROUP BY cache_id),
common AS (SELECT a.cache_id AS a, b.cache_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.cache_id < b.cache_id GROUP BY ALL)
SELECT a AS cache_id_a, b AS cache_id_b FROM common JOIN sizes x ON x.cache_id = a JOIN sizes y ON y.cache_id = b WHERE common.n >= 0.6 * (x.n + y.n - common.n)""",
}
