"""Queries of the engine over the tables of a folder, and the same rows as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from scriptorium.functions import text as T
from scriptorium.functions.taxonomy import NATIVE_VARIANTS, Taxonomy, Variant, pattern_of, variants_of
from scriptorium.operators import biblio, canvas, concepts, markup, sensitivity
from scriptorium.operators.numbered import numbered
from scriptorium.operators.spread import spread
from scriptorium.plans import fixtures
from scriptorium.plans.page import html_page
from scriptorium.sources import corpus

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL where there is one."""

    def register(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql:
            ORACLES[run.__name__] = sql
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(spark: SparkSession, folder: str, columns: list[str], name: str = "extraction_cache") -> DataFrame:
    """The named columns of a table of texts, on all cores even if it is one small file."""
    return spread(table(spark, folder, name).select(*columns))


def _taxonomy(spark: SparkSession, folder: str) -> Taxonomy:
    return Taxonomy.from_table(table(spark, folder, "taxonomy"))


#: Excluded phrases that may be part of a plan; a longer list is an error.
MAX_PHRASES = 1000


def _phrases(spark: SparkSession, folder: str) -> list[str]:
    # a list of phrases is part of the plan, like the taxonomy
    rows = table(spark, folder, "excluded_phrases").where("phrase IS NOT NULL").orderBy("phrase").limit(MAX_PHRASES + 1).collect()
    if len(rows) > MAX_PHRASES:
        raise ValueError(f"a list of more than {MAX_PHRASES} excluded phrases can't be part of a plan")
    return [r["phrase"] for r in rows]


def _profiles(spark: SparkSession, folder: str, discount: bool = True) -> tuple[DataFrame, Taxonomy]:
    taxonomy = _taxonomy(spark, folder)
    phrases = _phrases(spark, folder) if discount else []
    return concepts.profile(texts(spark, folder, ["cache_id", "path", "pages"]), taxonomy, phrases, keep=["cache_id", "path"]), taxonomy


# ---- SQL building blocks ----------------------------------------------------------------------------------------

_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_LETTER = r"[\p{L}\p{M}\p{N}_]"
_RAW = "array_to_string(list_transform(coalesce(pages, []), lambda p: coalesce(p, '')), chr(10))"


def _closed(text: str) -> str:
    return f"regexp_replace({text}, '({_LETTER})-{_SPACE}*\\n{_SPACE}*({_LETTER})', '\\1\\2', 'g')"


def _collapsed(text: str) -> str:
    return f"regexp_replace({text}, '{_SPACE}+', ' ', 'g')"


_DOCS = f"docs AS (SELECT cache_id, path, {_collapsed(_closed(_RAW))} AS text FROM extraction_cache)"
_PATTERN = r"'(?i)\b(?:' || array_to_string(variants, '|') || ')\\b'".replace("\\\\b", r"\b")
_TAX = f"tax AS (SELECT frame, frame_ord, concept, concept_ord, {_PATTERN} AS pattern FROM taxonomy)"
_PLAIN = "plain AS (SELECT cache_id, path, text, frame, frame_ord, concept, concept_ord, pattern, len(regexp_extract_all(text, pattern)) AS raw FROM docs, tax)"
_KEPT = """hit AS (SELECT *, regexp_extract_all(text, pattern) AS hits, string_split_regex(text, pattern) AS gaps FROM plain WHERE raw > 0),
starts AS (SELECT *, list_transform(range(1, raw + 1), lambda i: CAST(list_sum(list_transform(gaps[1:i], lambda g: len(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: len(h))), 0) AS BIGINT)) AS pos FROM hit),
near AS (SELECT *, list_transform(range(1, raw + 1), lambda i: lower(substr(text, CAST(greatest(0, pos[i] - 40) AS BIGINT) + 1, CAST(pos[i] + len(hits[i]) + 40 - greatest(0, pos[i] - 40) AS BIGINT)))) AS around FROM starts),
phrases AS (SELECT list(lower(phrase)) AS ps FROM excluded_phrases),
kept AS (SELECT cache_id, concept, len(list_filter(around, lambda a: len(list_filter(ps, lambda p: contains(a, p))) = 0)) AS kept FROM near, phrases),
counts AS (SELECT p.cache_id, p.path, p.text, p.frame, p.frame_ord, p.concept, p.concept_ord, p.raw, CAST(coalesce(k.kept, 0) AS BIGINT) AS hits FROM plain p LEFT JOIN kept k USING (cache_id, concept))"""
_COUNTS = f"WITH {_DOCS}, {_TAX}, {_PLAIN}, {_KEPT}"
_FRAMES = "frames AS (SELECT cache_id, frame, frame_ord, sum(hits) AS n FROM counts GROUP BY ALL)"
_NOT_BLANK = r"regexp_matches({}, '[^\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]')"
_PROFILE = f"""{_COUNTS}, {_FRAMES},
best AS (SELECT cache_id, arg_max(frame, n * 1000 - frame_ord) AS frame, sum(n) AS total FROM frames GROUP BY cache_id),
profile AS (SELECT c.cache_id, any_value(c.path) AS path, CAST(any_value(len(c.text)) AS BIGINT) AS char_count, any_value({_NOT_BLANK.format("c.text")}) AS extraction_ok,
 CAST(any_value(b.total) AS BIGINT) AS total_hits, CAST(count(*) FILTER (hits > 0) AS BIGINT) AS breadth, any_value(CASE WHEN b.total > 0 THEN b.frame END) AS dominant_frame
 FROM counts c JOIN best b USING (cache_id) GROUP BY c.cache_id)"""


# ---- concepts ---------------------------------------------------------------------------------------------------


@query(f"WITH {_DOCS} SELECT cache_id, CAST(len(text) AS BIGINT) AS char_count, {_NOT_BLANK.format('text')} AS extraction_ok FROM docs")
def text_normalised(spark: SparkSession, folder: str) -> DataFrame:
    text = T.normalise(T.join_pages(F.col("pages")))
    return table(spark, folder, "extraction_cache").select("cache_id", F.length(text).cast("bigint").alias("char_count"), (~T.is_blank(text)).alias("extraction_ok"))


@query(f"WITH {_DOCS}, {_TAX}, {_PLAIN} SELECT cache_id, frame, concept, CAST(raw AS BIGINT) AS hits FROM plain")
def concept_hits_long(spark: SparkSession, folder: str) -> DataFrame:
    profiled, taxonomy = _profiles(spark, folder, discount=False)
    return concepts.hits_long(profiled, taxonomy, ["cache_id"]).withColumn("hits", F.col("hits").cast("bigint"))


@query(f"{_COUNTS} SELECT cache_id, concept, CAST(raw AS BIGINT) AS raw_hits, hits AS kept_hits FROM counts WHERE raw > 0")
def context_discount(spark: SparkSession, folder: str) -> DataFrame:
    taxonomy, phrases = _taxonomy(spark, folder), _phrases(spark, folder)
    counted = concepts.count_concepts(texts(spark, folder, ["cache_id", "pages"]), taxonomy, phrases, keep=["cache_id"])
    rows = F.array(*(F.struct(F.lit(c).alias("concept"), F.col(f"raw__{c}").cast("bigint").alias("raw_hits"), F.col(f"concept__{c}").cast("bigint").alias("kept_hits")) for c in taxonomy.concepts))
    return counted.select("cache_id", F.inline(rows)).where("raw_hits > 0")


@query(f"{_PROFILE} SELECT cache_id, path, char_count, extraction_ok, total_hits, breadth, dominant_frame FROM profile")
def doc_profile(spark: SparkSession, folder: str) -> DataFrame:
    profiled, _ = _profiles(spark, folder)
    return profiled.select("cache_id", "path", *(F.col(c).cast("bigint").alias(c) for c in ("char_count",)), "extraction_ok", F.col("total_hits").cast("bigint").alias("total_hits"), F.col("breadth").cast("bigint").alias("breadth"), "dominant_frame")


@query(f"{_COUNTS}, {_FRAMES}, total AS (SELECT cache_id, sum(n) AS total FROM frames GROUP BY cache_id) SELECT cache_id, frame, CAST(n AS BIGINT) AS hits, CASE WHEN total > 0 THEN n / total ELSE 0.0 END AS share FROM frames JOIN total USING (cache_id)")
def frame_shares(spark: SparkSession, folder: str) -> DataFrame:
    profiled, taxonomy = _profiles(spark, folder)
    rows = F.array(*(F.struct(F.lit(f).alias("frame"), F.col(f"frame_hits__{f}").cast("bigint").alias("hits"), F.col(f"frame_share__{f}").alias("share")) for f in taxonomy.frame_order))
    return profiled.select("cache_id", F.inline(rows))


@query(f"{_PROFILE}, spine AS (SELECT CASE WHEN i = 6 THEN '6+' ELSE CAST(i AS VARCHAR) END AS bucket, i FROM range(7) t(i)) SELECT bucket, CAST(count(p.cache_id) AS BIGINT) AS documents, CAST((SELECT count(*) FROM profile) AS BIGINT) AS n_documents FROM spine LEFT JOIN profile p ON least(p.breadth, 6) = i GROUP BY bucket")
def breadth_hist(spark: SparkSession, folder: str) -> DataFrame:
    return concepts.breadth_histogram(_profiles(spark, folder)[0])


@query(f"{_COUNTS}, s AS (SELECT frame, CAST(sum(hits) AS BIGINT) AS total_hits FROM counts GROUP BY frame) SELECT frame, total_hits, CAST(sum(total_hits) OVER () AS BIGINT) AS all_hits, CASE WHEN sum(total_hits) OVER () > 0 THEN total_hits / (sum(total_hits) OVER ()) ELSE 0.0 END AS share FROM s")
def frame_dominance(spark: SparkSession, folder: str) -> DataFrame:
    profiled, taxonomy = _profiles(spark, folder)
    return concepts.frame_dominance(profiled, taxonomy)


@query(f"{_COUNTS} SELECT frame, concept, CAST(sum(hits) AS BIGINT) AS hits FROM counts GROUP BY ROLLUP (frame, concept)")
def frame_rollup(spark: SparkSession, folder: str) -> DataFrame:
    profiled, taxonomy = _profiles(spark, folder)
    return concepts.frame_rollup(concepts.hits_long(profiled, taxonomy, ["cache_id"]))


@query(f"{_PROFILE} SELECT count(*) AS n_documents, count(*) FILTER (breadth = 0) AS n_zero, count(*) FILTER (NOT extraction_ok) AS n_failed FROM profile")
def zero_docs(spark: SparkSession, folder: str) -> DataFrame:
    return concepts.zero_documents(_profiles(spark, folder)[0])


@query(f"{_PROFILE} SELECT CAST(row_number() OVER (ORDER BY total_hits DESC, string_split(path, '/'), cache_id) AS INTEGER) AS rank, total_hits, breadth FROM profile QUALIFY rank <= 40")
def top_documents(spark: SparkSession, folder: str) -> DataFrame:
    # the report's length; records read twice share a path, so only what they cannot differ in is compared
    top = concepts.top_documents(_profiles(spark, folder)[0])
    return top.select("rank", F.col("total_hits").cast("bigint").alias("total_hits"), F.col("breadth").cast("bigint").alias("breadth"))


def _json_lines(*lines: str) -> str:
    return " || chr(10) || ".join(lines)


_SUMMARY_TEXT = _json_lines(
    "'{'",
    """'  "n_documents_analyzed": ' || n || ','""",
    """'  "n_documents_zero_concepts": ' || n0 || ','""",
    """'  "pct_documents_zero_concepts": ' || CAST(round(100.0 * n0 / n, 2) AS DOUBLE) || ','""",
    """'  "breadth_histogram": {'""",
    "(SELECT string_agg(line, ',' || chr(10) ORDER BY i) FROM b)",
    "'  },'",
    """'  "frame_dominance": {'""",
    "(SELECT string_agg(line, ',' || chr(10) ORDER BY frame_ord) FROM d)",
    "'  }'",
    "'}'",
)
_SUMMARY = f"""{_PROFILE}, spine AS (SELECT CASE WHEN i = 6 THEN '6+' ELSE CAST(i AS VARCHAR) END AS bucket, i FROM range(7) t(i)),
b AS (SELECT i, '    "' || bucket || '": {{' || chr(10) || '      "documents": ' || count(p.cache_id) || ',' || chr(10) || '      "pct_of_corpus": ' || CAST(round(100.0 * count(p.cache_id) / (SELECT count(*) FROM profile), 2) AS DOUBLE) || chr(10) || '    }}' AS line
 FROM spine LEFT JOIN profile p ON least(p.breadth, 6) = i GROUP BY bucket, i),
d AS (SELECT frame_ord, '    "' || frame || '": {{' || chr(10) || '      "total_hits": ' || CAST(sum(hits) AS BIGINT) || ',' || chr(10) || '      "pct_of_all_concept_hits": ' || CAST(round(100 * (sum(hits) / (SELECT sum(hits) FROM counts)), 2) AS DOUBLE) || chr(10) || '    }}' AS line FROM counts GROUP BY frame, frame_ord),
z AS (SELECT count(*) AS n, count(*) FILTER (breadth = 0) AS n0 FROM profile)
SELECT {_SUMMARY_TEXT} AS summary FROM z"""


@query(_SUMMARY)
def summary_json(spark: SparkSession, folder: str) -> DataFrame:
    return concepts.summary(*_profiles(spark, folder))


# ---- variants ---------------------------------------------------------------------------------------------------

#: What the standard steps add to the taxonomy of the test tables.
TABLE_FORMS = (
    {"tenure": {"tenure_adj": ["customary"]}, "extraction": {"extraction_adj": ["maritime"]}},
    {"mobility": {"mobility_adj": ["mobile"]}},
    {"labour": {"labour_adj": ["unpaid"], "skill_adj": ["skilled"]}},
    {"tenure": {"commons": ["pastures?"]}, "labour": {"guild": ["weavers?"]}},
)


def _table_variants(spark: SparkSession, folder: str) -> tuple[Variant, ...]:
    return variants_of(_taxonomy(spark, folder), *TABLE_FORMS)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _variant_sql(variants: tuple[Variant, ...], base: bool) -> str:
    """SQL of the matrix; with ``base`` the patterns of the taxonomy table are joined to the forms added here."""
    rows = [f"({_quoted(v.name)}, {_quoted(v.unit)}, {_quoted(frame)}, {_quoted(concept)}, [{', '.join(map(_quoted, forms)) or ''}]::VARCHAR[])" for v in variants for frame, cs in v.taxonomy.frames for concept, forms in cs]
    names = ", ".join(f"({_quoted(v.name)}, {_quoted(v.unit)})" for v in variants)
    added = f"added(variant, unit, frame, concept, forms) AS (VALUES {', '.join(rows)})" if rows else ""
    if base:
        patterns = f"""names(variant, unit) AS (VALUES {names}), {added},
every AS (SELECT n.variant, n.unit, t.frame, t.concept, t.variants AS forms FROM names n, taxonomy t UNION ALL SELECT * FROM added),
joined AS (SELECT variant, unit, frame, concept, flatten(list(forms)) AS forms FROM every GROUP BY ALL)"""
        patterns = patterns.replace("GROUP BY ALL)", "GROUP BY variant, unit, frame, concept)")
    else:
        patterns = f"{added}, joined AS (SELECT * FROM added)"
    word = r"'(?i)\b(?:' || array_to_string(forms, '|') || ')\b'"
    pieces = f"string_split(regexp_replace(p, '([.!?]){_SPACE}+', '\\1' || chr(1), 'g'), chr(1))"
    return f"""WITH {patterns}, pat AS (SELECT variant, unit, frame, concept, {word} AS pattern FROM joined),
{_DOCS},
pieces AS (SELECT cache_id, flatten(list_transform(list_filter(list_transform(coalesce(pages, []), lambda p: coalesce(p, '')), lambda p: {_NOT_BLANK.format('p')}), lambda q: list_transform([{_collapsed('q')}], lambda p: {pieces})[1])) AS ss FROM extraction_cache),
counted AS (SELECT d.cache_id, variant, frame, CASE WHEN unit = 'token' THEN len(regexp_extract_all(d.text, pattern)) ELSE len(list_filter(ss, lambda s: regexp_matches(s, pattern))) END AS n FROM docs d JOIN pieces USING (cache_id), pat),
per_doc AS (SELECT cache_id, variant, sum(n) AS total FROM counted GROUP BY ALL),
zero AS (SELECT variant, count(*) FILTER (total = 0) AS n_zero, count(*) AS n_docs FROM per_doc GROUP BY variant),
frames AS (SELECT variant, frame, sum(n) AS hits FROM counted GROUP BY ALL)
SELECT variant, frame, CAST(hits AS BIGINT) AS hits, CAST(sum(hits) OVER (PARTITION BY variant) AS BIGINT) AS all_hits, CAST(n_zero AS BIGINT) AS n_zero, CAST(n_docs AS BIGINT) AS n_docs FROM frames JOIN zero USING (variant)"""


def _matrix(spark: SparkSession, folder: str, variants: tuple[Variant, ...]) -> DataFrame:
    found = sensitivity.sensitivity_matrix(texts(spark, folder, ["pages"]), variants)
    return found.select("variant", "frame", *(F.col(c).cast("bigint").alias(c) for c in ("hits", "all_hits", "n_zero", "n_docs")))


_EMPTY = Taxonomy.of({f: {} for f in ("tenure", "extraction", "mobility", "labour")})


@query(_variant_sql(variants_of(_EMPTY, *TABLE_FORMS), base=True))
def sensitivity_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return _matrix(spark, folder, _table_variants(spark, folder))


@query(_variant_sql(NATIVE_VARIANTS, base=False))
def native_sensitivity(spark: SparkSession, folder: str) -> DataFrame:
    return _matrix(spark, folder, NATIVE_VARIANTS)


@query(f"""WITH {_TAX}, s AS (SELECT unnest(string_split(regexp_replace({_collapsed('p')}, '([.!?]){_SPACE}+', '\\1' || chr(1), 'g'), chr(1))) AS s FROM (SELECT unnest(pages) AS p FROM extraction_cache) WHERE {_NOT_BLANK.format('p')})
SELECT concept, CAST(count(*) FILTER (regexp_matches(s, pattern)) AS BIGINT) AS n_sentences FROM s, tax GROUP BY concept""")
def sentence_presence(spark: SparkSession, folder: str) -> DataFrame:
    taxonomy = _taxonomy(spark, folder)
    matrix = Variant("only", taxonomy, "sentence")
    # a frame of its own for each concept gives the counts by concept
    split = Taxonomy.of({c: {c: v} for c, v in matrix.taxonomy.patterns.items()})
    return sensitivity.sensitivity_matrix(texts(spark, folder, ["pages"]), (Variant("only", split, "sentence"),)).select(F.col("frame").alias("concept"), F.col("hits").cast("bigint").alias("n_sentences"))


# ---- sources and text -------------------------------------------------------------------------------------------

EXCLUDED = ("week0[1-3]", "ledger", r"\Q[copy\E")


@query(r"SELECT cache_id, path FROM extraction_cache WHERE NOT regexp_matches(path, '(?i)week0[1-3]|ledger|\[copy')")
def exclusion_anti(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.without_excluded(table(spark, folder, "extraction_cache"), EXCLUDED).select("cache_id", "path")


@query(f"SELECT cache_id, CAST(len(raw) AS BIGINT) AS n_raw, CAST(len({_closed('raw')}) AS BIGINT) AS n_closed FROM (SELECT cache_id, {_RAW} AS raw FROM extraction_cache)")
def dehyphenate(spark: SparkSession, folder: str) -> DataFrame:
    raw = T.join_pages(F.col("pages"))
    return table(spark, folder, "extraction_cache").select("cache_id", F.length(raw).cast("bigint").alias("n_raw"), F.length(T.close_hyphens(raw)).cast("bigint").alias("n_closed"))


@query("SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS html FROM documents")
def html_escape(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", T.escape_html(F.col("text")).alias("html"))


# ---- bibliographies ---------------------------------------------------------------------------------------------

_LINES = f"""raw AS (SELECT cache_id, {_RAW} AS t FROM extraction_cache),
lines AS (SELECT cache_id, i, ls[i] AS line, regexp_replace(ls[i], '^{_SPACE}+|{_SPACE}+$', '', 'g') AS bare FROM (SELECT cache_id, string_split(t, chr(10)) AS ls FROM raw), range(1, 100000) r(i) WHERE i <= len(ls)),
marked AS (SELECT *, regexp_matches(bare, '(?i)^(references|bibliography|works cited|literature cited|reference list)$') AS head, regexp_matches(bare, '(?i)^(index|appendix|acknowledg(e)?ments|notes|about the author)$') AS stop FROM lines),
section AS (SELECT *, sum(CAST(head AS INTEGER)) OVER (PARTITION BY cache_id ORDER BY i) AS sec FROM marked),
stopped AS (SELECT *, max(CAST(stop AS INTEGER)) OVER (PARTITION BY cache_id, sec ORDER BY i) AS s FROM section WHERE sec > 0),
spans AS (SELECT cache_id, sec, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT head AND s = 0), '') AS span FROM stopped GROUP BY cache_id, sec),
biblio AS (SELECT cache_id, string_agg(span, chr(10) ORDER BY sec) AS biblio FROM spans GROUP BY cache_id)"""


@query(f"WITH {_LINES} SELECT cache_id, biblio FROM biblio WHERE biblio <> ''")
def biblio_sections(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "extraction_cache").select("cache_id", biblio.bibliography_text(F.col("pages")).alias("biblio")).where("biblio <> ''")


_STRIPPED = f"regexp_replace(e, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _parts(pattern: str) -> str:
    doubled = "replace(clean, chr(10), chr(10) || chr(10))"
    cut = f"string_split(regexp_replace({doubled}, '\\n({pattern})', chr(1) || '\\1', 'g'), chr(1))"
    return f"list_filter(list_transform({cut}, lambda e: regexp_replace(replace(e, chr(10) || chr(10), chr(10)), '^{_SPACE}+|{_SPACE}+$', '', 'g')), lambda e: e <> '')"


_ENTRIES = f"""{_LINES}, clean AS (SELECT cache_id, {_closed('biblio')} AS clean FROM biblio WHERE biblio <> ''),
both_ways AS (SELECT cache_id, clean, {_parts("[A-Z][A-Za-zÀ-ſ''\\-]+,[\\s\\x0b\\x1c-\\x1f]")} AS ad, {_parts("(?:\\[[0-9]{1,4}\\]|[0-9]{1,4}\\.)[\\s\\x0b\\x1c-\\x1f]")} AS num FROM clean),
chosen AS (SELECT cache_id, CASE WHEN NOT (len(ad) >= 3 AND len(clean) / greatest(len(ad), 1) < 600) AND len(num) >= 3 THEN 'numbered' ELSE 'author_date' END AS style_guess, ad, num FROM both_ways)"""


@query(f"WITH {_ENTRIES} SELECT cache_id, style_guess, array_to_string(CASE WHEN style_guess = 'numbered' THEN num ELSE ad END, chr(2)) AS entries FROM chosen")
def entry_split(spark: SparkSession, folder: str) -> DataFrame:
    found = table(spark, folder, "extraction_cache").select("cache_id", biblio.bibliography_text(F.col("pages")).alias("b")).where("b <> ''")
    return found.select("cache_id", biblio.split_entries(F.col("b")).alias("s")).select("cache_id", "s.style_guess", F.array_join("s.entries", "\x02").alias("entries"))


_SURNAME = r"[A-Z][A-Za-zÀ-ſ''\-]"
_KEY_OF = rf"""text AS (SELECT *, regexp_replace(regexp_replace({_collapsed('raw_entry')}, '^(?:\[[0-9]{{1,4}}\]|[0-9]{{1,4}}\.){_SPACE}*', ''), '^{_SPACE}+|{_SPACE}+$', '', 'g') AS t FROM {{entries}}),
year AS (SELECT *, CASE WHEN regexp_matches(t, '\([0-9]{{4}}[a-z]?\)') THEN regexp_extract(t, '\(([0-9]{{4}}[a-z]?)\)', 1) ELSE nullif(regexp_extract(t, '\b(?:19|20)[0-9]{{2}}[a-z]?\b'), '') END AS y,
 CASE WHEN regexp_matches(t, '\([0-9]{{4}}[a-z]?\)') THEN regexp_extract(t, '(?s)^(.*?)\([0-9]{{4}}[a-z]?\)', 1) ELSE regexp_extract(t, '(?s)^(.*?)\b(?:19|20)[0-9]{{2}}[a-z]?\b', 1) END AS before FROM text),
name AS (SELECT *, coalesce(nullif(regexp_extract(before, '^({_SURNAME}+)', 1), ''), nullif(regexp_extract(before, '^(?:[A-Z]\.{_SPACE}*){{1,3}}({_SURNAME}+)', 1), ''), nullif(regexp_extract(before, '(?:^|[^\p{{L}}\p{{M}}\p{{N}}_])({_SURNAME}{{2,}})', 1), '')) AS s FROM year)"""
_KEY = _KEY_OF.replace("{entries}", "per_document_entries")


@query(f"WITH {_KEY} SELECT entry_id, CASE WHEN y IS NOT NULL THEN s END AS surname, CASE WHEN s IS NOT NULL THEN y END AS year FROM name")
def citation_keys(spark: SparkSession, folder: str) -> DataFrame:
    return texts(spark, folder, ["entry_id", "raw_entry"], "per_document_entries").select("entry_id", biblio.citation_key(F.col("raw_entry")).alias("k")).select("entry_id", "k.surname", "k.year")


@query("SELECT cache_id, string_split(path, '/')[-1] AS filename, CAST(dense_rank() OVER (ORDER BY string_split(path, '/')) AS BIGINT) AS place FROM extraction_cache WHERE path IS NOT NULL")
def corpus_order(spark: SparkSession, folder: str) -> DataFrame:
    # path order compares the parts of a path; places come from the distinct paths, so that copies share one
    cache = table(spark, folder, "extraction_cache").where("path IS NOT NULL").select("cache_id", "path")
    ranked = numbered(cache.select("path").distinct(), [F.split("path", "/")], "place")
    return cache.join(ranked, "path").select("cache_id", T.file_name(F.col("path")).alias("filename"), "place")


_PARSED = "FROM per_document_entries WHERE surname <> '' AND year <> ''"


@query(f"SELECT lower(surname) AS surname, year, CAST(count(DISTINCT document) AS BIGINT) AS cited_by_n_documents {_PARSED} GROUP BY ALL")
def most_cited_works(spark: SparkSession, folder: str) -> DataFrame:
    return biblio.most_cited_works(table(spark, folder, "per_document_entries"))


#: Where an entry stands: its document in path order, and its number.
_SEEN = "struct_pack(d := string_split(document, '/'), e := entry_id)"


def _entries_in_order(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "per_document_entries").select("document", F.col("entry_id").alias("entry_no"), "surname", "year")


@query(f"WITH w AS (SELECT lower(surname) AS surname, year, count(DISTINCT document) AS n, min({_SEEN}) AS first {_PARSED} GROUP BY ALL) SELECT row_number() OVER (ORDER BY n DESC, first, surname, year) AS rank, surname, year, CAST(n AS BIGINT) AS cited_by_n_documents FROM w")
def works_in_order(spark: SparkSession, folder: str) -> DataFrame:
    """The whole report of works: most cited first, ties as they first appear in document order."""
    parsed = _entries_in_order(spark, folder)
    return biblio.ranked_by_popularity(biblio.most_cited_works(parsed), parsed, ["surname", "year"])


@query(f"WITH a AS (SELECT lower(surname) AS surname, count(DISTINCT document) AS n, min({_SEEN}) AS first {_PARSED} GROUP BY ALL) SELECT row_number() OVER (ORDER BY n DESC, first, surname) AS rank, surname, CAST(n AS BIGINT) AS cited_by_n_documents FROM a")
def authors_in_order(spark: SparkSession, folder: str) -> DataFrame:
    """The whole report of authors, in the same order."""
    parsed = _entries_in_order(spark, folder)
    return biblio.ranked_by_popularity(biblio.most_cited_authors(parsed), parsed, ["surname"])


@query(f"SELECT lower(surname) AS surname, CAST(count(DISTINCT document) AS BIGINT) AS cited_by_n_documents {_PARSED} GROUP BY ALL")
def most_cited_authors(spark: SparkSession, folder: str) -> DataFrame:
    return biblio.most_cited_authors(table(spark, folder, "per_document_entries"))


@query(f"""WITH {_ENTRIES}, e AS (SELECT cache_id, unnest(CASE WHEN style_guess = 'numbered' THEN num ELSE ad END) AS raw_entry FROM chosen),
{_KEY_OF.replace("{entries}", "e")}, n AS (SELECT count(*) AS n_entries FROM e) SELECT (SELECT count(*) FROM extraction_cache) AS n_documents, (SELECT count(*) FROM biblio WHERE biblio <> '') AS n_with_bibliography, n_entries, (SELECT count(*) FROM name WHERE y IS NOT NULL AND s IS NOT NULL) AS n_parsed FROM n""")
def biblio_coverage(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "extraction_cache")
    return biblio.coverage(documents, biblio.entries(documents))


@query(f"""WITH {_ENTRIES}, e AS (SELECT path AS document, style_guess, unnest(CASE WHEN style_guess = 'numbered' THEN num ELSE ad END) AS raw_entry, unnest(range(0, len(CASE WHEN style_guess = 'numbered' THEN num ELSE ad END))) AS entry_no FROM chosen JOIN extraction_cache USING (cache_id)),
{_KEY_OF.replace("{entries}", "e")} SELECT document, CAST(entry_no AS INTEGER) AS entry_no, style_guess, CASE WHEN y IS NOT NULL THEN s END AS surname, CASE WHEN s IS NOT NULL THEN y END AS year, substr(raw_entry, 1, 300) AS raw_entry FROM name""")
def biblio_entries(spark: SparkSession, folder: str) -> DataFrame:
    return biblio.entries(texts(spark, folder, ["path", "pages"]))


# ---- canvases ---------------------------------------------------------------------------------------------------

_VOLUME_NODES = "SELECT event_id AS id, event_id AS ord, CASE WHEN event_type = 'purchase' THEN 'group' ELSE 'text' END AS type, CAST((event_id * 37) % 5003 AS DOUBLE) AS x, CAST((event_id * 91) % 4001 AS DOUBLE) AS y, CAST(40 + user_id % 160 AS DOUBLE) AS width, CAST(30 + event_id % 90 AS DOUBLE) AS height FROM events"
_VOLUME_EDGES = "SELECT event_id AS ord, event_id AS \"fromNode\", (event_id * 7) % 12000 AS \"toNode\", CAST(NULL AS VARCHAR) AS \"fromSide\", CASE WHEN event_id % 5 = 0 THEN 'top' END AS \"toSide\", CAST(NULL AS VARCHAR) AS \"fromEnd\", CASE WHEN event_id % 3 = 0 THEN 'none' END AS \"toEnd\", CASE WHEN event_id % 4 = 0 THEN '4' WHEN event_id % 4 = 1 THEN '#123456' END AS color, CASE WHEN event_id % 6 = 0 THEN event_type || chr(10) || '<' || event_id || ' & co' END AS label FROM events"


def _volume(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges made of the events table, to run the layout at its size."""
    e = table(spark, folder, "events")
    i = F.col("event_id")
    nodes = e.select(i.alias("id"), i.alias("ord"), F.when(F.col("event_type") == "purchase", "group").otherwise("text").alias("type"), ((i * 37) % 5003).cast("double").alias("x"), ((i * 91) % 4001).cast("double").alias("y"), (40 + F.col("user_id") % 160).cast("double").alias("width"), (30 + i % 90).cast("double").alias("height"))
    edges = e.select(i.alias("ord"), i.alias("fromNode"), ((i * 7) % 12000).alias("toNode"), F.lit(None).cast("string").alias("fromSide"), F.when(i % 5 == 0, "top").alias("toSide"), F.lit(None).cast("string").alias("fromEnd"), F.when(i % 3 == 0, "none").alias("toEnd"), F.when(i % 4 == 0, "4").when(i % 4 == 1, "#123456").alias("color"), F.when(i % 6 == 0, F.concat("event_type", F.lit("\n<"), i.cast("string"), F.lit(" & co"))).alias("label"))
    return nodes, edges


@query(f"WITH n AS ({_VOLUME_NODES}), b AS (SELECT min(x) AS x0, min(y) - CASE WHEN bool_or(type = 'group') THEN 40 ELSE 0 END AS y0, max(x + width) AS x1, max(y + height) AS y1 FROM n) SELECT x0, y0, x1, y1, CAST(ceil(x1 - x0 + 160) AS BIGINT) AS width, CAST(ceil(y1 - y0 + 160) AS BIGINT) AS height FROM b")
def canvas_bbox(spark: SparkSession, folder: str) -> DataFrame:
    return canvas.bounding_box(_volume(spark, folder)[0])


@query(f"WITH n AS ({_VOLUME_NODES}) SELECT id, type = 'group' AS is_group, CASE WHEN type = 'group' THEN -width * height END AS paint, ord FROM n")
def paint_order(spark: SparkSession, folder: str) -> DataFrame:
    return canvas.paint_order(_volume(spark, folder)[0]).select("id", "is_group", "paint", "ord")


_JOINED = f"WITH n AS ({_VOLUME_NODES}), e AS ({_VOLUME_EDGES}), j AS (SELECT e.*, a.x AS ax, a.y AS ay, a.width AS aw, a.height AS ah, b.x AS bx, b.y AS by_, b.width AS bw, b.height AS bh FROM e JOIN n a ON a.id = e.\"fromNode\" JOIN n b ON b.id = e.\"toNode\")"


@query(f'{_JOINED} SELECT ord, "fromNode" AS from_node, "toNode" AS to_node FROM j')
def edge_join(spark: SparkSession, folder: str) -> DataFrame:
    return canvas.joined_edges(*_volume(spark, folder)).select("ord", F.col("fromNode").alias("from_node"), F.col("toNode").alias("to_node"))


def _sides() -> str:
    across = "abs(dx) * greatest(ah, 1) > abs(dy) * greatest(aw, 1)"
    return f"""{_JOINED}, d AS (SELECT *, (bx + bw / 2) - (ax + aw / 2) AS dx, (by_ + bh / 2) - (ay + ah / 2) AS dy FROM j),
s AS (SELECT *, coalesce("fromSide", CASE WHEN {across} THEN CASE WHEN dx > 0 THEN 'right' ELSE 'left' END WHEN dy > 0 THEN 'bottom' ELSE 'top' END) AS fs,
 coalesce("toSide", CASE WHEN {across} THEN CASE WHEN dx > 0 THEN 'left' ELSE 'right' END WHEN dy > 0 THEN 'top' ELSE 'bottom' END) AS ts FROM d),
p AS (SELECT *, CASE fs WHEN 'left' THEN ax WHEN 'right' THEN ax + aw ELSE ax + aw / 2 END AS x0, CASE fs WHEN 'top' THEN ay WHEN 'bottom' THEN ay + ah ELSE ay + ah / 2 END AS y0,
 CASE ts WHEN 'left' THEN bx WHEN 'right' THEN bx + bw ELSE bx + bw / 2 END AS x3, CASE ts WHEN 'top' THEN by_ WHEN 'bottom' THEN by_ + bh ELSE by_ + bh / 2 END AS y3 FROM s),
k AS (SELECT *, greatest(40.0, least(0.5 * sqrt((x3 - x0) * (x3 - x0) + (y3 - y0) * (y3 - y0)), 250.0)) AS k FROM p),
q AS (SELECT *, x0 + CASE fs WHEN 'left' THEN -k WHEN 'right' THEN k ELSE 0 END AS x1, y0 + CASE fs WHEN 'top' THEN -k WHEN 'bottom' THEN k ELSE 0 END AS y1, x3 + CASE ts WHEN 'left' THEN -k WHEN 'right' THEN k ELSE 0 END AS x2, y3 + CASE ts WHEN 'top' THEN -k WHEN 'bottom' THEN k ELSE 0 END AS y2 FROM k)"""


_GEOMETRY = f"""{_sides()}
SELECT ord, fs AS from_side, ts AS to_side, x0, y0, round(x1, 4) AS x1, round(y1, 4) AS y1, round(x2, 4) AS x2, round(y2, 4) AS y2, x3, y3, round(k, 4) AS k, round(0.125 * x0 + 0.375 * x1 + 0.375 * x2 + 0.125 * x3, 4) AS label_x, round(0.125 * y0 + 0.375 * y1 + 0.375 * y2 + 0.125 * y3, 4) AS label_y,
 coalesce("toEnd", 'arrow') = 'arrow' AS arrow_at_end, coalesce("fromEnd", 'none') = 'arrow' AS arrow_at_start, CASE WHEN color = '4' THEN '#44cf6e' WHEN color IS NULL THEN '#a3a3a3' ELSE color END AS stroke FROM q"""


@query(_GEOMETRY)
def edge_geometry(spark: SparkSession, folder: str) -> DataFrame:
    g = canvas.edge_geometry(canvas.joined_edges(*_volume(spark, folder)))
    r = lambda c: F.round(F.col(c), 4)
    return g.select("ord", "from_side", "to_side", F.col("p0.x").alias("x0"), F.col("p0.y").alias("y0"), r("p1.x").alias("x1"), r("p1.y").alias("y1"), r("p2.x").alias("x2"), r("p2.y").alias("y2"), F.col("p3.x").alias("x3"), F.col("p3.y").alias("y3"), r("k").alias("k"), r("label_x").alias("label_x"), r("label_y").alias("label_y"), "arrow_at_end", "arrow_at_start", "stroke")


@query(f"WITH n AS ({_VOLUME_NODES}), e AS ({_VOLUME_EDGES}) SELECT (SELECT count(*) FROM n) AS n_nodes, (SELECT count(*) FROM n WHERE type = 'group') AS n_groups, (SELECT count(*) FROM e) AS n_edges")
def canvas_counts(spark: SparkSession, folder: str) -> DataFrame:
    return canvas.canvas_counts(*_volume(spark, folder))


def _head_sql(tip: str, source: str) -> str:
    """The three points of an arrow head at one point, coming from another."""
    dx, dy = f"(x{tip} - x{source})", f"(y{tip} - y{source})"
    d = f"(CASE WHEN sqrt({dx} * {dx} + {dy} * {dy}) = 0 THEN 1.0 ELSE sqrt({dx} * {dx} + {dy} * {dy}) END)"
    bx, by = f"(x{tip} - {dx} / {d} * 12)", f"(y{tip} - {dy} / {d} * 12)"
    px, py = f"(-{dy} / {d} * 12 * 0.55)", f"({dx} / {d} * 12 * 0.55)"
    return f"""printf('<polygon points="%.1f,%.1f %.1f,%.1f %.1f,%.1f" fill="%s"/>', x{tip}, y{tip}, {bx} + {px}, {by} + {py}, {bx} - {px}, {by} - {py}, stroke)"""


@query(f"""{_sides()}, z AS (SELECT *, CASE WHEN color = '4' THEN '#44cf6e' WHEN color IS NULL THEN '#a3a3a3' ELSE color END AS stroke FROM q)
SELECT ord, printf('<path d="M%.1f,%.1f C%.1f,%.1f %.1f,%.1f %.1f,%.1f" stroke="%s" stroke-width="3" fill="none"/>', x0, y0, x1, y1, x2, y2, x3, y3, stroke) || CASE WHEN coalesce("toEnd", 'arrow') = 'arrow' THEN {_head_sql('3', '2')} ELSE '' END || CASE WHEN coalesce("fromEnd", 'none') = 'arrow' THEN {_head_sql('0', '1')} ELSE '' END AS path,
 CASE WHEN coalesce(label, '') = '' THEN '' ELSE printf('<div class="edge-label" style="left:%.1fpx;top:%.1fpx">', 0.125 * x0 + 0.375 * x1 + 0.375 * x2 + 0.125 * x3, 0.125 * y0 + 0.375 * y1 + 0.375 * y2 + 0.125 * y3) || replace(replace(replace(replace(label, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), '<br>') || '</div>' END AS label FROM z""")
def edge_paths(spark: SparkSession, folder: str) -> DataFrame:
    return canvas.edge_markup(canvas.edge_geometry(canvas.joined_edges(*_volume(spark, folder))))


_FILES = "files AS (SELECT path || '.md' AS path, min(cache_id) AS walk_ord FROM extraction_cache WHERE path IS NOT NULL GROUP BY path)"
_TARGETS = "targets AS (SELECT DISTINCT t AS target FROM (SELECT path AS t FROM extraction_cache UNION ALL SELECT string_split(path, '/')[-1] FROM extraction_cache UNION ALL SELECT upper(string_split(path, '/')[-1]) || '.MD' FROM extraction_cache UNION ALL SELECT 'no/such/' || cache_id FROM extraction_cache) WHERE t IS NOT NULL)"


@query(f"""WITH {_FILES}, {_TARGETS}, idx AS (SELECT DISTINCT k.key, path, walk_ord FROM files, (SELECT unnest([lower(string_split(path, '/')[-1]), regexp_replace(lower(string_split(path, '/')[-1]), '\\.md$', '')]) AS key, path AS p FROM files) k WHERE k.p = path),
c AS (SELECT target, 0 AS pr, 0 AS size, CAST(0 AS BIGINT) AS w, path FROM targets JOIN files ON path = target UNION ALL SELECT target, 1, 0, 0, path FROM targets JOIN files ON path = target || '.md'
 UNION ALL SELECT target, 2, len(path), walk_ord, path FROM targets JOIN idx ON key = lower(string_split(target, '/')[-1]) UNION ALL SELECT target, 3, len(path), walk_ord, path FROM targets JOIN idx ON key = lower(string_split(target, '/')[-1]) || '.md'),
best AS (SELECT target, path FROM c QUALIFY row_number() OVER (PARTITION BY target ORDER BY pr, size, w, path) = 1) SELECT target, path FROM targets LEFT JOIN best USING (target)""")
def link_resolve(spark: SparkSession, folder: str) -> DataFrame:
    cache = table(spark, folder, "extraction_cache").where("path IS NOT NULL")
    files = cache.groupBy(F.concat("path", F.lit(".md")).alias("path")).agg(F.min("cache_id").alias("walk_ord"))
    name = T.file_name(F.col("path"))
    targets = reduce(DataFrame.unionAll, [cache.select(c.alias("target")) for c in (F.col("path"), name, F.concat(F.upper(name), F.lit(".MD")), F.concat(F.lit("no/such/"), F.col("cache_id").cast("string")))])
    return canvas.resolve_links(targets, files)


# ---- fixtures ---------------------------------------------------------------------------------------------------


def _fixture(name: str, spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fixtures.ROWS[name], fixtures.SCHEMAS[name])


def _notes(spark: SparkSession, folder: str) -> DataFrame:
    """All documents, and the small notes, whose markup the documents have little of, under negative ids."""
    return texts(spark, folder, ["doc_id", "text"], "documents").withColumnRenamed("doc_id", "id").unionAll(_fixture("notes", spark).select((-F.col("id")).cast("bigint").alias("id"), "text"))


def _register_fixtures() -> None:
    for name, (on, run, sql) in FIXTURE_QUERIES.items():
        columns = ", ".join(c.split()[0] for c in fixtures.SCHEMAS[on].split(", "))

        def call(spark: SparkSession, folder: str, on: str = on, run: Callable[[DataFrame], DataFrame] = run) -> DataFrame:
            return run(_notes(spark, folder) if on == "notes" else _fixture(on, spark))

        QUERIES[name] = call
        if sql:
            values = ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int | float) else _quoted(v) for v in row) + ")" for row in fixtures.ROWS[on])
            ORACLES[name] = f"WITH small({columns}) AS (VALUES {values}), f AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT -id, text FROM small) {sql}" if on == "notes" else f"WITH f({columns}) AS (VALUES {values}) {sql}"


_PAIRS = lambda c, **named: F.array_join(F.transform(c, lambda s: F.concat_ws("~", *(s[k] for k in named))), "|")

_BOX = '<div class="callout" style="--c:%s"><div class="callout-title">%s</div><div class="callout-body"><p>%s</div></div>'

FIXTURE_QUERIES: dict[str, tuple[str, Callable[[DataFrame], DataFrame], str | None]] = {
    "tile_grid": (
        "pages",
        lambda f: canvas.tile_manifest(canvas.tile_plan(f, 2.0, 128), 2.0).select("id", "row", "col", "px", "py", "pw", "ph", "file"),
        """, g AS (SELECT id, width, height, CAST(ceil(width * 2.0) AS BIGINT) AS ow, CAST(ceil(height * 2.0) AS BIGINT) AS oh, 64 AS t FROM f),
c AS (SELECT *, r AS row, k AS col, k * t AS x, r * t AS y FROM g, range(0, 1000) rr(r), range(0, 1000) kk(k) WHERE r < ceil(height / t) AND k < ceil(width / t))
SELECT id, row, col, CAST(round_even(x * 2.0, 0) AS BIGINT) AS px, CAST(round_even(y * 2.0, 0) AS BIGINT) AS py, CAST(least(round_even((x + least(t, width - x)) * 2.0, 0), ow) - round_even(x * 2.0, 0) AS BIGINT) AS pw, CAST(least(round_even((y + least(t, height - y)) * 2.0, 0), oh) - round_even(y * 2.0, 0) AS BIGINT) AS ph, printf('tile_r%04d_c%04d.png', row, col) AS file FROM c""",
    ),
    "preview_size": (
        "pages",
        lambda f: canvas.tile_plan(f, 1.5, 256, 100).select("id", "out_width", "out_height", "cols", "rows", "preview_width", "preview_height"),
        """, g AS (SELECT id, width, height, CAST(ceil(width * 1.5) AS BIGINT) AS out_width, CAST(ceil(height * 1.5) AS BIGINT) AS out_height FROM f), s AS (SELECT *, least(1.0, 100 / greatest(out_width, out_height)) AS s FROM g)
SELECT id, out_width, out_height, CAST(ceil(width / 170) AS BIGINT) AS cols, CAST(ceil(height / 170) AS BIGINT) AS rows, greatest(1, CAST(round_even(out_width * s, 0) AS BIGINT)) AS preview_width, greatest(1, CAST(round_even(out_height * s, 0) AS BIGINT)) AS preview_height FROM s""",
    ),
    "colour_lookup": (
        "colours",
        lambda f: f.select("id", canvas.colour_of(F.col("color"), "#c8c8c8").alias("colour")),
        "SELECT id, CASE WHEN color IS NULL OR color = '' THEN '#c8c8c8' WHEN color = '1' THEN '#fb464c' WHEN color = '2' THEN '#e9973f' WHEN color = '3' THEN '#e0de71' WHEN color = '4' THEN '#44cf6e' WHEN color = '5' THEN '#53dfdd' WHEN color = '6' THEN '#a882ff' ELSE color END AS colour FROM f",
    ),
    "node_dispatch": (
        "nodes",
        lambda f: f.select("id", canvas.node_kind(F.col("type"), F.col("file"), F.col("resolved")).alias("kind")),
        r"""SELECT id, CASE WHEN coalesce(type, 'text') IN ('group', 'text', 'link') THEN coalesce(type, 'text') WHEN type <> 'file' THEN 'empty' WHEN resolved IS NULL THEN 'missing' WHEN regexp_matches(lower(resolved), '[^/]\.(png|jpg|jpeg|gif|bmp|svg|webp|avif)$') THEN 'image'
WHEN regexp_matches(lower(resolved), '[^/]\.md$') THEN 'note' WHEN regexp_matches(lower(resolved), '[^/]\.canvas$') THEN 'canvas' WHEN regexp_matches(lower(resolved), '[^/]\.pdf$') THEN 'pdf' ELSE 'file' END AS kind FROM f""",
    ),
    "subpath_extract": (
        "subpaths",
        lambda f: f.select("id", markup.subpath(F.col("text"), F.col("sub")).alias("section")),
        r""", l AS (SELECT id, sub, text, ls, i, ls[i] AS line FROM (SELECT *, string_split(text, chr(10)) AS ls FROM f), range(1, 1000) r(i) WHERE i <= len(ls)),
h AS (SELECT *, len(regexp_extract(line, '^(#{1,6})\s', 1)) AS lvl, lower(trim(regexp_extract(line, '^#{1,6}\s+(.*)$', 1))) AS title FROM l),
a AS (SELECT id, arg_min(i, i) AS at, arg_min(lvl, i) AS lvl FROM h WHERE lvl > 0 AND sub LIKE '#%' AND title = lower(trim(ltrim(sub, '#'))) GROUP BY id),
e AS (SELECT a.id, a.at, coalesce(min(h.i) FILTER (h.i > a.at AND h.lvl > 0 AND h.lvl <= a.lvl), any_value(len(h.ls)) + 1) AS stop FROM a JOIN h USING (id) GROUP BY a.id, a.at)
SELECT f.id, CASE WHEN e.id IS NULL THEN text ELSE array_to_string(list_slice(string_split(text, chr(10)), e.at, e.stop - 1), chr(10)) END AS section FROM f LEFT JOIN e USING (id)""",
    ),
    "comments_strip": ("notes", lambda f: f.select("id", markup.strip_comments(F.col("text")).alias("out")), "SELECT id, regexp_replace(text, '(?s)%%.*?%%', '', 'g') AS out FROM f"),
    "front_matter_strip": ("notes", lambda f: f.select("id", markup.strip_front_matter(F.col("text")).alias("out")), r"SELECT id, regexp_replace(text, '(?s)\A---\s*\n.*?\n---\s*(?:\n|\z)', '') AS out FROM f"),
    "embeds": (
        "notes",
        lambda f: f.select("id", _PAIRS(markup.embeds(F.col("text")), target=1, subpath=1, alias=1).alias("out")),
        r"SELECT id, array_to_string(list_transform(regexp_extract_all(text, '!\[\[[^\]|#^]*(?:[#^][^\]|]*)?(?:\|[^\]]*)?\]\]'), lambda m: regexp_replace(m, '^!\[\[([^\]|#^]*)([#^][^\]|]*)?(?:\|([^\]]*))?\]\]$', '\1~\2~\3')), '|') AS out FROM f",
    ),
    "wikilinks": (
        "notes",
        lambda f: f.select("id", _PAIRS(markup.wikilinks(F.col("text")), target=1, label=1).alias("out")),
        r"SELECT id, array_to_string(list_transform(regexp_extract_all(regexp_replace(text, '!\[\[[^\]|#^]*(?:[#^][^\]|]*)?(?:\|[^\]]*)?\]\]', '', 'g'), '\[\[[^\]|]*(?:\|[^\]]*)?\]\]'), lambda m: regexp_extract(m, '^\[\[([^\]|]*)', 1) || '~' || coalesce(nullif(regexp_extract(m, '\|([^\]]*)\]\]$', 1), ''), regexp_extract(m, '^\[\[([^\]|]*)', 1))), '|') AS out FROM f",
    ),
    "tags": ("notes", lambda f: f.select("id", F.array_join(markup.tags(F.col("text")), "|").alias("out")), r"SELECT id, array_to_string(list_transform(regexp_extract_all(text, '(?:^|[^\w&/#])#[A-Za-z_][\w/-]*'), lambda m: regexp_extract(m, '#(.*)$', 1)), '|') AS out FROM f"),
    "highlights": ("notes", lambda f: f.select("id", markup.highlight_markup(F.col("text")).alias("out")), r"SELECT id, regexp_replace(text, '==(\S|\S.*?\S)==', '<mark>\1</mark>', 'g') AS out FROM f"),
    "md_images": (
        "notes",
        lambda f: f.select("id", _PAIRS(markup.images(F.col("text")), alt=1, target=1).alias("out")),
        r"SELECT id, array_to_string(list_transform(list_filter(regexp_extract_all(text, '!\[[^\]]*\]\([^)\s]+(?:\s+\x22[^\x22]*\x22)?\)'), lambda m: NOT regexp_matches(m, '\]\((?:https?:|data:|file:)')), lambda m: regexp_extract(m, '^!\[([^\]]*)\]', 1) || '~' || replace(regexp_extract(m, '\]\(([^)\s]+)', 1), '%20', ' ')), '|') AS out FROM f",
    ),
    "math_spans": (
        "notes",
        lambda f: f.select("id", F.array_join(markup.math_blocks(F.col("text")), "|").alias("blocks"), F.array_join(markup.inline_math(F.col("text")), "|").alias("spans")),
        r"SELECT id, array_to_string(list_transform(regexp_extract_all(text, '(?s)\$\$(.+?)\$\$', 1), lambda m: trim(m)), '|') AS blocks, array_to_string(list_transform(regexp_extract_all(regexp_replace(text, '(?s)\$\$.+?\$\$', '', 'g'), '(?:^|[^\\$])\$[^\s$](?:[^$\n]*[^\s$])?\$(?:\D|$)'), lambda m: regexp_extract(m, '\$([^$]+)\$', 1)), '|') AS spans FROM f",
    ),
    "task_lists": (
        "html",
        lambda f: f.select("id", markup.task_lists(F.col("text")).alias("out")),
        r"""SELECT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '<li>\s*\[ \]\s*', '<li class="task">☐ ', 'g'), '<li>\s*\[[xX]\]\s*', '<li class="task done">☑ ', 'g'), '<li>\s*<p>\s*\[ \]\s*', '<li class="task"><p>☐ ', 'g'), '<li>\s*<p>\s*\[[xX]\]\s*', '<li class="task done"><p>☑ ', 'g') AS out FROM f""",
    ),
    "mermaid_rewrite": (
        "html",
        lambda f: f.select("id", markup.mermaid_blocks(F.col("text")).alias("out"), markup.uses_mermaid(F.col("text")).alias("uses_mermaid")),
        r"""SELECT id, regexp_replace(text, '(?s)<pre><code class="language-mermaid">(.*?)</code></pre>', '<pre class="mermaid">\1</pre>', 'g') AS out, contains(text, 'class="language-mermaid"') AS uses_mermaid FROM f""",
    ),
    "capability_flags": ("notes", lambda f: f.agg(F.bool_or(markup.uses_math(F.col("text"))).alias("uses_math"), F.count(F.lit(1)).alias("n_notes")), "SELECT bool_or(contains(text, '$$')) AS uses_math, count(*) AS n_notes FROM f"),
    "callouts": (
        "html",
        lambda f: f.select("id", markup.callouts(F.col("text")).alias("out")),
        "SELECT id, CASE id WHEN 2 THEN "
        + _quoted(_BOX % ("#ec7500", "Mind this", "body</p>\n") + "<p>after</p>")
        + " WHEN 3 THEN "
        + _quoted(_BOX % ("#086ddd", "Odd", "\ntext</p>") + "<blockquote><p>plain</p></blockquote>")
        + " ELSE text END AS out FROM f",
    ),
    "image_sizes": (
        "sizes",
        lambda f: f.select("id", markup.image_style(F.col("size")).alias("style")),
        r"""SELECT id, CASE WHEN regexp_matches(coalesce(size, ''), '^\s*\d+\s*(?:x\s*\d+)?\s*$') THEN ' style="width:' || regexp_extract(size, '^\s*(\d+)', 1) || 'px;' || CASE WHEN regexp_matches(size, 'x') THEN 'height:' || regexp_extract(size, 'x\s*(\d+)', 1) || 'px;' ELSE '' END || '"' ELSE '' END AS style FROM f""",
    ),
}
_register_fixtures()


@query(f"SELECT {_quoted(fixtures.PAGE)} AS html, CAST(360 AS BIGINT) AS width, CAST(300 AS BIGINT) AS height")
def html_pages(spark: SparkSession, folder: str) -> DataFrame:
    return html_page(_fixture("canvas_nodes", spark), _fixture("canvas_edges", spark), _fixture("vault", spark))


@query(f"SELECT cache_id, path, CAST(len(pages) AS INTEGER) AS n_pages, {_RAW} AS text FROM extraction_cache")
def cache_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    # the cache as JSON lines and back, within the plan
    cache = table(spark, folder, "extraction_cache")
    lines = cache.select("cache_id", F.to_json(F.struct("path", "pages")).alias("line"))
    return lines.select("cache_id", F.from_json("line", corpus.CACHE_SCHEMA).alias("r")).select("cache_id", "r.path", F.when(F.col("r.pages").isNotNull(), F.size("r.pages")).alias("n_pages"), T.join_pages(F.col("r.pages")).alias("text"))
