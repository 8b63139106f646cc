"""Readers: files of a corpus, extraction caches, exclusion lists, canvases and vaults."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scriptorium.functions.text import file_name

CACHE_SCHEMA = "path string, pages array<string>"
NODE_SCHEMA = "id string, type string, x double, y double, width double, height double, color string, label string, background string, backgroundStyle string, text string, url string, file string, subpath string"
EDGE_SCHEMA = "id string, fromNode string, toNode string, fromSide string, toSide string, fromEnd string, toEnd string, color string, label string"
CANVAS_SCHEMA = f"nodes array<struct<{NODE_SCHEMA.replace(' string', ': string').replace(' double', ': double')}>>, edges array<struct<{EDGE_SCHEMA.replace(' string', ': string')}>>"


def discover(spark: SparkSession, folder: str, glob: str = "*.pdf", content: bool = True) -> DataFrame:
    """(path, modificationTime, length, content) of every file below a folder; the suffix is case-sensitive."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    return found if content else found.drop("content")


def exclusion_patterns(path: str | None) -> list[str]:
    """Patterns of a list, one a line; blank lines and comments are skipped, and what is no expression is taken literally.

    A line counts as an expression by Python's rules; the forms that Java writes otherwise are rewritten.
    """
    if not path:
        return []
    out = []
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        pattern = line.strip()
        if not pattern or pattern.startswith("#"):
            continue
        try:
            re.compile(pattern)
            pattern = _java_form(pattern)
        except re.error:
            pattern = r"\Q" + pattern.replace(r"\E", r"\E\\E\Q") + r"\E"
        out.append(pattern)
    return out


def _java_form(pattern: str) -> str:
    """Named groups, their references and the end of the text as Java writes them."""
    for python, java in ((r"\(\?P<", "(?<"), (r"\(\?P=(\w+)\)", r"\\k<\1>"), (r"(?<!\\)((?:\\\\)*)\\Z", r"\1\\z")):
        pattern = re.sub(python, java, pattern)
    return pattern


def checked_patterns(spark: SparkSession, patterns: Iterable[str]) -> list[str]:
    """The patterns, after the engine that will run them has compiled each; one that it can't read is an error."""
    known = list(patterns)
    for pattern in known:
        try:
            spark.range(1).where(F.col("id").cast("string").rlike(f"(?iU){pattern}")).count()
        except Exception as error:
            raise ValueError(f"not an expression that can be run: {pattern}") from error
    return known


def excluded(path: Column, patterns: Iterable[str]) -> Column:
    """Whether any pattern occurs in the file name or the path, without regard to case."""
    tests = [file_name(path).rlike(f"(?iU){p}") | path.rlike(f"(?iU){p}") for p in patterns]
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def without_excluded(documents: DataFrame, patterns: Iterable[str], path: str = "path") -> DataFrame:
    return documents.where(~F.coalesce(excluded(F.col(path), patterns), F.lit(False)))


def extract_pages(files: DataFrame, *extractors: Callable[[bytes], list[str]]) -> DataFrame:
    """(path, pages) by the first extractor that succeeds on a file's bytes; an empty array if none does.

    No extractor comes with the engine: reading PDF files needs a library of the caller's choice.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pages = []
            for content in batch["content"]:
                found: list[str] = []
                for extract in extractors:
                    try:
                        found = list(extract(bytes(content)))
                        break
                    except Exception:  # noqa: BLE001 - any failure hands over to the next extractor
                        continue
                pages.append(found)
            yield pd.DataFrame({"path": batch["path"], "pages": pages})

    return files.select("path", "content").mapInPandas(run, CACHE_SCHEMA)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """An extraction cache of JSON lines, by its fixed schema."""
    return spark.read.schema(CACHE_SCHEMA).json(path)


def cached_pages(spark: SparkSession, cache: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The cache where there is one, and else what ``build`` returns, written there first."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        build().select("path", "pages").write.json(cache)
    return read_cache(spark, cache)


def read_canvas(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of canvas files, with their place in the file as ``ord`` and the file as ``canvas``."""
    whole = spark.read.schema(CANVAS_SCHEMA).option("multiLine", "true").json(path).withColumn("canvas", F.input_file_name())
    nodes = whole.select("canvas", F.posexplode("nodes").alias("ord", "n")).select("canvas", "ord", "n.*")
    edges = whole.select("canvas", F.posexplode("edges").alias("ord", "e")).select("canvas", "ord", "e.*")
    return nodes.withColumn("type", F.coalesce("type", F.lit("text"))), edges


def vault_root(canvas: str) -> str:
    """The nearest folder above a canvas that holds a vault's settings, or else the canvas's own."""
    own = Path(canvas).resolve().parent
    return str(next((p for p in (own, *own.parents) if (p / ".obsidian").is_dir()), own))


def vault_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, walk_ord, content) of a vault's files, relative to its root, outside hidden folders."""
    base = "file:" + str(Path(root).resolve()) + "/"
    found = discover(spark, root, "*")
    relative = F.expr(f"substring(regexp_replace(path, '^file:/+', 'file:/'), {len(base) + 1})")
    parts = F.split("path", "/")
    shown = found.select(relative.alias("path"), "content").where(~F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda d: d.startswith(".")))
    return shown.select("path", F.xxhash64("path").alias("walk_ord"), "content")


def note_text(content: Column) -> Column:
    """Bytes as UTF-8, wrong ones replaced; null as empty."""

    @F.pandas_udf("string")
    def decoded(values: pd.Series) -> pd.Series:
        return values.map(lambda b: "" if b is None else bytes(b).decode("utf-8", "replace"))

    return decoded(content)
