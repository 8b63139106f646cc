"""What a link within a vault means."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from scriptorium.functions import text as T

# Suffixes of images.
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".svg", ".webp", ".avif")


def vault_index(files: DataFrame) -> DataFrame:
    """(key, path, suffix, walk_ord): lower-case name and stem of every file outside hidden folders.

    ``files`` has (path, walk_ord), path relative to the vault; hidden files are kept.
    """
    parts = F.split(F.col("path"), "/")
    shown = files.where(~F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda d: d.startswith(".")))
    name = F.lower(T.file_name(F.col("path")))
    suffix = F.regexp_extract(name, r"(?<=.)\.[^.]+\z", 0)
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(suffix))
    return shown.select(F.explode(F.array_distinct(F.array(name, stem))).alias("key"), "path", suffix.alias("suffix"), "walk_ord")


def resolve_links(targets: DataFrame, files: DataFrame) -> DataFrame:
    """(target, path): the file each distinct link target means, null where there is none.

    In order: the exact path, the path with ".md", a file of that name or stem anywhere, and one of that name with
    ".md"; among the last two a note before other files, then the shortest path, then the first found.
    """
    wanted = targets.select("target").distinct().withColumn("clean", T.strip(F.col("target")))
    named = wanted.where("clean <> ''")
    direct = files.select(F.col("path").alias("found"))
    index = vault_index(files)
    name = F.lower(T.file_name(F.regexp_replace("clean", "/+$", "")))
    tries = (
        named.join(direct, F.col("clean") == F.col("found")).select("target", F.lit(0).alias("priority"), F.lit(False).alias("other"), F.lit(0).alias("size"), F.lit(0).cast("bigint").alias("walk_ord"), "found")
        .unionAll(named.join(direct, F.concat("clean", F.lit(".md")) == F.col("found")).select("target", F.lit(1), F.lit(False), F.lit(0), F.lit(0).cast("bigint"), "found"))
        .unionAll(named.join(index, name == F.col("key")).select("target", F.lit(2), F.col("suffix") != ".md", F.length("path"), F.col("walk_ord").cast("bigint"), "path"))
        .unionAll(named.join(index, F.concat(name, F.lit(".md")) == F.col("key")).select("target", F.lit(3), F.col("suffix") != ".md", F.length("path"), F.col("walk_ord").cast("bigint"), "path"))
    )
    # the least candidate is kept while aggregating, so that a popular name is never gathered in one task
    best = tries.groupBy("target").agg(F.min(F.struct("priority", "other", "size", "walk_ord", "found"))["found"].alias("path"))
    return wanted.select("target").join(best, "target", "left")
