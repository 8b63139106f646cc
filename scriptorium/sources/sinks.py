"""Writers of the reports; each writes one folder, and only small reports are brought into one file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from scriptorium.functions import text as T
from scriptorium.functions.taxonomy import Taxonomy

#: Lines of a report for the console; a longer one is an error.
MAX_LINES = 1000


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with a header; nulls and empty texts both as empty fields, flags as True and False."""
    flags = {c: F.when(F.col(c), "True").when(~F.col(c), "False") for c, kind in df.dtypes if kind == "boolean"}
    out = df.withColumns(flags) if flags else df
    (out.coalesce(1) if single else out).write.mode("overwrite").option("header", "true").option("emptyValue", "").option("nullValue", "").option("escape", '"').csv(path)


def per_document_report(profiled: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """The wide table of a run: fixed columns, then every concept, frame and percentage, in corpus order."""
    shares = [T.round_exactly(100 * F.col(f"frame_share__{f}"), 2).alias(f"frame_pct__{f}") for f in taxonomy.frame_order]
    fixed = [T.file_name(F.col("path")).alias("filename"), "path", "extraction_ok", "char_count", "total_hits", "breadth", "dominant_frame"]
    return profiled.select(*fixed, *(f"concept__{c}" for c in taxonomy.concepts), *(f"frame_hits__{f}" for f in taxonomy.frame_order), *shares).orderBy(F.split("path", "/"))


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_text(df: DataFrame, column: str, path: str) -> None:
    """One text a row, as it is: the summary, or a page of HTML."""
    df.select(F.col(column).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def console_table(df: DataFrame, widths: dict[str, int], decimals: int = 1) -> list[str]:
    """A small report as fixed-width lines, its header first: numbers to the right, the rest to the left."""
    cells = []
    for name, width in widths.items():
        kind = dict(df.dtypes)[name]
        value = F.when(F.col(name).isNotNull(), F.format_string(f"%.{decimals}f", F.col(name))) if kind in ("double", "float") else F.col(name).cast("string")
        value = F.coalesce(value, F.lit(""))
        cells.append(F.rpad(value, width, " ") if kind == "string" else F.lpad(value, width, " "))
    header = "  ".join(name[:width].ljust(width) if dict(df.dtypes)[name] == "string" else name[:width].rjust(width) for name, width in widths.items())
    lines = df.select(F.concat_ws("  ", *cells).alias("line")).limit(MAX_LINES + 1).collect()
    if len(lines) > MAX_LINES:
        raise ValueError(f"a report of more than {MAX_LINES} lines belongs in a file, not on the console")
    return [header, *(r["line"] for r in lines)]


def observed(profiled: DataFrame, name: str = "corpus") -> tuple[DataFrame, Observation]:
    """The profiles with a count of documents, failed extractions and hits taken as they pass, without another job."""
    metrics = Observation(name)
    return profiled.observe(metrics, F.count(F.lit(1)).alias("documents"), F.count_if(~F.col("extraction_ok")).alias("failed"), F.coalesce(F.sum("total_hits"), F.lit(0)).alias("hits")), metrics
