"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from scriptorium.session import cut, drop_checkpoint

__all__ = ["bounded_sample", "cut", "drop_checkpoint", "measured", "table"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def measured(df: DataFrame, text: str) -> tuple[int, int]:
    """Rows and characters of a column, to decide whether a side may be broadcast."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("c")).first()
    return int(row["n"]), int(row["c"])


def bounded_sample(rows: DataFrame, key: str, size: int, total: int) -> DataFrame:
    """At most ``size`` of the ``total`` rows by the hash of a key, the same ones on every run.

    Only about one and a half times as many rows pass the hash, whatever the table's size, so that no task and no
    driver ever holds more: a plain ordered limit would bring ``size`` rows from every partition.
    """
    share = min(1.0, 1.5 * size / max(total, 1))
    place = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    return rows.where(place < int(share * (1 << 30)) + 1).orderBy(place, key).limit(size)
