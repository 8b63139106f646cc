"""An extension: profiles of documents as they arrive, and running sums by frame and day."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from scriptorium.functions.taxonomy import Taxonomy
from scriptorium.operators.concepts import hits_long, profile


def watch_cache(spark: SparkSession, folder: str, schema: str = "path string, pages array<string>, cached_at timestamp") -> DataFrame:
    """A stream of the cache files (JSON lines) that appear in a folder."""
    return spark.readStream.schema(schema).json(folder)


def running_dominance(documents: DataFrame, taxonomy: Taxonomy, phrases: Iterable[str] = (), late: str = "30 days", window: str = "1 day") -> DataFrame:
    """(day, frame, hits) over a stream with ``cached_at``; rows later than ``late`` are too late."""
    profiled = profile(documents.withWatermark("cached_at", late), taxonomy, phrases, keep=["path", "cached_at"])
    long = hits_long(profiled, taxonomy, keep=["cached_at"])
    return long.groupBy(F.window("cached_at", window).alias("_w"), "frame").agg(F.sum("hits").alias("hits")).select(F.col("_w.start").alias("day"), "frame", "hits")


def append_profiles(documents: DataFrame, taxonomy: Taxonomy, output: str, checkpoint: str, phrases: Iterable[str] = ()) -> StreamingQuery:
    """Write the profile of every new document to a folder, each once."""
    return profile(documents, taxonomy, phrases).writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
