"""Numbers in a global order, without bringing the rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scriptorium.session import cut


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """The rows with their number, from 1, in the given order.

    The rows are sorted by ranges and kept in the checkpoint folder, so that their places hold; only the number of
    rows of each partition reaches the driver.
    """
    placed = cut(df.orderBy(*order)).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    before, offsets = 0, []
    for part, n in sorted(placed.groupBy("_part").agg(F.count(F.lit(1))).collect()):
        offsets.append((part, before))
        before += n
    # one row a partition
    starts = df.sparkSession.createDataFrame(offsets, "_part int, _before bigint")
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")
